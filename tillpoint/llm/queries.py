"""The thin queries over the given tables, and their DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillpoint.llm import (centroids, chat, chunkdedup, decontaminate, langid, mixing, packing, periodic, quality, secretscan,
                           sharding, simhash, toxicity)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


_WORDS = ("regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")
_OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
p AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, list_slice(w, i, i + least(10, len(w)) - 1) AS k
      FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT m FROM p),
dw AS (SELECT rid, m, i, list_slice(w, i, i + m - 1) AS k FROM d, lengths, unnest(range(1, len(w) - m + 2)) AS t(i)),
hits AS (SELECT rid, item_id, dw.m AS m, i FROM dw JOIN p ON dw.k = p.k AND dw.m = p.m),
covered AS (SELECT rid, count(DISTINCT pos) AS n FROM hits, unnest(range(i, i + m)) AS t(pos) GROUP BY rid),
found AS (SELECT rid, count(DISTINCT item_id) AS n, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids
          FROM hits GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(covered.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, covered.n IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN found USING (rid)
"""


@_query("op1_decontamination", _OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("item_ids")


_OP2_SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS name, coalesce(text, '') AS text FROM conversations),
parties AS (SELECT DISTINCT conv_id, name AS perspective FROM turns WHERE name <> 'system'),
rendered AS (
  SELECT t.conv_id, p.perspective, t.turn, t.name, t.text,
         CASE WHEN t.name = 'system' THEN 'system' WHEN t.name = p.perspective THEN 'assistant'
              ELSE 'user:' || t.name END AS speaker
  FROM turns t JOIN parties p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
segments AS (
  SELECT *, '<|' || speaker || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) AS segment,
         length(speaker) + 5 AS head
  FROM rendered),
placed AS (
  SELECT *, CAST(length(segment) AS BIGINT) AS length,
         row_number() OVER w - 1 AS position,
         CAST(sum(length(segment)) OVER w - length(segment) AS BIGINT) AS start
  FROM segments
  WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, name, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, CAST(position AS BIGINT) AS position, turn, speaker, segment, start, length,
       CASE WHEN speaker = 'assistant' THEN CAST(start + head AS BIGINT) END AS mask_start,
       CASE WHEN speaker = 'assistant' THEN CAST(length - head AS BIGINT) ELSE 0 END AS mask_length
FROM placed
"""


@_query("op2_chat_perspectives", _OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


@_query("op3_chunk_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunkdedup.dedup(table(spark, sf_dir, "documents"), whole_texts=True).drop("row")


@_query("op4_secret_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan(table(spark, sf_dir, "documents"))


@_query("op5_simhash_near_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@_query("op6_quality_rules")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


@_query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = remainder(4) == 2
    index = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held))
    out = toxicity.score(docs, index).withColumn("held_out", F.coalesce(held, F.lit(False)))
    return out.select("doc_id", "held_out", "score", "predicted", "evidence_ids", "evidence_sims", "evidence_toxic")


@_query("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = remainder(5) == 0
    net = langid.fit(docs.where(~held))
    out = langid.predict(docs, net).withColumn("held_out", F.coalesce(held, F.lit(False)))
    return out.select("doc_id", "held_out", "lang_pred", "score")


@_query("op9_sharding")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


@_query("op10_best_fit_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def _op11_sql(k: int = centroids.CLUSTERS, rounds: int = centroids.ROUNDS) -> str:
    squared = "list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))"
    parts = [f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1 AS j, v AS c FROM v QUALIFY j < {k})"""]
    for r in range(rounds + 1):
        parts.append(f"""
a{r} AS MATERIALIZED (
  SELECT rid, first(vec_id) AS vec_id, first(v) AS v, min({{'d': d, 'j': j}}) AS near
  FROM (SELECT rid, vec_id, v, j, CAST({squared} AS BIGINT) AS d FROM v, c{r}) GROUP BY rid)""")
        if r < rounds:
            parts.append(f"""
m{r} AS (
  SELECT j, list(CAST(floor_mean AS BIGINT) ORDER BY i) AS c
  FROM (SELECT j, i, (s - ((s % n) + n) % n) // n AS floor_mean
        FROM (SELECT near.j AS j, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, range(1, 65) t(i) GROUP BY ALL))
  GROUP BY j),
c{r + 1} AS MATERIALIZED (SELECT c{r}.j AS j, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (j))""")
    return ",".join(parts) + f"""
SELECT vec_id, CAST(near.j AS INTEGER) AS cluster, near.d AS distance,
       CAST(sum(near.d) OVER (PARTITION BY near.j) AS BIGINT) AS cluster_inertia,
       CAST(sum(near.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c{rounds}.j = near.j"""


@_query("op11_ptolemaic_clusters", _op11_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings")).drop("centroid")


_OP12_SQL = """
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
weighed AS (
  SELECT *, source_no % 3 + 1 AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_no
        FROM d GROUP BY source)),
levels AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW o AS (ORDER BY source_size / weight, source_no)),
level AS (SELECT arg_min(level, (source_size / weight, source_no)) AS level FROM levels WHERE 3 * source_size >= weight * level * (1 - 1e-12)),
sources AS MATERIALIZED (
  SELECT *, quota_at + quota AS quota_to FROM (
    SELECT *, coalesce(sum(quota) OVER (ORDER BY source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS quota_at
    FROM (SELECT *, CASE WHEN blocks > 0 THEN least(floor(target / source_size * blocks + 0.5), 3 * blocks) ELSE 0 END::BIGINT AS quota
          FROM (SELECT source, source_no, source_size, least(weight * level, 3.0 * source_size) AS target, ceil(source_size / 32)::BIGINT AS blocks
                FROM weighed, level)))),
size AS (
  SELECT *, total // per_shard // 2 AS drawn_shards
  FROM (SELECT sum(quota)::BIGINT AS total, greatest(256, floor(sqrt(sum(quota)))::BIGINT) AS per_shard FROM sources)),
drawn AS MATERIALIZED (
  SELECT id // per_shard AS shard, id % per_shard AS slot, source_no, quota, row_number() OVER (PARTITION BY source_no ORDER BY id) - 1 AS t
  FROM (SELECT unnest(range(drawn_shards * per_shard)) AS id, per_shard, total FROM size)
  JOIN sources ON ('0x' || substr(md5('12:slot:' || id), 1, 13))::BIGINT % greatest(1, total) >= quota_at
              AND ('0x' || substr(md5('12:slot:' || id), 1, 13))::BIGINT % greatest(1, total) < quota_to),
held AS (SELECT source_no, count(*) FILTER (t < quota) AS had FROM drawn GROUP BY source_no),
rest AS MATERIALIZED (
  SELECT *, coalesce(sum(n) OVER (ORDER BY source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS left_at
  FROM (SELECT source_no, coalesce(had, 0) AS had, quota - coalesce(had, 0) AS n FROM sources LEFT JOIN held USING (source_no))),
filled AS MATERIALIZED (
  SELECT source_no, t FROM drawn WHERE t < quota UNION ALL SELECT source_no, unnest(range(had, had + n)) FROM rest),
wanted AS MATERIALIZED (
  SELECT source_no, blocks, t // blocks AS epoch, t % blocks AS i FROM filled JOIN sources USING (source_no)),
keys AS MATERIALIZED (
  SELECT source_no, epoch, r, ('0x' || substr(md5('12:block:' || source_no || ':' || epoch || ':' || r || ':a'), 1, 13))::BIGINT % blocks AS a,
         ('0x' || substr(md5('12:block:' || source_no || ':' || epoch || ':' || r || ':c'), 1, 13))::BIGINT % 2147483647 AS c
  FROM (SELECT DISTINCT source_no, epoch, blocks FROM wanted), range(1, 25) t(r)),
shuffled AS (
  SELECT source_no, epoch, blocks, i AS x, 0 AS r FROM wanted
  UNION ALL
  SELECT source_no, epoch, blocks, CASE WHEN (y * y % 2147483647) * y % 2147483647 % 2 = 1 THEN other ELSE x END, r
  FROM (SELECT *, (greatest(x, other) % 2147483647 + c) % 2147483647 AS y
        FROM (SELECT s.source_no, s.epoch, blocks, x, ((a - x) % blocks + blocks) % blocks AS other, c, k.r AS r
              FROM shuffled s JOIN keys k ON k.source_no = s.source_no AND k.epoch = s.epoch AND k.r = s.r + 1))),
times AS (SELECT source_no, x AS block, count(*) AS times FROM shuffled WHERE r = 24 GROUP BY ALL),
number AS (SELECT floor(sqrt(greatest(1, count(*))))::BIGINT + 1 AS buckets FROM d),
placed AS MATERIALIZED (
  SELECT rid, doc_id, size, d.source AS source, source_size, target, source_no,
         sum(size) OVER (PARTITION BY source_no ORDER BY ('0x' || substr(md5('12:doc:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT % buckets,
                         doc_id NULLS FIRST, size, rid ROWS UNBOUNDED PRECEDING)::BIGINT - size AS start
  FROM d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source, number),
pieces AS (
  SELECT rid, source_no, start, size, unnest(range(start // 32, (start + size - 1) // 32 + 1)) AS block FROM placed WHERE size > 0),
taken AS (
  SELECT rid, sum((least(start + size, block * 32 + 32) - greatest(start, block * 32)) * times) AS taken
  FROM pieces JOIN times USING (source_no, block) GROUP BY rid)
SELECT doc_id, size, source, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM placed LEFT JOIN taken USING (rid)
"""


@_query("op12_source_mixing", _OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).taken()


def _extended_tails(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: where h = crc32(doc_id) ends in 0, the words from the (h / 10 mod n)th on repeat by a period."""
    i = "((crc32(cast(cast(doc_id as string) as binary)) div 10)"
    tail = (f"transform(array(w), w -> transform(array(struct(cast(size(w) as bigint) as n, {i} % size(w)) as a, {i} % 8) as s)), "
            "x -> array_join(transform(w, (v, i) -> if(i < x.a, v, get(w, cast(x.a + (i - x.a) % "
            "(1 + (x.n - x.a) div (3 + x.s)) as int)))), ' '))[0])[0]")
    return docs.withColumn("w", quality.word_list("text")).select(
        "doc_id", F.when((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0) & (F.size("w") > 0), F.expr(tail))
                   .otherwise(F.col("text")).alias("text"))


_OP13_SQL = """
WITH bits AS (
  SELECT n, list_reduce([n]::BIGINT[] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS x
  FROM range(256) t(n)),
crc_table AS (SELECT list(x ORDER BY n) AS t FROM bits),
d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w,
         xor(list_reduce([4294967295]::BIGINT[] || list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda k: ascii(substr(doc_id::VARCHAR, k, 1))::BIGINT),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM documents, crc_table),
g AS (SELECT *, len(w) AS n, h // 10 AS g FROM d),
a AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM g),
words AS MATERIALIZED (
  SELECT rid, doc_id, n,
         CASE WHEN h % 10 = 0 AND n > 0
              THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END)
              ELSE w END AS w
  FROM a),
tokens AS MATERIALIZED (SELECT rid, n, unnest(w) AS w, unnest(range(n)) AS i FROM words),
same AS (
  SELECT x.rid AS rid, y.i - x.i AS p, x.i AS i
  FROM tokens x JOIN tokens y ON x.rid = y.rid AND x.w = y.w AND y.i > x.i AND y.i - x.i <= x.n // 4),
islands AS (SELECT rid, p, i, i - row_number() OVER (PARTITION BY rid, p ORDER BY i) AS island FROM same),
regions AS (
  SELECT rid, p, min(i) AS start, count(*) + p AS length FROM islands
  GROUP BY rid, p, island HAVING count(*) + p >= greatest(6, 4 * p)),
runs AS MATERIALIZED (SELECT rid, start, length, min(p) AS period FROM regions GROUP BY rid, start, length),
per AS (
  SELECT rid, count(*) AS n_runs, min({'o': -length, 'start': start, 'period': period, 'length': length}) AS best,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
         list_distinct(flatten(list(range(start + period, start + length)))) AS gone
  FROM runs GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period,
       1000 * best.length // best.period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
       sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w
                       ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i - 1)) END, ' '), '')) AS collapsed_sha256
FROM words LEFT JOIN per USING (rid)
"""


@_query("op13_periodic_runs", _OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.collapse(_extended_tails(table(spark, sf_dir, "documents"))).withColumn("best", periodic.longest("runs"))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
