"""Registered queries: K-Means, Gaussian mixture, k-distance, DBSCAN, reports (§2.10)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillpoint.cluster import batched as bt
from tillpoint.cluster.knn import k_distance, k_distance_curve
from tillpoint.cluster.mixture import assign_mixture, assign_to_centres, elbow, fit_gmm, fit_kmeans, inertia_k1
from tillpoint.operators import aggregates as agg
from tillpoint.operators import cleaning as cl
from tillpoint.operators.encode import kmeans_design
from tillpoint.operators.pca import fit_pca
from tillpoint.operators.quantiles import exact_quantiles
from tillpoint.operators.scale import scale
from tillpoint.plans.cleaning import cleaned, cleaned_sales
from tillpoint.plans.common import CLEAN_CTES, KEYS_SQL, r, rounded, with_sales
from tillpoint.plans.registry import query
from tillpoint.plans.transforms import _PCA_CTES, standardized_pca_input
from tillpoint.session import discard
from tillpoint.sources.sales import COPIES, EXTRA_KEYS, ORDER_KEYS, ROW_NAME, SALES_COLUMNS, SHORT_KEYS, sales_from_tables, stored_lines

# Seeding of the exact assignment check: centres at these quantiles of each feature.
SEED_PROBS = [1 / 6, 1 / 2, 5 / 6]
_FEATS = ["Quantity", "UnitPrice"]


def quantile_seeded(spark, sf_dir):
    """G1 assignment step on the cleaned lines with centres at fixed quantiles."""
    clean = cleaned_sales(spark, sf_dir)
    q = {(r_["column"], round(r_["prob"], 9)): r_["value"]
         for r_ in exact_quantiles(clean, _FEATS, SEED_PROBS).collect()}
    centres = [[q[(c, round(p, 9))] for c in _FEATS] for p in SEED_PROBS]
    return assign_to_centres(clean, _FEATS, centres)


def _d(j: int) -> str:
    return f"(Quantity - cq{j}) * (Quantity - cq{j}) + (UnitPrice - cp{j}) * (UnitPrice - cp{j})"


_ASSIGN_CTES = [
    "cen AS (SELECT " + ", ".join(
        f"quantile_cont(Quantity, {p!r}) AS cq{j}, quantile_cont(UnitPrice, {p!r}) AS cp{j}"
        for j, p in enumerate(SEED_PROBS)) + " FROM clean)",
    f"asg AS (SELECT clean.*, CAST(CASE WHEN {_d(0)} <= {_d(1)} AND {_d(0)} <= {_d(2)} THEN 0 "
    f"WHEN {_d(1)} <= {_d(2)} AND {_d(1)} < {_d(0)} THEN 1 ELSE 2 END AS INTEGER) AS Cluster FROM clean, cen)",
]


@query("kmeans_assign", with_sales(*CLEAN_CTES, *_ASSIGN_CTES) + f"SELECT {KEYS_SQL}, Cluster FROM asg")
def q_kmeans_assign(spark, sf_dir):
    """G1 assignment with fixed centres (nearest centre, first on ties)."""
    return quantile_seeded(spark, sf_dir).select(*ORDER_KEYS, "Cluster")


def _profile_sql(src: str, key: str) -> str:
    cols = []
    for c in _FEATS:
        cols += [f"{r(f'avg({c})')} AS {c}_mean", f"{r(f'median({c})')} AS {c}_median",
                 f"{r(f'stddev_samp({c})')} AS {c}_std", f"{r(f'min({c})')} AS {c}_min",
                 f"{r(f'max({c})')} AS {c}_max"]
    return f"SELECT {key}, " + ", ".join(cols) + f" FROM {src} GROUP BY {key}"


@query("assigned_cluster_profile", with_sales(*CLEAN_CTES, *_ASSIGN_CTES) + _profile_sql("asg", "Cluster"))
def q_assigned_cluster_profile(spark, sf_dir):
    """Mean, exact median, sample std, min, max per cluster."""
    return rounded(agg.cluster_profile(quantile_seeded(spark, sf_dir), "Cluster", _FEATS))


@query("assigned_cluster_sizes", with_sales(*CLEAN_CTES, *_ASSIGN_CTES)
       + "SELECT Cluster, count(*) AS count FROM asg GROUP BY 1")
def q_assigned_cluster_sizes(spark, sf_dir):
    """Rows per cluster, largest first."""
    return agg.cluster_sizes(quantile_seeded(spark, sf_dir), "Cluster")


@query("assigned_cluster_summary", with_sales(*CLEAN_CTES, *_ASSIGN_CTES) + f"""
SELECT Cluster, {r('avg(Quantity)')} AS Quantity_mean, min(Quantity) AS Quantity_min, max(Quantity) AS Quantity_max,
  count(Quantity) AS Quantity_count, {r('avg(UnitPrice)')} AS UnitPrice_mean, {r('min(UnitPrice)')} AS UnitPrice_min,
  {r('max(UnitPrice)')} AS UnitPrice_max, count(DISTINCT CustomerID) AS CustomerID_nunique
FROM asg WHERE Cluster <> -1 GROUP BY 1""")
def q_assigned_cluster_summary(spark, sf_dir):
    """A8 + F12 over exact labels: summary without noise rows."""
    return rounded(agg.cluster_summary(quantile_seeded(spark, sf_dir), "Cluster"))


@query("assigned_country_counts", with_sales(*CLEAN_CTES, *_ASSIGN_CTES)
       + "SELECT Country, Cluster, count(*) AS count FROM asg GROUP BY 1, 2")
def q_assigned_country_counts(spark, sf_dir):
    """Country × Cluster counts (long form; zero cells absent)."""
    return agg.country_cluster_counts(quantile_seeded(spark, sf_dir), "Cluster")


@query("assigned_country_filled", with_sales(*CLEAN_CTES, *_ASSIGN_CTES) + """
SELECT c.Country, k.Cluster, count(a.Country) AS count
FROM (SELECT DISTINCT Country FROM asg) c CROSS JOIN (SELECT DISTINCT Cluster FROM asg) k
LEFT JOIN asg a ON a.Country = c.Country AND a.Cluster = k.Cluster GROUP BY 1, 2""")
def q_assigned_country_filled(spark, sf_dir):
    """A9 as the original's table: every country with every cluster, zero cells too."""
    return agg.country_cluster_counts(quantile_seeded(spark, sf_dir), "Cluster", filled=True)


# Fixed parameters of the mixture's assignment check, on standardised columns.
MIXTURE = ([0.5, 0.3, 0.2], [[-0.8, -0.5], [0.9, 0.2], [0.0, 1.1]],
           [[[0.6, 0.1], [0.1, 0.9]], [[0.4, -0.1], [-0.1, 0.5]], [[1.2, 0.3], [0.3, 0.4]]])


def _mixture_sql(k: int) -> str:
    w, (m0, m1), ((a, b), (_, c)) = MIXTURE[0][k], MIXTURE[1][k], MIXTURE[2][k]
    det = f"({a} * {c} - {b} * {b})"
    x, y = f"(zq - {m0})", f"(zp - {m1})"
    return f"ln({w}) - 0.5 * ln({det}) - 0.5 * ({c} * {x} * {x} - 2 * {b} * {x} * {y} + {a} * {y} * {y}) / {det}"


_MIXTURE_CTES = [
    "st AS (SELECT avg(Quantity) AS mq, stddev_pop(Quantity) AS sq, avg(UnitPrice) AS mp, stddev_pop(UnitPrice) AS sp FROM clean)",
    "z AS (SELECT clean.*, (Quantity - mq) / sq AS zq, (UnitPrice - mp) / sp AS zp FROM clean, st)",
    "l AS (SELECT *, " + ", ".join(f"{_mixture_sql(k)} AS l{k}" for k in range(3)) + " FROM z)",
    "mix AS (SELECT *, CAST(CASE WHEN l0 >= l1 AND l0 >= l2 THEN 0 WHEN l1 >= l2 THEN 1 ELSE 2 END AS INTEGER) AS cluster, "
    "1 / (exp(l0 - greatest(l0, l1, l2)) + exp(l1 - greatest(l0, l1, l2)) + exp(l2 - greatest(l0, l1, l2))) AS probability FROM l)",
]


def _fixed_mixture(spark, sf_dir):
    z = scale(cleaned_sales(spark, sf_dir), _FEATS, "standard", suffix="_z")
    return assign_mixture(z, ["Quantity_z", "UnitPrice_z"], *MIXTURE)


@query("gmm_assign_fixed", with_sales(*CLEAN_CTES, *_MIXTURE_CTES) + f"SELECT {KEYS_SQL}, cluster, {r('probability')} AS probability FROM mix")
def q_gmm_assign_fixed(spark, sf_dir):
    """G3 assignment with fixed parameters: most probable component and its probability."""
    return rounded(_fixed_mixture(spark, sf_dir).select(*ORDER_KEYS, "cluster", "probability"))


@query("assigned_cluster_counts", with_sales(*CLEAN_CTES, *_ASSIGN_CTES) + """
SELECT count(DISTINCT CASE WHEN Cluster <> -1 THEN Cluster END) AS n_clusters,
       count_if(Cluster = -1)::BIGINT AS n_noise FROM asg""")
def q_assigned_cluster_counts(spark, sf_dir):
    """Number of clusters without noise, noise rows."""
    return agg.cluster_counts(quantile_seeded(spark, sf_dir), "Cluster")


def _design(spark, sf_dir, keys=()):
    """The K-Means design of the cleaned rows without gaps, with ``keys`` beside it. What a row has besides is only asked for gaps."""
    sales = sales_from_tables(spark, sf_dir)
    columns = list(dict.fromkeys([*_FEATS, "StockCode", "Country", *keys]))
    whole = reduce(Column.__and__, [F.col(c).isNotNull() for c in sales.columns if c not in columns], F.lit(True))
    df = cl.drop_missing(cleaned(sales.select(*columns, F.when(whole, True).alias("_whole"))))
    return kmeans_design(df.drop("_whole"))


@query("elbow_k1", with_sales(*CLEAN_CTES,
    "nn AS (SELECT * FROM clean WHERE CustomerID IS NOT NULL)",
    "cd AS (SELECT *, dense_rank() OVER (ORDER BY StockCode) - 1 AS code FROM nn)",
    "cc AS (SELECT Country, count(*) AS c FROM nn GROUP BY 1)")
    + """SELECT 1 AS k, round((SELECT var_pop(Quantity) * count(*) + var_pop(UnitPrice) * count(*) + var_pop(code) * count(*) FROM cd)
       + (SELECT sum(c * (1 - c / (SELECT count(*) FROM nn))) FROM cc WHERE Country <> (SELECT min(Country) FROM nn)), 0) AS inertia""")
def q_elbow_k1(spark, sf_dir):
    """G2 at k = 1: Σ squared deviation over the K-Means design (numeric,
    country dummies without the first, stock-code labels)."""
    design, feats = _design(spark, sf_dir)
    out = inertia_k1(design, feats)
    return out.select("k", F.round("inertia", 0).alias("inertia"))


@query("kmeans_labels")
def q_kmeans_labels(spark, sf_dir):
    """G1: K-Means (k = 3, seed 42) on the unscaled design (B11); one label per row."""
    design, feats = _design(spark, sf_dir, EXTRA_KEYS)
    design = design.select(*[c for c in ORDER_KEYS if c in design.columns], *feats)
    _, out, _ = fit_kmeans(design, feats, 3, seed=42)
    return out.select(*[c for c in ORDER_KEYS if c in out.columns], "Cluster")


@query("kmeans_elbow")
def q_kmeans_elbow(spark, sf_dir):
    """Inertia for k = 1 … 9."""
    design, feats = _design(spark, sf_dir)
    return elbow(design, feats, 10)


def _gmm(spark, sf_dir):
    clean = cleaned_sales(spark, sf_dir)
    z = scale(clean, _FEATS, "standard", suffix="_z")
    _, out = fit_gmm(z, ["Quantity_z", "UnitPrice_z"], k=3, seed=0)
    return out


@query("gmm_profile")
def q_gmm_profile(spark, sf_dir):
    """G3 + G9/A6: Gaussian mixture (3 components, seed 0) on standardised
    Quantity/UnitPrice; statistics of the raw columns per component."""
    return agg.cluster_profile(_gmm(spark, sf_dir), "cluster", _FEATS)


@query("gmm_sizes")
def q_gmm_sizes(spark, sf_dir):
    """G3 + A7: component sizes, largest first (they add up to the row count)."""
    return agg.cluster_sizes(_gmm(spark, sf_dir), "cluster")


@query("gmm_pca_scores")
def q_gmm_pca_scores(spark, sf_dir):
    """G9 + T7: component label and PCA scores of the standardised inputs."""
    out = _gmm(spark, sf_dir)
    fit = fit_pca(out, ["Quantity_z", "UnitPrice_z"], 2)
    return fit.transform(out).select(*ORDER_KEYS, "cluster", "pc1", "pc2")


def _kdist(spark, sf_dir):
    z, feats = standardized_pca_input(spark, sf_dir)
    fit = fit_pca(z, feats, 2)
    from tillpoint.operators.rowindex import with_row_index
    scores = with_row_index(fit.transform(z).select(*ORDER_KEYS, "pc1", "pc2"), ORDER_KEYS)
    return k_distance(scores, ["pc1", "pc2"], k=5)


def _kdist_ctes(k: int = 5) -> str:
    """DuckDB twin of the k-distance: distances in the space of all principal components are those of the standardised
    columns. Candidates come from the 3 × 3 cells about a point; points whose k-th one is farther than a cell are compared
    with all points."""
    return with_sales(
        *CLEAN_CTES, *_PCA_CTES,
        f"zi AS (SELECT z1, z2, row_number() OVER (ORDER BY {KEYS_SQL}) - 1 AS id FROM z)",
        "pts AS MATERIALIZED (SELECT z1, z2, count(*) AS w, min(id) AS pid FROM zi GROUP BY z1, z2)",
        "side AS (SELECT sqrt((max(z1) - min(z1)) * (max(z2) - min(z2)) / count(*) * 8) AS s FROM pts)",
        "cells AS MATERIALIZED (SELECT pts.*, s, floor(z1 / s)::BIGINT AS g1, floor(z2 / s)::BIGINT AS g2 FROM pts, side)",
        "probe AS (SELECT cells.*, g1 + a AS h1, g2 + b AS h2 FROM cells, (VALUES (-1), (0), (1)) x(a), (VALUES (-1), (0), (1)) y(b))",
        "cand AS (SELECT p.pid, p.s, q.w, sqrt((p.z1 - q.z1) * (p.z1 - q.z1) + (p.z2 - q.z2) * (p.z2 - q.z2)) AS d "
        "FROM probe p JOIN cells q ON p.h1 = q.g1 AND p.h2 = q.g2)",
        "cum AS (SELECT pid, s, d, sum(w) OVER (PARTITION BY pid ORDER BY d ROWS UNBOUNDED PRECEDING) AS c FROM cand)",
        f"near AS MATERIALIZED (SELECT pid, min(d) AS kdist FROM cum WHERE c >= {k} GROUP BY pid HAVING min(d) <= min(s))",
        "far AS (SELECT p.pid, q.w, sqrt((p.z1 - q.z1) * (p.z1 - q.z1) + (p.z2 - q.z2) * (p.z2 - q.z2)) AS d "
        "FROM pts p, pts q WHERE p.pid NOT IN (SELECT pid FROM near))",
        "farc AS (SELECT pid, d, sum(w) OVER (PARTITION BY pid ORDER BY d ROWS UNBOUNDED PRECEDING) AS c FROM far)",
        f"kd AS (SELECT pid, kdist FROM near UNION ALL SELECT pid, min(d) FROM farc WHERE c >= {k} GROUP BY pid)")


@query("k_distance", _kdist_ctes() + f"SELECT pid, w, {r('kdist')} AS kdist FROM kd JOIN pts USING (pid)")
def q_k_distance(spark, sf_dir):
    """Distance to the 5th nearest point (itself first) in PCA space,
    per distinct point with its row weight."""
    return rounded(_kdist(spark, sf_dir).select("pid", "w", "kdist"))


@query("k_distance_curve", _kdist_ctes() + f"""
SELECT row_number() OVER (ORDER BY kdist) - 1 AS rank, {r('kdist')} AS distance
FROM (SELECT kdist, unnest(range(w)) FROM kd JOIN pts USING (pid))""")
def q_k_distance_curve(spark, sf_dir):
    """The ascending k-distance curve, every row."""
    return rounded(k_distance_curve(_kdist(spark, sf_dir)))


@query("k_distance_curve_101")
def q_k_distance_curve_101(spark, sf_dir):
    """The curve thinned to 101 exact quantiles."""
    return k_distance_curve(_kdist(spark, sf_dir), points=101)


def _dbscan_type1_sql(eps: float = bt.EPS, min_samples: int = bt.MIN_SAMPLES) -> str:
    """DuckDB twin of batched DBSCAN type 1. Four scaled dimensions have too many ε-pairs for a band join, so cells of side
    ε/√4 (mutual neighbours) make full cells core, cells of side ε/√7 link by their boxes (recursive label propagation), and
    points are paired only where that leaves a question: light points, components that boxes keep apart, border points."""
    feats = bt.TYPE1_FEATURES
    d = len(feats)
    z = ", ".join(f"({c} - min({c}) OVER w) / CASE WHEN max({c}) OVER w = min({c}) OVER w THEN 1 ELSE (max({c}) OVER w - min({c}) OVER w)::DOUBLE "
                  f"END AS z{i}" for i, c in enumerate(feats))
    cell = lambda n: ", ".join(f"floor(z{i} / {eps / n ** 0.5 * (1 - 1e-9)!r})::BIGINT" for i in range(d))
    near = " + ".join(f"(p.z{i} - q.z{i}) * (p.z{i} - q.z{i})" for i in range(d)) + f" <= {eps * eps}"
    far = " + ".join(f"power(greatest(q.hi{i} - p.lo{i}, p.hi{i} - q.lo{i}), 2)" for i in range(d)) + f" <= {eps * eps}"
    boxes = ", ".join(f"min(z{i}) AS lo{i}, max(z{i}) AS hi{i}" for i in range(d))
    head = with_sales(
        f"ix AS (SELECT *, row_number() OVER (ORDER BY {KEYS_SQL}) - 1 AS row_idx FROM sales)",
        f"bt AS (SELECT *, CAST(floor(row_idx / {bt.BATCH_SIZE}) + 1 AS INTEGER) AS batch_number FROM ix)",
        "dd AS (SELECT *, CAST(floor((epoch(InvoiceDate) - epoch(min(InvoiceDate) OVER (PARTITION BY batch_number))) / 86400) AS BIGINT) "
        "AS DaysSinceFirstPurchase FROM bt)",
        "nn AS (SELECT * FROM dd WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in feats) + ")",
        f"p AS MATERIALIZED (SELECT batch_number AS b, row_idx AS id, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in feats)}, {z} "
        "FROM nn WINDOW w AS (PARTITION BY batch_number))",
        f"w AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY b, {cell(d)}) AS w FROM p)",
        f"few AS MATERIALIZED (SELECT p.b, p.id, count(*) AS n FROM w p JOIN p q ON p.b = q.b AND {near} WHERE p.w < {min_samples} GROUP BY ALL)",
        f"core AS MATERIALIZED (SELECT w.*, min(id) OVER (PARTITION BY b, {cell(d + 3)}) AS node FROM w LEFT JOIN few USING (b, id) "
        f"WHERE w >= {min_samples} OR n >= {min_samples})",
        f"cells AS MATERIALIZED (SELECT b, node, {boxes} FROM core GROUP BY ALL)",
        f"sure AS MATERIALIZED (SELECT p.b, p.node AS a, q.node AS c FROM cells p JOIN cells q ON p.b = q.b AND p.node <> q.node AND {far})")

    def spread(name: str, nodes: str, edges: str) -> str:
        return f""",
{name}(b, id, l) USING KEY (b, id) AS (
  {nodes}
  UNION
  SELECT e.b, e.c, min(x.l) FROM {name} x JOIN {edges} e ON e.b = x.b AND e.a = x.id JOIN recurring.{name} r ON r.b = e.b AND r.id = e.c
  GROUP BY e.b, e.c HAVING min(x.l) < min(r.l))"""

    return head.replace("WITH ", "WITH RECURSIVE ", 1) + spread("lab", "SELECT b, node, node FROM cells", "sure") + f""",
part AS MATERIALIZED (SELECT core.*, lab.l AS part FROM core JOIN lab ON core.b = lab.b AND core.node = lab.id),
cross_ AS MATERIALIZED (SELECT DISTINCT p.b, p.part AS x, q.part AS y FROM part p JOIN part q ON p.b = q.b AND p.part < q.part AND {near}),
joined AS MATERIALIZED (SELECT b, x AS a, y AS c FROM cross_ UNION ALL SELECT b, y, x FROM cross_)""" + spread(
        "whole", "SELECT DISTINCT b, part, part FROM part", "joined") + f""",
numbered AS MATERIALIZED (SELECT part.*, dense_rank() OVER (PARTITION BY part.b ORDER BY first) - 1 AS k
  FROM part JOIN (SELECT *, min(id) OVER (PARTITION BY b, l) AS first FROM whole) x ON part.b = x.b AND part.part = x.id),
border AS (SELECT p.b, p.id, min(q.k) AS k FROM w p JOIN numbered q ON p.b = q.b AND {near}
  WHERE p.w < {min_samples} AND (p.b, p.id) NOT IN (SELECT b, id FROM core) GROUP BY ALL)
SELECT p.id AS row_idx, p.b AS batch_number, {', '.join('p.' + c for c in feats)}, CAST(coalesce(numbered.k, border.k, -1) AS INTEGER) AS Cluster
FROM p LEFT JOIN numbered ON p.b = numbered.b AND p.id = numbered.id LEFT JOIN border ON p.b = border.b AND p.id = border.id
"""


def _dbscan_lines(spark, sf_dir, *more):
    return stored_lines(spark, sf_dir, [*SHORT_KEYS, *bt.TYPE2_FEATURES, *more])


@query("dbscan_type1", _dbscan_type1_sql())
def q_dbscan_type1(spark, sf_dir):
    """Batched DBSCAN type 1 (min-max, four features, ε 0.5, min 5)."""
    return bt.dbscan_type1(_dbscan_lines(spark, sf_dir), SHORT_KEYS, owned=True, whole_batches=True)


@query("dbscan_type1_fine", _dbscan_type1_sql(0.12))
def q_dbscan_type1_fine(spark, sf_dir):
    """G5/G6 in four dimensions with ε 0.12: light cells, border points and noise in every batch."""
    return bt.dbscan_type1(_dbscan_lines(spark, sf_dir), SHORT_KEYS, owned=True, whole_batches=True, eps=0.12)


@query("dbscan_type2")
def q_dbscan_type2(spark, sf_dir):
    """Batched DBSCAN type 2 (standardised, three features, ε 0.5, min 5),
    all columns kept, plus Cluster and BatchNumber. Texts made of the order keys are made again at the end."""
    made = {"InvoiceNo": "l_orderkey", "StockCode": "l_partkey"}
    # labelled by the columns that decide the labels; the others meet their labels where the lines meet their orders
    out = bt.dbscan_type2(_dbscan_lines(spark, sf_dir, *COPIES), SHORT_KEYS, keep=ROW_NAME, owned=True, whole_batches=True)
    found = [c for c in out.columns if c not in [*ROW_NAME, *bt.TYPE2_FEATURES]]
    wide = stored_lines(spark, sf_dir, [c for c in SALES_COLUMNS + EXTRA_KEYS if c not in made],
                        out.select(*ROW_NAME, "row_idx", "batch_number", "Cluster"))
    discard(out)
    first, *rest = found
    return wide.withColumn("BatchNumber", F.col("batch_number")).withColumns({c: F.col(k).cast("string") for c, k in made.items()}) \
               .select(first, *SALES_COLUMNS, *EXTRA_KEYS, *rest)


def _dbscan_ctes(eps: float, min_samples: int) -> str:
    """DuckDB twin of batched DBSCAN type 2: per-batch standardisation, ε-pairs
    by a band join, core points, label propagation over core–core edges
    (recursive CTE keyed by point), clusters numbered by their lowest row,
    border points → lowest neighbouring cluster, the rest −1."""
    feats = bt.TYPE2_FEATURES
    z = ", ".join(
        f"({c} - avg({c}) OVER w) / CASE WHEN coalesce(stddev_pop({c}) OVER w, 0) = 0 THEN 1 "
        f"ELSE stddev_pop({c}) OVER w END AS z{i}" for i, c in enumerate(feats))
    d2 = " + ".join(f"(p.z{i} - q.z{i}) * (p.z{i} - q.z{i})" for i in range(len(feats)))
    head = with_sales(
        f"ix AS (SELECT *, row_number() OVER (ORDER BY {KEYS_SQL}) - 1 AS row_idx FROM sales)",
        f"bt AS (SELECT *, CAST(floor(row_idx / {bt.BATCH_SIZE}) + 1 AS INTEGER) AS batch_number FROM ix)",
        "nn AS (SELECT * FROM bt WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in feats) + ")",
        f"p AS MATERIALIZED (SELECT batch_number AS b, row_idx AS id, {z} FROM nn WINDOW w AS (PARTITION BY batch_number))",
        f"nb AS MATERIALIZED (SELECT p.b, p.id AS a, q.id AS c FROM p JOIN p q ON p.b = q.b "
        f"AND q.z0 BETWEEN p.z0 - {eps} AND p.z0 + {eps} AND {d2} <= {eps * eps})",
        f"core AS MATERIALIZED (SELECT b, a AS id FROM nb GROUP BY 1, 2 HAVING count(*) >= {min_samples})",
        "ce AS MATERIALIZED (SELECT b, a, c FROM nb WHERE a <> c AND (b, a) IN (SELECT b, id FROM core) "
        "AND (b, c) IN (SELECT b, id FROM core))")
    return head.replace("WITH ", "WITH RECURSIVE ", 1) + """,
lab(b, id, l) USING KEY (b, id) AS (
  SELECT b, id, id FROM core
  UNION
  SELECT ce.b, ce.c, min(lab.l) FROM lab JOIN ce ON ce.b = lab.b AND ce.a = lab.id
  JOIN recurring.lab r ON r.b = ce.b AND r.id = ce.c
  GROUP BY ce.b, ce.c HAVING min(lab.l) < min(r.l)
),
cl AS (SELECT b, id, CAST(dense_rank() OVER (PARTITION BY b ORDER BY l) - 1 AS INTEGER) AS k FROM lab),
border AS (SELECT nb.b, nb.a AS id, min(cl.k) AS k FROM nb JOIN cl ON nb.b = cl.b AND nb.c = cl.id
           WHERE (nb.b, nb.a) NOT IN (SELECT b, id FROM core) GROUP BY 1, 2),
res AS (SELECT p.b AS batch_number, p.id AS row_idx, CAST(coalesce(cl.k, border.k, -1) AS INTEGER) AS Cluster
  FROM p LEFT JOIN cl ON p.b = cl.b AND p.id = cl.id LEFT JOIN border ON p.b = border.b AND p.id = border.id),
rep AS (SELECT bt.*, res.Cluster, res.batch_number AS BatchNumber
  FROM res JOIN bt ON bt.batch_number = res.batch_number AND bt.row_idx = res.row_idx)
"""


def _dbscan_sql(eps: float, min_samples: int) -> str:
    """Labels per (batch, row) of batched DBSCAN type 2."""
    return _dbscan_ctes(eps, min_samples) + "SELECT batch_number, row_idx, Cluster FROM res"


@query("dbscan_type2_labels", _dbscan_sql(bt.EPS, bt.MIN_SAMPLES))
def q_dbscan_type2_labels(spark, sf_dir):
    """G5/G7 exact check: batched DBSCAN type 2 labels (ε 0.5, min 5) per
    (batch, row) over the whole table."""
    return bt.dbscan_type2(_dbscan_lines(spark, sf_dir), SHORT_KEYS, owned=True, whole_batches=True, keep=[]).select(
        "batch_number", "row_idx", "Cluster")


@query("dbscan_type2_fine_labels", _dbscan_sql(0.1, bt.MIN_SAMPLES))
def q_dbscan_type2_fine_labels(spark, sf_dir):
    """G5 with ε 0.1: hundreds of clusters, border points and noise per batch."""
    return bt.dbscan_type2(_dbscan_lines(spark, sf_dir), SHORT_KEYS, owned=True, whole_batches=True, eps=0.1, keep=[]).select(
        "batch_number", "row_idx", "Cluster")


@query("bisecting_kmeans_sizes")
def q_bisecting_kmeans_sizes(spark, sf_dir):
    """G10 + A7: divisive (bisecting) K-Means, k = 3, on standardised
    Quantity/UnitPrice; cluster sizes."""
    from tillpoint.cluster.mixture import fit_bisecting
    z = scale(cleaned_sales(spark, sf_dir), _FEATS, "standard", suffix="_z")
    _, out = fit_bisecting(z.select("Quantity_z", "UnitPrice_z"), ["Quantity_z", "UnitPrice_z"], 3)
    return agg.cluster_sizes(out, "Cluster")


# G8 reports over the exact type-2 labels; the oracles reuse the label SQL above.
@query("dbscan_report_summary", _dbscan_ctes(bt.EPS, bt.MIN_SAMPLES) + f"""
SELECT BatchNumber, Cluster, {r('avg(Quantity)')} AS Quantity_mean, min(Quantity) AS Quantity_min,
  max(Quantity) AS Quantity_max, count(Quantity) AS Quantity_count, {r('avg(UnitPrice)')} AS UnitPrice_mean,
  {r('min(UnitPrice)')} AS UnitPrice_min, {r('max(UnitPrice)')} AS UnitPrice_max,
  count(DISTINCT CustomerID) AS CustomerID_nunique
FROM rep WHERE Cluster <> -1 GROUP BY 1, 2""")
def q_dbscan_report_summary(spark, sf_dir):
    """Per (batch, cluster) summary without noise."""
    return rounded(bt.cluster_report(bt.dbscan_type2(_dbscan_lines(spark, sf_dir), SHORT_KEYS, owned=True, whole_batches=True, keep=[]))["summary"])


@query("dbscan_report_counts", _dbscan_ctes(bt.EPS, bt.MIN_SAMPLES) + """
SELECT BatchNumber, count(DISTINCT CASE WHEN Cluster <> -1 THEN Cluster END) AS n_clusters,
  count_if(Cluster = -1)::BIGINT AS n_noise
FROM rep GROUP BY 1""")
def q_dbscan_report_counts(spark, sf_dir):
    """Clusters and noise rows per batch."""
    return bt.cluster_report(bt.dbscan_type2(_dbscan_lines(spark, sf_dir), SHORT_KEYS, owned=True, whole_batches=True, keep=[]))["counts"]


@query("dbscan_report_country", _dbscan_ctes(bt.EPS, bt.MIN_SAMPLES)
       + "SELECT Country, BatchNumber, Cluster, count(*) AS count FROM rep GROUP BY 1, 2, 3")
def q_dbscan_report_country(spark, sf_dir):
    """Country × (batch, cluster) counts of the type-2 results."""
    return bt.cluster_report(bt.dbscan_type2(_dbscan_lines(spark, sf_dir, "Country"), SHORT_KEYS, owned=True, whole_batches=True, keep=["Country"]))["country"]


@query("dbscan_report_country_filled", _dbscan_ctes(bt.EPS, bt.MIN_SAMPLES) + """
SELECT c.Country, c.BatchNumber, k.Cluster, count(rep.Country) AS count
FROM (SELECT DISTINCT Country, BatchNumber FROM rep) c JOIN (SELECT DISTINCT BatchNumber, Cluster FROM rep) k USING (BatchNumber)
LEFT JOIN rep ON rep.Country = c.Country AND rep.BatchNumber = c.BatchNumber AND rep.Cluster = k.Cluster GROUP BY 1, 2, 3""")
def q_dbscan_report_country_filled(spark, sf_dir):
    """The same with the zero cells of each batch's table."""
    return bt.cluster_report(bt.dbscan_type2(_dbscan_lines(spark, sf_dir, "Country"), SHORT_KEYS, owned=True, whole_batches=True, keep=["Country"]))["country_filled"]


@query("dbscan_type1_scatter")
def q_dbscan_type1_scatter(spark, sf_dir):
    """C3 for the type-1 results: Quantity × UnitPrice bin counts per (batch, cluster)."""
    from tillpoint.operators.charts import scatter_bins
    out = bt.dbscan_type1(_dbscan_lines(spark, sf_dir), SHORT_KEYS, owned=True, whole_batches=True)
    return scatter_bins(out.withColumn("Cluster", F.concat_ws(":", "batch_number", "Cluster")),
                        "Quantity", "UnitPrice", 5.0, 10.0, "Cluster")
