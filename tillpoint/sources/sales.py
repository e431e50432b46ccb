"""Invoice-line sources and sinks.

The invoice-line table has eight business columns. ``sales_from_tables``
derives it from the driver's TPC-H-like Parquet tables (FIXTURES.md §B) and
carries the row-order keys along, because Parquet has no row order.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillpoint.session import scratch_path, shuffles_released

# The invoice-line schema the reference's CSV files carry.
SALES_SCHEMA = T.StructType([
    T.StructField("InvoiceNo", T.StringType(), True),
    T.StructField("StockCode", T.StringType(), True),
    T.StructField("Description", T.StringType(), True),
    T.StructField("Quantity", T.IntegerType(), True),
    T.StructField("InvoiceDate", T.TimestampNTZType(), True),
    T.StructField("UnitPrice", T.DoubleType(), True),
    T.StructField("CustomerID", T.LongType(), True),
    T.StructField("Country", T.StringType(), True),
])
SALES_COLUMNS = [f.name for f in SALES_SCHEMA.fields]

# Row-order keys: unique per row at every scale (FIXTURES.md §B).
ORDER_KEYS = ["InvoiceDate", "l_orderkey", "l_partkey", "l_suppkey",
              "l_linenumber", "l_extendedprice", "l_shipdate"]
EXTRA_KEYS = ORDER_KEYS[1:]
# The same order for ``sales_lines``, which can number the lines of an order key.
LINE = "_line"
SHORT_KEYS = ["InvoiceDate", "l_orderkey", LINE]
# With these, ``LINE`` names a row of the view also where keys of orders, customers or parts repeat: the number of its
# order's row among those of the order key, and of its part's row among those of the part key.
COPIES = ["_order", "_part"]
ROW_NAME = ["l_orderkey", LINE, *COPIES]
# Shares of the order keys that are joined one after the other where the exchanges of all would not fit the disk.
SHARES = 4

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sales_from_tables(spark: SparkSession, sf_dir: str, with_keys: bool = True) -> DataFrame:
    """The ``sales`` view of FIXTURES.md §B, built from the driver's tables.

    Columns are pruned before each join so the Parquet scans read only what
    is used. Join strategy is left to Catalyst/AQE: the size-checked
    auto-broadcast picks up the small dimensions (nation, and part/customer
    while they stay under the threshold); lineitem⋈orders is a shuffle join
    on the order key.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_returnflag", "l_shipdate")
    od = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    pt = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    cu = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    na = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")

    joined = (li.join(od, li.l_orderkey == od.o_orderkey)
                .join(pt, li.l_partkey == pt.p_partkey)
                .join(cu, od.o_custkey == cu.c_custkey)
                .join(na, cu.c_nationkey == na.n_nationkey))
    qty = F.col("l_quantity").cast("int")
    cols = [
        F.col("l_orderkey").cast("string").alias("InvoiceNo"),
        F.col("l_partkey").cast("string").alias("StockCode"),
        F.col("p_name").alias("Description"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1), -qty)
         .otherwise(qty).alias("Quantity"),
        F.timestamp_add("MINUTE", (F.col("o_orderkey") % 1440).cast("int"),
                       F.col("o_orderdate")).alias("InvoiceDate"),
        F.col("p_retailprice").alias("UnitPrice"),
        F.when(F.col("o_custkey") % 4 == 0, F.lit(None).cast("bigint"))
         .otherwise(F.col("o_custkey")).alias("CustomerID"),
        F.col("n_name").alias("Country"),
    ]
    if with_keys:
        cols += [F.col(k) for k in EXTRA_KEYS]
    return joined.select(*cols)


def sales_lines(spark: SparkSession, sf_dir: str, columns: list[str] | None = None, share: int | None = None,
                beside: DataFrame | None = None) -> DataFrame:
    """The rows of ``sales_from_tables`` with ``columns`` (default: all), with two exchanges of the lines instead of three.

    Orders meet customers and nations before the lines do, and what a line alone decides is computed where it is read,
    so every join carries only what ``columns`` need. Rows lie in another order than there: not for seeded fits.
    ``columns`` may name ``LINE``, the line's number by the other order keys among the lines of its order key
    (``SHORT_KEYS`` give the order of ``ORDER_KEYS``): the lines are numbered where they wait for their order, and the
    keys it stands for go no further.
    ``share`` (0 … ``SHARES`` − 1) leaves only the lines of that share of the order keys: written one after the other,
    the shares need a share of the exchanges' disk.
    ``columns`` may name ``COPIES`` too. ``beside`` holds further columns by ``ROW_NAME``: they are put beside its rows,
    and the others are left out (where the order keys meet, so what they bring crosses no exchange of its own
    under ``joined_by_order``).
    """
    wanted = SALES_COLUMNS + EXTRA_KEYS if columns is None else columns
    named_rows = beside is not None or any(c in wanted for c in COPIES)
    qty = F.col("l_quantity").cast("int")
    lines = read_table(spark, sf_dir, "lineitem").select(
        *EXTRA_KEYS, F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1), -qty).otherwise(qty).alias("Quantity"))
    part = read_table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_name").alias("Description"), F.col("p_retailprice").alias("UnitPrice"))
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey",
        F.timestamp_add("MINUTE", (F.col("o_orderkey") % 1440).cast("int"), F.col("o_orderdate")).alias("InvoiceDate"),
        F.when(F.col("o_custkey") % 4 == 0, F.lit(None).cast("bigint")).otherwise(F.col("o_custkey")).alias("CustomerID"))
    if LINE in wanted or beside is not None:
        rest = Window.partitionBy("l_orderkey").orderBy(*[k for k in EXTRA_KEYS if k != "l_orderkey"], "Quantity")
        lines = lines.where(F.col("l_orderkey").isNotNull()).withColumn(LINE, F.row_number().over(rest))
    if share is not None:
        own = lambda key: F.pmod(F.xxhash64(key), F.lit(SHARES)) == share
        lines, orders = lines.where(own("l_orderkey")), orders.where(own("o_orderkey"))
    cu = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    na = read_table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("Country"))

    orders = orders.join(cu.join(na, cu.c_nationkey == na.n_nationkey), orders.o_custkey == cu.c_custkey)
    of_order, of_part = lines.l_orderkey == orders.o_orderkey, lines.l_partkey == part.p_partkey
    if named_rows:
        one = lambda key, *by: F.row_number().over(Window.partitionBy(key).orderBy(*by))
        orders = orders.withColumn("_order", one("o_orderkey", "InvoiceDate", "o_custkey", "Country"))
        part = part.withColumn("_part", one("p_partkey", "Description", "UnitPrice"))
    if beside is not None:
        names = {c: f"_b{c}" for c in ROW_NAME}
        if share is not None:
            beside = beside.where(own("l_orderkey"))
        beside = beside.withColumnsRenamed(names)
        lines = lines.join(beside, (F.col("l_orderkey") == F.col(names["l_orderkey"])) & (F.col(LINE) == F.col(names[LINE])))
        of_order &= F.col(names["_order"]) == F.col("_order")
        of_part &= F.col(names["_part"]) == F.col("_part")
        wanted = [*wanted, *[c for c in beside.columns if c not in names.values()]]
    joined = lines.join(orders, of_order).join(part, of_part)
    named = joined.withColumns({"InvoiceNo": F.col("l_orderkey").cast("string"), "StockCode": F.col("l_partkey").cast("string")})
    return named.select(*wanted)


def stored_lines(spark: SparkSession, sf_dir: str, columns: list[str], beside: DataFrame | None = None) -> DataFrame:
    """``sales_lines`` as a compressed table of the shared folder, written share by share."""
    path = scratch_path(spark, f"lines_{uuid.uuid4().hex}")
    for share in range(SHARES):
        lines = sales_lines(spark, sf_dir, columns, share, beside)
        with shuffles_released(spark), joined_by_order(spark):
            lines.write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(lines.schema).parquet(path)


@contextmanager
def joined_by_order(spark: SparkSession) -> Iterator[None]:
    """Rows that lie together by one key of a join are not exchanged again for the others."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


# DuckDB twin of ``sales_from_tables`` for oracle queries.
SALES_SQL = """
SELECT cast(l_orderkey AS varchar) AS InvoiceNo,
       cast(l_partkey AS varchar) AS StockCode,
       p_name AS Description,
       CASE WHEN l_returnflag = 'R' AND l_linenumber = 1
            THEN -cast(l_quantity AS int) ELSE cast(l_quantity AS int) END AS Quantity,
       o_orderdate + to_minutes(cast(o_orderkey % 1440 AS int)) AS InvoiceDate,
       p_retailprice AS UnitPrice,
       CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_custkey END AS CustomerID,
       n_name AS Country,
       l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_shipdate
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
              JOIN part ON l_partkey = p_partkey
              JOIN customer ON o_custkey = c_custkey
              JOIN nation ON c_nationkey = n_nationkey
"""


def nan_to_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Turn NaN into NULL in floating columns (pandas treats both as missing)."""
    floating = {f.name for f in df.schema.fields
                if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    targets = [c for c in (cols or df.columns) if c in floating]
    if not targets:
        return df
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast(df.schema[c].dataType))
                           for c in targets})


def read_sales_csv(spark: SparkSession, path: str, encoding: str = "ISO-8859-1",
                   date_format: str | None = None, strict_dates: bool = False,
                   schema: T.StructType | None = None, multi_line: bool = False,
                   malformed: str | None = None) -> DataFrame:
    """Read a headered invoice-line CSV with a declared schema.

    Cells are read as text and cast: whole numbers may be written as floats
    (``17850.0``, as id columns with gaps are), ``InvoiceDate`` is parsed with
    D1 (strict) or D2 (lenient). A cell that is neither empty nor a value of
    its column becomes null; ``malformed`` names an array column that lists the
    columns of such cells. ``multi_line`` reads quoted line feeds, at the price
    of one task per file. The ``unicode_escape`` codec of the reference is
    read as ISO-8859-1 (SURVEY "Not built").
    """
    from tillpoint.functions.dates import parse_timestamp_lenient, parse_timestamp_strict

    enc = {"latin1": "ISO-8859-1", "latin-1": "ISO-8859-1", "iso-8859-1": "ISO-8859-1",
           "unicode_escape": "ISO-8859-1", "utf8": "UTF-8", "utf-8": "UTF-8"}.get(
        encoding.lower(), encoding)
    declared = schema or SALES_SCHEMA
    raw = (spark.read.schema(T.StructType([T.StructField(f.name, T.StringType(), True) for f in declared.fields]))
           .option("header", True)
           .option("encoding", enc)
           .option("multiLine", multi_line)
           .option("escape", '"')
           .option("mode", "PERMISSIVE")
           .csv(path))
    parse = parse_timestamp_strict if strict_dates else parse_timestamp_lenient
    cells: dict[str, Column] = {}
    for f in declared.fields:
        text = F.col(f"`{f.name}`")
        if f.name == "InvoiceDate":
            cells[f.name] = parse(text, date_format)
        elif isinstance(f.dataType, (T.IntegerType, T.LongType)):
            number = text.try_cast("decimal(38,10)")
            cells[f.name] = F.when(number == F.floor(number), number.try_cast(f.dataType))
        elif isinstance(f.dataType, T.StringType):
            cells[f.name] = text
        else:
            cells[f.name] = text.try_cast(f.dataType)
    out = [c.alias(name) for name, c in cells.items()]
    if malformed:
        bad = [F.when(F.col(f"`{name}`").isNotNull() & (F.trim(F.col(f"`{name}`")) != "") & c.isNull(), F.lit(name))
               for name, c in cells.items()]
        out.append(F.filter(F.array(*bad), lambda x: x.isNotNull()).alias(malformed))
    return nan_to_null(raw.select(*out))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", compression: str = "none") -> None:
    """Headered CSV, no index column. Spark writes one part file per partition."""
    df.write.mode(mode).option("header", True).option("escape", '"').option("compression", compression).csv(path)
