"""Domain relations projected from the star-schema tables; money is in whole cents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "1998-06-15"
#: Lines that one task joins and sorts; tables of up to so many such parts are left to the planner.
TASK_LINES, LEFT_ALONE = 500_000, 8
#: Labels that products carry in turn, so that text operators have something to read.
LABELS = (
    "Mléko plnotučné 1,5% 2x900 ml", "Máslo 250 g", "Pivo světlý ležák 0,5 l", "Šampon na vlasy 400 ml", "Různé druhy sýrů",
    "Krmivo pro kočky 4 x 50 g", "Pánská mikina", "Hrnec 5 l", "Vitamin C 60 ks", "Televize 55", "Akce", "Chléb 1,00 kg", "Gril zahradní", "Prací gel 3 l",
    "Káva mletá 1 kg", "Rohlík 43 g",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, nation, region = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(
        F.col("s_suppkey").alias("store_id"),
        F.lower(F.replace("s_name", F.lit("#"), F.lit("-"))).alias("slug"),
        F.col("n_name").alias("city"),
        F.col("r_name").alias("region"),
        (F.col("s_acctbal") >= 0).alias("is_active"),
        (F.lit(48.5) + F.expr("(s_suppkey * 37) % 250") / 100).alias("latitude"),
        (F.lit(12.0) + F.expr("(s_suppkey * 53) % 680") / 100).alias("longitude"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.array(*map(F.lit, LABELS))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.get(labels, (F.col("p_partkey") % len(LABELS)).cast("int")).alias("label"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category"),
        F.col("p_size").cast("bigint").alias("grams"),
        (F.col("p_partkey") % 3 == 0).alias("is_verified"),
        F.round(F.col("p_retailprice") * 100).cast("bigint").alias("retail_cents"),
    )


def offers(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """All offers, or those of the products ``of`` (``product_id``): lines of other products are then left out before any are moved."""
    lines = table(spark, sf_dir, "lineitem")
    n = lines.count()
    return offers_of(spread(lines_of(lines, of), n=n), table(spark, sf_dir, "orders"))


def lines_of(lines: DataFrame, of: DataFrame | None) -> DataFrame:
    return lines if of is None else lines.join(of.select(F.col("product_id").alias("l_partkey")), "l_partkey", "left_semi")


def spread(lines: DataFrame, task_lines: int = TASK_LINES, n: int | None = None) -> DataFrame:
    """Lines (at most ``n``, or as counted) dealt by list into parts that grow in number, not in size; what follows holds a part's lists in memory."""
    parts = -(-(lines.count() if n is None else n) // task_lines)
    if parts <= LEFT_ALONE:
        return lines
    return lines.repartition(max(parts, int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "l_orderkey")


def offers_of(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """Lines, a table or a stream, as offers; the id has five parts, as order and line alone are not unique."""
    orders = orders.select("o_orderkey", "o_orderstatus", "o_orderpriority")
    cents = "round(l_extendedprice * 100)::bigint"
    off, n = "round(l_discount * 100)::bigint", "l_quantity::bigint"
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.to_date("l_shipdate").cast("string")).alias("offer_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("store_id"),
        F.expr(f"({cents} * (100 - {off}) * 2 + 100 * {n}) div (200 * {n})").alias("price_cents"),
        F.expr(f"case when l_discount > 0 then ({cents} * 2 + {n}) div (2 * {n}) end").alias("old_cents"),
        F.to_date("l_shipdate").alias("valid_from"),
        F.date_add(F.to_date("l_shipdate"), F.col("l_linenumber") * 2).alias("valid_to"),
        F.expr("case o_orderstatus when 'F' then 'published' when 'O' then 'review' else 'expired' end").alias("status"),
        (F.col("l_returnflag") != "R").alias("is_verified"),
        F.expr("case left(o_orderpriority, 1) when '1' then 'store' when '2' then 'city' when '3' then 'region' else 'national' end").alias("coverage"),
        F.col("l_shipdate").alias("published_at"),
        F.col("l_orderkey").alias("list_id"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
    )


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their title; pages without one are left out."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", title.alias("title")).where("title <> ''")
