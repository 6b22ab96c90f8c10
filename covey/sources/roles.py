"""The driver's tables in the roles of this library's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers belong to the parts they ordered: user_id, pack_id."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return items.join(orders, items.l_orderkey == orders.o_orderkey).select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("pack_id")).distinct()


def dense_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of events belong to the values of k in the properties."""
    return table(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("pack_id")).where("pack_id IS NOT NULL").distinct()


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers follow customers, an edge for each line item; repeated edges and loops are left in."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    users = F.broadcast(table(spark, sf_dir, "customer").agg(F.count("*").alias("n")))  # one row
    return items.join(orders, items.l_orderkey == orders.o_orderkey).crossJoin(users).select(F.col("o_custkey").alias("source"), (F.col("l_partkey") % F.col("n")).alias("target"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pack_id"), "embedding")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document of each user: user_id, text, lang."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("user_id"), "text", "lang")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as posts: user_id, turn (their time), text."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("user_id"), "turn", "text")


def pair_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact table of pairs of customers, one for each line item that is no loop: user_a < user_b, shared_packs, cosine, n_eff, hops (4: out of reach). A customer is on either side of its pairs."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    users = F.broadcast(table(spark, sf_dir, "customer").agg(F.count("*").alias("n")))  # one row
    s, other = (F.col("l_linenumber") - 1).cast("long"), F.col("l_partkey") % F.col("n")
    joined = items.join(orders, items.l_orderkey == orders.o_orderkey).crossJoin(users).where(F.col("o_custkey") != other)
    return joined.select(
        F.least("o_custkey", other).alias("user_a"), F.greatest("o_custkey", other).alias("user_b"), s.alias("shared_packs"),
        (F.col("l_discount") + F.col("l_quantity") / 1000 + s / 100).alias("cosine"), F.when(s == 0, F.lit(0.0)).otherwise(1 + (s - 1) * (1 - 5 * F.col("l_tax"))).alias("n_eff"), (1 + F.col("l_suppkey") % 4).cast("long").alias("hops"),
    )


#: The same roles as common table expressions for the oracle.
SQL = {
    "m": "m AS (SELECT DISTINCT o_custkey AS user_id, l_partkey AS pack_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey)",
    "dm": "dm AS (SELECT DISTINCT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS pack_id FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL)",
    "e": "e AS (SELECT o_custkey AS source, l_partkey % (SELECT count(*) FROM customer) AS target FROM lineitem JOIN orders ON l_orderkey = o_orderkey)",
    "p": "p AS (SELECT least(o_custkey, other) AS user_a, greatest(o_custkey, other) AS user_b, CAST(l_linenumber - 1 AS BIGINT) AS shared_packs, l_discount + l_quantity / 1000 + (l_linenumber - 1) / 100.0::DOUBLE AS cosine, CASE WHEN l_linenumber = 1 THEN 0.0::DOUBLE ELSE 1 + (l_linenumber - 2) * (1 - 5 * l_tax) END AS n_eff, CAST(1 + l_suppkey % 4 AS BIGINT) AS hops FROM (SELECT *, l_partkey % (SELECT count(*) FROM customer) AS other FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE o_custkey <> other)",
}
