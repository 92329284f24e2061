"""Domain tables derived from the driver's tables by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..types import Genotypes, Phenotypes

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")

PHEN = """SELECT c_custkey AS sample_id, c_acctbal AS acctbal, CAST(o.n AS DOUBLE) AS n_orders, o.t AS total_price,
    CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal * 0.25 + o.n END AS exposure, c_mktsegment AS segment,
    CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_nationkey END AS nation, CASE WHEN c_acctbal > 4000 THEN 1 ELSE 0 END AS rich,
    CAST(1 + c_custkey % 3 AS DOUBLE) AS weight
    FROM customer JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS t FROM orders GROUP BY o_custkey) o ON c_custkey = o.o_custkey"""

VARIANTS = "SELECT p_partkey AS variant_idx, 'rs' || CAST(p_partkey AS STRING) AS variant_id, CAST(p_size % 22 + 1 AS STRING) AS contig, p_partkey * 1000 AS position, length(p_type) AS t FROM part"
# a call for each part that a supplier has delivered; integer arithmetic, so that engines agree
CALLS = """SELECT l_partkey AS variant_idx, l_suppkey AS sample_id,
    CASE WHEN (l_suppkey + l_partkey) % 23 = 0 THEN -1 WHEN (l_partkey * 31 + l_suppkey * 17 + l_partkey * l_suppkey) % 7 < 2 THEN 1 ELSE 0 END AS a1,
    CASE WHEN (l_suppkey + l_partkey) % 23 = 0 THEN -1 WHEN (l_partkey * 13 + l_suppkey * 29 + l_partkey * l_suppkey) % 5 < 2 THEN 1 ELSE 0 END AS a2
    FROM lineitem GROUP BY l_partkey, l_suppkey"""

PVALUES = "SELECT p_partkey AS id, p_brand AS grp, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE CAST((p_partkey * 37) % 1009 + 1 AS DOUBLE) / 1010.0 / (1 + p_partkey % 5) END AS p_value, CAST(p_size % 22 + 1 AS STRING) AS chrom, p_partkey * 1000 AS pos FROM part"


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run SQL over the tables of sf_dir."""
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in text})


def braced(text: str) -> str:
    """Table names as the placeholders that sql() fills, so that no session-wide view is needed."""
    import re

    return re.sub(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", r"\1 {\2}", text)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def phenotypes(spark: SparkSession, sf_dir: str) -> Phenotypes:
    return Phenotypes(sql(spark, sf_dir, braced(PHEN)), outcomes=("total_price",), covariates=("n_orders",), exposures=("acctbal", "exposure"), weights="weight")


def genotypes(spark: SparkSession, sf_dir: str) -> Genotypes:
    variants = sql(spark, sf_dir, braced(VARIANTS)).select("variant_idx", "variant_id", "contig", "position", F.when(F.col("t") % 3 == 0, F.array(F.lit("A"), F.lit("CT"))).when(F.col("t") % 3 == 1, F.array(F.lit("A"), F.lit("G"))).otherwise(F.array(F.lit("A"), F.lit("G"), F.lit("T"))).alias("alleles"))
    calls = sql(spark, sf_dir, braced(CALLS)).select("variant_idx", "sample_id", F.array("a1", "a2").alias("gt"))
    return Genotypes(variants, calls)


def p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, braced(PVALUES))
