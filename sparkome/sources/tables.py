"""Readers of tables, phenotypes, summary statistics and identifier lists."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..types import SUMSTATS, Phenotypes

def _ibm(raw: np.ndarray) -> np.ndarray:
    """IBM hexadecimal floats (rows of 8 bytes) as doubles; SAS missing codes as NaN."""
    first = raw[:, 0]
    mantissa = np.zeros(len(raw))
    for k in range(1, 8):
        mantissa = mantissa * 256 + raw[:, k]
    value = np.ldexp(mantissa / 2.0**56, 4 * ((first & 127).astype(int) - 64)) * np.where(first & 128, -1.0, 1.0)
    coded = (raw[:, 1:] == 0).all(axis=1)
    missing = coded & ((first == 46) | (first == 95) | ((first >= 65) & (first <= 90)))
    return np.where(missing, np.nan, np.where(coded & (first == 0), 0.0, value))


def xpt_columns(head: bytes) -> tuple[list[tuple[str, bool, int, int]], int, int]:
    """(name, is text, width, place) of the columns, the length of a row and where rows begin, of a SAS transport file."""
    at = head.index(b"NAMESTR HEADER RECORD")
    size = 140  # bytes of a description
    count = int(head[at + 34 : at + 38])
    start = at - 20 + 80
    columns = []
    for k in range(count):
        d = head[start + k * size : start + (k + 1) * size]
        kind, _, width, _ = struct.unpack(">hhhh", d[:8])
        (place,) = struct.unpack(">l", d[84:88])
        columns.append((d[8:16].decode("latin-1").strip(), kind == 2, width, place))
    begin = head.index(b"OBS     HEADER RECORD", start) - 20 + 80
    return columns, sum(c[2] for c in columns), begin


def read_xpt(spark: SparkSession, path: str, rows_per_chunk: int = 20_000) -> DataFrame:
    """A SAS transport file. Its rows are cut into chunks that are decoded apart."""
    raw = spark.read.format("binaryFile").load(path).select("content", "length")
    # the descriptions' header says how many there are, 140 bytes each
    mark = bytes(raw.select(F.substring("content", 1, 4096)).first()[0])
    count = int(mark[(at := mark.index(b"NAMESTR HEADER RECORD")) + 34 : at + 38])
    head = bytes(raw.select(F.substring("content", 1, at + 400 + 140 * count)).first()[0])
    columns, width, begin = xpt_columns(head)
    chunk = width * rows_per_chunk
    n = F.floor((F.col("length") - begin + chunk - 1) / chunk)
    # ends of columns that a chunk needs, as its place in the file
    parts = raw.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0).cast("long")))))
    parts = parts.select("k", F.substring(F.col("content"), (F.col("k") * chunk + begin + 1).cast("int"), F.lit(chunk)).alias("b")).repartition(max(1, spark.sparkContext.defaultParallelism), "k").sortWithinPartitions("k")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for b in pdf["b"]:
                a = np.frombuffer(b, np.uint8)
                a = a[: len(a) // width * width].reshape(-1, width)
                a = a[~(a == 32).all(axis=1)]  # blanks that fill the last record
                out = {}
                for name, is_text, w, place in columns:
                    cell = a[:, place : place + w]
                    if is_text:
                        out[name] = [t if (t := bytes(r).decode("latin-1").rstrip()) else None for r in cell]
                    else:
                        out[name] = pd.array(_ibm(np.pad(cell, ((0, 0), (0, 8 - w)))), dtype="Float64")
                yield pd.DataFrame(out)

    schema = ", ".join(f"`{name}` {'string' if is_text else 'double'}" for name, is_text, _, _ in columns)
    df = parts.mapInPandas(run, schema)
    return df.select(*[F.nanvl(c, F.lit(None).cast("double")).alias(c) if t == "double" else c for c, t in df.dtypes])


def read_table(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    """By suffix: .parquet, .xpt, .tsv and .txt (also .gz) tab-separated, else comma-separated. Types are inferred unless a schema is given."""
    low = path.lower().rstrip("/")
    if low.endswith(".parquet"):
        return spark.read.parquet(path)
    if low.endswith(".xpt"):
        return read_xpt(spark, path)
    sep = "\t" if low.removesuffix(".gz").endswith((".tsv", ".txt")) else ","
    reader = spark.read.option("header", True).option("sep", sep).options(**options)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_phenotypes(spark: SparkSession, source: str | DataFrame, *, sample_id: str = "sample_id", **roles) -> Phenotypes:
    df = source if isinstance(source, DataFrame) else read_table(spark, source)
    return Phenotypes(df, sample_id, **roles)


def read_nhanes_xpt(spark: SparkSession, path: str, **roles) -> Phenotypes:
    return read_phenotypes(spark, path, sample_id="SEQN", **roles)


# Source columns of each tool's summary statistics, in the order of SUMSTATS; None is absent.
PRESETS = {
    "plink2": ("ID", "#CHROM", "POS", "A1", "REF", "BETA", "SE", "P", "OBS_CT", "A1_FREQ"),
    "regenie": ("ID", "CHROM", "GENPOS", "ALLELE1", "ALLELE0", "BETA", "SE", "LOG10P", "N", "A1FREQ"),
    "bolt": ("SNP", "CHR", "BP", "ALLELE1", "ALLELE0", "BETA", "SE", "P_BOLT_LMM", None, "A1FREQ"),
    "gwas-catalog": ("hm_rsid", "hm_chrom", "hm_pos", "hm_effect_allele", "hm_other_allele", "hm_beta", "standard_error", "p_value", None, "hm_effect_allele_frequency"),
}


def read_sumstats(spark: SparkSession, path: str, preset: str | None = None, schema: dict[str, str | None] | None = None) -> DataFrame:
    """Canonical columns by a preset, by a mapping canonical -> source, or by both (the mapping wins). Entries without a source are left out.

    regenie's LOG10P becomes a p-value unless the mapping names another column for it.
    """
    if preset is not None and preset not in PRESETS:
        raise ValueError(f"unknown preset {preset!r}; there are {sorted(PRESETS)}")
    mapping = dict(zip(SUMSTATS, PRESETS[preset], strict=True)) if preset else {}
    mapping |= schema or {}
    if not mapping:
        raise ValueError("a preset or a schema is needed")
    low = path.lower()
    sep = "," if low.removesuffix(".gz").endswith(".csv") else "\t"
    df = spark.read.parquet(path) if low.endswith(".parquet") else spark.read.option("header", True).option("sep", sep).option("inferSchema", True).csv(path)
    if missing := [c for c in mapping.values() if c is not None and c not in df.columns]:
        raise KeyError(f"columns not in the file: {missing}")
    logged = preset == "regenie" and "pval" not in (schema or {})
    return df.select(*[(F.pow(F.lit(10.0), -F.col(f"`{src}`")) if name == "pval" and logged else F.col(f"`{src}`")).alias(name) for name, src in mapping.items() if src is not None])


def read_identifiers(spark: SparkSession, path: str) -> DataFrame:
    """One identifier a line; blanks and # comments are dropped."""
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id != '' and not startswith(id, '#')")


def write_csv(df: DataFrame, path: str, one_file: bool = True) -> None:
    """A folder of CSV with headers. Results and reports are small, so one part is the default; larger tables are written by all tasks."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def read_sql(spark: SparkSession, url: str, table: str, *, key: str | None = None, parts: int = 16, **properties: str) -> DataFrame:
    """A table or query of a SQL database through JDBC; the driver's jar must be on the class path.

    With a numeric key, the table is read in as many ranges of it at once as `parts` says, else by one task.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**properties)
    if key:
        quoted = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(key)
        low, high = spark.read.format("jdbc").option("url", url).option("query", f"SELECT MIN({quoted}) AS low, MAX({quoted}) AS high FROM {table}").options(**properties).load().first()
        if low is not None:
            reader = reader.option("partitionColumn", key).option("lowerBound", int(low)).option("upperBound", int(high) + 1).option("numPartitions", parts)
    return reader.load()


def fetch(spark: SparkSession, url: str, target: str, sha256: str | None = None) -> str:
    """Copy a file from any store that Hadoop opens (http and https too) and give its SHA-256. A target that has the hash already is left; a wrong hash leaves nothing."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    there = path(target)
    fs = there.getFileSystem(conf)
    digest = lambda p: spark.read.format("binaryFile").load(p).select(F.sha2("content", 256)).first()[0]
    if sha256 and fs.exists(there) and digest(target) == sha256:
        return sha256
    source, part = path(url), path(f"{target}.part")
    jvm.org.apache.hadoop.io.IOUtils.copyBytes(source.getFileSystem(conf).open(source), fs.create(part, True), 1 << 20, True)
    got = digest(f"{target}.part")
    if sha256 and got != sha256:
        fs.delete(part, False)
        raise ValueError(f"{url} has the hash {got}")
    fs.delete(there, False)
    fs.rename(part, there)
    return got
