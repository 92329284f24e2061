"""The folder that driver and executors share, and files written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; where that is unset, on a single machine only, below a temporary folder."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="sparkome-"))
        root = sc.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_tsv(df: DataFrame, path: str, header: bool = True) -> str:
    """Tab-separated text without quoting; values hold no tab. Null is the empty field."""
    plain = {"sep": "\t", "header": str(header).lower(), "quote": "\u0000", "emptyValue": "", "nullValue": ""}
    df.write.options(**plain).csv(path)
    return path


def write_lines(df: DataFrame, path: str) -> str:
    """The first column as lines of text."""
    df.select(df.columns[0]).write.text(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: df as a Parquet table in the shared folder, read back. Columns without a type, which files can't hold, are put back as they were."""
    path = folder(df.sparkSession, name)
    named = lambda c: F.col("`" + c.replace("`", "``") + "`")
    kept = [c for c, t in df.dtypes if t != "void"]
    df.select(*[named(c) for c in kept]).write.parquet(path)
    back = df.sparkSession.read.schema(df.select(*[named(c) for c in kept]).schema).parquet(path)
    return back.select(*[named(c) if t != "void" else F.lit(None).alias(c) for c, t in df.dtypes]) if len(kept) < len(df.columns) else back
