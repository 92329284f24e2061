"""Genotype files in the long layout: PLINK, VCF, and Parquet as the store that both are converted to."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.ids import in_order
from ..types import Genotypes


def write_genotypes(geno: Genotypes, path: str) -> None:
    """variants by contig and calls clustered by variant, so that regions and variants prune files."""
    geno.variants.write.mode("overwrite").partitionBy("contig").parquet(f"{path}/variants")
    geno.calls.repartition("variant_idx").sortWithinPartitions("variant_idx").write.mode("overwrite").parquet(f"{path}/calls")


def read_genotypes(spark: SparkSession, path: str) -> Genotypes:
    v = spark.read.parquet(f"{path}/variants").withColumn("contig", F.col("contig").cast("string"))
    return Genotypes(v.select("variant_idx", "variant_id", "contig", "position", "alleles"), spark.read.parquet(f"{path}/calls"))


def read_plink(spark: SparkSession, prefix: str, *, block: int = 4096) -> Genotypes:
    """bed, bim and fam. Alleles are (A2, A1), so a call counts A1. The bed file is read in ranges of variants by the tasks themselves."""
    bim = spark.read.text(f"{prefix}.bim").select(F.split(F.trim("value"), r"\s+").alias("p"))
    rows = in_order(bim, "variant_idx").select("variant_idx", F.col("p")[0].alias("contig"), F.col("p")[1].alias("variant_id"), F.col("p")[3].cast("long").alias("position"), F.array(F.col("p")[5], F.col("p")[4]).alias("alleles"))
    variants = rows.select(F.col("variant_idx").cast("long"), "variant_id", "contig", "position", "alleles")
    samples = [r[0] for r in spark.read.text(f"{prefix}.fam").select(F.split(F.trim("value"), r"\s+")[1].alias("s")).collect()]  # a row for each sample
    ids = spark.sparkContext.broadcast(samples)
    n, count = len(samples), variants.count()
    width = (n + 3) // 4
    path = f"{prefix}.bed"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs as pafs

        fs, place = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        first = np.array([1, -1, 0, 0], np.int8)  # codes 00 two A1, 01 missing, 10 both, 11 two A2
        second = np.array([1, -1, 1, 0], np.int8)
        for pdf in batches:
            for b in pdf["id"]:
                with fs.open_input_file(place) as f:
                    if f.read(3) != b"\x6c\x1b\x01":
                        raise ValueError("not a variant-major bed file")
                    f.seek(3 + int(b) * block * width)
                    raw = np.frombuffer(f.read(block * width), np.uint8).reshape(-1, width)
                codes = np.stack([raw >> s & 3 for s in (0, 2, 4, 6)], axis=2).reshape(len(raw), -1)[:, :n]
                for k in range(len(raw)):
                    c = codes[k]
                    yield pd.DataFrame({"variant_idx": int(b) * block + k, "sample_id": ids.value, "gt": list(np.stack([first[c], second[c]], axis=1).astype(np.int32))})

    blocks = spark.range(0, -(-count // block), 1, max(1, min(-(-count // block), 4 * spark.sparkContext.defaultParallelism)))
    calls = blocks.mapInPandas(run, "variant_idx long, sample_id string, gt array<int>")
    return Genotypes(variants, calls)


def read_vcf(spark: SparkSession, path: str, store: str | None = None, force: bool = False) -> Genotypes:
    """A VCF. With `store`, it is converted once to the Parquet layout there, and read from it unless forced."""
    if store and not force:
        try:
            return read_genotypes(spark, store)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    lines = spark.read.text(path)
    head = lines.where(F.col("value").startswith("#CHROM")).limit(1).collect()
    if not head:
        raise ValueError("no header line of columns")
    samples = head[0][0].split("\t")[9:]
    p = F.split("value", "\t")
    rows = in_order(lines.where(~F.col("value").startswith("#") & (F.col("value") != "")), "variant_idx").select("variant_idx", p.alias("p"))
    name = F.when(F.col("p")[2] != ".", F.col("p")[2]).otherwise(F.concat_ws(":", F.col("p")[0], F.col("p")[1], F.col("p")[3], F.col("p")[4]))
    variants = rows.select(F.col("variant_idx").cast("long"), name.alias("variant_id"), F.col("p")[0].alias("contig"), F.col("p")[1].cast("long").alias("position"), F.concat(F.array(F.col("p")[3]), F.split(F.col("p")[4], ",")).alias("alleles"))
    names = F.broadcast(spark.createDataFrame(list(enumerate(samples)) or [(-1, "")], "k int, sample_id string"))  # a row for each name of the header line
    at = F.array_position(F.split(F.col("p")[8], ":"), "GT").cast("int")
    cells = rows.select(F.col("variant_idx").cast("long").alias("variant_idx"), at.alias("at"), F.posexplode(F.slice("p", F.lit(10), F.greatest(F.size("p") - 9, F.lit(0)))).alias("k", "c")).join(names, "k")
    gt = F.when(F.col("at") > 0, F.get(F.split("c", ":"), F.col("at") - 1))
    slots = F.transform(F.split(F.coalesce(gt, F.lit("./.")), r"[/|]"), lambda a: F.coalesce(a.try_cast("int"), F.lit(-1)))
    calls = cells.select("variant_idx", "sample_id", F.when(F.size(slots) == 1, F.array_repeat(slots[0], 2)).otherwise(slots).alias("gt"))
    geno = Genotypes(variants, calls)
    if store:
        write_genotypes(geno, store)
        return read_genotypes(spark, store)
    return geno
