"""What plots draw, as frames: positions, expected quantiles, matrices, bins. Drawing is left to the caller."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.special import beta_ppf, norm_ppf
from ..plans.ids import numbered
from ..types import Phenotypes, RegressionResults, is_numeric, number
from .describe import summarize


def neglog10(p: Column) -> Column:
    return F.when(p > 0, -F.log10(p))


def manhattan(df: DataFrame, *, p: str = "p_value", chrom: str = "chrom", pos: str = "pos", order: str | None = None, top: int = 0, label: str | None = None) -> DataFrame:
    """df with y, x and is_top. Chromosomes follow each other in the order of their least `order`, a row number (without one, numbers first), with gaps of 1 % of the longest."""
    rows = df.where(F.col(p).isNotNull())
    seen = F.min(order) if order else F.min(F.when(F.col(chrom).cast("string").rlike(r"^\d{1,9}$"), F.col(chrom).try_cast("int")).otherwise(F.crc32(F.col(chrom).cast("string").cast("binary")) + (1 << 31)))
    per = rows.groupBy(F.col(chrom).alias("__c")).agg(seen.alias("__first"), F.max(pos).alias("__max"))  # a row for each chromosome
    gap = F.greatest(F.lit(1.0), F.max("__max").over(Window.partitionBy()) * 0.01)
    offsets = per.withColumn("__gap", gap).withColumn("__offset", F.coalesce(F.sum(F.col("__max") + F.col("__gap")).over(Window.orderBy("__first", "__c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    out = rows.join(F.broadcast(offsets.select("__c", "__offset")), F.col(chrom) == F.col("__c")).withColumn("x", F.col(pos) + F.col("__offset")).withColumn("y", neglog10(F.col(p))).drop("__c", "__offset")
    if not top:
        return out.withColumn("is_top", F.lit(False))
    ties = [c for c in (label, chrom, pos) if c]
    best = rows.orderBy(p, *ties).limit(top).select(*[F.col(c).alias(f"__{c}") for c in {chrom, pos}], F.lit(True).alias("__top")).distinct()
    return out.join(F.broadcast(best), [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in {chrom, pos}], "left").withColumn("is_top", F.coalesce("__top", F.lit(False))).drop("__top", *[f"__{c}" for c in {chrom, pos}])


def cutoffs(df: DataFrame, *, p: str = "p_value", alpha: float = 0.05) -> DataFrame:
    """One row: the Bonferroni cutoff alpha over the number of p-values, and its height."""
    return df.agg(F.count(p).alias("n_tests")).select("n_tests", (F.lit(alpha) / F.greatest("n_tests", F.lit(1))).alias("cutoff"), neglog10(F.lit(alpha) / F.greatest("n_tests", F.lit(1))).alias("y"))


def miami(upper: DataFrame, lower: DataFrame, **options) -> DataFrame:
    """Two series, the lower one mirrored, with a panel column."""
    a = manhattan(upper, **options).withColumn("panel", F.lit("upper"))
    b = manhattan(lower, **options).withColumn("panel", F.lit("lower")).withColumn("y", -F.col("y"))
    return a.unionByName(b, allowMissingColumns=True)


def qq(df: DataFrame, *, p: str = "p_value", band: float | None = None) -> DataFrame:
    """observed and expected -log10 p of each p-value in (0, 1], smallest first; with `band` the pointwise interval of order statistics."""
    rows = df.select(F.col(p).cast("double").alias("p")).where("p > 0 and p <= 1")
    out = numbered(rows, ["p"], "rank").withColumn("n", F.lit(rows.count()))
    out = out.select("rank", neglog10(F.col("p")).alias("observed"), neglog10((F.col("rank") - 0.5) / F.col("n")).alias("expected"), "n")
    if band is None:
        return out.drop("n")
    edge = lambda q: F.pandas_udf(lambda r, m: r.combine(m, lambda a, b: -math.log10(max(1e-300, beta_ppf(q, float(a), float(b - a + 1))))), "double")
    return out.withColumn("low", edge(1 - (1 - band) / 2)("rank", "n")).withColumn("high", edge((1 - band) / 2)("rank", "n")).drop("n")


def lambda_gc(df: DataFrame, *, p: str = "p_value") -> DataFrame:
    """Genomic inflation: the median of the one-degree chi-squared of the p-values over 0.4549."""
    med = df.where((F.col(p) > 0) & (F.col(p) <= 1)).agg(F.count(p).alias("n"), F.percentile(p, 0.5).alias("m"))
    chi = F.pandas_udf(lambda m: m.map(lambda v: norm_ppf(v / 2) ** 2 / 0.4549), "double")
    return med.select("n", F.when(F.col("n") > 0, chi(F.coalesce("m", F.lit(0.5)))).alias("lambda_gc"))


def average_linkage(values: np.ndarray) -> list[int]:
    """Leaf order of average linkage over the rows' Euclidean distances (missing as 0)."""
    x = np.nan_to_num(values)
    groups = {k: [k] for k in range(len(x))}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    while len(groups) > 1:
        keys = sorted(groups)
        _, a, b = min((d[np.ix_(groups[i], groups[j])].mean(), i, j) for n, i in enumerate(keys) for j in keys[n + 1 :])
        groups[a] = groups[a] + groups.pop(b)
    return next(iter(groups.values()), [])


def heatmap(df: DataFrame, *, row: str = "term1", col: str = "term2", value: str = "lrt_pvalue", transform: str = "neglog10", sign_col: str | None = None, cutoff: float | None = None, cluster: bool = True, most: int = 200) -> DataFrame:
    """Long symmetric cells: row, col, value, significant, row_order, col_order. The matrix that is clustered has at most `most` terms."""
    v = F.col(value).cast("double")
    shown = {"raw": v, "neglog10": neglog10(v), "signed": neglog10(v) * F.signum(F.col(sign_col)) if sign_col else neglog10(v)}[transform]
    cells = df.where(v.isNotNull()).select(F.col(row).cast("string").alias("row"), F.col(col).cast("string").alias("col"), shown.alias("value"), (v < cutoff if cutoff is not None else F.lit(False)).alias("significant"))
    both = cells.unionByName(cells.select(F.col("col").alias("row"), F.col("row").alias("col"), "value", "significant")).dropDuplicates(["row", "col"])
    names = [r[0] for r in both.select("row").distinct().orderBy("row").limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} terms")
    if cluster and len(names) > 2:
        at = {n: k for k, n in enumerate(names)}
        m = np.zeros((len(names), len(names)))
        for r in both.collect():  # at most most * most cells
            m[at[r["row"]], at[r["col"]]] = r["value"] if r["value"] is not None else 0
        names = [names[k] for k in average_linkage(m)]
    order = F.broadcast(df.sparkSession.createDataFrame([(n, k) for k, n in enumerate(names)] or [("", 0)], "n string, k int"))
    out = both.join(order.select(F.col("n").alias("row"), F.col("k").alias("row_order")), "row")
    return out.join(order.select(F.col("n").alias("col"), F.col("k").alias("col_order")), "col").select("row", "col", "value", "significant", "row_order", "col_order")


def dotplot(df: DataFrame, *, p: str = "beta_pvalue", n: int = 20, label: str = "variable") -> DataFrame:
    """The n smallest p-values with estimates and intervals, in order."""
    rows = df.where(F.col(p).isNotNull()).orderBy(p, label).limit(n)
    keep = [c for c in (label, "beta", "ci_low", "ci_high", p) if c in df.columns]
    return rows.select(*keep, neglog10(F.col(p)).alias("y"))


def bins(df: DataFrame, col: str, n: int = 30, low: float | None = None, high: float | None = None) -> DataFrame:
    """bin, left, right, count of equal-width bins; the last one holds its right end."""
    x = number(df, col)
    if low is None or high is None:
        low, high = df.agg(F.min(x), F.max(x)).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, left double, right double, count long")
    width = (high - low) / n or 1.0
    k = F.least(F.floor((x - low) / width), F.lit(n - 1)).cast("int")
    counts = df.where(x.between(low, high)).groupBy(k.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    every = df.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", (F.lit(low) + F.col("bin") * width).alias("left"), (F.lit(low) + (F.col("bin") + 1) * width).alias("right"), F.coalesce("count", F.lit(0)).alias("count"))


def distribution(phen: Phenotypes, col: str, kind: str = "auto", n_bins: int = 30) -> DataFrame:
    """hist, box (five numbers), violin (bins), qq against the normal, or counts of sorted levels."""
    df = phen.df
    if kind == "auto":
        kind = "hist" if is_numeric(df, col) and df.select(col).distinct().limit(3).count() > 2 else "levels"
    if kind == "levels":
        return df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("level")).agg(F.count(F.lit(1)).alias("count"))
    if kind in ("hist", "violin"):
        return bins(df, col, n_bins)
    if kind == "box":
        return summarize(phen, [col]).select("column", "min", "q25", "median", "q75", "max", "n_outliers")
    if kind == "qq":
        x = df.select(number(df, col).alias("x")).where("x is not null")
        q = F.pandas_udf(lambda s: s.map(norm_ppf), "double")
        return numbered(x, ["x"], "__r").select("x", q((F.col("__r") - 0.5) / F.lit(float(max(1, x.count())))).alias("expected"))
    raise ValueError(f"unknown kind {kind!r}")


def from_results(results: RegressionResults, kind: str = "auto", **options) -> tuple[str, DataFrame]:
    """manhattan from 50 tests on where chromosome and position are known, else the top estimates."""
    df = results.df
    chrom = next((c for c in ("chromosome", "chrom", "contig") if c in df.columns), None)
    pos = next((c for c in ("start_position", "position", "pos") if c in df.columns), None)
    if kind == "auto":
        kind = "manhattan" if chrom and pos and df.limit(50).count() >= 50 else "top"
    if kind == "manhattan":
        if not chrom or not pos:
            raise ValueError("no chromosome and position")
        return kind, manhattan(df, p=results.p_column, chrom=chrom, pos=pos, **options)
    if kind == "qq":
        return kind, qq(df, p=results.p_column, **options)
    return "top", dotplot(df, p=results.p_column, **options)


def from_describe(phen: Phenotypes, per_page: int = 12) -> DataFrame:
    """column, kind, page, slot: which plots a grid shows, continuous before binary before categorical."""
    s = summarize(phen).select("column", "kind")
    rank = F.row_number().over(Window.orderBy(F.when(F.col("kind") == "continuous", 0).when(F.col("kind") == "binary", 1).otherwise(2), "column")) - 1
    return s.withColumn("__r", rank).select("column", "kind", F.floor(F.col("__r") / per_page).cast("int").alias("page"), (F.col("__r") % per_page).alias("slot"))


def from_modify(before: Phenotypes, after: Phenotypes, col: str, n_bins: int = 30) -> DataFrame:
    """state (before, after) and the same bins or levels for both."""
    frames = []
    if is_numeric(before.df, col) and is_numeric(after.df, col):
        ends = [p.df.agg(F.min(number(p.df, col)), F.max(number(p.df, col))).first() for p in (before, after)]
        low, high = min((e[0] for e in ends if e[0] is not None), default=None), max((e[1] for e in ends if e[1] is not None), default=None)
        frames = [bins(p.df, col, n_bins, low, high).withColumn("state", F.lit(s)) for p, s in ((before, "before"), (after, "after"))]
    else:
        frames = [distribution(p, col, "levels").withColumn("state", F.lit(s)) for p, s in ((before, "before"), (after, "after"))]
    return frames[0].unionByName(frames[1])


def from_interaction(results: RegressionResults, most_terms: int = 30, n: int = 20) -> tuple[str, DataFrame]:
    """A heatmap up to most_terms terms, else the top pairs."""
    df = results.df
    terms = df.select(F.explode(F.array("term1", "term2")).alias("t")).distinct().limit(most_terms + 1).count()
    if terms <= most_terms:
        return "heatmap", heatmap(df)
    return "top", df.where("lrt_pvalue is not null").orderBy("lrt_pvalue", "term1", "term2").limit(n)


# What to draw for each kind of object.
SUGGESTIONS = {
    "Phenotypes": ("distribution", "from_describe"),
    "Genotypes": ("from_modify",),
    "association": ("manhattan", "qq", "dotplot"),
    "interaction": ("heatmap", "dotplot"),
}


def suggest(obj: object) -> tuple[str, ...]:
    if isinstance(obj, RegressionResults):
        return SUGGESTIONS["interaction" if "term1" in obj.df.columns else "association"]
    return SUGGESTIONS.get(type(obj).__name__, ())
