"""Phenotype summaries. Everything is one pass over a long form (group, column, value) with partial aggregation."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.special import kendall_tau_b, norm_sf
from ..plans.ids import average_ranks
from ..types import Phenotypes, corr, is_numeric, number

CV_LIMIT, ZERO_MEAN_STD, FENCE = 1e-3, 1e-9, 1.5
#: Cells that a crosstab may have.
MAX_CELLS = 1_000_000


def resolve(phen: Phenotypes, cols: list[str] | None, *, with_id: bool = False) -> list[str]:
    """The named columns, which must exist, or all (without the id unless asked)."""
    if cols is None:
        return [c for c in phen.df.columns if with_id or c != phen.sample_id]
    if missing := [c for c in cols if c not in phen.df.columns]:
        raise KeyError(f"columns not in the table: {missing}")
    return list(cols)


def long_form(df: DataFrame, cols: list[str], keep: list[str] = ()) -> DataFrame:
    """keep..., column, num, value, x: one row for each row and column. num says that the column is numeric, x holds its number."""
    parts = []
    for c in cols:
        numeric = is_numeric(df, c)
        x = number(df, c) if numeric else F.lit(None).cast("double")
        value = F.when(x.isNotNull(), F.col(f"`{c}`").cast("string")) if numeric else F.col(f"`{c}`").cast("string")
        parts.append(F.struct(F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("dtype"), F.lit(numeric).alias("num"), value.alias("value"), x.alias("x")))
    return df.select(*[F.col(f"`{k}`") for k in keep], F.inline(F.array(*parts)))


def _attach(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    renamed = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(renamed, on, "left").drop(*[f"__{k}" for k in keys])


def near_zero(n_unique: Column, num: Column, mean: Column, std: Column) -> Column:
    return (
        F.when(n_unique <= 1, True)
        .when(~num | std.isNull(), False)
        .when(std == 0, True)
        .when(mean == 0, std < ZERO_MEAN_STD)
        .otherwise(F.abs(std / mean) < CV_LIMIT)
    )


def summarize(phen: Phenotypes, cols: list[str] | None = None, *, by: str | None = None, weighted: bool = False, dropna_group: bool = True) -> DataFrame:
    """One row for each column (and group): counts, moments, quartiles, mode, near-zero variance and Tukey outliers.

    kind: two distinct values are binary, else numbers are continuous, else categorical. Mode: of columns that aren't
    numeric, the smallest of the commonest values. With weighted, rows need the value and a weight: mean and the
    (population) standard deviation are weighted, quartiles are those of the weight distribution, and
    the mode has the largest weight.
    """
    if weighted and not phen.weights:
        raise ValueError("weighted summaries need a weights column")
    names = [c for c in resolve(phen, cols) if c != by]
    df = phen.df if by is None or not dropna_group else phen.df.where(F.col(f"`{by}`").isNotNull())
    group = [by] if by else []
    w = [phen.weights] if weighted else []
    keys = [*group, "column"]
    long = long_form(df.withColumn("__weight", number(df, phen.weights)) if weighted else df, names, [*group, *(["__weight"] if weighted else [])])
    if weighted:
        whole = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").isNull()).alias("n_missing"), F.first("dtype").alias("dtype"), F.first("num").alias("num"))
        long = long.where(F.col("value").isNotNull() & F.col("__weight").isNotNull())
    levels = long.where(F.col("value").isNotNull()).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("__c"), (F.sum("__weight") if w else F.count(F.lit(1))).alias("__m"))
    modes = levels.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_unique"), F.min(F.struct((-F.col("__m")).alias("m"), F.col("value"), F.col("__c"))).alias("__mode"))
    aggs = [F.min("x").alias("min"), F.max("x").alias("max")]
    if not w:
        aggs += [F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").isNull()).alias("n_missing"), F.first("dtype").alias("dtype"), F.first("num").alias("num"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("__q")]
        stats = long.groupBy(*keys).agg(*aggs)
    else:
        aggs += [F.try_divide(F.sum(F.col("__weight") * F.col("x")), F.sum(F.when(F.col("x").isNotNull(), F.col("__weight")))).alias("mean"), F.sum(F.when(F.col("x").isNotNull(), F.col("__weight"))).alias("__total")]
        stats = long.groupBy(*keys).agg(*aggs)
        spread = _attach(long, stats.select(*keys, "mean", "__total"), keys).groupBy(*keys).agg(F.sqrt(F.try_divide(F.sum(F.col("__weight") * F.pow(F.col("x") - F.col("mean"), 2)), F.first("__total"))).alias("std"))
        # quantile p: the first value whose cumulative weight reaches p of the total, averaged with the next where it is just p
        points = long.where("x is not null").groupBy(*keys, "x").agg(F.sum("__weight").alias("__p"))
        run = Window.partitionBy(*keys).orderBy("x")
        points = points.withColumn("__cum", F.sum("__p").over(run)).withColumn("__next", F.lead("x").over(run)).withColumn("__all", F.sum("__p").over(Window.partitionBy(*keys)))
        q = []
        for p in (0.25, 0.5, 0.75):
            just = F.abs(F.col("__cum") - p * F.col("__all")) < 1e-9 * F.col("__all")
            q.append(F.min(F.when(just, F.struct("x", ((F.col("x") + F.coalesce("__next", "x")) / 2).alias("v"))).when(F.col("__cum") > p * F.col("__all"), F.struct("x", F.col("x").alias("v")))).getField("v"))
        stats = _attach(_attach(_attach(stats, spread, keys), points.groupBy(*keys).agg(F.array(*q).alias("__q")), keys), whole, keys)
    # fences are joined back to the values: a small table, which Spark broadcasts where it is small enough
    fences = stats.select(*keys, (F.col("__q")[0]).alias("__q1"), (F.col("__q")[2]).alias("__q3"), (F.col("__q")[2] - F.col("__q")[0]).alias("__iqr"))
    outside = (F.col("x") < F.col("__q1") - FENCE * F.col("__iqr")) | (F.col("x") > F.col("__q3") + FENCE * F.col("__iqr"))
    outliers = _attach(long.where("x is not null"), fences, keys).groupBy(*keys).agg(F.when(F.count("x") < 4, None).when(F.first("__iqr") <= 0, 0).otherwise(F.count_if(outside)).cast("long").alias("n_outliers"))
    out = _attach(_attach(stats, modes, keys), outliers, keys)
    kind = F.when(F.col("n_unique") == 2, "binary").when(F.col("num"), "continuous").otherwise("categorical")
    text = lambda c: F.when(~F.col("num"), c)
    return out.select(
        *group, "column", "dtype", F.coalesce(kind, F.lit("categorical")).alias("kind"), "n", "n_missing", F.bround(100.0 * F.col("n_missing") / F.col("n"), 2).alias("missing_pct"),
        F.coalesce("n_unique", F.lit(0)).cast("long").alias("n_unique"), "mean", "std", "min", F.col("__q")[0].alias("q25"), F.col("__q")[1].alias("median"), F.col("__q")[2].alias("q75"), "max",
        text(F.col("__mode.value")).alias("mode"), text(F.col("__mode.__c")).alias("mode_count"), near_zero(F.coalesce("n_unique", F.lit(0)), F.col("num"), F.col("mean"), F.col("std")).alias("near_zero_var"), "n_outliers",
    )


def summarize_by(phen: Phenotypes, by: str, cols: list[str] | None = None, dropna_group: bool = True) -> DataFrame:
    return summarize(phen, cols, by=by, dropna_group=dropna_group)


def exact_quantiles(df: DataFrame, col: str, probs: list[float], accuracy: int = 10_000) -> list[float | None]:
    """Exact linear-interpolation quantiles in bounded memory, for columns whose distinct values no task could hold.

    An approximate sketch brackets each rank, one pass counts what lies below and inside the brackets, and
    only values inside are ranked exactly: about 1/accuracy of the rows.
    """
    x = df.select(number(df, col).alias("x")).where("x is not null")
    spread = [min(1.0, max(0.0, p + d)) for p in probs for d in (-2 / accuracy, 2 / accuracy)]
    row = x.agg(F.count("x"), F.percentile_approx("x", spread, accuracy), F.min("x"), F.max("x")).first()
    n, ends, least, most = row
    if not n:
        return [None] * len(probs)
    ranks = [(p * (n - 1), int(p * (n - 1)), min(n - 1, int(p * (n - 1)) + 1)) for p in probs]
    bounds = [(ends[2 * k], ends[2 * k + 1]) for k in range(len(probs))]
    for _ in range(2):
        got = x.agg(*[f for lo, hi in bounds for f in (F.count_if(F.col("x") < lo), F.count_if(F.col("x").between(lo, hi)))]).first()
        ok = [got[2 * k] <= a and b < got[2 * k] + got[2 * k + 1] for k, (_, a, b) in enumerate(ranks)]
        if all(ok):
            break
        bounds = [bound if good else (least, most) for bound, good in zip(bounds, ok, strict=True)]
    share = lambda r, k: (r - got[2 * k]) / max(1, got[2 * k + 1] - 1)
    inside = x.agg(*[F.percentile(F.when(F.col("x").between(lo, hi), F.col("x")), F.array(F.lit(float(share(a, k))), F.lit(float(share(b, k))))) for k, ((lo, hi), (_, a, b)) in enumerate(zip(bounds, ranks, strict=True))]).first()
    return [v[0] + (v[1] - v[0]) * (r - a) for v, (r, a, _) in zip(inside, ranks, strict=True)]


def missing_report(phen: Phenotypes, cols: list[str] | None = None) -> DataFrame:
    names = resolve(phen, cols, with_id=True)
    out = long_form(phen.df, names).groupBy("column").agg(F.count_if(F.col("value").isNull()).alias("n_missing"), F.count(F.lit(1)).alias("n"))
    return out.select("column", "n_missing", F.bround(100.0 * F.col("n_missing") / F.col("n"), 2).alias("missing_pct")).orderBy(F.desc("missing_pct"), "column")


def correlations(phen: Phenotypes, cols: list[str] | None = None, method: str = "pearson") -> DataFrame:
    """var1, var2, n, score of every pair of numeric columns, each over the rows where both are present.

    Pearson is one aggregate for all pairs. Ranks depend on the pair's complete rows, so pairs are laid out as
    groups: spearman ranks them over range partitions; kendall counts exchanges of a pair's rows in one task.
    """
    names = [c for c in resolve(phen, cols) if is_numeric(phen.df, c)]
    pairs = list(itertools.combinations(names, 2))
    if method == "pearson":
        both = lambda a, b: F.col(f"`__{a}`").isNotNull() & F.col(f"`__{b}`").isNotNull()
        df = phen.df.select(*[number(phen.df, c).alias(f"__{c}") for c in names])
        row = F.array(*[F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), F.count_if(both(a, b)).alias("n"), corr(F.when(both(a, b), F.col(f"`__{a}`")), F.when(both(a, b), F.col(f"`__{b}`"))).alias("score")) for a, b in pairs])
        return df.agg(row.alias("r")).select(F.inline("r"))
    long = phen.df.select(F.inline(F.array(*[F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), number(phen.df, a).alias("x"), number(phen.df, b).alias("y")) for a, b in pairs]))).where("x is not null and y is not null")
    keys = ["var1", "var2"]
    if method == "spearman":
        ranked = long.join(average_ranks(long, keys, "x", "rx"), [*keys, "x"]).join(average_ranks(long, keys, "y", "ry"), [*keys, "y"])
        return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), corr(F.col("rx"), F.col("ry")).alias("score"))
    if method != "kendall":
        raise ValueError(f"unknown method {method!r}")

    def tau(pdf):
        import pandas as pd

        return pd.DataFrame({"var1": [pdf["var1"].iloc[0]], "var2": [pdf["var2"].iloc[0]], "n": [len(pdf)], "score": [kendall_tau_b(pdf["x"].to_numpy(), pdf["y"].to_numpy())]})

    return long.groupBy(*keys).applyInPandas(tau, "var1 string, var2 string, n long, score double")


def correlation_matrix(phen: Phenotypes, cols: list[str] | None = None, method: str = "pearson") -> DataFrame:
    """Wide and symmetric, ones on the diagonal."""
    names = [c for c in resolve(phen, cols) if is_numeric(phen.df, c)]
    half = correlations(phen, names, method).select("var1", "var2", "score")
    ones = phen.df.sparkSession.createDataFrame([(c, c, 1.0) for c in names], "var1 string, var2 string, score double")
    both = half.unionByName(half.select(F.col("var2").alias("var1"), F.col("var1").alias("var2"), "score")).unionByName(ones)
    return both.groupBy(F.col("var1").alias("variable")).pivot("var2", names).agg(F.first("score"))


def correlation_pairs(phen: Phenotypes, cols: list[str] | None = None, method: str = "pearson", threshold: float = 0.75, absolute: bool = True) -> DataFrame:
    rank = F.abs("score") if absolute else F.col("score")
    return correlations(phen, cols, method).where(rank >= threshold).select("var1", "var2", "score").orderBy(F.desc(F.abs("score")), "var1", "var2")


def crosstab(phen: Phenotypes, var1: str, var2: str, *, normalize: bool | str = False, margins: bool = False, dropna: bool = True) -> DataFrame:
    """Long form: var1, var2, count (or share, by 'all', 'index' or 'columns'); margins are rows with `All`."""
    df = phen.df.select(F.col(f"`{var1}`").cast("string").alias("var1"), F.col(f"`{var2}`").cast("string").alias("var2"))
    if dropna:
        df = df.na.drop()
    counts = df.groupBy("var1", "var2").agg(F.count(F.lit(1)).alias("count"))
    # a pair of levels that doesn't occur counts 0, so levels must be few
    n_one, n_two = counts.agg(F.count_distinct("var1"), F.count_distinct("var2")).first()
    if n_one * n_two > MAX_CELLS:
        raise ValueError(f"{n_one} times {n_two} levels are more than {MAX_CELLS} cells")
    one, two = counts.select(F.col("var1").alias("a")).distinct(), counts.select(F.col("var2").alias("b")).distinct()
    grid = one.join(F.broadcast(two))
    counts = grid.join(counts, F.col("a").eqNullSafe(F.col("var1")) & F.col("b").eqNullSafe(F.col("var2")), "left").select(F.col("a").alias("var1"), F.col("b").alias("var2"), F.coalesce("count", F.lit(0)).cast("long").alias("count"))
    if margins:
        cube = counts.cube("var1", "var2").agg(F.sum("count").alias("count"), F.grouping("var1").alias("g1"), F.grouping("var2").alias("g2"))
        counts = cube.select(F.when(F.col("g1") == 1, "All").otherwise(F.col("var1")).alias("var1"), F.when(F.col("g2") == 1, "All").otherwise(F.col("var2")).alias("var2"), "count")
    if not normalize:
        return counts
    inner = (F.col("var1") != "All") & (F.col("var2") != "All") if margins else F.lit(True)
    over = {"index": Window.partitionBy("var1"), "columns": Window.partitionBy("var2")}.get(normalize, Window.partitionBy(F.lit(1)))
    return counts.where(inner).withColumn("share", F.col("count") / F.sum("count").over(over)).drop("count")


def value_counts(phen: Phenotypes, cols: list[str], top: int | None = 20, dropna: bool = False) -> DataFrame:
    """column, value, count, pct: the `top` commonest values of each column, ties by value."""
    long = long_form(phen.df, resolve(phen, cols))
    if dropna:
        long = long.where("value is not null")
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    totals = counts.groupBy("column").agg(F.sum("count").alias("__n"))
    out = counts.join(F.broadcast(totals), "column").withColumn("pct", F.bround(100.0 * F.col("count") / F.col("__n"), 2)).drop("__n")
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("count"), F.asc_nulls_last("value")))
    return out.withColumn("__r", rank).where(F.col("__r") <= top).drop("__r") if top else out


def dataset_summary(phen: Phenotypes) -> DataFrame:
    rows = summarize(phen)
    total = F.sum("n")
    return rows.agg(
        F.max("n").alias("n_samples"), F.lit(len(phen.df.columns)).cast("long").alias("n_columns"),
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("binary", "categorical", "continuous")],
        F.count_if(F.col("n_missing") > 0).alias("n_with_missing"), F.bround(100.0 * F.sum("n_missing") / total, 2).alias("total_missing_pct"),
        *[F.lit(len(getattr(phen, r))).cast("long").alias(f"n_{r}") for r in ("outcomes", "covariates", "exposures")], F.lit(bool(phen.weights or phen.strata or phen.cluster)).alias("has_survey_design"),
    )


def skewness(phen: Phenotypes, cols: list[str] | None = None, dropna: bool = False) -> DataFrame:
    """column, n, skew (population), zscore and pvalue of D'Agostino's test from 8 values on; with missing values only n, unless dropna."""
    names = [c for c in resolve(phen, cols) if is_numeric(phen.df, c)]
    s = long_form(phen.df, names).groupBy("column").agg(F.count("x").alias("n"), F.count(F.lit(1)).alias("__all"), F.skewness("x").alias("__g"))
    ok = F.lit(True) if dropna else F.col("n") == F.col("__all")
    n = F.col("n").cast("double")
    s = s.select("column", "n", F.when(ok & ~F.isnan("__g"), F.col("__g")).alias("skew"))
    y = F.col("skew") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (b2 - 1)) - 1
    s = s.withColumn("zscore", F.when(n >= 8, F.asinh(y / F.sqrt(2 / (w2 - 1))) / F.sqrt(F.log(F.sqrt(w2)))))
    p = F.pandas_udf(lambda z: z.map(lambda v: 2 * norm_sf(abs(v))), "double")
    return s.withColumn("pvalue", F.when(F.col("zscore").isNotNull(), p(F.coalesce("zscore", F.lit(0.0)))))
