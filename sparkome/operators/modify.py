"""Phenotype transformations. Each gives a new Phenotypes over a lazy plan; statistics that a step needs are one small aggregate."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.special import norm_ppf
from ..sources.workspace import written
from ..types import Genotypes, Phenotypes, is_numeric, number
from .describe import exact_quantiles, long_form, resolve


def _numeric(phen: Phenotypes, col: str) -> Column:
    if col not in phen.df.columns:
        raise KeyError(col)
    if not is_numeric(phen.df, col):
        raise TypeError(f"{col} isn't numeric")
    return number(phen.df, col)


def bin_column(x: Column, edges: list[float], labels: list[str] | None = None) -> Column:
    """The bin of x among right-closed intervals, the lowest edge included; null outside."""
    out = None
    for k in range(1, len(edges)):
        inside = (x <= edges[k]) & ((x >= edges[0]) if k == 1 else (x > edges[k - 1]))
        value = F.lit(labels[k - 1] if labels else f"({edges[k - 1]:.6g}, {edges[k]:.6g}]")
        out = F.when(inside, value) if out is None else out.when(inside, value)
    return out if out is not None else F.lit(None).cast("string")


def discretize(phen: Phenotypes, col: str, method: str = "quantiles", n_bins: int = 4, bin_edges: list[float] | None = None, labels: list[str] | None = None, new_col: str | None = None, replace_col: bool = False) -> Phenotypes:
    """Cut a column at quantiles (equal edges dropped), at given edges or in equal widths; target `<col>_cat` unless named or replaced."""
    x = _numeric(phen, col)
    if method == "quantiles":
        got = exact_quantiles(phen.df, col, [k / n_bins for k in range(n_bins + 1)])
        edges = sorted({e for e in got if e is not None})
    elif method == "bins":
        if bin_edges is not None:
            edges = list(bin_edges)
        else:
            low, high = phen.df.agg(F.min(x), F.max(x)).first()
            edges = [] if low is None else [low + (high - low) * k / n_bins for k in range(n_bins + 1)]
    else:
        raise ValueError(f"unknown method {method!r}")
    if labels is not None and len(labels) != len(edges) - 1:
        raise ValueError(f"{len(edges) - 1} bins need as many labels")
    target = col if replace_col else new_col or f"{col}_cat"
    return replace(phen, df=phen.df.withColumn(target, bin_column(x, edges, labels)))


def _boxcox_lambda(df: DataFrame, x: Column) -> float:
    """The lambda of greatest profile likelihood: the sign of its slope is taken at 17 values in a pass, which leave a 16th of the interval.

    With y = (x^l - 1) / l the slope is sum(ln x) - n cov(y, dy/dl) / var(y).
    """
    n, least, logs = df.agg(F.count(x), F.min(x), F.sum(F.log(x))).first()
    if n < 2 or least <= 0:
        raise ValueError("Box-Cox needs two positive values at least and no others")
    low, high, log = -5.0, 5.3, F.log(x)  # 0, where the formula doesn't hold, is no value that is tried
    for _ in range(12):
        grid = [low + (high - low) * k / 16 for k in range(17)]
        grown = [F.pow(x, F.lit(g)) for g in grid]
        y = [(w - 1) / g for w, g in zip(grown, grid, strict=True)]
        moves = df.agg(*[F.covar_pop(v, w * log / g - (w - 1) / (g * g)) / F.nullif(F.var_pop(v), F.lit(0.0)) for v, w, g in zip(y, grown, grid, strict=True)]).first()
        slopes = [logs - n * m if m is not None else 0.0 for m in moves]
        at = max((k for k in range(17) if slopes[k] > 0), default=0)
        low, high = grid[at], grid[min(16, at + 1)]
    return (low + high) / 2


def transform(phen: Phenotypes, col: str, method: str | None = None, func: Callable | None = None, new_col: str | None = None, replace_col: bool = False) -> Phenotypes:
    """log, log1p, sqrt, zscore, rank_int, boxcox, or a Series -> Series function (run on Arrow batches, so it must work value by value)."""
    if (method is None) == (func is None):
        raise ValueError("exactly one of method and func")
    x, df = _numeric(phen, col), phen.df
    target = col if replace_col else new_col or (f"{col}_{method}" if method else f"{col}_transformed")
    if func is not None:
        value = F.pandas_udf(lambda s: func(s).astype("float64"), "double")(x)
    elif method in ("log", "log1p", "sqrt"):
        ok, f = {"log": (x > 0, F.log(x)), "log1p": (x > -1, F.log1p(x)), "sqrt": (x >= 0, F.sqrt(x))}[method]
        value = F.when(ok, f)
    elif method == "zscore":
        mean, std = df.agg(F.avg(x), F.stddev_samp(x)).first()
        value = (x - mean) / std if std else F.lit(None).cast("double")
    elif method == "boxcox":
        g = _boxcox_lambda(df, x)
        value = F.log(x) if abs(g) < 1e-12 else (F.pow(x, F.lit(g)) - 1) / g
    elif method == "rank_int":
        return replace(phen, df=rank_int(df, x, target))
    else:
        raise ValueError(f"unknown method {method!r}")
    return replace(phen, df=df.withColumn(target, value))


def rank_int(df: DataFrame, x: Column, target: str) -> DataFrame:
    """Rank-based inverse normal scores. Ranks come from counts of distinct values summed over range partitions, so no task holds all rows."""
    values = df.select(x.alias("__x")).where("__x is not null").groupBy("__x").agg(F.count(F.lit(1)).alias("__c"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = values.repartitionByRange(parts, "__x").withColumn("__p", F.spark_partition_id())
    ranged = written(ranged.sortWithinPartitions("__x"), "ranged")
    sums = {r[0]: r[1] for r in ranged.groupBy("__p").agg(F.sum("__c")).collect()}  # a row for each partition
    before, total = [], 0
    for p in sorted(sums):
        before.append((p, total))
        total += sums[p]
    offsets = df.sparkSession.createDataFrame(before or [(0, 0)], "__p int, __before long")
    run = F.sum("__c").over(Window.partitionBy("__p").orderBy("__x")) - F.col("__c")
    score = F.pandas_udf(lambda s: s.map(norm_ppf), "double")
    ranks = ranged.withColumn("__less", run).join(F.broadcast(offsets), "__p")
    rank = F.col("__before") + F.col("__less") + (F.col("__c") + 1) / 2
    ranks = ranks.select("__x", score((rank - 0.5) / F.lit(float(max(1, total)))).alias(target))
    base = df.drop(target).withColumn("__k", x) if target in df.columns else df.withColumn("__k", x)
    return base.join(ranks, base["__k"] == ranks["__x"], "left").drop("__k", "__x")


def recode(phen: Phenotypes, col: str, mapping: dict | None = None, missing_values: list | None = None, new_col: str | None = None, replace_col: bool = True) -> Phenotypes:
    """Values listed as missing become null; then the others are mapped, and those without a mapping stay."""
    c = F.col(f"`{col}`")
    if missing_values:
        c = F.when(~c.isin(list(missing_values)), c)
    out = c
    if mapping:
        chain = None
        for old, new in mapping.items():
            chain = F.when(c == F.lit(old), F.lit(new)) if chain is None else chain.when(c == F.lit(old), F.lit(new))
        kinds = {type(v) for v in mapping.values()}
        out = chain.otherwise(c.cast("string") if str in kinds else c)
    return replace(phen, df=phen.df.withColumn(new_col or (col if replace_col else f"{col}_recoded"), out))


def levels(phen: Phenotypes, cols: list[str]) -> DataFrame:
    """column, value, count of the values that aren't missing."""
    return long_form(phen.df, cols).where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def auto_classify(phen: Phenotypes, cols: list[str] | None = None, cat_min: int = 3, cat_max: int = 6, cont_min: int = 15) -> DataFrame:
    """column, n_unique, class: constant, binary, categorical, continuous or unknown. A report; nothing is changed."""
    names = resolve(phen, cols)
    got = levels(phen, names).groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"))
    info = phen.df.sparkSession.createDataFrame([(c, is_numeric(phen.df, c)) for c in names], "column string, num boolean")
    n = F.coalesce("n_unique", F.lit(0)).cast("long")
    kind = F.when(n <= 1, "constant").when(n == 2, "binary").when(n.between(cat_min, cat_max), "categorical").when((n >= cont_min) & F.col("num"), "continuous").otherwise("unknown")
    return F.broadcast(info).join(got, "column", "left").select("column", n.alias("n_unique"), kind.alias("class"))


def _targets(phen: Phenotypes, skip: list[str] | None, only: list[str] | None) -> list[str]:
    return [c for c in phen.variables if (only is None or c in only) and c not in (skip or [])]


def make_binary(phen: Phenotypes, skip: list[str] | None = None, only: list[str] | None = None) -> Phenotypes:
    """Columns must hold two distinct values each; {0, 1} becomes an integer, others a category with sorted levels."""
    names, df = _targets(phen, skip, only), phen.df
    some = levels(phen, names).withColumn("r", F.row_number().over(Window.partitionBy("column").orderBy("value"))).where("r <= 3")
    found: dict[str, list[str]] = {c: [] for c in names}
    for r in some.orderBy("column", "value").collect():  # three rows of each column at most
        found[r["column"]].append(r["value"])
    for c, values in found.items():
        if len(values) != 2:
            raise ValueError(f"{c} doesn't hold just two values")
        if is_numeric(df, c) and {float(v) for v in values} == {0.0, 1.0}:
            df = df.withColumn(c, F.col(f"`{c}`").cast("long"))
        else:
            df = df.withMetadata(c, {"levels": values}) if not is_numeric(df, c) else df.withColumn(c, F.col(f"`{c}`").cast("string")).withMetadata(c, {"levels": sorted(values, key=float)})
    return replace(phen, df=df)


def make_categorical(phen: Phenotypes, skip: list[str] | None = None, only: list[str] | None = None) -> Phenotypes:
    df = phen.df
    for c in _targets(phen, skip, only):
        df = df.withColumn(c, F.col(f"`{c}`").cast("string")).withMetadata(c, {"categorical": True})
    return replace(phen, df=df)


def make_continuous(phen: Phenotypes, skip: list[str] | None = None, only: list[str] | None = None) -> Phenotypes:
    """As numbers; a text that isn't one fails the job."""
    return replace(phen, df=phen.df.withColumns({c: F.col(f"`{c}`").cast("double") for c in _targets(phen, skip, only)}))


def remove_outliers(phen: Phenotypes, cols: list[str], method: str = "iqr", k: float = 1.5, cutoff: float = 3.0) -> Phenotypes:
    """Outliers become missing; rows stay. iqr: outside the fences; gaussian: further than cutoff standard deviations."""
    df, new = phen.df, {}
    if method == "gaussian":
        row = df.agg(*[f(_numeric(phen, c)) for c in cols for f in (F.count, F.avg, F.stddev_samp)]).first()
        for j, c in enumerate(cols):
            n, mean, std = row[3 * j : 3 * j + 3]
            x = _numeric(phen, c)
            new[c] = F.when(F.abs(x - mean) / std <= cutoff, x) if n >= 2 and std else x
    elif method == "iqr":
        for c in cols:
            x = _numeric(phen, c)
            q1, q3 = exact_quantiles(df, c, [0.25, 0.75])
            new[c] = F.when(x.between(q1 - k * (q3 - q1), q3 + k * (q3 - q1)), x) if q1 is not None and q3 > q1 else x
    else:
        raise ValueError(f"unknown method {method!r}")
    return replace(phen, df=df.withColumns(new))


def _union_roles(top: Phenotypes, bottom: Phenotypes) -> dict:
    join = lambda a, b: tuple(dict.fromkeys([*a, *b]))
    return {r: join(getattr(top, r), getattr(bottom, r)) for r in ("outcomes", "covariates", "exposures")} | {r: getattr(top, r) or getattr(bottom, r) for r in ("weights", "strata", "cluster")}


def _with_roles(phen: Phenotypes, df: DataFrame, roles: dict) -> Phenotypes:
    have = set(df.columns)
    return Phenotypes(df, phen.sample_id, **{k: tuple(c for c in v if c in have) if isinstance(v, tuple) else v if v in have else None for k, v in roles.items()})


def merge_observations(top: Phenotypes, bottom: Phenotypes) -> Phenotypes:
    """Rows of both over their common columns, in top's order. Shared sample ids are an error."""
    if top.sample_id != bottom.sample_id:
        raise ValueError("the tables name their samples by different columns")
    key = F.col(f"`{top.sample_id}`").cast("string")
    if again := top.df.select(key.alias("k")).join(bottom.df.select(key.alias("k")), "k", "left_semi").limit(3).collect():
        raise ValueError(f"samples in both tables: {[r[0] for r in again]}")
    common = [c for c in top.df.columns if c in bottom.df.columns]
    return _with_roles(top, top.df.select(*common).unionByName(bottom.df.select(*common)), _union_roles(top, bottom))


def merge_variables(left: Phenotypes, right: Phenotypes, how: str = "outer") -> Phenotypes:
    """Columns of both, joined by id; other columns of the same name get _x and _y and lose their roles."""
    if left.sample_id != right.sample_id:
        raise ValueError("the tables name their samples by different columns")
    i = left.sample_id
    clash = {c for c in left.df.columns if c in right.df.columns and c != i}
    a = left.df.select(*[F.col(f"`{c}`").alias(f"{c}_x" if c in clash else c) for c in left.df.columns])
    b = right.df.select(*[F.col(f"`{c}`").alias(f"{c}_y" if c in clash else c) for c in right.df.columns])
    return _with_roles(left, a.join(b, i, how), _union_roles(left, right))


def colfilter(phen: Phenotypes, skip: list[str] | None = None, only: list[str] | None = None) -> Phenotypes:
    return phen.with_df(phen.df.select(phen.sample_id, *[f"`{c}`" for c in _targets(phen, skip, only)]))


def _drop(phen: Phenotypes, gone: list[str]) -> Phenotypes:
    return phen.with_df(phen.df.drop(*gone))


def colfilter_min_n(phen: Phenotypes, n: int = 200, skip: list[str] | None = None, only: list[str] | None = None) -> Phenotypes:
    names = _targets(phen, skip, only)
    have = long_form(phen.df, names).groupBy("column").agg(F.count("value").alias("n"))
    return _drop(phen, [r[0] for r in have.where(F.col("n") < n).collect()])


def colfilter_min_cat_n(phen: Phenotypes, n: int = 200, cat_max: int = 6, skip: list[str] | None = None, only: list[str] | None = None) -> Phenotypes:
    """Drops categorical columns (2 to cat_max values, or not numeric) of which some level has fewer than n rows."""
    names = _targets(phen, skip, only)
    got = levels(phen, names).groupBy("column").agg(F.count(F.lit(1)).alias("u"), F.min("count").alias("least")).collect()
    return _drop(phen, [c for c, u, least in got if (2 <= u <= cat_max or not is_numeric(phen.df, c)) and least < n])


def colfilter_percent_zero(phen: Phenotypes, max_zero_pct: float = 90.0, skip: list[str] | None = None, only: list[str] | None = None) -> Phenotypes:
    names = [c for c in _targets(phen, skip, only) if is_numeric(phen.df, c)]
    got = long_form(phen.df, names).groupBy("column").agg(F.try_divide(100.0 * F.count_if(F.col("x") == 0), F.count("x")).alias("pct"))
    return _drop(phen, [r[0] for r in got.where(F.col("pct") >= max_zero_pct).collect()])


def drop_missing(phen: Phenotypes, cols: list[str] | None = None) -> Phenotypes:
    """Rows without a missing value in cols (default: the id and every column that has a role)."""
    names = cols or list(dict.fromkeys([phen.sample_id, *phen.outcomes, *phen.covariates, *phen.exposures, *(c for c in (phen.weights, phen.strata, phen.cluster) if c)]))
    return replace(phen, df=phen.df.na.drop(subset=names))


def rowfilter_incomplete_obs(phen: Phenotypes, skip: list[str] | None = None, only: list[str] | None = None) -> Phenotypes:
    return replace(phen, df=phen.df.na.drop(subset=[phen.sample_id, *_targets(phen, skip, only)]))


def move_variables(src: Phenotypes, dst: Phenotypes, cols: list[str]) -> tuple[Phenotypes, Phenotypes]:
    """Columns leave src and join dst by id, over those of the same name there. Both must hold the same samples."""
    a, b = (p.df.select(F.col(f"`{p.sample_id}`").cast("string").alias("k")) for p in (src, dst))
    if a.exceptAll(b).limit(1).count() or b.exceptAll(a).limit(1).count():
        raise ValueError("the tables hold different samples")
    part = src.df.select(F.col(f"`{src.sample_id}`").alias("__id"), *[f"`{c}`" for c in cols])
    left = dst.df.drop(*cols)
    out = left.join(part, left[dst.sample_id] == part["__id"]).drop("__id")
    roles = {r: tuple(dict.fromkeys([*getattr(dst, r), *[c for c in getattr(src, r) if c in cols]])) for r in ("outcomes", "covariates", "exposures")}
    return src.with_df(src.df.drop(*cols)), replace(dst, df=out, **roles)


def filter_samples(obj: Phenotypes | Genotypes, ids: DataFrame, keep: bool = True) -> Phenotypes | Genotypes:
    if isinstance(obj, Phenotypes):
        return obj.select_samples(ids, keep)
    if isinstance(obj, Genotypes):
        return obj.select(samples=ids, keep=keep)
    raise TypeError(f"no samples in a {type(obj).__name__}")
