"""What follows a study: corrections for many tests, selection, annotation, summary."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.special import hommel
from ..plans.ids import numbered, running
from ..types import RegressionResults

METHODS = ("bonferroni", "fdr_bh", "fdr_by", "holm", "sidak", "hommel")


def corrected(df: DataFrame, p: str, method: str = "fdr_bh", by: list[str] | None = None, out: str = "p_corrected") -> DataFrame:
    """df with corrected p-values (of all rows, or of each group); missing ones stay missing and don't count."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    by = list(by or [])
    if method == "hommel":
        schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, `{out}` double"

        def fix(pdf):
            pdf = pdf.copy()
            ok = pdf[p].notna()
            pdf[out] = float("nan")
            pdf.loc[ok, out] = hommel(pdf.loc[ok, p].to_numpy())
            pdf[out] = pdf[out].astype(object).where(ok, None)
            return pdf

        return df.groupBy(*by).applyInPandas(fix, schema)
    some = F.col(p).isNotNull()
    if not by and method != "hommel":
        return _corrected_all(df, p, method, out)
    w = Window.partitionBy(*by, some)
    m = F.count(F.lit(1)).over(w)
    up = w.orderBy(p)
    rank = F.row_number().over(up)
    x = F.col(p)
    if method == "bonferroni":
        value: Column = F.least(F.lit(1.0), x * m)
    elif method == "sidak":
        value = 1 - F.pow(1 - x, m)
    elif method == "holm":
        df = df.withColumn("__v", x * (m - rank + 1)).withColumn("__r", rank)
        value = F.least(F.lit(1.0), F.max("__v").over(w.orderBy("__r").rowsBetween(Window.unboundedPreceding, 0)))
    else:
        scale = F.lit(1.0) if method == "fdr_bh" else F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(m, F.lit(1)).cast("long")), F.lit(0.0), lambda s, k: s + 1.0 / k)
        df = df.withColumn("__r", rank).withColumn("__v", x * m / F.col("__r") * scale)
        value = F.least(F.lit(1.0), F.min("__v").over(w.orderBy(F.desc("__r")).rowsBetween(Window.unboundedPreceding, 0)))
    return df.withColumn(out, F.when(some, value)).drop("__v", "__r")


def _corrected_all(df: DataFrame, p: str, method: str, out: str) -> DataFrame:
    return corrections(df, p, {method: out})


def corrections(df: DataFrame, p: str, names: dict[str, str]) -> DataFrame:
    """df with a column for each method of names, over all rows as one family: the p-values are ranked once, by
    range partitions, and running extremes cross partitions by one number each, so that no task holds all rows. Missing ones stay missing.
    """
    if unknown := [m for m in names if m not in METHODS or m == "hommel"]:
        raise ValueError(f"not for one family of all rows: {unknown}")
    x, m = F.col(p), float(df.agg(F.count(p)).first()[0])
    made = {"bonferroni": F.least(F.lit(1.0), x * m), "sidak": 1 - F.pow(1 - x, F.lit(m))}
    rows = df.where(x.isNotNull())
    if {"fdr_bh", "fdr_by", "holm"} & set(names):
        rows = numbered(rows, [p], "__rank", part="__range")
        if {"fdr_bh", "fdr_by"} & set(names):
            rows = running(rows.withColumn("__v", x * m / F.col("__rank")), "__v", "__step_up", rank="__rank", part="__range", largest=False)
        if "holm" in names:
            rows = running(rows.withColumn("__v", x * (m - F.col("__rank") + 1)), "__v", "__step_down", rank="__rank", part="__range", largest=True)
        # the factor of fdr_by is one for all ranks
        made |= {"fdr_bh": F.least(F.lit(1.0), F.col("__step_up")), "fdr_by": F.least(F.lit(1.0), F.col("__step_up") * sum(1.0 / k for k in range(1, int(m) + 1))), "holm": F.least(F.lit(1.0), F.col("__step_down"))}
    found = rows.select(*[F.col(f"`{c}`") for c in df.columns], *[made[method].alias(out) for method, out in names.items()])
    return found.unionByName(df.where(x.isNull()).select("*", *[F.lit(None).cast("double").alias(out) for out in names.values()]))


def with_correction(results: RegressionResults, method: str = "fdr_bh", groupby: list[str] | None = None) -> RegressionResults:
    return replace(results, df=corrected(results.df, results.p_column, method, groupby), metadata=results.metadata | {"correction": method})


def passing(results: RegressionResults, p: float | None = None, p_corrected: float | None = None) -> RegressionResults:
    keep = F.lit(True)
    if p is not None:
        keep = keep & (F.col(results.p_column) < p)
    if p_corrected is not None:
        if "p_corrected" not in results.df.columns:
            raise ValueError("correct the p-values first")
        keep = keep & (F.col("p_corrected") < p_corrected)
    return replace(results, df=results.df.where(keep))


def top(results: RegressionResults, n: int = 20, by: str | None = None, ascending: bool = True) -> DataFrame:
    by = by or results.p_column
    ties = [c for c in ("outcome", "variable", "term1", "term2") if c in results.df.columns and c != by]
    return results.df.orderBy(F.asc_nulls_last(by) if ascending else F.desc_nulls_last(by), *ties).limit(n)


def annotate(results: RegressionResults, report: DataFrame, input_col: str = "variable", keep_columns: list[str] | None = None) -> RegressionResults:
    """The first row of the report for each `input_value`, joined from the left."""
    keep = keep_columns or [c for c in ("gene_symbol", "hgnc_id", "ensembl_id", "chromosome", "start_position", "end_position") if c in report.columns]
    first = report.groupBy("input_value").agg(*[F.min(F.struct(*keep))[c].alias(c) for c in keep])
    out = results.df.join(first, F.col(f"`{input_col}`").cast("string") == first["input_value"], "left").drop("input_value")
    return replace(results, df=out)


def summary(results: RegressionResults, alpha: float = 0.05) -> DataFrame:
    p = F.col(results.p_column)
    error = F.col("error").isNotNull() if "error" in results.df.columns else F.lit(False)
    return results.df.agg(F.count(F.lit(1)).alias("n_tests"), F.count_if(error).alias("n_errors"), F.count_if(p < alpha).alias("n_passing"), F.min(p).alias("min_p"))
