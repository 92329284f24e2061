"""Regressions of many tests from sums over cells: no task sees the rows of a test.

A row of a test is a vector u (the constant, covariates, numeric regressors and their product, zeros where a test has none) and a
cell (the levels of its categorical regressors). Within a cell the design is a linear map of u, so that all a
fit needs is, for each test and cell, sums of products of u, which Spark adds up map-side. Least squares take one
pass; a logistic model takes one for each Newton step, for all tests at once, with coefficients joined by test and cell.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.workspace import written
from ..types import broadcast_if_small

Cell = tuple[str | None, str | None]
#: Of a test's cells: the maps from u to the design, in the order of cells, and how many columns the smaller model has.
Maps = Callable[[dict, list[Cell]], tuple[list[np.ndarray], int]]


def design(cells: list[Cell], k: int, a_numeric: bool, b_numeric: bool | None = None) -> tuple[list[np.ndarray], int, list[list[str]]]:
    """Maps, the size of the smaller model, and the levels of both regressors but the first.

    u is (1, k covariates, a, b, a * b). With one regressor the smaller model lacks it; with two it has both and
    lacks their products.
    """
    width = k + 4
    unit = np.eye(width)
    at_a, at_b, at_ab = k + 1, k + 2, k + 3
    levels = [sorted({c[j] for c in cells if c[j] is not None})[1:] for j in (0, 1)]
    maps = []
    for a, b in cells:
        base = [unit[i] for i in range(k + 1)]
        one = [unit[at_a]] if a_numeric else [unit[0] * (a == v) for v in levels[0]]
        if b_numeric is None:
            maps.append(np.array(base + one))
            continue
        two = [unit[at_b]] if b_numeric else [unit[0] * (b == v) for v in levels[1]]
        if a_numeric and b_numeric:
            products = [unit[at_ab]]
        elif a_numeric:
            products = [unit[at_a] * (b == v) for v in levels[1]]
        elif b_numeric:
            products = [unit[at_b] * (a == v) for v in levels[0]]
        else:
            products = [unit[0] * (a == v) * (b == w) for v in levels[0] for w in levels[1]]
        maps.append(np.array(base + one + two + products))
    n_one = 1 if a_numeric else len(levels[0])
    n_two = 0 if b_numeric is None else 1 if b_numeric else len(levels[1])
    return maps, k + 1 + (0 if b_numeric is None else n_one + n_two), levels


def cell_key(is_number: Column, value: Column) -> Column:
    """A regressor's part of a row's cell: empty for a number, else its level after a mark, as a level may be empty too."""
    return F.when(is_number, F.lit("")).otherwise(F.concat(F.lit("="), value))


def cells_of_keys(pdf: pd.DataFrame) -> list[Cell]:
    return [(a[1:] if a else None, b[1:] if b else None) for a, b in zip(pdf["a"], pdf["b"], strict=True)]


def triangle(width: int, values) -> np.ndarray:
    m = np.zeros((width, width))
    m[np.triu_indices(width)] = values
    return m + np.triu(m, 1).T


def products(u: Column, width: int, w: Column) -> Column:
    """The upper triangle of the sums of w u u'."""
    return F.array(*[F.sum(w * u[i] * u[j]) for i in range(width) for j in range(i, width)])


def linear_sums(rows: DataFrame, keys: list[str], width: int, weighted: bool) -> DataFrame:
    """For each test and cell (a, b): rows, m, v (sums of u y), yy, and for the regressor at `width - 3` its least and greatest value, sum and sum of squares without weights."""
    u, y = F.col("u"), F.col("y")
    w = F.col("w") if weighted else F.lit(1.0)
    x = u[width - 3]
    return rows.groupBy(*keys, "a", "b").agg(
        F.count(F.lit(1)).alias("rows"), products(u, width, w).alias("m"), F.array(*[F.sum(w * u[i] * y) for i in range(width)]).alias("v"), F.sum(w * y * y).alias("yy"),
        F.min(x).alias("lo"), F.max(x).alias("hi"), F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"),
    )


def combined(pdf: pd.DataFrame, maps: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """X'WX and X'Wy (or the gradient) of a test from its cells."""
    size = len(maps[0])
    xx, xv = np.zeros((size, size)), np.zeros(size)
    for t, m, v in zip(maps, pdf["m"], pdf["v"], strict=True):
        xx += t @ triangle(width, m) @ t.T
        xv += t @ np.asarray(v, float)
    return xx, xv


_STATE = "model string, a string, b string, gamma array<double>, beta array<double>, ll double, cov array<double>, n long, status string"


def logistic(rows: DataFrame, keys: str, width: int, maps: Maps, *, weighted: bool = False, most_rounds: int = 100) -> DataFrame:
    """keys, model (full, null), beta, ll, cov, n, status of every test by Newton steps; status is done, unsettled, or what went wrong.

    keys names the columns of a test with their types. A step is one aggregate over the rows of the tests that aren't done yet.
    """
    names = [c.split()[0] for c in keys.split(", ")]
    on, at = [*names, "a", "b"], [*names, "model"]
    u, w = F.col("u"), F.col("w") if weighted else F.lit(1.0)
    spark = rows.sparkSession

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["a", "b"], na_position="first", kind="stable")
        first = pdf.iloc[0]
        cells = cells_of_keys(pdf)
        out = {c: [first[c]] * len(pdf) for c in at} | {"a": pdf["a"], "b": pdf["b"]}
        beta, ll, cov, n, status = [], math.nan, [], int(pdf["rows"].sum()), "go"
        gamma = [[] for _ in cells]
        try:
            whole, small = maps({c: first[c] for c in names}, cells)
            size = len(whole[0]) if first["model"] == "full" else small
            mine = [t[:size] for t in whole]
            if pdf["odd"].sum() or pdf["ylo"].min() != 0 or pdf["yhi"].max() != 1:
                raise ValueError("a logistic outcome must hold 0 and 1")
            h, g = combined(pdf, mine, width)
            scale = np.sqrt(np.diag(h))
            if (scale <= 0).any() or np.linalg.cond(h / np.outer(scale, scale)) > 1e13:
                raise ValueError("the design matrix is singular")
            bread = np.linalg.inv(h)
            before = np.zeros(size) if first["beta"] is None or not len(first["beta"]) else np.asarray(first["beta"], float)
            ll, last = float(pdf["lls"].sum()), first["last"]
            if last is not None and not math.isnan(last) and abs(ll - last) < 1e-8 * (abs(ll) + 1e-8):
                beta, status = before, "done"
            else:
                beta = before + bread @ g
            cov, gamma = bread.ravel(), [beta @ t for t in mine]
        except Exception as e:  # noqa: BLE001  what goes wrong in one fit is that test's status
            status = f"{type(e).__name__}: {e}"
        return pd.DataFrame(out | {"gamma": [list(x) for x in gamma], "beta": [list(beta)] * len(pdf), "ll": ll, "cov": [list(cov)] * len(pdf), "n": n, "status": status})

    schema = f"{keys}, {_STATE}"
    rows = written(rows.select(*on, "u", "y", *(["w"] if weighted else [])), "cells-rows")
    cells = rows.select(*on).distinct()
    models = F.explode(F.array(F.lit("full"), F.lit("null"))).alias("model")
    state = written(cells.select(*on, models).withColumns({"gamma": F.array_repeat(F.lit(0.0), width), "beta": F.array().cast("array<double>"), "ll": F.lit(None).cast("double")}), "cells-state")
    finished = []
    for _ in range(most_rounds):
        now = broadcast_if_small(state.select(*on, "model", "gamma"), 200_000)
        eta = F.greatest(F.lit(-35.0), F.least(F.lit(35.0), F.aggregate(F.zip_with("u", "gamma", lambda x, g: x * g), F.lit(0.0), lambda s, x: s + x)))
        scored = rows.join(now, on).withColumn("eta", eta).withColumn("mu", 1 / (1 + F.exp(-F.col("eta"))))
        mu, y = F.col("mu"), F.col("y")
        ll = F.sum(w * (y * F.col("eta") - F.greatest(F.col("eta"), F.lit(0.0)) - F.log1p(F.exp(-F.abs("eta")))))
        sums = scored.groupBy(*on, "model").agg(
            F.count(F.lit(1)).alias("rows"), products(u, width, w * F.greatest(mu * (1 - mu), F.lit(1e-12))).alias("m"), F.array(*[F.sum(w * u[i] * (y - mu)) for i in range(width)]).alias("v"),
            ll.alias("lls"), F.min("y").alias("ylo"), F.max("y").alias("yhi"), F.count_if(~y.isin(0.0, 1.0)).alias("odd"),
        )
        sums = sums.join(state.select(*on, "model", "beta", F.col("ll").alias("last")), [*on, "model"])
        new = written(sums.groupBy(*at).applyInPandas(step, schema), "cells-state")
        finished.append(new.where("status != 'go'"))
        state = new.where("status = 'go'")
        if state.isEmpty():
            break
    else:
        finished.append(state.withColumn("status", F.lit("unsettled")))
    out = finished[0]
    for part in finished[1:]:
        out = out.unionByName(part)
    return out.dropDuplicates(at).select(*at, "beta", "ll", "cov", "n", "status")
