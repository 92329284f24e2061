"""Regression studies: one plan for a whole grid of tests, never a driver loop of jobs.

Linear tests of numeric variables need only sums of products, which Spark adds up map-side; a
small system a test is then solved in Arrow batches. Logistic, categorical, clustered and standardized fits
see their rows grouped by test. A failed fit is a row with an error, not a failed job.
"""

from __future__ import annotations

import itertools
import math
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.special import chi2_sf, norm_sf, t_two_sided
from ..types import ASSOCIATION, INTERACTION, INTERACTION_TERMS, Genotypes, Phenotypes, RegressionResults, broadcast_if_small, is_numeric, number
from .cells import cell_key, cells_of_keys, combined, design, linear_sums, logistic
from .genotypes import dosage, encode

MIN_N = 200
#: Up to so many rows of a test are fitted in one task where sums over cells would take a pass for each step; beyond it none are.
LOCAL_ROWS = 500_000


@dataclass
class Fit:
    beta: np.ndarray
    cov: np.ndarray
    llf: float
    n: float
    converged: bool = True

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.maximum(0, np.diag(self.cov)))

    def p(self, k: int) -> float:
        return 2 * norm_sf(abs(self.beta[k] / self.se[k])) if self.se[k] > 0 else math.nan

    @property
    def aic(self) -> float:
        return -2 * self.llf + 2 * len(self.beta)


def _gaussian_llf(rss: float, n: float) -> float:
    return -n / 2 * (math.log(2 * math.pi * max(rss, 1e-300) / n) + 1)


def fit_glm(y: np.ndarray, x: np.ndarray, family: str, weights: np.ndarray | None = None, cluster: np.ndarray | None = None) -> Fit:
    """Gaussian least squares or binomial iterations, with frequency weights and, if clusters are given, their robust covariance."""
    w = np.ones(len(y)) if weights is None else weights.astype(float)
    k = x.shape[1]
    if np.linalg.matrix_rank(x) < k:
        raise ValueError("the design matrix is singular")
    total = float(w.sum())
    if family == "linear":
        bread = np.linalg.inv((x * w[:, None]).T @ x)
        beta = bread @ (x.T @ (w * y))
        resid = y - x @ beta
        rss = float((w * resid**2).sum())
        if total <= k:
            raise ValueError("no degrees of freedom are left")
        fit = Fit(beta, bread * rss / (total - k), _gaussian_llf(rss, total), total)
        scores = x * (w * resid)[:, None]
    else:
        if not set(np.unique(y)) <= {0.0, 1.0} or len(np.unique(y)) < 2:
            raise ValueError("a logistic outcome must hold 0 and 1")
        beta, last, converged = np.zeros(k), -math.inf, False
        for _ in range(100):
            eta = np.clip(x @ beta, -35, 35)
            mu = 1 / (1 + np.exp(-eta))
            v = np.maximum(mu * (1 - mu), 1e-12)
            bread = np.linalg.inv((x * (w * v)[:, None]).T @ x)
            beta = beta + bread @ (x.T @ (w * (y - mu)))
            eta = np.clip(x @ beta, -35, 35)
            llf = float((w * (y * eta - np.logaddexp(0, eta))).sum())
            if abs(llf - last) < 1e-8 * (abs(llf) + 1e-8):
                converged = True
                break
            last = llf
        mu = 1 / (1 + np.exp(-eta))
        bread = np.linalg.inv((x * (w * np.maximum(mu * (1 - mu), 1e-12))[:, None]).T @ x)
        fit = Fit(beta, bread, llf, total, converged)
        scores = x * (w * (y - mu))[:, None]
    if cluster is not None:
        _, at = np.unique(cluster, return_inverse=True)
        g = at.max() + 1
        sums = np.zeros((g, k))
        np.add.at(sums, at, scores)
        scale = g / max(1, g - 1) * (total - 1) / (total - k)
        fit.cov = scale * bread @ (sums.T @ sums) @ bread
    return fit


def resolve_engine(kind: str | Callable) -> Callable:
    """auto, glm and weighted_glm are fit_glm; a callable of its signature is used as it is; survey engines of other systems aren't here."""
    if callable(kind):
        return kind
    if kind in ("auto", "glm", "weighted_glm"):
        return fit_glm
    if kind == "r_survey":
        raise NotImplementedError("the survey engine needs a runtime that isn't part of this library")
    raise ValueError(f"unknown engine {kind!r}")


def infer_family(df: DataFrame, outcomes: list[str]) -> dict[str, str]:
    """logistic for booleans and for numbers of which all are 0 or 1, else linear. One aggregate for all outcomes."""
    out, ask = {}, []
    for c in outcomes:
        if dict(df.dtypes)[c] == "boolean":
            out[c] = "logistic"
        elif is_numeric(df, c):
            ask.append(c)
        else:
            raise ValueError(f"outcome {c} is neither numeric nor boolean")
    if ask:
        row = df.agg(*[f for c in ask for f in (F.count(number(df, c)), F.count_if(~number(df, c).isin(0.0, 1.0)))]).first()
        for k, c in enumerate(ask):
            if not row[2 * k]:
                raise ValueError(f"outcome {c} has no values")
            out[c] = "linear" if row[2 * k + 1] else "logistic"
    return out


def _dummies(values: pd.Series, name: str) -> tuple[np.ndarray, list[str], str]:
    """Design columns of a regressor: numbers as they are, texts as indicators of sorted levels but the first."""
    numeric = pd.to_numeric(values, errors="coerce")
    if numeric.notna().all():
        levels = numeric.nunique()
        return numeric.to_numpy(float)[:, None], [name], "binary" if levels == 2 else "continuous"
    levels = sorted(values.unique())
    cols = np.stack([(values == v).to_numpy(float) for v in levels[1:]], axis=1) if len(levels) > 1 else np.zeros((len(values), 0))
    return cols, [f"{name}_{v}" for v in levels[1:]], "binary" if len(levels) == 2 else "categorical"


def _standardized(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    for k in range(x.shape[1]):
        if len(np.unique(x[:, k])) > 2 and (s := x[:, k].std(ddof=1)) > 0:
            x[:, k] = (x[:, k] - x[:, k].mean()) / s
    return x


def _row(**values) -> dict:
    base = dict.fromkeys([c.split()[0] for c in ASSOCIATION.split(", ")])
    return base | {"converged": False} | values


def _ok(x: float | None) -> float | None:
    return None if x is None or not math.isfinite(x) else float(x)


def _lrt(full: Fit, null: Fit, df: int) -> tuple[float, float]:
    chi2 = 2 * (full.llf - null.llf)
    return chi2, chi2_sf(chi2, df) if chi2 >= 0 and math.isfinite(chi2) else math.nan


def _fit_group(pdf: pd.DataFrame, n_cov: int, min_n: int, engine: Callable, standardize: bool, report: bool) -> pd.DataFrame:
    outcome, variable, family = pdf["outcome"].iloc[0], pdf["variable"].iloc[0], pdf["family"].iloc[0]
    rows: list[dict] = []
    try:
        pdf = pdf[pdf["x"].notna()]
        if not len(pdf):
            raise ValueError("no complete rows")
        x, names, kind = _dummies(pdf["x"], variable)
        cov = np.array(pdf["cov"].tolist(), float).reshape(len(pdf), n_cov)
        if len(pdf) < min_n or len(pdf) < n_cov + x.shape[1] + 2:
            raise ValueError(f"{len(pdf)} complete rows are too few")
        if not x.shape[1] or any(len(np.unique(c)) < 2 for c in x.T):
            raise ValueError("the variable doesn't vary")
        y = pdf["y"].to_numpy(float)
        w = pdf["w"].to_numpy(float) if pdf["w"].notna().all() else None
        cluster = pdf["cl"].to_numpy() if pdf["cl"].notna().all() else None
        design = np.hstack([cov, x])
        if standardize:
            design = _standardized(design)
        ones = np.ones((len(pdf), 1))
        full = engine(y, np.hstack([ones, design]), family, w, cluster)
        null = engine(y, np.hstack([ones, design[:, :n_cov]]), family, w, cluster)
        _, lrt_p = _lrt(full, null, x.shape[1])
        shared = dict(outcome=outcome, n=len(pdf), lrt_pvalue=_ok(lrt_p), diff_aic=_ok(full.aic - null.aic), converged=bool(full.converged and null.converged))

        def term(k: int, name: str, kind_: str) -> dict:
            b, s = float(full.beta[1 + n_cov + k]), float(full.se[1 + n_cov + k])
            return _row(**shared, variable=name, variable_type=kind_, beta=b, se=_ok(s), ci_low=_ok(b - 1.959963984540054 * s), ci_high=_ok(b + 1.959963984540054 * s), beta_pvalue=_ok(full.p(1 + n_cov + k)))

        if x.shape[1] == 1:
            rows.append(term(0, variable, kind))
        else:
            rows.append(_row(**shared, variable=variable, variable_type=kind))
            if report:
                rows += [term(k, name, f"{kind}_dummy") for k, name in enumerate(names)]
    except Exception as e:  # noqa: BLE001  what goes wrong in one fit is that row's error
        rows = [_row(outcome=outcome, variable=variable, n=int(len(pdf)), error=f"{type(e).__name__}: {e}")]
    return pd.DataFrame(rows)


def _vector(df: DataFrame, cols: list[str]) -> Column:
    return F.array(*[number(df, c) for c in cols]) if cols else F.array().cast("array<double>")


def _interval(b: float, se: float) -> dict:
    return dict(beta=b, se=_ok(se), ci_low=_ok(b - 1.959963984540054 * se), ci_high=_ok(b + 1.959963984540054 * se))


def _association_rows(outcome: str, variable: str, rows: int, kind: str, levels: list[str], full: Fit, null: Fit, report: bool) -> list[dict]:
    """The rows of a test from its two fits: the tested columns are the last ones."""
    df = len(full.beta) - len(null.beta)
    shared = dict(outcome=outcome, n=rows, lrt_pvalue=_ok(_lrt(full, null, df)[1]), diff_aic=_ok(full.aic - null.aic), converged=bool(full.converged and null.converged))
    term = lambda j, name, kind_: _row(**shared, variable=name, variable_type=kind_, **_interval(float(full.beta[j]), float(full.se[j])), beta_pvalue=_ok(full.p(j)))
    if df == 1:
        return [term(len(null.beta), variable, kind)]
    out = [_row(**shared, variable=variable, variable_type=kind)]
    return out + [term(len(null.beta) + j, f"{variable}_{v}", f"{kind}_dummy") for j, v in enumerate(levels)] if report else out


def _sized(rows: int, min_n: int, columns: int) -> None:
    if rows < min_n or rows < columns + 1:
        raise ValueError(f"{rows} complete rows are too few")


def _linear_fits(pdf: pd.DataFrame, maps: list[np.ndarray], small: int, width: int) -> tuple[Fit, Fit]:
    """Both least-squares fits of a test from its cells' sums."""
    xx, xy = combined(pdf, maps, width)
    yy, n, fits = float(pdf["yy"].sum()), xx[0, 0], []
    scale = np.sqrt(np.diag(xx))
    if (scale <= 0).any() or np.linalg.cond(xx / np.outer(scale, scale)) > 1e13:
        raise ValueError("the design matrix is singular")
    for size in (len(xx), small):
        d = np.outer(scale[:size], scale[:size])
        inv = np.linalg.inv(xx[:size, :size] / d) / d
        beta = inv @ xy[:size]
        rss = max(0.0, float(yy - beta @ xy[:size]))
        if n <= size:
            raise ValueError("no degrees of freedom are left")
        fits.append(Fit(beta, inv * rss / (n - size), _gaussian_llf(rss, n), n))
    return fits[0], fits[1]


def _kind(pdf: pd.DataFrame, numeric: bool, levels: list[str]) -> str:
    """binary, continuous or categorical; a variable that doesn't vary is an error. A number is binary if nothing lies between its ends."""
    if not numeric:
        if not levels:
            raise ValueError("the variable doesn't vary")
        return "binary" if len(levels) == 1 else "categorical"
    lo, hi = pdf["lo"].min(), pdf["hi"].max()
    if not lo < hi:
        raise ValueError("the variable doesn't vary")
    n, sx, sxx = (float(pdf[c].sum()) for c in ("rows", "sx", "sxx"))
    between = (lo + hi) * sx - sxx - n * lo * hi  # the sum of (x - lo) (hi - x)
    return "binary" if between <= 1e-9 * n * (hi - lo) ** 2 + 1e-12 * n * max(abs(lo), abs(hi)) ** 2 else "continuous"


def sums_of_products(rows: DataFrame, keys: list[str], z: list[Column], weight: Column | None = None) -> DataFrame:
    """keys, rows, m: the upper triangle of the weighted sums of z z', by one aggregate that combines map-side."""
    w = weight if weight is not None else F.lit(1.0)
    cells = [F.sum(w * a * b) for i, a in enumerate(z) for b in z[i:]]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.array(*cells).alias("m"))


def association_study(phen: Phenotypes, outcomes: list[str] | None = None, regression_variables: list[str] | None = None, *, geno: Genotypes | None = None, covariates: list[str] | None = None, family: str | dict | None = None, regression_kind: str | Callable = "auto", encoding: str = "additive", edge_encoding_info: DataFrame | None = None, use_survey: bool = False, min_n: int = MIN_N, standardize_data: bool = False, report_categorical_betas: bool = False) -> RegressionResults:
    """Every outcome against every regressor (exposures by default, or all variants), adjusted for the covariates.

    Rows need the outcome, the covariates and the regressor (and the weight and cluster of a survey design).
    """
    outcomes = list(outcomes or phen.outcomes)
    covariates = list(phen.covariates if covariates is None else covariates)
    if not outcomes:
        raise ValueError("no outcome")
    if use_survey and not phen.weights:
        raise ValueError("a survey design needs a weights column")
    if use_survey and phen.strata:
        warnings.warn("strata don't enter the variance: weights and clusters alone do", UserWarning, stacklevel=2)
    engine = resolve_engine(regression_kind)
    df = phen.df
    if bad := [c for c in covariates if not is_numeric(df, c)]:
        raise ValueError(f"covariates must be numeric: {bad}")
    fam = family if isinstance(family, dict) else dict.fromkeys(outcomes, family) if family else infer_family(df, outcomes)
    w = number(df, phen.weights) if use_survey else F.lit(None).cast("double")
    cl = F.col(f"`{phen.cluster}`").cast("string") if use_survey and phen.cluster else F.lit(None).cast("string")
    base = df.select(F.col(f"`{phen.sample_id}`").cast("string").alias("sid"), _vector(df, covariates).alias("cov"), w.alias("w"), cl.alias("cl"), F.array(*[F.struct(F.lit(o).alias("outcome"), F.lit(fam[o]).alias("family"), F.col(f"`{o}`").cast("double").alias("y")) for o in outcomes]).alias("o"), *([] if geno else [F.array(*[F.struct(F.lit(v).alias("variable"), F.col(f"`{v}`").cast("string").alias("x")) for v in (regression_variables or phen.exposures)]).alias("v")]))
    numeric = geno is not None or all(is_numeric(df, v) for v in (regression_variables or phen.exposures))
    complete = F.forall("cov", lambda c: c.isNotNull())
    if use_survey:
        complete = complete & F.col("w").isNotNull() & (F.col("cl").isNotNull() if phen.cluster else F.lit(True))
    base = base.where(complete)
    k_cov = len(covariates)
    if geno is None:
        if not (regression_variables or phen.exposures):
            raise ValueError("no regression variables")
        long = base.select("cov", "w", "cl", F.explode("o").alias("o"), "v").select("cov", "w", "cl", "o.*", F.inline("v"))
    else:
        if encoding == "codominant":
            calls = encode(geno, encoding).select(F.col("sample_id").cast("string").alias("sid"), F.col("variant_id").alias("variable"), F.when(F.col("het").isNotNull(), F.when(F.col("het") == 1, "b_het").when(F.col("hom_alt") == 1, "c_hom_alt").otherwise("a_hom_ref")).alias("x"))
            numeric = False
        else:
            calls = encode(geno, encoding, edge_encoding_info).select(F.col("sample_id").cast("string").alias("sid"), F.col("variant_id").cast("string").alias("variable"), F.col("x").cast("string").alias("x"))
        if regression_variables:
            calls = calls.where(F.col("variable").isin(list(regression_variables)))
        long = calls.join(broadcast_if_small(base, 2_000_000 // (k_cov + len(outcomes) + 4)), "sid").select("cov", "w", "cl", F.inline("o"), "variable", "x")
    # NaN as missing, as everywhere
    long = long.where(F.col("y").isNotNull() & ~F.isnan("y")).withColumn("x", F.when(F.col("x") != "NaN", F.col("x")))
    k = len(covariates)
    names = [c.split()[0] for c in ASSOCIATION.split(", ")]
    variables = list(regression_variables or phen.exposures)
    numbers = dict.fromkeys(variables, numeric) if geno is not None else numeric_texts(df, variables)
    by_cells = engine is fit_glm and not standardize_data and not (use_survey and phen.cluster)
    small = base.limit(LOCAL_ROWS + 1).count() <= LOCAL_ROWS
    cells_of = [o for o in outcomes if by_cells and (fam[o] == "linear" or not small)]
    parts = []
    if cells_of:
        is_number = F.lit(numeric) if geno is not None else F.col("variable").isin([v for v, n in numbers.items() if n])
        x = F.when(is_number, F.col("x").try_cast("double")).otherwise(0.0)
        u = F.concat(F.array(F.lit(1.0)), F.col("cov"), F.array(x, F.lit(0.0), F.lit(0.0)))
        rows = long.where(F.col("outcome").isin(cells_of) & F.col("x").isNotNull())
        rows = rows.select("outcome", "variable", "y", "w", u.alias("u"), cell_key(is_number, F.col("x")).alias("a"), F.lit("").alias("b"))
        of = lambda variable: numbers.get(variable, numeric)
        parts += _association_cells(rows, [o for o in cells_of if fam[o] == "linear"], [o for o in cells_of if fam[o] != "linear"], k, of, min_n, use_survey, report_categorical_betas, names)
        tests = long.where(F.col("outcome").isin(cells_of)).groupBy("outcome", "variable").agg(F.count("x").alias("n")).where("n = 0")
        parts.append(tests.select(*[F.col(c) if c in ("outcome", "variable", "n") else F.lit("ValueError: no complete rows").alias(c) if c == "error" else F.lit(False).alias(c) if c == "converged" else F.lit(None).alias(c) for c in names]))
    if rest := [o for o in outcomes if o not in cells_of]:
        fit = lambda pdf: _fit_group(pdf, k, min_n, engine, standardize_data, report_categorical_betas)[names]
        parts.append(long.where(F.col("outcome").isin(rest)).groupBy("outcome", "variable").applyInPandas(fit, ASSOCIATION))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return RegressionResults(out, {"family": fam, "covariates": covariates, "min_n": min_n, "use_survey": use_survey})


def numeric_texts(df: DataFrame, cols: list[str]) -> dict[str, bool]:
    """For each column whether all its values are numbers, written as such or as texts."""
    texts = [c for c in cols if not is_numeric(df, c)]
    value = lambda c: F.col(f"`{c}`").cast("string")
    row = df.agg(*[F.count_if(value(c).isNotNull() & value(c).try_cast("double").isNull()) for c in texts]).first() if texts else ()
    return {c: True for c in cols} | {c: n == 0 for c, n in zip(texts, row, strict=True)}


def _association_cells(rows: DataFrame, linear: list[str], logistic_: list[str], k: int, is_number: Callable[[str], bool], min_n: int, weighted: bool, report: bool, names: list[str]) -> list[DataFrame]:
    """Results of tests from sums over cells, never from a test's rows in one place."""
    width, out = k + 4, []

    def plan(pdf: pd.DataFrame) -> tuple:
        cells = cells_of_keys(pdf)
        maps, small, levels = design(cells, k, is_number(pdf["variable"].iloc[0]))
        kind = _kind(pdf, is_number(pdf["variable"].iloc[0]), levels[0])
        _sized(int(pdf["rows"].sum()), min_n, len(maps[0]))
        return maps, small, levels[0], kind

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        outcome, variable, n = pdf["outcome"].iloc[0], pdf["variable"].iloc[0], int(pdf["rows"].sum())
        try:
            maps, small, levels, kind = plan(pdf)
            found = _association_rows(outcome, variable, n, kind, levels, *_linear_fits(pdf, maps, small, width), report)
        except Exception as e:  # noqa: BLE001
            found = [_row(outcome=outcome, variable=variable, n=n, error=f"{type(e).__name__}: {e}")]
        return pd.DataFrame(found, columns=names)

    if linear:
        sums = linear_sums(rows.where(F.col("outcome").isin(linear)), ["outcome", "variable"], width, weighted)
        out.append(sums.groupBy("outcome", "variable").applyInPandas(solve, ASSOCIATION))
    if logistic_:
        mine = rows.where(F.col("outcome").isin(logistic_))
        fits = logistic(mine, "outcome string, variable string", width, lambda key, cells: design(cells, k, is_number(key["variable"]))[:2], weighted=weighted)
        sums = linear_sums(mine, ["outcome", "variable"], width, weighted)

        def finish(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            outcome, variable, n = left["outcome"].iloc[0], left["variable"].iloc[0], int(left["rows"].sum())
            try:
                _, _, levels, kind = plan(left)
                found = _association_rows(outcome, variable, n, kind, levels, *_settled(right), report)
            except Exception as e:  # noqa: BLE001
                found = [_row(outcome=outcome, variable=variable, n=n, error=str(e) if isinstance(e, _Failed) else f"{type(e).__name__}: {e}")]
            return pd.DataFrame(found, columns=names)

        keys = ["outcome", "variable"]
        out.append(sums.groupBy(*keys).cogroup(fits.groupBy(*keys)).applyInPandas(finish, ASSOCIATION))
    return out


class _Failed(Exception):
    """What a distributed fit says has gone wrong."""


def _settled(fits: pd.DataFrame) -> tuple[Fit, Fit]:
    """The full and the null fit from the rows of cells.logistic."""
    out = []
    for model in ("full", "null"):
        r = fits[fits["model"] == model].iloc[0]
        if r["status"] not in ("done", "unsettled"):
            raise _Failed(r["status"])
        beta = np.asarray(r["beta"], float)
        out.append(Fit(beta, np.asarray(r["cov"], float).reshape(len(beta), -1), float(r["ll"]), float(r["n"]), r["status"] == "done"))
    return out[0], out[1]


def ewas(phen: Phenotypes, outcome: str, exposures: list[str] | None = None, covariates: list[str] | None = None, **options) -> RegressionResults:
    """One outcome against all exposures, in the older schema."""
    r = association_study(phen, [outcome], exposures, covariates=covariates, min_n=options.pop("min_n", 1), **options)
    return RegressionResults(r.df.select("variable", "n", "beta", "se", "ci_low", "ci_high", F.col("beta_pvalue").alias("p_value")), r.metadata)


def gwas(geno: Genotypes, phen: Phenotypes, outcome: str, covariates: list[str] | None = None, family: str | None = None) -> RegressionResults:
    """Every variant's dosage against a numeric outcome by least squares with a t-test; n is the number of aligned samples.

    The family is inferred unless given: a yes-or-no outcome asks for a logistic model, which there is none of here.

    Samples need the outcome and the covariates. A variant is fitted on its called samples, so a missing
    call doesn't cost the variant. Sums of products are all that leaves the calls.
    """
    covariates = list(phen.covariates if covariates is None else covariates)
    df = phen.df
    if missing := [c for c in (outcome, *covariates) if c not in df.columns]:
        raise ValueError(f"columns not in the table: {missing}")
    family = family or infer_family(df, [outcome])[outcome]
    if family not in ("linear", "logistic"):
        raise ValueError(f"unknown family {family!r}")
    if family == "logistic":
        raise NotImplementedError("genome-wide studies are linear; association_study fits logistic models")
    rows = df.select(F.col(f"`{phen.sample_id}`").cast("string").alias("sid"), _vector(df, covariates).alias("cov"), number(df, outcome).alias("y")).where(F.col("y").isNotNull() & F.forall("cov", lambda c: c.isNotNull()))
    rows = rows.join(geno.calls.select(F.col("sample_id").cast("string").alias("sid")).distinct(), "sid", "left_semi")
    n, k = rows.count(), len(covariates)
    if n < k + 3:
        raise ValueError(f"{n} aligned samples are too few")
    calls = geno.calls.select("variant_idx", F.col("sample_id").cast("string").alias("sid"), dosage(F.col("gt")).alias("g")).where("g is not null")
    z = [F.lit(1.0), *[F.col("cov")[j] for j in range(k)], F.col("g"), F.col("y")]
    sums = sums_of_products(calls.join(F.broadcast(rows) if n * (k + 4) <= 8_000_000 else rows, "sid"), ["variant_idx"], z)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                m = np.zeros((k + 3, k + 3))
                m[np.triu_indices(k + 3)] = r.m
                m = m + np.triu(m, 1).T
                xx, xy = m[: k + 2, : k + 2], m[: k + 2, k + 2]
                b = s = p = math.nan
                # what the covariates leave of the dosage decides whether it can be fitted
                left = xx[k + 1, k + 1] - xx[k + 1, : k + 1] @ np.linalg.lstsq(xx[: k + 1, : k + 1], xx[: k + 1, k + 1], rcond=None)[0]
                dof = m[0, 0] - k - 2
                if left > 1e-9 * max(1.0, xx[k + 1, k + 1]) and dof > 0:
                    beta = np.linalg.solve(xx, xy)
                    b = float(beta[-1])
                    s = math.sqrt(max(0.0, (m[-1, -1] - beta @ xy)) / dof / left)
                    p = t_two_sided(b / s, dof) if s > 0 else math.nan
                out.append((r.variable, n, _ok(b), _ok(s), _ok(b - 1.96 * s), _ok(b + 1.96 * s), _ok(p)))
            yield pd.DataFrame(out, columns=["variable", "n", "beta", "se", "ci_low", "ci_high", "p_value"])

    named = geno.variants.select("variant_idx", F.col("variant_id").cast("string").alias("variable")).join(sums, "variant_idx", "left")
    named = named.withColumn("m", F.coalesce("m", F.array_repeat(F.lit(0.0), (k + 3) * (k + 4) // 2)))
    out = named.select("variable", "m").mapInPandas(solve, "variable string, n long, beta double, se double, ci_low double, ci_high double, p_value double")
    return RegressionResults(out, {"outcome": outcome, "covariates": covariates, "n_samples": n})


def lrt(phen: Phenotypes, outcome: str, full: list[str], nested: list[str], family: str | None = None) -> DataFrame:
    """Likelihood-ratio test of nested models on the rows complete for the full one: chi2, df, p_value, ll_full, ll_nested, n."""
    if not set(nested) < set(full):
        raise ValueError("nested must be a proper part of full")
    df = phen.df
    fam = family or infer_family(df, [outcome])[outcome]
    order = [*nested, *[c for c in full if c not in nested]]
    rows = df.select(F.lit(1).alias("one"), F.col(f"`{outcome}`").cast("double").alias("y"), _vector(df, order).alias("x")).where(F.col("y").isNotNull() & F.forall("x", lambda c: c.isNotNull()))
    schema = "chi2 double, df long, p_value double, ll_full double, ll_nested double, n long"
    k0, k = len(nested), len(order)

    def check(n: int, chi2: float) -> None:
        if n < k + 3:
            raise ValueError(f"{n} complete rows are too few")
        if chi2 < 0:
            raise ValueError("the larger model fits worse")

    if fam == "linear":
        z = [F.lit(1.0), *[F.col("x")[j] for j in range(k)], F.col("y")]

        def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    m = np.zeros((k + 2, k + 2))
                    m[np.triu_indices(k + 2)] = r.m
                    m = m + np.triu(m, 1).T
                    rss = lambda q: float(m[-1, -1] - m[:q, -1] @ np.linalg.solve(m[:q, :q], m[:q, -1]))  # noqa: B023, E731
                    a, b = _gaussian_llf(rss(k + 1), m[0, 0]), _gaussian_llf(rss(k0 + 1), m[0, 0])
                    check(int(m[0, 0]), 2 * (a - b))
                    yield pd.DataFrame([(2 * (a - b), k - k0, chi2_sf(2 * (a - b), k - k0), a, b, int(m[0, 0]))], columns=["chi2", "df", "p_value", "ll_full", "ll_nested", "n"])

        return sums_of_products(rows, [], z).mapInPandas(solve, schema)

    if rows.limit(LOCAL_ROWS + 1).count() > LOCAL_ROWS:
        u = F.concat(F.array(F.lit(1.0)), F.col("x"))
        unit = np.eye(k + 1)
        fits = logistic(rows.select("one", "y", u.alias("u"), F.lit("").alias("a"), F.lit("").alias("b")), "one int", k + 1, lambda _, cells: ([unit] * len(cells), k0 + 1))

        def settle(pdf: pd.DataFrame) -> pd.DataFrame:
            a, b = _settled(pdf)
            chi2, p = _lrt(a, b, k - k0)
            check(int(a.n), chi2)
            return pd.DataFrame([(chi2, k - k0, p, a.llf, b.llf, int(a.n))], columns=["chi2", "df", "p_value", "ll_full", "ll_nested", "n"])

        return fits.groupBy("one").applyInPandas(settle, schema)

    def both(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.hstack([np.ones((len(pdf), 1)), np.array(pdf["x"].tolist(), float)])
        y = pdf["y"].to_numpy(float)
        a, b = fit_glm(y, x, fam), fit_glm(y, x[:, : k0 + 1], fam)
        chi2, p = _lrt(a, b, k - k0)
        check(len(pdf), chi2)
        return pd.DataFrame([(chi2, k - k0, p, a.llf, b.llf, len(pdf))], columns=["chi2", "df", "p_value", "ll_full", "ll_nested", "n"])

    return rows.groupBy("one").applyInPandas(both, schema)


def resolve_pairs(names: list[str], interactions: str | list[tuple[str, str]] | None, max_pairs: int) -> list[tuple[str, str]]:
    """All pairs of names, an anchor against the others, or the pairs given; too many are an error."""
    if interactions is None:
        pairs = list(itertools.combinations(names, 2))
    elif isinstance(interactions, str):
        pairs = [(interactions, n) for n in names if n != interactions]
    else:
        pairs = [tuple(p) for p in interactions]
    if not pairs:
        raise ValueError("no pairs")
    if len(pairs) > max_pairs:
        raise ValueError(f"{len(pairs)} pairs are more than max_pairs={max_pairs}")
    return pairs


def interaction_study(phen: Phenotypes, outcomes: list[str] | None = None, interactions: str | list[tuple[str, str]] | None = None, *, covariates: list[str] | None = None, family: str | dict | None = None, min_n: int = MIN_N, max_pairs: int = 1000, report_betas: bool = False) -> RegressionResults:
    """y ~ v1 + v2 + v1:v2 + covariates for each outcome and pair, by a likelihood-ratio test of the products."""
    outcomes, df = list(outcomes or phen.outcomes), phen.df
    covariates = list(phen.covariates if covariates is None else covariates)
    pairs = resolve_pairs(list(phen.exposures), interactions, max_pairs)
    fam = family if isinstance(family, dict) else dict.fromkeys(outcomes, family) if family else infer_family(df, outcomes)
    k = len(covariates)
    o = F.array(*[F.struct(F.lit(c).alias("outcome"), F.lit(fam[c]).alias("family"), F.col(f"`{c}`").cast("double").alias("y")) for c in outcomes])
    p = F.array(*[F.struct(F.lit(a).alias("term1"), F.lit(b).alias("term2"), F.col(f"`{a}`").cast("string").alias("a"), F.col(f"`{b}`").cast("string").alias("b")) for a, b in pairs])
    rows = df.select(_vector(df, covariates).alias("cov"), o.alias("o"), p.alias("p")).where(F.forall("cov", lambda c: c.isNotNull()))
    long = rows.select("cov", F.inline("o"), "p").select("cov", "outcome", "family", "y", F.inline("p")).where(F.col("y").isNotNull() & ~F.isnan("y"))
    schema = INTERACTION_TERMS if report_betas else INTERACTION
    names = [c.split()[0] for c in schema.split(", ")]
    small = rows.limit(LOCAL_ROWS + 1).count() <= LOCAL_ROWS
    by_cells = [c for c in outcomes if fam[c] == "linear" or not small]
    parts = []
    if by_cells:
        parts = _interaction_cells(long.where(F.col("outcome").isin(by_cells) & F.col("a").isNotNull() & F.col("b").isNotNull()), {c: fam[c] for c in by_cells}, k, numeric_texts(df, sorted({v for p in pairs for v in p})), min_n, names, schema, report_betas)
        empty = long.where(F.col("outcome").isin(by_cells)).groupBy("outcome", "term1", "term2").agg(F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("n")).where("n = 0")
        told = {"error": F.lit("ValueError: 0 complete rows are too few"), "converged": F.lit(False)}
        parts.append(empty.select(*[F.col(c) if c in empty.columns else told.get(c, F.lit(None)).alias(c) for c in names]))
    local = [c for c in outcomes if c not in by_cells]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        base = dict.fromkeys(names) | {"outcome": pdf["outcome"].iloc[0], "term1": pdf["term1"].iloc[0], "term2": pdf["term2"].iloc[0], "converged": False}
        try:
            pdf = pdf[pdf["a"].notna() & pdf["b"].notna()]
            base["n"] = len(pdf)
            if len(pdf) < max(min_n, 1):
                raise ValueError(f"{len(pdf)} complete rows are too few")
            a, a_names, _ = _dummies(pdf["a"], base["term1"])
            b, b_names, _ = _dummies(pdf["b"], base["term2"])
            prod = np.stack([a[:, i] * b[:, j] for i in range(a.shape[1]) for j in range(b.shape[1])], axis=1)
            terms = [f"{x}:{y}" for x in a_names for y in b_names]
            if len(pdf) < k + a.shape[1] + b.shape[1] + prod.shape[1] + 2:
                raise ValueError(f"{len(pdf)} complete rows are too few")
            cov = np.array(pdf["cov"].tolist(), float).reshape(len(pdf), k)
            main = np.hstack([np.ones((len(pdf), 1)), cov, a, b])
            y = pdf["y"].to_numpy(float)
            full, null = fit_glm(y, np.hstack([main, prod]), fam[base["outcome"]]), fit_glm(y, main, fam[base["outcome"]])
            chi2, pv = _lrt(full, null, prod.shape[1])
            base |= {"lrt_chi2": _ok(chi2), "lrt_df": prod.shape[1], "lrt_pvalue": _ok(pv), "diff_aic": _ok(full.aic - null.aic), "converged": bool(full.converged and null.converged)}
            if report_betas:
                at = main.shape[1]
                return pd.DataFrame([base | {"term": t, "term_beta": float(full.beta[at + i]), "term_se": _ok(full.se[at + i]), "term_beta_pvalue": _ok(full.p(at + i))} for i, t in enumerate(terms)], columns=names)
        except Exception as e:  # noqa: BLE001
            base |= {"n": int(len(pdf)), "error": f"{type(e).__name__}: {e}"}
        return pd.DataFrame([base], columns=names)

    if local:
        parts.append(long.where(F.col("outcome").isin(local)).groupBy("outcome", "term1", "term2").applyInPandas(fit, schema))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return RegressionResults(out, {"family": fam, "covariates": covariates})


def _interaction_cells(long: DataFrame, fam: dict[str, str], k: int, numbers: dict[str, bool], min_n: int, names: list[str], schema: str, report: bool) -> list[DataFrame]:
    """Results of pairs from sums over cells of their levels."""
    width, keys = k + 4, ["outcome", "term1", "term2"]
    number = lambda term: F.col(term).isin([v for v, n in numbers.items() if n])
    value = lambda c, term: F.when(number(term), F.col(c).try_cast("double")).otherwise(0.0)
    u = F.concat(F.array(F.lit(1.0)), F.col("cov"), F.array(value("a", "term1"), value("b", "term2"), value("a", "term1") * value("b", "term2")))
    level = lambda c, term: cell_key(number(term), F.col(c)).alias(c)
    rows = long.select(*keys, "y", u.alias("u"), level("a", "term1"), level("b", "term2"))

    def plan(one: str, two: str, cells: list) -> tuple:
        return design(cells, k, numbers[one], numbers[two])

    def answer(pdf: pd.DataFrame, fits: Callable) -> pd.DataFrame:
        n = int(pdf["rows"].sum())
        base = dict.fromkeys(names) | {c: pdf[c].iloc[0] for c in keys} | {"converged": False, "n": n}
        try:
            _sized(n, max(min_n, 1), 0)
            maps, small, levels = plan(base["term1"], base["term2"], cells_of_keys(pdf))
            _sized(n, 1, len(maps[0]))
            full, null = fits(maps, small)
            df = len(full.beta) - len(null.beta)
            chi2, p = _lrt(full, null, df)
            base |= {"lrt_chi2": _ok(chi2), "lrt_df": df, "lrt_pvalue": _ok(p), "diff_aic": _ok(full.aic - null.aic), "converged": bool(full.converged and null.converged)}
            if report:
                sides = [[t] if numbers[t] else [f"{t}_{v}" for v in lv] for t, lv in zip((base["term1"], base["term2"]), levels, strict=True)]
                terms = [f"{x}:{y}" for x in sides[0] for y in sides[1]]
                return pd.DataFrame([base | {"term": t, "term_beta": float(full.beta[small + j]), "term_se": _ok(full.se[small + j]), "term_beta_pvalue": _ok(full.p(small + j))} for j, t in enumerate(terms)], columns=names)
        except Exception as e:  # noqa: BLE001
            base |= {"error": str(e) if isinstance(e, _Failed) else f"{type(e).__name__}: {e}"}
        return pd.DataFrame([base], columns=names)

    out = []
    if linear := [c for c, f in fam.items() if f == "linear"]:
        sums = linear_sums(rows.where(F.col("outcome").isin(linear)), keys, width, False)
        out.append(sums.groupBy(*keys).applyInPandas(lambda pdf: answer(pdf, lambda maps, small: _linear_fits(pdf, maps, small, width)), schema))
    if others := [c for c, f in fam.items() if f != "linear"]:
        mine = rows.where(F.col("outcome").isin(others))
        fits = logistic(mine, "outcome string, term1 string, term2 string", width, lambda key, cells: plan(key["term1"], key["term2"], cells)[:2])
        sums = linear_sums(mine, keys, width, False)
        out.append(sums.groupBy(*keys).cogroup(fits.groupBy(*keys)).applyInPandas(lambda left, right: answer(left, lambda maps, small: _settled(right)), schema))
    return out
