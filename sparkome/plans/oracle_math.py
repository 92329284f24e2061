"""SQL expressions of distribution functions and least squares, for the queries' oracles. Terms of series are written as lists that DuckDB adds up."""

from __future__ import annotations


def erf(x: str, terms: int = 200) -> str:
    """2 / sqrt(pi) exp(-x^2) sum 2^n x^(2n+1) / (2n+1)!!, whose terms are all positive, for x >= 0."""
    term = f"exp(-({x}) * ({x}) + (2 * i_ + 1) * ln({x}) - lgamma(i_ + 1.5))"
    return f"CASE WHEN ({x}) <= 0 THEN 0.0 WHEN ({x}) > 10 THEN 1.0 ELSE list_sum(list_transform(range({terms}), lambda i_: {term})) END"


def norm_two_sided(z: str) -> str:
    return f"(1 - {erf(f'(abs({z}) / sqrt(2.0))')})"


def norm_cdf(z: str) -> str:
    return f"(0.5 + 0.5 * sign({z}) * {erf(f'(abs({z}) / sqrt(2.0))')})"


def norm_quantiles(source: str, p: str, out: str, keep: str, steps: int = 7) -> str:
    """CTEs q0 .. q<steps> over `source` that refine `out`, the normal quantile of column p, by Halley's steps from a logistic start."""
    parts = [f"q0 AS (SELECT {keep}, {p}, sqrt(3.141592653589793 / 8) * ln({p} / (1 - {p})) AS {out} FROM {source})"]
    for k in range(1, steps + 1):
        step = f"(({norm_cdf(out)} - {p}) * sqrt(2 * pi()) * exp({out} * {out} / 2))"
        parts.append(f"q{k} AS (SELECT {keep}, {p}, {out} - e / (1 + {out} * e / 2) AS {out} FROM (SELECT *, {step} AS e FROM q{k - 1}))")
    return ", ".join(parts)


def t_two_sided(t: str, df: str, most: int = 4000) -> str:
    """The closed form for a whole number of degrees of freedom: powers of the cosine of atan(t / sqrt(df))."""
    c = f"(1 / sqrt(1 + ({t}) * ({t}) / ({df})))"
    angle = f"atan(abs({t}) / sqrt({df}))"
    even = f"sin({angle}) * list_sum(list_transform(range(({df} // 2)::BIGINT), lambda k_: exp(lgamma(k_ + 0.5) - lgamma(k_ + 1) - 0.5 * ln(pi()) + 2 * k_ * ln({c}))))"
    odd = f"2 / pi() * ({angle} + sin({angle}) * coalesce(list_sum(list_transform(range((({df} - 1) // 2)::BIGINT), lambda k_: exp(lgamma(k_ + 1) - lgamma(k_ + 1.5) + 0.5 * ln(pi()) - ln(2.0) + (2 * k_ + 1) * ln({c})))), 0))"
    return f"(1 - CASE WHEN {df} % 2 = 0 THEN {even} ELSE {odd} END)"


def chi2_sf(x: str, df: int) -> str:
    if df % 2 == 0:
        return f"(exp(-({x}) / 2) * list_sum(list_transform(range({df // 2}), lambda k_: exp(k_ * ln(greatest({x}, 1e-300) / 2) - lgamma(k_ + 1)))))"
    tail = f"1 - {erf(f'sqrt(({x}) / 2)')}"
    more = f"coalesce(list_sum(list_transform(range({df // 2}), lambda k_: exp(-({x}) / 2 + (k_ + 0.5) * ln(greatest({x}, 1e-300) / 2) - lgamma(k_ + 1.5)))), 0)"
    return f"({tail} + {more})"


def least_squares(name: str, source: str, y: str, xs: list[str], keep: int, by: str | None = None) -> str:
    """CTEs ending in `name`: n, rss of y on a constant and the first `keep` of xs, rss on all, the last x's slope and what of it the others leave.

    Columns are made orthogonal one after the other, so that each step needs just the sums of the step before. With `by`, for each of its values.
    """
    g = f"{by}, " if by else ""
    over = f"OVER (PARTITION BY {by})" if by else "OVER ()"
    cols = [f"c{k}" for k in range(len(xs))]
    now = [*cols, "yy"]
    parts = [f"{name}_0 AS (SELECT {g}" + ", ".join(f"({x})::DOUBLE AS {c}" for x, c in zip(xs, cols, strict=True)) + f", ({y})::DOUBLE AS yy FROM {source})"]
    parts.append(f"{name}_m AS (SELECT {g}" + ", ".join(f"{c} - avg({c}) {over} AS {c}" for c in now) + f" FROM {name}_0)")
    last, kept = f"{name}_m", False
    for k, c in enumerate(cols):
        if k == keep:
            parts.append(f"{name}_keep AS (SELECT *, yy AS y_part FROM {last})")
            last, kept = f"{name}_keep", True
        scale = f"nullif(sum({c} * {c}) {over}, 0)"
        moved = ", ".join(f"{d} - {c} * coalesce(sum({c} * {d}) {over} / {scale}, 0) AS {d}" for d in now[k + 1 :])
        parts.append(f"{name}_{k + 1} AS (SELECT {g}{', '.join(cols[: k + 1])}, {moved}, sum({c} * yy) {over} / {scale} AS slope{', y_part' if kept else ''} FROM {last})")
        last = f"{name}_{k + 1}"
    part = "y_part" if keep < len(cols) else "yy"
    parts.append(f"{name} AS (SELECT {g}count(*) AS n, sum({part} * {part}) AS rss0, sum(yy * yy) AS rss, max(slope) AS slope, sum({cols[-1]} * {cols[-1]}) AS left_over FROM {last}" + (f" GROUP BY {by})" if by else ")"))
    return ", ".join(parts)


def gaussian_ll(rss: str, n: str) -> str:
    return f"(-{n} / 2.0 * (ln(2 * pi() * {rss} / {n}) + 1))"
