"""Queries of plot data and readers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from ..operators import models as A, modify as M, plotdata as P
from ..types import RegressionResults
from . import oracle_math as O
from .domain import PHEN, PVALUES, braced, p_values, phenotypes, sql, table
from .phenotype_queries import _KINDS, _rounded

Q: dict[str, Callable] = {}
SQL: dict[str, str] = {}
_PV = f"pv AS ({PVALUES.replace('STRING', 'VARCHAR')})"


def query(oracle: str | None = None):
    def add(f: Callable) -> Callable:
        Q[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return add


_MAN = f"""WITH {_PV}, c AS (SELECT chrom, CAST(chrom AS INT) AS k, max(pos) AS mx FROM pv WHERE p_value IS NOT NULL GROUP BY ALL), g AS (SELECT greatest(1.0, max(mx) * 0.01) AS gap FROM c),
    o AS (SELECT chrom, coalesce(sum(mx + gap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM c, g)
    SELECT id, round(CAST(pos + off AS DOUBLE), 3) AS x, round(-log10(p_value), 6) AS y FROM pv JOIN o USING (chrom) WHERE p_value IS NOT NULL"""


@query(_MAN)
def p1_manhattan(spark, sf):
    return _rounded(P.manhattan(p_values(spark, sf)).select("id", F.round("x", 3).alias("x"), "y"))


@query(f"WITH {_PV} SELECT count(p_value) AS n_tests, round(0.05 / count(p_value), 9) AS cutoff, round(-log10(0.05 / count(p_value)), 6) AS y FROM pv")
def p2_cutoffs(spark, sf):
    return P.cutoffs(p_values(spark, sf)).select("n_tests", F.round("cutoff", 9).alias("cutoff"), F.round("y", 6).alias("y"))


@query(f"SELECT id, 'upper' AS panel, y FROM ({_MAN}) UNION ALL SELECT id, 'lower', -y FROM ({_MAN})")
def p3_miami(spark, sf):
    p = p_values(spark, sf)
    return _rounded(P.miami(p, p).select("id", "panel", "y"))


@query(f"WITH {_PV}, r AS (SELECT p_value, row_number() OVER (ORDER BY p_value) AS k, count(*) OVER () AS n FROM pv WHERE p_value > 0 AND p_value <= 1) SELECT k AS rank, round(-log10(p_value), 6) AS observed, round(-log10((k - 0.5) / n), 6) AS expected FROM r")
def p4_qq(spark, sf):
    return _rounded(P.qq(p_values(spark, sf)))


@query(f"WITH {_PV}, m AS (SELECT count(*) AS n, median(p_value) / 2 AS p FROM pv WHERE p_value > 0 AND p_value <= 1), {O.norm_quantiles('m', 'p', 'x', 'n', 9)} SELECT n, round(x * x / 0.4549, 6) AS lambda_gc FROM q9")
def p4_lambda_gc(spark, sf):
    return _rounded(P.lambda_gc(p_values(spark, sf)))


@query(f"""WITH {_PV}, r AS (SELECT p_value AS p, row_number() OVER (ORDER BY p_value) AS k, count(*) OVER () AS n FROM pv WHERE p_value > 0 AND p_value <= 1), f AS (SELECT * FROM r WHERE k = 1 OR k = n)
    SELECT k AS rank, round(-log10(p), 6) AS observed, round(-log10((k - 0.5) / n), 6) AS expected, round(-log10(CASE WHEN k = 1 THEN 1 - pow(0.025, 1.0 / n) ELSE pow(0.975, 1.0 / n) END), 6) AS low, round(-log10(CASE WHEN k = 1 THEN 1 - pow(0.975, 1.0 / n) ELSE pow(0.025, 1.0 / n) END), 6) AS high FROM f""")
def p4_qq_band(spark, sf):
    """The interval at both ends, where order statistics have closed forms."""
    out = P.qq(p_values(spark, sf), band=0.95)
    last = out.agg(F.max("rank")).first()[0]
    return _rounded(out.where(F.col("rank").isin(1, last)))


_CELLS = "SELECT a.n_name AS term1, b.n_name AS term2, (1 + (a.n_nationkey * 7 + b.n_nationkey * 3) % 50) / 100.0 AS lrt_pvalue FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"


@query(f"""WITH c AS ({_CELLS}), h AS (SELECT term1 AS row, term2 AS col, lrt_pvalue AS p FROM c UNION ALL SELECT term2, term1, lrt_pvalue FROM c), o AS (SELECT row AS name, row_number() OVER (ORDER BY row) - 1 AS k FROM (SELECT DISTINCT row FROM h))
    SELECT row, col, round(-log10(p), 4) AS value, p < 0.05 AS significant, a.k AS row_order, b.k AS col_order FROM h JOIN o a ON a.name = row JOIN o b ON b.name = col""")
def p5_heatmap(spark, sf):
    """Cells of pairs of nations, both ways round, in the order of names."""
    cells = sql(spark, sf, braced(_CELLS)).withColumn("lrt_pvalue", F.col("lrt_pvalue").cast("double"))
    return _rounded(P.heatmap(cells, cutoff=0.05, cluster=False), 4)


@query("SELECT CASE n_nationkey % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS half, count(*) AS n, (max(n_nationkey // 2) - min(n_nationkey // 2) + 1) = count(*) AS together FROM nation GROUP BY 1")
def p5_heatmap_clusters(spark, sf):
    """Pairs of even nations are alike, as are pairs of odd ones: the clustered order puts each half side by side."""
    n = table(spark, sf, "nation")
    a, b = n.select(F.col("n_nationkey").alias("i")), n.select(F.col("n_nationkey").alias("j"))
    same = F.col("i") % 2 == F.col("j") % 2
    cells = a.join(b, F.col("i") < F.col("j")).select(F.lpad(F.col("i").cast("string"), 2, "0").alias("term1"), F.lpad(F.col("j").cast("string"), 2, "0").alias("term2"), F.when(same, 1e-9).otherwise(0.9).alias("lrt_pvalue"))
    order = P.heatmap(cells).select(F.col("row").cast("int").alias("k"), "row_order").distinct()
    half = F.when(F.col("k") % 2 == 0, "even").otherwise("odd").alias("half")
    return order.groupBy(half).agg(F.count(F.lit(1)).alias("n"), (F.max("row_order") - F.min("row_order") + 1 == F.count(F.lit(1))).alias("together"))


@query(f"WITH {_PV} SELECT id, round(p_value, 8) AS p_value FROM pv WHERE p_value IS NOT NULL ORDER BY p_value, id LIMIT 15")
def p6_dotplot(spark, sf):
    return P.dotplot(p_values(spark, sf), p="p_value", n=15, label="id").select("id", F.round("p_value", 8).alias("p_value"))


_BINS = "WITH p AS ({phen}), e AS (SELECT min({c}) AS lo, (max({c}) - min({c})) / {n} AS w FROM p), k AS (SELECT least(floor(({c} - lo) / w), {n} - 1)::INT AS bin, count(*) AS c FROM p, e WHERE {c} IS NOT NULL GROUP BY 1) SELECT r::BIGINT AS bin, round(lo + r * w, 4) AS \"left\", round(lo + (r + 1) * w, 4) AS \"right\", coalesce(c, 0) AS \"count\" FROM e, range({n}) t(r) LEFT JOIN k ON bin = r"


@query(_BINS.format(phen=PHEN, c="acctbal", n=30))
def p7_distribution(spark, sf):
    return _rounded(P.distribution(phenotypes(spark, sf), "acctbal"), 4)


@query(f"WITH p AS ({PHEN}) SELECT segment AS level, count(*) AS \"count\" FROM p GROUP BY 1")
def p7_levels(spark, sf):
    return P.distribution(phenotypes(spark, sf), "segment")


@query(f"SELECT id, x, y FROM ({_MAN})")
def p8_from_results(spark, sf):
    kind, df = P.from_results(RegressionResults(p_values(spark, sf)))
    return _rounded(df.select("id", F.round("x", 3).alias("x"), "y"))


@query(f"""WITH p AS ({PHEN}), k AS ({_KINDS}), o AS (SELECT col_, CASE WHEN u = 2 THEN 'binary' WHEN num THEN 'continuous' ELSE 'categorical' END AS kind FROM k),
    r AS (SELECT *, row_number() OVER (ORDER BY CASE kind WHEN 'continuous' THEN 0 WHEN 'binary' THEN 1 ELSE 2 END, col_) - 1 AS r FROM o) SELECT col_ AS "column", kind, r // 4 AS page, r % 4 AS slot FROM r""")
def p9_from_describe(spark, sf):
    return _rounded(P.from_describe(phenotypes(spark, sf), 4))


_COUNTED = "SELECT '{state}' AS state, r::BIGINT AS bin, round(lo + r * w, 4) AS \"left\", round(lo + (r + 1) * w, 4) AS \"right\", (SELECT count(*) FROM {rows} WHERE least(floor((x - lo) / w), 29) = r) AS \"count\" FROM e, (SELECT unnest(range(30)) AS r)"


@query(f"""WITH p AS ({PHEN}), q AS (SELECT quantile_cont(total_price, 0.25) AS a, quantile_cont(total_price, 0.75) AS b FROM p), before AS (SELECT total_price AS x FROM p), after AS (SELECT total_price AS x FROM p, q WHERE total_price BETWEEN a - 0.5 * (b - a) AND b + 0.5 * (b - a)),
    e AS (SELECT min(x) AS lo, (max(x) - min(x)) / 30 AS w FROM before) {_COUNTED.format(state='before', rows='before')} UNION ALL {_COUNTED.format(state='after', rows='after')}""")
def p10_from_modify(spark, sf):
    p = phenotypes(spark, sf)
    return _rounded(P.from_modify(p, M.remove_outliers(p, ["total_price"], k=0.5), "total_price"), 4)


_LRT = f"(2 * ({O.gaussian_ll('rss', 'n')} - {O.gaussian_ll('rss0', 'n')}))"


@query(f"""WITH p AS ({PHEN}), {O.least_squares('f', '(SELECT * FROM p WHERE exposure IS NOT NULL)', 'total_price', ['acctbal', 'exposure', 'acctbal * exposure'], 2)}, v AS (SELECT round(-log10({O.chi2_sf(_LRT, 1)}), 4) AS value FROM f)
    SELECT 'acctbal' AS row, 'exposure' AS col, value, false AS significant, 0::BIGINT AS row_order, 1::BIGINT AS col_order FROM v UNION ALL SELECT 'exposure', 'acctbal', value, false, 1, 0 FROM v""")
def p11_from_interaction(spark, sf):
    kind, df = P.from_interaction(A.interaction_study(phenotypes(spark, sf), ["total_price"], covariates=[], min_n=20))
    return _rounded(df.where(F.lit(kind == "heatmap")), 4)
