"""Queries of phenotype, genotype and result operators, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..operators import describe as D, genotypes as G, models as A, modify as M, results as R
from ..types import RegressionResults
from . import oracle_math as O
from .domain import CALLS, PHEN, PVALUES, VARIANTS, genotypes, p_values, phenotypes

Q: dict[str, Callable] = {}
SQL: dict[str, str] = {}
NUM = ("acctbal", "n_orders", "total_price", "exposure", "nation", "rich", "weight")
P = f"p AS ({PHEN})"


def query(oracle: str | None = None):
    def add(f: Callable) -> Callable:
        Q[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return add


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floating columns rounded, so that the order of summation doesn't show."""
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if t in ("double", "float") else F.col(f"`{c}`").cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(f"`{c}`") for c, t in df.dtypes])


def _r(x: str, name: str, digits: int = 6) -> str:
    return f"round(CAST({x} AS DOUBLE), {digits}) AS {name}"


def _summary_sql(cols: list[str], by: str | None = None) -> str:
    parts = []
    g = f"{by}, " if by else ""
    for c in cols:
        num = c in NUM
        x = f"CAST({c} AS DOUBLE)" if num else "CAST(NULL AS DOUBLE)"
        parts.append(f"SELECT {g}'{c}' AS col_, {str(num).lower()} AS num, CAST({c} AS VARCHAR) AS value, {x} AS x FROM p" + (f" WHERE {by} IS NOT NULL" if by else ""))
    k = f"{g}col_"
    return f"""WITH {P}, l AS ({' UNION ALL '.join(parts)}),
        s AS (SELECT {k}, bool_or(num) AS num, count(*) AS n, count(*) FILTER (value IS NULL) AS n_missing, count(DISTINCT value) AS u, avg(x) AS mean, stddev_samp(x) AS std,
              min(x) AS mn, max(x) AS mx, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3, count(x) AS c FROM l GROUP BY ALL),
        o AS (SELECT {', '.join(f'l.{y.strip()}' for y in k.split(','))}, count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS n_out FROM l JOIN s USING ({k}) WHERE x IS NOT NULL GROUP BY ALL),
        m AS (SELECT * FROM (SELECT {k}, value, count(*) AS vc, row_number() OVER (PARTITION BY {k} ORDER BY count(*) DESC, value) AS rn FROM l WHERE value IS NOT NULL GROUP BY {k}, value) WHERE rn = 1)
        SELECT {g}col_ AS "column", CASE WHEN u = 2 THEN 'binary' WHEN num THEN 'continuous' ELSE 'categorical' END AS kind, n, n_missing, round_even(100.0 * n_missing / n, 2)::DOUBLE AS missing_pct, u AS n_unique,
            {_r('mean', 'mean')}, {_r('std', 'std')}, {_r('mn', '"min"')}, {_r('q1', 'q25')}, {_r('q2', 'median')}, {_r('q3', 'q75')}, {_r('mx', '"max"')},
            CASE WHEN NOT num THEN m.value END AS mode, CASE WHEN NOT num THEN vc END AS mode_count,
            CASE WHEN u <= 1 THEN true WHEN NOT num OR std IS NULL THEN false WHEN std = 0 THEN true WHEN mean = 0 THEN std < 1e-9 ELSE abs(std / mean) < 1e-3 END AS near_zero_var,
            CASE WHEN c = 0 THEN NULL WHEN c < 4 THEN NULL WHEN q3 <= q1 THEN 0 ELSE n_out END::BIGINT AS n_outliers
        FROM s LEFT JOIN o USING ({k}) LEFT JOIN m USING ({k})"""


COLS = ["acctbal", "n_orders", "total_price", "exposure", "segment", "nation", "rich"]


@query(_summary_sql(COLS))
def d1_summarize(spark, sf):
    return _rounded(D.summarize(phenotypes(spark, sf), COLS).drop("dtype"))


@query(_summary_sql([c for c in COLS if c != "segment"], "segment"))
def d8_summarize_by(spark, sf):
    return _rounded(D.summarize_by(phenotypes(spark, sf), "segment", [c for c in COLS if c != "segment"]).drop("dtype"))


@query(f"""WITH {P}, w AS (SELECT exposure AS x, weight AS w FROM p WHERE exposure IS NOT NULL), m AS (SELECT sum(w * x) / sum(w) AS mean FROM w)
    SELECT 'exposure' AS "column", {_r('max(mean)', 'mean')}, {_r('sqrt(sum(w * (x - mean) * (x - mean)) / sum(w))', 'std')}, {_r('min(x)', '"min"')}, {_r('max(x)', '"max"')} FROM w, m""")
def d2_weighted_summary(spark, sf):
    return _rounded(D.summarize(phenotypes(spark, sf), ["exposure"], weighted=True).select("column", "mean", "std", "min", "max"))


@query(f"""WITH {P} SELECT col_ AS "column", nm AS n_missing, round_even(100.0 * nm / n, 2)::DOUBLE AS missing_pct FROM (
    {' UNION ALL '.join(f"SELECT '{c}' AS col_, count(*) FILTER ({c} IS NULL) AS nm, count(*) AS n FROM p" for c in ['sample_id', *COLS, 'weight'])})""")
def d3_missing_report(spark, sf):
    return D.missing_report(phenotypes(spark, sf))


_PAIRS = [(a, b) for i, a in enumerate(("acctbal", "n_orders", "total_price", "exposure")) for b in ("acctbal", "n_orders", "total_price", "exposure")[i + 1 :]]
_CORR = f"WITH {P} " + " UNION ALL ".join(f"SELECT '{a}' AS var1, '{b}' AS var2, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, round(corr({a}, {b}), 6) AS score FROM p" for a, b in _PAIRS)


@query(_CORR)
def d4_correlation_pearson(spark, sf):
    return _rounded(D.correlations(phenotypes(spark, sf), ["acctbal", "n_orders", "total_price", "exposure"]))


def _spearman(a: str, b: str) -> str:
    rank = lambda x: f"rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0"
    return f"SELECT '{a}' AS var1, '{b}' AS var2, count(*) AS n, round(corr(ra, rb), 6) AS score FROM (SELECT {rank(a)} AS ra, {rank(b)} AS rb FROM p WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"


@query(f"WITH {P} " + " UNION ALL ".join(_spearman(a, b) for a, b in _PAIRS))
def d4_correlation_spearman(spark, sf):
    return _rounded(D.correlations(phenotypes(spark, sf), ["acctbal", "n_orders", "total_price", "exposure"], "spearman"))


def _kendall(a: str, b: str) -> str:
    pairs = f"(SELECT count(*) AS t, sum(sign(l.x - r.x) * sign(l.y - r.y)) AS s, sum((l.x = r.x)::INT) AS tx, sum((l.y = r.y)::INT) AS ty FROM v l JOIN v r ON l.k < r.k)"
    rows = f"WITH v AS (SELECT {a} AS x, {b} AS y, sample_id AS k FROM p WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
    return f"SELECT '{a}' AS var1, '{b}' AS var2, (SELECT count(*) FROM p WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n, (SELECT score FROM ({rows} SELECT round(s / sqrt((t - tx)::DOUBLE) / sqrt((t - ty)::DOUBLE), 6) AS score FROM {pairs})) AS score"


@query(f"WITH {P} " + " UNION ALL ".join(_kendall(a, b) for a, b in (("acctbal", "n_orders"), ("acctbal", "exposure"), ("n_orders", "exposure"))))
def d4_correlation_kendall(spark, sf):
    return _rounded(D.correlations(phenotypes(spark, sf), ["acctbal", "n_orders", "exposure"], "kendall"))


@query(f"SELECT var1, var2, score FROM ({_CORR}) WHERE abs(score) >= 0.3")
def d5_correlation_pairs(spark, sf):
    return _rounded(D.correlation_pairs(phenotypes(spark, sf), ["acctbal", "n_orders", "total_price", "exposure"], threshold=0.3))


@query(f"""WITH {P}, c AS (SELECT segment AS var1, CAST(rich AS VARCHAR) AS var2, count(*) AS c FROM p GROUP BY ALL)
    SELECT coalesce(var1, 'All') AS var1, coalesce(var2, 'All') AS var2, sum(c)::BIGINT AS "count" FROM c GROUP BY CUBE (var1, var2)""")
def d6_crosstab(spark, sf):
    return D.crosstab(phenotypes(spark, sf), "segment", "rich", margins=True)


@query(f"""WITH {P}, l AS (SELECT 'segment' AS col_, segment AS value FROM p UNION ALL SELECT 'nation', CAST(nation AS VARCHAR) FROM p), c AS (SELECT col_, value, count(*) AS c FROM l GROUP BY ALL)
    SELECT "column", value, "count", pct FROM (SELECT col_ AS "column", value, c AS "count", round_even(100.0 * c / sum(c) OVER (PARTITION BY col_), 2)::DOUBLE AS pct, row_number() OVER (PARTITION BY col_ ORDER BY c DESC, value NULLS LAST) AS r FROM c) WHERE r <= 10""")
def d7_value_counts(spark, sf):
    return D.value_counts(phenotypes(spark, sf), ["segment", "nation"], top=10)


_KINDS = " UNION ALL ".join(f"SELECT '{c}' AS col_, {str(c in NUM).lower()} AS num, count(DISTINCT {c}) AS u, count(*) FILTER ({c} IS NULL) AS nm, count(*) AS n FROM p" for c in ("acctbal", "n_orders", "total_price", "exposure", "segment", "nation", "rich", "weight"))


@query(f"""WITH {P}, k AS (SELECT *, CASE WHEN u = 2 THEN 'binary' WHEN num THEN 'continuous' ELSE 'categorical' END AS kind FROM ({_KINDS}))
    SELECT max(n) AS n_samples, 9::BIGINT AS n_columns, count(*) FILTER (kind = 'binary') AS n_binary, count(*) FILTER (kind = 'categorical') AS n_categorical, count(*) FILTER (kind = 'continuous') AS n_continuous,
      count(*) FILTER (nm > 0) AS n_with_missing, round_even(100.0 * sum(nm) / sum(n), 2)::DOUBLE AS total_missing_pct, 1::BIGINT AS n_outcomes, 1::BIGINT AS n_covariates, 2::BIGINT AS n_exposures, true AS has_survey_design FROM k""")
def d9_dataset_summary(spark, sf):
    return D.dataset_summary(phenotypes(spark, sf))


@query(f"""WITH {P}, l AS (SELECT 'acctbal' AS col_, acctbal AS x FROM p UNION ALL SELECT 'n_orders', n_orders FROM p), m AS (SELECT col_, avg(x) AS mu FROM l GROUP BY 1),
    g AS (SELECT col_, count(*)::BIGINT AS n, avg(pow(x - mu, 3)) / pow(avg(pow(x - mu, 2)), 1.5) AS g FROM l JOIN m USING (col_) GROUP BY 1)
    SELECT "column", n, skew, round(z, 6) AS zscore, round(""" + O.norm_two_sided("z") + f""", 8) AS pvalue FROM (SELECT col_ AS "column", n, round(g, 6) AS skew, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(ln(sqrt(w2))) AS z FROM (
      SELECT *, g * sqrt((n + 1.0) * (n + 3.0) / (6.0 * (n - 2))) AS y, sqrt(2 * (3.0 * (n * n + 27.0 * n - 70) * (n + 1.0) * (n + 3.0) / ((n - 2.0) * (n + 5.0) * (n + 7.0) * (n + 9.0)) - 1)) - 1 AS w2 FROM g))""")
def d10_skewness(spark, sf):
    d = D.skewness(phenotypes(spark, sf), ["acctbal", "n_orders"])
    return d.select("column", "n", F.round("skew", 6).alias("skew"), F.round("zscore", 6).alias("zscore"), F.round("pvalue", 8).alias("pvalue"))


@query(f"""WITH {P}, e AS (SELECT quantile_cont(acctbal, 0.25) AS a, quantile_cont(acctbal, 0.5) AS b, quantile_cont(acctbal, 0.75) AS c FROM p)
    SELECT sample_id, CASE WHEN acctbal <= a THEN 'q1' WHEN acctbal <= b THEN 'q2' WHEN acctbal <= c THEN 'q3' ELSE 'q4' END AS acctbal_cat FROM p, e""")
def m1_discretize(spark, sf):
    return M.discretize(phenotypes(spark, sf), "acctbal", labels=["q1", "q2", "q3", "q4"]).df.select("sample_id", "acctbal_cat")


@query(f"""WITH {P}, s AS (SELECT avg(exposure) AS m, stddev_samp(exposure) AS s FROM p)
    SELECT sample_id, round(CASE WHEN acctbal > 0 THEN ln(acctbal) END, 6) AS acctbal_log, round(CASE WHEN acctbal >= 0 THEN sqrt(acctbal) END, 6) AS acctbal_sqrt, round((exposure - m) / s, 6) AS exposure_zscore FROM p, s""")
def m2_transform(spark, sf):
    p = M.transform(M.transform(M.transform(phenotypes(spark, sf), "acctbal", "log"), "acctbal", "sqrt"), "exposure", "zscore")
    return _rounded(p.df.select("sample_id", "acctbal_log", "acctbal_sqrt", "exposure_zscore"))


_RANKED = "r AS (SELECT sample_id, (rank() OVER (ORDER BY exposure) + (count(*) OVER (PARTITION BY exposure) - 1) / 2.0 - 0.5) / count(*) OVER () AS p FROM p WHERE exposure IS NOT NULL)"


@query(f"WITH {P}, {_RANKED}, {O.norm_quantiles('r', 'p', 'x', 'sample_id')} SELECT p.sample_id, round(x, 6) AS exposure_rank_int FROM p LEFT JOIN q7 USING (sample_id)")
def m2_rank_inverse_normal(spark, sf):
    return _rounded(M.transform(phenotypes(spark, sf), "exposure", "rank_int").df.select("sample_id", "exposure_rank_int"))


def _boxcox_sql(rounds: int = 48) -> str:
    """Halving of the interval in which the likelihood's slope changes its sign."""
    slope = "sum(ln(v)) - count(*) * covar_pop((pow(v, g) - 1) / g, pow(v, g) * ln(v) / g - (pow(v, g) - 1) / (g * g)) / var_pop((pow(v, g) - 1) / g)"
    parts = ["l0 AS (SELECT -5.0::DOUBLE AS lo, 5.3::DOUBLE AS hi)"]
    for k in range(rounds):
        rising = f"(SELECT {slope} FROM (SELECT total_price AS v, (lo + hi) / 2 AS g FROM p, l{k})) > 0"
        parts.append(f"l{k + 1} AS (SELECT CASE WHEN {rising} THEN (lo + hi) / 2 ELSE lo END AS lo, CASE WHEN {rising} THEN hi ELSE (lo + hi) / 2 END AS hi FROM l{k})")
    return f"WITH {P}, {', '.join(parts)} SELECT sample_id, round((pow(total_price, lo) - 1) / lo, 2) AS total_price_boxcox FROM p, l{rounds}"


@query(_boxcox_sql())
def m2_boxcox(spark, sf):
    return _rounded(M.transform(phenotypes(spark, sf), "total_price", "boxcox").df.select("sample_id", "total_price_boxcox"), 2)  # of five digits before the point


@query(f"WITH {P} SELECT sample_id, CASE WHEN segment = 'MACHINERY' THEN NULL WHEN segment = 'BUILDING' THEN 'home' ELSE segment END AS segment FROM p")
def m3_recode(spark, sf):
    return M.recode(phenotypes(spark, sf), "segment", {"BUILDING": "home"}, ["MACHINERY"]).df.select("sample_id", "segment")


@query(f"""WITH {P}, u AS ({' UNION ALL '.join(f"SELECT '{c}' AS col_, {str(c in NUM).lower()} AS num, count(DISTINCT {c}) AS u FROM p" for c in COLS)})
    SELECT col_ AS "column", u AS n_unique, CASE WHEN u <= 1 THEN 'constant' WHEN u = 2 THEN 'binary' WHEN u BETWEEN 3 AND 6 THEN 'categorical' WHEN u >= 15 AND num THEN 'continuous' ELSE 'unknown' END AS class FROM u""")
def m4_auto_classify(spark, sf):
    return M.auto_classify(phenotypes(spark, sf), COLS)


@query(f"WITH {P} SELECT sample_id, CAST(rich AS BIGINT) AS rich, CAST(nation AS VARCHAR) AS nation, CAST(weight AS DOUBLE) AS weight FROM p")
def m5_m7_make_kinds(spark, sf):
    p = M.make_continuous(M.make_categorical(M.make_binary(phenotypes(spark, sf), only=["rich"]), only=["nation"]), only=["weight"])
    return p.df.select("sample_id", "rich", "nation", "weight")


@query(f"""WITH {P}, q AS (SELECT quantile_cont(total_price, 0.25) AS a, quantile_cont(total_price, 0.75) AS b, avg(acctbal) AS m, stddev_samp(acctbal) AS s FROM p)
    SELECT sample_id, round(CASE WHEN total_price BETWEEN a - 0.5 * (b - a) AND b + 0.5 * (b - a) THEN total_price END, 4) AS total_price, round(CASE WHEN abs(acctbal - m) / s <= 1.5 THEN acctbal END, 4) AS acctbal FROM p, q""")
def m9_remove_outliers(spark, sf):
    p = M.remove_outliers(M.remove_outliers(phenotypes(spark, sf), ["total_price"], k=0.5), ["acctbal"], "gaussian", cutoff=1.5)
    return _rounded(p.df.select("sample_id", "total_price", "acctbal"), 4)


@query(f"WITH {P} SELECT sample_id, acctbal, segment FROM p UNION ALL SELECT sample_id + 1000000000, acctbal, segment FROM p")
def m10_merge_observations(spark, sf):
    p = phenotypes(spark, sf)
    other = p.with_df(p.df.withColumn("sample_id", F.col("sample_id") + 1000000000))
    return M.merge_observations(M.colfilter(p, only=["acctbal", "segment"]), M.colfilter(other, only=["segment", "acctbal", "rich"])).df


@query(f"WITH {P}, b AS (SELECT sample_id + 10 AS sample_id, rich, segment FROM p) SELECT coalesce(p.sample_id, b.sample_id) AS sample_id, acctbal, p.rich AS rich_x, b.rich AS rich_y, b.segment FROM p FULL JOIN b ON p.sample_id = b.sample_id")
def m11_merge_variables(spark, sf):
    p = phenotypes(spark, sf)
    other = p.with_df(p.df.withColumn("sample_id", F.col("sample_id") + 10))
    return M.merge_variables(M.colfilter(p, only=["acctbal", "rich"]), M.colfilter(other, only=["rich", "segment"])).df


@query(f"WITH {P} SELECT sample_id, acctbal, total_price, segment, nation, rich FROM p")
def m13_m16_column_filters(spark, sf):
    p = M.colfilter(phenotypes(spark, sf), skip=["weight"])
    p = p.with_df(p.df.withColumn("mostly_zero", F.when(F.col("sample_id") % 20 == 0, 1).otherwise(0)).withColumn("rare", F.when(F.col("sample_id") < 2, "a").otherwise("b")))
    n = p.df.count()
    return M.colfilter_percent_zero(M.colfilter_min_cat_n(M.colfilter_min_n(p, n - n // 7 + 1, only=["exposure"]), 3, only=["rare"]), only=["mostly_zero"]).df.drop("n_orders")


@query(f"WITH {P} SELECT sample_id, exposure, nation FROM p WHERE exposure IS NOT NULL AND nation IS NOT NULL")
def m17_m18_complete_rows(spark, sf):
    p = M.rowfilter_incomplete_obs(M.drop_missing(phenotypes(spark, sf)), only=["nation"])
    return p.df.select("sample_id", "exposure", "nation")


@query(f"WITH {P} SELECT sample_id, acctbal, segment FROM p")
def m19_move_variables(spark, sf):
    p = phenotypes(spark, sf)
    return M.move_variables(M.colfilter(p, only=["segment"]), M.colfilter(p, only=["acctbal"]), ["segment"])[1].df


@query(f"WITH {P} SELECT sample_id FROM p WHERE CAST(sample_id AS VARCHAR) NOT IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier)")
def m20_filter_samples(spark, sf):
    ids = spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey")
    return M.filter_samples(phenotypes(spark, sf), ids, keep=False).df.select("sample_id")


# genotypes

_ALLELES = "CASE WHEN t % 3 = 2 THEN 3 ELSE 2 END"
_GENO = f"""v AS ({VARIANTS}), c AS ({CALLS}),
    s AS (SELECT variant_idx, count(*) AS n, count(*) FILTER (a1 >= 0 AND a2 >= 0) AS n_called, count(*) FILTER (a1 >= 0 AND a2 >= 0 AND a1 <> a2) AS n_het, count(*) FILTER (a1 = 0 AND a2 = 0) AS n_hom_ref,
      count(*) FILTER (a1 > 0 AND a1 = a2) AS n_hom_alt, sum(CASE WHEN a1 = 1 THEN 1 ELSE 0 END + CASE WHEN a2 = 1 THEN 1 ELSE 0 END) AS alt, sum(CASE WHEN a1 >= 0 THEN 1 ELSE 0 END + CASE WHEN a2 >= 0 THEN 1 ELSE 0 END) AS slots FROM c GROUP BY variant_idx),
    f AS (SELECT v.*, s.* EXCLUDE (variant_idx), CASE WHEN {_ALLELES} = 3 THEN 0.0 ELSE least(alt, slots - alt) / slots END::DOUBLE AS maf, n_called / n AS call_rate FROM v LEFT JOIN s USING (variant_idx))""".replace("STRING", "VARCHAR")


def _weight(k: str) -> str:
    """Of the exact test: the weight of k heterozygotes, given how many the rarer allele has."""
    return f"exp({k} * ln(2.0) - lgamma((rare - {k}) / 2 + 1) - lgamma({k} + 1) - lgamma(n_called - (rare + {k}) / 2 + 1) + lgamma(rare / 2.0 + 1) + lgamma(n_called - rare / 2.0 + 1))"


_HWE = f"""h AS (SELECT *, CASE WHEN n_called > 0 THEN least(1.0, list_sum(list_filter(w, lambda x: x <= own * (1 + 1e-9))) / list_sum(w)) END AS hwe_pvalue FROM (
    SELECT *, list_transform(range(rare % 2, rare + 1, 2), lambda k: {_weight("k")}) AS w, {_weight("n_het")} AS own FROM (SELECT *, 2 * least(n_hom_ref, n_hom_alt) + n_het AS rare FROM f)))"""


@query(f"WITH {_GENO}, {_HWE} SELECT variant_id, contig, position, n_called, n_het, n_hom_ref, n_hom_alt, round(call_rate, 6) AS call_rate, round(maf, 6) AS maf, round(hwe_pvalue, 6) AS hwe_pvalue FROM h")
def g1_variant_stats(spark, sf):
    return _rounded(G.variant_stats(genotypes(spark, sf)).drop("variant_idx"))


@query(f"WITH {_GENO}, {_HWE} SELECT variant_id, round(hwe_pvalue, 6) AS hwe_pvalue FROM h WHERE hwe_pvalue >= 0.05")
def f6_filter_hwe(spark, sf):
    return _rounded(G.variant_stats(G.filter_hwe(genotypes(spark, sf), 0.05)).select("variant_id", "hwe_pvalue"))


@query(f"WITH {_GENO} SELECT sample_id, count(*) FILTER (a1 >= 0) AS n_called, count(*) FILTER (a1 >= 0 AND a1 <> a2) AS n_het, count(*) FILTER (a1 = 0 AND a2 = 0) AS n_hom_ref, count(*) FILTER (a1 = 1 AND a2 = 1) AS n_hom_alt, round(count(*) FILTER (a1 >= 0) / count(*), 6) AS call_rate FROM c GROUP BY 1")
def g2_sample_stats(spark, sf):
    return _rounded(G.sample_stats(genotypes(spark, sf)))


@query(f"WITH {_GENO}, h AS (SELECT sample_id, count(*) FILTER (a1 >= 0) AS n_called, count(*) FILTER (a1 >= 0 AND a1 <> a2) AS n_het FROM c GROUP BY 1), z AS (SELECT *, n_het / n_called AS het_rate FROM h) SELECT sample_id, n_called, n_het, round(het_rate, 6) AS het_rate, round((het_rate - (SELECT avg(het_rate) FROM z)) / (SELECT stddev_samp(het_rate) FROM z), 6) AS het_zscore, abs((het_rate - (SELECT avg(het_rate) FROM z)) / (SELECT stddev_samp(het_rate) FROM z)) > 1.5 AS is_outlier FROM z")
def g3_heterozygosity(spark, sf):
    return _rounded(G.heterozygosity(genotypes(spark, sf), 1.5))


@query(f"WITH {_GENO}, s_ AS (SELECT count(*) FILTER (a1 >= 0) / count(*) AS r FROM c GROUP BY sample_id) SELECT count(*) AS n_variants, round(min(call_rate), 6) AS min_variant_call_rate, (SELECT round(avg(r), 6) FROM s_) AS mean_sample_call_rate, (SELECT round(min(r), 6) FROM s_) AS min_sample_call_rate, round(avg(call_rate), 6) AS mean_variant_call_rate, round(avg(maf), 6) AS mean_maf, count(*) FILTER (maf < 0.01) AS n_maf_below_01, count(*) FILTER (maf < 0.05) AS n_maf_below_05, (SELECT count(DISTINCT sample_id) FROM c) AS n_samples FROM f")
def g4_genotype_summary(spark, sf):
    return _rounded(G.genotype_summary(genotypes(spark, sf)))


@query(f"WITH {_GENO} SELECT variant_id FROM f WHERE t % 3 = 1 AND maf >= 0.2 AND call_rate >= 0.9 AND CAST(contig AS INT) <= 22")
def f1_f4_variant_filters(spark, sf):
    g = G.filter_missingness_variants(G.filter_maf(G.keep_snvs_only(G.filter_biallelic(genotypes(spark, sf))), 0.2), 0.1)
    return g.variants.select("variant_id")


@query(f"WITH {_GENO}, k AS (SELECT sample_id FROM c GROUP BY 1 HAVING count(*) FILTER (a1 >= 0) / count(*) >= 0.955) SELECT sample_id, count(*) AS n FROM c WHERE sample_id IN (SELECT sample_id FROM k) AND variant_idx IN (SELECT variant_idx FROM v WHERE contig = '5' AND position BETWEEN 10000 AND 900000000) GROUP BY 1")
def f5_f8_samples_and_region(spark, sf):
    g = G.filter_by_region(G.filter_missingness_samples(genotypes(spark, sf), 0.045), "5", 10000, 900000000)
    return g.calls.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_GENO} SELECT variant_id FROM v WHERE contig <> '7'")
def f7_filter_variants(spark, sf):
    g = genotypes(spark, sf)
    return G.filter_variants(g, g.variants.where("contig = '7'").select("variant_id"), keep=False).variants.select("variant_id")


@query(f"WITH {_GENO}, h AS (SELECT sample_id, count(*) FILTER (a1 >= 0 AND a1 <> a2) / count(*) FILTER (a1 >= 0) AS r FROM c GROUP BY 1) SELECT sample_id FROM h WHERE abs(r - (SELECT avg(r) FROM h)) <= 1.5 * (SELECT stddev_samp(r) FROM h)")
def f9_heterozygosity_outliers(spark, sf):
    return G.filter_heterozygosity_outliers(genotypes(spark, sf), 1.5).calls.select("sample_id").distinct()


def _prune_sql(width: int, step: int, r2: float, at: str) -> str:
    """Variants one after the other along a contig: one stays unless it is linked with one that has stayed."""
    return f"""WITH RECURSIVE {_GENO}, o AS (SELECT variant_idx, variant_id, contig, {at} AS at, row_number() OVER (PARTITION BY contig ORDER BY position, variant_idx) AS k FROM v),
        d AS (SELECT variant_idx, sample_id, (a1 + a2)::DOUBLE AS d FROM c WHERE a1 >= 0 AND a2 >= 0),
        pairs AS (SELECT a.contig, a.k AS i, b.k AS j, a.variant_idx AS vi, b.variant_idx AS vj FROM o a JOIN o b ON a.contig = b.contig AND a.k < b.k AND b.at - a.at // {step} * {step} < {width}),
        linked AS (SELECT contig, i, j FROM pairs JOIN d x ON x.variant_idx = vi JOIN d y ON y.variant_idx = vj AND y.sample_id = x.sample_id GROUP BY ALL
          HAVING var_pop(x.d) > 1e-12 AND var_pop(y.d) > 1e-12 AND pow(covar_pop(x.d, y.d), 2) > {r2} * var_pop(x.d) * var_pop(y.d) + 1e-12),
        near AS (SELECT contig, j, list(i) AS before FROM linked GROUP BY ALL),
        run AS (SELECT DISTINCT contig, 0::BIGINT AS k, []::BIGINT[] AS kept FROM o
          UNION ALL SELECT run.contig, o.k, CASE WHEN before IS NULL OR len(list_intersect(before, kept)) = 0 THEN list_append(kept, o.k) ELSE kept END FROM run JOIN o ON o.contig = run.contig AND o.k = run.k + 1 LEFT JOIN near ON near.contig = o.contig AND near.j = o.k),
        last AS (SELECT contig, unnest(kept) AS k FROM (SELECT contig, arg_max(kept, k) AS kept FROM run GROUP BY contig))
        SELECT variant_id FROM o JOIN last USING (contig, k)"""


@query(_prune_sql(50, 5, 0.2, "row_number() OVER (PARTITION BY contig ORDER BY position, variant_idx) - 1"))
def f10_prune_ld(spark, sf):
    return G.prune_ld(genotypes(spark, sf), window=50, step=5, r2=0.2).variants.select("variant_id")


@query(_prune_sql(300_000, 70_000, 0.4, "position"))
def f10_prune_ld_kb(spark, sf):
    return G.prune_ld(genotypes(spark, sf), window=300, step=70, r2=0.4, unit="kb").variants.select("variant_id")


@query(f"WITH {_GENO}, d AS (SELECT variant_id, sample_id, CASE WHEN a1 >= 0 THEN CAST(a1 + a2 AS DOUBLE) END AS d FROM c JOIN v USING (variant_idx)) SELECT variant_id, sample_id, d AS additive, CASE WHEN d IS NOT NULL THEN CAST(d >= 1 AS INT)::DOUBLE END AS dominant, CASE WHEN d IS NOT NULL THEN CAST(d = 2 AS INT)::DOUBLE END AS recessive, CASE WHEN d IS NOT NULL THEN CAST(d = 1 AS INT)::DOUBLE END AS het, CASE WHEN d IS NOT NULL THEN CAST(d = 2 AS INT)::DOUBLE END AS hom_alt, CASE WHEN d IS NOT NULL THEN (ARRAY[0.0, 0.4, 1.0])[CAST(d AS INT) + 1]::DOUBLE END AS edge FROM d")
def e0_e5_encodings(spark, sf):
    g = genotypes(spark, sf)
    edge = g.variants.select("variant_id", F.lit(0.0).alias("score_0"), F.lit(0.4).alias("score_1"), F.lit(1.0).alias("score_2"))
    out = G.encode(g).withColumnRenamed("x", "additive")
    for name in ("dominant", "recessive"):
        out = out.join(G.encode(g, name).withColumnRenamed("x", name), ["variant_id", "sample_id"])
    out = out.join(G.encode(g, "codominant").select("variant_id", "sample_id", "het", "hom_alt"), ["variant_id", "sample_id"])
    return out.join(G.encode(g, "edge", edge).withColumnRenamed("x", "edge"), ["variant_id", "sample_id"])


# studies


_Z = "1.959963984540054"


def _glm(name: str, variable: str, k: int, source: str, y: str, xs: list[str], outcome: str = "total_price", kind: str = "continuous", min_n: int = 1) -> str:
    """A row of a linear study: the last of xs against the others, by a normal test and a likelihood ratio."""
    lrt = f"(2 * ({O.gaussian_ll('rss', 'n')} - {O.gaussian_ll('rss0', 'n')}))"
    return f"""SELECT '{outcome}' AS outcome, '{variable}' AS variable, '{kind}' AS variable_type, n, round(slope, 4) AS beta, round(se, 4) AS se, round(slope - {_Z} * se, 4) AS ci_low, round(slope + {_Z} * se, 4) AS ci_high,
        round({O.norm_two_sided("(slope / se)")}, 4) AS beta_pvalue, round({O.chi2_sf(f"greatest({lrt}, 0)", 1)}, 4) AS lrt_pvalue, round(2 - {lrt}, 4) AS diff_aic, true AS converged
        FROM (SELECT *, sqrt(rss / (n - {k}) / left_over) AS se FROM (WITH {O.least_squares(name, source, y, xs, len(xs) - 1)} SELECT * FROM {name}))"""


@query(f"""WITH {P}, a AS ({_glm('f', 'acctbal', 2, 'p', 'total_price', ['acctbal'])}), b AS ({_glm('f', 'exposure', 2, '(SELECT * FROM p WHERE exposure IS NOT NULL)', 'total_price', ['exposure'])})
    SELECT variable, n, beta, se, ci_low, ci_high, beta_pvalue AS p_value FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""")
def a7_ewas_linear(spark, sf):
    return _rounded(A.ewas(phenotypes(spark, sf), "total_price", covariates=[]).df, 4)


_LEVELS = ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]  # after the first, AUTOMOBILE
_DUMMIES = [f"(segment = '{v}')::INT" for v in _LEVELS]


def _categorical(name: str) -> str:
    """The row of a categorical variable: no estimate, a likelihood ratio of all its dummies together."""
    lrt = f"(2 * ({O.gaussian_ll('rss', 'n')} - {O.gaussian_ll('rss0', 'n')}))"
    none = ", ".join(f"NULL::DOUBLE AS {c}" for c in ("beta", "se", "ci_low", "ci_high", "beta_pvalue"))
    return f"""SELECT 'total_price' AS outcome, 'segment' AS variable, 'categorical' AS variable_type, n, {none}, round({O.chi2_sf(f"greatest({lrt}, 0)", 4)}, 4) AS lrt_pvalue, round(8 - {lrt}, 4) AS diff_aic, true AS converged
        FROM (WITH {O.least_squares(name, 'p', 'total_price', ['n_orders', *_DUMMIES], 1)} SELECT * FROM {name})"""


def _dummy(k: int) -> str:
    xs = ["n_orders", *[d for j, d in enumerate(_DUMMIES) if j != k], _DUMMIES[k]]
    row = _glm("f", f"segment_{_LEVELS[k]}", 6, "p", "total_price", xs, kind="categorical_dummy")
    return f"SELECT * REPLACE ((SELECT lrt_pvalue FROM whole) AS lrt_pvalue, (SELECT diff_aic FROM whole) AS diff_aic) FROM ({row})"


@query(f"""WITH {P}, whole AS ({_categorical('w')}) SELECT * FROM whole UNION ALL SELECT * FROM ({_glm('f', 'acctbal', 3, 'p', 'total_price', ['n_orders', 'acctbal'])})
    UNION ALL SELECT * FROM ({_glm('f', 'nation', 3, '(SELECT * FROM p WHERE nation IS NOT NULL)', 'total_price', ['n_orders', 'nation'])})
    UNION ALL SELECT * FROM ({_glm('f', 'rich', 3, 'p', 'total_price', ['n_orders', 'rich'], kind='binary')}) UNION ALL """ + " UNION ALL ".join(f"SELECT * FROM ({_dummy(k)})" for k in range(4)))
def a1_association_study(spark, sf):
    p = phenotypes(spark, sf)
    return _rounded(A.association_study(p, ["total_price"], ["acctbal", "segment", "nation", "rich"], min_n=20, report_categorical_betas=True).df.drop("error"), 4)


# a logistic model of levels alone has closed forms: log odds against the first level, their variances, the likelihood
_COUNTED = "c AS (SELECT {x} AS v, count(*) FILTER (rich = 1)::DOUBLE AS k1, count(*) FILTER (rich = 0)::DOUBLE AS k0 FROM p GROUP BY 1), r AS (SELECT *, first_value(k1) OVER (ORDER BY v) AS r1, first_value(k0) OVER (ORDER BY v) AS r0, row_number() OVER (ORDER BY v) AS j FROM c)"
_LL = "sum(k1 * ln(k1 / (k1 + k0)) + k0 * ln(k0 / (k1 + k0)))"
_LL0 = "(sum(k1) * ln(sum(k1) / sum(k1 + k0)) + sum(k0) * ln(sum(k0) / sum(k1 + k0)))"


def _logistic(variable: str, x: str, levels: int, kind: str) -> str:
    whole = f"(SELECT 2 * ({_LL} - {_LL0}) AS chi2, sum(k1 + k0)::BIGINT AS n FROM c)"
    shared = f"n, {{est}}, round({O.chi2_sf('chi2', levels - 1)}, 4) AS lrt_pvalue, round(2 * {levels - 1} - chi2, 4) AS diff_aic, true AS converged"
    est = f"round(b, 4) AS beta, round(se, 4) AS se, round(b - {_Z} * se, 4) AS ci_low, round(b + {_Z} * se, 4) AS ci_high, round({O.norm_two_sided('(b / se)')}, 4) AS beta_pvalue"
    none = ", ".join(f"NULL::DOUBLE AS {c}" for c in ("beta", "se", "ci_low", "ci_high", "beta_pvalue"))
    rows = "(SELECT v, ln(k1 * r0 / k0 / r1) AS b, sqrt(1 / k1 + 1 / k0 + 1 / r1 + 1 / r0) AS se FROM r WHERE j > 1)"
    if levels == 2:
        out = f"SELECT 'rich' AS outcome, '{variable}' AS variable, 'binary' AS variable_type, {shared.format(est=est)} FROM {whole}, {rows}"
    else:
        out = f"SELECT 'rich' AS outcome, '{variable}' AS variable, '{kind}' AS variable_type, {shared.format(est=none)} FROM {whole} UNION ALL SELECT 'rich', '{variable}_' || v, '{kind}_dummy', {shared.format(est=est)} FROM {whole}, {rows}"
    return f"WITH {P}, {_COUNTED.format(x=x)} {out}"


@query(f"SELECT * FROM ({_logistic('odd', '(sample_id % 2)', 2, 'binary')}) UNION ALL SELECT * FROM ({_logistic('segment', 'segment', 5, 'categorical')})")
def a1_association_logistic(spark, sf):
    p = phenotypes(spark, sf)
    p = p.with_df(p.df.withColumn("odd", F.col("sample_id") % 2))
    return _rounded(A.association_study(p, ["rich"], ["odd", "segment"], covariates=[], min_n=20, report_categorical_betas=True).df.drop("error"), 4)


_T = O.t_two_sided("(slope / se)", "(n - 2)")
_GWAS = "d AS (SELECT variant_id AS variable, CAST(a1 + a2 AS DOUBLE) AS g, s_acctbal AS y FROM c JOIN v USING (variant_idx) JOIN supplier ON s_suppkey = sample_id WHERE a1 >= 0)"


@query(f"""WITH {_GENO}, {_GWAS}, m AS (SELECT variable, count(*) AS n, regr_slope(y, g) AS slope, sqrt(greatest(regr_syy(y, g) - regr_slope(y, g) * regr_sxy(y, g), 0) / (count(*) - 2) / regr_sxx(y, g)) AS se FROM d GROUP BY 1 HAVING regr_sxx(y, g) > 0 AND count(*) > 2)
    SELECT variable, (SELECT count(*) FROM supplier) AS n, round(slope + 0.0000123, 4) AS beta, round(se + 0.0000123, 4) AS se, round(slope - 1.96 * se + 0.0000123, 4) AS ci_low, round(slope + 1.96 * se + 0.0000123, 4) AS ci_high, round({_T}, 4) AS p_value FROM m WHERE se > 1e-6""")
def a8_gwas(spark, sf):
    from ..types import Phenotypes

    phen = Phenotypes(spark.read.parquet(f"{sf}/supplier.parquet").withColumnRenamed("s_suppkey", "sample_id"))
    out = A.gwas(genotypes(spark, sf), phen, "s_acctbal").df.where("se > 1e-6")
    # slopes are fractions of cents: the offset keeps exact halves off the edge of rounding
    moved = [(F.col(c) + 0.0000123).alias(c) for c in ("beta", "se", "ci_low", "ci_high")]
    return _rounded(out.select("variable", "n", *moved, "p_value"), 4)


@query(f"""WITH {P}, {O.least_squares('f', 'p', 'total_price', ['n_orders', 'acctbal', 'weight'], 1)}, l AS (SELECT n, {O.gaussian_ll('rss', 'n')} AS a, {O.gaussian_ll('rss0', 'n')} AS b FROM f)
    SELECT round(2 * (a - b), 4) AS chi2, 2::BIGINT AS df, round({O.chi2_sf('(2 * (a - b))', 2)}, 4) AS p_value, round(a, 4) AS ll_full, round(b, 4) AS ll_nested, n FROM l""")
def a9_lrt(spark, sf):
    return _rounded(A.lrt(phenotypes(spark, sf), "total_price", ["n_orders", "acctbal", "weight"], ["n_orders"]), 4)


@query(f"""WITH {P}, {_COUNTED.format(x='(sample_id % 2)')}, l AS (SELECT sum(k1 + k0)::BIGINT AS n, {_LL} AS a, {_LL0} AS b FROM c)
    SELECT round(2 * (a - b), 4) AS chi2, 1::BIGINT AS df, round({O.chi2_sf('(2 * (a - b))', 1)}, 4) AS p_value, round(a, 4) AS ll_full, round(b, 4) AS ll_nested, n FROM l""")
def a9_lrt_logistic(spark, sf):
    p = phenotypes(spark, sf)
    return _rounded(A.lrt(p.with_df(p.df.withColumn("odd", F.col("sample_id") % 2)), "rich", ["odd"], []), 4)


def _interaction(a: str, b: str, source: str, xs: list[str], keep: int) -> str:
    df = len(xs) - keep
    lrt = f"(2 * ({O.gaussian_ll('rss', 'n')} - {O.gaussian_ll('rss0', 'n')}))"
    return f"""SELECT 'total_price' AS outcome, '{a}' AS term1, '{b}' AS term2, n, round({lrt}, 4) AS lrt_chi2, {df}::BIGINT AS lrt_df, round({O.chi2_sf(lrt, df)}, 4) AS lrt_pvalue, round(2 * {df} - {lrt}, 4) AS diff_aic, true AS converged
        FROM (WITH {O.least_squares('f', source, 'total_price', xs, keep)} SELECT * FROM f)"""


_PAIRS_SQL = [
    _interaction("acctbal", "weight", "p", ["acctbal", "weight", "acctbal * weight"], 2),
    _interaction("acctbal", "segment", "p", ["acctbal", *_DUMMIES, *[f"acctbal * {d}" for d in _DUMMIES]], 5),
    _interaction("exposure", "weight", "(SELECT * FROM p WHERE exposure IS NOT NULL)", ["exposure", "weight", "exposure * weight"], 2),
]


@query(f"WITH {P} " + " UNION ALL ".join(f"SELECT * FROM ({q})" for q in _PAIRS_SQL))
def a10_interaction_study(spark, sf):
    p = phenotypes(spark, sf)
    return _rounded(A.interaction_study(p, ["total_price"], [("acctbal", "weight"), ("acctbal", "segment"), ("exposure", "weight")], covariates=[], min_n=20).df.drop("error"), 4)


_PV = f"pv AS ({PVALUES.replace('STRING', 'VARCHAR')})"


@query(f"""WITH {_PV}, r AS (SELECT *, count(p_value) OVER () AS m, row_number() OVER (ORDER BY p_value) AS k FROM pv WHERE p_value IS NOT NULL)
    SELECT id, round(least(1.0, p_value * m), 8) AS bonferroni, round(1 - pow(1 - p_value, m), 8) AS sidak, round(least(1.0, min(p_value * m / k) OVER (ORDER BY k DESC)), 8) AS fdr_bh,
      round(least(1.0, min(p_value * m / k * (SELECT sum(1.0 / i)::DOUBLE FROM range(1, (SELECT count(p_value) FROM pv) + 1) t(i))) OVER (ORDER BY k DESC)), 8) AS fdr_by, round(least(1.0, max(p_value * (m - k + 1)) OVER (ORDER BY k)), 8) AS holm FROM r
    UNION ALL SELECT id, NULL, NULL, NULL, NULL, NULL FROM pv WHERE p_value IS NULL""")
def a11_corrections(spark, sf):
    df = R.corrections(p_values(spark, sf), "p_value", {m: m for m in ("bonferroni", "sidak", "fdr_bh", "fdr_by", "holm")})
    return _rounded(df.select("id", "bonferroni", "sidak", "fdr_bh", "fdr_by", "holm"), 8)


@query(f"""WITH {_PV}, r AS (SELECT id, grp, p_value AS p, row_number() OVER (PARTITION BY grp ORDER BY p_value, id) AS k, count(*) OVER (PARTITION BY grp) AS n FROM pv WHERE p_value IS NOT NULL),
    c AS (SELECT r.grp, m, min(m * p / (k - n + m)) AS c FROM r JOIN (SELECT unnest(range(1, (SELECT max(n) + 1 FROM r))) AS m) ON m <= n AND k > n - m GROUP BY ALL),
    a AS (SELECT id, max(CASE WHEN k > n - m THEN c ELSE least(c, m * p) END) AS h FROM r JOIN c USING (grp) WHERE m <= n GROUP BY id)
    SELECT id, round(least(1.0, greatest(h, p)), 8) AS hommel FROM a JOIN r USING (id) UNION ALL SELECT id, NULL FROM pv WHERE p_value IS NULL""")
def a11_hommel(spark, sf):
    return _rounded(R.corrected(p_values(spark, sf), "p_value", "hommel", ["grp"], out="hommel").select("id", "hommel"), 8)


@query(f"""WITH {_PV}, r AS (SELECT *, count(*) OVER (PARTITION BY grp) AS m, row_number() OVER (PARTITION BY grp ORDER BY p_value) AS k FROM pv WHERE p_value IS NOT NULL),
    c AS (SELECT id, grp, p_value, least(1.0, min(p_value * m / k) OVER (PARTITION BY grp ORDER BY k DESC)) AS pc FROM r) SELECT id, grp, round(pc, 8) AS p_corrected FROM c WHERE p_value < 0.05 AND pc < 0.3""")
def a12_a13_grouped_correction(spark, sf):
    r = R.passing(R.with_correction(RegressionResults(p_values(spark, sf)), "fdr_bh", ["grp"]), 0.05, 0.3)
    return _rounded(r.df.select("id", "grp", "p_corrected"), 8)


@query(f"WITH {_PV} SELECT id, round(p_value, 8) AS p_value FROM pv WHERE p_value IS NOT NULL ORDER BY p_value, id LIMIT 25")
def a14_top(spark, sf):
    r = RegressionResults(p_values(spark, sf).withColumnRenamed("id", "variable"))
    return _rounded(R.top(r, 25).select(F.col("variable").alias("id"), "p_value"), 8)


@query(f"WITH {_PV} SELECT count(*) AS n_tests, 0::BIGINT AS n_errors, count(*) FILTER (p_value < 0.05) AS n_passing, round(min(p_value), 8) AS min_p FROM pv")
def a16_summary(spark, sf):
    return _rounded(R.summary(RegressionResults(p_values(spark, sf))), 8)
