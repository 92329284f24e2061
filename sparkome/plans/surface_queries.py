"""Queries of what has no table of its own: resolvers, engines, registries, checks and the command line, as rows of what they answer."""

from __future__ import annotations

import contextlib
import io
import warnings
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import describe as D, genotypes as G, models as A, modify as M, plotdata as P, results as R
from ..sources import snapshot
from ..sources.workspace import folder
from ..types import RegressionResults
from . import kg as K
from .domain import genotypes, p_values, phenotypes, table
from .graph_queries import graph

Q: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(oracle: str):
    def add(f: Callable) -> Callable:
        Q[f.__name__] = f
        SQL[f.__name__] = oracle
        return f

    return add


def _answers(spark: SparkSession, asked: dict[str, Callable]) -> DataFrame:
    """What each call gives, or the name of the error that it raises."""
    rows = []
    for name, call in asked.items():
        try:
            got = call()
            rows.append((name, ",".join(map(str, got)) if isinstance(got, (list, tuple)) else str(got)))
        except Exception as e:  # noqa: BLE001  the kind of error is the answer
            rows.append((name, type(e).__name__))
    return spark.createDataFrame(rows, "asked string, answer string")


def _expected(**answers: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in answers.items()) + ") v(asked, answer)"


@query(_expected(all="acctbal,n_orders,total_price,exposure,segment,nation,rich,weight", with_id="9", named="rich,nation", missing="KeyError", targets="nation", unknown_ignored="", roles_left="exposure", weights_gone="None", bad_role="ValueError"))
def d12_m8_m12_resolvers(spark, sf):
    p = phenotypes(spark, sf)
    left = p.with_df(p.df.drop("acctbal", "weight"))
    return _answers(spark, {
        "all": lambda: D.resolve(p, None), "with_id": lambda: len(D.resolve(p, None, with_id=True)), "named": lambda: D.resolve(p, ["rich", "nation"]), "missing": lambda: D.resolve(p, ["rich", "none"]),
        "targets": lambda: [c for c in M.colfilter(p, only=["nation", "rich"], skip=["rich"]).variables], "unknown_ignored": lambda: M.colfilter(p, only=["none"]).variables,
        "roles_left": lambda: left.exposures, "weights_gone": lambda: left.weights, "bad_role": lambda: type(p)(p.df, outcomes=["none"]),
    })


@query(_expected(maf_high="ValueError", maf_low="ValueError", missing_high="ValueError", hwe_high="ValueError", r2_high="ValueError", window_zero="ValueError", step_zero="ValueError", unit="ValueError", contig="ValueError", encoding="ValueError", edge_without_scores="ValueError"))
def f11_rate_checks(spark, sf):
    g = genotypes(spark, sf)
    return _answers(spark, {
        "maf_high": lambda: G.filter_maf(g, 0.6), "maf_low": lambda: G.filter_maf(g, -0.1), "missing_high": lambda: G.filter_missingness_variants(g, 1.1), "hwe_high": lambda: G.filter_hwe(g, 2), "r2_high": lambda: G.prune_ld(g, r2=1.5),
        "window_zero": lambda: G.prune_ld(g, window=0), "step_zero": lambda: G.prune_ld(g, step=0), "unit": lambda: G.prune_ld(g, unit="x"), "contig": lambda: G.filter_by_region(g, "none"), "encoding": lambda: G.encode(g, "none"), "edge_without_scores": lambda: G.encode(g, "edge"),
    })


@query(_expected(auto="fit_glm", weighted="fit_glm", own="own", survey="NotImplementedError", unknown="ValueError", numbers="linear", zero_one="logistic", boolean="logistic", text="ValueError", empty="ValueError", weights_needed="ValueError", strata_warn="UserWarning", gwas_yes_or_no="NotImplementedError", gwas_column="ValueError", no_outcome="ValueError", covariate_text="ValueError"))
def a3_a6_engines_and_families(spark, sf):
    p = phenotypes(spark, sf)
    d = p.df.withColumns({"yes": F.col("rich") == 1, "none": F.lit(None).cast("double"), "st": F.lit("a")})
    one = lambda c: A.infer_family(d, [c])[c]

    def own(*_):
        return None

    def warned() -> str:
        with warnings.catch_warnings(record=True) as seen:
            warnings.simplefilter("always")
            A.association_study(type(p)(d, outcomes=["total_price"], exposures=["acctbal"], weights="weight", strata="st"), use_survey=True)
        return seen[0].category.__name__ if seen else "none"

    s = table(spark, sf, "supplier").withColumnRenamed("s_suppkey", "sample_id").withColumn("yes", F.col("s_acctbal") > 0)
    return _answers(spark, {
        "auto": lambda: A.resolve_engine("auto").__name__, "weighted": lambda: A.resolve_engine("weighted_glm").__name__, "own": lambda: A.resolve_engine(own).__name__, "survey": lambda: A.resolve_engine("r_survey"), "unknown": lambda: A.resolve_engine("x"),
        "numbers": lambda: one("total_price"), "zero_one": lambda: one("rich"), "boolean": lambda: one("yes"), "text": lambda: one("segment"), "empty": lambda: one("none"),
        "weights_needed": lambda: A.association_study(type(p)(p.df, outcomes=["total_price"], exposures=["acctbal"]), use_survey=True), "strata_warn": warned,
        "gwas_yes_or_no": lambda: A.gwas(genotypes(spark, sf), type(p)(s), "yes"), "gwas_column": lambda: A.gwas(genotypes(spark, sf), type(p)(s), "none"), "no_outcome": lambda: A.association_study(p.with_df(p.df.drop("total_price"))), "covariate_text": lambda: A.association_study(p, covariates=["segment"]),
    })


@query("""WITH p AS (SELECT c_custkey AS id, c_acctbal AS x, o.t AS y, 1.0 + c_custkey % 3 AS w FROM customer JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS t FROM orders GROUP BY o_custkey) o ON c_custkey = o.o_custkey),
    r AS (SELECT unnest(range(1, w::BIGINT + 1)) AS i, x, y FROM p), m AS (SELECT regr_slope(y, x) AS b, sqrt((regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (count(*) - 2) / regr_sxx(y, x)) AS se FROM r)
    SELECT engine, n, round(b, 4) AS beta, round(se, 4) AS se FROM m, (SELECT count(*) AS n FROM p), (VALUES ('sums'), ('rows')) v(engine)""")
def a2_a5_frequency_weights(spark, sf):
    """A weighted fit, by sums of products and by an engine on rows alike: as if each row were there as often as its weight says."""
    p = phenotypes(spark, sf)

    def rows(*args, **kw):
        return A.fit_glm(*args, **kw)

    out = None
    for name, kind in (("sums", "glm"), ("rows", rows)):
        r = A.association_study(p, ["total_price"], ["acctbal"], covariates=[], use_survey=True, regression_kind=kind, min_n=20)
        one = r.df.select(F.lit(name).alias("engine"), "n", F.round("beta", 4).alias("beta"), F.round("se", 4).alias("se"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH p AS (SELECT c_custkey AS id, c_acctbal AS x, o.t AS y, c_nationkey AS cl FROM customer JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS t FROM orders GROUP BY o_custkey) o ON c_custkey = o.o_custkey),
    m AS (SELECT count(*) AS n, avg(x) AS mx, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx FROM p), s AS (SELECT cl, sum((x - mx) * (y - a - b * x)) AS u FROM p, m GROUP BY cl),
    g AS (SELECT count(*)::DOUBLE AS g, sum(u * u) AS meat FROM s) SELECT n, round(b, 4) AS beta, round(sqrt(g / (g - 1) * (n - 1) / (n - 2) * meat) / sxx, 4) AS se FROM m, g""")
def a2_cluster_variance(spark, sf):
    """Robust standard errors of clusters; every row has the weight one."""
    p = phenotypes(spark, sf)
    d = p.df.join(table(spark, sf, "customer").select(F.col("c_custkey").alias("sample_id"), F.col("c_nationkey").alias("cl")), "sample_id").withColumn("one", F.lit(1.0))
    r = A.association_study(type(p)(d, outcomes=["total_price"], exposures=["acctbal"], weights="one", cluster="cl"), covariates=[], use_survey=True, min_n=20)
    return r.df.select("n", F.round("beta", 4).alias("beta"), F.round("se", 4).alias("se"))


@query("SELECT s_name AS variable, CASE WHEN s_suppkey % 3 > 0 THEN 'first ' || s_nationkey END AS gene_symbol, CASE WHEN s_suppkey % 3 > 0 THEN 'E' || s_suppkey END AS ensembl_id FROM supplier")
def a15_annotate(spark, sf):
    """Results with the least row of a report for each name; names that the report lacks keep nulls."""
    s = table(spark, sf, "supplier")
    results = RegressionResults(s.select(F.col("s_name").alias("variable"), F.lit(0.5).alias("p_value")))
    report = s.where("s_suppkey % 3 > 0").select(F.col("s_name").alias("input_value"), F.explode(F.array(F.lit("second "), F.lit("first "))).alias("w"), "s_nationkey", F.concat(F.lit("E"), F.col("s_suppkey").cast("string")).alias("ensembl_id"))
    report = report.select("input_value", F.concat("w", F.col("s_nationkey").cast("string")).alias("gene_symbol"), "ensembl_id")
    return R.annotate(results, report).df.select("variable", "gene_symbol", "ensembl_id")


@query(_expected(reports="disease_annotations,gene_annotations,go_annotations,pathway_annotations,protein_annotations", explained="True", unknown_report="ValueError", unknown_column="ValueError", not_run="ValueError", phenotypes="distribution,from_describe", genotypes="from_modify", association="manhattan,qq,dotplot", interaction="heatmap,dotplot", other=""))
def r9_p12_registries(spark, sf):
    g, pv = graph(spark, sf), p_values(spark, sf)
    inter = RegressionResults(pv.withColumn("term1", F.lit("a")))
    return _answers(spark, {
        "reports": K.list_reports, "explained": lambda: "gene_symbol" in K.explain("gene_annotations"), "unknown_report": lambda: K.explain("none"), "unknown_column": lambda: K.run_report(g, "go_annotations", columns=["none"]), "not_run": lambda: K.run_report(g, "none"),
        "phenotypes": lambda: P.suggest(phenotypes(spark, sf)), "genotypes": lambda: P.suggest(genotypes(spark, sf)), "association": lambda: P.suggest(RegressionResults(pv)), "interaction": lambda: P.suggest(inter), "other": lambda: P.suggest(1),
    })


@query("SELECT n_name AS input_value, (n_nationkey + 2000000)::VARCHAR AS entity_id, 'found' AS status, true AS verified, true AS listed FROM nation UNION ALL SELECT 'nothing', NULL, 'not_found', true, true FROM region WHERE r_regionkey = 0")
def r10_r11_command_line(spark, sf):
    """A report over a snapshot, with identifiers from a file, by the command line; what it lists and verifies."""
    from ..__main__ import main

    g, path = graph(spark, sf), folder(spark, "snapshot")
    n = table(spark, sf, "nation")
    master = n.select((F.col("n_nationkey") + 2000000).cast("long").alias("entity_id"), F.col("n_name").alias("pathway_id"), F.col("n_name").alias("name"), *[F.lit("x").alias(c) for c in ("source_db", "organism", "pathway_source_system", "pathway_data_source")])
    snapshot.export(spark, path, {"entity_types": g.entity_types, "entities": g.entities, "aliases": g.aliases, "relationships": g.relationships, "locations": g.locations, "pathway_master": master}, plain=False)
    n.select("n_name").write.text(f"{path}-ids")
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        verified = main(["verify", path]) == 0
        main(["reports"])
        main(["report", "pathway_annotations", path, "nothing", f"@{path}-ids", "--columns", "input_value", "entity_id", "status", "--out", f"{path}-out"])
    listed = "pathway_annotations" in said.getvalue()
    return spark.read.option("header", True).csv(f"{path}-out").select("input_value", "entity_id", "status", F.lit(verified).alias("verified"), F.lit(listed).alias("listed"))


@query("SELECT x, round(sqrt(x) * 2, 6)::DOUBLE AS own, round(ln(1 + x), 6)::DOUBLE AS log1p, CASE WHEN x <= 10 THEN '(0, 10]' WHEN x <= 20 THEN '(10, 20]' END AS edges, CASE WHEN x <= 12 THEN 'low' ELSE 'high' END AS widths FROM (SELECT n_nationkey::DOUBLE AS x FROM nation)")
def m1_m2_edges_and_functions(spark, sf):
    """Given edges, equal widths, log1p and a function of one's own."""
    from ..types import Phenotypes

    p = Phenotypes(table(spark, sf, "nation").select(F.col("n_nationkey").alias("sample_id"), F.col("n_nationkey").cast("double").alias("x")))
    p = M.transform(M.transform(p, "x", func=lambda s: np.sqrt(s) * 2, new_col="own"), "x", "log1p", new_col="log1p")
    p = M.discretize(M.discretize(p, "x", "bins", bin_edges=[0, 10, 20], new_col="edges"), "x", "bins", n_bins=2, labels=["low", "high"], new_col="widths")
    return p.df.select("x", F.round("own", 6).alias("own"), F.round("log1p", 6).alias("log1p"), "edges", "widths")
