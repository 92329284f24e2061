"""The facade, plot dispatchers and error surfaces."""

import re
import unicodedata

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sparkome.functions.text import normalize
from sparkome.operators import describe as D, modify as M, plotdata as P
from sparkome.plans.domain import genotypes, p_values, phenotypes
from sparkome.session import Session
from sparkome.types import RegressionResults

SF = "/root/testdata/sf0.001"


def test_facade(spark, tmp_path):
    with Session(spark) as s:
        spark.range(3).selectExpr("id as sample_id", "id * 2.0 as x").write.parquet(str(tmp_path / "t.parquet"))
        phen = s.data.read_phenotypes(str(tmp_path / "t.parquet"), exposures=["x"])
        assert s.describe.summarize(phen).first().n == 3 and s.report.list() and callable(s.report.gene_annotations)
        assert phen.role("exposures").columns == ["sample_id", "x"]
        assert s.modify.filter_samples(phen, spark.createDataFrame([("1",)], "id string")).df.count() == 1


def test_plot_dispatch(spark):
    r = RegressionResults(p_values(spark, SF))
    kind, df = P.from_results(r)
    assert kind == "manhattan" and df.where("is_top").count() == 0
    assert P.manhattan(p_values(spark, SF), top=3, label="id").where("is_top").count() == 3
    assert P.from_results(r, "qq")[0] == "qq" and P.qq(p_values(spark, SF), band=0.95).where("low <= expected and expected <= high").count() > 0
    phen = phenotypes(spark, SF)
    for kind in ("box", "violin", "qq", "levels"):
        assert P.distribution(phen, "acctbal", kind).count() > 0
    assert P.suggest(phen) and P.suggest(genotypes(spark, SF)) and P.suggest(r) and P.suggest(1) == ()
    with pytest.raises(ValueError):
        P.distribution(phen, "acctbal", "no")


def test_error_surfaces(spark):
    phen = phenotypes(spark, SF)
    with pytest.raises(KeyError):
        D.summarize(phen, ["none"])
    with pytest.raises(TypeError):
        M.transform(phen, "segment", "log")
    with pytest.raises(TypeError):
        M.filter_samples([], phen.df)
    with pytest.raises(ValueError):
        M.make_binary(phen, only=["segment"])
    with pytest.raises(ValueError):
        D.summarize(M.colfilter(phen, skip=["weight"]), weighted=True)
    with pytest.raises(ValueError):
        M.move_variables(phen, phen.with_df(phen.df.limit(3)), ["segment"])


def test_empty_and_missing(spark):
    phen = phenotypes(spark, SF)
    none = phen.with_df(phen.df.where("false"))
    assert D.summarize(none).count() == 0 and D.missing_report(none).count() == 0 and D.value_counts(none, ["segment"]).count() == 0
    gone = phen.with_df(phen.df.withColumn("acctbal", F.lit(None).cast("double")))
    row = D.summarize(gone, ["acctbal"]).first()
    assert (row.n_missing, row.n_unique, row.mean, row.n_outliers) == (row.n, 0, None, None) and row.near_zero_var
    nan = phen.with_df(phen.df.withColumn("acctbal", F.lit(float("nan"))))
    assert D.summarize(nan, ["acctbal"]).first().n_missing == phen.df.count()  # NaN is missing


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_normal_forms_by_their_definition(text):
    """Each step as it is said, character by character."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    assert normalize(text) == re.sub(r"[-_/\s]+", " ", plain).strip()
