"""Special functions against published values, models against closed forms and simulated effects."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkome.functions import special as S
from sparkome.operators import describe as D, genotypes as G, models as A, modify as M, results as R
from sparkome.types import Genotypes, Phenotypes, RegressionResults


def test_special_functions():
    assert S.norm_cdf(1.96) == pytest.approx(0.9750021049, abs=1e-9) and S.norm_ppf(0.975) == pytest.approx(1.9599639845, abs=1e-9)
    assert S.chi2_sf(3.841458821, 1) == pytest.approx(0.05, abs=1e-9) and S.chi2_sf(11.0704976935, 5) == pytest.approx(0.05, abs=1e-9) and S.chi2_sf(2.0, 4) == pytest.approx(0.7357588823, abs=1e-9)
    assert S.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8) and S.beta_i(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-9)
    assert S.beta_i(2, 5, S.beta_ppf(0.3, 2, 5)) == pytest.approx(0.3, abs=1e-9)
    assert math.isnan(S.norm_ppf(2)) and math.isnan(S.chi2_sf(-1, 2)) and S.skew_test(0.1, 5)[0] != S.skew_test(0.1, 5)[0]


def test_hardy_weinberg_against_enumeration():
    for het, a, b in ((57, 14, 50), (0, 30, 70), (5, 0, 1), (50, 25, 25)):
        n, rare = het + a + b, 2 * min(a, b) + het
        weight = {k: math.comb(n, k) * math.comb(n - k, (rare - k) // 2) * 2**k for k in range(rare % 2, rare + 1, 2)}
        total = sum(weight.values())
        want = sum(w for w in weight.values() if w <= weight[het]) / total
        assert S.hwe_exact(het, a, b) == pytest.approx(want, rel=1e-6)


def test_hommel_and_kendall_against_brute_force():
    r = random.Random(1)
    for _ in range(20):
        p = [r.random() ** 2 for _ in range(6)]

        def closed(k):  # the largest Simes p-value of all sets that hold k
            best = 0
            for mask in range(1, 64):
                if mask >> k & 1:
                    s = sorted(p[j] for j in range(6) if mask >> j & 1)
                    best = max(best, min(len(s) * v / (i + 1) for i, v in enumerate(s)))
            return min(1, best)

        assert S.hommel(np.array(p)).tolist() == pytest.approx([closed(k) for k in range(6)])
        x, y = [r.randrange(6) for _ in range(40)], [r.randrange(5) for _ in range(40)]
        sign = lambda v: (v > 0) - (v < 0)
        pairs = [(sign(x[i] - x[j]), sign(y[i] - y[j])) for i in range(40) for j in range(i)]
        want = sum(a * b for a, b in pairs) / math.sqrt(sum(a != 0 for a, _ in pairs) * sum(b != 0 for _, b in pairs))
        assert S.kendall_tau_b(np.array(x), np.array(y)) == pytest.approx(want)


@pytest.fixture(scope="module")
def cohort(spark):
    r = np.random.default_rng(0)
    rows = []
    for k in range(400):
        age, bmi, sex, null = r.uniform(20, 70), r.normal(27, 4), int(r.integers(0, 2)), r.normal()
        glucose = 80 + 0.5 * age + 2 * bmi + 5 * sex + r.normal(0, 5)
        ill = int(r.random() < 1 / (1 + math.exp(7 - 0.04 * age - 0.15 * bmi)))
        rows.append((f"S{k}", age, bmi if k % 50 else None, sex, null, glucose, ill, r.choice(["a", "b", "c"]).item(), float(r.integers(1, 3)), k % 7))
    df = spark.createDataFrame(rows, "sample_id string, age double, bmi double, sex int, noise double, glucose double, ill int, race string, w double, psu int")
    return Phenotypes(df, outcomes=["glucose"], covariates=["age", "sex"], exposures=["bmi", "noise"], weights="w", cluster="psu")


def test_effects_are_recovered(cohort):
    got = {r.variable: r for r in A.association_study(cohort).df.collect()}
    assert abs(got["bmi"].beta - 2) < 0.3 and got["bmi"].beta_pvalue < 1e-10 and got["bmi"].n == 392 and got["bmi"].converged
    assert got["noise"].beta_pvalue > 1e-4 and got["bmi"].variable_type == "continuous"
    ill = {r.variable: r for r in A.association_study(cohort, ["ill"]).df.collect()}
    assert ill["bmi"].beta > 0 and ill["bmi"].beta_pvalue < 0.05


def test_sums_of_products_equal_the_fit(cohort):
    """The distributed path and the fit on all rows give the same, weighted or not."""
    for survey in (False, True):
        phen = Phenotypes(cohort.df, outcomes=["glucose"], covariates=["age", "sex"], exposures=["bmi", "noise", "sex"], weights="w")
        a = A.association_study(phen, regression_variables=["bmi", "noise"], use_survey=survey).df.orderBy("variable").collect()
        b = A.association_study(phen, regression_variables=["bmi", "noise"], use_survey=survey, regression_kind=lambda *x: A.fit_glm(*x)).df.orderBy("variable").collect()
        for x, y in zip(a, b, strict=True):
            for c in ("n", "beta", "se", "ci_low", "beta_pvalue", "lrt_pvalue", "diff_aic"):
                assert x[c] == pytest.approx(y[c], rel=1e-6, abs=1e-12), c


def test_fit_equals_closed_forms():
    r = np.random.default_rng(2)
    x = np.column_stack([np.ones(60), r.normal(size=60)])
    y = x @ [1, 2] + r.normal(size=60)
    w = r.integers(1, 4, 60).astype(float)
    a, b = A.fit_glm(y, x, "linear", w), A.fit_glm(np.repeat(y, w.astype(int)), np.repeat(x, w.astype(int), axis=0), "linear")
    assert a.beta == pytest.approx(b.beta) and a.se == pytest.approx(b.se) and a.llf == pytest.approx(b.llf)  # frequency weights are repeated rows
    z = (r.random(60) < 0.5).astype(float)
    p = z.mean()
    assert A.fit_glm(z, np.ones((60, 1)), "logistic").beta[0] == pytest.approx(math.log(p / (1 - p)))
    robust = A.fit_glm(y, x, "linear", None, np.arange(60))
    e = y - x @ A.fit_glm(y, x, "linear").beta
    bread = np.linalg.inv(x.T @ x)
    assert robust.cov == pytest.approx(60 / 59 * 59 / 58 * bread @ (x * e[:, None]).T @ (x * e[:, None]) @ bread)


def test_categories_errors_and_interactions(cohort, spark):
    r = A.association_study(cohort, regression_variables=["race"], report_categorical_betas=True).df.collect()
    assert [x.variable_type for x in r] == ["categorical", "categorical_dummy", "categorical_dummy"] and r[0].beta is None
    bad = cohort.with_df(cohort.df.withColumn("empty", F.lit(None).cast("double")).withColumn("flat", F.lit(1.0)))
    e = {x.variable: x for x in A.association_study(bad, regression_variables=["empty", "flat", "bmi"]).df.collect()}
    assert e["empty"].error and e["flat"].error and not e["bmi"].error
    assert A.association_study(cohort, min_n=10_000).errors.count() == 2
    i = A.interaction_study(cohort, interactions=[("bmi", "race")], report_betas=True, min_n=50).df.collect()
    assert len(i) == 2 and i[0].lrt_df == 2 and 0 <= i[0].lrt_pvalue <= 1
    assert A.lrt(cohort, "glucose", ["age", "bmi"], ["age"]).first().p_value < 1e-20
    assert A.lrt(cohort, "ill", ["age", "bmi"], ["age"]).first().df == 1
    for call in (lambda: A.lrt(cohort, "glucose", ["age"], ["bmi"]), lambda: A.resolve_engine("x"), lambda: A.resolve_pairs(["a"] * 60, None, 10), lambda: A.association_study(cohort, covariates=["race"])):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(NotImplementedError):
        A.resolve_engine("r_survey")
    assert A.infer_family(cohort.df, ["ill", "glucose"]) == {"ill": "logistic", "glucose": "linear"}
    ew = A.ewas(cohort, "glucose")
    assert ew.df.columns == ["variable", "n", "beta", "se", "ci_low", "ci_high", "p_value"]
    fixed = R.with_correction(ew, "holm")
    assert R.passing(fixed, p_corrected=0.05).df.count() == 1 and R.top(ew, 1).first().variable == "bmi" and R.summary(ew).first().n_tests == 2
    note = spark.createDataFrame([("bmi", "G1", "H1"), ("bmi", "G2", "H2")], "input_value string, gene_symbol string, hgnc_id string")
    assert R.annotate(ew, note).df.where("variable = 'bmi'").first().gene_symbol == "G1"


@pytest.fixture(scope="module")
def geno(spark):
    r = np.random.default_rng(3)
    v = [(k, f"rs{k}", "1" if k < 3 else "2", 1000 * (k + 1), ["A", "G"] if k != 4 else ["A", "GT"]) for k in range(6)]
    g = r.binomial(1, 0.4, (6, 400, 2))
    g[1] = g[0]  # in full linkage
    g[5, :200] = -1
    calls = [(k, f"S{s}", [int(x) for x in g[k, s]]) for k in range(6) for s in range(400)]
    return Genotypes(spark.createDataFrame(v, "variant_idx long, variant_id string, contig string, position long, alleles array<string>"), spark.createDataFrame(calls, "variant_idx long, sample_id string, gt array<int>")), g


def test_gwas_equals_least_squares(geno, cohort, spark):
    gen, g = geno
    dose = spark.createDataFrame([(f"S{s}", float(g[2, s].sum())) for s in range(400)], "sample_id string, d double")
    phen = Phenotypes(cohort.df.join(dose, "sample_id").withColumn("y", F.col("glucose") + 4 * F.col("d")), covariates=["age"])
    got = {r.variable: r for r in A.gwas(gen, phen, "y").df.collect()}
    assert abs(got["rs2"].beta - 4) < 1.5 and got["rs2"].p_value < 1e-3 and got["rs2"].n == 400
    rows = {r.sample_id: r for r in phen.df.collect()}
    x = np.array([[1, rows[f"S{s}"].age, g[0, s].sum()] for s in range(400)], float)
    fit = A.fit_glm(np.array([rows[f"S{s}"].y for s in range(400)]), x, "linear")
    assert got["rs0"].beta == pytest.approx(fit.beta[2], rel=1e-6) and got["rs0"].se == pytest.approx(fit.se[2], rel=1e-6)
    with pytest.raises(NotImplementedError):
        A.gwas(gen, phen, "y", family="logistic")
    by = {r.variable: r for r in A.association_study(phen, ["y"], geno=gen, covariates=["age"]).df.collect()}
    assert by["rs0"].beta == pytest.approx(fit.beta[2], rel=1e-6)
    assert A.association_study(phen, ["y"], ["rs0"], geno=gen, covariates=["age"], encoding="codominant").df.first().variable_type == "categorical"


def test_genotype_filters(geno):
    gen, _ = geno
    ids = lambda x: sorted(r[0] for r in x.variants.select("variant_id").collect())
    assert ids(G.keep_snvs_only(gen)) == ["rs0", "rs1", "rs2", "rs3", "rs5"]
    assert ids(G.filter_missingness_variants(gen)) == ["rs0", "rs1", "rs2", "rs3", "rs4"]
    assert "rs1" not in ids(G.prune_ld(gen)) and "rs0" in ids(G.prune_ld(gen))
    assert "rs1" not in ids(G.prune_ld(gen, window=10, unit="kb"))
    assert ids(G.filter_by_region(gen, "2", 4000, 5000)) == ["rs3", "rs4"]
    for call in (lambda: G.filter_by_region(gen, "9"), lambda: G.filter_maf(gen, 0.9)):
        with pytest.raises(ValueError):
            call()


def _sparse_calls(seed: int, contigs: int, variants: int, samples: int):
    """(variant_idx, contig, position) and {variant_idx: {sample: (a1, a2)}}: each variant is called in a few samples, some calls are missing, many are like the call before."""
    r = random.Random(seed)
    places, calls = [], {}
    for c in range(contigs):
        last: dict = {}
        for k in range(variants):
            v = c * variants + k
            places.append((v, str(c), k * 700 + r.randrange(600)))
            calls[v] = {s: last.get(s, (0, 1)) if r.random() < 0.6 else r.choice([(0, 0), (0, 1), (1, 1), (-1, -1)]) for s in r.sample(range(samples), r.randrange(0, 9))}
            last |= calls[v]
    return places, calls


def _pruned_by_hand(places, calls, width: int, step: int, r2: float, by_rank: bool) -> set:
    kept = set()
    for c in {p[1] for p in places}:
        row = sorted((p for p in places if p[1] == c), key=lambda p: (p[2], p[0]))
        at = {p[0]: k if by_rank else p[2] for k, p in enumerate(row)}
        stay: list = []
        for j, _, _ in row:
            linked = False
            for i in stay:
                both = [(sum(calls[i][s]), sum(calls[j][s])) for s in calls[i].keys() & calls[j].keys() if min(*calls[i][s], *calls[j][s]) >= 0]
                if at[j] - at[i] // step * step < width and len(both) > 1:
                    x, y = np.array(both, float).T
                    linked |= x.var() > 1e-12 and y.var() > 1e-12 and np.cov(x, y, bias=True)[0, 1] ** 2 > r2 * x.var() * y.var() + 1e-12
            if not linked:
                stay.append(j)
        kept |= set(stay)
    return kept


def _pruning(spark, places, calls) -> Genotypes:
    v = spark.createDataFrame([(i, f"rs{i}", c, p, ["A", "G"]) for i, c, p in places], "variant_idx long, variant_id string, contig string, position long, alleles array<string>")
    return Genotypes(v, spark.createDataFrame([(i, f"S{s}", list(gt)) for i, row in calls.items() for s, gt in row.items()], "variant_idx long, sample_id string, gt array<int>"))


@pytest.mark.parametrize("together", [10**6, 150, 6])
def test_pruning_puts_blocks_together_and_deals_large_ones_by_sample(spark, monkeypatch, together):
    monkeypatch.setattr(G, "LD_CALLS", together)  # one tile a contig, several, and tiles of one block in chunks of samples
    places, calls = _sparse_calls(3, 2, 120, 12)
    got = {r[0] for r in G.prune_ld(_pruning(spark, places, calls), window=10, step=3, r2=0.2).variants.select("variant_idx").collect()}
    assert got == _pruned_by_hand(places, calls, 10, 3, 0.2, True) and 20 < len(got) < 220


def test_pruning_sends_links_only(spark):
    """A task that has all calls of its pairs gives one row for each variant with links, not the sums of every pair."""
    import pyarrow as pa

    n = 300
    r = np.random.default_rng(5)
    table = pa.table({"contig": ["1"] * n, "variant_idx": np.arange(n), "at": np.arange(n), "own": np.ones(n, bool), "samples": pa.array([list(range(40))] * n), "ds": pa.array(r.integers(0, 3, (n, 40)).tolist(), pa.list_(pa.int32()))})
    out = G._links(50, 5, 0.2)(table)
    assert 0 < out.num_rows < n and 0 < len(out["before"].combine_chunks().flatten()) < 500  # of about 14,000 pairs


@pytest.mark.parametrize("together", [10**6, 40])
def test_pruning_by_distance_puts_many_small_blocks_in_a_tile(spark, monkeypatch, together):
    monkeypatch.setattr(G, "LD_CALLS", together)
    places, calls = _sparse_calls(4, 2, 120, 10)
    places = [(i, c, p + 50_000 * (p > 40_000)) for i, c, p in places]  # a gap of several blocks
    got = {r[0] for r in G.prune_ld(_pruning(spark, places, calls), window=6, step=4, r2=0.4, unit="kb").variants.select("variant_idx").collect()}
    assert got == _pruned_by_hand(places, calls, 6000, 4000, 0.4, False) and 20 < len(got) < 235
    counted = spark.createDataFrame([("1", b, 10) for b in range(1000) if b != 500], "contig string, block long, calls long")
    tiles = {r.block: r for r in G._tiles(counted).collect()}
    assert len({t.tile for t in tiles.values()}) == (1 if together > 40 else 250) and tiles[501].before is None
    assert all(t.before == (tiles[b - 1].tile if b and b != 501 and tiles[b - 1].tile != t.tile else None) for b, t in tiles.items())


def test_quantiles_and_transforms(spark):
    r = random.Random(4)
    values = [r.gauss(0, 1) for _ in range(3000)] + [0.5] * 500
    df = spark.createDataFrame([(k, v if k % 9 else None) for k, v in enumerate(values)], "sample_id long, x double")
    want = df.agg(F.percentile("x", F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.9, 1.0)]))).first()[0]
    assert D.exact_quantiles(df, "x", [0.0, 0.25, 0.5, 0.9, 1.0], accuracy=100) == pytest.approx(want)
    assert D.exact_quantiles(df.where("x > 1000"), "x", [0.5]) == [None]
    phen = Phenotypes(df)
    ranks = {r_.x: r_.x_rank_int for r_ in M.transform(phen, "x", "rank_int").df.where("x is not null").collect()}
    known = sorted(v for k, v in enumerate(values) if k % 9)
    at = lambda v: S.norm_ppf(((known.index(v) + 1 + known.index(v) + known.count(v)) / 2 - 0.5) / len(known))
    for v in (known[0], known[700], 0.5, known[-1]):
        assert ranks[v] == pytest.approx(at(v))
    pos = Phenotypes(spark.createDataFrame([(k, math.exp(r.gauss(0, 1))) for k in range(500)], "sample_id long, x double"))
    assert abs(M._boxcox_lambda(pos.df, F.col("x"))) < 0.15  # log-normal: about the logarithm
    for call in (lambda: M.transform(phen, "x"), lambda: M.discretize(phen, "x", "no"), lambda: M.merge_observations(phen, phen), lambda: Phenotypes(df, outcomes=["none"])):
        with pytest.raises(ValueError):
            call()
    assert M.transform(phen, "x", func=lambda s: s * 2).df.where("x = 0.5").first().x_transformed == 1.0


def test_fits_over_cells_equal_fits_of_rows(spark, monkeypatch):
    """Logistic studies, interactions and likelihood ratios by Newton steps over all rows, against each test's rows in one place."""
    r = np.random.default_rng(3)
    n = 1200
    x, z, g, h = r.normal(size=n), r.normal(size=n), r.choice(["", "a", "b"], n), r.choice(["u", "v"], n)
    y = (r.random(n) < 1 / (1 + np.exp(-(0.4 * x - 0.3 * z + 0.5 * (g == "b") + 0.3 * x * (h == "v"))))).astype(int)
    rows = [(k, int(y[k]), float(x[k]), None if k % 50 == 0 else float(z[k]), g[k], h[k], float(k % 2), 1.0 + k % 3, 1.0) for k in range(n)]
    df = spark.createDataFrame(rows, "sample_id int, y int, x double, z double, g string, h string, bin double, w double, one double")
    p = Phenotypes(df, outcomes=["y"], covariates=["z"], exposures=["x", "g", "bin", "one"], weights="w")
    pairs = [("x", "bin"), ("x", "g"), ("g", "x"), ("g", "h")]
    calls = [
        lambda: A.association_study(p, min_n=20, report_categorical_betas=True).df,
        lambda: A.association_study(p, min_n=20, use_survey=True).df,
        lambda: A.interaction_study(p, interactions=pairs, min_n=20, report_betas=True).df,
        lambda: A.interaction_study(p, interactions=pairs, min_n=20, family="linear").df,
        lambda: A.lrt(p, "y", ["x", "z", "bin"], ["z"]),
    ]
    local = [sorted(c().collect(), key=str) for c in calls]
    monkeypatch.setattr(A, "LOCAL_ROWS", 0)
    for call, want in zip(calls, local, strict=True):
        got = sorted(call().collect(), key=str)
        assert len(got) == len(want) > 0
        for a, b in zip(got, want, strict=True):
            for c in a.asDict():
                if isinstance(b[c], float):
                    assert a[c] == pytest.approx(b[c], rel=1e-5, abs=1e-6), c
                elif c != "error":
                    assert a[c] == b[c], c
            assert ("error" not in a.asDict()) or (a["error"] is None) == (b["error"] is None)
    assert {x["variable"] for x in local[0] if x["error"]} == {"one"}


def test_corrections_of_tables_with_untyped_columns(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, None)], "id int, p double").withColumns({"none": F.lit(None), "a b": F.lit(1)})
    got = {r.id: r.q for r in R.corrected(df, "p", "fdr_bh", out="q").collect()}
    assert got == {1: pytest.approx(0.02), 2: pytest.approx(0.04), 3: None}
