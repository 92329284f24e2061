"""Data model: phenotype tables with roles, genotypes in long form, association results."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F, types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, NUMERIC)


def number(df: DataFrame, name: str) -> Column:
    """The column as a double, NaN as null: one kind of missing value inside the library."""
    c = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(c), c)


def corr(x: Column, y: Column) -> Column:
    """Pearson correlation of columns that are null together; null where one of them doesn't vary."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def broadcast_if_small(df: DataFrame, most_rows: int = 1_000_000) -> DataFrame:
    """df marked for broadcast if it has been counted to hold at most most_rows; else Spark joins it as its sizes say."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


@dataclass(frozen=True)
class Phenotypes:
    """A wide samples x variables table with the roles of its columns. Every role must name a column."""

    df: DataFrame
    sample_id: str = "sample_id"
    outcomes: tuple[str, ...] = ()
    covariates: tuple[str, ...] = ()
    exposures: tuple[str, ...] = ()
    weights: str | None = None
    strata: str | None = None
    cluster: str | None = None

    def __post_init__(self):
        for role in ("outcomes", "covariates", "exposures"):
            object.__setattr__(self, role, tuple(getattr(self, role)))
        wanted = [self.sample_id, *self.outcomes, *self.covariates, *self.exposures, *(x for x in (self.weights, self.strata, self.cluster) if x)]
        if missing := [c for c in wanted if c not in self.df.columns]:
            raise ValueError(f"columns not in the table: {missing}")

    def with_df(self, df: DataFrame) -> Phenotypes:
        """The same roles over another table; roles whose columns are gone are dropped."""
        have = set(df.columns)
        keep = lambda names: tuple(c for c in names if c in have)
        one = lambda name: name if name in have else None
        return replace(self, df=df, outcomes=keep(self.outcomes), covariates=keep(self.covariates), exposures=keep(self.exposures), weights=one(self.weights), strata=one(self.strata), cluster=one(self.cluster))

    def role(self, name: str) -> DataFrame:
        """Sample id and the columns of `outcomes`, `covariates` or `exposures`."""
        return self.df.select(self.sample_id, *getattr(self, name))

    @property
    def variables(self) -> list[str]:
        return [c for c in self.df.columns if c != self.sample_id]

    def select_samples(self, ids: DataFrame, keep: bool = True) -> Phenotypes:
        """Rows whose id, as text, is (or isn't) in the first column of ids."""
        wanted = ids.select(F.col(f"`{ids.columns[0]}`").cast("string").alias("__id")).distinct()
        how = "left_semi" if keep else "left_anti"
        return replace(self, df=self.df.join(wanted, F.col(f"`{self.sample_id}`").cast("string") == F.col("__id"), how))


@dataclass(frozen=True)
class Genotypes:
    """variants(variant_idx, variant_id, contig, position, alleles array) and calls(variant_idx, sample_id, gt array; -1 is missing)."""

    variants: DataFrame
    calls: DataFrame

    def listing(self) -> DataFrame:
        return self.variants.select("variant_id", "contig", "position", F.get("alleles", F.lit(0)).alias("ref"), F.concat_ws(",", F.slice("alleles", F.lit(2), F.greatest(F.size("alleles") - 1, F.lit(0)))).alias("alt"))

    def select(self, samples: DataFrame | None = None, variants: DataFrame | None = None, keep: bool = True) -> Genotypes:
        """Membership by id (first column of each frame); keep=False removes what is named."""
        how, out = "left_semi" if keep else "left_anti", self
        if variants is not None:
            ids = variants.select(F.col(f"`{variants.columns[0]}`").cast("string").alias("__id")).distinct()
            left = self.variants.join(ids, F.col("variant_id").cast("string") == F.col("__id"), how)
            out = Genotypes(left, self.calls.join(left.select("variant_idx"), "variant_idx", "left_semi"))
        if samples is not None:
            ids = samples.select(F.col(f"`{samples.columns[0]}`").cast("string").alias("__id")).distinct()
            out = Genotypes(out.variants, out.calls.join(ids, F.col("sample_id").cast("string") == F.col("__id"), how))
        return out


ASSOCIATION = "outcome string, variable string, variable_type string, n long, beta double, se double, ci_low double, ci_high double, beta_pvalue double, lrt_pvalue double, diff_aic double, converged boolean, error string"
INTERACTION = "outcome string, term1 string, term2 string, n long, lrt_chi2 double, lrt_df long, lrt_pvalue double, diff_aic double, converged boolean, error string"
INTERACTION_TERMS = INTERACTION + ", term string, term_beta double, term_se double, term_beta_pvalue double"
SUMSTATS = ("variant_id", "chrom", "pos", "effect_allele", "other_allele", "beta", "se", "pval", "n", "eaf")


@dataclass(frozen=True)
class RegressionResults:
    """Results of a study and how they were made; every method gives a new object."""

    df: DataFrame
    metadata: dict = field(default_factory=dict)

    @property
    def errors(self) -> DataFrame:
        return self.df.where(F.col("error").isNotNull()) if "error" in self.df.columns else self.df.where("false")

    @property
    def p_column(self) -> str:
        for c in ("beta_pvalue", "p_value", "lrt_pvalue"):
            if c in self.df.columns:
                return c
        raise ValueError("no column of p-values")
