"""One object with the library's parts, for interactive use."""

from __future__ import annotations

from functools import partial
from types import SimpleNamespace

from pyspark.sql import SparkSession

from .operators import describe, genotypes, models, modify, plotdata, results
from .plans import kg, nlp
from .sources import arrays, genotypes as genotype_files, snapshot, tables


class Session:
    """data, describe, modify, analyze, plot, report, nlp and snapshots over a SparkSession."""

    def __init__(self, spark: SparkSession | None = None):
        self.spark = spark or SparkSession.builder.getOrCreate()
        bound = lambda f: partial(f, self.spark)
        self.data = SimpleNamespace(read_table=bound(tables.read_table), read_phenotypes=bound(tables.read_phenotypes), read_nhanes_xpt=bound(tables.read_nhanes_xpt), read_sumstats=bound(tables.read_sumstats), read_identifiers=bound(tables.read_identifiers), read_plink=bound(genotype_files.read_plink), read_vcf=bound(genotype_files.read_vcf), read_genotypes=bound(genotype_files.read_genotypes), write_genotypes=genotype_files.write_genotypes, read_zarr=bound(arrays.read_zarr), read_sql=bound(tables.read_sql), fetch=bound(tables.fetch))
        self.describe = SimpleNamespace(summarize=describe.summarize, summarize_by=describe.summarize_by, missing_report=describe.missing_report, correlation_matrix=describe.correlation_matrix, correlation_pairs=describe.correlation_pairs, crosstab=describe.crosstab, value_counts=describe.value_counts, dataset_summary=describe.dataset_summary, skewness=describe.skewness, variant_stats=genotypes.variant_stats, sample_stats=genotypes.sample_stats, heterozygosity=genotypes.heterozygosity, genotype_summary=genotypes.genotype_summary)
        self.modify = modify
        self.filters = genotypes
        self.analyze = SimpleNamespace(association_study=models.association_study, ewas=models.ewas, gwas=models.gwas, lrt=models.lrt, interaction_study=models.interaction_study)
        self.results = results
        self.plot = plotdata
        self.report = SimpleNamespace(list=kg.list_reports, explain=kg.explain, run=kg.run_report, **{name: partial(kg.run_report, name=name) for name in kg.REPORTS})
        self.nlp = nlp
        self.snapshot = SimpleNamespace(export=bound(snapshot.export), open=bound(snapshot.open_snapshot), verify=bound(snapshot.verify), download=bound(snapshot.download))

    def __enter__(self) -> Session:
        return self

    def __exit__(self, *_) -> None:
        return None
