"""The knowledge graph: entities, aliases, relationships and locations as tables; upserts as anti-joins; reports as one lazy plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.text import normalized, normalized_ascii
from ..sources.workspace import written
from ..types import broadcast_if_small
from .ids import numbered

# The entity types and their domains.
ENTITY_TYPES = (
    (1, "Variants", "Genomics"), (2, "Genes", "Genomics"), (3, "Proteins", "Genomics"), (4, "Transcriptomics", "Genomics"), (5, "Epigenomics", "Genomics"),
    (6, "Pathways", "Knowledge"), (7, "Gene Ontology", "Knowledge"), (8, "Diseases", "Exposome"), (9, "Chemicals", "Exposome"), (10, "Phenotypes", "Exposome"),
    (11, "Exposome", "Exposome"), (12, "Metabolomics", "Exposome"), (13, "Microbiome", "Genomics"), (14, "Anatomy", "Knowledge"),
)
GENES = 2
SCHEMAS = {
    "entity_types": "type_id int, name string, domain string",
    "entities": "entity_id long, type_id int, is_active boolean, source string, package_id long",
    "aliases": "alias_id long, entity_id long, type_id int, alias_type string, xref_source string, alias_value string, alias_norm string, is_primary boolean, is_active boolean, source string, package_id long",
    "relationships": "relationship_id long, entity_1_id long, entity_1_type_id int, entity_2_id long, entity_2_type_id int, relation string, source string, evidence_count long, confidence double, package_id long, is_active boolean",
    "locations": "entity_id long, assembly string, chromosome int, start_position long, end_position long, strand string, package_id long",
}
MAX_VALUE, MAX_SHORT = 1000, 255


@dataclass(frozen=True)
class KnowledgeGraph:
    entity_types: DataFrame
    entities: DataFrame
    aliases: DataFrame
    relationships: DataFrame
    locations: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> KnowledgeGraph:
        return cls(spark.createDataFrame(ENTITY_TYPES, SCHEMAS["entity_types"]), *[spark.createDataFrame([], SCHEMAS[t]) for t in ("entities", "aliases", "relationships", "locations")])


def guarded(col: Column, size: int = MAX_VALUE) -> Column:
    """Trimmed, cut to the table's width, blank as null."""
    x = F.substring(F.trim(col.cast("string")), 1, size)
    return F.when(x != "", x)


def truncation_counts(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """One row: how many values of each column are wider than their table allows."""
    return df.agg(*[F.count_if(F.length(F.trim(F.col(c).cast("string"))) > n).alias(c) for c, n in widths.items()])


# Ranges that rows must keep.
CHECKS = {
    "relationships": "confidence is null or confidence between 0 and 1",
    "locations": "chromosome between 1 and 25 and (end_position is null or start_position is null or end_position >= start_position)",
    "variants": "(af is null or af between 0 and 1) and (ac is null or an is null or ac <= an)",
    "associations": "p_value is null or p_value between 0 and 1",
}


def validate(df: DataFrame, check: str) -> tuple[DataFrame, DataFrame]:
    """Rows that keep a check (a name of CHECKS or a condition), and the rows in quarantine; a check that can't be decided fails."""
    ok = F.coalesce(F.expr(CHECKS.get(check, check)), F.lit(False))
    return df.where(ok), df.where(~ok)


def seed(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new by key over old ones, where they aren't null; rows whose key has a null are left out."""
    new = new.na.drop(subset=keys).dropDuplicates(keys)
    rest = [c for c in old.columns if c not in keys]
    both = old.alias("a").join(new.alias("b"), keys, "full")
    return both.select(*keys, *[F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) if c in new.columns else F.col(f"a.{c}") for c in rest]).select(*old.columns)


def _max_id(df: DataFrame, col: str) -> int:
    return df.agg(F.max(col)).first()[0] or 0


KEY = ["alias_value", "alias_type", "xref_source"]


def get_or_create_entities(kg: KnowledgeGraph, new: DataFrame, *, source: str, package_id: int = 0) -> KnowledgeGraph:
    """Entities for rows (alias_value, alias_type, xref_source, type_id) whose primary alias isn't there; the type is no part of the key."""
    new = new.select(guarded(F.col("alias_value")).alias("alias_value"), "alias_type", "xref_source", "type_id").where("alias_value is not null")
    new = new.groupBy(*KEY).agg(F.min("type_id").alias("type_id"))
    have = kg.aliases.where("is_primary").select(*[F.col(k).alias(f"__{k}") for k in KEY])
    missing = new.join(have, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in KEY], "left_anti")
    made = numbered(missing, KEY, "entity_id", _max_id(kg.entities, "entity_id") + 1)
    rows = numbered(made, ["entity_id"], "alias_id", _max_id(kg.aliases, "alias_id") + 1)
    const = {"is_active": F.lit(True), "is_primary": F.lit(True), "source": F.lit(source), "package_id": F.lit(package_id).cast("long")}
    full = rows.withColumns(const).withColumn("alias_norm", normalized(F.col("alias_value")))
    return replace(kg, entities=kg.entities.unionByName(full.select(*kg.entities.columns)), aliases=kg.aliases.unionByName(full.select(*kg.aliases.columns)))


def build_aliases(df: DataFrame, key: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """key, alias_value, alias_type, xref_source: every named column, lists element by element."""
    def named(kind: str, src: str):
        return lambda v: F.struct(v.alias("alias_value"), F.lit(kind).alias("alias_type"), F.lit(src).alias("xref_source"))

    parts = []
    for c, (kind, src) in fields.items():
        values = F.col(c).cast("array<string>") if dict(df.dtypes)[c].startswith("array") else F.array(F.col(c).cast("string"))
        parts.append(F.transform(values, named(kind, src)))
    return df.select(key, F.inline(F.flatten(F.array(*[F.coalesce(p, F.array().cast("array<struct<alias_value:string,alias_type:string,xref_source:string>>")) for p in parts])))).where("trim(alias_value) != ''")


def add_aliases(kg: KnowledgeGraph, new: DataFrame, *, source: str, package_id: int = 0) -> KnowledgeGraph:
    """Secondary aliases (entity_id, type_id, alias_value, alias_type, xref_source): skipped where the entity has the triple, or a repeated normal form in this call."""
    new = new.withColumn("alias_value", guarded(F.col("alias_value"))).where("alias_value is not null").withColumn("alias_norm", normalized(F.col("alias_value")))
    new = new.groupBy("entity_id", "alias_norm").agg(F.min(F.struct("alias_type", "xref_source", "alias_value", "type_id")).alias("a")).select("entity_id", "alias_norm", "a.*")
    keys = ["entity_id", *KEY]
    have = kg.aliases.select(*[F.col(k).alias(f"__{k}") for k in keys])
    new = new.join(have, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left_anti")
    rows = numbered(new, keys, "alias_id", _max_id(kg.aliases, "alias_id") + 1)
    rows = rows.withColumns({"is_primary": F.lit(False), "is_active": F.lit(True), "source": F.lit(source), "package_id": F.lit(package_id).cast("long")})
    return replace(kg, aliases=kg.aliases.unionByName(rows.select(*kg.aliases.columns)))


def canonical(df: DataFrame, gene_type: int = GENES) -> DataFrame:
    """Both ends in one order: a gene before what isn't one, else the smaller id first."""
    one, two = F.col("entity_1_type_id") == gene_type, F.col("entity_2_type_id") == gene_type
    swap = F.coalesce(F.when(one & ~two, False).when(two & ~one, True).otherwise(F.col("entity_1_id") > F.col("entity_2_id")), F.col("entity_1_id") > F.col("entity_2_id"))
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    ends = {n: pick(n, n.replace("_1_", "_2_") if "_1_" in n else n.replace("_2_", "_1_")) for n in ("entity_1_id", "entity_2_id", "entity_1_type_id", "entity_2_type_id")}
    return df.withColumn("__s", swap).select(*[ends[c].alias(c) if c in ends else F.col(c) for c in df.columns])


def add_relationships(kg: KnowledgeGraph, new: DataFrame, *, source: str, package_id: int = 0) -> KnowledgeGraph:
    """Edges (ends with types, relation, optional evidence_count and confidence) that (ends, relation, source) doesn't have yet."""
    for c, kind in (("evidence_count", "long"), ("confidence", "double")):
        if c not in new.columns:
            new = new.withColumn(c, F.lit(None).cast(kind))
    keys = ["entity_1_id", "entity_2_id", "relation"]
    new = canonical(new).groupBy(*keys).agg(F.max("evidence_count").alias("evidence_count"), F.max("confidence").alias("confidence"), F.min("entity_1_type_id").alias("entity_1_type_id"), F.min("entity_2_type_id").alias("entity_2_type_id"))
    have = kg.relationships.where(F.col("source") == source).select(*[F.col(k).alias(f"__{k}") for k in keys])
    new = new.join(have, [F.col(k) == F.col(f"__{k}") for k in keys], "left_anti")
    rows = numbered(new, keys, "relationship_id", _max_id(kg.relationships, "relationship_id") + 1)
    rows = rows.withColumns({"source": F.lit(source), "package_id": F.lit(package_id).cast("long"), "is_active": F.lit(True)})
    return replace(kg, relationships=kg.relationships.unionByName(rows.select(*kg.relationships.columns)))


def upsert_locations(old: DataFrame, new: DataFrame) -> DataFrame:
    """New places over old ones by (entity, assembly)."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    best = F.row_number().over(Window.partitionBy("entity_id", "assembly").orderBy(F.desc("__new"), F.asc_nulls_last("start_position")))
    return both.withColumn("__r", best).where("__r = 1").drop("__r", "__new")


def fill_null_only(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Values of new where old has none."""
    one = new.groupBy(key).agg(*[F.first(c, ignorenulls=True).alias(c) for c in new.columns if c != key])
    both = old.alias("a").join(one.alias("b"), key, "left")
    return both.select(*[F.col(key) if c == key else F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) if c in one.columns else F.col(f"a.{c}").alias(c) for c in old.columns])


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """INSERT ... SELECT DISTINCT ... ON CONFLICT DO NOTHING."""
    fresh = new.dropDuplicates(keys).join(old.select(*[F.col(k).alias(f"__{k}") for k in keys]), [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def resolve(kg: KnowledgeGraph, df: DataFrame, col: str, out: str, type_id: int | None = None, strict: bool = False) -> DataFrame:
    """df with the entity (out_id, out_type) that a column names; the lowest alias id wins. strict compares lower-cased text only."""
    a = kg.aliases.where("is_active")
    if type_id is not None:
        a = a.where(F.col("type_id") == type_id)
    first = a.groupBy("alias_norm").agg(F.min(F.struct("alias_id", "entity_id", "type_id")).alias("a"))
    norm = F.lower(F.trim(F.col(col))) if strict else normalized(F.col(col))
    # hot names are few and the alias side is one row a name: Spark splits a skewed side here
    joined = df.withColumn("__norm", norm).join(first.withColumnRenamed("alias_norm", "__norm"), "__norm", "left")
    return joined.withColumns({f"{out}_id": F.col("a.entity_id"), f"{out}_type_id": F.col("a.type_id")}).drop("__norm", "a")


def link(kg: KnowledgeGraph, df: DataFrame, left: str, right: str, relation: Column, left_type: int | None = None, right_type: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges of rows whose both names resolve, and the rows that are rejected."""
    both = resolve(kg, resolve(kg, df, left, "entity_1", left_type), right, "entity_2", right_type).withColumn("relation", relation)
    ok = F.col("entity_1_id").isNotNull() & F.col("entity_2_id").isNotNull()
    edges = ["entity_1_id", "entity_1_type_id", "entity_2_id", "entity_2_type_id", "relation", *[c for c in ("evidence_count", "confidence") if c in both.columns]]
    return both.where(ok).select(*edges), both.where(~ok).select(*df.columns, "relation")


def descendants(edges: DataFrame, roots: DataFrame, most_rounds: int = 100) -> DataFrame:
    """root, node: all nodes below each root over (child, parent) edges, each once. One join a level with what is new; cycles end by themselves."""
    spark = edges.sparkSession
    found = roots.select(F.col("root"), F.col("root").alias("node")).distinct()
    new = found
    down = written(edges.select(F.col("parent").alias("node"), F.col("child")).distinct(), "edges")
    for _ in range(most_rounds):
        step = new.join(down, "node").select("root", F.col("child").alias("node")).distinct()
        new = written(step.join(found, ["root", "node"], "left_anti"), "level")
        if new.isEmpty():
            return found
        found = found.unionByName(new)
    raise RuntimeError(f"deeper than {most_rounds} levels")


# reports


def directed(kg: KnowledgeGraph) -> DataFrame:
    """entity_id, other_type_id, relation, outward: each active edge once from both of its ends, a loop once."""
    r = kg.relationships.where("is_active")
    out = r.select(F.col("entity_1_id").alias("entity_id"), F.col("entity_2_type_id").alias("other_type_id"), "relation", F.lit(True).alias("outward"))
    back = r.where("entity_1_id != entity_2_id").select(F.col("entity_2_id").alias("entity_id"), F.col("entity_1_type_id").alias("other_type_id"), "relation", F.lit(False).alias("outward"))
    return out.unionByName(back)


def rollup(kg: KnowledgeGraph, ids: DataFrame | None = None) -> DataFrame:
    """entity_id, entity_relationships_by_group ("Type:count; ..." by type), total_entity_relationships; of the entities in ids alone if given."""
    types = F.broadcast(kg.entity_types.select(F.col("type_id").alias("other_type_id"), "name"))
    edges = directed(kg) if ids is None else directed(kg).join(ids, "entity_id", "left_semi")
    n = edges.join(types, "other_type_id", "left").groupBy("entity_id", F.coalesce("name", F.lit("Unknown")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    text = F.transform(F.array_sort(F.collect_list(F.struct("name", "n"))), lambda x: F.concat(x["name"], F.lit(":"), x["n"].cast("string")))
    return n.groupBy("entity_id").agg(F.array_join(text, "; ").alias("entity_relationships_by_group"), F.sum("n").alias("total_entity_relationships"))


def other_aliases(rows: DataFrame, kg: KnowledgeGraph, known: list[str], most: int = 15) -> DataFrame:
    """rows with other_aliases: up to `most` secondary aliases by id that no known column of the row holds."""
    a = kg.aliases.where("is_active and not is_primary").select("entity_id", "alias_id", "alias_value")
    key = ["input_value", "entity_id"]
    pairs = rows.select(*key, F.array(*[F.col(k).cast("string") for k in known]).alias("__known")).where("entity_id is not null").join(a, "entity_id")
    pairs = pairs.where(~F.exists("__known", lambda k: k.eqNullSafe(F.col("alias_value"))))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("alias_id"))
    text = pairs.withColumn("r", rank).where(F.col("r") <= most).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("r", "alias_value"))).alias("l"))
    return rows.join(text.select(*key, F.array_join(F.col("l.alias_value"), "; ").alias("other_aliases")), key, "left")


@dataclass(frozen=True)
class Report:
    """A kind of annotation report: its entity type, how a master table's rows become columns, and what its columns are."""

    name: str
    type_id: int
    columns: tuple[str, ...]
    fill: Callable[[KnowledgeGraph, DataFrame, dict], DataFrame]
    about: str


_TAIL = ("entity_relationships_by_group", "total_entity_relationships", "other_aliases", "status", "note")
_HEAD = ("input_value", "input_matched_alias", "entity_id")


def first_xrefs(kg: KnowledgeGraph, names: dict[str, str]) -> DataFrame:
    """entity_id and, for each source of names, its first alias by id: one pass over the aliases."""
    a = kg.aliases.where(F.col("xref_source").isin(list(names)) & F.col("is_active"))
    return a.groupBy("entity_id").agg(*[F.min_by(F.when(F.col("xref_source") == source, F.col("alias_value")), F.when(F.col("xref_source") == source, F.col("alias_id"))).alias(name) for source, name in names.items()])


def _genes(kg: KnowledgeGraph, rows: DataFrame, o: dict) -> DataFrame:
    m = o["master"].select("entity_id", F.col("symbol").alias("gene_symbol"), "hgnc_status", F.col("locus_group").alias("gene_locus_group"), F.col("locus_type").alias("gene_locus_type"), F.array_join(F.array_sort("groups"), "; ").alias("gene_groups"))
    rows = rows.join(m, "entity_id", "left")
    rows = rows.join(first_xrefs(kg, {"HGNC": "hgnc_id", "ENSEMBL": "ensembl_id", "NCBI": "entrez_id"}), "entity_id", "left")
    place = kg.locations.where(F.col("assembly") == o.get("assembly", "GRCh38.p14")).select("entity_id", "assembly", F.col("chromosome").cast("string").alias("chromosome"), "start_position", "end_position", "strand")
    return rows.join(place, "entity_id", "left")


def _edges_with(kg: KnowledgeGraph, type_id: int, outward: bool, name: str) -> DataFrame:
    d = directed(kg).where((F.col("other_type_id") == type_id) & F.col("relation").isin("is_a", "part_of") & (F.col("outward") == outward))
    return d.groupBy("entity_id").agg(F.count(F.lit(1)).alias(name))


def _zero(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return rows.withColumns({n: F.when(F.col("entity_id").isNotNull(), F.coalesce(F.col(n), F.lit(0)).cast("long")) for n in names})


def _diseases(kg: KnowledgeGraph, rows: DataFrame, o: dict) -> DataFrame:
    m = o["master"].select("entity_id", "disease_id", "label", "description", "mondo_id", "omim_id", "mesh_id", "icd10", "orphanet_id", F.array_join(F.array_sort("groups"), "; ").alias("disease_groups"), "groups")
    rows = rows.join(m, "entity_id", "left")
    if group := o.get("group_filter"):  # an unknown group leaves nothing, not-found rows included
        rows = rows.where(F.exists("groups", lambda g: F.lower(g) == group.lower()))
    rows = rows.drop("groups").join(_edges_with(kg, 8, True, "disease_parent_count"), "entity_id", "left").join(_edges_with(kg, 8, False, "disease_child_count"), "entity_id", "left")
    return _zero(rows, ("disease_parent_count", "disease_child_count"))


def _go(kg: KnowledgeGraph, rows: DataFrame, o: dict) -> DataFrame:
    m = o["master"].select("entity_id", "go_id", F.col("name").alias("go_name"), "namespace")
    labels = F.when(F.col("namespace") == "BP", "Biological Process").when(F.col("namespace") == "MF", "Molecular Function").when(F.col("namespace") == "CC", "Cellular Component")
    rows = rows.join(m, "entity_id", "left").withColumn("namespace_label", labels)
    if o.get("namespace"):
        rows = rows.where((F.col("namespace") == o["namespace"]) | F.col("entity_id").isNull())
    e = o["relations"]
    up = e.groupBy(F.col("child").alias("go_id")).agg(F.count(F.lit(1)).alias("go_parent_count"))
    down = e.groupBy(F.col("parent").alias("go_id")).agg(F.count(F.lit(1)).alias("go_child_count"))
    return _zero(rows.join(up, "go_id", "left").join(down, "go_id", "left"), ("go_parent_count", "go_child_count"))


def _pathways(kg: KnowledgeGraph, rows: DataFrame, o: dict) -> DataFrame:
    return rows.join(o["master"].select("entity_id", "pathway_id", F.col("name").alias("pathway_name"), "source_db", "organism", "pathway_source_system", "pathway_data_source"), "entity_id", "left")


def _proteins(kg: KnowledgeGraph, rows: DataFrame, o: dict) -> DataFrame:
    iso = o["isoforms"].select(F.col("isoform_entity_id").alias("entity_id"), F.col("canonical_entity_id").alias("__canonical"), F.col("accession").alias("input_isoform_accession"))
    rows = rows.join(iso, "entity_id", "left").withColumn("input_is_isoform", F.when(F.col("entity_id").isNotNull(), F.col("__canonical").isNotNull()))
    rows = rows.withColumn("canonical_entity_id", F.coalesce("__canonical", "entity_id")).drop("__canonical")
    m = o["master"].select(F.col("entity_id").alias("canonical_entity_id"), "protein_master_id", "protein_id", "function", "location", "tissue_expression", "protein_source_system", "protein_data_source")
    many = o["isoforms"].groupBy("canonical_entity_id").agg(F.count(F.lit(1)).alias("isoform_count"))
    p = o["pfam"].select("protein_master_id", "pfam_id", "pfam_type").distinct()
    rank = F.row_number().over(Window.partitionBy("protein_master_id", "pfam_type").orderBy("pfam_id"))
    p = p.withColumn("r", rank).groupBy("protein_master_id", "pfam_type").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("r") <= o.get("max_pfam", 10), F.col("pfam_id")))), ",").alias("ids"))
    p = p.groupBy("protein_master_id").agg(F.sum("n").alias("pfam_total_count"), F.array_sort(F.collect_list(F.struct("pfam_type", "n", "ids"))).alias("l"))
    text = lambda f: F.array_join(F.transform("l", lambda x: F.concat(x["pfam_type"], F.lit(":"), x[f].cast("string"))), "; ")
    p = p.select("protein_master_id", "pfam_total_count", text("n").alias("pfam_count_by_type"), text("ids").alias("pfam_ids_by_type"))
    rows = rows.join(m, "canonical_entity_id", "left").join(many, "canonical_entity_id", "left").join(p, "protein_master_id", "left")
    if not o.get("pfam_ids", True):
        rows = rows.withColumn("pfam_ids_by_type", F.lit(None).cast("string"))
    return _zero(rows, ("isoform_count", "pfam_total_count")).withColumn("__status", F.when(F.col("entity_id").isNotNull() & F.col("protein_master_id").isNull(), "error"))


REPORTS = {
    r.name: r
    for r in (
        Report("gene_annotations", 2, (*_HEAD, "gene_symbol", "hgnc_id", "ensembl_id", "entrez_id", "hgnc_status", "gene_locus_group", "gene_locus_type", "gene_groups", "assembly", "chromosome", "start_position", "end_position", "strand", *_TAIL), _genes, "Genes by any alias: codes, locus, groups, coordinates of one assembly. Options: master, assembly."),
        Report("disease_annotations", 8, (*_HEAD, "disease_id", "label", "description", "mondo_id", "omim_id", "mesh_id", "icd10", "orphanet_id", "disease_groups", "disease_parent_count", "disease_child_count", *_TAIL), _diseases, "Diseases: codes, groups, parents and children. Options: master, group_filter."),
        Report("go_annotations", 7, (*_HEAD, "go_id", "go_name", "namespace", "namespace_label", "go_parent_count", "go_child_count", *_TAIL), _go, "Ontology terms: namespace, parents and children. Options: master, relations, namespace."),
        Report("pathway_annotations", 6, (*_HEAD, "pathway_id", "pathway_name", "source_db", "organism", "pathway_source_system", "pathway_data_source", *_TAIL), _pathways, "Pathways with their sources. Options: master."),
        Report("protein_annotations", 3, (*_HEAD, "canonical_entity_id", "protein_master_id", "protein_id", "input_is_isoform", "input_isoform_accession", "isoform_count", "function", "location", "tissue_expression", "protein_source_system", "protein_data_source", "pfam_total_count", "pfam_count_by_type", "pfam_ids_by_type", *_TAIL), _proteins, "Proteins, isoforms by their canonical entry, families by type. Options: master, isoforms, pfam, max_pfam, pfam_ids."),
    )
}


def list_reports() -> list[str]:
    return sorted(REPORTS)


def explain(name: str) -> str:
    if name not in REPORTS:
        raise ValueError(f"unknown report {name!r}; there are {list_reports()}")
    r = REPORTS[name]
    return f"# {name}\n\n{r.about}\n\nColumns: {', '.join(r.columns)}"


def run_report(kg: KnowledgeGraph, name: str, inputs: DataFrame | None = None, *, columns: list[str] | None = None, emit_not_found_rows: bool = True, include_relationships: bool = True, include_aliases: bool = True, strict: bool = False, ascii_inputs: bool = False, **options) -> DataFrame:
    """One row for each input value (first column of inputs; comma lists are split), or for all entities of the type without inputs.

    Values are matched by normal form within the type, the lowest alias id first; strict compares
    lower-cased text, as stored forms without hyphens then need. What isn't found has null columns, status not_found and a note.
    """
    if name not in REPORTS:
        raise ValueError(f"unknown report {name!r}; there are {list_reports()}")
    spec, ids = REPORTS[name], None
    wanted = list(columns or spec.columns)
    if bad := [c for c in wanted if c not in spec.columns]:
        raise ValueError(f"{name} has no columns {bad}")
    mine = kg.aliases.where((F.col("type_id") == spec.type_id) & F.col("is_active"))
    if inputs is None:
        rows = mine.where("is_primary").groupBy("entity_id").agg(F.min_by("alias_value", "alias_id").alias("input_value")).select("input_value", F.col("input_value").alias("input_matched_alias"), "entity_id")
    else:
        values = inputs.select(F.explode(F.split(F.col(f"`{inputs.columns[0]}`").cast("string"), ",")).alias("v")).select(F.trim("v").alias("input_value")).where("input_value != ''").distinct()
        norm = F.lower("input_value") if strict else normalized_ascii(F.col("input_value")) if ascii_inputs else normalized(F.col("input_value"))
        first = mine.groupBy(F.col("alias_norm").alias("__norm")).agg(F.min(F.struct("alias_id", "entity_id", "alias_value")).alias("a"))
        rows = values.withColumn("__norm", norm).join(first, "__norm", "left").select("input_value", F.col("a.alias_value").alias("input_matched_alias"), F.col("a.entity_id").alias("entity_id"))
        # what follows needs the edges and aliases of the entities that were found alone
        rows = written(rows, "report-rows")
        ids = broadcast_if_small(rows.select("entity_id").where("entity_id is not null").distinct())
        kg = replace(kg, aliases=kg.aliases.join(ids, "entity_id", "left_semi"))
    rows = spec.fill(kg, rows, options)
    if include_relationships:
        rows = _zero(rows.join(rollup(kg, ids), "entity_id", "left"), ("total_entity_relationships",))
    if include_aliases:
        known = [c for c in ("input_matched_alias", "gene_symbol", "hgnc_id", "ensembl_id", "entrez_id", "disease_id", "mondo_id", "omim_id", "mesh_id", "label", "go_id", "go_name", "pathway_id", "pathway_name", "protein_id") if c in rows.columns]
        rows = other_aliases(rows, kg, known)
    found = F.col("entity_id").isNotNull()
    rows = rows.withColumn("status", F.coalesce(F.col("__status") if "__status" in rows.columns else F.lit(None).cast("string"), F.when(found, "found").otherwise("not_found")))
    rows = rows.withColumn("note", F.when(~found, F.concat(F.lit("No match for '"), "input_value", F.lit("'"))).when(F.col("status") == "error", "No master row"))
    if not emit_not_found_rows:
        rows = rows.where(found)
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in wanted])


def report_stats(report: DataFrame) -> DataFrame:
    """total_rows and the rows of each status."""
    return report.groupBy("status").agg(F.count(F.lit(1)).alias("rows"))
