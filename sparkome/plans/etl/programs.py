"""The transforms: each takes a session and its files and gives named frames, and nothing is collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ...functions.text import chromosome, chromosome_label, normalized_ascii
from ...sources.workspace import written
from .formats import attribute, edges_of, obo, text, texts, tsv, xml

Frames = dict[str, DataFrame]
PROGRAMS: dict[str, Callable[..., Frames]] = {}


def program(f: Callable[..., Frames]) -> Callable[..., Frames]:
    PROGRAMS[f.__name__] = f
    return f


def _map(col: Column, table: dict, default: Column | None = None) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(m, col), default) if default is not None else F.try_element_at(m, col)


def _first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a stated order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


# NCBI gene kinds as locus groups.
LOCUS_GROUPS = {"protein-coding": "protein-coding gene", "pseudo": "pseudogene", "ncRNA": "RNA gene", "rRNA": "RNA gene", "tRNA": "RNA gene", "snRNA": "RNA gene", "snoRNA": "RNA gene", "miscRNA": "RNA gene", "other": "other"}
# Relation of each MONDO predicate, among diseases and to other ontologies.
_OBO = "http://purl.obolibrary.org/obo/"
DISEASE_PREDICATES = {"is_a": "is_a", f"{_OBO}BFO_0000050": "part_of", f"{_OBO}RO_0002473": "part_of", f"{_OBO}RO_0001025": "part_of"}
CROSS_PREDICATES = {
    f"{_OBO}RO_0004003": "has_genetic_basis", f"{_OBO}RO_0004001": "has_genetic_basis", f"{_OBO}RO_0004004": "has_genetic_basis", f"{_OBO}RO_0004020": "has_genetic_basis",
    f"{_OBO}RO_0004021": "has_disruption_in", f"{_OBO}RO_0004024": "has_disruption_in",
    f"{_OBO}RO_0004029": "has_phenotype", f"{_OBO}RO_0000053": "has_phenotype", f"{_OBO}mondo#disease_has_major_feature": "has_phenotype", f"{_OBO}RO_0002573": "has_phenotype",
    f"{_OBO}RO_0004026": "has_location", f"{_OBO}RO_0004027": "has_location", f"{_OBO}RO_0004030": "has_location",
    f"{_OBO}RO_0004028": "responds_to", f"{_OBO}mondo#disease_responds_to": "responds_to",
}
XREF_COLUMNS = {"OMIM": "omim_id", "MESH": "mesh_id", "MSH": "mesh_id", "ICD10": "icd10", "ICD10CM": "icd10", "ORPHANET": "orphanet_id", "ORPHA": "orphanet_id"}
# UniChem sources by number, and those whose compounds are wanted.
UNICHEM_WANTED = (7, 18, 33, 2, 34, 4, 14, 38, 49)
UNICHEM_NAMES = {1: "ChEMBL", 2: "DrugBank", 3: "RCSB-PDB", 4: "GtoPdb", 5: "PDBe", 7: "ChEBI", 14: "FDA-SRS", 15: "SureChEMBL", 18: "HMDB", 22: "PubChem", 24: "NMRShiftDB", 28: "MolPort", 31: "BindingDB", 32: "CompTox", 33: "LipidMaps", 34: "DrugCentral", 37: "Brenda", 38: "Rhea", 41: "SwissLipids", 46: "ClinicalTrials", 49: "ProbesAndDrugs", 50: "CCDC"}
# Which alias sources put a chemical in a group, and amino acids by name.
GROUP_SOURCES = {"Lipid": ("LipidMaps", "LIPID MAPS", "SwissLipids"), "Drug": ("DrugBank", "DrugCentral", "GtoPdb", "ProbesAndDrugs", "FDA-SRS"), "Pollutant": ("CompTox",), "Metabolite": ("HMDB",)}
AMINO_ACIDS = ("alanine", "arginine", "asparagine", "aspartic acid", "cysteine", "glutamic acid", "glutamine", "glycine", "histidine", "isoleucine", "leucine", "lysine", "methionine", "phenylalanine", "proline", "serine", "threonine", "tryptophan", "tyrosine", "valine")
# Roots of the role classes.
ROLE_ROOTS = {"Hormone": 24621, "Toxin": 27026, "Nutrient": 33284, "Vitamin": 33229}
GO_RELATIONS = ("part_of", "regulates", "positively_regulates", "negatively_regulates")
GO_NAMESPACES = {"biological_process": "BP", "molecular_function": "MF", "cellular_component": "CC"}


@program
def gene_hgnc(spark: SparkSession, path: str) -> Frames:
    d = spark.read.option("multiLine", True).json(path).select(F.explode("response.docs").alias("d")).select("d.*")
    have = lambda c, kind="string": F.col(c).cast(kind) if c in d.columns else F.lit(None).cast(kind)
    lists = ("alias_symbol", "alias_name", "prev_symbol", "prev_name")
    master = d.where(F.col("symbol").isNotNull()).select(
        "symbol", have("hgnc_id").alias("hgnc_id"), have("name").alias("name"), have("ensembl_gene_id").alias("ensembl_id"), have("entrez_id").alias("entrez_id"), have("status").alias("hgnc_status"),
        have("locus_group").alias("locus_group"), have("locus_type").alias("locus_type"), chromosome(have("location")).alias("chromosome"), have("gene_group", "array<string>").alias("groups"), *[have(c, "array<string>").alias(c) for c in lists],
    )
    return {"master": master, "groups": master.select("symbol", F.explode("groups").alias("group")).distinct()}


@program
def gene_ncbi(spark: SparkSession, path: str) -> Frames:
    d = tsv(spark, path)
    d = d.withColumnRenamed("#tax_id", "tax_id").where("tax_id = '9606'")
    xref = lambda name: F.nullif(F.regexp_extract("dbXrefs", rf"(?:^|\|){name}:((?:{name}:)?[^|]+)", 1), F.lit(""))
    d = d.withColumns({"hgnc_id": xref("HGNC"), "ensembl_id": xref("Ensembl"), "omim_id": xref("MIM")})
    keep = F.col("hgnc_id").isNull() & ~F.lower("Symbol").isin("-", "unknown", "n/a") & F.col("Symbol").isNotNull() & (F.col("map_location") != "-")
    return {"master": d.where(keep).select(F.col("GeneID").alias("entrez_id"), F.col("Symbol").alias("symbol"), F.filter(F.split("Synonyms", r"\|"), lambda x: x != "-").alias("synonyms"), "ensembl_id", "omim_id", chromosome(F.col("chromosome")).alias("chromosome"), F.col("map_location").alias("location"), "description", _map(F.col("type_of_gene"), LOCUS_GROUPS, F.lit("other")).alias("locus_group"), F.col("type_of_gene").alias("locus_type"))}


@program
def gene_ensembl(spark: SparkSession, path: str) -> Frames:
    parts = F.split("value", "\t")
    d = spark.read.text(path).where(~F.col("value").startswith("#")).select(parts.alias("p")).where(F.size("p") == 9)
    at = F.col("p")[8]
    rows = d.where(attribute(at, "ID").startswith("gene:")).select(F.substring(attribute(at, "ID"), 6, 64).alias("ensembl_id"), attribute(at, "Name").alias("symbol"), attribute(at, "biotype").alias("biotype"), chromosome_label(F.col("p")[0]).alias("chromosome"), F.col("p")[3].try_cast("long").alias("start_position"), F.col("p")[4].try_cast("long").alias("end_position"), F.col("p")[6].alias("strand"))
    return {"master": rows}


def locations(genes: DataFrame, places: DataFrame, assembly: str = "GRCh38.p14") -> DataFrame:
    """entity_id with the first place of its (upper-case symbol, chromosome)."""
    p = _first(places.where("symbol is not null and chromosome is not null").withColumn("k", F.upper("symbol")), ["k", "chromosome"], ["start_position", "ensembl_id"])
    g = genes.select("entity_id", F.upper("symbol").alias("k"), "chromosome")
    return g.join(p.select("k", "chromosome", "start_position", "end_position", "strand"), ["k", "chromosome"]).select("entity_id", F.lit(assembly).alias("assembly"), "chromosome", "start_position", "end_position", "strand")


@program
def protein_pfam(spark: SparkSession, path: str) -> Frames:
    names = ["pfam_id", "pfam_name", "source_database", "type", "clan_id", "clan_name", "description"]
    d = tsv(spark, path, names)
    return {"master": d.select(*[F.nullif(F.trim(c), F.lit("")).alias(c) for c in names]).where("pfam_id is not null")}


@program
def protein_uniprot(spark: SparkSession, path: str) -> Frames:
    d = xml(spark, path, "entry").where(F.expr("xpath_boolean(x, 'entry/organism/dbReference[@type=\"NCBI Taxonomy\" and @id=\"9606\"]')"))
    comment = lambda kind: F.concat_ws(" ", texts(f'entry/comment[@type="{kind}"]/text'))
    refs = lambda kind: F.expr(f"xpath(x, 'entry/dbReference[@type=\"{kind}\"]/@id')")
    d = d.select(text("entry/accession").alias("protein_id"), texts("entry/accession").alias("accessions"), text("entry/name").alias("name"), text("entry/protein/recommendedName/fullName").alias("full_name"), comment("function").alias("function"), F.concat_ws("; ", texts('entry/comment[@type="subcellular location"]/subcellularLocation/location')).alias("location"), comment("tissue specificity").alias("tissue_expression"), texts("entry/comment/isoform/id").alias("isoforms"), refs("Pfam").alias("pfam_ids"), *[refs(k).alias(k) for k in ("HGNC", "GO", "KEGG", "RefSeq")])
    d = written(d, "proteins")
    kinds = (("HGNC", "encodes", "Genes"), ("GO", "part_of", "Gene Ontology"), ("KEGG", "in_pathway", "Pathways"), ("RefSeq", "has_transcript", "Transcriptomics"))

    def target(relation: str, kind: str):
        return lambda t: F.struct(F.lit(relation).alias("relation"), t.alias("target_id"), F.lit(kind).alias("target_type"))

    rel = d.select("protein_id", F.inline(F.flatten(F.array(*[F.transform(F.col(k), target(r, y)) for k, r, y in kinds]))))
    return {"master": d.drop(*[k for k, _, _ in kinds]), "relations": rel.distinct()}


def _obo_graph(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path).select(F.get("graphs", F.lit(0)).alias("g"))


def mondo_id(iri: Column) -> Column:
    return F.when(iri.contains("MONDO_"), F.regexp_replace(F.substring_index(iri, "/", -1), "^([A-Za-z]+)_", "$1:"))


@program
def disease_mondo(spark: SparkSession, path: str) -> Frames:
    g = _obo_graph(spark, path)
    node = g.select(F.explode("g.nodes").alias("n"))
    fields = {f.name for f in node.schema["n"].dataType.fields}
    meta = {f.name for f in node.schema["n"].dataType["meta"].dataType.fields} if "meta" in fields else set()
    of = lambda c, e: F.expr(e) if c in meta else F.lit(None)
    n = node.select(mondo_id(F.col("n.id")).alias("mondo_id"), F.col("n.lbl").alias("label"), of("definition", "n.meta.definition.val").cast("string").alias("description"), F.coalesce(of("deprecated", "n.meta.deprecated").cast("boolean"), F.lit(False)).alias("dead"), F.coalesce(of("xrefs", "n.meta.xrefs.val").cast("array<string>"), F.array().cast("array<string>")).alias("xrefs"), F.coalesce(of("synonyms", "n.meta.synonyms.val").cast("array<string>"), F.array().cast("array<string>")).alias("synonyms"), F.coalesce(of("subsets", "n.meta.subsets").cast("array<string>"), F.array().cast("array<string>")).alias("subsets"))
    n = n.where("mondo_id is not null and label is not null and not dead").drop("dead")
    first = lambda col: F.get(F.filter("xrefs", lambda x: F.upper(F.substring_index(x, ":", 1)).isin([k for k, v in XREF_COLUMNS.items() if v == col])), F.lit(0))
    master = n.select("mondo_id", F.col("mondo_id").alias("disease_id"), "label", "description", *[first(c).alias(c) for c in ("omim_id", "mesh_id", "icd10", "orphanet_id")], F.transform("subsets", lambda s: F.substring_index(s, "#", -1)).alias("groups"), "synonyms", "xrefs")
    e = g.select(F.inline("g.edges")).select(F.col("sub"), F.col("pred"), F.col("obj"))
    live = master.select("mondo_id")
    inner = e.select(mondo_id(F.col("sub")).alias("child"), mondo_id(F.col("obj")).alias("parent"), _map(F.col("pred"), DISEASE_PREDICATES).alias("relation")).where("child is not null and parent is not null and relation is not null")
    inner = inner.join(live.withColumnRenamed("mondo_id", "child"), "child", "left_semi").join(live.withColumnRenamed("mondo_id", "parent"), "parent", "left_semi")
    local = F.substring_index("obj", "/", -1)
    dotted = F.regexp_replace(local, "^([A-Za-z]+)_", "$1:")
    kinds = (("HP_", "Phenotypes"), ("UBERON_", "Anatomy"), ("GO_", "Gene Ontology"), ("CHEBI_", "Chemicals"))
    kind = F.when(F.col("obj").rlike(r"identifiers\.org/(hgnc|ncbigene)/\d+$"), "Genes")
    for prefix, name in kinds:
        kind = kind.when(local.startswith(prefix), name)
    target = F.when(F.col("obj").contains("identifiers.org/hgnc/"), F.concat(F.lit("HGNC:"), local)).when(F.col("obj").contains("identifiers.org/ncbigene/"), F.concat(F.lit("NCBIGene:"), local)).otherwise(dotted)
    cross = e.select(mondo_id(F.col("sub")).alias("mondo_id"), target.alias("target_id"), kind.alias("target_type"), _map(F.col("pred"), CROSS_PREDICATES).alias("relation")).where("mondo_id is not null and target_type is not null and relation is not null")
    return {"master": master, "relations": inner.distinct(), "cross_relations": cross.join(live, "mondo_id", "left_semi").distinct()}


def _mesh_names(concepts: str) -> Column:
    names = F.array_distinct(F.transform(texts(f"{concepts}/Term/String"), lambda x: F.trim(x)))
    return F.array_join(F.aggregate(names, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x)))), "|")


@program
def disease_mesh(spark: SparkSession, path: str) -> Frames:
    d = xml(spark, path, "DescriptorRecord").withColumn("trees", texts("DescriptorRecord/TreeNumberList/TreeNumber"))
    d = d.where(F.exists("trees", lambda t: t.startswith("C") | t.startswith("F03")))
    return {"master": d.select(text("DescriptorRecord/DescriptorUI").alias("mesh_id"), text("DescriptorRecord/DescriptorName/String").alias("label"), "trees", _mesh_names("DescriptorRecord/ConceptList/Concept/TermList").alias("synonyms")).where("mesh_id is not null")}


@program
def go(spark: SparkSession, path: str) -> Frames:
    t = written(obo(spark, path).where("id is not null"), "terms")
    master = t.select(F.col("id").alias("go_id"), "name", _map(F.col("namespace"), GO_NAMESPACES, F.col("namespace")).alias("namespace"), "definition", "synonyms", "alt_ids")
    return {"master": master, "relations": edges_of(t, GO_RELATIONS)}


@program
def pathway_reactome(spark: SparkSession, pathways: str, hierarchy: str, gmt: str, ensembl: str, uniprot: str) -> Frames:
    p = tsv(spark, pathways, ["pathway_id", "name", "organism"]).where("organism = 'Homo sapiens'")
    human = p.select("pathway_id")
    up = tsv(spark, hierarchy, ["parent", "child"])
    up = up.join(human.withColumnRenamed("pathway_id", "parent"), "parent", "left_semi").join(human.withColumnRenamed("pathway_id", "child"), "child", "left_semi")
    up = up.select(F.col("child").alias("source_id"), F.col("parent").alias("target_id"), F.lit("Pathways").alias("target_type"), F.lit("part_of").alias("relation"))
    parts = F.split("value", "\t")
    genes = spark.read.text(gmt).select(parts[1].alias("pathway_id"), F.explode(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0)))).alias("target_id")).where("target_id != ''")
    ids = ["target_id", "pathway_id", "url", "pathway", "evidence", "organism"]
    ens = tsv(spark, ensembl, ids).where("organism = 'Homo sapiens'").withColumn("target_type", F.when(F.col("target_id").startswith("ENSG"), "Genes").when(F.col("target_id").startswith("ENSP"), "Proteins")).where("target_type is not null")
    uni = tsv(spark, uniprot, ids).where("organism = 'Homo sapiens'").withColumn("target_type", F.lit("Proteins"))
    members = genes.withColumn("target_type", F.lit("Genes")).unionByName(ens.select("pathway_id", "target_id", "target_type")).unionByName(uni.select("pathway_id", "target_id", "target_type")).join(human, "pathway_id", "left_semi")
    rel = up.unionByName(members.select(F.col("pathway_id").alias("source_id"), "target_id", "target_type", F.lit("in_pathway").alias("relation"))).distinct()
    return {"master": p, "relations": rel}


@program
def pathway_kegg(spark: SparkSession, path: str) -> Frames:
    d = tsv(spark, path, ["pathway_id", "name"])
    return {"master": d.select(F.regexp_replace(F.trim("pathway_id"), "^path:", "").alias("pathway_id"), F.trim("name").alias("name")).where("pathway_id != ''")}


@program
def phenotype_hpo(spark: SparkSession, path: str, root: str = "HP:0000001") -> Frames:
    t = written(obo(spark, path).where(F.col("id").startswith("HP:") & (F.col("id") != root)), "terms")
    e = edges_of(t, ("part_of",)).where(F.col("parent").startswith("HP:") & (F.col("parent") != root))
    return {"master": t.select(F.col("id").alias("hpo_id"), "name", "definition", "synonyms", "alt_ids", "xrefs"), "relations": e}


@program
def relationship_hpo_genes(spark: SparkSession, path: str) -> Frames:
    d = tsv(spark, path, comment=None)
    d = d.toDF(*[c.lstrip("#").strip() for c in d.columns]).where("gene_symbol is not null and hpo_id is not null")
    return {"relations": d.groupBy("gene_symbol", "hpo_id").agg(F.count(F.lit(1)).alias("evidence_count"), F.min("ncbi_gene_id").alias("ncbi_gene_id"), F.lit("associated_with").alias("relation"))}


@program
def chemical_chebi(spark: SparkSession, compounds: str, properties: str, secondary: str, accessions: str, sources: str) -> Frames:
    c = tsv(spark, compounds)
    c = c.toDF(*[x.strip().lower() for x in c.columns])
    c = c.select(F.col("id").try_cast("long").alias("compound_id"), F.col("chebi_accession").alias("chebi_id"), F.col("name").alias("label"), (F.col("status") if "status" in c.columns else F.lit("E")).alias("status")).where("chebi_id like 'CHEBI:%' and label is not null")
    p = tsv(spark, properties).select(F.col("COMPOUND_ID").try_cast("long").alias("compound_id"), "TYPE", "CHEMICAL_DATA")
    names = {"FORMULA": "formula", "MASS": "mass", "CHARGE": "charge", "MONOISOTOPIC MASS": "monoisotopic_mass", "SMILES": "smiles", "InChIKey": "inchi_key"}
    p = p.withColumn("prop", _map(F.col("TYPE"), names)).where("prop is not null")
    wide = p.groupBy("compound_id").pivot("prop", list(names.values())).agg(F.min("CHEMICAL_DATA"))
    s = tsv(spark, secondary).select(F.col("COMPOUND_ID").try_cast("long").alias("compound_id"), "SECONDARY_ID").groupBy("compound_id").agg(F.sort_array(F.collect_set("SECONDARY_ID")).alias("secondary_ids"))
    src = tsv(spark, sources).select(F.col("ID").alias("__source"), F.col("NAME").alias("source_name"))
    x = tsv(spark, accessions).join(F.broadcast(src), F.col("SOURCE_ID") == F.col("__source"), "left").select(F.col("COMPOUND_ID").try_cast("long").alias("compound_id"), F.struct(F.coalesce("source_name", "SOURCE_ID").alias("source"), F.col("ACCESSION_NUMBER").alias("value")).alias("x")).groupBy("compound_id").agg(F.sort_array(F.collect_set("x")).alias("xrefs"))
    return {"master": c.join(wide, "compound_id", "left").join(s, "compound_id", "left").join(x, "compound_id", "left")}


@program
def chemical_unichem(spark: SparkSession, references: str, structures: str) -> Frames:
    r = tsv(spark, references).select(F.col("UCI").alias("uci"), F.col("SRC_ID").try_cast("int").alias("src"), F.col("SRC_COMPOUND_ID").alias("value"))
    wanted = r.where(F.col("src").isin(*UNICHEM_WANTED)).select("uci").distinct()
    x = r.join(wanted, "uci", "left_semi").select("uci", F.struct(_map(F.col("src"), UNICHEM_NAMES, F.col("src").cast("string")).alias("source"), "value").alias("x"))
    s = tsv(spark, structures).select(F.col("UCI").alias("uci"), F.col("STANDARDINCHI").alias("inchi"), F.col("STANDARDINCHIKEY").alias("inchikey"))
    return {"master": s.join(x.groupBy("uci").agg(F.sort_array(F.collect_set("x")).alias("xrefs")), "uci")}


@program
def chemical_hmdb(spark: SparkSession, path: str) -> Frames:
    m = "metabolite"
    d = xml(spark, path, m)
    one = {c: text(f"{m}/{c}") for c in ("accession", "name", "description", "chemical_formula", "monisotopic_molecular_weight", "cas_registry_number", "smiles", "inchi", "inchikey", "chebi_id", "pubchem_compound_id", "kegg_id", "drugbank_id")}
    return {"master": d.select(*[v.alias(k) for k, v in one.items()], F.slice(texts(f"{m}/synonyms/synonym"), 1, 50).alias("synonyms"), texts(f"{m}/secondary_accessions/accession").alias("secondary_accessions")).where("accession is not null")}


@program
def chemical_mesh(spark: SparkSession, supplements: str, descriptors: str) -> Frames:
    cas = lambda p: F.get(F.filter(F.array_union(texts(f"{p}/RegistryNumber"), texts(f"{p}/RelatedRegistryNumberList/RelatedRegistryNumber")), lambda x: x.rlike(r"^\d{2,7}-\d{2}-\d\b")), F.lit(0))
    s = xml(spark, supplements, "SupplementalRecord").select(text("SupplementalRecord/SupplementalRecordUI").alias("mesh_id"), text("SupplementalRecord/SupplementalRecordName/String").alias("label"), cas("SupplementalRecord/ConceptList/Concept").alias("cas"), _mesh_names("SupplementalRecord/ConceptList/Concept/TermList").alias("synonyms"))
    d = xml(spark, descriptors, "DescriptorRecord").where(F.exists(texts("DescriptorRecord/TreeNumberList/TreeNumber"), lambda t: t.startswith("D")))
    d = d.select(text("DescriptorRecord/DescriptorUI").alias("mesh_id"), text("DescriptorRecord/DescriptorName/String").alias("label"), cas("DescriptorRecord/ConceptList/Concept").alias("cas"), _mesh_names("DescriptorRecord/ConceptList/Concept/TermList").alias("synonyms"))
    both = s.unionByName(d).where("mesh_id is not null")
    return {"master": both.withColumn("cas", F.nullif(F.regexp_extract("cas", r"^(\d{2,7}-\d{2}-\d)", 1), F.lit("")))}


def match_chemicals(new: DataFrame, aliases: DataFrame, codes: list[tuple[str, str]], name_col: str | None = None) -> DataFrame:
    """new with entity_id: the first code column (name, alias source) that an alias holds, then a name that just one entity has; null where it must be created."""
    out, found = new, []
    for k, (col, source) in enumerate(codes):
        a = aliases.where(F.col("xref_source") == source).groupBy(F.lower("alias_value").alias(f"__v{k}")).agg(F.min("entity_id").alias(f"__e{k}"))
        out = out.join(a, F.lower(F.col(col)) == F.col(f"__v{k}"), "left")
        found.append(F.col(f"__e{k}"))
    if name_col:
        a = aliases.where("alias_type = 'preferred'").groupBy(F.col("alias_norm").alias("__vn")).agg(F.countDistinct("entity_id").alias("__n"), F.min("entity_id").alias("__en")).where("__n = 1")
        out = out.join(a, normalized_ascii(F.col(name_col)) == F.col("__vn"), "left")
        found.append(F.col("__en"))
    return out.select(*new.columns, F.coalesce(*found).alias("entity_id"))


@program
def chemical_groups(spark: SparkSession, aliases: DataFrame) -> Frames:
    """entity_id, group from the aliases of chemicals: by source, by `vitamin ...`, by amino acid names with and without l and d."""
    parts = [aliases.where(F.col("xref_source").isin(*src)).select("entity_id", F.lit(g).alias("group")) for g, src in GROUP_SOURCES.items()]
    parts.append(aliases.where("alias_norm like 'vitamin %'").select("entity_id", F.lit("Vitamin").alias("group")))
    acids = [f"{p}{a}" for p in ("", "l ", "d ") for a in AMINO_ACIDS]
    parts.append(aliases.where(F.col("alias_norm").isin(acids)).select("entity_id", F.lit("Amino-Acid").alias("group")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return {"members": out.distinct()}


@program
def chemical_chebi_roles(spark: SparkSession, relations: str, roots: dict[str, int] | None = None) -> Frames:
    """compound, group: compounds with a role below one of the roots. type 5 is is_a, 4 has_role; init has or is the final."""
    from ..kg import descendants

    r = tsv(spark, relations)
    r = r.toDF(*[c.strip().lower() for c in r.columns])
    kind, init, final = (F.col(c).try_cast("long") for c in ("relation_type_id", "init_id", "final_id"))
    e = r.select(kind.alias("kind"), init.alias("init"), final.alias("final"))
    up = e.where("kind = 5").select(F.col("init").alias("child"), F.col("final").alias("parent"))
    start = spark.createDataFrame([(v, k) for k, v in (roots or ROLE_ROOTS).items()], "root long, group string")
    below = descendants(up, start.select("root")).join(F.broadcast(start), "root")
    has = e.where("kind = 4").select(F.col("init").alias("compound"), F.col("final").alias("node"))
    return {"members": has.join(below, "node").select("compound", "group").distinct()}


@program
def ctd_chem_gene(spark: SparkSession, path: str) -> Frames:
    names = ["chemical", "chemical_id", "cas", "gene", "gene_id", "forms", "organism", "organism_id", "interaction", "actions", "pubmed"]
    d = tsv(spark, path, names, "#").where("organism_id = '9606' and chemical_id is not null and gene_id is not null")
    return {"relations": d.groupBy("chemical_id", "gene_id").agg(F.count(F.lit(1)).alias("evidence_count"), F.min("chemical").alias("chemical"), F.min("gene").alias("gene"), F.lit("regulates").alias("relation"))}


@program
def ctd_gene_disease(spark: SparkSession, path: str) -> Frames:
    names = ["gene", "gene_id", "disease", "disease_id", "evidence", "chemical", "score", "omim", "pubmed"]
    d = tsv(spark, path, names, "#").where("evidence is not null and trim(evidence) != ''").where(F.col("disease_id").startswith("MESH:") | F.col("disease_id").startswith("OMIM:"))
    kinds = d.select("gene_id", "disease_id", "gene", "disease", F.explode(F.split("evidence", r"\|")).alias("e"))
    rel = F.when(F.col("e").contains("marker"), "associated_with").when(F.col("e").contains("therapeutic"), "responds_to")
    return {"relations": kinds.withColumn("relation", rel).where("relation is not null").groupBy("gene_id", "disease_id", "relation").agg(F.count(F.lit(1)).alias("evidence_count"), F.min("gene").alias("gene"), F.min("disease").alias("disease"))}


# Words that tell the level of an anatomical entity.
LEVEL_SUBSETS = {"organ_slim": "organ", "major_organ": "organ"}
TISSUE_WORDS = ("tissue", "parenchyma", "epithelium", "endothelium", "mucosa", "stroma", "adventitia", "mesothelium", "myelin", "periosteum", "perichondrium", "mesenchyme", "ectoderm", "endoderm", "mesoderm")
STRUCTURE_WORDS = ("synapse", "synaptic", "axon", "dendrite", "dendritic", "membrane", "junction", "channel", "receptor", "fiber tract", "nerve fiber", "filament", "granule cell", "vesicle", "tubule", "canaliculus", "cilium")
ABSTRACT_SUBSETS = ("upper_level", "non_informative", "early_development")


@program
def anatomy_uberon(spark: SparkSession, path: str, level_subsets: dict[str, str] | None = None) -> Frames:
    t = written(obo(spark, path).where(F.col("id").startswith("UBERON:") & ~F.arrays_overlap("subsets", F.array(*[F.lit(s) for s in ABSTRACT_SUBSETS]))), "terms")
    name = F.lower("name")
    level = None
    for s, v in (level_subsets or LEVEL_SUBSETS).items():
        level = F.when(F.array_contains("subsets", s), v) if level is None else level.when(F.array_contains("subsets", s), v)
    any_of = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: name.contains(w))
    level = level.when(F.arrays_overlap(F.split(name, r"\s+"), F.array(F.lit("system"), F.lit("apparatus"))), "system").when(any_of(TISSUE_WORDS), "tissue").when(any_of(STRUCTURE_WORDS), "structure").otherwise("region")
    return {"master": t.select(F.col("id").alias("uberon_id"), "name", "definition", "synonyms", "xrefs", "subsets", level.alias("anatomy_level")), "relations": edges_of(t, ("part_of",))}


def linked(names: DataFrame, kg, source: str, target: str, target_type: str) -> tuple[DataFrame, DataFrame]:
    """The relationship programs: edges whose source code and (type, target code) both resolve, and the rejects."""
    from ..kg import resolve

    types = kg.entity_types.select("type_id", F.col("name").alias(target_type))
    rows = names.join(F.broadcast(types), target_type, "left")
    both = resolve(kg, rows, source, "entity_1")
    a = kg.aliases.where("is_active").groupBy("alias_norm", F.col("type_id").alias("__t")).agg(F.min(F.struct("alias_id", "entity_id")).alias("a"))
    both = both.withColumn("__norm", normalized_ascii(F.col(target))).join(a, (F.col("__norm") == F.col("alias_norm")) & (F.col("type_id") == F.col("__t")), "left")
    both = both.withColumns({"entity_2_id": F.col("a.entity_id"), "entity_2_type_id": F.col("type_id")})
    ok = F.col("entity_1_id").isNotNull() & F.col("entity_2_id").isNotNull()
    return both.where(ok).select("entity_1_id", "entity_1_type_id", "entity_2_id", "entity_2_type_id", "relation"), both.where(~ok).select(*names.columns)


@program
def relationship_uniprot(spark: SparkSession, relations: DataFrame, kg) -> Frames:
    edges, rejects = linked(relations, kg, "protein_id", "target_id", "target_type")
    return {"edges": edges, "rejects": rejects}


@program
def relationship_mondo(spark: SparkSession, relations: DataFrame, kg) -> Frames:
    edges, rejects = linked(relations, kg, "mondo_id", "target_id", "target_type")
    return {"edges": edges, "rejects": rejects}


@program
def relationship_reactome(spark: SparkSession, relations: DataFrame, kg) -> Frames:
    edges, rejects = linked(relations, kg, "source_id", "target_id", "target_type")
    return {"edges": edges, "rejects": rejects}


@program
def nlp_hmdb(spark: SparkSession, records: DataFrame, kg) -> Frames:
    """Mentions in descriptions: best match a span, one match for each record and entity; and the co-occurrences."""
    from ..nlp import co_occurrences, persist_matches, resolve_mentions

    m = resolve_mentions(records, kg, id_col="accession", text_col="description")
    m = _first(m, ["record_id", "entity_id"], ["start", "stop", "alias_id"])
    return {"matches": persist_matches(m, field="description"), "relations": co_occurrences(m)}
