"""Queries of the programs that load public sources. Each writes the source's files, in their own format, from the driver's tables and runs the program on them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.workspace import folder, write_lines, write_tsv
from . import kg as K
from .domain import braced, sql
from .etl import programs as P
from .graph_queries import graph

Q: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(oracle: str):
    def add(f: Callable) -> Callable:
        Q[f.__name__] = f
        SQL[f.__name__] = oracle
        return f

    return add


def _rows(spark: SparkSession, sf: str, text: str) -> DataFrame:
    return sql(spark, sf, braced(text))


def _tsv(spark: SparkSession, sf: str, name: str, text: str, header: bool = True) -> str:
    return write_tsv(_rows(spark, sf, text), folder(spark, name), header)


def _lines(spark: SparkSession, sf: str, name: str, text: str) -> str:
    return write_lines(_rows(spark, sf, text), folder(spark, name))


def _joined(df: DataFrame, **separators: str) -> DataFrame:
    """Lists as text, whole numbers as longs."""
    kinds = dict(df.dtypes)
    one = lambda c: F.array_join(c, separators[c]).alias(c) if c in separators else F.col(c).cast("long").alias(c) if kinds[c] == "int" else F.col(c)
    return df.select(*[one(c) for c in df.columns])


# genes and proteins


@query("""SELECT s_name AS symbol, 'HGNC:' || s_suppkey AS hgnc_id, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey::VARCHAR END AS entrez_id,
    CASE s_suppkey % 4 WHEN 0 THEN 23 WHEN 1 THEN s_suppkey % 22 + 1 WHEN 3 THEN 25 END::BIGINT AS chromosome, 'g' || s_nationkey || ';all' AS groups FROM supplier WHERE s_suppkey % 10 <> 0""")
def t1_gene_hgnc(spark, sf):
    docs = _rows(spark, sf, """SELECT s_nationkey AS file, named_struct('symbol', CASE WHEN s_suppkey % 10 <> 0 THEN s_name END, 'hgnc_id', concat('HGNC:', s_suppkey), 'name', 'n', 'status', 'Approved',
        'locus_group', 'x', 'locus_type', 'y', 'ensembl_gene_id', 'e', 'entrez_id', CASE WHEN s_suppkey % 3 > 0 THEN CAST(s_suppkey AS STRING) END, 'gene_group', array(concat('g', s_nationkey), 'all'),
        'location', CASE s_suppkey % 4 WHEN 0 THEN 'Xq28' WHEN 1 THEN concat(s_suppkey % 22 + 1, 'p13.31') WHEN 2 THEN 'reserved' ELSE 'mitochondria' END) AS d FROM supplier""")
    path = folder(spark, "hgnc")
    files = docs.groupBy("file").agg(F.to_json(F.struct(F.struct(F.collect_list("d").alias("docs")).alias("response"))).alias("json"))  # a file holds one document
    files.write.partitionBy("file").text(path)
    f = P.gene_hgnc(spark, path)
    groups = f["groups"].groupBy("symbol").agg(F.sort_array(F.collect_set("group"), asc=False).alias("g"))
    return _joined(f["master"].join(groups, "symbol").select("symbol", "hgnc_id", "entrez_id", "chromosome", F.array_join("g", ";").alias("groups")))


@query("""SELECT p_partkey::VARCHAR AS entrez_id, 'G' || p_partkey AS symbol, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'a' || p_partkey || ';b' END AS synonyms,
    CASE WHEN p_partkey % 5 = 1 THEN 'E' || p_partkey END AS ensembl_id, CASE WHEN p_partkey % 5 = 1 THEN p_partkey::VARCHAR END AS omim_id, (p_partkey % 22 + 1)::BIGINT AS chromosome,
    CASE p_partkey % 3 WHEN 0 THEN 'protein-coding gene' WHEN 1 THEN 'pseudogene' ELSE 'other' END AS locus_group
    FROM part WHERE p_partkey % 9 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 13 <> 0 AND p_partkey % 7 <> 0""")
def t2_gene_ncbi(spark, sf):
    path = _tsv(spark, sf, "ncbi", """SELECT CASE WHEN p_partkey % 9 = 0 THEN '10090' ELSE '9606' END AS `#tax_id`, p_partkey AS GeneID, CASE WHEN p_partkey % 13 = 0 THEN '-' ELSE concat('G', p_partkey) END AS Symbol,
        CASE WHEN p_partkey % 2 = 0 THEN '-' ELSE concat('a', p_partkey, '|b') END AS Synonyms,
        CASE p_partkey % 5 WHEN 0 THEN concat('MIM:1|HGNC:HGNC:', p_partkey) WHEN 1 THEN concat('MIM:', p_partkey, '|Ensembl:E', p_partkey) ELSE '-' END AS dbXrefs, p_partkey % 22 + 1 AS chromosome,
        CASE WHEN p_partkey % 7 = 0 THEN '-' ELSE '1p' END AS map_location, p_name AS description, CASE p_partkey % 3 WHEN 0 THEN 'protein-coding' WHEN 1 THEN 'pseudo' ELSE 'biological-region' END AS type_of_gene FROM part""")
    m = P.gene_ncbi(spark, path)["master"]
    return _joined(m.select("entrez_id", "symbol", "synonyms", "ensembl_id", "omim_id", "chromosome", "locus_group"), synonyms=";")


_LABEL = "CASE s_suppkey % 5 WHEN 0 THEN 'X' WHEN 1 THEN 'chr' || (s_suppkey % 22 + 1) WHEN 2 THEN 'MT' WHEN 3 THEN '99' ELSE '' || (s_suppkey % 22 + 1) END"


@query("""SELECT s_suppkey::BIGINT AS entity_id, 'GRCh38.p14' AS assembly, CASE s_suppkey % 5 WHEN 0 THEN 23 WHEN 2 THEN 25 ELSE s_suppkey % 22 + 1 END::BIGINT AS chromosome, (5 * s_suppkey + 5)::BIGINT AS start_position,
    (5 * s_suppkey + 9)::BIGINT AS end_position, '-' AS strand FROM supplier WHERE s_suppkey % 5 <> 3""")
def t3_gene_ensembl(spark, sf):
    gene = "SELECT concat_ws('\t', {label}, 'src', '{kind}', {at} * s_suppkey + {at}, {at} * s_suppkey + 9, '.', '{strand}', '.', concat('ID={kind}:E{at}', s_suppkey, ';Name=', s_name, ';biotype=b')) AS line FROM supplier"
    parts = [gene.format(label=_LABEL, kind=k, at=at, strand=s) for k, at, s in (("gene", 10, "+"), ("gene", 5, "-"), ("transcript", 1, "+"))]
    places = P.gene_ensembl(spark, _lines(spark, sf, "gff3", " UNION ALL ".join(parts) + " UNION ALL SELECT '#comment' FROM region UNION ALL SELECT 'no fields' FROM region"))["master"]
    genes = _rows(spark, sf, "SELECT s_suppkey AS entity_id, lower(s_name) AS symbol, CASE s_suppkey % 5 WHEN 0 THEN 23 WHEN 2 THEN 25 ELSE s_suppkey % 22 + 1 END AS chromosome FROM supplier")
    return _joined(P.locations(genes.withColumn("entity_id", F.col("entity_id").cast("long")), places))


@query("SELECT 'PF' || p_partkey AS pfam_id, p_name AS pfam_name, p_brand AS type, CASE WHEN p_partkey % 2 = 0 THEN 'CL' || p_size END AS clan_id FROM part")
def t4_protein_pfam(spark, sf):
    path = _tsv(spark, sf, "pfam", "SELECT concat('PF', p_partkey, ' '), p_name, 'Pfam', p_brand, CASE WHEN p_partkey % 2 = 0 THEN concat('CL', p_size) ELSE ' ' END, '', 'd' FROM part", header=False)
    return P.protein_pfam(spark, path)["master"].select("pfam_id", "pfam_name", "type", "clan_id")


def _uniprot(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return P.protein_uniprot(spark, _lines(spark, sf, "uniprot", """SELECT concat('<entry xmlns="http://uniprot.org/uniprot"><accession>P', s_suppkey, '</accession><accession>Q', s_suppkey, '</accession><name>N</name><protein><recommendedName><fullName>',
        s_name, '</fullName></recommendedName></protein><organism><dbReference type="NCBI Taxonomy" id="', CASE WHEN s_suppkey % 6 = 0 THEN '10090' ELSE '9606' END, '"/></organism>',
        '<dbReference type="HGNC" id="HGNC:', s_suppkey, '"/><dbReference type="GO" id="GO:', s_suppkey % 7, '"/><dbReference type="Pfam" id="PF', s_nationkey, '"/><comment type="function"><text>f ', s_nationkey, '</text></comment></entry>') AS x FROM supplier"""))


@query("SELECT 'P' || s_suppkey AS protein_id, 'P' || s_suppkey || ',Q' || s_suppkey AS accessions, s_name AS full_name, 'f ' || s_nationkey AS function, 'PF' || s_nationkey AS pfam_ids FROM supplier WHERE s_suppkey % 6 <> 0")
def t5_protein_uniprot(spark, sf):
    return _joined(_uniprot(spark, sf)["master"].select("protein_id", "accessions", "full_name", "function", "pfam_ids"), accessions=",", pfam_ids=",")


@query("""SELECT 'P' || s_suppkey AS protein_id, 'encodes' AS relation, 'HGNC:' || s_suppkey AS target_id, 'Genes' AS target_type FROM supplier WHERE s_suppkey % 6 <> 0
    UNION ALL SELECT 'P' || s_suppkey, 'part_of', 'GO:' || (s_suppkey % 7), 'Gene Ontology' FROM supplier WHERE s_suppkey % 6 <> 0""")
def t5_uniprot_relations(spark, sf):
    return _uniprot(spark, sf)["relations"].select("protein_id", "relation", "target_id", "target_type")


# relationship programs: names of both ends are looked up, what doesn't resolve is rejected


def _links(frames: dict[str, DataFrame], source: str) -> DataFrame:
    none = F.lit(None).cast("string")
    edges = frames["edges"].select(F.lit("edge").alias("kind"), "entity_1_id", "entity_2_id", none.alias("name"), "relation")
    back = F.lit(None).cast("long")
    return edges.unionByName(frames["rejects"].select(F.lit("reject").alias("kind"), back.alias("entity_1_id"), back.alias("entity_2_id"), F.col(source).alias("name"), "relation"))


@query("""SELECT DISTINCT 'edge' AS kind, (l_suppkey + 1000000)::BIGINT AS entity_1_id, (l_partkey + 4000000)::BIGINT AS entity_2_id, NULL::VARCHAR AS name, 'binds' AS relation FROM lineitem
    UNION ALL SELECT 'reject', NULL, NULL, 'none ' || s_suppkey, 'binds' FROM supplier UNION ALL SELECT 'reject', NULL, NULL, s_name, 'wrong type' FROM supplier""")
def t6_relationship_uniprot(spark, sf):
    names = _rows(spark, sf, """SELECT DISTINCT s_name AS protein_id, concat(p_name, ' ', p_partkey) AS target_id, 'Chemicals' AS target_type, 'binds' AS relation FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey
        UNION ALL SELECT concat('none ', s_suppkey), concat(p_name, ' ', p_partkey), 'Chemicals', 'binds' FROM supplier JOIN part ON p_partkey = s_suppkey
        UNION ALL SELECT s_name, concat(p_name, ' ', p_partkey), 'Genes', 'wrong type' FROM supplier JOIN part ON p_partkey = s_suppkey""")
    return _links(P.relationship_uniprot(spark, names, graph(spark, sf)), "protein_id")


@query("""SELECT 'edge' AS kind, (n_nationkey + 2000000)::BIGINT AS entity_1_id, (n_regionkey + 3000000)::BIGINT AS entity_2_id, NULL::VARCHAR AS name, 'is_a' AS relation FROM nation
    UNION ALL SELECT 'reject', NULL, NULL, n_name, 'has_phenotype' FROM nation""")
def t8_relationship_mondo(spark, sf):
    names = _rows(spark, sf, """SELECT lower(n_name) AS mondo_id, upper(r_name) AS target_id, 'Gene Ontology' AS target_type, 'is_a' AS relation FROM nation JOIN region ON r_regionkey = n_regionkey
        UNION ALL SELECT n_name, concat('HP:', n_nationkey), 'Phenotypes', 'has_phenotype' FROM nation""")
    return _links(P.relationship_mondo(spark, names, graph(spark, sf)), "mondo_id")


@query("""SELECT 'edge' AS kind, (s_nationkey + 2000000)::BIGINT AS entity_1_id, (s_suppkey + 1000000)::BIGINT AS entity_2_id, NULL::VARCHAR AS name, 'in_pathway' AS relation FROM supplier
    UNION ALL SELECT 'reject', NULL, NULL, 'R-HSA-' || n_nationkey, 'part_of' FROM nation""")
def t12_relationship_reactome(spark, sf):
    names = _rows(spark, sf, """SELECT concat('R-HSA-', s_nationkey) AS source_id, concat('ensg ', s_suppkey) AS target_id, 'Genes' AS target_type, 'in_pathway' AS relation FROM supplier
        UNION ALL SELECT concat('R-HSA-', n_nationkey), 'R-HSA-none', 'Pathways', 'part_of' FROM nation""")
    return _links(P.relationship_reactome(spark, names, graph(spark, sf)), "source_id")


# diseases


_OBO = "http://purl.obolibrary.org/obo/"


def _mondo(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    docs = _rows(spark, sf, f"""SELECT n_regionkey AS file, named_struct('id', concat('{_OBO}MONDO_', n_nationkey), 'lbl', n_name, 'meta', named_struct('definition', named_struct('val', concat('d ', n_name)),
        'deprecated', n_nationkey % 8 = 7, 'xrefs', array(named_struct('val', concat('MSH:D', n_nationkey)), named_struct('val', concat('OMIM:', n_nationkey)), named_struct('val', 'OMIM:0')),
        'synonyms', array(named_struct('val', lower(n_name))), 'subsets', array('{_OBO}mondo#rare'))) AS node,
        array(named_struct('sub', concat('{_OBO}MONDO_', n_nationkey), 'pred', 'is_a', 'obj', concat('{_OBO}MONDO_', n_nationkey div 2)),
          named_struct('sub', concat('{_OBO}MONDO_', n_nationkey), 'pred', '{_OBO}RO_0004003', 'obj', concat('http://identifiers.org/hgnc/', n_nationkey)),
          named_struct('sub', concat('{_OBO}MONDO_', n_nationkey), 'pred', '{_OBO}RO_0004029', 'obj', concat('{_OBO}HP_', n_nationkey)),
          named_struct('sub', concat('{_OBO}MONDO_', n_nationkey), 'pred', 'unknown', 'obj', concat('{_OBO}HP_', n_nationkey))) AS edges FROM nation""")
    path = folder(spark, "mondo")
    whole = F.struct(F.array(F.struct(F.collect_list("node").alias("nodes"), F.flatten(F.collect_list("edges")).alias("edges"))).alias("graphs"))
    docs.groupBy("file").agg(F.to_json(whole).alias("json")).write.partitionBy("file").text(path)
    return P.disease_mondo(spark, path)


@query("""SELECT 'MONDO:' || n_nationkey AS mondo_id, n_name AS label, 'd ' || n_name AS description, 'OMIM:' || n_nationkey AS omim_id, 'MSH:D' || n_nationkey AS mesh_id, NULL::VARCHAR AS icd10, 'rare' AS groups, lower(n_name) AS synonyms
    FROM nation WHERE n_nationkey % 8 <> 7""")
def t7_disease_mondo(spark, sf):
    m = _mondo(spark, sf)["master"].select("mondo_id", "label", "description", "omim_id", "mesh_id", "icd10", "groups", "synonyms")
    return _joined(m, groups=";", synonyms=";")


@query("""SELECT 'MONDO:' || n_nationkey AS child, 'MONDO:' || (n_nationkey // 2) AS parent, 'is_a' AS relation FROM nation WHERE n_nationkey % 8 <> 7 AND (n_nationkey // 2) % 8 <> 7
    UNION ALL SELECT 'MONDO:' || n_nationkey, 'HGNC:' || n_nationkey, 'has_genetic_basis' FROM nation WHERE n_nationkey % 8 <> 7 UNION ALL SELECT 'MONDO:' || n_nationkey, 'HP:' || n_nationkey, 'has_phenotype' FROM nation WHERE n_nationkey % 8 <> 7""")
def t7_mondo_relations(spark, sf):
    f = _mondo(spark, sf)
    return f["relations"].select("child", "parent", "relation").unionByName(f["cross_relations"].select(F.col("mondo_id").alias("child"), F.col("target_id").alias("parent"), "relation"))


_DESCRIPTOR = """SELECT concat('<DescriptorRecord><DescriptorUI>D', p_partkey, '</DescriptorUI><DescriptorName><String>', p_name, '</String></DescriptorName><TreeNumberList><TreeNumber>', {tree}, '</TreeNumber></TreeNumberList>',
    '<ConceptList><Concept><RegistryNumber>', p_partkey + 100, '-', p_partkey % 90 + 10, '-', p_partkey % 10, ' (x)</RegistryNumber><TermList><Term><String> ', p_brand, ' </String></Term><Term><String>', lower(p_brand), '</String></Term>',
    '<Term><String>', p_type, '</String></Term></TermList></Concept></ConceptList></DescriptorRecord>') AS x FROM part"""
_TREE = "CASE p_partkey % 4 WHEN 0 THEN 'C01.1' WHEN 1 THEN 'F03.5' WHEN 2 THEN 'F02' ELSE 'D03' END"


@query("SELECT 'D' || p_partkey AS mesh_id, p_name AS label, p_brand || '|' || p_type AS synonyms FROM part WHERE p_partkey % 4 < 2")
def t9_disease_mesh(spark, sf):
    return P.disease_mesh(spark, _lines(spark, sf, "mesh", _DESCRIPTOR.format(tree=_TREE)))["master"].select("mesh_id", "label", "synonyms")


# ontologies


_TERM = """SELECT concat('[Term]\nid: {p}:', s_suppkey, '\nname: ', s_name, '\n{more}', CASE WHEN s_suppkey % 9 = 0 THEN 'is_obsolete: true\n' ELSE '' END,
    'def: "about ', s_nationkey, '" [x]\nsynonym: "s', s_suppkey, '" EXACT []\nalt_id: {p}:9', s_suppkey, '\nis_a: {p}:', s_suppkey div 2, ' ! parent\nrelationship: part_of {p}:', s_suppkey % 5 + 1, ' ! whole\nrelationship: other {p}:1\n') AS x FROM supplier"""


@query("SELECT 'GO:' || s_suppkey AS go_id, s_name AS name, 'BP' AS namespace, 'about ' || s_nationkey AS definition, 's' || s_suppkey AS synonyms, 'GO:9' || s_suppkey AS alt_ids FROM supplier WHERE s_suppkey % 9 <> 0")
def t10_go(spark, sf):
    f = P.go(spark, _lines(spark, sf, "go", _TERM.format(p="GO", more="namespace: biological_process\n")))
    return _joined(f["master"].select("go_id", "name", "namespace", "definition", "synonyms", "alt_ids"), synonyms=";", alt_ids=";")


@query("""SELECT 'GO:' || s_suppkey AS child, 'GO:' || (s_suppkey // 2) AS parent, 'is_a' AS relation FROM supplier WHERE s_suppkey % 9 <> 0
    UNION ALL SELECT 'GO:' || s_suppkey, 'GO:' || (s_suppkey % 5 + 1), 'part_of' FROM supplier WHERE s_suppkey % 9 <> 0""")
def t10_go_relations(spark, sf):
    return P.go(spark, _lines(spark, sf, "go", _TERM.format(p="GO", more="namespace: biological_process\n")))["relations"]


@query("""SELECT 'HP:' || s_suppkey AS child, s_name AS name, parent, relation FROM supplier JOIN (SELECT s_suppkey AS k, 'HP:' || (s_suppkey // 2) AS parent, 'is_a' AS relation, s_suppkey // 2 AS up FROM supplier
    UNION ALL SELECT s_suppkey, 'HP:' || (s_suppkey % 5 + 1), 'part_of', s_suppkey % 5 + 1 FROM supplier) ON k = s_suppkey WHERE s_suppkey % 9 <> 0 AND s_suppkey <> 1 AND up <> 1""")
def t14_phenotype_hpo(spark, sf):
    f = P.phenotype_hpo(spark, _lines(spark, sf, "hpo", _TERM.format(p="HP", more="")), root="HP:1")
    return f["relations"].join(f["master"].select(F.col("hpo_id").alias("child"), "name"), "child").select("child", "name", "parent", "relation")


@query("""SELECT 'UBERON:' || s_suppkey AS uberon_id, CASE s_suppkey % 5 WHEN 0 THEN 'organ' WHEN 1 THEN 'system' WHEN 2 THEN 'tissue' WHEN 3 THEN 'structure' ELSE 'region' END AS anatomy_level FROM supplier WHERE s_suppkey % 9 <> 0 AND s_suppkey % 11 <> 0""")
def t24_anatomy_uberon(spark, sf):
    word = "CASE s_suppkey % 5 WHEN 0 THEN 'heart' WHEN 1 THEN 'nervous system' WHEN 2 THEN 'lung epithelium' WHEN 3 THEN 'axon hillock' ELSE 'hand' END"
    text = f"""SELECT concat('[Term]\nid: UBERON:', s_suppkey, '\nname: ', {word}, '\n', CASE WHEN s_suppkey % 5 = 0 THEN 'subset: organ_slim\n' ELSE '' END, CASE WHEN s_suppkey % 11 = 0 THEN 'subset: upper_level\n' ELSE '' END,
        CASE WHEN s_suppkey % 9 = 0 THEN 'is_obsolete: true\n' ELSE '' END, 'is_a: UBERON:', s_suppkey div 2, '\n') AS x FROM supplier"""
    return P.anatomy_uberon(spark, _lines(spark, sf, "uberon", text))["master"].select("uberon_id", "anatomy_level")


@query("SELECT 'G' || l_suppkey AS gene_symbol, 'HP:' || (l_partkey % 50) AS hpo_id, count(*) AS evidence_count, 'associated_with' AS relation FROM lineitem GROUP BY ALL")
def t15_relationship_hpo_genes(spark, sf):
    path = _tsv(spark, sf, "hpogenes", "SELECT l_suppkey AS `#ncbi_gene_id`, concat('G', l_suppkey) AS gene_symbol, concat('HP:', l_partkey % 50) AS hpo_id FROM lineitem")
    return P.relationship_hpo_genes(spark, path)["relations"].select("gene_symbol", "hpo_id", "evidence_count", "relation")


# pathways


@query("""WITH h AS (SELECT n_nationkey AS k FROM nation WHERE n_nationkey % 6 <> 0)
    SELECT 'R-' || n_nationkey AS source_id, 'R-' || (n_nationkey // 2) AS target_id, 'Pathways' AS target_type, 'part_of' AS relation FROM nation WHERE n_nationkey IN (FROM h) AND n_nationkey // 2 IN (FROM h)
    UNION SELECT 'R-' || s_nationkey, 'S' || s_suppkey, 'Genes', 'in_pathway' FROM supplier WHERE s_nationkey IN (FROM h) UNION SELECT 'R-' || s_nationkey, 'T' || s_nationkey, 'Genes', 'in_pathway' FROM supplier WHERE s_nationkey IN (FROM h)
    UNION SELECT 'R-' || s_nationkey, CASE WHEN s_suppkey % 3 = 0 THEN 'ENSG' ELSE 'ENSP' END || s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'Genes' ELSE 'Proteins' END, 'in_pathway' FROM supplier WHERE s_nationkey IN (FROM h) AND s_suppkey % 3 < 2 AND s_suppkey % 7 <> 0
    UNION SELECT 'R-' || s_nationkey, 'P' || s_suppkey, 'Proteins', 'in_pathway' FROM supplier WHERE s_nationkey IN (FROM h) AND s_suppkey % 7 <> 0""")
def t11_pathway_reactome(spark, sf):
    organism = "CASE WHEN {k} = 0 THEN 'Mus musculus' ELSE 'Homo sapiens' END"
    pathways = _tsv(spark, sf, "pathways", f"SELECT concat('R-', n_nationkey), n_name, {organism.format(k='n_nationkey % 6')} FROM nation", header=False)
    hierarchy = _tsv(spark, sf, "hierarchy", "SELECT concat('R-', n_nationkey div 2), concat('R-', n_nationkey) FROM nation", header=False)
    gmt = _lines(spark, sf, "gmt", "SELECT concat_ws('\t', 'name', concat('R-', s_nationkey), concat('S', s_suppkey), concat('T', s_nationkey)) AS x FROM supplier")
    ids = f"SELECT {{id}}, concat('R-', s_nationkey), 'u', 'p', 'TAS', {organism.format(k='s_suppkey % 7')} FROM supplier"
    ensembl = _tsv(spark, sf, "ensembl", ids.format(id="concat(CASE s_suppkey % 3 WHEN 0 THEN 'ENSG' WHEN 1 THEN 'ENSP' ELSE 'ENST' END, s_suppkey)"), header=False)
    uniprot = _tsv(spark, sf, "uniprot", ids.format(id="concat('P', s_suppkey)"), header=False)
    return P.pathway_reactome(spark, pathways, hierarchy, gmt, ensembl, uniprot)["relations"].select("source_id", "target_id", "target_type", "relation")


@query("SELECT 'hsa' || n_nationkey AS pathway_id, n_name AS name FROM nation")
def t13_pathway_kegg(spark, sf):
    return P.pathway_kegg(spark, _tsv(spark, sf, "kegg", "SELECT concat(CASE WHEN n_nationkey % 2 = 0 THEN 'path:' ELSE '' END, 'hsa', n_nationkey), concat(' ', n_name, ' ') FROM nation", header=False))["master"]


# chemicals


@query("""SELECT 'CHEBI:' || p_partkey AS chebi_id, p_name AS label, 'H' || p_size AS formula, p_size::VARCHAR AS mass, NULL::VARCHAR AS smiles, CASE WHEN p_partkey % 3 = 0 THEN 'CHEBI:A;CHEBI:B' ELSE '' END AS secondary_ids,
    'CAS=' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN ';' || '9=' || p_size ELSE '' END AS xrefs FROM part WHERE p_partkey % 10 <> 0""")
def t16_chemical_chebi(spark, sf):
    compounds = _tsv(spark, sf, "compounds", "SELECT p_partkey AS ID, concat(CASE WHEN p_partkey % 10 = 0 THEN 'X:' ELSE 'CHEBI:' END, p_partkey) AS CHEBI_ACCESSION, p_name AS NAME FROM part")
    properties = _tsv(spark, sf, "properties", "SELECT p_partkey AS ID, p_partkey AS COMPOUND_ID, 'FORMULA' AS TYPE, concat('H', p_size) AS CHEMICAL_DATA FROM part UNION ALL SELECT p_partkey, p_partkey, 'MASS', CAST(p_size AS STRING) FROM part UNION ALL SELECT p_partkey, p_partkey, 'COLOUR', 'red' FROM part")
    secondary = _tsv(spark, sf, "secondary", "SELECT p_partkey AS COMPOUND_ID, 'CHEBI:B' AS SECONDARY_ID FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 'CHEBI:A' FROM part WHERE p_partkey % 3 = 0")
    accessions = _tsv(spark, sf, "accessions", "SELECT p_partkey AS ID, p_partkey AS COMPOUND_ID, '1' AS SOURCE_ID, CAST(p_partkey AS STRING) AS ACCESSION_NUMBER FROM part UNION ALL SELECT p_partkey, p_partkey, '9', CAST(p_size AS STRING) FROM part WHERE p_partkey % 2 = 0")
    sources = _tsv(spark, sf, "sources", "SELECT '1' AS ID, 'CAS' AS NAME FROM region WHERE r_regionkey = 0")
    m = P.chemical_chebi(spark, compounds, properties, secondary, accessions, sources)["master"]
    pairs = F.array_join(F.sort_array(F.transform("xrefs", lambda x: F.concat(x["source"], F.lit("="), x["value"])), asc=False), ";")
    return m.select("chebi_id", "label", "formula", "mass", "smiles", F.coalesce(F.array_join("secondary_ids", ";"), F.lit("")).alias("secondary_ids"), pairs.alias("xrefs"))


@query("""SELECT p_partkey::VARCHAR AS uci, 'I' || p_partkey AS inchi, 'ChEBI=C' || p_partkey || ';PubChem=P' || p_partkey || ';99=Z' AS xrefs FROM part WHERE p_partkey % 3 = 0""")
def t17_chemical_unichem(spark, sf):
    references = _tsv(spark, sf, "references", "SELECT p_partkey AS UCI, 7 AS SRC_ID, concat('C', p_partkey) AS SRC_COMPOUND_ID FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 22, concat('P', p_partkey) FROM part UNION ALL SELECT p_partkey, 99, 'Z' FROM part")
    structures = _tsv(spark, sf, "structures", "SELECT p_partkey AS UCI, concat('I', p_partkey) AS STANDARDINCHI, concat('K', p_partkey) AS STANDARDINCHIKEY FROM part")
    m = P.chemical_unichem(spark, references, structures)["master"]
    shown = F.array_sort(F.transform("xrefs", lambda x: F.struct((x["source"] == "99").alias("last"), F.concat(x["source"], F.lit("="), x["value"]).alias("t"))))
    return m.select("uci", "inchi", F.array_join(F.transform(shown, lambda x: x["t"]), ";").alias("xrefs"))


@query("SELECT 'HMDB' || p_partkey AS accession, p_name AS name, 'K' || p_partkey AS inchikey, CASE WHEN p_partkey % 2 = 0 THEN 'C' || p_size END AS chebi_id, p_brand || ';' || p_type AS synonyms FROM part")
def t18_chemical_hmdb(spark, sf):
    path = _lines(spark, sf, "hmdb", """SELECT concat('<metabolite xmlns="http://www.hmdb.ca"><accession>HMDB', p_partkey, '</accession><name> ', p_name, ' </name><chebi_id>', CASE WHEN p_partkey % 2 = 0 THEN concat('C', p_size) ELSE '' END,
        '</chebi_id><inchikey>K', p_partkey, '</inchikey><synonyms><synonym>', p_brand, '</synonym><synonym>', p_type, '</synonym></synonyms></metabolite>') AS x FROM part""")
    return _joined(P.chemical_hmdb(spark, path)["master"].select("accession", "name", "inchikey", "chebi_id", "synonyms"), synonyms=";")


@query("""SELECT 'D' || p_partkey AS mesh_id, p_name AS label, (p_partkey + 100) || '-' || (p_partkey % 90 + 10) || '-' || (p_partkey % 10) AS cas, p_brand || '|' || p_type AS synonyms FROM part WHERE p_partkey % 4 = 3
    UNION ALL SELECT 'C' || s_suppkey, s_name, NULL, '' FROM supplier""")
def t19_chemical_mesh(spark, sf):
    supplements = _lines(spark, sf, "supp", "SELECT concat('<SupplementalRecord><SupplementalRecordUI>C', s_suppkey, '</SupplementalRecordUI><SupplementalRecordName><String>', s_name, '</String></SupplementalRecordName></SupplementalRecord>') AS x FROM supplier")
    return P.chemical_mesh(spark, supplements, _lines(spark, sf, "desc", _DESCRIPTOR.format(tree=_TREE)))["master"].select("mesh_id", "label", "cas", "synonyms")


@query("SELECT DISTINCT c_custkey::BIGINT AS compound, CASE WHEN n_regionkey = 1 THEN 'Hormone' ELSE 'Toxin' END AS \"group\" FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey IN (1, 2)")
def t21_chemical_chebi_roles(spark, sf):
    # roles: nations below regions; each customer's compound has its nation's role
    path = _tsv(spark, sf, "roles", "SELECT 5 AS RELATION_TYPE_ID, 1000 + n_nationkey AS INIT_ID, n_regionkey AS FINAL_ID FROM nation UNION ALL SELECT 4, c_custkey, 1000 + c_nationkey FROM customer UNION ALL SELECT 7, c_custkey, 1 FROM customer")
    return P.chemical_chebi_roles(spark, path, {"Hormone": 1, "Toxin": 2})["members"]


@query("SELECT 'D' || l_partkey AS chemical_id, l_suppkey::VARCHAR AS gene_id, count(*) AS evidence_count, 'c' || l_partkey AS chemical, 'g' || l_suppkey AS gene, 'regulates' AS relation FROM lineitem WHERE l_linenumber % 5 <> 0 GROUP BY ALL")
def t22_ctd_chem_gene(spark, sf):
    path = _lines(spark, sf, "ctd", """SELECT '# a comment' AS x FROM region UNION ALL SELECT concat_ws('\t', concat('c', l_partkey), concat('D', l_partkey), '', concat('g', l_suppkey), l_suppkey, 'protein', CASE WHEN l_linenumber % 5 = 0 THEN 'Mus' ELSE 'Homo' END,
        CASE WHEN l_linenumber % 5 = 0 THEN '10090' ELSE '9606' END, 'i', 'a', '1') FROM lineitem""")
    return P.ctd_chem_gene(spark, path)["relations"].select("chemical_id", "gene_id", "evidence_count", "chemical", "gene", "relation")


@query("""WITH d AS (SELECT l_suppkey::VARCHAR AS gene_id, CASE WHEN l_partkey % 3 = 0 THEN 'OTHER:' WHEN l_partkey % 3 = 1 THEN 'MESH:' ELSE 'OMIM:' END || (l_partkey % 30) AS disease_id, l_linenumber AS n FROM lineitem)
    SELECT gene_id, disease_id, relation, count(*) AS evidence_count FROM (SELECT *, 'associated_with' AS relation FROM d WHERE n IN (1, 2) UNION ALL SELECT *, 'responds_to' FROM d WHERE n IN (2, 3)) WHERE disease_id NOT LIKE 'OTHER%' GROUP BY ALL""")
def t23_ctd_gene_disease(spark, sf):
    path = _lines(spark, sf, "ctdgd", """SELECT '# a comment' AS x FROM region UNION ALL SELECT concat_ws('\t', 'g', l_suppkey, 'd', concat(CASE WHEN l_partkey % 3 = 0 THEN 'OTHER:' WHEN l_partkey % 3 = 1 THEN 'MESH:' ELSE 'OMIM:' END, l_partkey % 30),
        CASE l_linenumber WHEN 1 THEN 'marker/mechanism' WHEN 2 THEN 'marker/mechanism|therapeutic' WHEN 3 THEN 'therapeutic' ELSE '' END, '', '', '', '') FROM lineitem""")
    return P.ctd_gene_disease(spark, path)["relations"].select("gene_id", "disease_id", "relation", "evidence_count")


_MENTIONED = "SELECT l_orderkey AS r, l_suppkey + 1000000 AS e, min(l_linenumber) AS n FROM lineitem GROUP BY ALL"


@query(f"""WITH o AS ({_MENTIONED}), f AS (SELECT r FROM o GROUP BY r HAVING count(*) BETWEEN 2 AND 20)
    SELECT 'match' AS kind, CAST(r AS VARCHAR) AS record_id, e::BIGINT AS entity_1_id, NULL::BIGINT AS entity_2_id, NULL::BIGINT AS evidence_count FROM o
    UNION ALL SELECT 'relation', NULL, a.e, b.e, count(*) FROM o a JOIN o b ON a.r = b.r AND a.e < b.e WHERE a.r IN (FROM f) GROUP BY a.e, b.e""")
def t25_nlp_hmdb(spark, sf):
    """Each order is a description that names its suppliers."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "s_name"))), lambda x: F.concat(F.lit("with "), x["s_name"])), ", ")
    records = _rows(spark, sf, "SELECT l_orderkey, l_linenumber, s_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey").groupBy(F.col("l_orderkey").cast("string").alias("accession")).agg(text.alias("description"))
    f = P.nlp_hmdb(spark, records, graph(spark, sf))
    none = F.lit(None).cast("long")
    matches = f["matches"].select(F.lit("match").alias("kind"), "record_id", F.col("entity_id").alias("entity_1_id"), none.alias("entity_2_id"), none.alias("evidence_count"))
    return matches.unionByName(f["relations"].select(F.lit("relation").alias("kind"), F.lit(None).cast("string").alias("record_id"), "entity_1_id", "entity_2_id", "evidence_count"))
