"""Queries of the knowledge graph, text mentions, loads and audit over a graph derived from the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import normalized, normalized_ascii
from . import kg as K, nlp as N
from .domain import braced, sql, table
from .etl import framework

Q: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f: Callable) -> Callable:
        Q[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return add


# Entities: 2 (Genes) suppliers, 6 (Pathways) nations, 7 (Gene Ontology) regions, 9 (Chemicals) parts. Ids are ranges a kind.
ALIASES = """SELECT s_suppkey * 10 + 1 AS alias_id, s_suppkey + 1000000 AS entity_id, 2 AS type_id, 'preferred' AS alias_type, 'HGNC' AS xref_source, s_name AS alias_value, true AS is_primary FROM supplier
    UNION ALL SELECT s_suppkey * 10 + 2, s_suppkey + 1000000, 2, 'code', 'ENSEMBL', 'ENSG-' || CAST(s_suppkey AS STRING), false FROM supplier
    UNION ALL SELECT n_nationkey * 10 + 3, n_nationkey + 2000000, 6, 'preferred', 'REACTOME', n_name, true FROM nation
    UNION ALL SELECT n_nationkey * 10 + 4, n_nationkey + 2000000, 6, 'code', 'REACTOME', 'R-HSA-' || CAST(n_nationkey AS STRING), false FROM nation
    UNION ALL SELECT r_regionkey * 10 + 5, r_regionkey + 3000000, 7, 'preferred', 'GO', r_name, true FROM region
    UNION ALL SELECT p_partkey * 10 + 6, p_partkey + 4000000, 9, 'preferred', 'ChEBI', p_name || ' ' || CAST(p_partkey AS STRING), true FROM part
    UNION ALL SELECT p_partkey * 10 + 7, p_partkey + 4000000, 9, 'synonym', 'ChEBI', p_brand, false FROM part"""
EDGES = """SELECT n_nationkey + 2000000 AS a, 6 AS ta, n_regionkey + 3000000 AS b, 7 AS tb, 'part_of' AS relation, CAST(1 AS BIGINT) AS n FROM nation
    UNION ALL SELECT s_nationkey + 2000000, 6, s_suppkey + 1000000, 2, 'associated_with', CAST(1 AS BIGINT) FROM supplier
    UNION ALL SELECT l_partkey + 4000000, 9, l_suppkey + 1000000, 2, 'regulates', count(*) FROM lineitem GROUP BY l_partkey, l_suppkey"""


def graph(spark: SparkSession, sf: str) -> K.KnowledgeGraph:
    a = sql(spark, sf, braced(ALIASES)).withColumns({"alias_norm": normalized_ascii(F.col("alias_value")), "is_active": F.lit(True), "source": F.lit("seed"), "package_id": F.lit(1).cast("long")})
    empty = K.KnowledgeGraph.empty(spark)
    e = a.where("is_primary").select("entity_id", "type_id", "is_active", "source", "package_id")
    r = sql(spark, sf, braced(EDGES)).select(F.col("a").alias("entity_1_id"), F.col("ta").alias("entity_1_type_id"), F.col("b").alias("entity_2_id"), F.col("tb").alias("entity_2_type_id"), "relation", F.col("n").alias("evidence_count"))
    r = K.canonical(r).withColumns({"relationship_id": F.xxhash64("entity_1_id", "entity_2_id", "relation"), "source": F.lit("seed"), "confidence": F.lit(None).cast("double"), "package_id": F.lit(1).cast("long"), "is_active": F.lit(True)})
    return K.KnowledgeGraph(empty.entity_types, e, a.select(*empty.aliases.columns), r.select(*empty.relationships.columns), empty.locations)


_A = f"a AS (SELECT *, trim(regexp_replace(lower(alias_value), '[-_/\\s]+', ' ', 'g')) AS alias_norm FROM ({ALIASES.replace('STRING', 'VARCHAR')}))"
_E = f"e AS (SELECT CASE WHEN sw THEN b ELSE a END AS e1, CASE WHEN sw THEN tb ELSE ta END AS t1, CASE WHEN sw THEN a ELSE b END AS e2, CASE WHEN sw THEN ta ELSE tb END AS t2, relation, n FROM (SELECT *, CASE WHEN ta = 2 AND tb <> 2 THEN false WHEN tb = 2 AND ta <> 2 THEN true ELSE a > b END AS sw FROM ({EDGES})))"
_NAMES = "t AS (SELECT * FROM (VALUES (2, 'Genes'), (6, 'Pathways'), (7, 'Gene Ontology'), (9, 'Chemicals')) v(type_id, name))"
_ROLL = """d AS (SELECT e1 AS id, t2 AS o FROM e UNION ALL SELECT e2, t1 FROM e WHERE e1 <> e2), k AS (SELECT id, name, count(*) AS n FROM d JOIN t ON o = type_id GROUP BY ALL),
    roll AS (SELECT id, string_agg(name || ':' || n, '; ' ORDER BY name) AS by_group, sum(n)::BIGINT AS total FROM k GROUP BY id)"""


@query(f"WITH {_A}, {_E}, {_NAMES}, {_ROLL} SELECT id AS entity_id, by_group AS entity_relationships_by_group, total AS total_entity_relationships FROM roll")
def r6_relationship_rollup(spark, sf):
    return K.rollup(graph(spark, sf))


def _inputs(spark: SparkSession, sf: str, text: str) -> DataFrame:
    return sql(spark, sf, braced(text))


def _report_sql(type_id: int, inputs: str, extra: str = "", joins: str = "", known: str = "''") -> str:
    return f"""WITH {_A}, {_E}, {_NAMES}, {_ROLL}, i AS (SELECT DISTINCT trim(v) AS input_value FROM (SELECT unnest(string_split(v, ',')) AS v FROM ({inputs})) WHERE trim(v) <> ''),
        f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY alias_norm ORDER BY alias_id) AS rn FROM a WHERE type_id = {type_id}) WHERE rn = 1),
        m AS (SELECT i.input_value, f.alias_value AS input_matched_alias, f.entity_id FROM i LEFT JOIN f ON f.alias_norm = trim(regexp_replace(lower(i.input_value), '[-_/\\s]+', ' ', 'g')))
        SELECT m.*, {extra} by_group AS entity_relationships_by_group, CASE WHEN m.entity_id IS NOT NULL THEN coalesce(total, 0) END AS total_entity_relationships,
          (SELECT string_agg(x.alias_value, '; ' ORDER BY x.alias_id) FROM a x WHERE x.entity_id = m.entity_id AND NOT x.is_primary AND x.alias_value <> m.input_matched_alias AND x.alias_value NOT IN ({known})) AS other_aliases,
          CASE WHEN m.entity_id IS NULL THEN 'not_found' ELSE 'found' END AS status, CASE WHEN m.entity_id IS NULL THEN 'No match for ''' || m.input_value || '''' END AS note
        FROM m LEFT JOIN roll ON roll.id = m.entity_id {joins}"""


_GENE_IN = "SELECT s_name || ', ENSG-' || CAST(s_suppkey AS STRING) || ',unknown ' || CAST(s_suppkey % 3 AS STRING) AS v FROM supplier"


@query(_report_sql(2, _GENE_IN.replace("STRING", "VARCHAR"), "s_name AS gene_symbol, s_name AS hgnc_id, CASE WHEN m.entity_id IS NOT NULL THEN 'ENSG-' || s_suppkey END AS ensembl_id, CASE WHEN s_nationkey IS NOT NULL THEN 'g' || s_nationkey END AS gene_groups, CASE WHEN m.entity_id IS NOT NULL THEN CAST(s_nationkey % 22 + 1 AS VARCHAR) END AS chromosome, s_suppkey * 100 AS start_position,", "LEFT JOIN supplier ON s_suppkey + 1000000 = m.entity_id", "coalesce(s_name, ''), coalesce('ENSG-' || s_suppkey, '')"))
def r1_gene_annotations(spark, sf):
    s = table(spark, sf, "supplier")
    master = s.select((F.col("s_suppkey") + 1000000).alias("entity_id"), F.col("s_name").alias("symbol"), F.lit("Approved").alias("hgnc_status"), F.lit("x").alias("locus_group"), F.lit("y").alias("locus_type"), F.array(F.concat(F.lit("g"), F.col("s_nationkey").cast("string"))).alias("groups"))
    g = graph(spark, sf)
    places = s.select((F.col("s_suppkey") + 1000000).alias("entity_id"), F.lit("GRCh38.p14").alias("assembly"), (F.col("s_nationkey") % 22 + 1).alias("chromosome"), (F.col("s_suppkey") * 100).alias("start_position"), (F.col("s_suppkey") * 100 + 50).alias("end_position"), F.lit("+").alias("strand"), F.lit(1).cast("long").alias("package_id"))
    g = K.KnowledgeGraph(g.entity_types, g.entities, g.aliases, g.relationships, places)
    out = K.run_report(g, "gene_annotations", _inputs(spark, sf, _GENE_IN), master=master)
    return out.select("input_value", "input_matched_alias", "entity_id", "gene_symbol", "hgnc_id", "ensembl_id", "gene_groups", "chromosome", "start_position", "entity_relationships_by_group", "total_entity_relationships", "other_aliases", "status", "note")


_PATH_IN = "SELECT n_name || ',R-HSA-' || CAST(n_nationkey * 2 AS STRING) AS v FROM nation"


@query(_report_sql(6, _PATH_IN.replace("STRING", "VARCHAR"), "n_name AS pathway_name,", "LEFT JOIN nation ON n_nationkey + 2000000 = m.entity_id", "coalesce(n_name, '')"))
def r4_pathway_annotations(spark, sf):
    n = table(spark, sf, "nation")
    master = n.select((F.col("n_nationkey") + 2000000).cast("long").alias("entity_id"), F.concat(F.lit("P"), F.col("n_nationkey").cast("string")).alias("pathway_id"), F.col("n_name").alias("name"), F.lit("Reactome").alias("source_db"), F.lit("Homo sapiens").alias("organism"), F.lit("reactome").alias("pathway_source_system"), F.lit("pathways").alias("pathway_data_source"))
    out = K.run_report(graph(spark, sf), "pathway_annotations", _inputs(spark, sf, _PATH_IN), master=master)
    return out.select("input_value", "input_matched_alias", "entity_id", "pathway_name", "entity_relationships_by_group", "total_entity_relationships", "other_aliases", "status", "note")


_GO_IN = "SELECT r_name || ',nothing' AS v FROM region"


@query(_report_sql(7, _GO_IN, "CASE WHEN r_regionkey IS NOT NULL THEN 'BP' END AS namespace, CASE WHEN r_regionkey IS NOT NULL THEN 'Biological Process' END AS namespace_label, CASE WHEN r_regionkey IS NOT NULL THEN (r_regionkey > 0)::INT::BIGINT END AS go_parent_count, CASE WHEN r_regionkey IS NOT NULL THEN (CASE WHEN r_regionkey = 0 THEN 4 ELSE 0 END)::BIGINT END AS go_child_count,", "LEFT JOIN region ON r_regionkey + 3000000 = m.entity_id", "coalesce(r_name, '')"))
def r3_go_annotations(spark, sf):
    r = table(spark, sf, "region")
    master = r.select((F.col("r_regionkey") + 3000000).cast("long").alias("entity_id"), F.concat(F.lit("GO:"), F.col("r_regionkey").cast("string")).alias("go_id"), F.col("r_name").alias("name"), F.lit("BP").alias("namespace"))
    edges = r.where("r_regionkey > 0").select(F.concat(F.lit("GO:"), F.col("r_regionkey").cast("string")).alias("child"), F.lit("GO:0").alias("parent"))
    out = K.run_report(graph(spark, sf), "go_annotations", _inputs(spark, sf, _GO_IN), master=master, relations=edges)
    return out.select("input_value", "input_matched_alias", "entity_id", "namespace", "namespace_label", "go_parent_count", "go_child_count", "entity_relationships_by_group", "total_entity_relationships", "other_aliases", "status", "note")


_NONE = ", ".join(f"NULL::VARCHAR AS {c}" for c in ("description", "mondo_id", "omim_id", "mesh_id", "icd10", "orphanet_id"))


@query(f"""WITH {_A}, {_E}, {_NAMES}, {_ROLL} SELECT n_name AS input_value, n_name AS input_matched_alias, (n_nationkey + 2000000)::BIGINT AS entity_id, n_name AS disease_id, n_name AS label, {_NONE}, 'Rare; r' || n_regionkey AS disease_groups,
    0::BIGINT AS disease_parent_count, 0::BIGINT AS disease_child_count, by_group AS entity_relationships_by_group, coalesce(total, 0) AS total_entity_relationships, 'R-HSA-' || n_nationkey AS other_aliases, 'found' AS status, NULL::VARCHAR AS note
    FROM nation LEFT JOIN roll ON id = n_nationkey + 2000000 WHERE n_regionkey > 0""")
def r2_disease_annotations(spark, sf):
    """All entities of the type, those of one group; nations stand in for diseases."""
    g, n = graph(spark, sf), table(spark, sf, "nation")
    groups = F.when(F.col("n_regionkey") > 0, F.array(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), F.lit("Rare"))).otherwise(F.array(F.lit("r0")))
    none = [F.lit(None).cast("string").alias(c) for c in ("description", "mondo_id", "omim_id", "mesh_id", "icd10", "orphanet_id")]
    master = n.select((F.col("n_nationkey") + 2000000).cast("long").alias("entity_id"), F.col("n_name").alias("disease_id"), F.col("n_name").alias("label"), *none, groups.alias("groups"))
    g = K.KnowledgeGraph(g.entity_types, g.entities, g.aliases.withColumn("type_id", F.when(F.col("type_id") == 6, 8).otherwise(F.col("type_id"))), g.relationships, g.locations)
    return K.run_report(g, "disease_annotations", None, master=master, group_filter="rare")


@query("""SELECT 'n' || n_nationkey AS input_value, (SELECT count(*) FROM (SELECT n_nationkey AS c, n_nationkey // 2 AS p, 1 AS k FROM nation WHERE n_nationkey > 0 UNION ALL SELECT n_nationkey, n_nationkey // 3, 2 FROM nation WHERE n_nationkey > 0) e WHERE e.c = n.n_nationkey) AS disease_parent_count,
    (SELECT count(*) FROM (SELECT n_nationkey AS c, n_nationkey // 2 AS p, 1 AS k FROM nation WHERE n_nationkey > 0 UNION ALL SELECT n_nationkey, n_nationkey // 3, 2 FROM nation WHERE n_nationkey > 0) e WHERE e.p = n.n_nationkey) AS disease_child_count FROM nation n""")
def r2_disease_parents(spark, sf):
    """Parents and children by the direction of is_a and part_of edges between diseases; edges keep the order that they were made in."""
    n, e = table(spark, sf, "nation"), K.KnowledgeGraph.empty(spark)
    name = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    key = F.col("n_nationkey").cast("long")
    const = {"alias_type": F.lit("preferred"), "xref_source": F.lit("MONDO"), "is_primary": F.lit(True), "is_active": F.lit(True), "source": F.lit("t"), "package_id": F.lit(1).cast("long")}
    a = n.select(key.alias("alias_id"), key.alias("entity_id"), F.lit(8).alias("type_id"), name.alias("alias_value"), name.alias("alias_norm")).withColumns(const)
    up = lambda k, relation: n.where("n_nationkey > 0").select(key.alias("entity_1_id"), F.lit(8).alias("entity_1_type_id"), F.floor(F.col("n_nationkey") / k).cast("long").alias("entity_2_id"), F.lit(8).alias("entity_2_type_id"), F.lit(relation).alias("relation"))
    edges = up(2, "is_a").unionByName(up(3, "part_of")).withColumns({"relationship_id": F.lit(1).cast("long"), "source": F.lit("t"), "evidence_count": F.lit(1).cast("long"), "confidence": F.lit(1.0), "package_id": F.lit(1).cast("long"), "is_active": F.lit(True)})
    g = K.KnowledgeGraph(e.entity_types, e.entities, a.select(*e.aliases.columns), edges.select(*e.relationships.columns), e.locations)
    master = n.select(key.alias("entity_id"), name.alias("disease_id"), name.alias("label"), *[F.lit(None).cast("string").alias(c) for c in ("description", "mondo_id", "omim_id", "mesh_id", "icd10", "orphanet_id")], F.array().cast("array<string>").alias("groups"))
    return K.run_report(g, "disease_annotations", n.select(name.alias("v")), columns=["input_value", "disease_parent_count", "disease_child_count"], master=master)


_PFAM = "f AS (SELECT *, row_number() OVER (PARTITION BY m, t ORDER BY id) AS r FROM (SELECT DISTINCT l_suppkey AS m, l_returnflag AS t, 'PF' || (l_partkey % 20) AS id FROM lineitem)), pt AS (SELECT m, t, count(*) AS n, string_agg(id, ',' ORDER BY id) FILTER (r <= 4) AS ids FROM f GROUP BY ALL), pf AS (SELECT m, sum(n)::BIGINT AS total, string_agg(t || ':' || n, '; ' ORDER BY t) AS counts, string_agg(t || ':' || ids, '; ' ORDER BY t) AS ids FROM pt GROUP BY m)"


@query(f"""WITH {_PFAM}, s AS (SELECT s_suppkey AS k, s_name, CASE WHEN s_suppkey % 5 IN (1, 2) THEN s_suppkey - s_suppkey % 5 ELSE s_suppkey END AS c FROM supplier)
    SELECT s.s_name AS input_value, (k + 1000000)::BIGINT AS entity_id, (c + 1000000)::BIGINT AS canonical_entity_id, m.s_suppkey::BIGINT AS protein_master_id, m.s_name AS protein_id, k <> c AS input_is_isoform, CASE WHEN k <> c THEN s.s_name END AS input_isoform_accession,
      CASE WHEN c % 5 = 0 THEN (SELECT count(*) FROM supplier x WHERE x.s_suppkey % 5 IN (1, 2) AND x.s_suppkey - x.s_suppkey % 5 = c) ELSE 0 END::BIGINT AS isoform_count, CASE WHEN m.s_suppkey IS NOT NULL THEN 'f' END AS function,
      coalesce(total, 0)::BIGINT AS pfam_total_count, counts AS pfam_count_by_type, ids AS pfam_ids_by_type, CASE WHEN m.s_suppkey IS NULL THEN 'error' ELSE 'found' END AS status
    FROM s LEFT JOIN supplier m ON m.s_suppkey = c AND m.s_suppkey % 5 = 0 LEFT JOIN pf ON pf.m = m.s_suppkey""")
def r5_protein_annotations(spark, sf):
    """Every fifth supplier is a master protein, the two after it are its isoforms, the others have no master row."""
    g = graph(spark, sf)
    g = K.KnowledgeGraph(g.entity_types, g.entities, g.aliases.withColumn("type_id", F.when(F.col("type_id") == 2, 3).otherwise(F.col("type_id"))), g.relationships, g.locations)
    s = table(spark, sf, "supplier")
    master = s.where("s_suppkey % 5 = 0").select((F.col("s_suppkey") + 1000000).alias("entity_id"), F.col("s_suppkey").alias("protein_master_id"), F.col("s_name").alias("protein_id"), *[F.lit("f").alias(c) for c in ("function", "location", "tissue_expression", "protein_source_system", "protein_data_source")])
    iso = s.where("s_suppkey % 5 in (1, 2)").select((F.col("s_suppkey") + 1000000).alias("isoform_entity_id"), (F.col("s_suppkey") - F.col("s_suppkey") % 5 + 1000000).alias("canonical_entity_id"), F.col("s_name").alias("accession"))
    pfam = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("protein_master_id"), F.concat(F.lit("PF"), (F.col("l_partkey") % 20).cast("string")).alias("pfam_id"), F.col("l_returnflag").alias("pfam_type"))
    out = K.run_report(g, "protein_annotations", s.select("s_name"), master=master, isoforms=iso, pfam=pfam, max_pfam=4)
    longs = [F.col(c).cast("long").alias(c) for c in ("entity_id", "canonical_entity_id", "protein_master_id", "isoform_count", "pfam_total_count")]
    return out.select("input_value", *longs, "protein_id", "input_is_isoform", "input_isoform_accession", "function", "pfam_count_by_type", "pfam_ids_by_type", "status")


@query(f"WITH {_A}, {_E}, {_NAMES}, {_ROLL} SELECT CASE WHEN id IS NULL THEN 'not_found' ELSE 'found' END AS status, count(*) AS rows FROM (SELECT DISTINCT trim(v) AS v FROM (SELECT unnest(string_split(v, ',')) AS v FROM ({_PATH_IN.replace('STRING', 'VARCHAR')}))) LEFT JOIN (SELECT DISTINCT alias_norm AS id FROM a WHERE type_id = 6) ON id = trim(regexp_replace(lower(v), '[-_/\\s]+', ' ', 'g')) GROUP BY 1")
def r8_r10_report_stats(spark, sf):
    n = table(spark, sf, "nation").select((F.col("n_nationkey") + 2000000).cast("long").alias("entity_id"), F.lit("x").alias("pathway_id"), F.col("n_name").alias("name"), *[F.lit("x").alias(c) for c in ("source_db", "organism", "pathway_source_system", "pathway_data_source")])
    return K.report_stats(K.run_report(graph(spark, sf), "pathway_annotations", _inputs(spark, sf, _PATH_IN), columns=["input_value", "status"], master=n))


# upserts


@query("WITH n AS (SELECT DISTINCT p_brand AS v FROM part), o AS (SELECT v, row_number() OVER (ORDER BY v) AS entity_id FROM n) SELECT entity_id, v AS alias_value, lower(replace(v, '#', '#')) AS alias_norm FROM o UNION ALL SELECT (SELECT count(*) FROM n) + row_number() OVER (ORDER BY r_name), r_name, lower(r_name) FROM region")
def u1_get_or_create(spark, sf):
    rows = lambda df, c: df.select(F.col(c).alias("alias_value"), F.lit("code").alias("alias_type"), F.lit("X").alias("xref_source"), F.lit(9).alias("type_id"))
    part, region = rows(table(spark, sf, "part"), "p_brand"), rows(table(spark, sf, "region"), "r_name")
    g = K.get_or_create_entities(K.KnowledgeGraph.empty(spark), part, source="a")
    g = K.get_or_create_entities(g, part.unionByName(region), source="b")  # brands are there already
    return g.aliases.select("entity_id", "alias_value", "alias_norm")


@query("SELECT (s_suppkey + 1000000)::BIGINT AS entity_id, upper(s_name) || ' x' AS alias_value, lower(s_name) || ' x' AS alias_norm, false AS is_primary, 'new' AS source FROM supplier")
def u2_add_aliases(spark, sf):
    """Of values with one normal form the least is taken (capitals come first), and a value that the entity has is left out."""
    g, s = graph(spark, sf), table(spark, sf, "supplier")
    new = s.select((F.col("s_suppkey") + 1000000).alias("entity_id"), F.lit(2).alias("type_id"), F.explode(F.array(F.concat("s_name", F.lit("-x")), F.concat(F.upper("s_name"), F.lit(" x")), F.concat(F.lit("ENSG-"), F.col("s_suppkey").cast("string")))).alias("alias_value"), F.lit("code").alias("alias_type"), F.lit("ENSEMBL").alias("xref_source"))
    return K.add_aliases(g, new, source="new").aliases.where("source = 'new'").select(F.col("entity_id").cast("long").alias("entity_id"), "alias_value", "alias_norm", "is_primary", "source")


@query("SELECT c_custkey AS entity_id, 'A' AS assembly, CASE WHEN c_acctbal < 0 THEN c_custkey * 2 ELSE c_custkey END AS start_position FROM customer")
def u6_location_upsert(spark, sf):
    c = table(spark, sf, "customer")
    row = lambda df, x: df.select(F.col("c_custkey").alias("entity_id"), F.lit("A").alias("assembly"), x.alias("start_position"))
    return K.upsert_locations(row(c, F.col("c_custkey")), row(c.where("c_acctbal < 0"), F.col("c_custkey") * 2))


@query("SELECT c_custkey AS id, CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE 'filled' END AS segment FROM customer")
def u7_fill_null_only(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("segment"))
    return K.fill_null_only(c, c.select("id", F.lit("filled").alias("segment")), "id")


@query("SELECT DISTINCT l_suppkey AS entity_id, l_returnflag AS grp FROM lineitem")
def u8_insert_new(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("entity_id"), F.col("l_returnflag").alias("grp"))
    return K.insert_new(l.where("grp = 'N'").distinct(), l, ["entity_id", "grp"])


@query("WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier), d AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS node FROM region UNION SELECT root, child FROM d JOIN e ON node = parent) SELECT root, node FROM d")
def t21_descendants(spark, sf):
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = table(spark, sf, "nation").select(text("n", "n_nationkey").alias("child"), text("r", "n_regionkey").alias("parent")).unionByName(table(spark, sf, "supplier").select(text("s", "s_suppkey").alias("child"), text("n", "s_nationkey").alias("parent")))
    return K.descendants(e, table(spark, sf, "region").select(text("r", "r_regionkey").alias("root")))


@query(f"WITH {_A} SELECT DISTINCT entity_id, 'Metabolite' AS \"group\" FROM a WHERE xref_source = 'ENSEMBL' UNION SELECT entity_id, 'Lipid' FROM a WHERE xref_source = 'ChEBI'")
def t20_source_groups(spark, sf):
    from .etl.programs import chemical_groups

    a = graph(spark, sf).aliases.withColumn("xref_source", F.when(F.col("xref_source") == "ENSEMBL", "HMDB").when(F.col("xref_source") == "ChEBI", "LipidMaps").otherwise(F.col("xref_source")))
    return chemical_groups(spark, a)["members"]


# text

TOKENS = "SELECT w, count(*) AS n FROM (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM documents)) WHERE length(w) >= 4 GROUP BY w HAVING count(*) >= 20"


def _token_graph(spark: SparkSession, sf: str) -> K.KnowledgeGraph:
    """Frequent words as entities; every fifth shares its name with another entity."""
    d = table(spark, sf, "documents")
    w = d.select("doc_id", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).distinct().where("length(w) >= 4").groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n >= 20")
    twice = F.when(F.length("w") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    a = w.select("w", F.explode(twice).alias("k")).select((F.crc32(F.col("w").cast("binary")) * 2 + F.col("k")).alias("entity_id"), "w")
    a = a.select(F.col("entity_id").alias("alias_id"), "entity_id", F.lit(9).alias("type_id"), F.lit("preferred").alias("alias_type"), F.lit("X").alias("xref_source"), F.col("w").alias("alias_value"), F.col("w").alias("alias_norm"), F.lit(True).alias("is_primary"), F.lit(True).alias("is_active"), F.lit("t").alias("source"), F.lit(1).cast("long").alias("package_id"))
    e = K.KnowledgeGraph.empty(spark)
    return K.KnowledgeGraph(e.entity_types, e.entities, a, e.relationships, e.locations)


@query("SELECT doc_id, trim(regexp_replace(lower(strip_accents(text)), '[-_/\\s]+', ' ', 'g')) AS norm FROM documents")
def n1_normalize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", normalized(F.col("text")).alias("norm"))


@query(f"""WITH t AS ({TOKENS}), d AS (SELECT doc_id, unnest(string_split_regex(trim(regexp_replace(lower(strip_accents(text)), '[-_/\\s]+', ' ', 'g')), '[^\\p{{L}}\\p{{N}}]+')) AS w FROM documents)
    SELECT CAST(doc_id AS VARCHAR) AS record_id, w AS matched, count(*) AS mentions, CASE WHEN length(w) % 5 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence, CASE WHEN length(w) % 5 = 0 THEN 'pending' ELSE 'auto' END AS review_status FROM d JOIN t USING (w) GROUP BY ALL""")
def n4_n7_best_match(spark, sf):
    docs = table(spark, sf, "documents")
    m = N.resolve_mentions(docs, _token_graph(spark, sf), id_col="doc_id", text_col="text", stopwords=frozenset(), min_length=4, context=None)
    return m.groupBy("record_id", "matched").agg(F.count(F.lit(1)).alias("mentions"), F.max("confidence").alias("confidence"), F.max("review_status").alias("review_status"))


@query("WITH one AS (SELECT DISTINCT o_orderkey AS r, l_partkey AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey), f AS (SELECT r FROM one GROUP BY r HAVING count(*) BETWEEN 2 AND 20) SELECT a.e AS entity_1_id, b.e AS entity_2_id, count(*) AS evidence_count, min(CAST(a.r AS VARCHAR)) AS source_ref FROM one a JOIN one b ON a.r = b.r AND a.e < b.e WHERE a.r IN (SELECT r FROM f) GROUP BY ALL")
def n10_co_occurrences(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("record_id"), F.col("l_partkey").alias("entity_id"), F.lit(9).alias("type_id"), F.col("l_linenumber").alias("start"), F.lit(1.0).alias("confidence"))
    return N.co_occurrences(l).select("entity_1_id", "entity_2_id", "evidence_count", "source_ref")


# audit


@query("""WITH p AS (SELECT event_id AS package_id, 's' || user_id AS source, CASE event_id % 3 WHEN 0 THEN 'extract' WHEN 1 THEN 'transform' ELSE 'load' END AS step, event_type AS status FROM events),
    l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, step ORDER BY package_id DESC) AS r FROM p) WHERE r = 1)
    SELECT source, max(status) FILTER (step = 'extract') AS extract_status, max(package_id) FILTER (step = 'extract') AS extract_package, max(status) FILTER (step = 'transform') AS transform_status, max(package_id) FILTER (step = 'transform') AS transform_package, max(status) FILTER (step = 'load') AS load_status, max(package_id) FILTER (step = 'load') AS load_package FROM l GROUP BY source""")
def o5_status(spark, sf):
    e = table(spark, sf, "events")
    step = F.when(F.col("event_id") % 3 == 0, "extract").when(F.col("event_id") % 3 == 1, "transform").otherwise("load")
    return framework.status(e.select(F.col("event_id").alias("package_id"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("source"), step.alias("step"), F.col("event_type").alias("status")))
