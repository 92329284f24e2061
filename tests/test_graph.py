"""Upserts, reports, mentions and loads on small graphs and files written here."""

import json
import zipfile  # noqa: F401

import pytest
from pyspark.sql import functions as F

from sparkome.functions.text import chromosome, chromosome_label, normalize
from sparkome.plans import ids, kg as K, nlp as N
from sparkome.plans.etl import programs as P
from sparkome.plans.etl.framework import Manager, Source, content_hash


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def aliases(spark, data):
    """(id, entity, type, kind, source, value, primary)"""
    df = spark.createDataFrame([(i, e, t, k, s, v, normalize(v), p, True, "t", 1) for i, e, t, k, s, v, p in data], K.SCHEMAS["aliases"])
    return df.select(K.KnowledgeGraph.empty(spark).aliases.columns)


@pytest.fixture(scope="module")
def graph(spark):
    e = K.KnowledgeGraph.empty(spark)
    a = aliases(spark, [
        (1, 10, 2, "preferred", "HGNC", "BRCA1", True), (2, 10, 2, "code", "ENSEMBL", "ENSG-1", False), (3, 11, 2, "preferred", "HGNC", "TP53", True), (4, 11, 2, "synonym", "HGNC", "shared-name", False),
        (5, 20, 9, "preferred", "ChEBI", "Aspirin", True), (6, 20, 9, "synonym", "ChEBI", "Shared name", False), (7, 30, 8, "preferred", "MONDO", "Naïve-fever", True), (8, 21, 9, "preferred", "ChEBI", "the", True),
    ])
    r = spark.createDataFrame([(1, 20, 9, 10, 2, "regulates"), (2, 10, 2, 10, 2, "interacts_with"), (3, 30, 8, 11, 2, "associated_with")], "relationship_id long, entity_1_id long, entity_1_type_id int, entity_2_id long, entity_2_type_id int, relation string")
    r = r.withColumns({"source": F.lit("s"), "evidence_count": F.lit(1).cast("long"), "confidence": F.lit(1.0), "package_id": F.lit(1).cast("long"), "is_active": F.lit(True)})
    return K.KnowledgeGraph(e.entity_types, a.where("is_primary").select("entity_id", "type_id", "is_active", "source", "package_id"), a, r.select(e.relationships.columns), e.locations)


def test_names_and_numbers(spark):
    assert normalize("  Naïve-Fever/ß_α  x ") == "naive fever ß α x" and normalize(None) is None
    df = spark.createDataFrame([("12p13.31",), ("Xq28",), ("mitochondria",), ("reserved",), ("Y",), ("99",), (None,)], "l string")
    assert [r[0] for r in df.select(chromosome(F.col("l"))).collect()] == [12, 23, 25, None, 24, None, None]
    df = spark.createDataFrame([("chr7",), ("X",), ("MT",), ("7p",), ("23",), (None,)], "l string")
    assert [r[0] for r in df.select(chromosome_label(F.col("l"))).collect()] == [7, 23, 25, None, None, None]
    n = ids.numbered(spark.range(100).select((F.lit(1000) - F.col("id")).alias("v")), ["v"], "k", 5)
    assert rows(n, "v", "k") == sorted(((v, v - 901 + 5) for v in range(901, 1001)), key=str)


def test_upserts_are_idempotent(spark, graph):
    new = spark.createDataFrame([("TP53", "preferred", "HGNC", 2), ("New", "preferred", "HGNC", 2), (" ", "preferred", "HGNC", 2)], "alias_value string, alias_type string, xref_source string, type_id int")
    once = K.get_or_create_entities(graph, new, source="x", package_id=7)
    twice = K.get_or_create_entities(once, new, source="x")
    assert once.entities.count() == graph.entities.count() + 1 == twice.entities.count()
    assert once.entities.agg(F.max("entity_id")).first()[0] == 31
    edge = spark.createDataFrame([(10, 2, 20, 9, "regulates", 3), (20, 9, 10, 2, "regulates", 5), (30, 8, 20, 9, "responds_to", 1)], "entity_1_id long, entity_1_type_id int, entity_2_id long, entity_2_type_id int, relation string, evidence_count long")
    a = K.add_relationships(graph, edge, source="x")
    b = K.add_relationships(a, edge, source="x")
    assert rows(a.relationships.where("source = 'x'"), "entity_1_id", "entity_2_id", "evidence_count") == [(10, 20, 5), (20, 30, 1)] and b.relationships.count() == a.relationships.count()
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "id int, name string, about string")
    assert rows(K.seed(old, spark.createDataFrame([(2, None, "new"), (3, "c", "z"), (None, "n", "n")], "id int, name string, about string"), ["id"]), "id", "name", "about") == [(1, "a", "x"), (2, "b", "new"), (3, "c", "z")]
    built = K.build_aliases(spark.createDataFrame([(1, "A", ["b", " "]), (2, None, None)], "e long, s string, l array<string>"), "e", {"s": ("code", "X"), "l": ("synonym", "Y")})
    assert rows(built, "e", "alias_value", "xref_source") == [(1, "A", "X"), (1, "b", "Y")]
    assert K.truncation_counts(spark.createDataFrame([("x" * 9,), ("y",)], "s string"), {"s": 5}).first().s == 1


def test_reports(spark, graph):
    master = spark.createDataFrame([(10, "BRCA1", "Approved", "g", "t", ["z", "a"])], "entity_id long, symbol string, hgnc_status string, locus_group string, locus_type string, groups array<string>")
    asked = spark.createDataFrame([("brca1, ENSG 1",), (" ",), ("nope",)], "v string")
    got = {r.input_value: r for r in K.run_report(graph, "gene_annotations", asked, master=master).collect()}
    assert set(got) == {"brca1", "ENSG 1", "nope"} and got["brca1"].gene_groups == "a; z" and got["nope"].status == "not_found" and got["nope"].entity_id is None
    assert got["ENSG 1"].entity_id == 10 and got["brca1"].total_entity_relationships == 2 and got["brca1"].entity_relationships_by_group == "Chemicals:1; Genes:1"  # the loop counts once
    assert K.run_report(graph, "gene_annotations", spark.createDataFrame([("ENSG-1",)], "v string"), master=master, strict=True).first().status == "not_found"
    assert K.run_report(graph, "gene_annotations", asked, master=master, emit_not_found_rows=False, columns=["input_value"]).count() == 2
    assert K.run_report(graph, "gene_annotations", None, master=master).count() == 2
    assert "Columns" in K.explain("go_annotations") and len(K.list_reports()) == 5
    for call in (lambda: K.explain("x"), lambda: K.run_report(graph, "go_annotations", columns=["x"]), lambda: K.run_report(graph, "x")):
        with pytest.raises(ValueError):
            call()


@pytest.mark.parametrize("limit", [10**6, 5])
def test_mentions(spark, graph, limit, monkeypatch):
    """By one automaton and by many alike."""
    monkeypatch.setattr(N, "PART_BYTES", limit)
    docs = spark.createDataFrame([("a", "BRCA1 and brca1a; Shared-NAME. naive fever!"), ("b", ""), ("c", None), ("d", "the shared name aspirin")], "record_id string, text string")
    every = N.resolve_mentions(docs, graph, mode="all_candidates")
    assert rows(every, "record_id", "matched", "entity_id", "confidence") == [("a", "brca1", 10, 1.0), ("a", "naive fever", 30, 1.0), ("a", "shared name", 11, 0.5), ("a", "shared name", 20, 0.5), ("d", "aspirin", 20, 1.0), ("d", "shared name", 11, 0.5), ("d", "shared name", 20, 0.5)]
    best = N.resolve_mentions(docs, graph)
    assert rows(best.where("matched = 'shared name'"), "record_id", "entity_id", "review_status") == [("a", 11, "pending"), ("d", 11, "pending")]
    assert N.resolve_mentions(docs, graph, mode="smart", threshold=0.9).count() == 7
    first = every.where("matched = 'brca1'").first()
    assert (first.start, first.stop) == (0, 4) and first.context.startswith("brca1 and brca1a")


@pytest.mark.parametrize("piece", [500_000, 4])
def test_hashed_beginnings_find_what_a_search_by_hand_finds(spark, tmp_path, monkeypatch, piece):
    """All names between word boundaries, overlapping ones and ones of marks and spaces included; texts cut into pieces alike."""
    import random

    monkeypatch.setattr(N, "PIECE", piece)
    r = random.Random(7)
    word = lambda most: "".join(r.choice("ab#, é") for _ in range(r.randrange(1, most)))
    names = sorted({word(7) for _ in range(60)})
    spark.createDataFrame([(n,) for n in names], "alias_norm string").write.parquet(f"file://{tmp_path}/names")
    levels, longest = N._prefixes(f"file://{tmp_path}/names")
    texts = [word(60) for _ in range(150)]
    got = []
    for pieces in N._grouped(N._pieces(list(enumerate(texts))), lambda p: p[3] - p[2] + longest):
        got += [(pieces[k][0], a, b) for k, a, b in N._spans(pieces, levels, longest)]
    edge = lambda t, k: not 0 <= k < len(t) or not t[k].isalnum()
    known = set(names)
    want = [(k, a, b) for k, t in enumerate(texts) for a in range(len(t)) for b in range(a, min(len(t), a + 6)) if t[a : b + 1] in known and edge(t, a - 1) and edge(t, b + 1)]
    assert sorted(got) == want and len(want) > 300


def test_a_worker_holds_hashes_of_names_only(spark, tmp_path):
    """100,000 names of three words that share their beginnings: 9 bytes for each different one; 2.6 million such names took an automaton 567 MB."""
    spark.range(100_000).select(F.concat_ws(" ", F.lit("large"), F.concat(F.lit("ring"), F.col("id") % 100), "id").alias("alias_norm")).write.parquet(f"file://{tmp_path}/names")
    levels, longest = N._prefixes(f"file://{tmp_path}/names")
    assert [len(h) for h, _ in levels] == [1, 100, 100_000] and longest == len("large ring99 99999")
    assert sum(h.nbytes + w.nbytes for h, w in levels) == 9 * 100_101


def test_co_occurrence_edges(spark, graph):
    m = N.resolve_mentions(spark.createDataFrame([("1", "brca1 aspirin"), ("2", "aspirin brca1 brca1"), ("3", "tp53")], "record_id string, text string"), graph)
    e = N.co_occurrences(m)
    assert rows(e, "entity_1_id", "entity_2_id", "evidence_count", "confidence", "source_ref") == [(10, 20, 2, 1.0, "1")]
    g = N.load_co_occurrences(N.load_co_occurrences(graph, m, source="n"), m, source="n")
    assert g.relationships.where("source = 'n'").count() == 1
    assert N.persist_matches(m).where("length(text_hash) = 16").count() == m.count()
    assert N.resolve_text(spark, "TP53!", graph).count() == 1 and N.resolve_list(spark, ["tp53", "x"], graph).first().record_id == "0"


def write(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_gene_programs(spark, tmp_path):
    doc = {"response": {"docs": [{"symbol": "A1", "hgnc_id": "HGNC:1", "ensembl_gene_id": "E1", "status": "Approved", "location": "Xq28", "gene_group": ["g1", "g2"], "alias_symbol": ["a"]}, {"symbol": "B", "location": "reserved"}]}}
    f = P.gene_hgnc(spark, write(tmp_path, "h.json", json.dumps(doc)))
    assert rows(f["master"], "symbol", "chromosome") == [("A1", 23), ("B", None)] and f["groups"].count() == 2
    n = "#tax_id\tGeneID\tSymbol\tSynonyms\tdbXrefs\tchromosome\tmap_location\tdescription\ttype_of_gene\n"
    n += "9606\t1\tNOHG\tx|y\tMIM:5|Ensembl:E9\t7\t7p1\td\tncRNA\n9606\t2\tH\t-\tHGNC:HGNC:3\t7\t7p1\td\tncRNA\n10090\t3\tM\t-\t-\t7\t7p\td\tother\n9606\t4\t-\t-\t-\t7\t7p\td\tother\n9606\t5\tU\t-\t-\t7\t-\td\tother\n"
    r = P.gene_ncbi(spark, write(tmp_path, "n.tsv", n))["master"].collect()
    assert len(r) == 1 and (r[0].symbol, r[0].locus_group, r[0].ensembl_id, r[0].synonyms) == ("NOHG", "RNA gene", "E9", ["x", "y"])
    g = "#c\nchr1\ts\tgene\t10\t20\t.\t+\t.\tID=gene:E1;Name=A1;biotype=pc\nX\ts\tgene\t5\t9\t.\t-\t.\tID=gene:E2;Name=A1\nbad\n1\ts\texon\t1\t2\t.\t+\t.\tID=exon:1\n"
    places = P.gene_ensembl(spark, write(tmp_path, "g.gff3", g))["master"]
    assert rows(places, "ensembl_id", "chromosome", "start_position") == [("E1", 1, 10), ("E2", 23, 5)]
    genes = spark.createDataFrame([(1, "a1", 23), (2, "zz", 1)], "entity_id long, symbol string, chromosome int")
    assert rows(P.locations(genes, places), "entity_id", "start_position", "strand") == [(1, 5, "-")]
    assert P.protein_pfam(spark, write(tmp_path, "p.tsv", "PF1\tn\tsrc\tDomain\t\tc\td\n")).get("master").first().clan_id is None


OBO = """format-version: 1.2

[Term]
id: GO:1
name: one
namespace: biological_process
def: "the \\"first\\"" [x]
synonym: "uno" EXACT []
alt_id: GO:9
is_a: GO:2 ! two
relationship: part_of GO:3 ! three
relationship: happens_during GO:3

[Term]
id: GO:2
name: two
namespace: molecular_function

[Term]
id: GO:4
name: gone
is_obsolete: true
is_a: GO:2

[Typedef]
id: part_of
name: part of
"""


def test_ontology_programs(spark, tmp_path):
    f = P.go(spark, write(tmp_path, "go.obo", OBO))
    assert rows(f["master"], "go_id", "namespace", "synonyms", "alt_ids") == [("GO:1", "BP", ["uno"], ["GO:9"]), ("GO:2", "MF", [], [])]
    assert rows(f["relations"], "child", "parent", "relation") == [("GO:1", "GO:2", "is_a"), ("GO:1", "GO:3", "part_of")]
    hp = OBO.replace("GO:", "HP:000000")
    h = P.phenotype_hpo(spark, write(tmp_path, "hp.obo", hp), root="HP:0000002")
    assert rows(h["master"], "hpo_id") == [("HP:0000001",)] and rows(h["relations"], "parent", "relation") == [("HP:0000003", "part_of")]
    ub = "".join(f"[Term]\nid: UBERON:{k}\nname: {name}\n{''.join(f'subset: {s}' + chr(10) for s in subsets)}\n" for k, (name, subsets) in enumerate([("nervous system", []), ("heart", ["organ_slim"]), ("lung epithelium", []), ("axon hillock", []), ("hand", []), ("thing", ["upper_level"])]))
    a = P.anatomy_uberon(spark, write(tmp_path, "u.obo", ub))
    assert rows(a["master"], "name", "anatomy_level") == [("axon hillock", "structure"), ("hand", "region"), ("heart", "organ"), ("lung epithelium", "tissue"), ("nervous system", "system")]
    o = "http://purl.obolibrary.org/obo/"
    mondo = {"graphs": [{"nodes": [{"id": f"{o}MONDO_1", "lbl": "one", "meta": {"xrefs": [{"val": "OMIM:7"}, {"val": "OMIM:8"}], "subsets": [f"{o}mondo#rare"], "deprecated": False}}, {"id": f"{o}MONDO_2", "lbl": "two"}, {"id": f"{o}MONDO_3", "lbl": "dead", "meta": {"deprecated": True}}], "edges": [{"sub": f"{o}MONDO_1", "pred": "is_a", "obj": f"{o}MONDO_2"}, {"sub": f"{o}MONDO_1", "pred": "is_a", "obj": f"{o}MONDO_3"}, {"sub": f"{o}MONDO_2", "pred": f"{o}RO_0004003", "obj": "http://identifiers.org/hgnc/5"}, {"sub": f"{o}MONDO_2", "pred": f"{o}RO_0004029", "obj": f"{o}HP_7"}]}]}
    m = P.disease_mondo(spark, write(tmp_path, "m.json", json.dumps(mondo)))
    assert rows(m["master"], "mondo_id", "omim_id", "groups") == [("MONDO:1", "OMIM:7", ["rare"]), ("MONDO:2", None, [])]
    assert rows(m["relations"], "child", "parent", "relation") == [("MONDO:1", "MONDO:2", "is_a")]
    assert rows(m["cross_relations"], "target_id", "target_type", "relation") == [("HGNC:5", "Genes", "has_genetic_basis"), ("HP:7", "Phenotypes", "has_phenotype")]


def test_xml_programs(spark, tmp_path):
    up = '<?xml version="1.0"?>\n<uniprot xmlns="http://uniprot.org/uniprot">\n' + "".join(f'<entry dataset="S"><accession>P{k}</accession><accession>Q{k}</accession><name>N{k}</name><protein><recommendedName><fullName>F{k}</fullName></recommendedName></protein><organism><dbReference type="NCBI Taxonomy" id="{tax}"/></organism><comment type="function"><text>does</text></comment><dbReference type="HGNC" id="HGNC:{k}"/><dbReference type="GO" id="GO:1"/><dbReference type="Pfam" id="PF1"/></entry>\n' for k, tax in enumerate((9606, 10090))) + "</uniprot>"
    f = P.protein_uniprot(spark, write(tmp_path, "u.xml", up))
    assert rows(f["master"], "protein_id", "full_name", "function", "pfam_ids") == [("P0", "F0", "does", ["PF1"])]
    assert rows(f["relations"], "target_id", "relation", "target_type") == [("GO:1", "part_of", "Gene Ontology"), ("HGNC:0", "encodes", "Genes")]
    rec = lambda ui, tree: f"<DescriptorRecord><DescriptorUI>{ui}</DescriptorUI><DescriptorName><String>N{ui}</String></DescriptorName><TreeNumberList><TreeNumber>{tree}</TreeNumber></TreeNumberList><ConceptList><Concept><RegistryNumber>50-78-2 (x)</RegistryNumber><TermList><Term><String>Aa</String></Term><Term><String>aa</String></Term><Term><String>B</String></Term></TermList></Concept></ConceptList></DescriptorRecord>\n"
    path = write(tmp_path, "d.xml", f"<DescriptorRecordSet>\n{rec('D1', 'C01')}{rec('D2', 'D03')}{rec('D3', 'F03.1')}</DescriptorRecordSet>")
    assert rows(P.disease_mesh(spark, path)["master"], "mesh_id", "synonyms") == [("D1", "Aa|B"), ("D3", "Aa|B")]
    sup = write(tmp_path, "s.xml", "<S>\n<SupplementalRecord><SupplementalRecordUI>C1</SupplementalRecordUI><SupplementalRecordName><String>S</String></SupplementalRecordName></SupplementalRecord>\n</S>")
    c = P.chemical_mesh(spark, sup, path)["master"]
    assert rows(c, "mesh_id", "cas") == [("C1", None), ("D2", "50-78-2")]
    h = P.chemical_hmdb(spark, write(tmp_path, "h.xml", '<hmdb xmlns="x">\n<metabolite><accession>HMDB1</accession><name>Nm</name><inchikey>K</inchikey><synonyms><synonym>a</synonym><synonym>b</synonym></synonyms></metabolite>\n</hmdb>'))
    assert rows(h["master"], "accession", "inchikey", "synonyms") == [("HMDB1", "K", ["a", "b"])]


def test_chemical_and_link_programs(spark, tmp_path, graph):
    u = P.chemical_unichem(spark, write(tmp_path, "r.tsv", "UCI\tSRC_ID\tSRC_COMPOUND_ID\n1\t7\tC1\n1\t22\tP1\n2\t22\tP2\n"), write(tmp_path, "s.tsv", "UCI\tSTANDARDINCHI\tSTANDARDINCHIKEY\n1\tI1\tK1\n2\tI2\tK2\n"))
    assert rows(u["master"], "uci", "inchikey") == [("1", "K1")] and [x.source for x in u["master"].first().xrefs] == ["ChEBI", "PubChem"]
    c = P.chemical_chebi(spark, write(tmp_path, "c.tsv", "ID\tCHEBI_ACCESSION\tNAME\n1\tCHEBI:1\tone\n2\tX\ttwo\n"), write(tmp_path, "p.tsv", "ID\tCOMPOUND_ID\tTYPE\tCHEMICAL_DATA\n1\t1\tFORMULA\tH2\n2\t1\tMASS\t2\n3\t1\tOTHER\tz\n"), write(tmp_path, "2.tsv", "COMPOUND_ID\tSECONDARY_ID\n1\tCHEBI:9\n"), write(tmp_path, "a.tsv", "ID\tCOMPOUND_ID\tACCESSION_NUMBER\tSOURCE_ID\n1\t1\t50-78-2\t3\n"), write(tmp_path, "o.tsv", "ID\tNAME\n3\tCAS\n"))
    assert rows(c["master"], "chebi_id", "formula", "mass", "smiles", "secondary_ids") == [("CHEBI:1", "H2", "2", None, ["CHEBI:9"])] and c["master"].first().xrefs[0].source == "CAS"
    roles = "ID\tRELATION_TYPE_ID\tINIT_ID\tFINAL_ID\n" + "".join(f"{k}\t{t}\t{i}\t{f}\n" for k, (t, i, f) in enumerate([(5, 2, 1), (5, 3, 1), (5, 4, 2), (5, 4, 3), (5, 1, 4), (4, 50, 4), (4, 51, 9)]))
    assert rows(P.chemical_chebi_roles(spark, write(tmp_path, "rel.tsv", roles), {"Toxin": 1})["members"], "compound", "group") == [(50, "Toxin")]  # a diamond and a cycle
    a = aliases(spark, [(1, 1, 9, "preferred", "CompTox", "x", True), (2, 2, 9, "preferred", "X", "Vitamin C", True), (3, 3, 9, "preferred", "X", "L-Alanine", True), (4, 4, 9, "code", "MESH", "D2", False)])
    assert rows(P.chemical_groups(spark, a)["members"], "entity_id", "group") == [(1, "Pollutant"), (2, "Vitamin"), (3, "Amino-Acid")]
    new = spark.createDataFrame([("d2", "q"), ("zz", "vitamin-c"), ("yy", "none")], "mesh_id string, label string")
    assert rows(P.match_chemicals(new, a, [("mesh_id", "MESH")], "label"), "mesh_id", "entity_id") == [("d2", 4), ("yy", None), ("zz", 2)]
    ctd = "# c\n" + "a\tD1\t\tG\t5\t\tH\t9606\ti\tx\t1\n" * 2 + "a\tD1\t\tG\t6\t\tM\t10090\ti\tx\t1\n"
    assert rows(P.ctd_chem_gene(spark, write(tmp_path, "ctd.tsv", ctd))["relations"], "chemical_id", "gene_id", "evidence_count") == [("D1", "5", 2)]
    gd = "# c\nG\t5\td\tMESH:1\tmarker/mechanism|therapeutic\t\t\t\t\nG\t5\td\tMESH:1\t\tchem\t3\t\t\nG\t5\td\tOTHER:1\ttherapeutic\t\t\t\t\n"
    assert rows(P.ctd_gene_disease(spark, write(tmp_path, "gd.tsv", gd))["relations"], "relation", "evidence_count") == [("associated_with", 1), ("responds_to", 1)]
    hg = P.relationship_hpo_genes(spark, write(tmp_path, "hg.tsv", "#ncbi_gene_id\tgene_symbol\thpo_id\n1\tA\tHP:1\n1\tA\tHP:1\n2\tB\tHP:1\n"))
    assert rows(hg["relations"], "gene_symbol", "evidence_count") == [("A", 2), ("B", 1)]
    assert P.pathway_kegg(spark, write(tmp_path, "k.tsv", "path:hsa1\tOne\n"))["master"].first().pathway_id == "hsa1"
    human = "\tHomo sapiens\n"
    r = P.pathway_reactome(spark, write(tmp_path, "pw.tsv", f"R-1\tone{human}R-2\ttwo{human}R-3\tmouse\tMus\n"), write(tmp_path, "hi.tsv", "R-1\tR-2\nR-3\tR-2\n"), write(tmp_path, "g.gmt", "one\tR-1\tG1\tG2\n"), write(tmp_path, "e.tsv", f"ENSG1\tR-1\tu\tp\tTAS{human}ENST1\tR-1\tu\tp\tTAS{human}ENSP1\tR-3\tu\tp\tTAS{human}"), write(tmp_path, "up.tsv", f"P1\tR-2\tu\tp\tTAS{human}"))
    assert rows(r["relations"], "source_id", "target_id", "target_type", "relation") == [("R-1", "ENSG1", "Genes", "in_pathway"), ("R-1", "G1", "Genes", "in_pathway"), ("R-1", "G2", "Genes", "in_pathway"), ("R-2", "P1", "Proteins", "in_pathway"), ("R-2", "R-1", "Pathways", "part_of")]
    rel = spark.createDataFrame([("BRCA1", "Aspirin", "Chemicals", "regulates"), ("TP53", "Aspirin", "Genes", "regulates"), ("none", "TP53", "Genes", "regulates")], "protein_id string, target_id string, target_type string, relation string")
    f = P.relationship_uniprot(spark, rel, graph)
    assert rows(f["edges"], "entity_1_id", "entity_2_id") == [(10, 20)] and f["rejects"].count() == 2
    edges, rejects = K.link(graph, rel, "protein_id", "target_id", F.col("relation"))
    assert edges.count() == 2 and rejects.count() == 1
    nl = P.nlp_hmdb(spark, spark.createDataFrame([("H1", "aspirin, Aspirin and BRCA1")], "accession string, description string"), graph)
    assert nl["matches"].count() == 2 and nl["relations"].count() == 1


def test_runs_are_gated_audited_and_reverted(spark, tmp_path):
    m = Manager(spark, str(tmp_path / "etl"))
    state = {"hash": "a", "fail": False, "loads": 0}

    def load(frames, package):
        if state["fail"]:
            raise RuntimeError("broken")
        state["loads"] += 1
        return {"rows": frames["x"].count()}

    m.add(Source("second", lambda: state["hash"], lambda: {"x": spark.range(2)}, load, after=("first",)))
    m.add(Source("first", lambda: "z", lambda: {"x": spark.range(3)}, load))
    assert m.run() == {"first": "completed", "second": "completed"}
    assert m.run(["second"]) == {"second": "up_to_date"} and state["loads"] == 2
    state["hash"] = "b"
    assert m.run(["second"]) == {"second": "completed"} and m.run(resume=True) == {"first": "skipped", "second": "skipped"}
    state["fail"] = True
    assert m.run(["first"], force=("load",))["first"].startswith("failed: broken")
    s = {r.source: r for r in m.status().collect()}
    assert s["first"].load_status == "failed" and s["second"].load_status == "completed" and s["first"].transform_status == "up_to_date"
    t = lambda: {"entities": spark.createDataFrame([(1, "first", 1, True), (2, "second", 2, True)], "entity_id long, source string, package_id long, is_active boolean"), "relationships": spark.createDataFrame([(7, 1, 2, "first", 1)], "relationship_id long, entity_1_id long, entity_2_id long, source string, package_id long")}
    soft = m.rollback(t(), sources=["second"])
    assert rows(soft["entities"], "entity_id", "is_active") == [(1, True), (2, False)] and soft["relationships"].count() == 1
    m.sources["first"].strategy = "mixed"
    assert m.rollback(t(), sources=["first"])["relationships"].count() == 0
    state["fail"] = False
    assert m.run(["second"]) == {"second": "completed"}  # what was reverted loads again
    hard = m.rollback(t(), sources=["first"], hard=True)
    assert rows(hard["entities"], "entity_id") == [(2,)] and hard["relationships"].count() == 0
    assert {r.source for r in m.status().collect()} == {"second"}  # the audit has forgotten the first
    assert m.run(["first"], steps=("extract", "transform")) == {"first": "completed"} and m.run(["first"], steps=("extract", "transform")) == {"first": "completed"}
    last = m.audit().where("source = 'first'").orderBy("package_id", "started").collect()
    assert [(r.step, r.status) for r in last] == [("extract", "completed"), ("transform", "completed"), ("extract", "up_to_date"), ("transform", "up_to_date")]
    assert m.run_all(resume=True) == {"selected": 2, "skipped": 1, "succeeded": 1, "failed": 0}
    ids = [r.package_id for r in m.audit().select("package_id").distinct().collect()]
    assert m._next() not in ids and len({m._next(), m._next()}) == 2
    for bad in (lambda: m.run(["none"]), lambda: m.rollback(t()), lambda: m.rollback(t(), sources=["none"]), lambda: m.add(Source("x", None, None, None, strategy="x"))):
        with pytest.raises(ValueError):
            bad()
    m.sources["first"].files = (str(tmp_path / "down"),)
    (tmp_path / "down").mkdir()
    m.clean(["first"])
    assert not (tmp_path / "down").exists() and not (tmp_path / "etl/processed/first").exists()
    (tmp_path / "f.txt").write_text("x")
    assert content_hash(spark, [str(tmp_path / "f.txt")]) == content_hash(spark, [str(tmp_path / "f.txt")])


def test_checks_files_and_versions(spark, tmp_path, graph):
    df = spark.createDataFrame([(1, 0.5), (2, 2.0), (3, None)], "id int, confidence double")
    good, bad = K.validate(df, "relationships")
    assert rows(good, "id") == [(1,), (3,)] and rows(bad, "id") == [(2,)]
    assert N.version(graph) == 1 and N.is_stale(graph, 0) and not N.is_stale(graph, 1)
    from sparkome.plans.etl.framework import write_processed

    back = write_processed({"edges": df, "rejects": df.where("id = 2")}, str(tmp_path))
    assert back["edges"].count() == 3 and (tmp_path / "skipped_relationships.csv").is_dir()


def test_command_line(spark, tmp_path, graph, capsys):
    from sparkome.__main__ import main
    from sparkome.sources import snapshot

    master = spark.createDataFrame([(10, "BRCA1", "Approved", "g", "t", ["a"])], "entity_id long, symbol string, hgnc_status string, locus_group string, locus_type string, groups array<string>")
    snapshot.export(spark, str(tmp_path / "s"), {"entity_types": graph.entity_types, "entities": graph.entities, "aliases": graph.aliases, "relationships": graph.relationships, "locations": graph.locations, "gene_master": master}, plain=False)
    (tmp_path / "ids").write_text("# ids\nTP53\n")
    assert main(["report", "gene_annotations", str(tmp_path / "s"), "brca1", f"@{tmp_path}/ids", "--columns", "input_value", "status", "--out", str(tmp_path / "out")]) == 0
    assert rows(spark.read.option("header", True).csv(str(tmp_path / "out")), "input_value", "status") == [("TP53", "found"), ("brca1", "found")]
    assert main(["reports"]) == 0 and main(["explain", "go_annotations"]) == 0 and main(["verify", str(tmp_path / "s")]) == 0 and main(["info", str(tmp_path / "s")]) == 0
    assert "gene_annotations" in capsys.readouterr().out
    assert main(["download", str(tmp_path / "s"), str(tmp_path / "copy")]) == 0 and main(["verify", str(tmp_path / "copy")]) == 0
    assert main(["dictionary", str(tmp_path / "copy")]) == 0 and N.load_dictionary(spark, str(tmp_path / "copy"), graph).count() > 0
    assert main(["status", str(tmp_path / "loads")]) == 0
    assert main(["query", "d3_missing_report", "/root/testdata/sf0.001"]) == 0
