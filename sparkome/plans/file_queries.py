"""Queries of the readers, writers, snapshots, loads and upserts, over files that are written from the driver's tables."""

from __future__ import annotations

import csv
import itertools
import json
import os
import shutil
import struct
import tempfile
from collections.abc import Callable

import numpy as np
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import code
from ..operators import genotypes as G
from ..sources import arrays, genotypes as GF, snapshot, tables
from ..sources.workspace import folder, write_lines, write_tsv
from . import kg as K, nlp as N
from .domain import braced, sql, table
from .etl import formats, framework
from .graph_queries import _A, _E, EDGES, graph

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


_CUSTOMER = "SELECT c_custkey AS sample_id, c_mktsegment AS segment, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS balance FROM customer"


@query(" UNION ALL ".join(f"SELECT '{k}' AS kind, sample_id, segment, round(balance, 2) AS balance FROM ({_CUSTOMER})" for k in ("csv", "tsv", "parquet")))
def s1_read_table(spark, sf):
    df, root = _rows(spark, sf, _CUSTOMER), folder(spark, "tables")
    df.write.option("header", True).csv(f"{root}/t.csv")
    write_tsv(df, f"{root}/t.tsv")
    df.write.parquet(f"{root}/t.parquet")
    out = None
    for kind in ("csv", "tsv", "parquet"):
        one = tables.read_table(spark, f"{root}/t.{kind}").select(F.lit(kind).alias("kind"), F.col("sample_id").cast("long").alias("sample_id"), "segment", F.round("balance", 2).alias("balance"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"SELECT sample_id, round(balance, 2) AS balance FROM ({_CUSTOMER})")
def s2_read_phenotypes(spark, sf):
    path = f"{folder(spark, 'phenotypes')}.csv"
    _rows(spark, sf, _CUSTOMER).write.option("header", True).csv(path)
    return tables.read_phenotypes(spark, path, outcomes=["balance"], covariates=["segment"]).role("outcomes").select(F.col("sample_id").cast("long").alias("sample_id"), F.round("balance", 2).alias("balance"))


def _ibm(x: float | None) -> bytes:
    """A number as eight bytes of IBM's hexadecimal floating point; None as the code of a missing one."""
    if x is None:
        return b"." + bytes(7)
    if x == 0:
        return bytes(8)
    power, size = 64, abs(x)
    while size >= 1:
        size, power = size / 16, power + 1
    while size < 1 / 16:
        size, power = size * 16, power - 1
    return bytes([(0x80 if x < 0 else 0) | power]) + int(size * 2**56).to_bytes(7, "big")


def _transport(columns: list[tuple[str, int]], rows: list[tuple]) -> bytes:
    """A SAS transport file of numbers (width 0) and texts of a width."""
    mark = lambda kind, tail: f"HEADER RECORD*******{kind} HEADER RECORD!!!!!!!{tail}".encode().ljust(80)
    zero = "0" * 30
    out = mark("LIBRARY", zero) + b"SAS".ljust(80) * 2 + mark("MEMBER ", "000000000000000001600000000140") + mark("DSCRPTR", zero) + b"SAS".ljust(80) * 2
    out += mark("NAMESTR", f"000000{len(columns):04d}" + "0" * 20)
    described, place = b"", 0
    for k, (name, width) in enumerate(columns):
        described += struct.pack(">hhhh8s40s8shhh2s8shhl52s", 2 if width else 1, 0, width or 8, k + 1, name.encode().ljust(8), b"", b"", 0, 0, 0, b"", b"", 0, 0, place, b"")
        place += width or 8
    data = b"".join(b"".join(v.encode().ljust(w) if w else _ibm(v) for (_, w), v in zip(columns, row, strict=True)) for row in rows)
    pad = lambda b: b.ljust(-(-len(b) // 80) * 80)
    return out + pad(described) + mark("OBS    ", zero) + pad(data)


def _put(spark: SparkSession, path: str, data: bytes) -> str:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(data))
    out.close()
    return path


@query("SELECT n_nationkey::DOUBLE AS seqn, n_name AS name, CASE WHEN n_nationkey % 4 <> 0 THEN round(-n_nationkey / 7.0 * 1000, 6)::DOUBLE END AS x FROM nation")
def s3_nhanes_xpt(spark, sf):
    rows = [(float(r[0]), r[1], -r[0] / 7 * 1000 if r[0] % 4 else None) for r in table(spark, sf, "nation").select("n_nationkey", "n_name").collect()]  # 25 nations
    path = _put(spark, f"{folder(spark, 'nhanes')}.xpt", _transport([("SEQN", 0), ("NAME", 25), ("X", 0)], rows))
    return tables.read_nhanes_xpt(spark, path, exposures=["X"]).df.select(F.col("SEQN").alias("seqn"), F.col("NAME").alias("name"), F.round("X", 6).alias("x"))


# nations are the variants of small genotype files, regions their samples; a dosage of 3 stands for a missing call
_DOSE = "SELECT 'rs' || n_nationkey AS variant_id, 'S' || r_regionkey AS sample_id, (n_nationkey * 3 + r_regionkey * 5) % 4 AS g FROM nation, region"
_READ = f"SELECT variant_id, sample_id, CASE WHEN g < 3 THEN g END::DOUBLE AS x FROM ({_DOSE})"


def _bed(n_variants: int, n_samples: int) -> bytes:
    code_of = {0: 3, 1: 2, 2: 0, 3: 1}
    out = b"\x6c\x1b\x01"
    for v in range(n_variants):
        codes = [code_of[(v * 3 + s * 5) % 4] for s in range(n_samples)]
        out += bytes(sum(c << (2 * j) for j, c in enumerate(codes[k : k + 4])) for k in range(0, n_samples, 4))
    return out


@query(_READ)
def s4_read_plink(spark, sf):
    n, r = (table(spark, sf, t).count() for t in ("nation", "region"))
    prefix = f"{folder(spark, 'plink')}/g"
    _put(spark, f"{prefix}.bed", _bed(n, r))
    _put(spark, f"{prefix}.bim", "".join(f"{k % 22 + 1}\trs{k}\t0\t{k * 10}\tG\tA\n" for k in range(n)).encode())
    _put(spark, f"{prefix}.fam", "".join(f"F S{k} 0 0 1 -9\n" for k in range(r)).encode())
    return G.encode(GF.read_plink(spark, prefix, block=4)).select("variant_id", "sample_id", "x")


def _vcf(spark: SparkSession, sf: str) -> str:
    cell = "CASE (n_nationkey * 3 + {s} * 5) % 4 WHEN 0 THEN '7:0/0' WHEN 1 THEN '7:0|1' WHEN 2 THEN '7:1/1' ELSE '7:./.' END"
    r = table(spark, sf, "region").count()
    cells = ", ".join(cell.format(s=k) for k in range(r))
    body = _rows(spark, sf, f"SELECT n_nationkey AS k, concat_ws('\t', n_nationkey % 22 + 1, n_nationkey * 10, concat('rs', n_nationkey), 'A', 'G', '.', '.', '.', 'DP:GT', {cells}) AS line FROM nation")
    head = spark.createDataFrame([(-2, "##fileformat=VCFv4.2"), (-1, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *[f"S{k}" for k in range(r)]]))], "k long, line string")
    path = f"{folder(spark, 'vcf')}.vcf"
    head.unionByName(body).coalesce(1).sortWithinPartitions("k").select("line").write.text(path)  # one file, as a VCF is
    return path


@query(_READ)
def s5_read_vcf(spark, sf):
    return G.encode(GF.read_vcf(spark, _vcf(spark, sf), f"{folder(spark, 'vcf')}-store")).select("variant_id", "sample_id", "x")


def _zarr(spark: SparkSession, n: int, r: int) -> str:
    """A store in the layout of VCF Zarr: genotypes by Zstandard in chunks that don't divide the table, texts by zlib or as they are."""
    import zlib

    import zstandard

    path = folder(spark, "zarr")

    def put(name: str, a: np.ndarray, chunks: tuple[int, ...], codec: str | None = None) -> None:
        words = a.dtype == object
        meta = {"zarr_format": 2, "shape": a.shape, "chunks": chunks, "dtype": "|O" if words else a.dtype.str, "order": "C", "fill_value": "" if words else 0, "compressor": {"id": codec} if codec else None, "filters": [{"id": "vlen-utf8"}] if words else None}
        _put(spark, f"{path}/{name}/.zarray", json.dumps(meta).encode())
        for at in itertools.product(*[range(-(-size // c)) for size, c in zip(a.shape, chunks, strict=True)]):
            part = np.full(chunks, meta["fill_value"], a.dtype)
            piece = a[tuple(slice(k * c, (k + 1) * c) for k, c in zip(at, chunks, strict=True))]
            part[tuple(slice(0, size) for size in piece.shape)] = piece
            raw = len(part.ravel()).to_bytes(4, "little") + b"".join(len(x.encode()).to_bytes(4, "little") + x.encode() for x in part.ravel()) if words else part.tobytes()
            _put(spark, f"{path}/{name}/{'.'.join(map(str, at))}", zstandard.compress(raw) if codec == "zstd" else zlib.compress(raw) if codec else raw)

    dose = (np.arange(n)[:, None] * 3 + np.arange(r)[None, :] * 5) % 4
    alleles = np.array([[0, 0], [0, 1], [1, 1], [-1, -1]], np.int8)
    put("call_genotype", alleles[dose], (7, 2, 2), "zstd")
    put("variant_position", np.arange(n, dtype=np.int32) * 10, (7,), "zlib")
    put("variant_contig", (np.arange(n) % 22).astype(np.int8), (7,))
    put("variant_id", np.array([f"rs{k}" for k in range(n)], object), (7,), "zlib")
    put("variant_allele", np.array([["A", "G", ""]] * n, object), (7, 3))
    put("contig_id", np.array([str(k + 1) for k in range(22)], object), (22,))
    put("sample_id", np.array([f"S{k}" for k in range(r)], "<U8"), (r,))
    return path


@query(f"SELECT d.*, (n_nationkey % 22 + 1)::VARCHAR AS contig, (n_nationkey * 10)::BIGINT AS position, 'G' AS alt FROM ({_READ}) d JOIN nation ON variant_id = 'rs' || n_nationkey")
def s6_read_zarr(spark, sf):
    g = arrays.read_zarr(spark, _zarr(spark, *(table(spark, sf, t).count() for t in ("nation", "region"))))
    return G.encode(g).join(g.listing(), "variant_id").select("variant_id", "sample_id", "x", "contig", "position", "alt")


@query("SELECT 'rs' || n_nationkey AS variant_id, (n_nationkey % 22 + 1)::VARCHAR AS contig, (n_nationkey * 10)::BIGINT AS position, 'A' AS ref, 'G' AS alt FROM nation")
def s6_genotype_store(spark, sf):
    """The Parquet store: written from a VCF, opened again, its listing of variants."""
    path = folder(spark, "store")
    GF.write_genotypes(GF.read_vcf(spark, _vcf(spark, sf)), path)
    return GF.read_genotypes(spark, path).listing()


@query("SELECT kind, 'rs' || p_partkey AS variant_id, p_size::BIGINT AS pos, 'A' AS effect_allele, round(p_partkey / 8.0, 6)::DOUBLE AS beta, CASE kind WHEN 'regenie' THEN 0.01 WHEN 'mapped' THEN 2.0 ELSE 0.25 END::DOUBLE AS pval FROM part, (VALUES ('plink2'), ('regenie'), ('mapped')) v(kind)")
def s7_sumstats(spark, sf):
    plink = write_tsv(_rows(spark, sf, "SELECT concat('rs', p_partkey) AS ID, 1 AS `#CHROM`, p_size AS POS, 'A' AS A1, 'C' AS REF, p_partkey / 8 AS BETA, 0.5 AS SE, 0.25 AS P, 10 AS OBS_CT, 0.1 AS A1_FREQ FROM part"), folder(spark, "plink2"))
    regenie = write_tsv(_rows(spark, sf, "SELECT concat('rs', p_partkey) AS ID, 1 AS CHROM, p_size AS GENPOS, 'A' AS ALLELE1, 'C' AS ALLELE0, p_partkey / 8 AS BETA, 0.5 AS SE, 2.0 AS LOG10P, 10 AS N, 0.1 AS A1FREQ FROM part"), folder(spark, "regenie"))
    read = {"plink2": tables.read_sumstats(spark, plink, "plink2"), "regenie": tables.read_sumstats(spark, regenie, "regenie"), "mapped": tables.read_sumstats(spark, regenie, "regenie", {"pval": "LOG10P", "n": None})}
    out = None
    for kind, df in read.items():
        one = df.select(F.lit(kind).alias("kind"), "variant_id", F.col("pos").cast("long").alias("pos"), "effect_allele", F.round("beta", 6).cast("double").alias("beta"), F.round(F.col("pval").cast("double"), 6).alias("pval"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT 'nation' AS name, n_nationkey::BIGINT AS key, n_name AS value, true AS verified FROM nation UNION ALL SELECT 'region', r_regionkey, r_name, true FROM region")
def s8_k3_snapshot(spark, sf):
    path = folder(spark, "snapshot")
    snapshot.export(spark, path, {"nation": table(spark, sf, "nation"), "region": table(spark, sf, "region"), "left_out": table(spark, sf, "region")}, exclude=("left_out",))
    found, wrong = snapshot.open_snapshot(spark, f"parquet://{path}"), snapshot.verify(spark, path)
    rows = [found[t].select(F.lit(t).alias("name"), F.col(k).cast("long").alias("key"), F.col(v).alias("value"), F.lit(t not in wrong).alias("verified")) for t, k, v in (("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name")) if t in found and "left_out" not in found]
    return rows[0].unionByName(rows[1])


@query("SELECT n_nationkey::BIGINT AS key, n_name AS value, true AS verified, true AS copied, 0::BIGINT AS copied_again FROM nation")
def k4_snapshot_download(spark, sf):
    path, target = folder(spark, "snapshot"), folder(spark, "mirror")
    snapshot.export(spark, path, {"nation": table(spark, sf, "nation")})
    first, again = snapshot.download(spark, path, target), snapshot.download(spark, path, target)
    df = snapshot.open_snapshot(spark, target)["nation"]
    return df.select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("value"), F.lit(not snapshot.verify(spark, target)).alias("verified"), F.lit(first > 0).alias("copied"), F.lit(again).cast("long").alias("copied_again"))


def _derby(spark: SparkSession, df: DataFrame, name: str) -> str:
    """URL of a Derby database whose only table is df, a key and a text. It lies in the shared folder as an archive: such a database is read only, and driver and executors may open it at once."""
    jvm = spark._jvm
    connect = lambda url: jvm.org.apache.derby.iapi.jdbc.AutoloadedDriver().connect(url, jvm.java.util.Properties())
    shared = jvm.org.apache.hadoop.fs.Path(f"{folder(spark, 'db')}.jar")
    if shared.toUri().getScheme() not in (None, "file"):
        raise ValueError(f"Derby opens files only, not {shared.toString()}")
    key, text = df.columns
    with tempfile.TemporaryDirectory() as made:
        own = os.path.realpath(made)
        db = connect(f"jdbc:derby:{own}/db;create=true")
        with open(f"{own}/rows.csv", "w", encoding="utf-8", newline="") as f:
            csv.writer(f, quoting=csv.QUOTE_NOTNULL).writerows(df.toLocalIterator())
        db.createStatement().execute(f'CREATE TABLE {name} ("{key}" BIGINT, "{text}" CLOB)')
        db.createStatement().execute(f"CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, '{name.upper()}', '{own}/rows.csv', NULL, NULL, 'UTF-8', 0)")
        db.close()
        try:
            connect(f"jdbc:derby:{own}/db;shutdown=true")
        except Py4JJavaError as closed:
            if closed.java_exception.getSQLState() != "08006":  # how Derby says that it has shut down
                raise
        with open(shutil.make_archive(f"{own}/db", "zip", own, "db"), "rb") as f:
            _put(spark, shared.toString(), f.read())
    return f"jdbc:derby:jar:({shared.toUri().getPath()})db"


@query("SELECT n_nationkey::BIGINT AS key, n_name AS name FROM nation")
def s9_sql_source(spark, sf):
    """Through JDBC, by the database that comes with Spark."""
    url = _derby(spark, table(spark, sf, "nation").select("n_nationkey", "n_name"), "nation")
    return tables.read_sql(spark, url, "nation", key="n_nationkey", parts=3, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"))


@query("SELECT s_name AS id FROM supplier")
def s10_identifiers(spark, sf):
    path = write_lines(_rows(spark, sf, "SELECT concat('  ', s_name, ' ') AS line FROM supplier UNION ALL SELECT '# comment' FROM region UNION ALL SELECT '   ' FROM region"), folder(spark, "ids"))
    return tables.read_identifiers(spark, path)


@query("SELECT s_suppkey::VARCHAR AS id, s_name AS name, 'is_a ' || s_nationkey AS tags, s_nationkey::VARCHAR AS attribute FROM supplier")
def s11_raw_formats(spark, sf):
    """Stanzas with tags, attributes of GFF3, elements of XML and tab-separated lines give the same rows."""
    lines = lambda text, name: write_lines(_rows(spark, sf, text), folder(spark, name))
    terms = formats.obo(spark, lines("SELECT concat('[Term]\nid: ', s_suppkey, '\nname: ', s_name, ' \nis_a: is_a ', s_nationkey, ' ! x\n\n[Typedef]\nid: none\n') AS x FROM supplier", "obo"))
    gff = spark.read.text(lines("SELECT concat('ID=', s_suppkey, '; note=', s_nationkey) AS x FROM supplier", "gff")).select(formats.attribute(F.col("value"), "ID").alias("id"), formats.attribute(F.col("value"), "note").alias("attribute"))
    marked = formats.xml(spark, lines("SELECT concat('<e xmlns=\"v\" xsi:z=\"1\"><i> ', s_suppkey, ' </i></e>') AS x FROM supplier", "xml"), "e")
    flat = formats.tsv(spark, lines("SELECT '#x' AS x FROM region UNION ALL SELECT concat(s_suppkey, '\t\"', s_name) FROM supplier", "tsv"), ["id", "name"], "#")
    ids = marked.select(formats.text("e/i").alias("id")).join(flat.where(F.col("name").startswith('"')).select("id"), "id")
    return ids.join(terms.select("id", "name", F.array_join("is_a", ";").alias("tags")), "id").join(gff, "id")


@query("SELECT sha256(string_agg(n_name || chr(10), '' ORDER BY n_nationkey)) AS hash, true AS kept, true AS refused FROM nation")
def s12_download(spark, sf):
    names = "".join(f"{r[0]}\n" for r in table(spark, sf, "nation").orderBy("n_nationkey").select("n_name").collect())  # 25 nations
    root = folder(spark, "download")
    source = _put(spark, f"{root}/source.txt", names.encode())
    got = tables.fetch(spark, source, f"{root}/target.txt")
    kept = tables.fetch(spark, f"{root}/none.txt", f"{root}/target.txt", got) == got  # there already: the source isn't opened
    try:
        tables.fetch(spark, source, f"{root}/other.txt", "0" * 64)
        refused = False
    except ValueError:
        refused = not snapshot.exists(spark, f"{root}/other.txt")
    return spark.createDataFrame([(got, kept, refused)], "hash string, kept boolean, refused boolean")


@query("SELECT p_partkey::BIGINT AS id, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN p_size END::BIGINT AS size, 1::BIGINT AS files FROM part")
def k1_k2_write_csv(spark, sf):
    path = folder(spark, "csv")
    tables.write_csv(_rows(spark, sf, "SELECT p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS size FROM part"), path)
    back = spark.read.option("header", True).csv(path)
    return back.select(F.col("id").cast("long").alias("id"), "name", F.col("size").cast("long").alias("size"), F.lit(len(back.inputFiles())).cast("long").alias("files"))


@query(f"WITH {_A} SELECT alias_norm, entity_id::BIGINT AS entity_id, min(CASE WHEN is_primary THEN alias_value END) OVER (PARTITION BY entity_id) AS primary_name, true AS refused_again, true AS stale_refused FROM a WHERE length(alias_norm) >= 3")
def k5_kept_dictionary(spark, sf):
    g, path = graph(spark, sf), folder(spark, "snapshot")
    snapshot.export(spark, path, {"entity_types": g.entity_types})
    names = N.dictionary(g, stopwords=frozenset())
    N.save_dictionary(spark, path, names, N.version(g))

    def refuses(f: Callable, error: type) -> bool:
        try:
            f()
        except error:
            return True
        return False

    again = refuses(lambda: N.save_dictionary(spark, path, names, 1), FileExistsError)
    newer = K.KnowledgeGraph(g.entity_types, g.entities, g.aliases.withColumn("package_id", F.lit(9).cast("long")), g.relationships, g.locations)
    stale = refuses(lambda: N.load_dictionary(spark, path, newer), ValueError)
    return N.load_dictionary(spark, path, g).select("alias_norm", "entity_id", "primary_name", F.lit(again).alias("refused_again"), F.lit(stale).alias("stale_refused"))


@query("SELECT 'master' AS kind, p_partkey::VARCHAR AS id FROM part UNION ALL SELECT 'rejects', s_suppkey::VARCHAR FROM supplier UNION ALL SELECT 'csv', s_suppkey::VARCHAR FROM supplier")
def k6_processed_files(spark, sf):
    path = folder(spark, "processed")
    text = lambda t, c: table(spark, sf, t).select(F.col(c).cast("string").alias("id"))
    framework.write_processed({"master": text("part", "p_partkey"), "rejects": text("supplier", "s_suppkey")}, path)
    back = framework.read_processed(spark, path)
    frames = {**back, "csv": spark.read.option("header", True).csv(f"{path}/skipped_relationships.csv")}
    kinds = [df.select(F.lit(kind).alias("kind"), "id") for kind, df in frames.items()]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


# upserts


@query(f"""WITH {_E}, n AS (SELECT *, row_number() OVER (ORDER BY e1, e2, relation) AS id FROM e)
    SELECT id AS relationship_id, e1 AS entity_1_id, t1::BIGINT AS entity_1_type_id, e2 AS entity_2_id, t2::BIGINT AS entity_2_type_id, relation, n AS evidence_count, 'first' AS source FROM n
    UNION ALL SELECT (SELECT count(*) FROM n) + row_number() OVER (ORDER BY e1, e2), e1, t1, e2, t2, relation, n, 'second' FROM n WHERE relation = 'part_of'""")
def u3_add_relationships(spark, sf):
    """Edges into an empty graph, once by each order of their ends; what is there already changes nothing; another source has its own."""
    edges = _rows(spark, sf, EDGES).select(F.col("a").cast("long").alias("entity_1_id"), F.col("ta").alias("entity_1_type_id"), F.col("b").cast("long").alias("entity_2_id"), F.col("tb").alias("entity_2_type_id"), "relation", F.col("n").alias("evidence_count"))
    back = edges.select(F.col("entity_2_id").alias("entity_1_id"), F.col("entity_2_type_id").alias("entity_1_type_id"), F.col("entity_1_id").alias("entity_2_id"), F.col("entity_1_type_id").alias("entity_2_type_id"), "relation", "evidence_count")
    g = K.add_relationships(K.KnowledgeGraph.empty(spark), edges.unionByName(back), source="first")
    g = K.add_relationships(g, back, source="first")
    g = K.add_relationships(g, back.where("relation = 'part_of'"), source="second")
    return g.relationships.select("relationship_id", "entity_1_id", F.col("entity_1_type_id").cast("long").alias("entity_1_type_id"), "entity_2_id", F.col("entity_2_type_id").cast("long").alias("entity_2_type_id"), "relation", "evidence_count", "source")


@query("""SELECT p_partkey::BIGINT AS key, unnest([p_name, p_brand, lower(p_brand)]) AS alias_value, unnest(['preferred', 'synonym', 'synonym']) AS alias_type, unnest(['A', 'B', 'B']) AS xref_source FROM part
    UNION ALL SELECT p_partkey, p_type, 'code', 'C' FROM part WHERE p_partkey % 2 = 0""")
def u4_build_aliases(spark, sf):
    d = _rows(spark, sf, "SELECT p_partkey AS key, p_name AS name, array(p_brand, ' ', lower(p_brand)) AS names, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS code, CAST(NULL AS ARRAY<STRING>) AS none FROM part")
    return K.build_aliases(d, "key", {"name": ("preferred", "A"), "names": ("synonym", "B"), "code": ("code", "C"), "none": ("code", "D")}).select(F.col("key").cast("long").alias("key"), "alias_value", "alias_type", "xref_source")


@query("SELECT p_partkey::BIGINT AS key, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE substr(p_name, 1, 7) END AS short, (SELECT count(*) FROM part WHERE p_partkey % 5 <> 0 AND length(p_name) > 7) AS too_wide FROM part")
def u5_truncation_guards(spark, sf):
    d = _rows(spark, sf, "SELECT p_partkey AS key, CASE WHEN p_partkey % 5 = 0 THEN '  ' ELSE concat(' ', p_name, ' ') END AS name FROM part")
    wide = K.truncation_counts(d, {"name": 7}).withColumnRenamed("name", "too_wide").withColumn("one", F.lit(1))
    return d.select(F.col("key").cast("long").alias("key"), K.guarded(F.col("name"), 7).alias("short"), F.lit(1).alias("one")).join(wide, "one").drop("one")


# mentions


@query("SELECT s_suppkey::BIGINT AS id, lower(s_name) AS norm FROM supplier")
def n2_normalize_code(spark, sf):
    return _rows(spark, sf, "SELECT s_suppkey AS id, concat(' ', s_name, ' ') AS name FROM supplier").select(F.col("id").cast("long").alias("id"), code(F.col("name")).alias("norm"))


@query("""SELECT 'text' AS call, '0' AS record_id, 2::BIGINT AS mentions, false AS stale FROM region WHERE r_regionkey = 0 UNION ALL SELECT 'list', n_nationkey::VARCHAR, 1, true FROM nation""")
def n8_resolve_text_and_list(spark, sf):
    g = graph(spark, sf)
    names = [r[0] for r in table(spark, sf, "nation").orderBy("n_nationkey").select("n_name").collect()]  # 25 nations
    types = {"types": [6]}
    one = N.resolve_text(spark, f"From {names[0].lower()} to {names[1].title()}, not {names[2]}land", g, **types).select(F.lit("text").alias("call"), "record_id", F.lit(N.is_stale(g, 1)).alias("stale"))
    many = N.resolve_list(spark, [f"in {n}!" for n in names], g, **types).select(F.lit("list").alias("call"), "record_id", F.lit(N.is_stale(g, 0)).alias("stale"))
    return one.unionByName(many).groupBy("call", "record_id", "stale").agg(F.count(F.lit(1)).alias("mentions"))


@query("""SELECT mode, s_suppkey::VARCHAR AS record_id, 'description' AS field, 16::BIGINT AS hash_length, 0::BIGINT AS start, (length(s_name) - 1)::BIGINT AS stop, lower(s_name) AS matched, k AS entity_id, 'exact_aho' AS method, 0.5::DOUBLE AS confidence, 'pending' AS review_status
    FROM supplier, (VALUES ('best_match', 1), ('all_candidates', 1), ('all_candidates', 2), ('smart', 1), ('smart', 2)) m(mode, i), LATERAL (SELECT s_suppkey * 2 + i - 1 AS k)""")
def n7_n9_modes_and_persisted_matches(spark, sf):
    """Every supplier's name is shared by two entities: what each mode keeps, in the form that is stored."""
    s, e = table(spark, sf, "supplier"), K.KnowledgeGraph.empty(spark)
    a = s.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("i"), "s_suppkey", "s_name").select((F.col("s_suppkey") * 2 + F.col("i")).cast("long").alias("entity_id"), F.col("s_name").alias("alias_value"))
    a = a.withColumns({"alias_id": F.col("entity_id"), "type_id": F.lit(2), "alias_type": F.lit("preferred"), "xref_source": F.lit("X"), "alias_norm": F.lower("alias_value"), "is_primary": F.lit(True), "is_active": F.lit(True), "source": F.lit("t"), "package_id": F.lit(1).cast("long")})
    g = K.KnowledgeGraph(e.entity_types, e.entities, a.select(*e.aliases.columns), e.relationships, e.locations)
    out = None
    for mode in ("best_match", "all_candidates", "smart"):
        m = N.persist_matches(N.resolve_mentions(s, g, id_col="s_suppkey", text_col="s_name", mode=mode), field="description").withColumn("mode", F.lit(mode))
        out = m if out is None else out.unionByName(m)
    longs = [F.col(c).cast("long").alias(c) for c in ("start", "stop", "entity_id")]
    return out.select("mode", "record_id", "field", F.length("text_hash").cast("long").alias("hash_length"), *longs, "matched", "method", "confidence", "review_status")


# runs of loads


def _manager(spark: SparkSession, state: dict) -> framework.Manager:
    m = framework.Manager(spark, folder(spark, "etl"))

    def load(frames: dict[str, DataFrame], package: int) -> dict[str, int]:
        if state["fail"]:
            raise RuntimeError("broken")
        return {"rows": frames["x"].count(), "nothing": 0}

    m.add(framework.Source("edges", lambda: state["hash"], lambda: {"x": spark.range(2)}, load, after=("nodes",), system="b", strategy="delete"))
    m.add(framework.Source("nodes", lambda: "n", lambda: {"x": spark.range(3)}, load, system="a"))
    return m


@query("""SELECT * FROM (VALUES (1::BIGINT, 'nodes', 'completed'), (1, 'edges', 'completed'), (2, 'nodes', 'up_to_date'), (2, 'edges', 'up_to_date'), (3, 'edges', 'completed'), (4, 'nodes', 'skipped'), (4, 'edges', 'skipped'),
    (5, 'nodes', 'failed: broken'), (6, 'nodes', 'completed'), (7, 'edges', 'completed')) v(run, source, result)""")
def o1_o3_runs_and_gates(spark, sf):
    """Order of dependencies, gates by hash, changed content, resuming, failures, forced steps."""
    state = {"hash": "a", "fail": False}
    m = _manager(spark, state)
    runs = [m.run(), m.run()]
    state["hash"] = "b"
    runs += [m.run(["edges"]), m.run(resume=True)]
    state["fail"] = True
    runs.append(m.run(["nodes"], force=("load",)))
    state["fail"] = False
    runs += [m.run(systems=["a"]), m.run(["edges"], steps=("extract", "transform"))]
    rows = [(k, source, result) for k, run in enumerate(runs, 1) for source, result in run.items()]
    return spark.createDataFrame(rows, "run long, source string, result string")


@query("""SELECT * FROM (VALUES ('nodes', 'extract', 'completed', 0::BIGINT, '{}'), ('nodes', 'transform', 'completed', 0, '{}'), ('nodes', 'load', 'completed', 3, '{"rows": 3}'), ('edges', 'extract', 'completed', 0, '{}'), ('edges', 'transform', 'completed', 0, '{}'),
    ('edges', 'load', 'completed', 2, '{"rows": 2}'), ('edges', 'extract', 'up_to_date', 0, '{}'), ('edges', 'transform', 'up_to_date', 0, '{}'), ('edges', 'load', 'completed', 2, '{"rows": 2}'),
    ('selected', '2', '', 0, ''), ('skipped', '2', '', 0, ''), ('succeeded', '0', '', 0, ''), ('failed', '0', '', 0, '')) v(source, step, status, rows, stats)""")
def o2_o7_audit_and_summary(spark, sf):
    """What the audit holds of runs, with the counters that aren't zero, and the summary of a run that resumes."""
    m = _manager(spark, {"hash": "a", "fail": False})
    m.run()
    m.run(["edges"], force=("load",))
    summary = [(k, str(v), "", 0, "") for k, v in m.run_all().items()]
    return m.audit().select("source", "step", "status", "rows", "stats").unionByName(spark.createDataFrame(summary, "source string, step string, status string, rows long, stats string"))


@query("""SELECT 'soft' AS mode, s_suppkey::BIGINT AS entity_id, s_nationkey % 2 = 1 AS is_active, CASE WHEN s_nationkey % 3 > 0 THEN 1 ELSE 0 END::BIGINT AS edges FROM supplier
    UNION ALL SELECT 'hard', s_suppkey, true, 1 FROM supplier WHERE s_nationkey % 2 = 1""")
def o4_rollback(spark, sf):
    """Entities of even nations are of the source `nodes`, edges of every third nation of `edges`; edges end at their own supplier and at itself."""
    e = _rows(spark, sf, "SELECT s_suppkey AS entity_id, true AS is_active, CASE WHEN s_nationkey % 2 = 0 THEN 'nodes' ELSE 'x' END AS source, 1 AS package_id FROM supplier")
    r = _rows(spark, sf, "SELECT s_suppkey AS entity_1_id, s_suppkey AS entity_2_id, CASE WHEN s_nationkey % 3 = 0 THEN 'edges' ELSE 'x' END AS source, 1 AS package_id FROM supplier")
    m = _manager(spark, {"hash": "a", "fail": False})
    parts = []
    for mode, sources in (("soft", ["nodes", "edges"]), ("hard", ["nodes"])):
        t = m.rollback({"entities": e, "relationships": r}, sources=sources, hard=mode == "hard")
        n = t["relationships"].groupBy("entity_1_id").agg(F.count(F.lit(1)).alias("edges"))
        parts.append(t["entities"].join(n, F.col("entity_id") == F.col("entity_1_id"), "left").select(F.lit(mode).alias("mode"), F.col("entity_id").cast("long").alias("entity_id"), "is_active", F.coalesce("edges", F.lit(0)).cast("long").alias("edges")))
    return parts[0].unionByName(parts[1])


@query("SELECT * FROM (VALUES ('all', 'nodes,edges'), ('system b', 'edges'), ('unknown', 'ValueError'), ('files of nodes', 'false'), ('files of edges', 'true')) v(what, result)")
def o6_sources_and_cleanup(spark, sf):
    m = _manager(spark, {"hash": "a", "fail": False})
    m.run()
    m.clean(["nodes"])
    try:
        unknown = ",".join(m.resolve(["none"]))
    except ValueError as e:
        unknown = type(e).__name__
    there = {n: str(snapshot.exists(spark, f"{m.folder}/processed/{n}")).lower() for n in ("nodes", "edges")}
    rows = [("all", ",".join(m.resolve())), ("system b", ",".join(m.resolve(systems=["b"]))), ("unknown", unknown), *[(f"files of {n}", v) for n, v in there.items()]]
    return spark.createDataFrame(rows, "what string, result string")
