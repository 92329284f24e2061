"""Readers and stores on files written here byte by byte."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkome.operators import genotypes as G
from sparkome.sources import genotypes as GF, snapshot, tables
from sparkome.streaming.incremental import load_new


def ibm(x):
    if x is None:
        return b"." + bytes(7)
    if x == 0:
        return bytes(8)
    sign, x, e = (0x80 if x < 0 else 0), abs(x), 64
    while x >= 1:
        x, e = x / 16, e + 1
    while x < 1 / 16:
        x, e = x * 16, e - 1
    return bytes([sign | e]) + int(x * 2**56).to_bytes(7, "big")


def write_xpt(path, columns, rows):
    card = lambda b: b.ljust(80)
    out = card(b"HEADER RECORD*******LIBRARY HEADER RECORD!!!!!!!000000000000000000000000000000") + card(b"SAS") * 2
    out += card(b"HEADER RECORD*******MEMBER  HEADER RECORD!!!!!!!000000000000000001600000000140") + card(b"HEADER RECORD*******DSCRPTR HEADER RECORD!!!!!!!000000000000000000000000000000") + card(b"SAS") * 2
    out += card(b"HEADER RECORD*******NAMESTR HEADER RECORD!!!!!!!" + b"000000%04d" % len(columns) + b"00000000000000000000")
    names, place = b"", 0
    for k, (name, text, width) in enumerate(columns):
        names += struct.pack(">hhhh8s40s8shhh2s8shhl52s", 2 if text else 1, 0, width, k + 1, name.encode().ljust(8), b"", b"", 0, 0, 0, b"", b"", 0, 0, place, b"")
        place += width
    out += names.ljust(-(-len(names) // 80) * 80) + card(b"HEADER RECORD*******OBS     HEADER RECORD!!!!!!!000000000000000000000000000000")
    data = b"".join(b"".join(v.encode().ljust(w) if t else ibm(v)[:w] for (_, t, w), v in zip(columns, row, strict=True)) for row in rows)
    path.write_bytes(out + data.ljust(-(-len(data) // 80) * 80))


def test_transport_file(spark, tmp_path):
    rows = [(float(k), -k / 7 if k % 5 else None, f"t{k}", 1.0) for k in range(1000)]
    write_xpt(tmp_path / "a.xpt", [("SEQN", False, 8), ("X", False, 8), ("NAME", True, 6), ("SHORT", False, 4)], rows)
    phen = tables.read_nhanes_xpt(spark, str(tmp_path / "a.xpt"), exposures=["X"])
    got = sorted(tuple(r) for r in phen.df.collect())
    assert len(got) == 1000 and got[5] == (5.0, None, "t5", 1.0) and got[6][1] == pytest.approx(-6 / 7)
    raw = tables.read_xpt(spark, str(tmp_path / "a.xpt"), rows_per_chunk=64)
    assert sorted(r.SEQN for r in raw.collect()) == [float(k) for k in range(1000)]


def test_tables_and_sumstats(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("sample_id\tx\n1\t2.5\n2\t\n")
    (tmp_path / "b.csv").write_text("sample_id,x\n1,2\n")
    (tmp_path / "ids.txt").write_text("# some\n a \n\nb\n")
    assert tables.read_table(spark, str(tmp_path / "a.tsv")).dtypes == [("sample_id", "int"), ("x", "double")]
    assert tables.read_table(spark, str(tmp_path / "b.csv"), schema="sample_id string, x long").first().sample_id == "1"
    assert [r.id for r in tables.read_identifiers(spark, str(tmp_path / "ids.txt")).collect()] == ["a", "b"]
    (tmp_path / "r.txt").write_text("CHROM\tGENPOS\tID\tALLELE0\tALLELE1\tA1FREQ\tN\tBETA\tSE\tLOG10P\n1\t5\trs1\tA\tG\t0.1\t10\t0.5\t0.1\t2\n")
    r = tables.read_sumstats(spark, str(tmp_path / "r.txt"), "regenie").first()
    assert r.pval == pytest.approx(0.01) and (r.effect_allele, r.other_allele, r.pos) == ("G", "A", 5)
    assert tables.read_sumstats(spark, str(tmp_path / "r.txt"), "regenie", {"pval": "LOG10P"}).first().pval == 2
    assert "n" not in tables.read_sumstats(spark, str(tmp_path / "r.txt"), "regenie", {"n": None}).columns
    with pytest.raises(KeyError):
        tables.read_sumstats(spark, str(tmp_path / "r.txt"), "plink2")
    with pytest.raises(ValueError):
        tables.read_sumstats(spark, str(tmp_path / "r.txt"))


def test_plink_and_store(spark, tmp_path):
    r = np.random.default_rng(0)
    n, m = 11, 9
    gt = r.choice([0, 1, 2, -1], (m, n))  # copies of A1
    code = {2: 0, -1: 1, 1: 2, 0: 3}
    body = b""
    for row in gt:
        for k in range(0, n, 4):
            body += bytes([sum(code[int(v)] << (2 * j) for j, v in enumerate(row[k : k + 4]))])
    (tmp_path / "p.bed").write_bytes(b"\x6c\x1b\x01" + body)
    (tmp_path / "p.bim").write_text("".join(f"{k % 2 + 1}\trs{k}\t0\t{k * 10}\tG\tA\n" for k in range(m)))
    (tmp_path / "p.fam").write_text("".join(f"F S{k} 0 0 1 -9\n" for k in range(n)))
    geno = GF.read_plink(spark, str(tmp_path / "p"), block=4)
    got = {(r_.variant_id, r_.sample_id): r_.x for r_ in G.encode(geno).collect()}
    assert got == {(f"rs{k}", f"S{s}"): None if gt[k, s] < 0 else float(gt[k, s]) for k in range(m) for s in range(n)}
    GF.write_genotypes(geno, str(tmp_path / "store"))
    back = GF.read_genotypes(spark, str(tmp_path / "store"))
    assert back.variants.count() == m and back.calls.exceptAll(geno.calls).count() == 0
    assert geno.listing().where("variant_id = 'rs3'").first().alt == "G"


def test_vcf(spark, tmp_path):
    (tmp_path / "a.vcf").write_text("##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\n1\t10\trs1\tA\tG,T\t.\t.\t.\tDP:GT\t3:0|1\t2:./.\nX\t20\t.\tC\t<DEL>\t.\t.\t.\tGT\t1\t0/0\n")
    g = GF.read_vcf(spark, str(tmp_path / "a.vcf"), str(tmp_path / "cache"))
    assert {(r.variant_id, r.contig, tuple(r.alleles)) for r in g.variants.collect()} == {("rs1", "1", ("A", "G", "T")), ("X:20:C:<DEL>", "X", ("C", "<DEL>"))}
    calls = {(r.variant_idx, r.sample_id): r.gt for r in g.calls.collect()}
    assert calls == {(0, "S1"): [0, 1], (0, "S2"): [-1, -1], (1, "S1"): [1, 1], (1, "S2"): [0, 0]}
    (tmp_path / "a.vcf").unlink()
    assert GF.read_vcf(spark, str(tmp_path / "a.vcf"), str(tmp_path / "cache")).variants.count() == 2


def test_snapshot(spark, tmp_path):
    path = str(tmp_path / "snap")
    made = snapshot.export(spark, path, {"a": spark.range(5), "b": spark.createDataFrame([], "x array<int>"), "c": spark.range(1)}, exclude=("c",))
    assert made["tables"]["a"]["rows"] == 5 and set(made["tables"]) == {"a", "b"}
    found = snapshot.open_snapshot(spark, f"parquet://{path}", views=True)
    assert found["b"].dtypes == [("x", "string")] and spark.sql("select count(*) from a").first()[0] == 5
    assert snapshot.verify(spark, path) == []
    with pytest.raises(FileExistsError):
        snapshot.export(spark, path, {"a": spark.range(5)})
    spark.range(6).write.mode("overwrite").parquet(f"{path}/a.parquet")
    assert snapshot.verify(spark, path) == ["a"]
    assert json.loads((tmp_path / "snap" / "manifest.json").read_text())["format"] == 1


def test_incremental_load(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    go = lambda: load_new(spark, src, "id long", lambda d: d.withColumn("y", F.col("id") * 2), out, ck, keys=["id"]).awaitTermination()
    spark.range(5).write.parquet(src)
    go()
    spark.range(3, 8).write.mode("append").parquet(src)
    go()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(8))
