"""Near-copies of whole texts for the pipeline's near-dedup: operator 5 on shingles of five words, helped by banded MinHash, then the exact similarity of the shingle sets.

Texts with equal sets are one node. Candidates are, first, what operator 5 links: SimHash fingerprints of the sets that its
covering anchors bring together. Fingerprints can't tell the rest (texts of similarity 0.8 differ in about 10 of 64 bits, where
anchors would meet nearly everything; README has the figures), so nodes also have 32 bands of 5 MinHash values, and those that share a
band may be near: a pair of similarity 0.8 shares none with a probability of (1 - 0.8^5)^32, 3 in a million. What candidates connect
is a cluster. A cluster's texts meet in blocks of bounded size, where each pair of near sketches that isn't
connected yet has its sets compared, so that a group of copies gives a spanning forest and never its pairs. Clusters of more
than a block are compared block by block: first each with itself, then the nodes that still share a band with
another component with those of the other blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import col, release, settled, small, written
from .simhash import components, keep_one, links as anchor_links, majority

BANDS, ROWS = 32, 5
#: MinHash values of 160 that must agree before sets are compared: at similarity 0.8, 128 are expected with a deviation of 5, so 104 is over four of them below.
AGREE = 104
#: Nodes and bytes of text of a block.
BLOCK_NODES, BLOCK_BYTES = 4096, 48 << 20
_MULTIPLIERS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct XXH64 of a whole text's shingles: A-Z lowered, words cut at ASCII white space; fewer words than a shingle are one."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    joined = b" ".join(words)
    stop = np.cumsum(size + 1) - 1
    start = stop - size
    if len(words) > shingle:
        start, stop = start[: 1 - shingle], stop[shingle - 1 :]
    else:
        start, stop = start[:1], stop[-1:]
    h = xxhash.xxh64_intdigest
    return np.unique(np.array([h(joined[a:b]) for a, b in zip(start.tolist(), stop.tolist(), strict=True)], np.uint64))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The MinHash values of a set."""
    out = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(out, (hashes[at : at + 1024, None] * _MULTIPLIERS).min(axis=0), out=out)
    return out


def node_of(hashes: np.ndarray) -> int:
    """The name of a set as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())).astype(np.int64))


def _describe(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingles(t, shingle) for t in part.column(2).to_pylist()]
                low = np.array([minima(s) for s in sets]).reshape(-1, BANDS, ROWS)
                bands = np.array([[xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(x)] for x in low], np.uint64)
                listed = pa.ListArray.from_arrays(np.arange(0, bands.size + 1, BANDS, dtype=np.int32), pa.array(bands.ravel().view(np.int64)))
                fp = pa.array(np.array([majority(s) for s in sets], np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([node_of(s) for s in sets], pa.int64()), fp, listed, part.column(3)], ["doc_id", "hash", "node", "fp", "bands", "size"])

    return run


def forest(sets: list[np.ndarray], low: np.ndarray, root: np.ndarray, side: np.ndarray | None, similarity: float) -> list[tuple[int, int]]:
    """Links (as positions) that connect just what the links of at least the similarity between the sets do, beyond what equal `root` say is connected.

    With `side`, only pairs of different sides count. A set is compared with those of near sketches and sizes, nearest
    first, and not with what has been connected meanwhile.
    """
    size = np.array([len(s) for s in sets])
    root, out = np.unique(root, return_inverse=True)[1], []
    for i in range(len(sets) - 1):
        rest = slice(i + 1, None)
        able = (root[rest] != root[i]) & (np.minimum(size[rest], size[i]) >= similarity * np.maximum(size[rest], size[i]))
        if side is not None:
            able &= side[rest] != side[i]
        todo = i + 1 + np.flatnonzero(able)
        if not len(todo):
            continue
        agree = (low[todo] == low[i]).sum(axis=1)
        order = np.argsort(-agree, kind="stable")
        todo = todo[order[: int((agree >= AGREE).sum())]]
        while len(todo):
            j = int(todo[0])
            both = size[i] + size[j] - len(np.union1d(sets[i], sets[j]))
            if both >= similarity * (size[i] + size[j] - both):
                out.append((i, j))
                root[root == root[j]] = root[i]
                todo = todo[root[todo] != root[i]]
            else:
                todo = todo[1:]
    return out


def _compare(shingle: int, similarity: float):
    """Of rows sorted by cluster and block (columns cluster, block, node, root, side, text): links as pairs of nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        key, nodes, sets, lows, roots, sides = None, {}, [], [], [], []

        def close() -> pa.RecordBatch:
            found = []
            if len(sets) > 1:
                names = list(nodes)
                side = np.array(sides) if min(sides) != max(sides) else None
                pairs = forest(sets, np.array(lows), np.array(roots, np.int64), side, similarity) if side is not None or sides[0] < 0 else []
                found = [(names[i], names[j]) for i, j in pairs]
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for cluster, block, node, root, side, text in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    if key != (cluster, block):
                        yield close()
                        key, nodes, sets, lows, roots, sides = (cluster, block), {}, [], [], [], []
                    if node in nodes:
                        continue
                    s = shingles(text, shingle)
                    if node_of(s) == node:  # else another row with an equal id and hash of its text
                        nodes[node] = len(sets)
                        sets.append(s)
                        lows.append(minima(s).astype(np.uint32))
                        roots.append(root)
                        sides.append(side)
        yield close()

    return run


def _blocks(placed: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links a, b found in the blocks that `placed` (least, hash, cluster, block, node, root, side; a written table or a projection of one) names."""
    parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = placed.select(F.coalesce("least", F.lit(0)).alias("id"), F.col("least").isNull().alias("none"), "hash", "cluster", "block", "node", "root", "side")
    given = texts.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), F.xxhash64("text").alias("hash"), "text")
    rows = given.join(small(wanted), ["id", "none", "hash"]).select("cluster", "block", "node", "root", "side", "text")
    dealt = rows.repartition(parts, "cluster", "block").sortWithinPartitions("cluster", "block", "node")
    return dealt.mapInArrow(_compare(shingle, similarity), "a long, b long")


def _anchored(nodes: DataFrame, threshold: int = 2) -> DataFrame:
    """a, b: candidates that operator 5 gives, a tree for each group: nodes of one fingerprint, and fingerprints that differ in at most `threshold` bits."""
    first = written(nodes.groupBy("fp").agg(F.min("node").alias("first")), "fingerprints")
    same = nodes.select("node", "fp").join(first, "fp").where("node != first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    one, two = (first.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_node")) for c in ("a", "b"))
    near = anchor_links(first.select("fp"), threshold=threshold).join(one, "a").join(two, "b")
    return same.unionByName(near.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))


def _links(nodes: DataFrame, texts: DataFrame, shingle: int, similarity: float, block_nodes: int) -> DataFrame:
    """Links that connect all pairs of nodes (columns node, least, hash, size, fp, bands) that are near."""
    buckets = nodes.select(F.explode("bands").alias("bucket"), "node")
    shared = buckets.groupBy("bucket").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(shared.select("bucket", "first"), "shared")
    stars = buckets.join(small(shared), "bucket").where("node != first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct()
    star = components(stars.unionByName(_anchored(nodes)))
    cluster = star.select("node", F.col("root").alias("cluster")).unionByName(star.select(F.col("root").alias("node"), F.col("root").alias("cluster")).distinct())
    placed = cluster.join(nodes.select("node", "least", "hash", "size"), "node")
    deal = placed.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block_nodes), F.ceil(F.sum("size") / BLOCK_BYTES)).cast("int").alias("parts"))
    placed = placed.join(deal, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    placed = written(placed, "clusters")
    inside = placed.select("least", "hash", "cluster", "block", "node", F.col("node").alias("root"), F.lit(-1).alias("side"))
    links = written(_blocks(inside, texts, shingle, similarity), "links-inside")
    many = placed.where("parts > 1")
    if many.isEmpty():
        return links
    # nodes of larger clusters that share a band with another component meet the other blocks' nodes
    rooted = written(many.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    open_ = nodes.join(rooted.select("node", "root"), "node").select(F.explode("bands").alias("bucket"), "node", "root")
    mixed = open_.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("bucket")
    rest = rooted.join(open_.join(mixed, "bucket", "left_semi").select("node").distinct(), "node", "left_semi")
    other = F.explode(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: x != F.col("block")))
    pairs = rest.withColumn("other", other).withColumn("lower", F.least("block", "other")).withColumn("upper", F.greatest("block", "other"))
    crossing = written(pairs.select("least", "hash", "cluster", (F.col("lower") * F.col("parts") + F.col("upper")).alias("block"), "node", "root", F.col("block").alias("side")), "crossing")
    return links.unionByName(_blocks(crossing, texts, shingle, similarity))


def grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int = 5, similarity: float = 0.8, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """doc_id, node, root of every row, as a written table: rows with equal roots are one component."""
    return settled(docs.sparkSession, "grouped", lambda: _grouped(docs, id_col, text_col, shingle, similarity, block_nodes))


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, block_nodes: int) -> DataFrame:
    texts = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    named = texts.select("doc_id", F.xxhash64("text").alias("hash"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    rows = written(named.mapInArrow(_describe(shingle), "doc_id long, hash long, node long, fp long, bands array<long>, size long"), "bands")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("hash")))
    nodes = rows.groupBy("node").agg(first.alias("f"), F.max("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    nodes = written(nodes.select("node", F.col("f.doc_id").alias("least"), F.col("f.hash").alias("hash"), "size", "fp", "bands"), "nodes")
    stars = components(_links(nodes, texts, shingle, similarity, block_nodes))
    found = nodes.select("node").join(stars, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    return rows.select("doc_id", "node").join(found, "node")


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """doc_id, component_id of every document: one row for each row.

    Documents link where the Jaccard similarity of their sets of shingles is at least `similarity`, whose bands
    are chosen for 0.8 or more; component_id is the smallest id that links reach. Null and empty texts are
    copies of each other. A null id is no component's id unless all ids of its component are null. Repeated rows are
    in one component; an empty table gives an empty one; other columns are not read.
    """
    found = grouped(docs, id_col, text_col, shingle, similarity, block_nodes)
    ids = found.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return found.join(ids, "root").select("doc_id", "component_id")


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """The rows of docs without near-copies: of each component one row stays, with the columns of docs.

    It is the row with the smallest id (null ids come last); of rows that share that id, one whose set
    has the smallest hash, so that a repeated id never costs a text that has no copy. Rows equal in both count
    once. Null and empty texts are copies of each other; an empty table gives an empty one.
    """
    found = grouped(docs, id_col, text_col, shingle, similarity, block_nodes)
    return keep_one(docs, found, lambda text: node_of(shingles(text, shingle)), id_col=id_col, text_col=text_col)
