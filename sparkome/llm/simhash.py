"""SimHash fingerprints and near-duplicates by covering anchors.

Fingerprints of 64 bits are cut into blocks of 23, 23 and 18 bits. In each block the words of the perfect
binary Golay code (23 bits, 12 free ones, every word within 3 of exactly one code word; the last block is
padded with zeros) are the anchors, and an anchor of a fingerprint is one for each block. A fingerprint is
replicated to every anchor that is nearest to some word within the threshold of it, which are the anchors within
covering radius plus threshold that can matter. Each of the two sides of a link may take half: if x and y differ in t bits, some z
differs from x in at most ceil(t/2) and from y in at most floor(t/2) of them, and both reach z's nearest anchor. Fingerprints are
compared at each anchor, and connected components follow from the links.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .common import col, packed, remove, settled, small, written

BLOCKS = ((0, 23), (23, 23), (46, 18))
#: The generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the Golay code.
GOLAY = 0b110001110101
#: Up to so many fingerprints at an anchor are compared by a matrix of differing bits; more of them by their neighbours' keys.
MATRIX = 512


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of a whole text: A-Z lowered, words cut at ASCII white space, each shingle's XXH64; a bit is 1 if over half of the hashes have it."""
    raw = (text or "").encode().lower()
    words = raw.split()
    if not words:
        return 0
    size = np.fromiter(map(len, words), np.int64, len(words))
    joined = b" ".join(words)
    stop = np.cumsum(size + 1) - 1
    start = stop - size
    if len(words) > shingle:
        start, stop = start[: 1 - shingle], stop[shingle - 1 :]
    else:
        start, stop = start[:1], stop[-1:]
    h = xxhash.xxh64_intdigest
    return majority(np.array([h(joined[a:b], seed) for a, b in zip(start.tolist(), stop.tolist(), strict=True)], "<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        count += np.unpackbits(hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << k for k in np.flatnonzero(2 * count > len(hashes)).tolist()))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp (64 bits as a signed long) of every whole text. Null and empty texts: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                fp = np.array([fingerprint(t, shingle, seed) for t in part.column(1).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp)], ["doc_id", "fp"])

    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _remainder(word: int) -> int:
    for k in range(22, 10, -1):
        if word >> k & 1:
            word ^= GOLAY << (k - 11)
    return word


@functools.cache
def _code() -> tuple[np.ndarray, np.ndarray]:
    """For each single bit its syndrome, and for each of the 2048 syndromes the error of weight 3 at most."""
    bit = np.array([_remainder(1 << k) for k in range(23)], np.int64)
    error = np.zeros(2048, np.int64)
    for weight in range(4):
        for bits in itertools.combinations(range(23), weight):
            error[np.bitwise_xor.reduce(bit[list(bits)]) if bits else 0] = sum(1 << k for k in bits)
    return bit, error


def _syndrome(words: np.ndarray) -> np.ndarray:
    bit, _ = _code()
    out = np.zeros(len(words), np.int64)
    for k in range(23):
        out ^= np.where(words >> k & 1, bit[k], 0)
    return out


@functools.cache
def _offsets(width: int, flips: int) -> list[np.ndarray]:
    """For each syndrome: what to add to a word for the code words nearest to some word within `flips` of it."""
    bit, error = _code()
    moves = [(0, 0)]
    for weight in range(1, flips + 1):
        moves += [(sum(1 << k for k in bits), int(np.bitwise_xor.reduce(bit[list(bits)]))) for bits in itertools.combinations(range(width), weight)]
    move, syn = np.array(moves, np.int64).T
    return [np.unique(move ^ error[s ^ syn]) for s in range(2048)]


def anchors(fp: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for every fingerprint and each anchor nearest to some word within `reach` bits of it.

    An anchor is the 12 upper bits (which say it all, the code being systematic) of each block's code word.
    """
    fp = fp.view(np.uint64) if fp.dtype == np.int64 else fp
    words = [((fp >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in BLOCKS]
    syndromes = [_syndrome(w) for w in words]
    rows, keys = [], []
    # how many of the flips each block gets; a block's own sets are nested, so only full spendings count
    for spend in itertools.product(range(reach + 1), repeat=len(BLOCKS)):
        if sum(spend) != reach:
            continue
        row = np.arange(len(fp))
        key = np.zeros(len(fp), np.int64)
        for word, syndrome, (_, width), flips in zip(words, syndromes, BLOCKS, spend, strict=True):
            sets = _offsets(width, flips)
            size = np.array([len(x) for x in sets])
            flat, first = np.concatenate(sets), np.concatenate(([0], np.cumsum(size)[:-1]))
            s = syndrome[row]
            many = size[s]
            at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            offset = flat[np.repeat(first[s], many) + at]
            row, key = np.repeat(row, many), np.repeat(key, many)
            key = key << 12 | (word[row] ^ offset) >> 11
        rows.append(row)
        keys.append(key)
    if len(rows) == 1:
        return rows[0], keys[0]
    bits = 12 * len(BLOCKS)
    both = np.unique(np.concatenate(rows) << bits | np.concatenate(keys))  # for up to 2^27 rows at a time
    return both >> bits, both & ((1 << bits) - 1)


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def forest(fp: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links (as positions) that connect just what the links between differing fingerprints at `threshold` or fewer bits connect.

    Few fingerprints are compared by a matrix. Many are sorted by the keys of all words within half of the
    threshold, of which linked ones share one; that is exact too, and grows as their number.
    """
    n = len(fp)
    parent = list(range(n))

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    out = []

    def link(a: int, b: int) -> None:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((min(a, b), max(a, b)))

    if n <= MATRIX:
        a, b = np.nonzero(np.triu(_bits(fp[:, None] ^ fp[None, :]) <= threshold, 1))
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            link(x, y)
        return out
    half = threshold // 2
    masks = [0]
    for weight in range(1, half + 1):
        masks += [sum(1 << k for k in bits) for bits in itertools.combinations(range(64), weight)]
    masks_ = np.array(masks, np.uint64)
    step = max(1, (1 << 22) // n)
    keys = np.concatenate([(fp[:, None] ^ masks_[at : at + step]).ravel() for at in range(0, len(masks_), step)])
    who = np.concatenate([np.repeat(np.arange(n), len(masks_[at : at + step])) for at in range(0, len(masks_), step)])
    order = np.argsort(keys, kind="stable")
    keys, who = keys[order], who[order]
    same = np.flatnonzero(keys[1:] == keys[:-1])
    pairs = np.unique(np.sort(np.stack([who[same], who[same + 1]]), axis=0), axis=1)
    for x, y in zip(*pairs.tolist(), strict=True):
        link(x, y)
    if threshold % 2:  # an odd threshold: one side has a bit more to flip, so pairs one bit beyond the shared keys remain
        for k in range(64):
            at = np.searchsorted(keys, keys ^ np.uint64(1 << k))
            at[at == len(keys)] = 0
            hit = np.flatnonzero(keys[at] == keys ^ np.uint64(1 << k))
            for x, y in zip(who[hit].tolist(), who[at[hit]].tolist(), strict=True):
                link(x, y)
    return out


def _replicate(reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for at in range(0, len(fp), 4096):
                part = fp[at : at + 4096]
                row, key = anchors(part, reach)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row])], ["anchor", "fp"])

    return run


def _compare(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_a, rest_f = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def links(anchor: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            found: list[tuple[int, int]] = []
            edge = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1], [True])))
            size = np.diff(edge)
            two = edge[:-1][size == 2]  # most anchors that several reach are reached by two
            pair = two[_bits((fp[two] ^ fp[two + 1]).view(np.uint64)) <= threshold] if len(two) else two
            found += zip(fp[pair].tolist(), fp[pair + 1].tolist(), strict=True)
            for a, n in zip(edge[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
                group = fp[a : a + n]
                found += [(int(group[x]), int(group[y])) for x, y in forest(group.view(np.uint64), threshold)]
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

        for batch in batches:
            anchor = np.concatenate([rest_a, batch.column(0).to_numpy()])
            fp = np.concatenate([rest_f, batch.column(1).to_numpy()])
            if not len(anchor):
                continue
            cut = int(np.searchsorted(anchor, anchor[-1]))
            rest_a, rest_f = anchor[cut:], fp[cut:]
            if cut:
                yield links(anchor[:cut], fp[:cut])
        if len(rest_a):
            yield links(rest_a, rest_f)

    return run


def links(distinct: DataFrame, *, threshold: int = 2) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that connect all that differ in at most `threshold` bits.

    Not all pairs of a group: at each anchor a spanning forest of its links, so rows grow as fingerprints do.
    """
    reach = (threshold + 1) // 2
    spread = distinct.select("fp").mapInArrow(_replicate(reach), "anchor long, fp long")
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = spread.repartition(parts, "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(_compare(threshold), "a long, b long").distinct()


def components(edges: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """node, root: each node of the edges (a, b) with the smallest node that it reaches, but for those nodes themselves.

    Alternates large-star and small-star steps, each written to the shared folder, until edges are stars
    about their roots; that takes rounds as the logarithm of the nodes, and no node's links are gathered
    in one row: a step only needs each node's smallest neighbour, joined back.
    """
    spark = edges.sparkSession
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "links")
    kept = now.inputFiles()[:1]
    before = None
    for _ in range(most_rounds):
        # large star: each neighbour above a node gets the node's least neighbour
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: each neighbour below a node, and the node, get the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        after = written(small, "links")
        state = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if kept:
            remove(spark, kept[0].rpartition("/")[0])
        now, kept = after, after.inputFiles()[:1]
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
    raise RuntimeError(f"components were not settled after {most_rounds} rounds")


def _grouped(docs: DataFrame, id_col: str, text_col: str, threshold: int, shingle: int) -> DataFrame:
    """doc_id, node (the fingerprint), root of every row: rows with equal roots are one component."""
    rows = written(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "fingerprints")
    distinct = rows.select("fp").distinct()
    star = components(links(distinct, threshold=threshold)).withColumnRenamed("node", "fp")
    found = written(distinct.join(star, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "roots")
    # copies of one text may be a third of the rows: the adaptive planner deals such a join's rows over several tasks
    return rows.join(found, "fp").select("doc_id", F.col("fp").alias("node"), "root")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: int = 2, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint, component_id of every document: one row for each row.

    Documents link where their fingerprints differ in at most `threshold` bits; component_id is the smallest
    id that links reach. Equal fingerprints are one node, so copies never become pairs: each is looked up.
    Null and empty texts have fingerprint 0 and link like any other. A null id is no component's
    id unless all ids of its component are null. Repeated rows are in one component; an empty table gives an empty one; other columns are not read.
    """
    found = settled(docs.sparkSession, "grouped", lambda: _grouped(docs, id_col, text_col, threshold, shingle))
    ids = found.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return found.join(ids, "root").select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, found: DataFrame, node_of: Callable[[str | None], int], *, id_col: str, text_col: str) -> DataFrame:
    """One row of docs for each root of `found` (doc_id, node, root of every row; read several times, so a written table).

    It is the row with the least (id, node), null ids last. Rows that nothing but their id is needed for are
    kept or dropped by it; rows whose id is repeated or null are told apart by their node, which is made anew from the text.
    """
    none = F.col("doc_id").isNull()
    kept = found.groupBy("root").agg(F.min(F.struct(none.alias("none"), F.col("doc_id"), F.col("node"))).alias("k")).select("k.*")
    by_id = found.where(~none).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    repeated = written(by_id.where("n > 1").select("doc_id"), "repeated")
    going = written(found.where(~none).select("doc_id").distinct().join(kept.where("not none").select("doc_id"), "doc_id", "left_anti"), "going")
    rows = docs.select(packed(docs), col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    given = rows.where(~none)
    out = given.join(small(going.unionByName(repeated)), "doc_id", "left_anti").select("row.*")
    if repeated.isEmpty() and found.where(none).isEmpty():
        return out

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([node_of(t) for t in batch.column(2).to_pylist()], pa.int64())], ["row", "doc_id", "node"])

    told = given.join(small(repeated), "doc_id", "left_semi").select("row", "doc_id", "text").unionByName(rows.where(none))
    order = F.lit(0) if "map<" in docs.schema.simpleString() else F.xxhash64("row")
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("doc_id", T.LongType()), T.StructField("node", T.LongType())])
    told = told.mapInArrow(named, schema).withColumn("none", none).withColumn("id", F.coalesce("doc_id", F.lit(0))).withColumn("order", order)
    one = kept.select("none", F.coalesce("doc_id", F.lit(0)).alias("id"), "node")
    first = told.join(one, ["none", "id", "node"], "left_semi").groupBy("none", "id", "node").agg(F.min_by("row", "order").alias("row"))
    return out.unionByName(first.select("row.*"))


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: int = 2, shingle: int = 3) -> DataFrame:
    """The rows of docs without near-duplicates: of each component one row stays, with the columns of docs.

    It is the row with the smallest id (null ids come last); of rows that share that id, the one with the
    smallest fingerprint, so that a repeated id never costs a text that has no near-duplicate. Rows equal in both count
    once. Null and empty texts are copies of each other; an empty table gives an empty one.
    """
    found = settled(docs.sparkSession, "grouped", lambda: _grouped(docs, id_col, text_col, threshold, shingle))
    return keep_one(docs, found, lambda text: int(np.uint64(fingerprint(text, shingle)).astype(np.int64)), id_col=id_col, text_col=text_col)
