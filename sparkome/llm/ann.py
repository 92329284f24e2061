"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut in two halves and each half is quantised by its own codebook of k centroids, so that k * k
cells cost 2 * k distances. A query walks centroid pairs in the order of their summed distance with a heap until the cells
hold the wanted number of entries, and all entries of these cells are ranked by the exact measure. How many entries
it takes is itself fitted: the smallest share that reaches the wanted recall on a bounded sample,
where exact neighbours are known.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import sampled, small, written


@dataclass(frozen=True)
class Index:
    first: np.ndarray  # k x half
    second: np.ndarray  # k x rest
    share: float  # of the entries that a query's cells must hold at least

    @property
    def cut(self) -> int:
        return self.first.shape[1]

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distance of each half of each vector to the half's centroids."""
        return _distances(x[:, : self.cut], self.first), _distances(x[:, self.cut :], self.second)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(axis=1) * len(self.second) + b.argmin(axis=1)


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    x = np.unique(x, axis=0)
    if len(x) <= k:
        return x.copy()
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = _distances(x, c).argmin(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        n = np.bincount(at, minlength=len(c))
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def walk(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, wanted: int) -> np.ndarray:
    """Cells (pairs i * len(b) + j) in the order of a[i] + b[j] until they hold `wanted` entries or none is left.

    The multi-sequence traversal: a pair enters the heap once both its predecessors in the two sorted lists
    have been taken.
    """
    oa, ob = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    sa, sb = a[oa].tolist(), b[ob].tolist()
    heap, out, have, width = [(sa[0] + sb[0], 0, 0)], [], 0, len(sb)
    taken = [0] * len(sa)  # of row i the pairs (i, 0..taken[i]-1)
    ia, ib, n = oa.tolist(), ob.tolist(), sizes.tolist()
    while heap and have < wanted:
        _, i, j = heapq.heappop(heap)
        taken[i] = j + 1
        cell = ia[i] * width + ib[j]
        if n[cell]:
            out.append(cell)
            have += n[cell]
        if j + 1 < width and (i == 0 or taken[i - 1] > j + 1):
            heapq.heappush(heap, (sa[i] + sb[j + 1], i, j + 1))
        if i + 1 < len(sa) and taken[i + 1] == j:
            heapq.heappush(heap, (sa[i + 1] + sb[j], i + 1, j))
    return np.array(out, np.int64)


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products, each summed in the same order whatever rows stand beside it, so that equal vectors score equally."""
    return (x * q).sum(axis=1)


def learn(sample: np.ndarray, *, centroids: int = 32, rounds: int = 12, recall: float = 0.95, neighbours: int = 20, probes: int = 256, seed: int = 7) -> Index:
    """Fit codebooks on a sample, and the share of entries that a walk must take for the wanted mean recall on it."""
    rng = np.random.default_rng(seed)
    cut = sample.shape[1] // 2 or 1
    index = Index(_kmeans(sample[:, :cut], centroids, rounds, rng), _kmeans(sample[:, cut:], centroids, rounds, rng), 1.0)
    n = len(sample)
    if n < 4 * neighbours:
        return index
    probe = rng.choice(n, min(n, probes), replace=False)
    score = sample[probe] @ sample.T
    score[np.arange(len(probe)), probe] = -np.inf
    true = np.argpartition(-score, neighbours, axis=1)[:, :neighbours]
    cells = index.cells(sample)
    sizes = np.bincount(cells, minlength=len(index.first) * len(index.second))
    a, b = index.distances(sample[probe])
    need = []
    for k in range(len(probe)):
        order = walk(a[k], b[k], sizes, n)
        before = np.zeros(len(sizes), np.int64)
        before[order] = np.cumsum(sizes[order])
        need.append(before[cells[true[k]]] / n)
    return Index(index.first, index.second, float(min(1.0, np.quantile(np.concatenate(need), recall))))


def valid(col, dim: int | None = None):
    """Vectors that take part: not null, without null or non-finite components, not zero; of `dim` components if given."""
    ok = col.isNotNull() & (F.size(col) > 0) & F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(col, lambda x: x != 0)
    return F.coalesce(ok & (F.size(col) == dim) if dim else ok, F.lit(False))


def _matrix(column: pa.Array | pd.Series) -> np.ndarray:
    if isinstance(column, pd.Series):
        return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 1))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def search(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", neighbours: int = 20, sample_rows: int = 4096, block_rows: int = 8192, query_rows: int = 2048, recall: float = 0.95, centroids: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the `neighbours` entries of largest inner product found for each query.

    Nearness is exact on the original vectors in double precision; ties go to the smaller id, and an entry
    with the query's own id is no candidate. All rows are indexed; the codebooks and the share of entries are fitted
    on sample_rows of them, chosen by a hash of the id. Unless given, the number of centroids of a half grows as the
    root of the number of rows, from 32 on, as far as the sample has 16 rows for each. Cells are packed into blocks of about block_rows entries,
    a cell that is larger is dealt over several by id, and each block meets the queries whose walk
    enters one of its cells, query_rows of them at a time: no task holds more than a block and a set of queries, however
    common one vector is. Each block gives a query at most `neighbours` rows.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do those whose length
    differs from the commonest one, nor null ids. Repeated rows are entries of their own; a query id that is
    repeated is asked once, with the least of its vectors. Without any query or
    vector the result is empty. Other columns are not read.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"

    def of(df: DataFrame) -> DataFrame:
        x = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
        return x.where(F.col("id").isNotNull() & valid(F.col("v")))

    rows = of(vectors)
    sizes_of = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes_of:
        return spark.createDataFrame([], schema)
    dim = sizes_of[0][0]
    rows = rows.where(F.size("v") == dim)
    asked = of(queries).where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v"))
    sample = np.array([r[1] for r in sampled(rows, "id", sample_rows).collect()], np.float64)
    if centroids is None:
        centroids = max(32, min(1 << max(0, round(math.log2(sizes_of[0][1]) / 2 - 2)), len(sample) // 16))
    index = learn(sample, centroids=centroids, recall=recall, neighbours=neighbours)
    shared = spark.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shared.value.cells(_matrix(b.column(1))).astype(np.int32))], ["id", "v", "cell"])

    placed = written(rows.mapInArrow(place, "id long, v array<double>, cell int"), "ann-cells")
    n_cells = len(index.first) * len(index.second)
    sizes = np.zeros(n_cells, np.int64)  # at most k * k rows reach the driver
    for cell, n in placed.groupBy("cell").agg(F.count(F.lit(1))).collect():
        sizes[cell] = n
    total = int(sizes.sum())
    wanted = max(neighbours + 1, math.ceil(index.share * total))
    # blocks: neighbouring cells together up to block_rows, a larger cell over blocks of its own
    first_block, parts = np.zeros(n_cells, np.int32), np.ones(n_cells, np.int32)
    block, room = 0, block_rows
    for cell in np.flatnonzero(sizes).tolist():
        n = int(sizes[cell])
        if n > room and room < block_rows:
            block, room = block + 1, block_rows
        first_block[cell] = block
        if n > block_rows:
            parts[cell] = -(-n // block_rows)
            block, room = block + int(parts[cell]), block_rows
        else:
            room -= n
    plan = spark.sparkContext.broadcast((sizes, first_block, parts))
    n_asked = asked.count()
    sets = max(1, -(-n_asked // query_rows))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, first_block, parts = plan.value
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                da, db = shared.value.distances(_matrix(part.column(1)))
                who, where, bound = [], [], []
                for k in range(part.num_rows):
                    cells = walk(da[k], db[k], sizes, wanted)
                    # the last cell taken bounds the walk; cells at just this distance are entered too
                    reach = da[k][cells // db.shape[1]] + db[k][cells % db.shape[1]]
                    into = np.unique(np.concatenate([first_block[cells[parts[cells] == 1]], *[np.arange(first_block[c], first_block[c] + parts[c]) for c in cells[parts[cells] > 1].tolist()]]))
                    who += [k] * len(into)
                    where += into.tolist()
                    bound += [float(reach.max())] * len(into)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(who, pa.int64())), part.column(1).take(pa.array(who, pa.int64())), pa.array(where, pa.int32()), pa.array(bound, pa.float64())], ["id", "v", "block", "bound"])

    set_of = lambda: F.pmod(F.xxhash64("id", F.lit(1)), F.lit(sets)).cast("int")
    visits = written(asked.mapInArrow(visit, "id long, v array<double>, block int, bound double").withColumn("part", set_of()), "ann-visits")
    wanted = written(visits.select("block", "part").distinct(), "ann-wanted")

    def to_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, first_block, parts = plan.value
        for b in batches:
            cell = b.column(2).to_numpy()
            ids = b.column(0).to_numpy()
            mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            block = (first_block[cell] + mixed % parts[cell]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(block)], ["id", "v", "cell", "block"])

    entries = placed.mapInArrow(to_block, "id long, v array<double>, cell int, block int").join(small(wanted), "block")  # once for each set of queries that enters the block

    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out_q, out_v, out_s = [], [], []
        if len(left) and len(right):
            left = left.sort_values("id", kind="stable")
            ids, x, cell = left["id"].to_numpy(), _matrix(left["v"]), left["cell"].to_numpy()
            asked_ids, q, bound = right["id"].to_numpy(), _matrix(right["v"]), right["bound"].to_numpy()
            da, db = shared.value.distances(q)
            width = db.shape[1]
            for at in range(0, len(q), 256):
                score = q[at : at + 256] @ x.T
                near = da[at : at + 256][:, cell // width] + db[at : at + 256][:, cell % width] <= bound[at : at + 256, None] * (1 + 1e-9) + 1e-12
                score[~near | (asked_ids[at : at + 256, None] == ids[None, :])] = -np.inf
                for k in range(len(score)):
                    s = score[k]
                    if len(s) > neighbours:
                        least = np.partition(s, len(s) - neighbours)[len(s) - neighbours]
                        slack = 1e-9 * (1 + abs(least)) if np.isfinite(least) else 0.0
                        pick = np.flatnonzero((s >= least - slack) & (s > -np.inf))
                    else:
                        pick = np.flatnonzero(s > -np.inf)
                    if not len(pick):
                        continue
                    exact = _exact(q[at + k], x[pick])
                    best = np.lexsort((ids[pick], -exact))[:neighbours]
                    out_q += [asked_ids[at + k]] * len(best)
                    out_v += ids[pick][best].tolist()
                    out_s += exact[best].tolist()
        return pd.DataFrame({"query_id": np.array(out_q, np.int64), "vec_id": np.array(out_v, np.int64), "score": np.array(out_s, np.float64)})

    keys = ["block", "part"]
    found = entries.select("id", "v", "cell", *keys).groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInPandas(rank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # Spark cuts each task's rows of a query to the best before the shuffle
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")


def brute_force(ids: np.ndarray, x: np.ndarray, asked: np.ndarray, neighbours: int = 20) -> dict[int, list[int]]:
    """Exact neighbours of the rows `asked` (positions), for measuring recall."""
    out = {}
    for k in asked.tolist():
        s = _exact(x[k], x)
        s[ids == ids[k]] = -np.inf
        order = np.lexsort((ids, -s))[:neighbours]
        out[int(ids[k])] = ids[order][np.isfinite(s[order])].tolist()
    return out
