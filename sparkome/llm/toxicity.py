"""Toxic passages as maximum-scoring segments of token log-odds, calibrated by extreme-value statistics.

A token's score is its log-odds between toxic and clean texts under an informative Dirichlet prior (the
frequencies of both together), kept where its z-value says that it isn't chance; any other token costs a
little, so that a passage ends. One linear pass finds every maximal scoring segment (each that can't be
extended or joined with another for gain). By the extreme-value law for such segments, one of score S in
n clean tokens has the E-value K n exp(-lambda S), with lambda the positive root of E[exp(lambda s)] = 1
over clean tokens and K fitted on clean texts. A text's best few segments together have a tail probability by the law's
sum statistic, and its score is a logistic of the logarithm of that alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import col, held_out, scratch, small, stratified, written
from .near_copies import grouped

_TOKEN = re.compile(r"[^\W_]+")


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def maximal_segments(at: list[int], gain: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a sequence in which position at[k] scores gain[k] and any other -drift.

    Runs in time linear in the number of given positions: candidates stay on a stack with the cumulative
    score before and after them, and each refers to the nearest earlier one with a lower score before it.
    """
    stack: list[list] = []  # first, last, cumulative before, cumulative after, index of the nearest earlier one that starts lower
    total, before = 0.0, -1
    for k, pos in enumerate(at):
        total -= drift * (pos - before - 1)
        before = pos
        if gain[k] <= 0:
            total += gain[k]
            continue
        item = [pos, pos, total, total + gain[k], -1]
        total += gain[k]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= item[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= item[3]:
                item[4] = j
                stack.append(item)
                break
            item = [stack[j][0], item[1], stack[j][2], item[3], -1]
            del stack[j:]
    return [(a, b, hi - lo) for a, b, lo, hi, _ in stack]


@dataclass(frozen=True)
class Model:
    gains: dict[str, float] = field(default_factory=dict)
    drift: float = 1.0
    rate: float = 1.0  # lambda
    k: float = 1.0
    weights: tuple[float, float] = (0.0, -20.0)

    def raw_segments(self, words: list[str]) -> list[tuple[int, int, float]]:
        """(first token, last token, score) of every maximal segment."""
        gains = self.gains
        hits = [(k, g) for k, w in enumerate(words) if (g := gains.get(w)) is not None]
        return maximal_segments([k for k, _ in hits], [g for _, g in hits], self.drift)

    def segments(self, words: list[str]) -> list[tuple[int, int, float, float]]:
        """(first token, last token, score, E-value) of every maximal segment."""
        return [(a, b, s, self.k * len(words) * math.exp(-min(700.0, self.rate * s))) for a, b, s in self.raw_segments(words)]

    def evidence(self, scores: list[float], n: int) -> float:
        """-ln of the probability that clean text of n tokens has segments of such scores: of the r best together, with
        t = sum(lambda s) - r ln(K n), it is about exp(-t) t^(r-1) / (r! (r-1)!); the r that says most counts. 0 if nothing stands out."""
        best = t = 0.0
        shift = math.log(max(self.k * n, 1e-300))
        for r, s in enumerate(sorted(scores, reverse=True)[:50], 1):
            t += self.rate * s - shift
            if t <= 0:
                break
            best = max(best, t - (r - 1) * math.log(t) + math.lgamma(r + 1) + math.lgamma(r))
        return best

    def calibrated(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.weights[0] * min(evidence, 50.0) + self.weights[1]))))

    def score(self, text: str | None) -> float:
        words = tokens(text)
        return self.calibrated(self.evidence([s for *_, s in self.raw_segments(words)], len(words)))


def _root(values: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum(share * exp(x * values)) = 1; the mean of values must be below 0."""
    low, high = 0.0, 1.0
    f = lambda x: float((share * np.exp(np.minimum(700, x * values))).sum()) - 1
    while f(high) < 0 and high < 1e3:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return (low + high) / 2


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weighted ridge logistic regression; the last column is the constant, which isn't shrunk."""
    beta = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], ridge)
    shrink[-1] = 1e-9
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(shrink) + 1e-9 * np.eye(len(beta))
        step = np.linalg.solve(h, x.T @ (w * (y - p)) - shrink * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of columns y, text: token, n0, n1, the numbers of texts of each class that hold it, added up as far as a task's memory allows."""
    count: tuple[Counter, Counter] = (Counter(), Counter())

    def flush() -> pa.RecordBatch:
        names = sorted(count[0].keys() | count[1].keys())
        out = [pa.array(names, pa.string()), *(pa.array([c[w] for w in names], pa.int64()) for c in count)]
        for c in count:
            c.clear()
        return pa.RecordBatch.from_arrays(out, ["token", "n0", "n1"])

    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            for y, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                count[y].update(set(tokens(text)))
            if len(count[0]) + len(count[1]) > 200_000:
                yield flush()
    yield flush()


def _clean_hits(gains: dict[str, float]):
    """Of column text: token, n of listed tokens, and one row with a null token for the number of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits, total = Counter(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                for text in batch.column(0).slice(at, 512).to_pylist():
                    words = tokens(text)
                    total += len(words)
                    hits.update(w for w in words if w in gains)
        yield pa.RecordBatch.from_arrays([pa.array([*hits, None], pa.string()), pa.array([*hits.values(), total], pa.int64())], ["token", "n"])

    return run


def _reach(model: Model):
    """Of columns id, y, text: id, y, size, the scores of the text's best segments (evidence looks at 50)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, size, scores = batch.slice(at, 512), [], []
                for text in part.column(2).to_pylist():
                    words = tokens(text)
                    size.append(len(words))
                    scores.append(sorted((s for *_, s in model.raw_segments(words)), reverse=True)[:50])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(size, pa.int64()), pa.array(scores, pa.list_(pa.float64()))], ["id", "y", "size", "scores"])

    return run


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 8000, prior: float = 50.0, least_z: float = 3.0, least_texts: int = 3, gap: int = 20, vocabulary: int = 50_000) -> Model:
    """Learn from the labelled rows outside the held-out quarter.

    Tokens are counted by Spark over all of their whole texts: a token counts once a text, and of the texts of a class that
    operator 5 finds to be near-duplicates the one with the smallest id counts. At most `vocabulary` tokens, those of the highest z-value,
    reach the driver. The calibration takes at most max_rows / 2 rows of each class, as numbers, with
    the weights that classes have among all such rows. Labels other than 0 and 1, and null ids, are left out; a null text
    has no token. No toxic or no clean text, or nothing that tells them apart: a model that scores all about 0.
    """
    with scratch(docs.sparkSession):
        return _fit(docs, labels, id_col, text_col, label_col, max_rows, prior, least_z, least_texts, gap, vocabulary)


def _fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int, prior: float, least_z: float, least_texts: int, gap: int, vocabulary: int) -> Model:
    known = labels.where(col(label_col).isin(0, 1) & col(id_col).isNotNull() & ~held_out(col(id_col))).select(col(id_col).cast("long").alias("id"), col(label_col).cast("int").alias("y")).distinct()
    known = written(known, "toxic-labels")
    rows = docs.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text"))
    data = written(rows.join(small(known), "id").select("id", "y", "text"), "toxic-rows")
    many = {r[0]: r[1] for r in data.groupBy("y").count().collect()}
    if len(many) < 2:
        return Model()
    alike = grouped(data, "id", "text").select(F.col("doc_id").alias("id"), "root")
    first = alike.distinct().join(known, "id").groupBy("root", "y").agg(F.min("id").alias("id")).select("id", "y").distinct()
    taught = written(data.join(small(written(first, "toxic-first")), ["id", "y"], "left_semi"), "toxic-taught")
    count = written(taught.select("y", "text").mapInArrow(_count_tokens, "token string, n0 long, n1 long").groupBy("token").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "toxic-tokens")
    all0, all1 = count.agg(F.sum("n0"), F.sum("n1")).first()
    if not all0 or not all1:
        return Model()
    a = 0.5 + prior * (F.col("n0") + F.col("n1")) / (all0 + all1)
    odds = [F.log((F.col(f"n{y}") + a) / (n + prior - F.col(f"n{y}") - a)) for y, n in enumerate((all0, all1))]
    scored = count.where(F.col("n0") + F.col("n1") >= least_texts).withColumn("gain", odds[1] - odds[0])
    scored = scored.withColumn("z", F.abs("gain") / F.sqrt(1 / (F.col("n1") + a) + 1 / (F.col("n0") + a)))
    gains = {r[0]: r[1] for r in sorted(scored.where(F.col("z") >= least_z).orderBy(F.desc("z"), "token").limit(vocabulary).select("token", "gain").collect())}
    up = [g for g in gains.values() if g > 0]
    if not up:
        return Model()
    drift = float(np.median(up)) / gap
    hits = taught.where("y = 0").select("text").mapInArrow(_clean_hits(gains), "token string, n long")
    clean = {r[0]: r[1] for r in hits.groupBy("token").agg(F.sum("n")).collect()}  # at most a row for each listed token
    total = clean.pop(None, 0)
    values = np.array([*gains.values(), -drift])
    share = np.array([*[(clean.get(w, 0) + 0.05) for w in gains], max(1, total - sum(clean.values()))], float)
    share /= share.sum()
    if (values * share).sum() >= -1e-9:
        drift = max(drift, 2 * float((values[:-1] * share[:-1]).clip(0).sum()))
        values[-1] = -drift
    model = Model(gains, drift, _root(values, share), 1.0)
    # K: as many clean texts exceed a level, the median of their positive best scores, as the law expects
    reach = written(data.select("id", "y", "text").mapInArrow(_reach(model), "id long, y int, size long, scores array<double>"), "toxic-reach")
    best = F.coalesce(F.get("scores", F.lit(0)), F.lit(0.0))
    calm = reach.where("y = 0").select(best.alias("best"), "size")
    level = calm.where("best > 0").agg(F.percentile_approx("best", 0.5, 10_000)).first()[0] or float(np.median(up))
    above, words = calm.agg(F.sum((F.col("best") >= level).cast("int")), F.sum("size")).first()
    k = max(1e-6, (above + 0.5) / max(words * math.exp(-model.rate * level), 1e-9))
    model = Model(gains, drift, model.rate, k)
    got = stratified(reach, "y", "id", max(1, max_rows // 2)).select("y", "size", "scores").collect()
    y = np.array([r[0] for r in got], float)
    have = Counter(y)
    weight = np.array([many[int(v)] / have[v] for v in y])
    x = np.array([(min(model.evidence(list(r[2]), r[1]), 50.0), 1.0) for r in got])
    return Model(gains, drift, model.rate, k, tuple(map(float, logistic(x, y, weight * len(y) / weight.sum()))))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))


def passages(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", most_e: float = 0.01) -> DataFrame:
    """Every significant passage of every whole text: doc_id, start, stop (character offsets), passage, score, e_value.

    Null and empty texts have none. Of segments that would gain by being joined there is one, so passages of a
    text don't overlap. Each row is searched by itself: repeated rows give equal passages, an empty table none; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out: list[tuple] = []
                part = batch.slice(at, 256)
                for doc, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    spans = [m.span() for m in _TOKEN.finditer(text or "")]
                    for a, b, s, e in shared.value.segments([text[i:j].lower() for i, j in spans]):
                        if e <= most_e:
                            out.append((doc, spans[a][0], spans[b][1], text[spans[a][0] : spans[b][1]], s, e))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 6, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64()), strict=True)], ["doc_id", "start", "stop", "passage", "score", "e_value"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, start long, stop long, passage string, score double, e_value double")


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text; nothing but the text goes into a score.

    Null and empty texts have no passage and get the score of that. Rows are scored by themselves, so
    repeated rows get equal scores and an empty table gives an empty one; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shared.value.score(t) for t in part.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    out = _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
