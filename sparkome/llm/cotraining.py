"""Quality scores by co-training: a classifier of the text and one of the page's metadata teach each other.

Each view has a logistic regression. The features of every document are written once. In every round each view scores all unlabelled
documents and hands those it is surest of, a share of them all with the classes in the labelled rows' balance,
to the other one to learn from. A view's handed rows are stated by its coefficients and two thresholds, so that a round
needs a histogram of margins and sums of gradients, never the rows themselves in one place. At the end each view is
calibrated on labelled rows that it hasn't learned from, and a logistic of both calibrated views scores every document.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import col, held_out, scratch, small, stratified, uniform, written
from .toxicity import logistic

#: Buckets of hashed words' endings and of hashed sources.
_TAILS, _SOURCES, _LANGS = 128, 64, 16


def content(text: str | None) -> np.ndarray:
    """The text's view: shares of kinds of characters, repetition, lengths, and word endings by hash."""
    raw = (text or "").encode()
    chars = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(float)
    n = max(1.0, chars.sum())
    words = raw.split()
    w = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    size = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    out = np.zeros(20 + _TAILS)
    upper, lower, digit = chars[65:91].sum(), chars[97:123].sum(), chars[48:58].sum()
    symbols = sum(chars[list(b"#*$%&|<>")])
    out[:20] = (
        math.log1p(len(words)), math.log1p(len(lines)), upper / n, lower / n, digit / n, 10 * symbols / n, chars[128:].sum() / n,
        10 * chars[33] / n, 10 * (chars[46] + chars[44]) / n, 10 * chars[124] / n, size.mean() / 10, min(3.0, size.std() / 10),
        len(set(words)) / w, 1 - len(set(lines)) / max(1, len(lines)), len(set(zip(words, words[1:]))) / w, len(lines) / w,
        (size <= 2).sum() / w, (size >= 12).sum() / w, float(len(words) < 50), float(not words),
    )
    if words:
        tails, many = np.unique([w[-2:] for w in words], return_counts=True)
        at = [20 + zlib.crc32(t) % _TAILS for t in tails.tolist()]
        np.add.at(out, at, np.sqrt(many / w))
    return out


@dataclass(frozen=True)
class View:
    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])
        return np.clip(z @ self.beta, -30, 30)

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * self.margin(x) + self.offset, -30, 30)


@dataclass(frozen=True)
class Model:
    text: View | None = None
    page: View | None = None
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)
    exchanged: int = 0

    def score(self, text: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of quality 1 by text, by metadata and by both."""
        if self.text is None or self.page is None:
            half = np.full(len(text), 0.5)
            return half, half, half
        a, b = self.text.calibrated(text), self.page.calibrated(page)
        p = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
        return p(a), p(b), p(self.weights[0] * a + self.weights[1] * b + self.weights[2])


#: Margins are counted in steps of 0.01 from -30 to 30.
_BINS, _STEP = 6000, 0.01


@dataclass(frozen=True)
class Round:
    """What one round hands over: rows at or above `high` as 1 and at or below `low` as 0, by each view's margin."""

    text: View
    page: View
    text_cut: tuple[float, float] = (math.inf, -math.inf)
    page_cut: tuple[float, float] = (math.inf, -math.inf)


def _handed(margins: np.ndarray, cuts: list[tuple[float, float]]) -> np.ndarray:
    """The label that the first round to hand a row over gives it, or -1; margins has a column a round."""
    out = np.full(len(margins), -1, np.int8)
    for k, (high, low) in enumerate(cuts):
        new = out < 0
        out[new & (margins[:, k] <= low)] = 0
        out[new & (margins[:, k] >= high)] = 1
    return out


def _bin(margin: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((margin + 30) / _STEP), 0, _BINS - 1).astype(np.int64)


def _cut(counts: np.ndarray, ones: float, zeros: float, sure: float) -> tuple[float, float]:
    """The thresholds that hand over the least number of surest bins which reaches `ones` and `zeros` rows; ties stay together."""
    edge = np.log(sure / (1 - sure))
    at = np.arange(_BINS) * _STEP - 30
    up, down = np.where(at >= edge, counts, 0)[::-1].cumsum()[::-1], np.where(at + _STEP <= -edge, counts, 0).cumsum()
    high, low = math.inf, -math.inf
    if up[0]:
        high = at[np.flatnonzero(up >= min(ones, up[0]))[-1]]
    if down[-1]:
        low = at[np.flatnonzero(down >= min(zeros, down[-1]))[0]] + _STEP - 1e-9
    return float(high) - 1e-9, float(low)


class Pool:
    """The unlabelled rows as two matrices in memory."""

    def __init__(self, text: np.ndarray, page: np.ndarray):
        self.text, self.page, self.to_text, self.to_page = text, page, [], []

    def size(self) -> int:
        return len(self.text)

    def histograms(self, done: list[Round], now: Round) -> tuple[np.ndarray, np.ndarray]:
        """How many rows that a view hasn't handed over yet have its margin in each bin, for both views."""
        return _histograms(self.text, self.page, done, now)

    def hand(self, rounds: list[Round]) -> tuple[int, int]:
        """Hand over what the last round adds. The numbers of rows handed to the text's and to the page's view so far."""
        new = _new(self.text, self.page, rounds)
        self.to_text.append((self.text[new[0] >= 0], new[0][new[0] >= 0]))
        self.to_page.append((self.page[new[1] >= 0], new[1][new[1] >= 0]))
        return sum(len(x) for x, _ in self.to_text), sum(len(x) for x, _ in self.to_page)

    def sums(self, text: View, page: View) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """What _gradient gives for the handed rows, for both views."""
        out = []
        for view, given in ((text, self.to_text), (page, self.to_page)):
            x = np.vstack([np.zeros((0, len(view.mean))), *[x for x, _ in given]])
            out.append(_gradient(view, x, np.concatenate([np.zeros(0), *[y for _, y in given]])))
        return out


def _histograms(text: np.ndarray, page: np.ndarray, done: list[Round], now: Round) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for x, view, cut in ((text, "text", "text_cut"), (page, "page", "page_cut")):
        free = np.ones(len(x), bool)
        if done:
            free = _handed(np.stack([getattr(r, view).margin(x) for r in done], axis=1), [getattr(r, cut) for r in done]) < 0
        out.append(np.bincount(_bin(getattr(now, view).margin(x[free])), minlength=_BINS))
    return out[0], out[1]


def _new(text: np.ndarray, page: np.ndarray, rounds: list[Round]) -> tuple[np.ndarray, np.ndarray]:
    """Labels (or -1) that the last of the rounds hands to the text's view and to the page's; a view learns from the other."""
    out = []
    for x, view, cut in ((page, "page", "page_cut"), (text, "text", "text_cut")):
        margins = np.stack([getattr(r, view).margin(x) for r in rounds], axis=1)
        cuts = [getattr(r, cut) for r in rounds]
        label = _handed(margins, cuts)
        if len(rounds) > 1:
            label[_handed(margins[:, :-1], cuts[:-1]) >= 0] = -1
        out.append(label)
    return out[0], out[1]


def _gradient(view: View, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The logarithm of the rows' likelihood, its gradient and its Hessian without the sign."""
    z = np.hstack([(x - view.mean) / view.scale, np.ones((len(x), 1))])
    eta = z @ view.beta
    p = 1 / (1 + np.exp(-np.clip(eta, -30, 30)))
    return float((y * eta - np.logaddexp(0, eta)).sum()), z.T @ (y - p), (z * (p * (1 - p))[:, None]).T @ z


def learn(text: np.ndarray, page: np.ndarray, y: np.ndarray, aside: np.ndarray, pool: Pool, *, rounds: int = 4, share: float = 0.02, sure: float = 0.95, ridge: float = 2.0, steps: int = 12) -> Model:
    """Fit on labelled rows (those of `aside` only calibrate) and the pool of unlabelled ones. Fewer than two classes: a model that scores 0.5.

    In each of the rounds a view hands over about `share` of the pool, and only rows of a probability of at least
    `sure`. Handed rows have half the weight of a labelled one, less where they are many: together no more than the labelled rows.
    """
    use = ~aside
    if len(np.unique(y[use])) < 2 or len(np.unique(y[aside])) < 2:
        return Model()
    ones, size = float(y[use].mean()), pool.size()
    views = []
    for x in (text[use], page[use]):
        scale = x.std(axis=0)
        scale[scale < 1e-9] = 1.0
        views.append(View(x.mean(axis=0), scale, np.zeros(x.shape[1] + 1)))

    def fit(given: tuple[int, int]) -> None:
        """Newton steps from where the views are, halved where the likelihood falls, until neither moves."""
        last: list = [None, None]  # coefficients, likelihood and step of where each view was
        for _ in range(steps):
            more = pool.sums(*views) if any(given) else None
            moved = 0.0
            for k, x in enumerate((text[use], page[use])):
                view = views[k]
                shrink = np.full(len(view.beta), ridge)
                shrink[-1] = 1e-9
                ll, g, h = _gradient(view, x, y[use])
                if more:
                    w = min(0.5, len(x) / max(1, given[k]))
                    ll, g, h = ll + w * more[k][0], g + w * more[k][1], h + w * more[k][2]
                ll -= (shrink * view.beta**2).sum() / 2
                if last[k] and ll < last[k][1] - 1e-9 * abs(ll):
                    beta, was, step = last[k][0], last[k][1], last[k][2] / 2
                else:
                    beta, was, step = view.beta, ll, np.linalg.solve(h + np.diag(shrink + 1e-9), g - shrink * view.beta)
                last[k] = (beta, was, step)
                views[k] = View(view.mean, view.scale, beta + step)
                moved = max(moved, float(np.abs(step).max()))
            if moved < 1e-3:
                break

    fit((0, 0))
    done: list[Round] = []
    total = (0, 0)
    for _ in range(rounds if size else 0):
        now = Round(*views)
        cuts = [_cut(c, math.ceil(share * size * ones), math.ceil(share * size * (1 - ones)), sure) for c in pool.histograms(done, now)]
        done.append(Round(*views, *cuts))
        before, total = total, pool.hand(done)
        if total == before:
            break
        fit(total)
    rest = np.ones(int(aside.sum()))
    out = []
    for view, x in zip(views, (text, page), strict=True):
        slope, offset = logistic(np.stack([view.margin(x[aside]), rest], axis=1), y[aside].astype(float), rest, 1e-3)
        out.append(View(view.mean, view.scale, view.beta, max(0.0, float(slope)), float(offset)))
    both = np.stack([out[0].calibrated(text[aside]), out[1].calibrated(page[aside]), rest], axis=1)
    return Model(out[0], out[1], tuple(map(float, logistic(both, y[aside].astype(float), rest, 1.0))), sum(total))


_PAGE = _SOURCES + _LANGS + 14


def _pages(source: np.ndarray, lang: np.ndarray, n_chars: np.ndarray) -> np.ndarray:
    """The page's view of many rows: language and source by hash, and the recorded length in steps."""
    out, row, at = np.zeros((len(source), _PAGE)), np.arange(len(source)), _SOURCES + _LANGS
    n = np.maximum(0, n_chars)
    out[row, source] = 1
    out[row, _SOURCES + lang] = 1
    out[row, at + np.minimum(12, (np.log2(1 + n) * 0.75).astype(np.int64))] = 1
    out[:, at + 13] = np.log1p(n) / 10
    return out


def features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", size_col: str = "n_chars") -> DataFrame:
    """doc_id, x (the text's view of the whole text as 32-bit floats), source and lang (buckets), n_chars of every row.

    Null text counts as empty, null metadata as a value of its own, and a metadata column that isn't there as null.
    """

    def of(name: str, kind: str):
        return (col(name) if name in docs.columns else F.lit(None)).cast(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = pa.array([content(t).astype("<f4").tobytes() for t in part.column(1).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), x, *part.columns[2:]], ["doc_id", "x", "source", "lang", "n_chars"])

    bucket = lambda name, n: (F.crc32(F.coalesce(of(name, "string"), F.lit("")).cast("binary")) % n).cast("int").alias(name)
    rows = docs.select(of(id_col, "long").alias("doc_id"), of(text_col, "string").alias("text"), bucket(source_col, _SOURCES), bucket(lang_col, _LANGS), F.coalesce(of(size_col, "long"), F.lit(0)).alias("n_chars"))
    return rows.mapInArrow(run, "doc_id long, x binary, source int, lang int, n_chars long")


def _matrices(x: list[bytes], source: np.ndarray, lang: np.ndarray, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(x), "<f4").astype(float).reshape(len(x), 20 + _TAILS), _pages(source, lang, n_chars)


def _parts(batches: Iterator[pa.RecordBatch], first: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            x, *rest = part.columns[first : first + 4]
            yield part, *_matrices(x.to_pylist(), *[c.to_numpy() for c in rest])


class Table(Pool):
    """The unlabelled rows as a written table; what is handed over is a written table for each round."""

    def __init__(self, rows: DataFrame):
        self.rows, self.given = rows, None

    def size(self) -> int:
        return self.rows.count()

    def histograms(self, done: list[Round], now: Round) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, _BINS), np.int64)
            for _, text, page in _parts(batches):
                total += np.stack(_histograms(text, page, done, now))
            view, at = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(view.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(total[view, at])], ["view", "bin", "n"])

        out = np.zeros((2, _BINS), np.int64)
        found = self.rows.select("x", "source", "lang", "n_chars").mapInArrow(run, "view int, bin int, n long")
        for view, at, n in found.groupBy("view", "bin").agg(F.sum("n")).collect():  # at most a row for each bin
            out[view, at] = n
        return out[0], out[1]

    def hand(self, rounds: list[Round]) -> tuple[int, int]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, text, page in _parts(batches):
                to_text, to_page = _new(text, page, rounds)
                some = np.flatnonzero((to_text >= 0) | (to_page >= 0))
                labels = [pa.array(y[some].astype(np.int32)) for y in (to_text, to_page)]
                yield pa.RecordBatch.from_arrays([*part.take(pa.array(some)).columns, *labels], ["x", "source", "lang", "n_chars", "to_text", "to_page"])

        rows = self.rows.select("x", "source", "lang", "n_chars").mapInArrow(run, "x binary, source int, lang int, n_chars long, to_text int, to_page int")
        new = written(rows, "handed")
        self.given = new if self.given is None else self.given.unionByName(new)
        return self.given.agg(F.count_if(F.col("to_text") >= 0), F.count_if(F.col("to_page") >= 0)).first()

    def sums(self, text: View, page: View) -> list[tuple[float, np.ndarray, np.ndarray]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = [(0.0, np.zeros(len(v.beta)), np.zeros((len(v.beta), len(v.beta)))) for v in (text, page)]
            for part, *given in _parts(batches):
                for k, (view, x) in enumerate(zip((text, page), given, strict=True)):
                    y = part.column(4 + k).to_numpy()
                    total[k] = tuple(a + b for a, b in zip(total[k], _gradient(view, x[y >= 0], y[y >= 0]), strict=True))
            raw = np.concatenate([np.ravel(a) for t in total for a in t]).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 16], pa.int32()), pa.array([raw], pa.binary())], ["part", "raw"])

        def add(table: pa.Table) -> pa.Table:
            total = np.sum([np.frombuffer(x) for x in table.column("raw").to_pylist()], axis=0)
            return pa.table({"raw": pa.array([total.tobytes()], pa.binary())})

        # tasks' sums are added in 16 groups, so that as many rows reach the driver
        raw = self.given.mapInArrow(run, "part int, raw binary").groupBy("part").applyInArrow(add, "raw binary").collect()
        total, out = np.sum([np.frombuffer(r[0]) for r in raw], axis=0), []
        for view in (text, page):
            n = len(view.beta)
            out.append((float(total[0]), total[1 : n + 1], total[n + 1 : n + 1 + n * n].reshape(n, n)))
            total = total[n + 1 + n * n :]
        return out


def fit(rows: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality", max_rows: int = 6000, **options) -> Model:
    """Learn from the features of all documents (see features; read several times, so a written table).

    At most max_rows labelled rows, chosen by a hash of their id and of the classes as they are, teach; none are of the held-out
    quarter, and a third only calibrates. All rows without a label are the pool that the views hand over from. Labels other than 0 and
    1, and null ids, are left out; an id with both labels teaches both.
    """
    with scratch(rows.sparkSession):
        return _fit(rows, labels, id_col, label_col, max_rows, options)


def _fit(rows: DataFrame, labels: DataFrame, id_col: str, label_col: str, max_rows: int, options: dict) -> Model:
    known = labels.where(col(label_col).isin(0, 1) & col(id_col).isNotNull()).select(col(id_col).cast("long").alias("doc_id"), col(label_col).cast("int").alias("__y")).distinct()
    train = known.where(~held_out(F.col("doc_id")))
    many = {r[0]: r[1] for r in train.groupBy("__y").count().collect()}
    total = max(1, sum(many.values()))
    some = None
    for y, n in sorted(many.items()):
        part = stratified(train.where(F.col("__y") == y), "__y", "doc_id", max(1, round(max_rows * n / total)))
        some = part if some is None else some.unionByName(part)
    if some is None:
        return Model()
    got = rows.join(F.broadcast(some), "doc_id").select("x", "source", "lang", "n_chars", "doc_id", "__y", uniform(F.col("doc_id"), F.lit("aside")).alias("u")).collect()
    if not got:
        return Model()
    got.sort(key=lambda r: (r[4], r[5], bytes(r[0])))
    text, page = _matrices([bytes(r[0]) for r in got], *[np.array([r[k] for r in got], np.int64) for k in (1, 2, 3)])
    ids = written(known.select("doc_id").distinct(), "cotraining-labelled")
    pool = Table(written(rows.join(small(ids), "doc_id", "left_anti").select("x", "source", "lang", "n_chars"), "cotraining-pool"))
    return learn(text, page, np.array([r[5] for r in got], float), np.array([r[6] < 1 / 3 for r in got], bool), pool, **options)


def score(rows: DataFrame, model: Model, *, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, text_score, page_score, score, kept of every row of features. Each is scored by itself, so repeated rows get equal scores."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, text, page in _parts(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x.astype(float)) for x in shared.value.score(text, page))], ["doc_id", "text_score", "page_score", "score"])

    out = rows.select("doc_id", "x", "source", "lang", "n_chars").mapInArrow(run, "doc_id long, text_score double, page_score double, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text_score", "page_score", "score", (F.col("score") >= threshold).alias("kept"))


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", size_col: str = "n_chars", label_col: str = "quality", threshold: float = 0.5, **options) -> DataFrame:
    """doc_id, held_out, text_score, page_score, score, kept of every whole document: features, co-training and scores in one.

    Null text counts as empty, null metadata as a value of its own, and a metadata column that isn't there as
    null. Null ids are scored and teach only as unlabelled rows. Repeated rows get equal scores; an empty table gives an empty one;
    without labels of both classes all scores are 0.5. Other columns are not read.
    """
    rows = written(features(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, source_col=source_col, size_col=size_col), "cotraining")
    known = labels.select(col(id_col).alias("doc_id"), col(label_col).alias("label"))
    return score(rows, fit(rows, known, label_col="label", **options), threshold=threshold)
