"""Language identification by string kernels.

The kernel of two texts is the number of character n-grams (blended spectrum, n = 1..3) that both hold,
over the square root of the numbers that each holds: presence bits, not counts. A Nyström basis of
landmark texts makes the kernel finite: a text's row is its kernel with each landmark. One-versus-rest
ridge regression in that space gives a weight for each landmark and language. Scoring is two products for
each batch: presence bits by the landmarks' bits, and kernel rows by weights.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import col, held_out, packed, stratified

UNDETERMINED = "und"
#: Code points that are turned into n-grams at a time; bounds memory for very long texts.
_BLOCK = 1 << 20


@functools.cache
def _letters() -> np.ndarray:
    """True for each code point that is a letter."""
    table = np.zeros(0x110000, bool)
    table[[c for c in range(0x110000) if chr(c).isalpha()]] = True
    return table


def codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text, each run of other characters than letters as one space."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[raw]
    raw = np.where(letter, raw, 32)
    keep = letter.copy()
    if len(raw):
        keep[0] = True
        keep[1:] |= letter[:-1]
    return raw[keep].astype(np.int64)


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sorting beats np.unique's hashing for these."""
    keys.sort()
    keep = np.ones(len(keys), bool)
    keep[1:] = keys[1:] != keys[:-1]
    return keys[keep]


def grams(code: np.ndarray, orders: int = 3) -> np.ndarray:
    """The distinct n-grams of 1 to `orders` (at most 3) code points, 21 bits a code point, sorted."""
    found: list[np.ndarray] = []
    for at in range(0, max(1, len(code)), _BLOCK):
        c = code[at : at + _BLOCK + orders - 1]
        keys, key = [c], c
        for n in range(1, orders):
            key = key[:-1] | c[n:] << (21 * n) if len(c) > n else c[:0]
            keys.append(key)
        found.append(_distinct(np.concatenate(keys)))
    return found[0] if len(found) == 1 else _distinct(np.concatenate(found))


@dataclass(frozen=True)
class Model:
    vocabulary: np.ndarray  # sorted n-grams of the landmarks
    bits: np.ndarray  # vocabulary x landmarks, each column over the root of its landmark's number of n-grams
    weights: np.ndarray  # landmarks x languages
    languages: tuple[str, ...]

    def kernel(self, texts: list[np.ndarray]) -> np.ndarray:
        """Kernel rows of texts given as sorted distinct n-grams."""
        rows = np.zeros((len(texts), len(self.vocabulary)), np.float32)
        size = np.ones(len(texts))
        for k, g in enumerate(texts):
            at = np.searchsorted(self.vocabulary, g)
            at[at == len(self.vocabulary)] = 0
            rows[k, at[self.vocabulary[at] == g]] = 1
            size[k] = max(1, len(g))
        return (rows @ self.bits) / np.sqrt(size)[:, None]

    def predict(self, texts: list[str | None], batch: int = 64) -> tuple[list[str], list[float]]:
        """Language and score (softmax of the margins) of whole texts; und and 0 for a text without a letter."""
        langs, scores = [], []
        for at in range(0, len(texts), batch):
            code = [codes(t or "") for t in texts[at : at + batch]]
            known = [bool(len(c)) and bool((c != 32).any()) and bool(self.languages) for c in code]
            margin = self.kernel([grams(c) for c in code]) @ self.weights
            p = np.exp(6 * (margin - margin.max(axis=1, keepdims=True))) if self.languages else np.zeros((len(code), 1))
            p /= np.maximum(p.sum(axis=1, keepdims=True), 1e-30)
            for k, ok in enumerate(known):
                langs.append(self.languages[int(p[k].argmax())] if ok else UNDETERMINED)
                scores.append(float(p[k].max()) if ok else 0.0)
        return langs, scores


def learn(samples: list[tuple[str, str]], *, landmarks: int = 128, landmark_chars: int = 4000, ridge: float = 1e-3) -> Model:
    """Fit on (text, language) pairs. Landmarks are the first texts of each language that have up to landmark_chars."""
    rows = [(g, lang, len(t)) for t, lang in samples if len(g := grams(codes(t or "")))]
    languages = tuple(sorted({lang for _, lang, _ in rows}))
    if not languages:
        return Model(np.array([0]), np.zeros((1, 1), np.float32), np.zeros((1, 0)), ())
    each, chosen = max(1, landmarks // len(languages)), []
    for lang in languages:
        mine = [(g, n) for g, x, n in rows if x == lang]
        chosen += ([g for g, n in mine if n <= landmark_chars] or [g for g, _ in mine])[:each]
    vocabulary = np.unique(np.concatenate(chosen))
    bits = np.zeros((len(vocabulary), len(chosen)), np.float32)
    for k, g in enumerate(chosen):
        bits[np.searchsorted(vocabulary, g), k] = 1 / np.sqrt(len(g))
    model = Model(vocabulary, bits, np.zeros((len(chosen), len(languages))), languages)
    among = np.vstack([model.kernel(chosen[k : k + 64]) for k in range(0, len(chosen), 64)]).astype(float)
    design = np.vstack([model.kernel([g for g, _, _ in rows[k : k + 64]]) for k in range(0, len(rows), 64)]).astype(float)
    target = np.array([[1.0 if x == lang else -1.0 for lang in languages] for _, x, _ in rows])
    among = (among + among.T) / 2
    left = design.T @ design + ridge * len(rows) * among + 1e-8 * len(rows) * np.eye(len(chosen))
    return Model(vocabulary, bits, np.linalg.solve(left, design.T @ target), languages)


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = 2000, max_chars: int = 20_000, **options) -> Model:
    """Learn from a bounded sample: at most max_rows whole texts, equally many of each language; those above max_chars only where a language has too few others.

    Only rows with a language, a text and an id outside the held-out quarter teach. The sample depends on
    the rows' ids alone.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"), F.col(f"`{lang_col}`").cast("string").alias("__lang"))
    rows = rows.where(F.col("__lang").isNotNull() & F.col("__text").isNotNull() & ~held_out(F.col("__id")))
    classes = max(1, rows.select("__lang").distinct().count())
    rows = rows.where(F.length("__text") > 0)
    got = stratified(rows, "__lang", "__id", max(1, max_rows // classes), F.length("__text") > max_chars).select("__lang", "__id", "__text").collect()
    return learn([(r[2], r[0]) for r in sorted(got, key=lambda r: (r[0], str(r[1]), r[2]))], **options)


def _map(model, extra: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                langs, scores = model.value.predict(part.column(extra).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:extra], *part.columns[extra + 1 :], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*part.schema.names[:extra], *part.schema.names[extra + 1 :], "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text. Nothing but the text goes into a prediction.

    Null text or one without a letter: und, score 0. A table without any labelled text: und for all.
    Repeated rows get equal predictions; an empty table gives an empty one; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = rows.mapInArrow(_map(shared, 1), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep(docs: DataFrame, model: Model, *, text_col: str = "text", least: float = 0.4) -> DataFrame:
    """The rows of docs whose text gets a language with at least the score `least`, with the columns of docs.

    Null text and text without a letter go. A model that has learned no language can't reject: all rows stay.
    """
    if not model.languages:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                langs, scores = shared.value.predict(part.column(1).to_pylist())
                sure = part.filter(pa.array([x != UNDETERMINED and s >= least for x, s in zip(langs, scores, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays([sure.column(0)], ["row"])

    rows = docs.select(packed(docs), col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, T.StructType([T.StructField("row", docs.schema)])).select("row.*")
