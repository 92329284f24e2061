"""Lexical retrieval packing: a sharded BM25 inverted index fills the window of each seed document with its neighbours."""

from __future__ import annotations

import functools
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import col, release, written

#: Words whose ids a worker keeps, half of them from before; when the newer half is full, the older one goes. Bounds memory, not results.
CACHE_WORDS = 500_000


#: Marks that may follow a word, of which they are no part; a run of them is looked up by itself. Not the apostrophe.
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


#: Texts with white space of every kind between words, marks and digits.
_PROBES = ("a b", "the river, of\nstone.\t12 x", "  lead  and trail  ", "don't (stop) 3.14 é ü\r\nend", "a\x0bb\x0cc", "one\n\n two -- #!")


class WordEncoder(dict):
    """Ids of whole texts by any tokenizer; word by word where its pre-tokenizer never spans white space.

    That is so where probes are encoded like their words are, and the pattern that it splits by, if that is known, matches no white space. Else
    texts are encoded whole. A text is cut at ASCII white space and each distinct word is encoded by the tokenizer once; the
    concatenation is what the tokenizer gives for the whole text. Letters A-Z are lowered before, as the
    tokenizer does, unless the text may hold a special token. As a dict it holds the ids of words it has seen lately,
    and those of before beside it: a word that is seen again comes back from there.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.before: dict[bytes, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.bytes_of = [k.to_bytes(self.dtype.itemsize, "little") for k in range(self.size)]
        self.lowers = self.tokenizer.encode("A", add_special_tokens=False).ids == self.tokenizer.encode("a", add_special_tokens=False).ids
        self.split, self.model = self._splitter(path), self.tokenizer.model
        self.chars = _byte_chars()
        self.letters = {k: "".join([self.chars[b] for b in low.encode()]) for k in range(0x300) if (c := chr(k)).isalpha() and len(low := c.lower()) == 1}
        whole = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        self.by_word = all(whole(t) == [k for w in t.split() for k in whole(w)] for t in _PROBES)

    def words(self, raw: bytes) -> list[bytes]:
        if self.lowers and b"<|" not in raw:
            raw = raw.lower()
        return raw.split()

    @staticmethod
    def _splitter(path: str):
        """The pattern of a tokenizer that normalizes to lower-case NFC, splits by one pattern and maps bytes; None for any other."""
        import json

        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        norm = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if norm != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in pre] != ["Split", "ByteLevel"] or not pre[0].get("invert") or pre[1].get("add_prefix_space") or pre[1].get("use_regex"):
            return None
        find = regex.compile(pre[0]["pattern"]["Regex"]).findall
        apart = all(find("a\u00e9" + m) == ["a\u00e9", *find(m)] for m in [*_MARKS.decode(), _MARKS.decode()])
        return find if apart and all(m.split() == [m] for t in _PROBES for m in find(t)) else None

    def packed(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def mapped(self, part: str) -> bytes:
        """Ids of what the pre-tokenizer gives as one part, in the characters that stand for its bytes."""
        of = self.bytes_of
        return b"".join([of[t.id] for t in self.model.tokenize(part)])

    def part(self, part: bytes) -> bytes:
        return self.mapped(part.decode() if part.isascii() else "".join([self.chars[c] for c in part]))

    def _letters(self, word: bytes) -> str:
        """What is letters below U+0300 only, one part for the pre-tokenizer, in lower case and mapped; else nothing."""
        text = word.decode()
        return text.translate(self.letters) if text.isalpha() and max(text) < "\u0300" and "\u0130" not in text else ""

    def __missing__(self, raw: bytes) -> bytes:
        """A printable word below U+0300 (where NFC changes nothing) goes to the model by its parts; any other to the whole tokenizer."""
        if (x := self.before.get(raw)) is not None:
            pass
        elif self.split and raw.isalpha():  # of bytes: A-Z and a-z, one part
            x = self.mapped(raw.lower().decode())
        elif self.split and len(stem := raw.rstrip(_MARKS)) < len(raw) and (stem.isalpha() or not stem.isascii() and self._letters(stem)):
            x = self[stem] + self[raw[len(stem) :]]
        elif self.split and not raw.isascii() and (low := self._letters(raw)):
            x = self.mapped(low)
        elif self.split and b"<|" not in raw and (word := raw.decode()).isprintable() and (raw.isascii() or max(word) < "\u0300"):
            parts = [p.encode() for p in self.split(word.lower())]
            x = b"".join([self[p] for p in parts]) if len(parts) > 1 else self.part(parts[0]) if parts else b""
        else:
            x = self.packed(self.tokenizer.encode(raw.decode(), add_special_tokens=False).ids)
        if len(self) >= CACHE_WORDS // 2:
            self.before = dict(self)
            self.clear()
        self[raw] = x
        return x

    def ids(self, text: str | bytes) -> bytes:
        """Ids of a text (or of its UTF-8) as little-endian bytes of self.dtype."""
        raw = text.encode() if isinstance(text, str) else text
        if not self.by_word:
            return self.packed(self.tokenizer.encode(raw.decode(), add_special_tokens=False).ids)
        return b"".join(map(self.__getitem__, self.words(raw)))


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + extra)
            extra += 1
    return [table[b] for b in range(256)]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _tokenize(path: str, end_id: int):
    """Ids of whole texts and, for each task, how many documents and tokens there are and in how many documents each token is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        enc = encoder(path)
        end = np.array([end_id], enc.dtype).tobytes()
        df, docs, tokens, names = np.zeros(enc.size, np.int64), 0, 0, ["stat", "doc_id", "ids", "docs", "tokens", "df"]
        for batch in batches:
            keys = batch.column(0)
            raw, step = batch.column(1).cast(pa.binary()), 2000
            for at in range(0, batch.num_rows, step):
                ids = pa.array([enc.ids(t or b"") + end for t in raw.slice(at, step).to_pylist()], pa.binary())
                for flat, lengths in _runs(ids, enc.dtype):
                    df += np.bincount(_distinct(flat, lengths, enc.size)[0], minlength=enc.size)
                    docs += len(lengths)
                    tokens += len(flat)
                yield pa.RecordBatch.from_arrays([pa.array([False] * len(ids)), keys.slice(at, step), ids, pa.array([0] * len(ids), pa.int64()), pa.array([0] * len(ids), pa.int64()), pa.nulls(len(ids), pa.binary())], names)
        seen = np.flatnonzero(df)
        packed = np.stack([seen, df[seen]]).astype("<i8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([True]), pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([docs], pa.int64()), pa.array([tokens], pa.int64()), pa.array([packed], pa.binary())], names)

    return run


def _route(idf: np.ndarray, mean_length: float, width: str, k1: float, b: float):
    """Adds a key by which documents of like content sort near each other: two terms of 20 bits, then 22 bits of the id's hash, which split what has equal terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder.cache_clear()  # a reused worker's words, which no later stage needs
        release()
        variates, docs, step = _variates(len(idf)), 0, 2000
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                terms = [routes(*weights(flat, lengths, idf, mean_length, k1, b), variates) for flat, lengths in _runs(part.column(1), width)]
                one, two = (np.concatenate(x) & 0xFFFFF for x in zip(*terms, strict=True))
                ids = [zlib.crc32(b"%d" % (docs + k if doc is None else doc)) >> 10 for k, doc in enumerate(part.column(0).to_pylist(), 1)]
                docs += len(ids)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(one << 42 | two << 22 | np.array(ids))], ["doc_id", "ids", "route"])

    return run


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.column(0).to_pylist():
            ids, n = np.frombuffer(x, "<i8").reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], ["token", "n"])


#: Ids that are counted at a time; a longer text is one run. Bounds memory, not results.
RUN_IDS = 1 << 18


def _runs(column: pa.Array, width: str | np.dtype) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All rows of a binary column of ids, a run of whole texts at a time: their ids one after the other, and how many each has."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] // np.dtype(width).itemsize
    ids = np.frombuffer(column.buffers()[2], width, int(ends[-1]))
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + RUN_IDS, "right")) - 1)
        yield ids[ends[at] : ends[stop]], np.diff(ends[at : stop + 1])
        at = stop


def _distinct(ids: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of each of some texts, text by text and ascending, how often each is there, and its text's number."""
    bits = max(1, int(size - 1).bit_length())
    key = np.repeat(np.arange(len(lengths), dtype=np.uint32 if len(lengths) << bits <= 1 << 32 else np.uint64) << bits, lengths)
    key |= ids.astype(key.dtype, copy=False)
    key.sort()
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    key, n = key[first], np.diff(first, append=len(key))
    return (key & ((1 << bits) - 1)).astype(np.uint16 if bits <= 16 else np.uint32), n, (key >> bits).astype(np.int64)


def weights(ids: np.ndarray, lengths: np.ndarray, idf: np.ndarray, mean_length: float, k1: float, b: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of each of some texts, which follow each other in ids, their BM25 weights and their texts' numbers."""
    term, n, text = _distinct(ids, lengths, len(idf))
    return term, n * (k1 + 1) / (n + (k1 * (1 - b + b * lengths / mean_length))[text]) * idf[term], text


def _variates(size: int) -> list[np.ndarray]:
    """Two times a fixed exponential variate for each term."""
    return [np.random.default_rng(seed).exponential(size=size) for seed in range(2)]


def routes(terms: np.ndarray, weight: np.ndarray, text: np.ndarray, variates: list[np.ndarray]) -> list[np.ndarray]:
    """For each of the variates a term of each text, none of which is without terms, by weighted MinHash: two texts get the same one as often as their weights overlap."""
    weight, start = np.maximum(weight, 1e-9), np.flatnonzero(np.diff(text, prepend=-1))
    out = []
    for v in variates:
        rank = v[terms] / weight
        least = np.flatnonzero(rank == np.minimum.reduceat(rank, start)[text])
        out.append(terms[least[np.flatnonzero(np.diff(text[least], prepend=-1))]].astype(np.int64))  # of equal ones the smallest term
    return out


class Shard:
    """A BM25 inverted index over the units of one shard, with the corpus's document frequencies."""

    def __init__(self, units: list[np.ndarray], idf: np.ndarray, mean_length: float, k1: float, b: float):
        term, weight, unit = weights(np.concatenate(units), np.array([len(ids) for ids in units]), idf, mean_length, k1, b)
        self.n = len(units)
        self.of = np.split(term, np.searchsorted(unit, np.arange(1, self.n)))
        order = np.argsort(term, kind="stable")
        self.unit, self.weight = unit[order], weight[order]
        self.ends = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(idf)))))
        often = np.diff(self.ends) >= max(8, self.n // 8)  # postings of a term that many units have are a row, added at once
        self.row = np.where(often, np.cumsum(often) - 1, -1)
        self.rows = np.zeros((int(often.sum()), self.n))
        at = self.row[term[order]]
        self.rows[at[at >= 0], self.unit[at >= 0]] = self.weight[at >= 0]

    def scores(self, k: int) -> np.ndarray:
        """BM25 of every unit for the distinct terms of unit k as the query."""
        row = self.row[self.of[k]]
        rare = self.of[k][row < 0].astype(np.int64)
        start, stop = self.ends[rare], self.ends[rare + 1]
        size = stop - start
        at = np.arange(size.sum()) + np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size)
        return np.bincount(self.unit[at], self.weight[at], self.n) + self.rows[row[row >= 0]].sum(axis=0)


def _fill(units: list[list], shard: Shard, window: int, last: bool) -> tuple[list[list[tuple]], list[list]]:
    """Windows of (doc, start, length), and the units left over. A unit is [doc, start, stop]."""
    left = np.array([u[2] - u[1] for u in units])
    total, out = int(left.sum()), []
    for seed in range(len(units)):
        if not left[seed]:
            continue
        if total < window and not last:
            break
        room, row = window, []
        score = shard.scores(seed)
        score[seed] = np.inf
        live = np.flatnonzero(left)
        for k in live[np.argsort(-score[live], kind="stable")]:
            take = min(room, int(left[k]))
            row.append((units[k][0], units[k][1], take))
            units[k][1] += take
            left[k] -= take
            total -= take
            room -= take
            if not room:
                break
        out.append(row)
    return out, [u for u in units if u[2] > u[1]]


def powers(row: list[tuple], window: int) -> list[list[tuple]]:
    """Cut a short window into sequences whose lengths are powers of two, which need no padding."""
    total, out, at = sum(x[2] for x in row), [], 0
    sizes, size = [], window // 2
    while size:
        if total >= size:
            sizes.append(size)
            total -= size
        size //= 2
    row = [list(x) for x in row]
    for size in sizes:
        part = []
        while size:
            doc, start, n = row[at]
            take = min(n, size)
            part.append((doc, start, take))
            row[at][1] += take
            row[at][2] -= take
            size -= take
            at += not row[at][2]
        out.append(part)
    return out


def _pack(idf: np.ndarray, mean_length: float, width: str, window: int, shard_units: int, k1: float, b: float):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        first = TaskContext.get().partitionId() << 36
        state = {"next": 0}
        docs: dict[int, tuple] = {}
        pending: list[list] = []

        def batch_of(sequences: list[list[tuple]]) -> pa.RecordBatch:
            cols: list[list] = [[] for _ in names]
            for row in sequences:
                offset = 0
                for doc, start, n in row:
                    key, ids = docs[doc]
                    crc = zlib.crc32(ids[start : start + n].astype("<u4").tobytes())
                    for c, v in zip(cols, (key, start, n, crc, len(ids), first + state["next"], offset), strict=True):
                        c.append(v)
                    offset += n
                state["next"] += 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

        def close(last: bool) -> pa.RecordBatch:
            nonlocal pending
            shard = Shard([docs[u[0]][1][u[1] : u[2]] for u in pending], idf, mean_length, k1, b)
            rows, pending = _fill(pending, shard, window, last)
            if last and rows and sum(x[2] for x in rows[-1]) < window:
                rows[-1:] = powers(rows[-1], window)
            out = batch_of(rows)
            keep = {u[0] for u in pending}
            for k in [k for k in docs if k not in keep]:
                del docs[k]
            return out

        seen = 0
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(raw.as_buffer(), width)
                docs[seen] = (key, ids)
                whole = len(ids) - len(ids) % window
                for at in range(0, whole, window * 256):  # windows that the document fills by itself
                    yield batch_of([[(seen, x, window)] for x in range(at, min(whole, at + window * 256), window)])
                if whole < len(ids):
                    docs[seen] = (key, ids.copy())
                    pending.append([seen, whole, len(ids)])
                else:
                    del docs[seen]
                seen += 1
                if len(pending) >= shard_units:
                    yield close(False)
        if pending:
            yield close(True)

    return run


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, end_id: int = 1, shard_units: int = 512, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Pack all documents into sequences of at most `window` tokens.

    Steps: (1) every whole text is tokenized once and the ids are written to the shared folder, with each
    task's document frequencies; (2) frequencies are summed over all documents (at most one row for each
    vocabulary entry reaches the driver); (3) documents are sorted, over all tasks, by their route, two terms that a MinHash by
    these BM25 weights picks, so that a shard holds like documents wherever the table has them; (4) each task packs its shards of `shard_units` units: what a
    document has beyond whole windows is a unit, units are indexed by BM25, and each seed's window takes
    its best-scoring unused units; the one that overflows is cut and its rest stays in the pool.
    Units that are left pass to the task's next shard; only a task's last window can be short, and it is
    cut at powers of two. A seed sees its shard's units only.

    Null text: no ids but the end id. Repeated rows are documents of their own. Null ids stay null. An
    empty table gives an empty result. Other columns are not read. Ties in score go to the earlier unit.
    Result: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    """
    spark = docs.sparkSession
    width = encoder(tokenizer_path).dtype.str
    size = encoder(tokenizer_path).size
    texts = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    table = written(texts.mapInArrow(_tokenize(tokenizer_path, end_id), "stat boolean, doc_id long, ids binary, docs long, tokens long, df binary"), "packing-ids", "lz4")
    stats = table.where("stat")
    n_docs, n_tokens = stats.agg(F.sum("docs"), F.sum("tokens")).first()
    n_docs, n_tokens = n_docs or 0, n_tokens or 0
    df = np.zeros(size)
    for token, n in stats.select("df").mapInArrow(_unpack, "token long, n long").groupBy("token").agg(F.sum("n")).collect():
        df[token] = n
    idf = np.log1p((n_docs - df + 0.5) / (df + 0.5)).astype(np.float32)
    mean_length = max(1.0, n_tokens / max(1, n_docs))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    routed = table.where(~F.col("stat")).select("doc_id", "ids").mapInArrow(_route(idf, mean_length, width, k1, b), "doc_id long, ids binary, route long")
    rows = routed.repartitionByRange(parts, "route").sortWithinPartitions("route", "doc_id").select("doc_id", "ids")
    return rows.mapInArrow(_pack(idf, mean_length, width, window, shard_units, k1, b), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
