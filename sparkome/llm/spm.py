"""SentencePiece encoding, decoding and counting: an Aho-Corasick automaton over the pieces drives a Viterbi pass.

The automaton reports, for each end position, every piece that ends there (output links, longest first);
each relaxes the best score at that position. A later candidate must be strictly better, so of equal
scores the longest last piece wins: the library's rule for unigram models. Sums are the library's too, 32-bit
floats: at a position whose score is further from 0 than FAR, that score becomes the new 0 for all later
positions, each rounded once more. So paths tie where the library's tie. A character that no one-character piece covers may be the unknown piece at the lowest score
less 10; with byte fallback it becomes its UTF-8 bytes.

Where no piece holds the space mark after another character, the best path of a text is the concatenation
of the best paths of its words, and each distinct word is solved once and kept in a bounded table. What
comes before a word matters only by rounding: where the mark alone has a score so low that floats near it are `step` apart, the sum before a word
counts by its distance from the nearest multiple of the step, and a word has a few solutions, each for a range of that.
"""

from __future__ import annotations

import functools
import math
import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import col

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words whose result a worker keeps; beyond that the table starts anew. Bounds memory, not results.
CACHE_WORDS = 1_000_000
_FLOOR = float("-inf")
#: Fixed value: how far from 0 the library lets a score go before it starts anew from there.
FAR = 1e5
#: Whole numbers below it are exact as 32-bit floats.
_EXACT = float(1 << 24)


def _f32(x: float, _pack=struct.Struct("<f")) -> float:
    """The nearest 32-bit float."""
    return _pack.unpack(_pack.pack(x))[0]


def _fields(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(number, wire type, value) of a protobuf message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, kind, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, kind, data[at : at + n]
            at += n


class Pieces:
    """The vocabulary of a SentencePiece model file with its automaton."""

    def __init__(self, pieces: list[tuple[str, float, int]], *, byte_fallback: bool = False, dummy_prefix: bool = True, squeeze: bool = False, normalize: Callable[[str], str] | None = None):
        import ahocorasick

        self.pieces, self.dummy_prefix, self.squeeze, self.normalize = pieces, dummy_prefix, squeeze, normalize
        self.unknown = next((k for k, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.bytes = {int(p[0][3:5], 16): k for k, p in enumerate(pieces) if p[2] == BYTE}
        self.byte_fallback = byte_fallback and len(self.bytes) == 256
        scores = [p[1] for p in pieces if p[2] == NORMAL] or [0.0]
        self.unknown_score = _f32(min(scores) - 10.0)
        self.automaton = ahocorasick.Automaton()
        for k, (text, score, kind) in enumerate(pieces):
            if text and kind in (NORMAL, USER):
                value = score if kind == NORMAL else len(text.encode()) * max(scores) - 0.1
                self.automaton.add_word(text, (len(text), value, k))
        self.automaton.make_automaton()
        usable = [p[0] for p in pieces if p[2] in (NORMAL, USER)]
        whole = all(v == int(v) for v in scores) and not any(p[2] == USER for p in pieces)
        self.exact = _EXACT if whole else 0.0  # sums nearer to 0 need no rounding
        by_text = {p[0]: p[1] for p in pieces if p[2] == NORMAL}
        low = by_text.get(MARK, 0.0)
        self.step = 2.0 ** (math.frexp(low)[1] - 24) if -low >= _EXACT else 0.0  # how far floats near the mark's score are apart
        plain = all(-v < _EXACT / 2 for t, v in by_text.items() if t.strip(MARK)) and (not self.step or low % (2 * self.step) == 0)
        self.singles = {t for t, v in by_text.items() if len(t) == 1 and (v >= -FAR or t == MARK)}
        self.by_word = whole and plain and MARK in usable and not any(MARK in p.lstrip(MARK) for p in usable)
        # with byte fallback, characters of no piece are words of their own: every path goes through them one by one
        known = "".join(sorted({c for p in usable for c in p}))
        self.foreign = re.compile(f"[^{re.escape(known)}]+") if self.byte_fallback and known else None
        self.surface = [b"" if kind == CONTROL else bytes([int(p[3:5], 16)]) if kind == BYTE else " ⁇ ".encode() if kind == UNKNOWN else p.replace(MARK, " ").encode() for p, _, kind in pieces]

    @classmethod
    def load(cls, path: str) -> Pieces:
        with open(path, "rb") as f:
            model = f.read()
        pieces, fallback, norm = [], False, {}
        for number, _, value in _fields(model):
            if number == 1:
                got = {n: v for n, _, v in _fields(value)}
                pieces.append((got[1].decode(), struct.unpack("<f", got.get(2, b"\0\0\0\0"))[0], got.get(3, NORMAL)))
            elif number == 2:
                fallback = bool({n: v for n, _, v in _fields(value)}.get(35, 0))
            elif number == 3:
                norm = {n: v for n, _, v in _fields(value)}
        normalize = None
        if norm.get(2):
            import sentencepiece

            processor = sentencepiece.SentencePieceProcessor(model_proto=model)
            normalize = lambda text: processor.normalize(text).replace(MARK, " ")
        return cls(pieces, byte_fallback=fallback, dummy_prefix=bool(norm.get(3, 1)) and not normalize, squeeze=bool(norm.get(4, 1)) and not normalize, normalize=normalize)

    def words(self, text: str) -> list[str]:
        """What is solved by itself, as marked text: each word holds its leading space marks."""
        if self.normalize:
            text = self.normalize(text)
        elif self.squeeze:
            text = " ".join([w for w in text.split(" ") if w])
        if not text:
            return []
        text = text.replace(MARK, " ")
        if not self.by_word:
            return [(MARK if self.dummy_prefix else "") + text.replace(" ", MARK)]
        if self.dummy_prefix:
            text = " " + text
        words = text.replace(" ", " " + MARK).split(" ")
        if not words[0]:
            del words[0]
        if MARK in words:  # marks in a row, or at the end, are one word with what follows
            out, lead = [], ""
            for w in words:
                lead += w
                if w != MARK:
                    out.append(lead)
                    lead = ""
            return out + ([lead] if lead else [])
        return words

    # Both passes below share a scheme. `till` is a position's score for pieces that start there, `moved` what became
    # the new 0 there, `seen` the last start whose new 0 a position's score has followed. A position is closed once all
    # pieces that end there are known. The loops are written out, as they are what encoding costs.

    def _followed(self, x: float, moved: list[float], after: int, to: int) -> float:
        """A score moved along with each new 0 of the starts after..to."""
        for k in range(after, to + 1):
            if moved[k]:
                x = _f32(x - moved[k])
        return x

    def best(self, text: str, base: float = 0.0) -> tuple[list[int], float, list[float]]:
        """Ids of the best path through the text, its score from `base` on, and the scores of the pieces that the text begins with."""
        n, exact, unknown, unknown_score = len(text), self.exact, self.unknown, self.unknown_score
        score, till, moved, seen = [_FLOOR] * (n + 1), [base] * (n + 1), [0.0] * (n + 1), [0] * (n + 1)
        first, piece = [0] * (n + 1), [0] * (n + 1)
        closed = last_moved = single = 0
        opening: list[float] = []
        for last, (length, value, k) in [*self.automaton.iter(text), (n, (0, 0.0, 0))]:
            while closed < last:
                closed += 1
                x = score[closed]
                if last_moved > seen[closed] and x > _FLOOR:
                    x = self._followed(x, moved, seen[closed] + 1, last_moved)
                if single != closed and (y := _f32(till[closed - 1] + unknown_score)) > x:
                    x, first[closed], piece[closed] = y, closed - 1, unknown
                if -FAR <= x <= FAR:
                    till[closed] = x
                else:
                    moved[closed], till[closed], last_moved = x, 0.0, closed
                score[closed] = x
            if not length:
                break
            end = last + 1
            start = end - length
            if (best := score[end]) > _FLOOR and last_moved > seen[end]:
                best = score[end] = self._followed(best, moved, seen[end] + 1, min(start, last_moved))
            seen[end] = start
            x = till[start] + value
            if not -exact < x < exact:
                x = _f32(x)
            if not start:
                opening.append(value)
            if x > best:
                score[end], first[end], piece[end] = x, start, k
            if length == 1:
                single = end
        out, at = [], n
        while at:
            k = piece[at]
            if k != unknown:
                out.append(k)
            elif self.byte_fallback:
                out += [self.bytes[b] for b in reversed(text[first[at] : at].encode())]
            elif not out or out[-1] != unknown:
                out.append(unknown)
            at = first[at]
        return out[::-1], score[n] if n else base, opening

    def count(self, text: str, base: float = 0.0) -> tuple[int, float, list[float]]:
        """The same with the number of pieces instead of the ids: the pass carries the best score and its count, and keeps no path."""
        n, exact, unknown_score, fallback = len(text), self.exact, self.unknown_score, self.byte_fallback
        score, till, moved, seen = [_FLOOR] * (n + 1), [base] * (n + 1), [0.0] * (n + 1), [0] * (n + 1)
        many, tail_unknown = [0] * (n + 1), [False] * (n + 1)  # without byte fallback neighbouring unknown characters are one piece
        closed = last_moved = single = 0
        opening: list[float] = []
        for last, (length, value, _) in [*self.automaton.iter(text), (n, (0, 0.0, 0))]:
            while closed < last:
                closed += 1
                x = score[closed]
                if last_moved > seen[closed] and x > _FLOOR:
                    x = self._followed(x, moved, seen[closed] + 1, last_moved)
                if single != closed and (y := _f32(till[closed - 1] + unknown_score)) > x:
                    x, tail_unknown[closed] = y, True
                    many[closed] = many[closed - 1] + (len(text[closed - 1].encode()) if fallback else not tail_unknown[closed - 1])
                if -FAR <= x <= FAR:
                    till[closed] = x
                else:
                    moved[closed], till[closed], last_moved = x, 0.0, closed
                score[closed] = x
            if not length:
                break
            end = last + 1
            start = end - length
            if (best := score[end]) > _FLOOR and last_moved > seen[end]:
                best = score[end] = self._followed(best, moved, seen[end] + 1, min(start, last_moved))
            seen[end] = start
            x = till[start] + value
            if not -exact < x < exact:
                x = _f32(x)
            if not start:
                opening.append(value)
            if x > best:
                score[end], many[end], tail_unknown[end] = x, many[start] + 1, False
            if length == 1:
                single = end
        return many[n], score[n] if n else base, opening

    # Most words begin with the mark and a piece beyond it. The scores of the pieces that they begin with are rounded to the step,
    # then the first position that such a piece reaches becomes the new 0, and from there sums are exact: all that
    # is needed of the passes above. They need no unknown piece, as every character is one.

    def _quick(self, word: str) -> bool:
        return bool(self.step) and word[:1] == MARK and word[1:2] != MARK and self.singles.issuperset(word)

    def _left(self, score: list[float], zero: int) -> float:
        """The sum at the end of a word whose positions from `zero` on have these scores: each that is too far becomes the new 0."""
        if min(score[zero:]) >= -FAR:
            return score[-1]
        moved = 0.0
        for x in score[zero:]:
            if x - moved < -FAR:
                moved = x
        return score[-1] - moved

    def best_quick(self, word: str, rest: float) -> tuple[list[int], float, float, float] | None:
        """Ids, the sum at the end, and the least and the greatest `rest` for which the scores are rounded alike; None if no piece beyond the mark begins the word."""
        n, step = len(word), self.step
        score, first, piece, zero, base, half = [_FLOOR] * (n + 1), [0] * (n + 1), [0] * (n + 1), 0, 0.0, step / 2
        low, high = -half, half
        for last, (length, value, k) in self.automaton.iter(word):
            end = last + 1
            if length <= last:
                x = score[end - length] + value
            elif last:
                times = round((rest + value) / step)
                x = step * times
                if (edge := x - half - value + (times & 1)) > low:  # a distance of half a step goes to the even multiple
                    low = edge
                if (edge := x + half - value - (times & 1)) < high:
                    high = edge
                x -= base
                if not zero:
                    zero, base, x = end, x, 0.0
            else:
                continue
            if x > score[end]:
                score[end], first[end], piece[end] = x, end - length, k
        if not zero:
            return None
        out, at = [], n
        while at:
            out.append(piece[at])
            at = first[at]
        out.reverse()
        return out, self._left(score, zero), low, high

    def count_quick(self, word: str, rest: float) -> tuple[int, float, float, float] | None:
        """The same with the number of pieces."""
        n, step = len(word), self.step
        score, many, zero, base, half = [_FLOOR] * (n + 1), [0] * (n + 1), 0, 0.0, step / 2
        low, high = -half, half
        for last, (length, value, _) in self.automaton.iter(word):
            end = last + 1
            if length <= last:
                x = score[end - length] + value
            elif last:
                times = round((rest + value) / step)
                x = step * times
                if (edge := x - half - value + (times & 1)) > low:
                    low = edge
                if (edge := x + half - value - (times & 1)) < high:
                    high = edge
                x -= base
                if not zero:
                    zero, base, x = end, x, 0.0
            else:
                continue
            if x > score[end]:
                score[end], many[end] = x, many[end - length] + 1
        return (many[n], self._left(score, zero), low, high) if zero else None

    def rest(self, total: float) -> float:
        """What matters of a sum before a word: its distance from the nearest multiple of the step."""
        if not self.step or not -FAR <= total <= FAR:
            return 0.0
        return total - self.step * round(total / self.step)

    def range(self, word: str, rest: float, opening: list[float]) -> tuple[float, float]:
        """The least and the greatest `rest` for which the scores of a word that begins with such pieces are rounded alike."""
        low, high = -self.step / 2, self.step / 2
        if not self.step or word[:1] != MARK:
            return low, high
        if word[1:2] == MARK:
            return rest, rest
        for x in opening:
            if -x < _EXACT:  # not the mark alone
                k = round((rest + x) / self.step)
                inner = self.step / 2 - (k & 1)  # a distance of half a step goes to the even multiple
                low, high = max(low, k * self.step - inner - x), min(high, k * self.step + inner - x)
        return low, high

    def decode(self, ids: list[int]) -> str:
        surface = self.surface
        text = b"".join([surface[k] for k in ids]).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


#: One object for each of the numbers that solutions are full of.
_SHARED = {float(k): float(k) for k in range(-64, 65)}


class Walker:
    """Whole texts word by word.

    quick(word, rest) and slow(word, rest) give a result with what Pieces' passes say; kept makes of it what is kept, join adds
    that up; foreign gives a foreign character's. The table holds a word's solutions as a chain: the range of `rest` that it is for, its
    result, the rest that it leaves, the next one.
    """

    def __init__(self, pieces: Pieces, quick: Callable, slow: Callable, kept: Callable, foreign: Callable, join: Callable):
        self.pieces, self.quick, self.slow, self.kept, self.foreign, self.join = pieces, quick, slow, kept, foreign, join
        self.table: dict[str, tuple] = {}
        self.held = 0

    def _new(self, word: str, rest: float) -> tuple:
        p = self.pieces
        if p._quick(word) and (solved := self.quick(word, rest)):
            result, total, low, high = solved
            found = (low, high, self.kept(result), p.rest(total))
        elif p.foreign is not None and p.foreign.search(word):
            found = (rest, rest, *self._cut(word, rest))
        else:
            result, total, opening = self.slow(word, rest)
            found = (*p.range(word, rest, opening), self.kept(result), p.rest(total))
        if self.held >= CACHE_WORDS:
            self.table.clear()
            self.held = 0
        low, high, result, after = found
        same = _SHARED.get
        found = self.table[word] = (same(low, low), same(high, high), result, same(after, after), self.table.get(word))
        self.held += 1
        return found

    def _one(self, word: str, rest: float) -> tuple:
        found = self.table.get(word)
        while found and not found[0] <= rest <= found[1]:
            found = found[4]
        return found or self._new(word, rest)

    def _cut(self, word: str, rest: float) -> tuple:
        """Result and rest of a word that holds foreign characters: each takes all scores with it, so what follows starts from 0."""
        out, done = [], 0
        for run in [*self.pieces.foreign.finditer(word), None]:
            stop = run.start() if run else len(word)
            if stop > done:
                _, _, result, rest, _ = self._one(word[done:stop], rest)
                out.append(result)
            if run:
                out += [self.foreign(c) for c in run.group()]
                done, rest = run.end(), 0.0
        return self.join(out), rest

    def walk(self, text: str):
        words = self.pieces.words(text)
        if not self.pieces.by_word:
            return self.join([self.kept(self.slow(w, 0.0)[0]) for w in words])
        out, rest, get, new = [], 0.0, self.table.get, self._new
        for word in words:
            found = get(word)
            while found and not found[0] <= rest <= found[1]:
                found = found[4]
            if not found:
                found = new(word, rest)
            out.append(found[2])
            rest = found[3]
        return self.join(out)


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces.load(path)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Walker:
    p = pieces(path)
    return Walker(p, p.best_quick, p.best, lambda ids: array("I", ids).tobytes(), lambda c: array("I", [p.bytes[b] for b in c.encode()]).tobytes(), b"".join)


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Walker:
    p = pieces(path)
    return Walker(p, p.count_quick, p.count, int, lambda c: len(c.encode()), sum)


def encode_text(text: str, path: str) -> bytes:
    """Ids of a whole text as little-endian unsigned 32-bit numbers."""
    return encoder(path).walk(text)


def count_text(text: str, path: str) -> int:
    return counter(path).walk(text)


def _rows(f: Callable[[str | None], tuple], names: list[str], kinds: list[pa.DataType], step: int = 500):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                got = [f(x) for x in part.column(1).to_pylist()]
                cols = [pa.array([g[k] for g in got], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], ["doc_id", *names])

    return run


def _in(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) of every whole text. Null text: null ids; empty text: no ids. No shuffle."""

    def one(text: str | None) -> tuple:
        return (None if text is None else array("I", encode_text(text, model_path)).tolist(),)

    return _in(docs, id_col, text_col).mapInArrow(_rows(one, ["ids"], [pa.list_(pa.int32())]), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text: the text that the ids stand for. Null ids: null text; ids outside the vocabulary raise."""

    def one(ids: list[int] | None) -> tuple:
        return (None if ids is None else pieces(model_path).decode(ids),)

    rows = encoded.select(col(id_col).cast("long").alias("doc_id"), col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(_rows(one, ["text"], [pa.string()]), "doc_id long, text string")


def round_trip(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text: doc_id, n_pieces, ids_crc32 (of little-endian 32-bit ids), decoded_same.

    decoded_same says that decoding the ids gives the text as the model normalizes it. Null text counts as
    empty. Repeated rows, empty tables and other columns need no care: each row is mapped by itself.
    """

    def one(text: str | None) -> tuple:
        text, p = text or "", pieces(model_path)
        raw = encode_text(text, model_path)
        want = p.normalize(text).removeprefix(" ") if p.normalize else " ".join([w for w in text.split(" ") if w]) if p.squeeze else text
        return len(raw) // 4, zlib.crc32(raw), p.decode(array("I", raw).tolist()) == want.replace(MARK, " ")

    return _in(docs, id_col, text_col).mapInArrow(_rows(one, ["n_pieces", "ids_crc32", "decoded_same"], [pa.int64(), pa.int64(), pa.bool_()]), "doc_id long, n_pieces long, ids_crc32 long, decoded_same boolean")
