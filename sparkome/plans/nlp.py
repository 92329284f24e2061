"""Entity mentions in text by dictionary, and the edges that mentions in common give."""

from __future__ import annotations

import functools
import re
import sys
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import normalize
from ..sources.snapshot import exists
from ..sources.workspace import folder, written
from ..types import broadcast_if_small
from .kg import KnowledgeGraph, add_relationships, canonical

# Names too common in text to be mentions.
STOPWORDS = frozenset((
    "disease", "factor", "protein", "gene", "cell", "human", "type", "system", "patient", "study", "level", "case", "group", "role", "form", "site", "size", "name", "code", "value", "data", "set",
    "test", "result", "rate", "time", "year", "day", "age", "sex", "model", "method", "process", "function", "pathway", "complex", "the", "and", "with", "for", "from", "into", "this", "that",
    "these", "those", "any", "all", "such", "more", "most", "less", "very", "many", "some", "than", "then", "out", "off",
))
MIN_LENGTH, AUTO, MAX_ENTITIES = 3, 0.9, 20
#: Bytes and words of names whose hashes a worker holds at once; a larger dictionary is cut into as many parts, each of which reads the texts once.
PART_BYTES, PART_WORDS = 64 << 20, 8_000_000
MATCHES = "record_id string, field string, start int, stop int, matched string, context string, alias_id long, alias_value string, entity_id long, type_id int, is_primary boolean, alias_type string"


def dictionary(kg: KnowledgeGraph, *, types: list[int] | None = None, domain: str | None = None, min_length: int = MIN_LENGTH, stopwords: frozenset[str] = STOPWORDS) -> DataFrame:
    """alias_norm with its entity; primary_name is taken before short names and stop words go."""
    a = kg.aliases.where("is_active and alias_norm is not null").join(F.broadcast(kg.entity_types), "type_id")
    if types:
        a = a.where(F.col("type_id").isin(types))
    if domain:
        a = a.where(F.col("domain") == domain)
    names = a.where("is_primary").groupBy("entity_id").agg(F.min_by("alias_value", "alias_id").alias("primary_name"))
    kept = a.where((F.length("alias_norm") >= min_length) & ~F.col("alias_norm").isin(sorted(stopwords))) if stopwords else a.where(F.length("alias_norm") >= min_length)
    return kept.join(names, "entity_id", "left").select("alias_norm", "alias_id", "alias_value", "alias_type", "entity_id", "type_id", "is_primary", "primary_name")


def save_dictionary(spark, path: str, names: DataFrame, built_at: int, overwrite: bool = False) -> None:
    """Keep a dictionary with a snapshot: its Parquet table below the snapshot's folder, and an entry in the manifest, last.

    The automaton isn't kept: each worker builds it once from the table.
    """
    from ..sources import snapshot

    path = path.removeprefix("parquet://")
    manifest = snapshot.manifest(spark, path)
    if "dictionary" in manifest and not overwrite:
        raise FileExistsError(f"{path} has a dictionary")
    names.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/nlp/dictionary.parquet")
    entry = {"package": built_at, "rows": spark.read.parquet(f"{path}/nlp/dictionary.parquet").count(), "files": snapshot.file_hashes(spark, f"{path}/nlp/dictionary.parquet")}
    snapshot.put_manifest(spark, path, manifest | {"dictionary": entry})


def load_dictionary(spark, path: str, kg: KnowledgeGraph | None = None) -> DataFrame:
    """The dictionary that a snapshot keeps; with a graph, one of another package is refused as stale."""
    from ..sources import snapshot

    path = path.removeprefix("parquet://")
    entry = snapshot.manifest(spark, path).get("dictionary")
    if entry is None:
        raise FileNotFoundError(f"{path} has no dictionary")
    if kg is not None and is_stale(kg, entry["package"]):
        raise ValueError("the dictionary is of another package than the graph")
    return spark.read.parquet(f"{path}/nlp/dictionary.parquet")


def version(kg: KnowledgeGraph) -> int:
    """The largest package of the aliases: a dictionary that was built at another one is stale."""
    return kg.aliases.agg(F.max("package_id")).first()[0] or 0


def is_stale(kg: KnowledgeGraph, built_at: int) -> bool:
    return version(kg) != built_at


#: An odd multiplier of span hashes and its inverse, modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Code points that are hashed at once, beyond which a long text is cut with an overlap of the longest name.
PIECE = 500_000


@functools.cache
def _alnum():
    """Whether each code point is a letter or a digit, as str.isalnum says."""
    import numpy as np

    return np.fromiter((chr(c).isalnum() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


@functools.lru_cache(maxsize=1)
def _powers(n: int):
    import numpy as np

    return tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, x, np.uint64)))) for x in (_BASE, _INVERSE))


def _hashes(codes):
    """A function of first and last places in codes: 64-bit hashes of the spans, the same for equal spans anywhere."""
    import numpy as np

    power, inverse = _powers(1 << max(12, len(codes).bit_length()))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[: len(codes)])))
    return lambda first, last: (sums[last + 1] - sums[first]) * inverse[first]


def _joined(texts: list[str]):
    """Code points of texts with a line break after each, where each begins, and whether each code point is a letter or digit."""
    import numpy as np

    codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return codes, begin, _alnum()[codes]


@functools.lru_cache(maxsize=1)
def _prefixes(path: str):
    """Of the names in a Parquet folder: for each number of words, the sorted hashes of beginnings of so many words and which of them are whole names; and the longest name. Loaded once in each worker.

    A word ends where no letter or digit follows. No name itself is kept: 9 bytes for each different beginning.
    """
    import numpy as np
    import pyarrow.dataset as ds
    import pyarrow.fs as pafs

    fs, place = pafs.FileSystem.from_uri(path if "://" in path else re.sub("^(file:)?/+", "file:///", path))
    levels: list[list] = []
    longest = 0
    for batch in ds.dataset(place, filesystem=fs, format="parquet").to_batches(columns=["alias_norm"], batch_size=1 << 14):
        for texts in _grouped(batch.column(0).to_pylist(), most=1 << 14):
            longest = max(longest, *map(len, texts))
            codes, begin, alnum = _joined(texts)
            span = _hashes(codes)
            end = np.flatnonzero(~alnum[1:])
            name = np.searchsorted(begin, end, "right") - 1
            inside = end < begin[name + 1] - 1
            end, name = end[inside], name[inside]
            k = np.arange(len(end)) - np.searchsorted(name, name)
            h, whole = span(begin[name], end), end == begin[name + 1] - 2
            order = np.argsort(k, kind="stable")
            for n, cut in enumerate(np.split(order, np.cumsum(np.bincount(k))[:-1])):
                if n == len(levels):
                    levels.append([])
                levels[n].append(_merged([(h[cut], whole[cut])]))
                if len(levels[n]) > 64:
                    levels[n] = [_merged(levels[n])]
    for n, parts in enumerate(levels):
        levels[n] = _merged(parts)
    return levels, longest


def _merged(parts: list):
    """Distinct hashes in order, with whether any of the equal ones is of a whole name."""
    import numpy as np

    h, whole = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    order = np.argsort(h)
    h, whole = h[order], whole[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    return h[first], np.logical_or.reduceat(whole, first)


def _grouped(texts: Iterable, size: Callable = len, most: int = 512) -> Iterator[list]:
    """Runs of at most PIECE code points together (or of one text)."""
    out: list = []
    total = 0
    for t in texts:
        if out and (total + size(t) > PIECE or len(out) == most):
            yield out
            out, total = [], 0
        out.append(t)
        total += size(t)
    if out:
        yield out


def _pieces(rows: list[tuple[str, str]]) -> Iterator[tuple]:
    """(record, text, from, to): where a name may begin in a text; of a long text, several."""
    for record, text in rows:
        for at in range(0, len(text), PIECE):
            yield record, text, at, min(at + PIECE, len(text))


def _spans(pieces: list[tuple], levels: list, longest: int) -> Iterator[tuple[int, int, int]]:
    """(piece, start, last) of all occurrences that begin and end at word boundaries, overlapping ones included; hashes decide, so that one in 10**12 or fewer may be no name."""
    import numpy as np

    shift = [max(0, at - 1) for _, _, at, _ in pieces]
    cut = [text[s : to + longest + 1] for (_, text, _, to), s in zip(pieces, shift, strict=True)]
    codes, begin, alnum = _joined(cut)
    span = _hashes(codes)
    free = ~alnum
    starts = np.flatnonzero(np.concatenate(([True], free[:-1])))
    piece = np.searchsorted(begin, starts, "right") - 1
    at, to, s = (np.array(x) for x in ([p[2] for p in pieces], [p[3] for p in pieces], shift))
    place = starts - begin[np.minimum(piece, len(pieces) - 1)] + s[np.minimum(piece, len(pieces) - 1)]
    ok = (piece < len(pieces)) & (codes[np.minimum(starts, len(codes) - 1)] != 10)
    ok[ok] &= (place[ok] >= at[piece[ok]]) & (place[ok] < to[piece[ok]])
    # in the middle of a text, the place after a cut's end isn't known: a name from here ends before it
    starts, piece = starts[ok], piece[ok]
    ends = np.flatnonzero(free[1:] & (codes[:-1] != 10))
    stop = begin[piece + 1] - 2
    first = np.searchsorted(ends, starts)
    active = np.arange(len(starts))
    found = []
    for k, (hashes, whole) in enumerate(levels):
        active = active[first[active] + k < len(ends)]
        last = ends[first[active] + k]
        inside = last <= stop[active]
        active, last = active[inside], last[inside]
        if not len(active):
            break
        h = span(starts[active], last)
        where = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        hit = hashes[where] == h
        active, last, where = active[hit], last[hit], where[hit]
        name = whole[where]
        found.append((active[name], last[name]))
    if found:
        which, last = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        p = piece[which]
        off = s[p] - begin[p]
        rows = np.stack([p, starts[which] + off, last + off])
        yield from rows[:, np.lexsort(rows[::-1])].T.tolist()


def _scan(path: str, context: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, longest = _prefixes(path)
        for batch in batches:
            for at in range(0, batch.num_rows if levels else 0, 512):
                rows = [(record, normalize(raw)) for record, raw in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns), strict=True)]
                for pieces in _grouped(_pieces(rows), lambda p: p[3] - p[2] + longest):
                    records, starts, stops, names, around = [], [], [], [], []
                    for k, a, b in _spans(pieces, levels, longest):
                        record, text = pieces[k][:2]
                        records.append(record)
                        starts.append(a)
                        stops.append(b)
                        names.append(text[a : b + 1])
                        if context is not None:
                            around.append(text[max(0, a - context) : b + 1 + context])
                    cols = [pa.array(records, pa.string()), pa.array(starts, pa.int32()), pa.array(stops, pa.int32()), pa.array(names, pa.string())]
                    cols.append(pa.array(around, pa.string()) if context is not None else pa.nulls(len(records), pa.string()))
                    yield pa.RecordBatch.from_arrays(cols, ["record_id", "start", "stop", "matched", "context"])

    return run


def _candidates(records: DataFrame, names: DataFrame, *, id_col: str, text_col: str, context: int | None = 50) -> DataFrame:
    """record_id, start, stop, matched, context of every occurrence of a name, and possibly of a text whose hash is a name's: a join by `matched` leaves names only.

    The names are written to the shared folder in parts of at most about PART_BYTES and PART_WORDS, and each worker loads the hashes of a part's
    beginnings once, so that neither the driver nor a task ever holds more of the dictionary; a text is read once for each part.
    """
    distinct = names.select("alias_norm").where("alias_norm != ''").distinct()
    spark = records.sparkSession
    words = F.length(F.regexp_replace("alias_norm", r"[\p{L}\p{N}]", "")) + 1
    size, count = (x or 0 for x in distinct.agg(F.sum(F.octet_length("alias_norm")), F.sum(words)).first())
    parts = max(1, -(-size // PART_BYTES), -(-count // PART_WORDS))
    path = folder(spark, "names")
    distinct.withColumn("part", F.pmod(F.xxhash64("alias_norm"), F.lit(parts)).cast("int")).repartition(parts, "part").write.partitionBy("part").parquet(path)
    if records.rdd.getNumPartitions() < 2 * spark.sparkContext.defaultParallelism:
        records = records.repartition(2 * spark.sparkContext.defaultParallelism)  # a few large files: the scan is worth a shuffle
    rows = records.select(F.col(f"`{id_col}`").cast("string").alias("record_id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("trim(text) != ''")
    schema = "record_id string, start int, stop int, matched string, context string"
    out = None
    for k in range(parts):
        place = f"{path}/part={k}"
        if exists(spark, place):
            one = rows.mapInArrow(_scan(place, context), schema)
            out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], schema)


def scan(records: DataFrame, names: DataFrame, *, id_col: str, text_col: str, context: int | None = 50) -> DataFrame:
    """record_id, start, stop, matched, context: every occurrence of a name in the normalized text; context None leaves that column empty."""
    known = names.select(F.col("alias_norm").alias("matched"))
    return _candidates(records, names, id_col=id_col, text_col=text_col, context=context).join(known, "matched", "left_semi").select("record_id", "start", "stop", "matched", "context")


def resolve_mentions(records: DataFrame, kg: KnowledgeGraph, *, id_col: str = "record_id", text_col: str = "text", mode: str = "best_match", threshold: float = AUTO, names: DataFrame | None = None, context: int | None = 50, **options) -> DataFrame:
    """One row for each span and entity: confidence is one over the entities that share the name; best aliases are preferred names, then synonyms, then codes.

    The names are those of `names`, a dictionary that was kept, or of the graph as the options say. best_match keeps the first entity of a span, all_candidates all, smart the first where its confidence reaches the threshold.
    """
    names = names if names is not None else written(dictionary(kg, **options), "dictionary")
    spans = _candidates(records, names, id_col=id_col, text_col=text_col, context=context)
    priority: Column = F.when(F.col("alias_type") == "preferred", 0).when(F.col("alias_type") == "synonym", 1).when(F.col("alias_type") == "code", 2).otherwise(3)
    best = names.withColumn("__p", priority).groupBy("alias_norm", "entity_id").agg(F.min(F.struct("__p", "alias_id", "alias_value", "alias_type", "type_id", "primary_name")).alias("a"))
    shared = best.groupBy("alias_norm").agg(F.count(F.lit(1)).alias("__n"))
    best = best.join(shared, "alias_norm").select(F.col("alias_norm").alias("matched"), "entity_id", "a.alias_id", "a.alias_value", "a.alias_type", "a.type_id", "a.primary_name", (1.0 / F.col("__n")).alias("confidence"))
    # candidates of a span are those of its name, so they are ranked and chosen name by name, before any span is met
    rank = F.row_number().over(Window.partitionBy("matched").orderBy(F.desc("confidence"), "alias_id"))
    best = best.withColumn("__r", rank).withColumn("review_status", F.when(F.col("confidence") >= AUTO, "auto").otherwise("pending"))
    keep = {"best_match": F.col("__r") == 1, "all_candidates": F.lit(True), "smart": (F.col("confidence") < threshold) | (F.col("__r") == 1)}[mode]
    return spans.join(broadcast_if_small(best.where(keep).drop("__r"), 500_000), "matched")


def persist_matches(matches: DataFrame, *, field: str = "text", method: str = "exact_aho") -> DataFrame:
    """Rows for the table of mentions: only with an entity, texts cut to the table's width, the text known by a hash."""
    return matches.where("entity_id is not null").select("record_id", F.lit(field).alias("field"), F.substring(F.sha2("context", 256), 1, 16).alias("text_hash"), "start", "stop", F.substring("matched", 1, 500).alias("matched"), F.substring("context", 1, 1000).alias("context"), "alias_id", "entity_id", F.lit(method).alias("method"), "confidence", "review_status")


def co_occurrences(matches: DataFrame, *, most_entities: int = MAX_ENTITIES) -> DataFrame:
    """Pairs of entities that a record holds both: evidence_count, confidence and the first record. Records with more entities than most_entities say too little and are left out."""
    one = matches.groupBy("record_id", "entity_id").agg(F.min(F.struct("start", "type_id", "confidence")).alias("a")).select("record_id", "entity_id", F.col("a.type_id").alias("type_id"), F.col("a.confidence").alias("confidence"))
    few = one.groupBy("record_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, most_entities)).select("record_id")
    one = one.join(few, "record_id", "left_semi")
    a, b = (one.select("record_id", F.col("entity_id").alias(f"entity_{k}_id"), F.col("type_id").alias(f"entity_{k}_type_id"), F.col("confidence").alias(f"c{k}")) for k in (1, 2))
    pairs = canonical(a.join(b, "record_id").where("entity_1_id < entity_2_id"))
    keys = ["entity_1_id", "entity_1_type_id", "entity_2_id", "entity_2_type_id"]
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("evidence_count"), F.bround(F.max(F.least("c1", "c2")), 4).alias("confidence"), F.min("record_id").alias("source_ref"))


def load_co_occurrences(kg: KnowledgeGraph, matches: DataFrame, *, source: str, relation: str = "co_occurs_with", package_id: int = 0) -> KnowledgeGraph:
    return add_relationships(kg, co_occurrences(matches).drop("source_ref").withColumn("relation", F.lit(relation)), source=source, package_id=package_id)


def resolve_text(spark, text: str, kg: KnowledgeGraph, **options) -> DataFrame:
    return resolve_mentions(spark.createDataFrame([("0", text)], "record_id string, text string"), kg, **options)


def resolve_list(spark, texts: list[str], kg: KnowledgeGraph, **options) -> DataFrame:
    rows = [(str(k), t) for k, t in enumerate(texts)]
    return resolve_mentions(spark.createDataFrame(rows, "record_id string, text string"), kg, **options)
