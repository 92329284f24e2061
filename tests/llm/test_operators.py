"""Each operator against a brute-force version on a small fixture, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import base64
import hashlib
import io
import json
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkome.llm import ann, cotraining, langid, near_copies, packing, quality_rules, simhash, spm, token_counts, toxicity, warc
from sparkome.llm.queries import table, vocabulary

WORDS = "the of and vector cluster river stone quiet window paper garden music letter number island market winter".split()
SPACES = re.compile(r"[\x20\x09-\x0D]+")


def words_of(text):
    return [w for w in SPACES.split(text or "") if w]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    make = lambda n: " ".join(r.choice(WORDS) + str(r.randrange(60)) for _ in range(n))
    base = [make(r.randrange(1, 90)) for _ in range(60)]
    near = [b.replace(" ", "  ", 1) + " tail" for b in base[:8]]
    long = "\n".join(make(12) for _ in range(900)) + "\n" + make(12)
    lines = "one two three four\n" * 40
    return [None, "", " \t\n", "Zürich ist schön, ß É", "a", "A a", "a b c", *base, *near, *base[:5], long, long, lines, "#### $$$ \x1c x\x85y", "x" * 5000]


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Columns that clash with the operators' own names stand beside id and text."""
    rows = [(k, t, "en", f"s{k % 3}", None if t is None else len(t), 7, "x") for k, t in enumerate(texts)] + [(3, texts[3], None, None, None, 7, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int, fp string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


# 8 packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary("word_bpe_49k.json"))


def test_word_ids_are_the_tokenizers(tokenizer, texts):
    enc = packing.encoder(vocabulary("word_bpe_49k.json"))
    odd = ["<|endoftext|> a <|ENDOFTEXT|>", "don't IT'S İ K é \xadz", "東京 ΟΔΟΣ 𝔘😀", "½ x²y ÷×"]
    for t in [t for t in texts if t is not None] + odd:
        assert np.frombuffer(enc.ids(t), enc.dtype).tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_tokenizers_that_span_white_space_encode_whole_texts(tmp_path):
    """A pattern that takes a leading space along must not be cut into words."""
    from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

    chars = packing._byte_chars()
    vocab = {c: k for k, c in enumerate(dict.fromkeys(chars))}
    space = chars[32]
    vocab |= {f"{space}a": len(vocab), "ab": len(vocab) + 1}
    for pattern, by_word in ((r"\s?\p{L}+|[^\s\p{L}]+|\s+", False), (r"\p{L}+|[^\s\p{L}]+", True)):
        t = Tokenizer(models.BPE(vocab=vocab, merges=[(space, "a"), ("a", "b")]))
        t.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex("\u0000"), " "), normalizers.Lowercase()])
        t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "removed", invert=True), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        t.save(str(tmp_path / f"{by_word}.json"))
        enc = packing.WordEncoder(str(tmp_path / f"{by_word}.json"))
        assert enc.by_word == by_word
        for text in ("ab ab a", "a, ab. A\n\nb x", ""):
            assert np.frombuffer(enc.ids(text), enc.dtype).tolist() == t.encode(text, add_special_tokens=False).ids


def test_packing_is_whole_and_gapless(docs, tokenizer, texts):
    rows = packing.pack(docs, vocabulary("word_bpe_49k.json"), window=256, shard_units=16).collect()
    ids = {k: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for k, t in enumerate(texts)}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
        assert r.doc_tokens == len(ids[r.doc_id])
        want = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(want)
    for k, all_ids in ids.items():
        copies = 2 if k == 3 else 1  # its row is there twice
        assert sorted(x for a, n in pieces[k] for x in range(a, a + n)) == sorted(list(range(len(all_ids))) * copies)
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= 256
        padding += 0 if at & (at - 1) == 0 else 256 - at
    assert padding <= 256 * 4  # at most one short window for each task


def test_packing_ranks_neighbours_by_bm25():
    units = [np.array(u) for u in ([1, 2, 3], [1, 2, 9], [7, 8, 9], [3, 3, 2])]
    idf = np.log1p((4 - np.bincount(np.concatenate([np.unique(u) for u in units]), minlength=10) + 0.5) / (np.bincount(np.concatenate([np.unique(u) for u in units]), minlength=10) + 0.5))
    shard = packing.Shard(units, idf, 3.0, 1.2, 0.75)
    for q in range(4):
        for d in range(4):
            tf = Counter(units[d].tolist())
            want = sum(idf[t] * tf[t] * 2.2 / (tf[t] + 1.2) for t in set(units[q].tolist()))
            assert shard.scores(q)[d] == pytest.approx(want)


def test_packing_of_no_rows(empty):
    assert packing.pack(empty, vocabulary("word_bpe_49k.json")).count() == 0


def test_packing_finds_neighbours_far_apart_in_storage(spark):
    r = random.Random(6)
    made = [" ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=4)) for _ in range(80)) for _ in range(200)]
    rows = [(k, t) for k, t in enumerate(made)] + [(200 + k, edited(r, t, 2)) for k, t in enumerate(made)]  # copies are 200 rows apart
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), vocabulary("word_bpe_49k.json"), window=1024, shard_units=32).collect()
    where = defaultdict(set)
    for x in got:
        where[x.doc_id].add(x.sequence_id)
    assert sum(bool(where[k] & where[200 + k]) for k in range(200)) >= 120


@pytest.fixture(scope="module")
def alike(spark):
    """1200 texts of 400 topics, those of a topic apart in storage: 60 words that all have in any order, three of the topic, and 4000 characters of space before."""
    r = random.Random(8)
    word = lambda n: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    common, topics = [word(4) for _ in range(60)], [" ".join(word(6) for _ in range(3)) for _ in range(400)]
    return spark.createDataFrame([(k, " " * 4000 + " ".join(r.sample(common, 60)) + " " + topics[k % 400]) for k in range(1200)], "doc_id long, text string")


def topics_met(rows):
    """Topics whose first two texts have a sequence in common."""
    where = defaultdict(set)
    for x in rows:
        where[x.doc_id].add(x.sequence_id)
    return sum(bool(where[k] & where[400 + k]) for k in range(400))


def test_packing_routes_by_frequencies_of_the_whole_corpus(alike):
    assert topics_met(packing.pack(alike, vocabulary("word_bpe_49k.json"), window=256, shard_units=16).collect()) >= 300


def one_by_one(texts, idf, mean_length):
    """Documents of each token, and each text's two terms of the least variate a weight, by a loop over texts."""
    df, terms, variates = np.zeros(len(idf), np.int64), [], packing._variates(len(idf))
    for ids in texts:
        t, n = np.unique(ids, return_counts=True)
        df[t] += 1
        w = n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(ids) / mean_length)) * idf[t]
        terms.append([int(t[np.argmin(v[t] / np.maximum(w, 1e-9))]) for v in variates])
    return df, terms


def test_packing_routes_many_texts_at_once(monkeypatch):
    """What a loop over texts gives, in less than half its time; texts longer than a run, of one token and with equal weights, null ids."""
    import time

    import pyarrow as pa

    monkeypatch.setattr(packing, "RUN_IDS", 1 << 14, raising=False)
    r = np.random.default_rng(3)
    texts = [(r.zipf(1.3, n) % 49_408).astype("<u2") for n in [1, 40_000, 1, 2, *r.integers(1, 400, 4000)]]
    idf = np.log1p(r.random(49_408) * 1000).astype(np.float32)
    idf[:50] = 0
    keys = [None if k % 7 == 0 else k - 5 for k in range(len(texts))]
    whole = pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([x.tobytes() for x in texts], pa.binary())], ["doc_id", "ids"])
    run = packing._route(idf, 200.0, "<u2", 1.2, 0.75)
    took = [math.inf, math.inf]
    for _ in range(3):
        began = time.process_time()
        got = [x for part in run(iter([whole.slice(0, 0), whole.slice(0, 3), whole.slice(3)])) for x in part.column(2).to_pylist()]
        took[0], began = min(took[0], time.process_time() - began), time.process_time()
        _, want = one_by_one(texts, idf, 200.0)
        took[1] = min(took[1], time.process_time() - began)
    assert [[x >> 42, x >> 22 & 0xFFFFF] for x in got] == want
    assert [x & 0x3FFFFF for x in got] == [zlib.crc32(b"%d" % (k + 1 if key is None else key)) >> 10 for k, key in enumerate(keys)]
    assert took[0] < took[1] / 2


def test_packing_counts_every_text(monkeypatch):
    """Frequencies, documents and tokens are those of all texts, whatever the run's length."""
    import pyarrow as pa

    texts = [*("river stone " * k + "window" * (k % 3) for k in range(3000)), None, "", "quiet " * 9000]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(at, min(at + 700, len(texts)))), pa.array(texts[at : at + 700])], ["doc_id", "text"]) for at in range(0, len(texts), 700)]
    path = vocabulary("word_bpe_49k.json")
    enc = packing.encoder(path)
    ids = [np.frombuffer(enc.ids(t or ""), enc.dtype).tolist() + [1] for t in texts]
    for run_ids in (1, 5000, 1 << 18):
        monkeypatch.setattr(packing, "RUN_IDS", run_ids, raising=False)
        *parts, last = packing._tokenize(path, 1)(iter(batches))
        assert [np.frombuffer(x, enc.dtype).tolist() for part in parts for x in part.column(2).to_pylist()] == ids
        assert last.column(3).to_pylist() == [len(texts)] and last.column(4).to_pylist() == [sum(map(len, ids))]
        token, n = np.frombuffer(last.column(5)[0].as_py(), "<i8").reshape(2, -1)
        assert dict(zip(token.tolist(), n.tolist(), strict=True)) == Counter(t for x in ids for t in set(x))


def test_words_that_recur_stay_known(monkeypatch, tokenizer):
    """A word that is seen now and then is encoded once, however many others pass between; marks after it are looked up apart."""
    monkeypatch.setattr(packing, "CACHE_WORDS", 40)
    enc = packing.WordEncoder(vocabulary("word_bpe_49k.json"))
    seen, model = Counter(), enc.model

    class Counting:
        def tokenize(self, word):
            seen[word] += 1
            return model.tokenize(word)

    enc.model = Counting()
    letters = "abcdefghijklmnopqrstuvwxyz"
    for k in range(400):
        text = f"river x{letters[k % 26]}{letters[k // 26]}!? river###"
        assert np.frombuffer(enc.ids(text), enc.dtype).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert seen["river"] == 1 and len(enc) + len(enc.before) <= 40


def test_letters_of_every_kind_are_the_tokenizers(tokenizer):
    """Each character below U+0300 within a word, alone and with marks, against the library."""
    enc = packing.WordEncoder(vocabulary("word_bpe_49k.json"))
    for k in range(0x300):
        text = f"x{chr(k)}y {chr(k)} é{chr(k)}, Ä{chr(k)}É##"
        assert np.frombuffer(enc.ids(text), enc.dtype).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, hex(k)


def test_marks_that_belong_to_words_stay_there(tmp_path):
    """A pattern by which marks and letters are one part."""
    from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

    chars = packing._byte_chars()
    t = Tokenizer(models.BPE(vocab={c: k for k, c in enumerate(chars)} | {"a.": 256}, merges=[("a", ".")]))
    t.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex("\u0000"), " "), normalizers.Lowercase()])
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(r"\S+"), "removed", invert=True), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    t.save(str(tmp_path / "t.json"))
    enc = packing.WordEncoder(str(tmp_path / "t.json"))
    for text in ("a. ba.", "A.. \u00e9a.", "a"):
        assert np.frombuffer(enc.ids(text), enc.dtype).tolist() == t.encode(text, add_special_tokens=False).ids


# 4 and 10 SentencePiece


def viterbi(pieces, text):
    """Best path by trying every piece at every start, left to right; a later candidate must be strictly better. Scores are 32-bit floats;
    a start whose score is further from 0 than 100,000 becomes the new 0."""
    by = {p: (s, k) for k, (p, s, kind) in enumerate(pieces.pieces) if kind == spm.NORMAL}
    longest = max(map(len, by))
    best = [[0.0, None, None]] + [[-math.inf, None, None] for _ in text]
    for a in range(len(text)):
        if abs(zero := best[a][0]) > 1e5:
            for node in best[a : a + longest + 1]:
                node[0] = float(np.float32(node[0] - zero))
        for b in range(a + 1, min(len(text), a + longest) + 1):
            if text[a:b] in by and best[a][0] + by[text[a:b]][0] > best[b][0]:
                best[b] = [float(np.float32(best[a][0] + by[text[a:b]][0])), a, by[text[a:b]][1]]
        if text[a] not in by and (x := float(np.float32(best[a][0] + pieces.unknown_score))) > best[a + 1][0]:
            best[a + 1] = [x, a, pieces.unknown]
    out, at = [], len(text)
    while at:
        _, a, k = best[at]
        out += [k] if k != pieces.unknown else [pieces.bytes[x] for x in reversed(text[a:at].encode())]
        at = a
    return out[::-1]


def test_encoding_equals_brute_force(texts):
    path = vocabulary("piece_bpe_32k.model")
    p = spm.pieces(path)
    odd = ["a  b", " a", "a ", "  ", "\n", "東京 ok", "é\x00z", "<s> </s> <0x41>", "𝔘😀 "]
    for t in [t[:1500] for t in texts if t is not None] + odd:
        got = np.frombuffer(spm.encode_text(t, path), "<u4").tolist()
        assert got == (viterbi(p, "▁" + t.replace(" ", "▁")) if t else [])
        assert spm.count_text(t, path) == len(got)
        assert p.decode(got) == t


def as_unigram(path, out, edit=lambda score: score):
    """The model file as one of a unigram model, with its own scores or edited ones."""

    def varint(x):
        out = b""
        while True:
            out += bytes([x & 127 | (128 if x > 127 else 0)])
            x >>= 7
            if not x:
                return out

    def message(fields):
        return b"".join(varint(n << 3 | k) + (varint(v) if k == 0 else varint(len(v)) + v if k == 2 else v) for n, k, v in fields)

    with open(path, "rb") as f:
        fields = list(spm._fields(f.read()))
    new = []
    for n, k, v in fields:
        if n == 1:
            v = message([(a, b, struct.pack("<f", edit(struct.unpack("<f", c)[0])) if a == 2 else c) for a, b, c in spm._fields(v)])
        elif n == 2:
            v = message([(a, b, 1 if a == 3 else c) for a, b, c in spm._fields(v)])
        new.append((n, k, v))
    with open(out, "wb") as f:
        f.write(message(new))
    return str(out)


def test_whole_documents_are_encoded_as_by_the_library(spark, tmp_path):
    """The library run as a unigram model over the same file, with the file's own scores: long sums are rounded, and ties follow."""
    import sentencepiece

    path = as_unigram(vocabulary("piece_bpe_32k.model"), tmp_path / "unigram.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = [r.text for r in table(spark, "/root/testdata/sf0.01", "documents").select("text").collect()]
    odd = ["a  b", " a", "a ", "  ", "\n", "東京 ok\n\n𝔘😀 ", "x" * 30_000, "the quick brown fox " * 3000]
    r = random.Random(1)
    odd += [" ".join("".join(r.choice("theanringso,.ABé東\n") for _ in range(r.randrange(0, 9))) for _ in range(r.randrange(1, 400))) for _ in range(200)]
    for t in docs + odd:
        want = library.encode(t or "")
        assert np.frombuffer(spm.encode_text(t or "", path), "<u4").tolist() == want
        assert spm.count_text(t or "", path) == len(want)
    try:  # small tables, which start anew all the time
        spm.CACHE_WORDS, kept = 7, spm.CACHE_WORDS
        spm.encoder.cache_clear()
        for t in docs[:200] + odd:
            assert np.frombuffer(spm.encode_text(t or "", path), "<u4").tolist() == library.encode(t or "")
    finally:
        spm.CACHE_WORDS = kept
    raised = as_unigram(vocabulary("piece_bpe_32k.model"), tmp_path / "raised.model", lambda x: max(x, -40000.0))
    library = sentencepiece.SentencePieceProcessor(model_file=raised)
    for t in odd[-200:]:
        got = np.frombuffer(spm.encode_text(t, raised), "<u4").tolist()
        assert got == library.encode(t) and spm.pieces(raised).decode(got) == library.decode(got)


def test_fractional_scores_are_rounded_as_by_the_library(tmp_path):
    import sentencepiece

    path = as_unigram(vocabulary("piece_bpe_32k.model"), tmp_path / "u.model", edit=lambda x: max(x, -40000.0) / 7.3)
    assert not spm.pieces(path).by_word
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(2)
    for t in ["the river of stone and vectors, cluster " * 500, "a\nb  ccc", *(" ".join("".join(r.choice("theanringso,.ABé東\n09") for _ in range(r.randrange(0, 9))) for _ in range(r.randrange(1, 300))) for _ in range(60))]:
        assert np.frombuffer(spm.encode_text(t, path), "<u4").tolist() == library.encode(t)


def test_vocabulary_without_byte_fallback_joins_unknowns():
    p = spm.Pieces([("<unk>", 0.0, spm.UNKNOWN), ("▁", -2.0, 1), ("a", -1.0, 1), ("▁a", -3.0, 1), ("aa", -2.0, 1)])
    assert [p.pieces[k][0] for k in p.best("▁a")[0]] == ["▁a"]  # a tie: the longest last piece wins
    assert [p.pieces[k][0] for k in p.best("aa")[0]] == ["aa"]
    assert p.best("▁xya")[0] == [1, 0, 2] and p.count("▁xya")[0] == 3


def test_sentencepiece_frames(docs, empty, texts):
    path = vocabulary("piece_bpe_32k.model")
    dotted = docs.select(F.col("doc_id").alias("doc.id"), F.col("text").alias("the text"))
    assert token_counts.token_counts(dotted, path, id_col="doc.id", text_col="the text").count() == docs.count()
    rows = spm.round_trip(docs, path).collect()
    assert len(rows) == len(texts) + 1 and all(r.decoded_same for r in rows)
    counts = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, path).collect()}
    assert counts == {r.doc_id: r.n_pieces for r in rows} and counts[0] == counts[1] == 0
    back = {r.doc_id: r.text for r in spm.decode(spm.encode(docs, path), path).collect()}
    assert back == dict(enumerate(texts))
    assert spm.round_trip(empty, path).count() == token_counts.token_counts(empty, path).count() == 0


# 5 SimHash


def slow_fingerprint(text):
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode()) if w]
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def component_ids(ids, fps, threshold):
    parent = list(range(len(ids)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(ids)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= threshold:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [least.get(find(k)) for k in range(len(ids))]


def test_fingerprint_equals_brute_force(texts):
    for t in texts:
        assert simhash.fingerprint(t) == slow_fingerprint(t)


@pytest.mark.parametrize("reach", [1, 2])
def test_anchors_cover(reach):
    """Any two words within 2 * reach bits meet at an anchor, and the code is perfect."""
    bit, error = simhash._code()
    assert len({int(x) for x in error}) == 2048 and max(int(x).bit_count() for x in error) == 3
    r = random.Random(reach)
    for _ in range(60):
        x = r.getrandbits(64)
        y = x
        for b in r.sample(range(64), r.randrange(0, 2 * reach + 1)):
            y ^= 1 << b
        row, key = simhash.anchors(np.array([x, y], np.uint64), reach)
        assert set(key[row == 0].tolist()) & set(key[row == 1].tolist())


@pytest.mark.parametrize("threshold", [2, 3])
def test_forest_of_many_equals_forest_of_few(threshold):
    r = random.Random(3)
    centre = [r.getrandbits(64) for _ in range(12)]
    fp = np.unique(np.array([c ^ sum(1 << b for b in r.sample(range(64), r.randrange(0, 4))) for c in centre for _ in range(90)], np.uint64))
    many = simhash.forest(fp, threshold)
    try:
        simhash.MATRIX = 10**9
        few = simhash.forest(fp, threshold)
    finally:
        simhash.MATRIX = 512
    ids = list(range(len(fp)))

    def parts(pairs):
        parent = ids[:]

        def find(k):
            while parent[k] != k:
                k = parent[k]
            return k

        for a, b in pairs:
            parent[max(find(a), find(b))] = min(find(a), find(b))
        return [find(k) for k in ids]

    assert len(fp) > 512 and parts(many) == parts(few)


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(201, 200)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: 0 for k in range(1, 41)} | {k: 100 for k in range(101, 140)} | {201: 200}
    assert got == want


def test_near_duplicates_equal_brute_force(spark, docs, empty):
    r = random.Random(2)
    base = [" ".join(f"w{r.randrange(4000)}" for _ in range(400)) for _ in range(20)]
    more = [(1000 + 10 * k + j, b if j == 0 else " ".join(f"x{j}" if q == 17 * j else w for q, w in enumerate(b.split()))) for k, b in enumerate(base) for j in range(5)]
    rows = [(r_.doc_id, r_.text) for r_ in docs.collect()] + more + [(None, "alone here now"), (None, base[0])]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    fps = [slow_fingerprint(t) for _, t in rows]
    want = sorted((i is None, i or 0, f"{f:016x}", c is None, c or 0) for (i, _), f, c in zip(rows, fps, component_ids([i for i, _ in rows], fps, 2), strict=True))
    assert sorted((x.doc_id is None, x.doc_id or 0, x.fingerprint, x.component_id is None, x.component_id or 0) for x in got) == want
    assert simhash.near_duplicates(empty).count() == 0


def test_keep_first_keeps_columns_and_one_of_each(docs, texts):
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    comp = component_ids(list(range(len(texts))), [slow_fingerprint(t) for t in texts], 2)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(comp))


# near-copies in the pipeline


def slow_shingles(text):
    words = words_of((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def slow_near_copies(texts):
    """The least position that links of similarity 0.8 or more reach, for every text."""
    sets, root = [slow_shingles(t) for t in texts], list(range(len(texts)))
    for x in range(len(texts)):
        for y in range(x):
            if sets[x] == sets[y] or len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]):
                old, new = max(root[x], root[y]), min(root[x], root[y])
                root = [new if r == old else r for r in root]
    return root


def edited(r, text, n):
    words = text.split()
    for k in r.sample(range(len(words)), n):
        words[k] = f"y{r.randrange(10**9)}"
    return " ".join(words)


def test_near_copies_equal_brute_force(spark, docs, empty):
    r = random.Random(3)
    base = [" ".join(f"w{r.randrange(4000)}" for _ in range(300)) for _ in range(25)]
    texts = [x.text for x in docs.orderBy("doc_id").collect()] + base + [edited(r, b, n) for b in base for n in (1, 3, 5, 6, 7, 9, 14)]
    chain = [base[0]]
    for _ in range(12):  # each is near the one before, the ends are not near each other
        chain.append(edited(r, chain[-1], 3))
    texts += chain[1:] + [edited(r, base[1], 4) for _ in range(60)]
    want = slow_near_copies(texts)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in near_copies.near_copies(frame).collect()}
    assert [got[k] for k in range(len(texts))] == want
    small = {x.doc_id: x.component_id for x in near_copies.near_copies(frame, block_nodes=4).collect()}
    assert small == got
    assert near_copies.near_copies(empty).count() == 0


@pytest.mark.parametrize("keep", [simhash.keep_first, near_copies.keep_first])
def test_keep_first_goes_by_row_not_by_id(spark, keep):
    """Repeated and null ids lose no text that has no copy, whatever the columns are called."""
    r = random.Random(8)
    a, b, c = (" ".join(f"w{r.randrange(4000)}" for _ in range(60)) for _ in range(3))
    rows = [(1, a, 1), (5, a, 2), (5, b, 3), (5, b, 3), (7, c, 4), (None, c, 5), (None, None, 6), (None, "", 7), (None, a + " " + b, 8)]
    frame = spark.createDataFrame(rows, "`doc.id` long, text string, __id int").withColumns({"node": F.lit(1), "row": F.lit(2), "none": F.lit(3), "root": F.lit(4)})
    kept = keep(frame, id_col="doc.id")
    assert kept.columns == frame.columns
    got = kept.collect()
    assert sorted(x["__id"] for x in got if x["doc.id"] is not None) == [1, 3, 4]
    assert sorted(x["text"] or "" for x in got if x["doc.id"] is None) == ["", a + " " + b]
    assert keep(frame.where("false"), id_col="doc.id").count() == 0


def test_pipeline_drops_near_copies_beyond_two_bits(spark, sf_dir):
    import corpus_pipeline

    r = random.Random(4)
    base = " ".join(f"w{r.randrange(4000)}" for _ in range(400))
    near = [edited(r, base, n) for n in (4, 6, 8)]
    assert min((slow_fingerprint(base) ^ slow_fingerprint(t)).bit_count() for t in near) > 2
    rows = [(k, t) for k, t in enumerate([base, *near, edited(r, base, 120)])]
    kept = corpus_pipeline.deduplicate(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir)
    assert kept.columns == ["doc_id", "text"] and sorted(x.doc_id for x in kept.collect()) == [0, 4]


# 6 quality rules


def slow_statistics(text):
    words = words_of(text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    count = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if count[w] > 1 for j in range(3)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if words_of(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_quality_statistics_equal_brute_force(docs, empty, texts):
    rules = [quality_rules.Rule((quality_rules.Condition("symbols_per_word", True, 0.5),), 1, 0)]
    rows = quality_rules.report(docs, rules).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        n, chars, symbols, dup, repeat = slow_statistics(texts[r.doc_id])
        failed = n < 50 or 100 * repeat > 50 * n
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (n, chars, symbols, dup, repeat, failed)
        assert r.kept == (not failed and symbols / max(1, n) <= 0.5)
    assert quality_rules.report(empty, []).count() == 0
    kept = quality_rules.keep(docs, rules)
    assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect()) == sorted(r.doc_id for r in rows if r.kept)


def test_decision_list_finds_planted_rules():
    r = random.Random(4)
    rows = []
    for _ in range(1500):
        row = {f: r.random() for f in quality_rules.FEATURES}
        row["bad"] = (row["symbols_per_word"] > 0.8 or (row["upper_share"] > 0.7 and row["distinct_share"] < 0.3)) and r.random() < 0.98
        row["prune"] = r.random() < 1 / 3
        rows.append(row)
    rules = quality_rules.learn_rules(rows)
    verdict = lambda row: any(all(c.holds(row) for c in x.conditions) for x in rules)
    assert 2 <= len(rules) <= 6
    assert np.mean([verdict(x) == x["bad"] for x in rows]) > 0.95
    assert quality_rules.learn_rules([]) == [] and quality_rules.learn_rules([x | {"bad": False} for x in rows]) == []


def test_quality_plan_has_no_python(docs):
    plan = quality_rules.report(docs, [])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 2 language


def test_kernel_equals_brute_force():
    a, b = "The cat, 12 sat", "that CAT"
    norm = lambda t: re.sub(r"[^a-z]+", " ", t.lower())
    sets = [{norm(t)[k : k + n] for n in (1, 2, 3) for k in range(len(norm(t)) - n + 1)} for t in (a, b)]
    model = langid.learn([(a, "x"), (b, "y")], landmarks=2)
    want = len(sets[0] & sets[1]) / math.sqrt(len(sets[0]) * len(sets[1]))
    assert model.kernel([langid.grams(langid.codes(a))])[0, 1] == pytest.approx(want, rel=1e-6)
    long = langid.codes("abc def " * 400)
    try:
        langid._BLOCK, block = 100, langid._BLOCK
        assert langid.grams(long).tolist() == np.unique(np.concatenate([long, long[:-1] | long[1:] << 21, long[:-2] | long[1:-1] << 21 | long[2:] << 42])).tolist()
    finally:
        langid._BLOCK = block


def test_languages_of_held_out_rows(spark, docs, empty, sf_dir):
    corpus = table(spark, sf_dir, "documents")
    model = langid.fit(corpus)
    rows = langid.identify(corpus, model).join(corpus.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.97
    odd = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert odd[0].lang_pred == odd[1].lang_pred == odd[2].lang_pred == "und" and odd[0].score == 0
    assert all(0 <= r.score <= 1 for r in odd.values())
    assert langid.identify(empty, model).count() == 0
    long = corpus.limit(400).withColumn("text", F.when(F.col("lang") == "de", F.repeat("text", 40)).otherwise(F.col("text")))
    assert langid.fit(long, max_chars=3000).languages == langid.fit(corpus.limit(400)).languages  # a language of long texts only is learned too
    nothing = langid.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.keep(docs, nothing).count() == docs.count()
    kept = langid.keep(docs, model)
    assert kept.columns == docs.columns and {0, 1, 2}.isdisjoint(r.doc_id for r in kept.collect())


# 7 toxicity


def slow_segments(scores):
    """Maximal segments by their definition: recursively the best segment, then both sides of it."""
    if not scores or max(scores) <= 0:
        return []
    best, where = 0.0, None
    for a in range(len(scores)):
        total = 0.0
        for b in range(a, len(scores)):
            total += scores[b]
            if total > best + 1e-12:
                best, where = total, (a, b)
    a, b = where
    return slow_segments(scores[:a]) + [(a, b, best)] + [(x + b + 1, y + b + 1, s) for x, y, s in slow_segments(scores[b + 1 :])]


def test_segments_equal_their_definition():
    r = random.Random(8)
    for _ in range(200):
        scores = [r.choice([-0.37, -0.37, -0.37, r.uniform(0.1, 2), -r.uniform(0.1, 1)]) for _ in range(r.randrange(1, 40))]
        at = [k for k, s in enumerate(scores) if s != -0.37]
        got = toxicity.maximal_segments(at, [scores[k] for k in at], 0.37)
        want = slow_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert [s for *_, s in got] == pytest.approx([s for *_, s in want])


def test_toxic_held_out_rows(spark, docs, empty):
    corpus, labels = (table(spark, "/root/testdata/sf0.01", n) for n in ("documents", "labels"))
    model = toxicity.fit(corpus, labels)
    r = random.Random(1)
    make = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    rows = [(k, make(200) + (" you idiot stupid scum loser " if k % 2 else " ") + make(200)) for k in range(20)] + [(50, None), (51, ""), (52, make(20000))]
    mine = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x for x in toxicity.score(mine, model).collect()}
    assert [got[k].predicted for k in range(20)] == [k % 2 for k in range(20)] and got[50].score == got[51].score and got[52].predicted == 0
    found = toxicity.passages(mine, model).collect()
    assert {x.doc_id for x in found} == set(range(1, 20, 2)) and all("idiot" in x.passage or "scum" in x.passage for x in found)
    both = toxicity.score(corpus, model).join(labels, "doc_id").where("held_out").collect()
    hit = sum(x.predicted and x.toxic for x in both)
    assert hit / max(1, sum(x.predicted for x in both)) > 0.6 and hit / sum(x.toxic for x in both) > 0.5
    assert toxicity.score(empty, model).count() == 0
    assert all(x.predicted == 0 for x in toxicity.score(docs, toxicity.fit(corpus, labels.where("toxic = 0"))).collect())


# 3 WARC


def test_warc_round_trip(spark, tmp_path):
    r = random.Random(3)
    html = [None, "", "<p>ü</p>", *["<html>" + " ".join(r.choice(WORDS) for _ in range(r.randrange(5, 300))) + "</html>" for _ in range(60)], "z" * 300_000]
    rows = [(k, f"http://h/{k}\r\nX: y", h, 1) for k, h in enumerate(html)]
    rows += [(500 + k, "u", html[k % 7], 1) for k in range(30)] + [(7, "u", html[7], 1), (7, "u", "other", 1), (None, "n", html[9], 1), (None, None, "lonely", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    folder = f"file://{tmp_path}/warc"
    files = warc.write(pages, folder, roll=20_000)
    back = warc.read(files, folder).collect()
    least = {}
    for page, _, h, _ in rows:
        if page is not None:
            least[h or ""] = min(page, least.get(h or "", page))
    want, seen = [], set()
    for page, _, h, _ in rows:
        h = h or ""
        first = least.get(h)
        response = page == first and (page, h) not in seen
        seen.add((page, h))
        sha = base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        want.append((page, len(h.encode()), sha, "response" if response else "revisit", None if response else first))
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in back), key=key) == sorted(want, key=key)
    assert {x.payload.decode() for x in back if x.record_type == "response"} == {h or "" for _, _, h, _ in rows}
    names = [x.path for x in files.collect()]
    assert len(names) > 1 and sum(x.records for x in files.collect()) == len(rows)
    with open(names[0], "rb") as f:  # any reader of skippable frames and dictionaries can follow
        raw = f.read()
    import zstandard

    size = int.from_bytes(raw[4:8], "little")
    assert raw[:4] == bytes.fromhex("5d2a4d18")
    d = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw[8 : 8 + size]))
    one = zstandard.ZstdDecompressor(dict_data=d).decompressobj()
    assert one.decompress(raw[8 + size :]).startswith(b"WARC/1.1\r\n")
    assert list(warc.frames(io.BytesIO(raw)))
    assert warc.round_trip(pages.where("false")).count() == 0


def test_warc_small_payloads_stay_responses(spark):
    pages = spark.createDataFrame([(k, "u", "ab") for k in range(4)] + [(0, "u", "ab"), (8, "u", "abc"), (9, "u", "abc")], "page_id long, url string, html string")
    got = warc.round_trip(pages, least_bytes=3).collect()
    assert sorted((x.page_id, x.record_type) for x in got) == sorted([(k, "response") for k in (0, 0, 1, 2, 3, 8)] + [(9, "revisit")])


# 1 nearest neighbours


def test_walk_is_in_order_of_summed_distance():
    r = np.random.default_rng(0)
    a, b = r.random(9), r.random(7)
    order = ann.walk(a, b, np.ones(63, np.int64), 63)
    total = (a[:, None] + b[None, :]).ravel()
    assert sorted(order.tolist()) == list(range(63)) and np.all(np.diff(total[order]) >= 0)
    assert len(ann.walk(a, b, np.ones(63, np.int64), 10)) == 10


def test_search_recall_ties_and_odd_vectors(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(1500, 16)).astype(np.float32)
    x[700:1200] = x[3]  # a third of the rows are one vector
    rows = [(k, [float(v) for v in x[k]], 1) for k in range(len(x))]
    rows += [(5000, None, 1), (5020, [0.0] * 16, 1), (5040, [float("nan")] * 16, 1), (5060, [None] * 16, 1), (5080, [1.0, 2.0], 1), (None, rows[0][1], 1), (5100, [float("inf")] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = defaultdict(list)
    for q in ann.search(df, df.where("vec_id % 20 = 0"), block_rows=256, query_rows=32, sample_rows=800).orderBy("query_id", "rank").collect():
        got[q.query_id].append((q.rank, q.vec_id, q.score))
    ids = np.arange(len(x))
    true = ann.brute_force(ids, x.astype(float), np.arange(0, len(x), 20))
    assert set(got) == set(true)
    hits = sum(len({v for _, v, _ in got[q]} & set(true[q])) for q in true)
    assert hits / sum(map(len, true.values())) >= 0.9
    for q, found in got.items():
        assert [k for k, _, _ in found] == list(range(1, 21))
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        for _, v, s in found:
            assert s == pytest.approx(float(x[q].astype(float) @ x[v].astype(float)), abs=1e-9) and v != q
    assert [v for _, v, _ in got[700]] == true[700]  # ties: the smaller ids of the common vector
    again = df.where("vec_id in (20, 40)")
    assert ann.search(df, again.union(again), sample_rows=800).count() == 40
    few = spark.createDataFrame(rows[:5], "vec_id long, embedding array<float>, rank int")
    assert ann.search(few, few.where("vec_id = 0")).count() == 4
    assert ann.search(df.where("false"), df).count() == 0 == ann.search(df, df.where("false")).count()


# 9 co-training


def slow_views(x, y, w, ridge):
    """Ridge logistic regression of weighted rows by plain gradient steps on the standardized columns."""
    beta = np.zeros(x.shape[1])
    shrink = np.r_[np.full(x.shape[1] - 1, ridge), 1e-9]
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g, h = x.T @ (w * (y - p)) - shrink * beta, (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(shrink + 1e-9)
        beta = beta + np.linalg.solve(h, g)
        if np.abs(g).max() < 1e-9:
            break
    return beta


def slow_cotraining(text, page, y, aside, text_u, page_u, rounds, share, sure, ridge):
    """Co-training by lists of rows: each view's surest rows, whole steps of 0.01 in the margin, are handed to the other."""
    z = {}
    for name, x, xu in (("text", text, text_u), ("page", page, page_u)):
        mean, scale = x[~aside].mean(axis=0), x[~aside].std(axis=0)
        scale[scale < 1e-9] = 1.0
        z[name] = [np.hstack([(m - mean) / scale, np.ones((len(m), 1))]) for m in (x[~aside], xu)]
    given = {"text": {}, "page": {}}
    yy = y[~aside]

    def fit(name):
        rows = sorted(given[name])
        w = np.r_[np.ones(len(yy)), np.full(len(rows), min(0.5, len(yy) / max(1, len(rows))))]
        return slow_views(np.vstack([z[name][0], z[name][1][rows]]), np.r_[yy, [given[name][r] for r in rows]], w, ridge)

    beta = {"text": fit("text"), "page": fit("page")}
    for _ in range(rounds):
        new = {}
        for teacher, learner in (("text", "page"), ("page", "text")):
            steps = np.floor((np.clip(z[teacher][1] @ beta[teacher], -30, 30) + 30) / 0.01)
            free = [k for k in range(len(text_u)) if k not in given[learner]]
            edge = math.log(sure / (1 - sure))
            for label, many in ((1, math.ceil(share * len(text_u) * yy.mean())), (0, math.ceil(share * len(text_u) * (1 - yy.mean())))):
                able = [k for k in free if (steps[k] * 0.01 - 30 >= edge if label else steps[k] * 0.01 - 29.99 <= -edge)]
                able.sort(key=lambda k: -steps[k] if label else steps[k])
                cut = able[: many][-1:]  # rows in the same step as the last one go along
                new |= {(learner, k): label for k in able if cut and (steps[k] >= steps[cut[0]] if label else steps[k] <= steps[cut[0]])}
        for (learner, k), label in new.items():
            given[learner][k] = label
        if not new:
            break
        beta = {"text": fit("text"), "page": fit("page")}
    return beta, given


def test_cotraining_equals_brute_force(spark):
    corpus, labels = (table(spark, "/root/testdata/sf0.01", n) for n in ("documents", "labels"))
    rows = cotraining.features(corpus).cache()
    known = {r.doc_id: r.quality for r in labels.collect()}
    got = sorted(rows.collect(), key=lambda r: r.doc_id)
    matrix = lambda rs: cotraining._matrices([bytes(r.x) for r in rs], *[np.array([r[c] for r in rs], np.int64) for c in ("source", "lang", "n_chars")])
    teach, free = [r for r in got if r.doc_id in known], [r for r in got if r.doc_id not in known]
    y, aside = np.array([known[r.doc_id] for r in teach], float), np.arange(len(teach)) % 3 == 0
    (text, page), (text_u, page_u) = matrix(teach), matrix(free)
    options = dict(rounds=3, share=0.05, sure=0.9, ridge=2.0)
    beta, given = slow_cotraining(text, page, y, aside, text_u, page_u, **options)
    local = cotraining.Pool(text_u, page_u)
    spread = cotraining.Table(rows.where(F.col("doc_id").isin([r.doc_id for r in free])))
    for pool in (local, spread):
        model = cotraining.learn(text, page, y, aside, pool, steps=100, **options)
        assert model.exchanged == len(given["text"]) + len(given["page"]) > 40
        np.testing.assert_allclose(model.text.beta, beta["text"], atol=2e-2)
        np.testing.assert_allclose(model.page.beta, beta["page"], atol=2e-2)


def test_views_teach_each_other_and_predict(spark, docs, empty):
    corpus, labels = (table(spark, "/root/testdata/sf0.01", n) for n in ("documents", "labels"))
    got = cotraining.classify(corpus, labels).join(labels, "doc_id").where("held_out").collect()
    s, y = np.array([x.score for x in got]), np.array([x.quality for x in got])
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    assert auc > 0.9 and np.all((s >= 0) & (s <= 1))
    rows = cotraining.features(corpus).cache()
    model = cotraining.fit(rows, labels)
    more = cotraining.fit(rows.unionByName(rows.withColumn("doc_id", F.col("doc_id") + 10_000_000)), labels)
    assert more.exchanged > 1.8 * model.exchanged > 0  # what is handed over grows with the pool
    odd = cotraining.score(cotraining.features(docs.drop("lang")), model).collect()
    assert len(odd) == docs.count() and not any(math.isnan(x.score) for x in odd)
    assert cotraining.classify(empty, labels).count() == 0
    assert {x.score for x in cotraining.classify(docs, labels.where("quality = 1")).collect()} == {0.5}


# the queries


def test_oracle_of_warc(spark, sf_dir):
    import duckdb

    from sparkome.llm.queries import op3_warc, oracle_sql

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    cur = con.execute(oracle_sql()["op3_warc"])
    names = [d[0] for d in cur.description]
    want = sorted(json.dumps(dict(zip(names, r, strict=True)), sort_keys=True) for r in cur.fetchall())
    got = op3_warc(spark, sf_dir)
    assert sorted(json.dumps(r.asDict(), sort_keys=True) for r in got.collect()) == want


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = table(spark, sf_dir, "documents")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "simhash_near_dedup", "packing"]
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, sf_dir).cache()
        assert after.columns == docs.columns
        assert 0 < after.count() <= kept.count() and after.subtract(docs).count() == 0
        kept = after
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in kept.collect()}


def test_pipeline_packs_by_frequencies_of_the_whole_corpus(spark, alike, sf_dir):
    import corpus_pipeline

    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")  # some 19 of the texts in each
    try:
        assert topics_met(corpus_pipeline.STAGES[-1][1](spark, alike, sf_dir).collect()) >= 300
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_pipeline_on_nulls_repeats_and_clashing_columns(spark, docs, sf_dir, tmp_path):
    """Every stage on a table with null and repeated ids, null texts, an empty table, and columns that are named like the operators' own."""
    import corpus_pipeline

    corpus = table(spark, sf_dir, "documents")
    twice = corpus.unionByName(corpus.limit(5)).unionByName(corpus.limit(5).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(corpus.limit(3).withColumn("text", F.lit(None).cast("string")))
    odd = twice.withColumns({"__q_x": F.lit(1), "__q_text": F.lit("t"), "__id": F.lit(2), "score": F.lit(3), "node": F.lit(4), "a.b": F.lit(5)})
    for frame in (odd, odd.where("false")):
        now = frame
        for name, stage in corpus_pipeline.STAGES[:3]:
            path = str(tmp_path / f"{name}-{frame is odd}")
            stage(spark, now, sf_dir).write.parquet(path)
            now = spark.read.parquet(path)
            assert now.columns == odd.columns
        if frame is odd:
            texts = [x.text for x in now.select("text").collect()]
            assert len(texts) == len(set(texts)) and 0 < len(texts) < corpus.count()
        packed = corpus_pipeline.pack(spark, now, sf_dir)
        assert packed.columns == corpus_pipeline.pack(spark, corpus, sf_dir).columns
        assert (packed.count() > 0) == (frame is odd)
