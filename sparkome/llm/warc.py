"""WARC archives whose records are single Zstandard frames that share one dictionary.

A file begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself compressed, and
goes on with one frame for each record, as public readers of .warc.zst expect. The dictionary is trained on a bounded
sample of the records that are archived. Of records with equal payloads the first is a response and the others
are revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window, functions as F

from .common import new_path, sampled, written

SKIPPABLE = 0x184D2A5D
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(value: str | None) -> str:
    return " ".join((value or "").split())


def record_id(page: int | None, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page/{page}/{copy}')}>"


def record(page: int | None, url: str | None, payload: bytes | None, size: int, sha: str, first: int | None, copy: int, date: str) -> bytes:
    """One WARC record. payload None: a revisit of page `first`. The block is an HTTP response whose Content-Length is that of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    fields = [
        ("WARC-Type", "response" if payload is not None else "revisit"),
        ("WARC-Record-ID", record_id(page, copy)),
        ("WARC-Date", date),
        ("WARC-Target-URI", _header(url)),
        ("WARC-Payload-Digest", f"sha1:{sha}"),
        ("X-Page-ID", "" if page is None else str(page)),
    ]
    if payload is None:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(first, 0)), ("X-Refers-To-Page", "" if first is None else str(first)), ("WARC-Truncated", "length")]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes, int, bytes]:
    """Headers, HTTP head, the Content-Length that the head states, and the payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    size = int(fields["Content-Length"])
    block, tail = rest[:size], rest[size:]
    if len(block) != size or tail != b"\r\n\r\n":
        raise ValueError("a WARC record that doesn't end where its length says")
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return fields, http, stated, payload


def train(samples: list[bytes], size: int) -> bytes:
    """A Zstandard dictionary; where the samples are too few to train one, their own bytes as raw content."""
    import zstandard

    if len(samples) >= 16:
        try:
            return zstandard.train_dictionary(size, samples).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-size:]


def lead(dictionary: bytes) -> bytes:
    """The skippable frame that opens a file."""
    import zstandard

    body = zstandard.ZstdCompressor(level=9).compress(dictionary)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def _zdict(dictionary: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(dictionary) if len(dictionary) >= 8 else None


def frames(source) -> Iterator[bytes]:
    """The records of an archive, from a file object: the dictionary is what the leading frame holds."""
    import zstandard

    magic, size = struct.unpack("<II", source.read(8))
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    zdict = _zdict(zstandard.ZstdDecompressor().decompress(source.read(size)))
    one = zstandard.ZstdDecompressor(dict_data=zdict) if zdict else zstandard.ZstdDecompressor()
    rest = b""
    while True:
        if not rest and not (rest := source.read(1 << 20)):
            return
        frame, parts = one.decompressobj(), []
        while True:
            parts.append(frame.decompress(rest))
            if frame.eof:
                rest = frame.unused_data
                break
            if not (rest := source.read(1 << 20)):
                raise ValueError("an archive ends inside a record")
        yield b"".join(parts)


def _uri(path: str) -> tuple[pafs.FileSystem, str]:
    """The store and the path in it; a bare path is local, any scheme that Arrow knows (file, hdfs, s3, gs) goes to its store."""
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


def _write(folder: str, dictionary: bytes, level: int, roll: int, date: str, least_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        fs, base = _uri(folder)
        zdict = _zdict(dictionary)
        zip_ = zstandard.ZstdCompressor(level=level, dict_data=zdict, write_content_size=True, write_checksum=True) if zdict else zstandard.ZstdCompressor(level=level, write_checksum=True)
        out = name = None
        done: list[tuple] = []
        n = size = 0

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((name, n, size))
                out = None

        for batch in batches:
            for page, url, html, bytes_, sha, first, copy in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    # a name of its own for each attempt: only files that a finished task reports are read
                    name = f"{base}/{uuid.uuid4().hex}.warc.zst"
                    out, n, size = fs.open_output_stream(name, compression=None), 0, 0
                    size += out.write(lead(dictionary)) or 0
                is_first = page == first and (copy == 0 or bytes_ < least_bytes)
                packed = zip_.compress(record(page, url, (html or "").encode() if is_first else None, bytes_, sha, first, copy, date))
                out.write(packed)
                size += len(packed)
                n += 1
                if size >= roll:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([f"{x[0]}" for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64())], ["path", "records", "bytes"])

    return run


def write(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, dictionary_bytes: int = 112_640, sample_rows: int = 1000, sample_chars: int = 32_768, level: int = 3, roll: int = 64 << 20, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Archive every row as a record below `folder` and return path, records, bytes of the files.

    Steps: digests in a map; the smallest id of each digest with copies by an aggregate that combines before
    its shuffle; a join on salted digests, so that one payload that a third of the rows hold is dealt over
    many tasks; a join by id that brings the bodies; and a map that writes. A task reports its files once it has
    ended, and files of lost or repeated attempts have names that no report holds.

    Null html: an empty payload. Payloads below least_bytes are all responses. Repeated rows (equal id and
    payload): the first is the response and the others revisit it. A null id is larger than any other. The
    dictionary comes from at most sample_rows payloads of up to sample_chars, chosen by a hash of the id;
    without any the archives do without. An empty table gives no files.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    picked = sampled(rows, "page_id", sample_rows).where(F.length("html").between(1, sample_chars))
    sample = [record(r[0], r[1], r[2].encode(), len(r[2].encode()), digest(r[2].encode()), r[0], 0, date) for r in picked.collect()]
    dictionary = train(sample, dictionary_bytes)
    key = F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("key")
    # as hexadecimal: the JVM computes it, and base32 follows where records are written
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = rows.select("page_id", F.octet_length(body).cast("long").alias("bytes"), F.sha1(body).alias("sha"))
    keyed = keyed.groupBy("page_id", "sha").agg(F.max("bytes").alias("bytes"))
    keyed = written(keyed, "warc-digests")
    firsts = keyed.where(F.col("bytes") >= least_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "first")
    salts = 16
    salted = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    marked = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int")).join(salted, ["sha", "salt"], "left")
    marked = marked.select(key, "sha", "bytes", F.when(F.col("bytes") >= least_bytes, F.coalesce("first", "page_id")).otherwise(F.col("page_id")).alias("first"))
    hashed = rows.select(key, "page_id", "url", "html", F.sha1(body).alias("sha"))
    full = hashed.join(marked, ["key", "sha"])
    full = full.select("key", "page_id", "url", F.when(F.col("page_id").eqNullSafe(F.col("first")), F.col("html")).alias("html"), "bytes", "sha", "first")
    # rows of one key hold equal bodies: any order among them will do, and this one needs no further sort
    copy = F.row_number().over(Window.partitionBy("key", "sha").orderBy("key")) - 1
    full = full.withColumn("copy", copy.cast("long")).drop("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def base32() -> Iterator[pa.RecordBatch]:
            for b in batches:
                sha = pa.array([base64.b32encode(bytes.fromhex(x)).decode() for x in b.column(4).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*b.columns[:4], sha, *b.columns[5:]], b.schema.names)

        yield from _write(folder, dictionary, level, roll, date, least_bytes)(base32())

    _uri(folder)[0].create_dir(_uri(folder)[1], recursive=True)
    return written(full.mapInArrow(run, "path string, records long, bytes long"), "warc-files")


def read(files: DataFrame, folder: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload of every record of the files that `files` names.

    A response's length and digest are those of what was read; a revisit's are what its record states.
    A digest that doesn't fit its payload raises.
    """
    store = folder if "://" in folder else f"file://{folder.removeprefix('file:')}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

        number = lambda x: int(x) if x else None
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, _ = _uri(store)
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None) as source:
                    for raw in frames(source):
                        fields, _, stated, payload = parse(raw)
                        sha, revisit = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"] == "revisit"
                        if not revisit and (digest(payload) != sha or len(payload) != stated):
                            raise ValueError(f"record {fields['WARC-Record-ID']} holds another payload than it says")
                        rows.append((number(fields["X-Page-ID"]), fields["WARC-Target-URI"], stated, sha, fields["WARC-Type"], number(fields.get("X-Refers-To-Page")) if revisit else None, None if revisit else payload))
                        held += len(payload)
                        if held > 8 << 20 or len(rows) >= 5000:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    spread = files.select("path").repartition(max(1, files.sparkSession.sparkContext.defaultParallelism * 2), "path")
    return spread.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def round_trip(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write the archives, read them back and return what the records say, without payloads."""
    folder = folder or new_path(pages.sparkSession, "warc")
    return read(write(pages, folder, **options), folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


__all__ = ["digest", "frames", "lead", "parse", "read", "record", "round_trip", "train", "write"]
