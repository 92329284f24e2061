"""Dense array stores of genotypes: Zarr of version 2 in the layout of VCF Zarr, read chunk by chunk by the tasks.

Chunks may be plain or compressed by zlib, gzip, bz2, lzma or Zstandard; for other codecs (blosc) the package numcodecs must be there.
Texts are fixed-width or of the variable-length UTF-8 codec.
"""

from __future__ import annotations

import itertools
import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

from ..types import Genotypes


def _open(path: str):
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(path if "://" in path else re.sub("^(file:)?/+", "file:///", path))


def _plain(data: bytes, codec: dict | None) -> bytes:
    """A chunk without its compression."""
    if codec is None:
        return data
    name = codec["id"]
    if name == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    if name in ("zlib", "gzip", "bz2", "lzma"):
        return __import__(name).decompress(data)
    import numcodecs

    return numcodecs.get_codec(codec).decode(data)


def _texts(data: bytes) -> np.ndarray:
    """The variable-length UTF-8 codec: how many, then each with its length."""
    n, at, out = int.from_bytes(data[:4], "little"), 4, []
    for _ in range(n):
        size = int.from_bytes(data[at : at + 4], "little")
        out.append(data[at + 4 : at + 4 + size].decode())
        at += 4 + size
    return np.array(out, object)


class Stored:
    """An array of a store; slices are put together from the chunks that hold them."""

    def __init__(self, path: str, name: str):
        self.fs, place = _open(path)
        self.place = f"{place}/{name}"
        with self.fs.open_input_stream(f"{self.place}/.zarray") as f:
            self.meta = json.loads(f.read())
        if self.meta["zarr_format"] != 2 or self.meta["order"] != "C":
            raise ValueError("only arrays of format 2 in C order")
        self.shape, self.chunks = tuple(self.meta["shape"]), tuple(self.meta["chunks"])
        self.words = any(f["id"] == "vlen-utf8" for f in self.meta.get("filters") or [])
        self.dtype = np.dtype(object) if self.words else np.dtype(self.meta["dtype"])

    def _chunk(self, at: tuple[int, ...]) -> np.ndarray:
        import pyarrow.fs as pafs

        path = f"{self.place}/{self.meta.get('dimension_separator', '.').join(map(str, at))}"
        if self.fs.get_file_info(path).type == pafs.FileType.NotFound:  # a chunk of nothing but the fill value isn't stored
            return np.full(self.chunks, self.meta["fill_value"], self.dtype)
        with self.fs.open_input_stream(path) as f:
            data = _plain(f.read(), self.meta["compressor"])
        return (_texts(data) if self.words else np.frombuffer(data, self.dtype)).reshape(self.chunks)

    def read(self, *ranges: tuple[int, int]) -> np.ndarray:
        """The elements of a range on each of the first axes, all of the others."""
        ranges = [*ranges, *[(0, n) for n in self.shape[len(ranges) :]]]
        out = np.empty([b - a for a, b in ranges], self.dtype)
        for at in itertools.product(*[range(a // c, -(-b // c)) for (a, b), c in zip(ranges, self.chunks, strict=True)]):
            spans = [(max(a, k * c), min(b, (k + 1) * c)) for k, (a, b), c in zip(at, ranges, self.chunks, strict=True)]
            to = tuple(slice(x - a, y - a) for (x, y), (a, _) in zip(spans, ranges, strict=True))
            out[to] = self._chunk(at)[tuple(slice(x - k * c, y - k * c) for k, (x, y), c in zip(at, spans, self.chunks, strict=True))]
        return out


def read_zarr(spark: SparkSession, path: str) -> Genotypes:
    """A store with call_genotype (variants x samples x ploidy), variant_position, variant_id, variant_allele, variant_contig, contig_id and sample_id.

    A task reads the chunks of call_genotype that it is given; a missing allele is -1, and alleles beyond a variant's own are dropped.
    Variants are numbered in the store's order. A row for each contig and sample reaches the driver.
    """
    calls = Stored(path, "call_genotype")
    n_variants, n_samples = calls.shape[:2]
    step_v, step_s = calls.chunks[:2]
    contigs = [str(c) for c in Stored(path, "contig_id").read()]
    samples = spark.sparkContext.broadcast([str(s) for s in Stored(path, "sample_id").read()])

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stored = {c: Stored(path, f"variant_{c}") for c in ("id", "contig", "position", "allele")}
        for pdf in batches:
            for b in pdf["id"]:
                span = (int(b) * step_v, min(n_variants, (int(b) + 1) * step_v))
                got = {c: a.read(span) for c, a in stored.items()}
                yield pd.DataFrame({
                    "variant_idx": np.arange(*span), "variant_id": [str(x) for x in got["id"]], "contig": [contigs[int(c)] for c in got["contig"]],
                    "position": got["position"].astype(np.int64), "alleles": [[str(a) for a in row if str(a)] for row in got["allele"]],
                })

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stored = Stored(path, "call_genotype")
        for pdf in batches:
            for b in pdf["id"]:
                v, s = divmod(int(b), math.ceil(n_samples / step_s))
                rows, cols = (v * step_v, min(n_variants, (v + 1) * step_v)), (s * step_s, min(n_samples, (s + 1) * step_s))
                gt = np.maximum(stored.read(rows, cols).astype(np.int32), -1)
                for k in range(len(gt)):
                    yield pd.DataFrame({"variant_idx": rows[0] + k, "sample_id": samples.value[slice(*cols)], "gt": list(gt[k])})

    blocks = lambda n: spark.range(0, n, 1, max(1, min(n, 4 * spark.sparkContext.defaultParallelism)))
    n_blocks = math.ceil(n_variants / step_v)
    variants = blocks(n_blocks).mapInPandas(describe, "variant_idx long, variant_id string, contig string, position long, alleles array<string>")
    return Genotypes(variants, blocks(n_blocks * math.ceil(n_samples / step_s)).mapInPandas(read, "variant_idx long, sample_id string, gt array<int>"))
