"""Snapshots: a folder of Parquet tables with a manifest of versions, hashes, rows and columns."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

VERSION = 1


def manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest.json", wholetext=True).first()[0])


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _put(spark: SparkSession, path: str, text: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def put_manifest(spark: SparkSession, path: str, content: dict) -> None:
    _put(spark, f"{path}/manifest.json", json.dumps(content, indent=1, sort_keys=True))


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with the text, but for one that is there already: then nothing is changed and the answer is no."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        out = fs.create(p, False)
    except Exception as e:
        if "FileAlreadyExists" not in str(e):
            raise
        return False
    out.write(bytearray(text.encode()))
    out.close()
    return True


def file_hashes(spark: SparkSession, folder: str) -> dict[str, str]:
    """name -> SHA-256 of the part files; a row for each file reaches the driver."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(folder)
    return {r[0]: r[1] for r in rows.select(F.element_at(F.split("path", "/"), -1), F.sha2("content", 256)).collect()}


def portable(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, so that any reader of plain columns can use the table."""
    return df.select(*[F.to_json(F.col(f"`{c}`")).alias(c) if t.startswith(("array", "struct", "map")) else F.col(f"`{c}`") for c, t in df.dtypes])


def export(spark: SparkSession, path: str, tables: dict[str, DataFrame], *, only: list[str] | None = None, exclude: tuple[str, ...] = (), overwrite: bool = False, plain: bool = True, version: str = "1") -> dict:
    """Write the tables (empty ones too) with zstd and the manifest last. A folder that has a manifest is refused unless overwritten."""
    if exists(spark, f"{path}/manifest.json") and not overwrite:
        raise FileExistsError(path)
    entries = {}
    for name, df in tables.items():
        if (only and name not in only) or name in exclude:
            continue
        folder = f"{path}/{name}.parquet"
        (portable(df) if plain else df).write.mode("overwrite").option("compression", "zstd").parquet(folder)
        back = spark.read.parquet(folder)
        entries[name] = {"rows": back.count(), "columns": back.columns, "files": file_hashes(spark, folder)}
    made = {"format": VERSION, "version": version, "tables": entries}
    put_manifest(spark, path, made)
    return made


def open_snapshot(spark: SparkSession, path: str, views: bool = False) -> dict[str, DataFrame]:
    """The tables that the manifest names, and temporary views of them if asked. path may begin with parquet://."""
    path = path.removeprefix("parquet://")
    found = {name: spark.read.parquet(f"{path}/{name}.parquet") for name in manifest(spark, path)["tables"]}
    if views:
        for name, df in found.items():
            df.createOrReplaceTempView(name)
    return found


def _copy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Copy files (source, target, sha256) that aren't at their target yet, through a partial file that is moved when its hash is right."""
    import pyarrow.fs as pafs

    place = lambda uri: pafs.FileSystem.from_uri(uri if "://" in uri else re.sub("^(file:)?/+", "file:///", uri))

    def digest(fs, path: str) -> str:
        h = hashlib.sha256()
        with fs.open_input_stream(path) as f:
            while block := f.read(1 << 22):
                h.update(block)
        return h.hexdigest()

    for pdf in batches:
        done = []
        for source, target, want in pdf[["source", "target", "sha256"]].itertuples(index=False):
            (one, a), (two, b) = place(source), place(target)
            if two.get_file_info(b).type == pafs.FileType.File and digest(two, b) == want:
                done.append((target, False))
                continue
            two.create_dir(b.rpartition("/")[0])
            pafs.copy_files(a, f"{b}.part", source_filesystem=one, destination_filesystem=two)
            if want and digest(two, f"{b}.part") != want:
                two.delete_file(f"{b}.part")
                raise ValueError(f"{source} isn't what its hash says")
            two.move(f"{b}.part", b)
            done.append((target, True))
        yield pd.DataFrame(done, columns=["target", "copied"])


def copy_files(spark: SparkSession, files: DataFrame) -> DataFrame:
    """target, copied of files (source, target, sha256), copied by the tasks between any stores that Arrow opens; files that are there with their hash are left."""
    return files.select("source", "target", "sha256").repartition(4 * spark.sparkContext.defaultParallelism).mapInPandas(_copy, "target string, copied boolean")


def download(spark: SparkSession, path: str, target: str) -> int:
    """Copy a snapshot to another store, its manifest last; the number of files that were copied. A download that broke off goes on where it was."""
    path = path.removeprefix("parquet://")
    found = manifest(spark, path)
    folders = {f"{t}.parquet": e for t, e in found["tables"].items()} | ({"nlp/dictionary.parquet": found["dictionary"]} if "dictionary" in found else {})
    files = [(f"{path}/{t}/{name}", f"{target}/{t}/{name}", sha) for t, e in folders.items() for name, sha in e["files"].items()]
    done = copy_files(spark, spark.createDataFrame(files, "source string, target string, sha256 string"))
    copied = done.agg(F.count_if("copied")).first()[0] if files else 0
    put_manifest(spark, target, found)
    return copied


def verify(spark: SparkSession, path: str) -> list[str]:
    """Names of tables whose files aren't those of the manifest."""
    path = path.removeprefix("parquet://")
    return [name for name, e in manifest(spark, path)["tables"].items() if file_hashes(spark, f"{path}/{name}.parquet") != e["files"]]
