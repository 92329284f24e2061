"""Runs of programs: gates by content hash, an audit table, resuming, reverting, status."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ...sources.snapshot import exists, put_new

AUDIT = "package_id long, source string, step string, status string, hash string, rows long, stats string, started timestamp"
STEPS = ("extract", "transform", "load")
DONE = ("completed", "up_to_date")


@dataclass
class Source:
    """A source's steps. extract gives a hash of its files, transform frames, load the counts of what it wrote.

    strategy says what reverting does: `deactivate` entities and aliases, `delete` relationships, or `mixed`, both.
    files are the folders of its downloads, which a cleanup removes.
    """

    name: str
    extract: Callable[[], str]
    transform: Callable[[], dict[str, DataFrame]]
    load: Callable[[dict[str, DataFrame], int], dict[str, int]]
    after: tuple[str, ...] = ()
    active: bool = True
    system: str = ""
    strategy: str = "deactivate"
    files: tuple[str, ...] = ()


@dataclass
class Manager:
    """Sources in the order of their dependencies over an audit table kept as Parquet files that are only ever added to."""

    spark: SparkSession
    folder: str
    sources: dict[str, Source] = field(default_factory=dict)

    def add(self, source: Source) -> None:
        if source.strategy not in ("deactivate", "delete", "mixed"):
            raise ValueError(f"unknown strategy {source.strategy!r}")
        self.sources[source.name] = source

    def _order(self) -> list[Source]:
        done: list[Source] = []
        names = [s for s in self.sources.values() if s.active]
        while names:
            ready = [s for s in names if all(a in {d.name for d in done} or a not in self.sources for a in s.after)]
            if not ready:
                raise ValueError("sources depend on each other in a circle")
            done.append(ready[0])
            names.remove(ready[0])
        return done

    def resolve(self, names: list[str] | None = None, systems: list[str] | None = None) -> list[str]:
        """Active sources by name and by system, in order; a name that isn't there is an error."""
        if unknown := [n for n in names or [] if n not in self.sources]:
            raise ValueError(f"unknown sources {unknown}")
        return [s.name for s in self._order() if (not names or s.name in names) and (not systems or s.system in systems)]

    def _rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(AUDIT).parquet(f"{self.folder}/audit")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], AUDIT)

    def audit(self) -> DataFrame:
        """The rows that no hard revert has forgotten."""
        rows = self._rows()
        gone = rows.where("step = 'forget'").select(F.col("package_id").alias("__upto"), F.col("source").alias("__s"), F.get_json_object("stats", "$.package").cast("long").alias("__p"))
        hit = (F.col("source") == F.col("__s")) & (F.col("package_id") < F.col("__upto")) & (F.col("__p").isNull() | (F.col("__p") == F.col("package_id")))
        return rows.where("step != 'forget'").join(gone, hit, "left_anti")

    def _next(self) -> int:
        """A package id of this run alone: whoever creates its marker first has it."""
        package = (self._rows().agg(F.max("package_id")).first()[0] or 0) + 1
        while not put_new(self.spark, f"{self.folder}/packages/{package}", ""):
            package += 1
        return package

    def _log(self, package: int, source: str, step: str, status: str, digest: str = "", stats: dict | None = None) -> None:
        told = {k: v for k, v in (stats or {}).items() if v}
        rows = sum(v for v in told.values() if isinstance(v, int)) if step == "load" else 0
        row = self.spark.createDataFrame([(package, source, step, status, digest, rows, json.dumps(told))], AUDIT.removesuffix(", started timestamp"))
        row.withColumn("started", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.folder}/audit")

    def _latest(self, source: str) -> dict[str, tuple[str, str]]:
        """step -> (status, hash) of the source's last row of each step since anything of it was reverted: a few rows."""
        rows = self.audit().where(F.col("source") == source).select("package_id", "started", "step", "status", "hash").orderBy("package_id", "started").collect()
        out: dict[str, tuple[str, str]] = {}
        for r in rows:
            if r["step"] == "rollback":
                out = {}
            else:
                out[r["step"]] = (r["status"], r["hash"])
        return out

    def run(self, names: list[str] | None = None, steps: tuple[str, ...] = STEPS, force: tuple[str, ...] = (), stop_on_error: bool = False, resume: bool = False, systems: list[str] | None = None) -> dict[str, str]:
        """source -> completed, up_to_date, skipped or failed: and why.

        Each step is left out where it has completed with the same hash, unless it is forced: an extract is noted as up to date, a
        transform's frames are read back from its processed files, a load writes nothing.
        """
        out: dict[str, str] = {}
        for name in self.resolve(names, systems):
            s, last = self.sources[name], self._latest(name)
            if resume and last.get("load", ("",))[0] in DONE:
                out[name] = "skipped"
                continue
            package, step = self._next(), "extract"
            fresh = lambda step, digest: step not in force and last.get(step, ("", ""))[0] in DONE and last[step][1] == digest  # noqa: B023, E731
            try:
                digest = s.extract()
                out[name] = "completed"
                if "extract" in steps:
                    self._log(package, name, "extract", "up_to_date" if fresh("extract", digest) else "completed", digest)
                if "load" in steps and fresh("load", digest):
                    self._log(package, name, "load", "up_to_date", digest)
                    out[name] = "up_to_date"
                    continue
                step, place = "transform", f"{self.folder}/processed/{name}/{hashlib.sha256(digest.encode()).hexdigest()[:16]}"
                frames: dict[str, DataFrame] = {}
                if {"transform", "load"} & set(steps):
                    if fresh("transform", digest) and exists(self.spark, f"{place}/frames.json"):
                        frames, status = read_processed(self.spark, place), "up_to_date"
                    else:
                        frames, status = write_processed(s.transform(), place), "completed"
                    if "transform" in steps:
                        self._log(package, name, "transform", status, digest)
                step = "load"
                if "load" in steps:
                    self._log(package, name, "load", "completed", digest, s.load(frames, package))
            except Exception as e:  # noqa: BLE001  a source that fails is recorded, and the others go on unless asked
                self._log(package, name, step, "failed", "", {"error": str(e)[:300]})
                out[name] = f"failed: {str(e)[:200]}"
                if stop_on_error:
                    break
        return out

    def run_all(self, *, resume: bool = True, stop_on_error: bool = False, **options) -> dict[str, int]:
        """Numbers of the sources that were selected, skipped, and did or didn't succeed."""
        got = self.run(resume=resume, stop_on_error=stop_on_error, **options)
        failed, skipped = sum(v.startswith("failed") for v in got.values()), sum(v == "skipped" for v in got.values())
        return {"selected": len(got), "skipped": skipped, "succeeded": len(got) - failed - skipped, "failed": failed}

    def rollback(self, tables: dict[str, DataFrame], *, sources: list[str] | None = None, packages: list[int] | None = None, hard: bool = False) -> dict[str, DataFrame]:
        """The tables without what the sources, or the packages, have loaded, by each source's strategy.

        Soft: entities and aliases become inactive, relationships go. Hard: entities and aliases go, with the
        relationships and aliases that refer to them, and the audit forgets the packages, last of all. The audit keeps a record of a soft one.
        """
        if (sources is None) == (packages is None):
            raise ValueError("sources or packages")
        if unknown := [n for n in sources or [] if n not in self.sources]:
            raise ValueError(f"unknown sources {unknown}")
        if packages is not None:
            owner = {r[0]: r[1] for r in self.audit().where(F.col("package_id").isin(packages)).select("package_id", "source").distinct().collect()}
            parts = [(owner.get(p, ""), p, F.col("package_id") == p) for p in packages]
        else:
            parts = [(n, None, F.col("source") == n) for n in sources]
        for name, package, mine in parts:
            known = self.sources.get(name)
            tables = _reverted(tables, known.strategy if known else "deactivate", F.coalesce(mine, F.lit(False)), hard)
            self._log(self._next(), name, "forget" if hard else "rollback", "completed", "", {"package": package})
        return tables

    def clean(self, names: list[str]) -> None:
        """Remove the downloads and processed files of sources."""
        for name in self.resolve(names):
            for path in (*self.sources[name].files, f"{self.folder}/processed/{name}"):
                p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def status(self) -> DataFrame:
        return status(self.audit())


def _reverted(tables: dict[str, DataFrame], strategy: str, mine: Column, hard: bool) -> dict[str, DataFrame]:
    out = dict(tables)
    if strategy in ("delete", "mixed") and "relationships" in out:
        out["relationships"] = out["relationships"].where(~mine)
    if strategy in ("deactivate", "mixed"):
        for t in ("entities", "aliases"):
            if t in out:
                out[t] = out[t].where(~mine) if hard else out[t].withColumn("is_active", F.when(mine, False).otherwise(F.col("is_active")))
        if hard and "entities" in tables:
            gone = tables["entities"].where(mine).select(F.col("entity_id").alias("__gone"))
            for t, keys in (("aliases", ("entity_id",)), ("relationships", ("entity_1_id", "entity_2_id")), ("locations", ("entity_id",))):
                for key in keys if t in out else ():
                    out[t] = out[t].join(gone, F.col(key) == F.col("__gone"), "left_anti")
    return out


def write_processed(frames: dict[str, DataFrame], folder: str) -> dict[str, DataFrame]:
    """A program's frames as Parquet below its folder (rejects as CSV too), read back: loads start from files that stay."""
    out = {}
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}_data.parquet")
        out[name] = df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}_data.parquet")
        if name == "rejects":
            out[name].write.mode("overwrite").option("header", True).csv(f"{folder}/skipped_relationships.csv")
    for df in frames.values():
        put_new(df.sparkSession, f"{folder}/frames.json", json.dumps(sorted(frames)))
        break
    return out


def read_processed(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The frames that write_processed has left in a folder."""
    names = json.loads(spark.read.text(f"{folder}/frames.json", wholetext=True).first()[0])
    return {n: spark.read.parquet(f"{folder}/{n}_data.parquet") for n in names}


def status(audit: DataFrame) -> DataFrame:
    """One row a source: status and package of the latest package of each step."""
    last = F.row_number().over(Window.partitionBy("source", "step").orderBy(F.desc("package_id")))
    rows = audit.where(F.col("step").isin(*STEPS)).withColumn("r", last).where("r = 1")
    return rows.groupBy("source").pivot("step", list(STEPS)).agg(F.first("status").alias("status"), F.first("package_id").alias("package"))


def content_hash(spark: SparkSession, paths: list[str]) -> str:
    """SHA-256 over the files' own hashes, computed where the files are read."""
    rows = spark.read.format("binaryFile").load(paths).select(F.element_at(F.split("path", "/"), -1).alias("n"), F.sha2("content", 256).alias("h")).orderBy("n").collect()
    return hashlib.sha256("".join(f"{r[0]}{r[1]}" for r in rows).encode()).hexdigest()
