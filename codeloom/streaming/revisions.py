"""Revisions of a live graph as a log of numbered entries in a shared folder: what was edited, and up to where a published graph has seen it.

An entry is written beside the log and renamed to the next free number without overwriting, so that of two writers one sees the other's entry and decides
anew. Nothing is kept in the driver: another process, or the same one after a restart, reads the same state. The folder must be on a file
system whose rename doesn't overwrite when told so (HDFS, or a local folder in tests).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.sources.sinks import _fs

ENTRY = "number long, kind string, paths array<string>, listed string, target long, message string"


def names_in(spark: SparkSession, folder: str) -> list[str]:
    fs, at = _fs(spark, folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def put_once(spark: SparkSession, side: str, at: str, text: str) -> bool:
    """Write a small file and move it to `at`; False if somebody else has done so before."""
    jvm = spark.sparkContext._jvm
    fs, _ = _fs(spark, side)
    start, end = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{side}/{uuid.uuid4().hex}", at))
    fs.mkdirs(end.getParent())
    out = fs.create(start, True)
    out.write(bytearray(text.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf()).rename(start, end, options)
    except Exception:
        fs.delete(start, False)
        if not fs.exists(end):
            raise
        return False
    return True


class Revisions:
    """Observed and published revisions, dirty paths, failures and receipts of edits."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.log = spark, root, f"{root}/entries"
        fs, at = _fs(spark, self.log)
        fs.mkdirs(at)

    def entries(self) -> DataFrame:
        return self.spark.read.schema(ENTRY).json(self.log)

    def _append(self, decide) -> dict | None:
        """decide(number, state) → the entry for this number, or None for none; asked again when another writer was faster."""
        while True:
            last = names_in(self.spark, self.log)
            number = int(last[-1].split(".")[0]) + 1 if last else 1
            entry = decide(number)
            if entry is None:
                return None
            entry = {"number": number} | entry
            if put_once(self.spark, f"{self.root}/side", f"{self.log}/{number:020d}.json", json.dumps(entry)):
                return entry

    def edit(self, paths: list[str]) -> dict:
        """A receipt: answers from this revision on have seen these paths."""
        entry = self._append(lambda n: {"kind": "edit", "paths": sorted(set(paths))})
        return {"paths": entry["paths"], "min_revision": entry["number"]}

    def observe(self, changed: DataFrame) -> dict | None:
        """As edit, for any number of paths (column file_path), which Spark writes beside the log; None if there are none."""
        listed = f"{self.root}/listed/{uuid.uuid4().hex}"
        changed.select("file_path").distinct().write.parquet(listed)
        if not self.spark.read.parquet(listed).head(1):
            return None
        return {"min_revision": self._append(lambda n: {"kind": "edit", "paths": [], "listed": listed})["number"]}

    def _state(self):
        e = F.col("kind")
        return self.entries().agg(
            F.coalesce(F.max(F.when(e == "edit", F.col("number"))), F.lit(0)).alias("observed"),
            F.coalesce(F.max(F.when(e == "publish", F.col("target"))), F.lit(0)).alias("published"),
            F.max_by(F.when(e.isin("failed", "publish"), F.struct("kind", "message")), F.when(e.isin("failed", "publish"), F.col("number"))).alias("last"),
        ).first()

    def publish(self, revision: int) -> bool:
        """A graph that has seen all edits up to this revision; late results of an older one are dropped."""
        return self._append(lambda n: None if revision < self._state().published else {"kind": "publish", "target": revision}) is not None

    def failed(self, revision: int, message: str) -> None:
        """A rebuild that failed: the published graph and the dirty paths stay."""
        self._append(lambda n: {"kind": "failed", "target": revision, "message": message})

    def fresh(self, receipt: dict) -> bool:
        return self._state().published >= receipt["min_revision"]

    def paths_of(self, edits: DataFrame) -> DataFrame:
        """(file_path, number) of edit entries, a row for each path with its last edit."""
        out = edits.select(F.explode("paths").alias("file_path"), "number")
        for r in edits.filter("listed is not null").select("listed", "number").collect():  # one a poll
            out = out.unionByName(self.spark.read.parquet(r.listed).withColumn("number", F.lit(r.number)))
        return out.groupBy("file_path").agg(F.max("number").alias("number"))

    def dirty(self) -> DataFrame:
        return self.paths_of(self.entries().filter((F.col("kind") == "edit") & (F.col("number") > self._state().published)))

    def status(self) -> dict:
        s = self._state()
        error = s.last.message if s.last is not None and s.last.kind == "failed" else None
        return {"observed": s.observed, "published": s.published, "stale": s.observed > s.published or error is not None, "dirty": self.dirty().count(), "last_error": error}
