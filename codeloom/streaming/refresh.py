"""Live refresh: a stream of edits whose micro-batches rebuild what changed, from durable state; windowed counts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeloom.functions import expr as E
from codeloom.operators.graph import cut
from codeloom.sources import scan
from codeloom.sources.sinks import _fs
from codeloom.streaming.revisions import ENTRY, Revisions, names_in

STATE = "file_path string, modified_at timestamp, size_bytes long, content_hash long"
#: Up to so many changed files are opened by name; more are found by a scan of the folder, with the same result.
BY_NAME = 1000
#: So many batches' changes lie beside a full state before the next one is full.
DELTAS = 16


def file_state(spark: SparkSession, shared: str, below: int | None = None) -> DataFrame:
    """What the batches before `below` (all, if None) left: the last row of each file. Rows of removed files have no hash."""
    done = {int(n.split("-")[1]): n for n in names_in(spark, f"{shared}/state") if "_SUCCESS" in names_in(spark, f"{shared}/state/{n}")}
    done = {k: n for k, n in done.items() if below is None or k < below}
    full = max((k for k, n in done.items() if n.startswith("full")), default=-1)
    out = spark.createDataFrame([], f"{STATE}, batch long")
    for k, n in sorted(done.items()):
        if k >= full:
            out = out.unionByName(spark.read.schema(STATE).parquet(f"{shared}/state/{n}").withColumn("batch", F.lit(k)))
    row = F.struct("modified_at", "size_bytes", "content_hash")
    return out.groupBy("file_path").agg(F.max_by(row, "batch").alias("r")).select("file_path", "r.*")


def put_state(spark: SparkSession, shared: str, number: int, changed: DataFrame) -> None:
    """The state after a batch: its changes alone, or everything where many changes have gathered. A batch that is retried writes the same again."""
    kept = names_in(spark, f"{shared}/state")
    full = max((int(n.split("-")[1]) for n in kept if n.startswith("full") and int(n.split("-")[1]) < number), default=-1)
    if number - full <= DELTAS:
        return changed.write.mode("overwrite").parquet(f"{shared}/state/delta-{number:020d}")
    merged = file_state(spark, shared, number).join(changed.select("file_path"), "file_path", "left_anti").unionByName(changed)
    merged.filter("content_hash is not null").write.mode("overwrite").parquet(f"{shared}/state/full-{number:020d}")


def poll(spark: SparkSession, folder: str, shared: str, revisions: Revisions) -> dict | None:
    """Tell the log which files are new, removed or of another time or size than the state has; no file is opened. A receipt, or None if nothing changed."""
    now = scan.scan(spark, folder).select(F.col("relative_path").alias("file_path"), "modified_at", "size_bytes").filter(E.language("file_path").isNotNull())
    was = file_state(spark, shared).filter("content_hash is not null").select("file_path", F.col("modified_at").alias("m"), F.col("size_bytes").alias("s"))
    changed = now.join(was, "file_path", "full").filter("not (modified_at <=> m and size_bytes <=> s)")
    known = revisions.dirty().select("file_path")  # told before, not yet rebuilt
    return revisions.observe(changed.join(known, "file_path", "left_anti"))


def _read(spark: SparkSession, folder: str, paths: DataFrame) -> DataFrame:
    """The named files that exist, with their content."""
    few = [r.file_path for r in paths.limit(BY_NAME + 1).collect()]
    if len(few) > BY_NAME:
        found = scan.scan(spark, folder)
        return found.join(paths.select(F.col("file_path").alias("relative_path")), "relative_path", "left_semi")
    fs, _ = _fs(spark, folder)
    there = [p for p in (f"{folder}/{f}" for f in few) if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p))]
    if not there:
        return scan.empty(spark)
    # Names are no patterns.
    quoted = ["".join("\\" + c if c in "\\*?[]{}^" else c for c in p) for p in there]
    return scan.below(spark.read.format("binaryFile").load(quoted), folder)


def watch(spark: SparkSession, folder: str, shared: str, rebuild: Callable[[DataFrame, int], None], revisions: Revisions, once: bool = True) -> StreamingQuery:
    """Stream the log's edits; each micro-batch reads the files they name, rebuilds those whose content really changed and publishes the last edit that it has seen.

    rebuild gets (file_path, content_hash, text) and the batch's number; a removed file has neither hash nor text. Stream and state lie under `shared`: after
    a stop the next start goes on where the last one ended, and a batch that didn't end is done again from the same state. A rebuild that fails is
    noted in the log and ends the stream; its edits stay dirty.
    """
    edits = spark.readStream.schema(ENTRY).json(revisions.log).filter("kind = 'edit'")

    def each(batch: DataFrame, number: int) -> None:
        last = batch.agg(F.max("number")).first()[0]
        if last is None:
            return
        paths = cut(revisions.paths_of(batch).filter(E.language("file_path").isNotNull()).select("file_path"))
        read = _read(spark, folder, paths).select(F.col("relative_path").alias("file_path"), "modified_at", "size_bytes", "content_hash", F.decode("content", "UTF-8").alias("text"))
        state = file_state(spark, shared, number).filter("content_hash is not null")
        both = cut(paths.join(read, "file_path", "left").join(state.select("file_path", F.col("content_hash").alias("was")), "file_path", "left"))
        try:
            rebuild(both.filter("not (content_hash <=> was)").select("file_path", "content_hash", "text"), number)
        except Exception as problem:
            revisions.failed(last, str(problem))
            raise
        put_state(spark, shared, number, both.filter("content_hash is not null or was is not null").select("file_path", "modified_at", "size_bytes", "content_hash"))
        revisions.publish(last)

    writer = edits.writeStream.foreachBatch(each).option("checkpointLocation", f"{shared}/stream")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="300 milliseconds")).start()


def windowed_counts(spark: SparkSession, path: str, width: str = "1 hour", lateness: str = "10 minutes", shared: str | None = None) -> DataFrame:
    """Events per window and type: rows of a file, or of all files of a folder, read as a stream to its end.

    Each micro-batch writes the windows it changed; a window's last count holds. Windows that the watermark has passed leave the state, and later events of theirs
    are dropped. With a `shared` folder a later call goes on with what is new; without one, a new folder beside the checkpoints is taken.
    """
    if shared is None:
        cut(spark.range(1))  # sees to the shared folder
        shared = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/windows-{uuid.uuid4().hex}"
    kind = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    files = spark.readStream.schema(kind)
    events = files.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") else files.parquet(path)
    events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    counts = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{shared}/counts/batch={number}")

    counts.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", f"{shared}/stream").trigger(availableNow=True).start().awaitTermination()
    if not names_in(spark, f"{shared}/counts"):
        return spark.createDataFrame([], counts.schema)
    return spark.read.parquet(f"{shared}/counts").groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"))
