"""Results: artifact families, generations, graph exports, reports."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write one small file beside its place and rename it there, on any Hadoop file system."""
    fs, at = _fs(spark, path)
    side = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(side, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(at, False)
    if not fs.rename(side, at):
        raise OSError(f"could not publish {path}")


def get_text(spark: SparkSession, path: str) -> str | None:
    fs, at = _fs(spark, path)
    return "\n".join(r[0] for r in spark.read.text(path).collect()) if fs.exists(at) else None


def publish(spark: SparkSession, root: str, members: dict[str, DataFrame], identity: dict | None = None) -> str:
    """Write all members as a new generation, then point CURRENT at it. Readers of the old one aren't disturbed."""
    name = f"generation-{uuid.uuid4().hex}"
    counts = {}
    for member, df in members.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/{member}")
        counts[member] = spark.read.parquet(f"{root}/{name}/{member}").count()
    put_text(spark, f"{root}/{name}/MANIFEST.json", json.dumps({"members": counts, "identity": identity or {}}, sort_keys=True))
    put_text(spark, f"{root}/CURRENT", name)
    return name


def current(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    name = get_text(spark, f"{root}/CURRENT")
    if name is None:
        return {}
    spec = json.loads(get_text(spark, f"{root}/{name}/MANIFEST.json"))
    return {m: spark.read.parquet(f"{root}/{name}/{m}") for m in spec["members"]}


def identity(spark: SparkSession, root: str) -> dict:
    """What the current generation was published under; nothing where there is none."""
    name = get_text(spark, f"{root}/CURRENT")
    return {} if name is None else json.loads(get_text(spark, f"{root}/{name}/MANIFEST.json"))["identity"]


def export_graph(nodes: DataFrame, relations: DataFrame, folder: str) -> None:
    """Nodes and relations as quoted CSV for a graph database. A relation without its nodes fails the export."""
    ids = nodes.select("id")
    loose = relations.select(F.explode(F.array("from", "to")).alias("id")).distinct().join(ids, "id", "left_anti").limit(1).collect()
    if loose:
        raise ValueError(f"relation to unknown node {loose[0][0]!r}")
    nodes.write.mode("overwrite").option("quoteAll", True).csv(f"{folder}/nodes")
    relations.write.mode("overwrite").option("quoteAll", True).csv(f"{folder}/relations")


def register_views(nodes: DataFrame, relations: DataFrame) -> None:
    """code_node and code_relation for spark.sql."""
    nodes.createOrReplaceTempView("code_node")
    relations.createOrReplaceTempView("code_relation")


def write_json(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").json(folder)


def report(title: str, sections: dict[str, DataFrame], rows: int = 20) -> str:
    """Markdown of the first rows of each section."""
    out = [f"# {title}"]
    for name, df in sections.items():
        got = df.limit(rows).collect()
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
        out += ["| " + " | ".join(str(v).replace("|", "\\|") for v in r) + " |" for r in got] or ["", "Nothing."]
    return "\n".join(out) + "\n"


def manifest(files: DataFrame) -> DataFrame:
    return files.select("relative_path", "size_bytes", "content_hash")
