"""Runtime overlays: edges that frameworks make and source text only implies. A plugin is any function from frames to edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Calls that hand work to a queue; hooks that subscribe and publish.
QUEUE_CALLS = ["dispatch", "dispatchSync", "dispatch_sync", "dispatchNow", "onQueue", "later", "delay", "apply_async", "perform_later", "perform_async", "enqueue"]
HOOK_SUBSCRIBE, HOOK_PUBLISH = ["add_action", "add_filter"], ["do_action", "apply_filters", "do_action_ref_array", "apply_filters_ref_array"]


def _overlay(edges: DataFrame, relation: str, layer: str, confidence: int, reason: str, tier: str = "Global") -> DataFrame:
    return edges.withColumns({"relation_kind": F.lit(relation), "layer": F.lit(layer), "strength": F.lit("Dynamic"), "origin": F.lit("Plugin"), "resolution_tier": F.lit(tier), "confidence_millis": F.lit(confidence), "reason": F.lit(reason)})


def queue_dispatch(edges: DataFrame, calls: list[str] = QUEUE_CALLS) -> DataFrame:
    """Calls that enqueue work, as dispatches to what they name."""
    return _overlay(edges.filter((F.col("kind") == "Call") & F.col("reference_target_name").isin(calls)), "Dispatch", "Runtime", 700, "plugin:queue-dispatch")


def container(registrations: DataFrame, edges: DataFrame) -> DataFrame:
    """registrations (file_path, line, identity, symbol_id, target_file_path) ⋈ edges that ask the container for the identity."""
    r = registrations.select("identity", F.col("symbol_id").alias("__s"), F.col("target_file_path").alias("__f"))
    hit = edges.join(r, edges.reference_target_name == r.identity)
    hit = hit.withColumns({"target_symbol_id": F.col("__s"), "target_file_path": F.col("__f")}).select(*edges.columns)
    return _overlay(hit, "ContainerResolution", "Framework", 900, "plugin:container", "ImportScoped")


def subscribed(registrations: DataFrame) -> DataFrame:
    """registrations (file_path, line, identity, handler) as subscription edges."""
    return registrations.select(F.col("file_path").alias("source_file_path"), F.col("handler").alias("target_symbol_id"), "identity", "line", F.lit("EventSubscribe").alias("relation_kind"), F.lit("Framework").alias("layer"), F.lit(650).alias("confidence_millis"))


def published(publishers: DataFrame, subscribers: DataFrame, confidence: int = 650) -> DataFrame:
    """Who publishes what, to whom. Each side is distinct before they meet, so repeated calls don't multiply."""
    p = publishers.select(F.col("file_path").alias("source_file_path"), "identity").distinct()
    s = subscribers.select(F.col("file_path").alias("target_file_path"), F.col("handler").alias("target_symbol_id"), "identity").distinct()
    return p.join(s, "identity").withColumns({"relation_kind": F.lit("EventPublish"), "layer": F.lit("Runtime"), "strength": F.lit("Dynamic"), "confidence_millis": F.lit(confidence)})


def hooks(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(subscribers, publishers) of hooks in lines: file_path, line, identity[, handler]."""
    def found(names: list[str], handler: bool):
        p = rf"\b(?:{'|'.join(names)})\s*\(\s*['\"]([A-Za-z0-9_.:/-]+)['\"]" + (r"\s*,\s*(?:\[[^,\]]*,\s*)?['\"]([A-Za-z0-9_:\\]+)['\"]" if handler else "")
        x = lines.filter(F.col("content").rlike(p)).select("file_path", "line", F.regexp_extract("content", p, 1).alias("identity"), *([F.regexp_extract("content", p, 2).alias("handler")] if handler else []))
        return x

    return found(HOOK_SUBSCRIBE, True), found(HOOK_PUBLISH, False)


def signals(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(subscribers, publishers) of signals: `x.connect(handler)`, `@receiver(x)`; `x.send(`."""
    con, snd = r"\b([a-z_][a-z0-9_]*)\.connect\s*\(\s*([A-Za-z_][A-Za-z0-9_.]*)", r"\b([a-z_][a-z0-9_]*)\.(?:send|send_robust)\s*\("
    sub = lines.filter(F.col("content").rlike(con)).select("file_path", "line", F.regexp_extract("content", con, 1).alias("identity"), F.regexp_extract("content", con, 2).alias("handler"))
    return sub, lines.filter(F.col("content").rlike(snd)).select("file_path", "line", F.regexp_extract("content", snd, 1).alias("identity"))
