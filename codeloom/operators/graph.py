"""File graph metrics and iterative graph operators.

Loops are level-synchronous: each round is a join and a group-by over a frontier, cut by checkpoint(). Where an
algorithm is sequential by nature (components, witnesses, path search), a graph of up to LOCAL_EDGES edges, counted
first, goes to one task; a larger one takes the distributed form.
"""

from __future__ import annotations

import tempfile
import uuid
from collections import deque

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom import model as M
from codeloom.functions import expr as E
from codeloom.operators.edges import dependency_edges, snake

LOCAL_EDGES = 1_000_000
#: Links that a task of betweenness holds as numbers, beside arrays over all nodes.
SHARED_EDGES = 40_000_000
#: Sources that go on together in a task of betweenness, and numbers (source, node) of a kind that they hold at most; links that are added up one after another.
TOGETHER, HELD, PIECE = 64, 4_000_000, 512
#: Rows (source, node) that a block of sources may reach at once in the joins of betweenness.
BLOCK_ROWS = 50_000_000
#: How much a relation says about a way through the code.
RELATION_RANK = {"Call": 5, "Dispatch": 4, "ContainerResolution": 3, "EventPublish": 2, "Import": 1}
ENTRY_RELATIONS = ["Import", "Call", "Dispatch", "ContainerResolution", "EventPublish"]


def cut(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def put_by(df: DataFrame) -> DataFrame:
    """As cut, but written in columns, a fraction of a checkpoint of the same rows; for tables as large as the input."""
    cut(df.limit(0))  # sees to the shared folder
    path = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a task which parses sources gets at most, about.
DEALT_ROWS = 20_000


def dealt(sources: DataFrame, rows: int | None = None) -> DataFrame:
    """Sources dealt out by file for work in Python, a file's rows one after the other: tables of short rows are read by one task, however many files they make."""
    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sources.repartition(n if rows is None else max(n, -(-rows // DEALT_ROWS)), "file_path").sortWithinPartitions("file_path")


def file_graph(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: path, links: src, dst) of dependency edges: distinct, without loops, whose ends are nodes all the same. Edges are read once, whatever is made of both."""
    pairs = cut(dependency_edges(edges).select(F.col("source_file_path").alias("src"), F.col("target_file_path").alias("dst")).distinct())
    nodes = pairs.select(F.explode(F.array("src", "dst")).alias("path")).distinct()
    return nodes, pairs.filter("src != dst")


def module_counts(links: DataFrame) -> DataFrame:
    """Distinct file links between modules."""
    m = links.select(E.first_segment("src").alias("source_module"), E.first_segment("dst").alias("target_module")).filter("source_module != target_module")
    return m.groupBy("source_module", "target_module").agg(F.count(F.lit(1)).alias("dependency_count"))


def coupling(nodes: DataFrame, links: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Afferent and efferent modules, and instability in millis. pairs: module_counts of the links, where a caller has them; links are counted once."""
    pairs = cut(module_counts(links)) if pairs is None else pairs
    modules = nodes.select(E.first_segment("path").alias("module")).distinct()
    a = pairs.groupBy(F.col("target_module").alias("module")).agg(F.count(F.lit(1)).alias("a"))
    e = pairs.groupBy(F.col("source_module").alias("module")).agg(F.count(F.lit(1)).alias("e"))
    out = modules.join(a, "module", "left").join(e, "module", "left").na.fill(0)
    total = F.col("a") + F.col("e")
    return cut(out.select("module", F.col("a").alias("afferent"), F.col("e").alias("efferent"), F.when(total == 0, 0).otherwise(E.millis(F.col("e") / total)).cast("int").alias("instability_millis")))


def hub_smells(coupled: DataFrame) -> DataFrame:
    """Modules with many dependencies either way: at least 2 and 2, and a total in the upper fifth (6 at least)."""
    t = coupled.withColumn("total", F.col("afferent") + F.col("efferent"))
    # The exact value at an index of the sorted totals, from how many modules have each total.
    per = t.groupBy("total").agg(F.count(F.lit(1)).alias("n"))
    below = per.withColumn("upto", F.sum("n").over(Window.orderBy("total").rowsBetween(Window.unboundedPreceding, 0)))
    stat = below.agg(F.max("total").alias("m"), F.max("upto").alias("all")).select("m", F.least(F.floor(F.col("all") * 0.8), F.col("all") - 1).alias("at"))
    stat = below.join(F.broadcast(stat), F.col("upto") > F.col("at")).groupBy("m").agg(F.greatest(F.lit(6), F.min("total")).alias("bar"))
    return t.join(F.broadcast(stat)).filter("afferent >= 2 and efferent >= 2 and total >= bar").select(F.lit("HubLikeDependency").alias("kind"), F.col("module").alias("subject"), E.millis(F.col("total") / F.col("m")).alias("severity_millis"))


def unstable_smells(coupled: DataFrame, pairs: DataFrame) -> DataFrame:
    """Modules others rely on, that rely on a clearly less stable one."""
    a = coupled.select(F.col("module").alias("source_module"), F.col("afferent").alias("aff"), F.col("instability_millis").alias("ai"))
    b = coupled.select(F.col("module").alias("target_module"), F.col("instability_millis").alias("bi"))
    out = pairs.join(a, "source_module").join(b, "target_module").filter("aff >= 2 and bi >= ai + 250")
    return out.select(F.lit("UnstableDependency").alias("kind"), F.col("source_module").alias("subject"), F.col("target_module").alias("related"), (F.col("bi") - F.col("ai")).alias("severity_millis"), F.concat("source_module", F.lit(" -> "), "target_module", F.lit(" ("), "dependency_count", F.lit(" cross-module links)")).alias("preview"))


def neighbour_modules(pairs: DataFrame, top: int = 3) -> DataFrame:
    """Per module the components it shares most links with."""
    both = pairs.select(F.col("source_module").alias("module"), F.col("target_module").alias("other"), F.col("dependency_count").alias("o"), F.lit(0).alias("i")).unionByName(pairs.select(F.col("target_module").alias("module"), F.col("source_module").alias("other"), F.lit(0).alias("o"), F.col("dependency_count").alias("i")))
    n = both.groupBy("module", "other").agg(F.sum("o").alias("out_count"), F.sum("i").alias("in_count"))
    rank = F.row_number().over(Window.partitionBy("module").orderBy(F.desc(F.col("out_count") + F.col("in_count")), "other"))
    return n.withColumn("rank", rank).filter(F.col("rank") <= top)


def density(nodes: DataFrame, links: DataFrame) -> DataFrame:
    n = nodes.agg(F.count(F.lit(1)).alias("node_count"))
    e = links.agg(F.count(F.lit(1)).alias("edge_count"))
    pairs = F.col("node_count") * (F.col("node_count") - 1)
    return n.join(F.broadcast(e)).select("node_count", "edge_count", F.when(F.col("node_count") < 2, 0).otherwise(E.millis(F.col("edge_count") / pairs)).cast("int").alias("density_millis"))


def zero_inbound(nodes: DataFrame, links: DataFrame, truncated: bool = False, complete: bool = True) -> DataFrame:
    """Files nothing depends on, but that depend on something: entries, orphans, or cut off by the slice. Incomplete input coverage proves no orphan."""
    found = links.select(F.col("src").alias("path")).distinct().join(links.select(F.col("dst").alias("path")).distinct(), "path", "left_anti")
    status = F.when(E.is_default_entry("path"), "runtime_entry").otherwise(F.lit("boundary_truncated" if truncated else "orphan"))
    out = found.select("path", status.alias("status"))
    return out if complete else out.filter("status != 'orphan'")


def _scc_local(links: DataFrame) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list[str]] = {}
        back: dict[str, list[str]] = {}
        for a, b in zip(pdf.src, pdf.dst):
            out.setdefault(a, []).append(b)
            back.setdefault(b, []).append(a)
        seen, order = set(), []
        for root in out:
            if root in seen:
                continue
            seen.add(root)
            stack = [(root, iter(out[root]))]
            while stack:
                node, rest = stack[-1]
                new = next((x for x in rest if x not in seen), None)
                if new is None:
                    order.append(node)
                    stack.pop()
                else:
                    seen.add(new)
                    stack.append((new, iter(out.get(new, ()))))
        rows, done = [], set()
        for root in reversed(order):
            if root in done:
                continue
            done.add(root)
            part, todo = [], [root]
            while todo:
                x = todo.pop()
                part.append(x)
                for y in back.get(x, ()):
                    if y not in done:
                        done.add(y)
                        todo.append(y)
            rows += [(x, min(part), len(part)) for x in part if len(part) > 1]
        return pd.DataFrame(rows, columns=["path", "component", "size"])

    return links.groupBy().applyInPandas(run, "path string, component string, size int")


def _numbered(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(names: path, id; links: s, d as ids)."""
    names = cut(nodes.select("path").distinct().withColumn("id", F.monotonically_increasing_id()))
    ids = links.join(names.select(F.col("path").alias("src"), F.col("id").alias("s")), "src").join(names.select(F.col("path").alias("dst"), F.col("id").alias("d")), "dst")
    return names, ids.select("s", "d")


def _hashed(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As _numbered, by hashes of the paths, so that links meet no table of names; where two paths have one hash, numbered all the same."""
    names = cut(nodes.select("path").distinct().withColumn("id", F.xxhash64("path")))
    if not names.groupBy("id").count().filter("count > 1").isEmpty():
        return _numbered(nodes, links)
    return names, links.select(F.xxhash64("src").alias("s"), F.xxhash64("dst").alias("d"))


def _ways_from(links: DataFrame, key: str) -> DataFrame:
    """Links that stay where they are while a loop joins labels to them."""
    n = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return links.repartition(n, key).sortWithinPartitions(key).persist(StorageLevel.MEMORY_AND_DISK)


def _least_both_ways(forth: DataFrame, back: DataFrame, turn: int) -> DataFrame:
    """(id, f, b): the least label that leads to each node, and the least that it leads to. Labels are the ids mixed anew each turn, one to one."""
    label = F.xxhash64("id", F.lit(turn))
    ends = forth.select(F.col("s").alias("id")).distinct().unionByName(back.select(F.col("d").alias("id")).distinct()).distinct()
    state = cut(ends.select("id", label.alias("f"), label.alias("b"), F.lit(True).alias("ff"), F.lit(True).alias("fb")))
    while True:
        to = state.filter("ff").select(F.col("id").alias("s"), "f").join(forth, "s").groupBy(F.col("d").alias("id")).agg(F.min("f").alias("nf"))
        fro = state.filter("fb").select(F.col("id").alias("d"), "b").join(back, "d").groupBy(F.col("s").alias("id")).agg(F.min("b").alias("nb"))
        got = state.join(to, "id", "left").join(fro, "id", "left")
        state = cut(got.select("id", F.least("f", "nf").alias("f"), F.least("b", "nb").alias("b"), F.coalesce(F.col("nf") < F.col("f"), F.lit(False)).alias("ff"), F.coalesce(F.col("nb") < F.col("b"), F.lit(False)).alias("fb")))
        if not state.filter("ff or fb").head(1):
            return state.select("id", "f", "b")


def _scc_rounds(links: DataFrame, local_edges: int = -1) -> DataFrame:
    """Colouring both ways: nodes whose least label comes and goes are its component, and a link whose ends differ in either lies in none.

    Labels are mixed anew each round, so what is left breaks up in a number of rounds that grows with the logarithm of how many components lie
    behind each other. What is left of up to local_edges goes to one task.
    """
    nodes = links.select(F.explode(F.array("src", "dst")).alias("path"))
    names, rest = _hashed(nodes, links)
    out, turn = None, 0
    while True:
        # The first links are put where the loop wants them at once, without a checkpoint between.
        forth = _ways_from(rest, "s")
        if not (left := forth.count()):
            forth.unpersist()
            break
        if left <= local_edges:
            local = _scc_local(forth.select(F.col("s").cast("string").alias("src"), F.col("d").cast("string").alias("dst"))).select(F.col("path").cast("long").alias("id"), F.col("component").cast("long").alias("root"))
            local = cut(local)
            forth.unpersist()
            out = local if out is None else out.unionByName(local)
            break
        back = _ways_from(forth, "d")
        state = _least_both_ways(forth, back, turn)
        found = state.filter("f = b").select("id", F.col("f").alias("root"))
        found = cut(found.groupBy("root").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").join(found, "root").select("id", F.col("least").alias("root")))
        out = found if out is None else out.unionByName(found)
        open_ = state.filter("f != b")
        kept = forth.join(open_.select(F.col("id").alias("s"), F.col("f").alias("f1"), F.col("b").alias("b1")), "s").join(open_.select(F.col("id").alias("d"), "f", "b"), "d").filter("f = f1 and b = b1")
        rest = cut(kept.select("s", "d"))
        forth.unpersist(), back.unpersist()
        turn += 1
    if out is None:
        return links.select(F.col("src").alias("path"), F.col("src").alias("component"), F.lit(0).alias("size")).limit(0)
    named = cut(out.join(names, "id").select("root", "path"))
    sized = named.groupBy("root").agg(F.min("path").alias("component"), F.count(F.lit(1)).cast("int").alias("size")).filter("size > 1")
    return named.join(sized, "root").select("path", "component", "size")


def strong_components(links: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(path, component: its first member, size) of all strongly connected components of two or more."""
    return _scc_local(links) if links.count() <= local_edges else _scc_rounds(links, local_edges)


def cycle_classes(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Per component: class, layers, top relations, edges within.

    A large one whose sure edges (confidence 900 and more) hold no component of 60 % of its files is probably an artifact.
    """
    s, t = members.select(F.col("path").alias("source_file_path"), "component", "size"), members.select(F.col("path").alias("target_file_path"), F.col("component").alias("c2"))
    inner = dependency_edges(edges).filter("source_file_path != target_file_path").join(s, "source_file_path").join(t, "target_file_path").filter("component = c2")
    # Edges are read once: those within components are few, and go three ways.
    inner = cut(inner.select("component", "size", "layer", "relation_kind", "confidence_millis", "source_file_path", "target_file_path"))
    layers = inner.groupBy("component", "size").agg(F.array_sort(F.collect_set(M.rank("layer", M.LAYERS))).alias("l"), F.count(F.lit(1)).alias("edge_count"))
    per = inner.groupBy("component", "relation_kind").agg(F.count(F.lit(1)).alias("n"))
    first = F.row_number().over(Window.partitionBy("component").orderBy(F.desc("n"), M.rank("relation_kind", M.RELATIONS)))
    top = per.withColumn("r", first).filter("r <= 3").groupBy("component").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "relation_kind"))), lambda x: x["relation_kind"]), ",").alias("top_relations"))
    sure = inner.filter("confidence_millis >= 900 and size >= 8").select(F.col("source_file_path").alias("src"), F.col("target_file_path").alias("dst")).distinct()
    core = strong_components(sure).groupBy("path").agg(F.max("size").alias("core"))
    best = members.join(core, "path", "left").groupBy("component").agg(F.max("core").alias("core"))
    out = layers.join(top, "component").join(best, "component")
    artifact = (F.col("size") >= 8) & (F.coalesce("core", F.lit(0)) < 0.6 * F.col("size"))
    one = M.named(F.element_at("l", 1), M.LAYERS)
    return out.select("component", "size", F.when(artifact, "ProbableArtifact").when(F.size("l") > 1, "Mixed").otherwise(one).alias("cycle_class"), F.array_join(F.transform("l", lambda x: M.named(x, M.LAYERS)), ",").alias("layers"), "top_relations", "edge_count")


def cycle_witness(links: DataFrame, members: DataFrame) -> DataFrame:
    """Per component the shortest closed way from its first file over sorted links."""
    s, t = members.select(F.col("path").alias("src"), "component"), members.select(F.col("path").alias("dst"), F.col("component").alias("c2"))
    inner = cut(links.join(s, "src").join(t, "dst").filter("component = c2").select("component", "src", "dst"))
    # Of the ways of one length the least in order is the one that a search in a queue over sorted links finds first; all components go on together.
    front = inner.select("component").distinct().select("component", F.col("component").alias("at"), F.array("component").alias("way"))
    seen, found = front.select("component", "at"), None
    while True:
        got = front.join(inner.withColumnRenamed("src", "at"), ["component", "at"]).groupBy("component", "dst").agg(F.min("way").alias("way"))
        got = cut(got.select("component", F.col("dst").alias("at"), F.concat("way", F.array("dst")).alias("way")))
        closed = got.filter("at = component").select("component", F.col("way").alias("witness"))
        found = closed if found is None else found.unionByName(closed)
        front = got.join(closed.select("component"), "component", "left_anti").join(seen, ["component", "at"], "left_anti")
        if not front.head(1):
            return found
        seen = seen.unionByName(front.select("component", "at"))


def betweenness(nodes: DataFrame, links: DataFrame, local_edges: int = SHARED_EDGES, pivots: int | None = None) -> DataFrame:
    """Directed, unweighted, unnormalised betweenness in millis, ends excluded.

    Exact at every size unless the caller asks for `pivots`: then an estimate from so many sources, those of small hashes, scaled to all, whose standard
    error falls with the root of the pivots (exact where there are no more nodes than that). For up to local_edges links the sources are
    shared out in blocks over tasks, each of which gets all links as numbers, a counted number of them; beyond, and for estimates, level by level in joins, which gives the same.
    """
    links = cut(links)
    count = links.count()
    if pivots is not None or count > local_edges:
        return _betweenness_rounds(nodes, links, pivots)
    # Dense numbers in the order of the paths, so that a node's place in an array is its number and neighbours in number are of one folder.
    every = nodes.unionByName(links.select(F.explode(F.array("src", "dst")).alias("path"))).select("path").distinct()
    names = _dense(cut(every.repartitionByRange("path").sortWithinPartitions("path").withColumn("id", F.monotonically_increasing_id())))
    place = names.select("path", "place")
    ids = links.join(place.toDF("src", "sp"), "src").join(place.toDF("dst", "dp"), "dst").select("sp", "dp")
    n = names.count()
    parts = links.sparkSession.sparkContext.defaultParallelism
    shared = ids.select("sp", "dp", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))

    def run(batches):
        got = [(x.sp.to_numpy(np.int32), x.dp.to_numpy(np.int32), x.part.iloc[0]) for x in batches if len(x)]
        if got:
            total = _shares(np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got]), n, got[0][2], parts)
            some = np.flatnonzero(total)
            yield pd.DataFrame({"place": some.astype(np.int32), "part": total[some]})

    # By number, not by hash: two parts in one task would take twice the time.
    got = shared.repartitionById(parts, "part").mapInPandas(run, "place int, part double")
    return _centrality(nodes, got.join(names, "place").select("path", "part"))


def _dense(names: DataFrame) -> DataFrame:
    """(path, id) with a place from 0 without gaps: counts of partitions are added up, so no task sorts all."""
    part = F.shiftright("id", 33).cast("int")  # how monotonically_increasing_id numbers
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = names.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return cut(names.join(F.broadcast(starts), part == F.col("part")).select("path", "id", (F.col("start") + F.col("id").bitwiseAND((1 << 33) - 1)).cast("int").alias("place")))


def _connected(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """The least node that each is connected with, whichever way the links lead."""
    label = np.arange(n, dtype=np.int32)
    while True:
        a, b = label[src], label[dst]
        some = a != b
        if not some.any():
            return label
        src, dst, a, b = src[some], dst[some], a[some], b[some]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def _shares(src: np.ndarray, dst: np.ndarray, n: int, part: int, parts: int) -> np.ndarray:
    """How much of the shortest ways from every parts-th block of sources to all others leads over each node.

    A block is of sources that are connected, neighbours in number, and its work goes by what they reach, not by the whole graph.
    """
    label = _connected(src, dst, n)
    order = np.argsort(label, kind="stable").astype(np.int32)
    rank = np.empty(n, np.int32)
    rank[order] = np.arange(n, dtype=np.int32)
    src, dst = rank[src], rank[dst]
    out, into = np.argsort(src, kind="stable"), np.argsort(dst, kind="stable")
    forth, back = (src[out], dst[out]), (src[into], dst[into])
    del src, dst, out, into
    first, came = np.searchsorted(forth[0], np.arange(n + 1)), np.searchsorted(back[1], np.arange(n + 1))
    ends = np.append(np.flatnonzero(np.diff(label[order], prepend=-1)), n)
    total, inside, block = np.zeros(n), np.zeros(n, bool), 0
    for low, high in zip(ends[:-1].tolist(), ends[1:].tolist()):
        roots = low + np.flatnonzero(first[low + 1 : high + 1] > first[low:high])
        size = max(1, min(TOGETHER, HELD // (high - low)))
        for at in range(0, len(roots), size):
            block += 1
            if block % parts != part:
                continue
            own = roots[at : at + size]
            reached = _reached(own, first, forth[1], inside)
            # Few of the component's links are taken out and sorted, many are chosen in their order.
            if 4 * (first[reached + 1] - first[reached]).sum() < first[high] - first[low]:
                i = _ranges(first, reached)
                t, h = forth[0][i], forth[1][i]
                by_head = np.argsort(h, kind="stable")
                a, b = (t[by_head], h[by_head]), (t, h)
            else:
                a, b = (tuple(x[lo:hi][inside[links[0][lo:hi]]] for x in links) for links, lo, hi in ((back, came[low], came[high]), (forth, first[low], first[high])))
            inside[reached] = False
            local = np.zeros(reached[-1] - reached[0] + 1, np.int32)
            local[reached - reached[0]] = np.arange(len(reached), dtype=np.int32)
            a, b = (tuple(local[x - reached[0]] for x in links) for links in (a, b))
            total[reached] += _block_shares(local[own - reached[0]], a, b, len(reached))
    return total[rank]


def _ranges(first: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Places of the nodes' links."""
    size = first[nodes + 1] - first[nodes]
    return np.repeat(first[nodes] - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _reached(roots: np.ndarray, first: np.ndarray, dst: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """The nodes that some root leads to, in order; they are marked in inside."""
    found, front = [roots], roots
    inside[roots] = True
    while len(front):
        head = dst[_ranges(first, front)]
        front = np.unique(head[~inside[head]])
        inside[front] = True
        found.append(front)
    return np.sort(np.concatenate(found))


def _sums(x: np.ndarray, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the rows x[at] from each start to the next; long ones in pieces, so that as many steps as the longest piece has do for all."""
    size = np.diff(starts, append=len(at))
    pieces = -(-size // PIECE)
    begin = np.cumsum(pieces) - pieces
    turn = np.arange(pieces.sum()) - np.repeat(begin, pieces)
    low = np.repeat(starts, pieces) + turn * PIECE
    size = np.minimum(np.repeat(size, pieces) - turn * PIECE, PIECE)
    order = np.argsort(-size, kind="stable")
    low, longer = low[order], -size[order]
    out = x[at[low]]
    for k in range(1, -longer[0]):
        n = np.searchsorted(longer, -k)
        out[:n] += x[at[low[:n] + k]]
    back = np.empty_like(out)
    back[order] = out
    return back if len(back) == len(begin) else np.add.reduceat(back, begin, axis=0)


def _block_shares(roots: np.ndarray, by_head: tuple[np.ndarray, np.ndarray], by_tail: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """How much of the shortest ways from the roots to all others leads over each of n nodes: all roots go level by level together, a column each. Links (tails, heads) come in both orders."""
    b = len(roots)
    depth, ways, front, share = np.full((n, b), -1, np.int16 if n < 1 << 15 else np.int32), np.zeros((n, b)), np.zeros((n, b)), np.zeros((n, b))
    depth[roots, np.arange(b)], ways[roots, np.arange(b)], front[roots, np.arange(b)] = 0, 1.0, 1.0
    on, missed, levels = np.zeros(n, bool), np.ones(n, bool), [roots]
    tail, head = by_head
    while len(levels[-1]):
        on[levels[-1]] = True
        i = np.flatnonzero(on[tail] & missed[head])
        on[levels[-1]] = False
        if not len(i):
            break
        starts = np.flatnonzero(np.diff(head[i], prepend=-1))
        rows = head[i][starts]
        got = _sums(front, tail[i], starts)
        d = depth[rows]
        new = d < 0
        new &= got > 0
        some = new.any(axis=1)
        if not some.all():
            rows, got, new, d = rows[some], got[some], new[some], d[some]
        got *= new
        np.copyto(d, len(levels), where=new)
        depth[rows], front[rows], missed[rows] = d, got, (d < 0).any(axis=1)
        ways[rows] += got
        levels.append(rows)
    tail, head = by_tail
    for k in range(len(levels) - 1, 1, -1):
        below, above = levels[k], levels[k - 1]
        flow = share[below]
        flow += 1
        front[below] = np.divide(flow, ways[below], out=np.zeros_like(flow), where=depth[below] == k)
        on[below], missed[:] = True, False
        missed[above] = True
        i = np.flatnonzero(on[head] & missed[tail])
        on[below] = False
        if not len(i):
            continue
        starts = np.flatnonzero(np.diff(tail[i], prepend=-1))
        rows = tail[i][starts]
        got = _sums(front, head[i], starts)
        got *= ways[rows]
        got *= depth[rows] == k - 1
        share[rows] += got
    return share.sum(axis=1)


def _centrality(nodes: DataFrame, part: DataFrame) -> DataFrame:
    total = part.groupBy("path").agg(F.sum("part").alias("score"))
    return nodes.join(total, "path", "left").select("path", F.round(F.coalesce("score", F.lit(0.0)) * 1000).cast("long").alias("centrality_millis"))


def _betweenness_rounds(nodes: DataFrame, links: DataFrame, pivots: int | None) -> DataFrame:
    """Blocks of sources, each of which can reach no more than BLOCK_ROWS (source, node); its checkpoints go before the next block's come, so disk doesn't grow with files times files."""
    sc = links.sparkSession.sparkContext
    nodes, links = cut(nodes), cut(links)
    n = nodes.count()
    pivots = n if pivots is None else pivots
    roots = cut(nodes.orderBy(F.xxhash64("path"), "path").limit(pivots) if n > pivots else nodes)
    blocks = -(-min(n, pivots) * n // BLOCK_ROWS) or 1
    if blocks == 1:
        return _centrality(nodes, _scaled(_share_rounds(roots, links), n, pivots))
    shared, total = sc._jsc.sc().getCheckpointDir().get(), None
    for k in range(blocks):
        own = f"{shared}/block-{k}"
        sc.setCheckpointDir(own)
        try:
            part = _share_rounds(roots.filter(F.pmod(F.xxhash64("path", F.lit(1)), F.lit(blocks)) == k), links)
            total = part if total is None else total.unionByName(part)
            sc._jsc.sc().setCheckpointDir(shared)
            total = cut(total.groupBy("path").agg(F.sum("part").alias("part")))
        finally:
            sc._jsc.sc().setCheckpointDir(shared)
            folder = sc._jvm.org.apache.hadoop.fs.Path(own)
            folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)
    return _centrality(nodes, _scaled(total, n, pivots))


def _scaled(part: DataFrame, n: int, pivots: int) -> DataFrame:
    return part.select("path", (F.col("part") * (max(n, 1) / max(1, min(n, pivots)))).alias("part"))


def _share_rounds(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(path, part) of all roots at once: (s, v, distance, ways) by levels forth, then shares back."""
    reached = cut(roots.select(F.col("path").alias("s"), F.col("path").alias("v"), F.lit(0).alias("d"), F.lit(1.0).alias("ways")))
    front, depth = reached, 0
    while front.head(1):
        depth += 1
        step = front.join(links, front.v == links.src).groupBy("s", F.col("dst").alias("v")).agg(F.sum("ways").alias("ways"))
        front = cut(step.join(reached.select("s", "v"), ["s", "v"], "left_anti").select("s", "v", F.lit(depth).alias("d"), "ways"))
        reached = reached.unionByName(front)
    reached = cut(reached)
    total = share = reached.select("s", "v", F.lit(0.0).alias("delta")).limit(0)
    for d in range(depth - 1, 0, -1):
        here = reached.filter(F.col("d") == d)
        below = reached.filter(F.col("d") == d + 1).select("s", F.col("v").alias("w"), F.col("ways").alias("wn")).join(share.select("s", F.col("v").alias("w"), "delta"), ["s", "w"], "left").na.fill(0.0, ["delta"])
        flow = here.join(links, here.v == links.src).join(below.withColumnRenamed("s", "s2"), (F.col("s") == F.col("s2")) & (F.col("dst") == F.col("w"))).groupBy("s", "v").agg(F.sum(F.col("ways") / F.col("wn") * (1 + F.col("delta"))).alias("delta"))
        share = cut(flow)
        total = total.unionByName(share)
    return total.groupBy(F.col("v").alias("path")).agg(F.sum("delta").alias("part"))


def bottlenecks(centrality: DataFrame, top: int = 20) -> DataFrame:
    """The files most on the way; graphs of fewer than three have none."""
    n = centrality.agg(F.count(F.lit(1)).alias("__n"))
    return centrality.join(F.broadcast(n)).filter("centrality_millis > 0 and __n >= 3").drop("__n").orderBy(F.desc("centrality_millis"), "path").limit(top)


def levels(links: DataFrame, roots: DataFrame, most: int = 8) -> DataFrame:
    """(path, depth) of what roots (path) reach, roots at 0; the frontier is joined, what was seen is anti-joined."""
    seen = front = cut(roots.select("path").distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, most + 1):
        step = front.select(F.col("path").alias("src")).join(links, "src").select(F.col("dst").alias("path")).distinct()
        front = cut(step.join(seen, "path", "left_anti").withColumn("depth", F.lit(depth)))
        if not front.head(1):
            break
        seen = seen.unionByName(front)
    return seen


def entry_reachability(edges: DataFrame, entries: DataFrame, most: int = 8) -> DataFrame:
    """(path, depth, root, relation, via): how entries first get to each file: the least (root, place, relation rank, line, target) of the level before."""
    use = edges.filter(F.col("relation_kind").isin(ENTRY_RELATIONS) & (F.col("strength") != "Inferred") & (F.col("source_file_path") != F.col("target_file_path")))
    rank = F.create_map(*[v for k, n in RELATION_RANK.items() for v in (F.lit(k), F.lit(n))])[F.col("relation_kind")]
    step_edges = cut(use.groupBy(F.col("source_file_path").alias("src"), F.col("target_file_path").alias("dst")).agg(F.min(F.struct((-rank).alias("r"), "line", "relation_kind")).alias("e")))
    seen = front = cut(entries.select("path").distinct().select("path", F.lit(0).alias("depth"), F.col("path").alias("root"), F.lit(None).cast("string").alias("relation"), F.lit(None).cast("string").alias("via")))
    for depth in range(1, most + 1):
        got = front.select(F.col("path").alias("src"), "root").join(step_edges, "src")
        got = got.groupBy(F.col("dst").alias("path")).agg(F.min(F.struct("root", "e", "src")).alias("b"))
        front = cut(got.join(seen, "path", "left_anti").select("path", F.lit(depth).alias("depth"), F.col("b.root").alias("root"), F.col("b.e.relation_kind").alias("relation"), F.col("b.src").alias("via")))
        if not front.head(1):
            break
        seen = seen.unionByName(front)
    return seen


def impact_radius(links: DataFrame, target: str, most: int = 3) -> DataFrame:
    """Files that depend on the target, by the least number of steps."""
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    root = links.sparkSession.createDataFrame([(target,)], "path string")
    return levels(back, root, most).filter("depth > 0")


def impact_modules(radius: DataFrame, top: int = 20) -> DataFrame:
    return radius.groupBy(E.first_segment("path").alias("module")).agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "module").limit(top)


def resolve_target(symbols: DataFrame, files: DataFrame, name: str) -> DataFrame:
    """Candidates for a target: a file, a symbol id or a name; more than one row is an ambiguity that the caller must report."""
    f = files.filter(F.col("path") == name).select(F.lit("file").alias("as"), F.col("path").alias("id"), F.col("path").alias("file_path"))
    s = symbols.filter((F.col("id") == name) | (F.col("name") == name)).select(F.when(F.col("id") == name, "id").otherwise("name").alias("as"), "id", "file_path")
    found = f.unionByName(s)
    best = found.agg(F.min(F.when(F.col("as") == "file", 0).when(F.col("as") == "id", 1).otherwise(2)).alias("b"))
    return found.join(F.broadcast(best)).filter(F.when(F.col("as") == "file", 0).when(F.col("as") == "id", 1).otherwise(2) == F.col("b")).drop("b")


def traces(edges: DataFrame, source: str, target: str, most: int = 6, k: int = 1, branches: int = 12, ways: bool = False) -> DataFrame:
    """Up to k node-simple ways from source to target, shortest first; of each file's links the `branches` best by relation, confidence and layer go on. ways: all ways of `most` links instead."""
    rank = F.coalesce(F.create_map(*[v for r, n in RELATION_RANK.items() for v in (F.lit(r), F.lit(n))])[F.col("relation_kind")], F.lit(0))
    step = edges.filter("source_file_path != target_file_path").groupBy(F.col("source_file_path").alias("src"), F.col("target_file_path").alias("dst")).agg(F.min(F.struct((-rank).alias("r"), (-F.col("confidence_millis")).alias("c"), M.rank("layer", M.LAYERS).alias("l"), "relation_kind")).alias("e"))
    step = cut(step.withColumn("n", F.row_number().over(Window.partitionBy("src").orderBy("e", "dst"))).filter(F.col("n") <= branches))
    front = edges.sparkSession.createDataFrame([([source], [])], "path array<string>, relations array<string>")
    found = front.limit(0)
    for _ in range(most):
        got = front.withColumn("src", F.element_at("path", -1)).join(step, "src").filter(~F.array_contains("path", F.col("dst")))
        got = cut(got.select(F.concat("path", F.array("dst")).alias("path"), F.concat("relations", F.array("e.relation_kind")).alias("relations")))
        found = found.unionByName(got.filter(F.element_at("path", -1) == target))
        front = got.filter(F.element_at("path", -1) != target)
        if not ways and found.count() >= k or not got.head(1):
            break
    if ways:
        return front
    return found.withColumn("hops", F.size("relations")).orderBy("hops", "path").limit(k)


def required_radius(links: DataFrame, anchors: DataFrame, limit: int = 50) -> DataFrame:
    """One step in and out of the anchors (path), without them."""
    out_ = links.join(anchors.select(F.col("path").alias("src")), "src", "left_semi").select(F.col("dst").alias("path"))
    in_ = links.join(anchors.select(F.col("path").alias("dst")), "dst", "left_semi").select(F.col("src").alias("path"))
    return out_.unionByName(in_).distinct().join(anchors, "path", "left_anti").orderBy("path").limit(limit)


def zone_links(edges: DataFrame, top: int = 40) -> DataFrame:
    z = edges.select(E.zone("source_file_path").alias("source_zone"), E.zone("target_file_path").alias("target_zone")).filter("source_zone != target_zone")
    return z.groupBy("source_zone", "target_zone").agg(F.count(F.lit(1)).alias("relations")).orderBy(F.desc("relations"), "source_zone", "target_zone").limit(top)


def bridges(edges: DataFrame, source_zone: str, target_zone: str) -> DataFrame:
    """Links by which one zone leads to another, strongest first."""
    at = edges.filter((E.zone("source_file_path") == source_zone) & (E.zone("target_file_path") == target_zone))
    return at.groupBy("source_file_path", "target_file_path").agg(F.count(F.lit(1)).alias("relations"), F.max("confidence_millis").alias("confidence_millis"), F.array_sort(F.collect_set(snake(F.col("relation_kind")))).alias("kinds")).orderBy(F.desc("relations"), F.desc("confidence_millis"), "source_file_path", "target_file_path")


def best_steps(edges: DataFrame, branches: int = 12) -> DataFrame:
    """(src, dst, relation_kind, confidence_millis): the best edge between two files by relation, confidence and layer, and of each file's the `branches` best."""
    rank = F.coalesce(F.create_map(*[v for r, n in RELATION_RANK.items() for v in (F.lit(r), F.lit(n))])[F.col("relation_kind")], F.lit(0))
    step = edges.filter("source_file_path != target_file_path").groupBy(F.col("source_file_path").alias("src"), F.col("target_file_path").alias("dst")).agg(F.min(F.struct((-rank).alias("r"), (-F.col("confidence_millis")).alias("c"), M.rank("layer", M.LAYERS).alias("l"), "relation_kind")).alias("e"))
    best = step.withColumn("n", F.row_number().over(Window.partitionBy("src").orderBy("e", "dst"))).filter(F.col("n") <= branches)
    return best.select("src", "dst", F.col("e.relation_kind").alias("relation_kind"), (-F.col("e.c")).cast("int").alias("confidence_millis"))


def support_paths(edges: DataFrame, pairs: DataFrame, hops: int = 4, most: int = 2, branches: int = 12) -> DataFrame:
    """pairs (pair, source, target: files) → (pair, rank, path, relations, confidence_millis): up to `most` ways without a file twice, all pairs searched at once.

    The ways of a pair that come to the same file in the same number of steps are as many as `most`, those of the highest least
    confidence, so a round holds no more than pairs × files × most rows, and a common file isn't paired out. A pair that has its ways goes on no further.
    """
    step = cut(best_steps(edges, branches))
    front = pairs.filter("source != target").select("pair", "target", F.col("source").alias("at"), F.array("source").alias("path"), F.array().cast("array<string>").alias("relations"), F.lit(1000).alias("confidence_millis"))
    found, done = [], None
    w = Window.partitionBy("pair", "at").orderBy(F.desc("confidence_millis"), "path")
    for _ in range(hops):
        s = step.select(F.col("src").alias("at"), "dst", "relation_kind", F.col("confidence_millis").alias("c"))
        got = front.join(s, "at").filter(~F.array_contains("path", F.col("dst")))
        got = got.select("pair", "target", F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"), F.concat("relations", F.array("relation_kind")).alias("relations"), F.least("confidence_millis", "c").alias("confidence_millis"))
        got = cut(got.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most).drop("n"))
        found.append(got.filter("at = target"))
        done = found[-1] if done is None else done.unionByName(found[-1])
        full = done.groupBy("pair").count().filter(F.col("count") >= most).select("pair")
        front = got.filter("at != target").join(full, "pair", "left_anti")
        if front.isEmpty():
            break
    rank = F.row_number().over(Window.partitionBy("pair").orderBy(F.size("relations"), F.desc("confidence_millis"), "path"))
    return done.withColumn("rank", rank).filter(F.col("rank") <= most).select("pair", "rank", "path", "relations", "confidence_millis")


def zone_files(edges: DataFrame) -> DataFrame:
    """(zone, path): the file of most edges in each zone."""
    ends = edges.filter("source_file_path != target_file_path").select(F.explode(F.array("source_file_path", "target_file_path")).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    return ends.groupBy(E.zone("path").alias("zone")).agg(F.min(F.struct((-F.col("n")).alias("n"), "path")).alias("b")).select("zone", F.col("b.path").alias("path"))


def zone_support_paths(edges: DataFrame, top: int = 40, hops: int = 4, most: int = 2) -> DataFrame:
    """For each of the `top` zone links, ways between the zones' main files: from the source zone to the target zone, or back where there is none.
    → source_zone, target_zone, reversed, rank, path, relations, confidence_millis."""
    files = cut(zone_files(edges))
    linked = zone_links(edges, top).join(files.select(F.col("zone").alias("source_zone"), F.col("path").alias("a")), "source_zone").join(files.select(F.col("zone").alias("target_zone"), F.col("path").alias("b")), "target_zone")
    both = linked.select("source_zone", "target_zone", F.explode(F.array(F.struct(F.lit(False).alias("reversed"), F.col("a").alias("source"), F.col("b").alias("target")), F.struct(F.lit(True).alias("reversed"), F.col("b").alias("source"), F.col("a").alias("target")))).alias("w"))
    pairs = cut(both.select(F.struct("source_zone", "target_zone", "w.reversed").alias("pair"), "w.source", "w.target"))
    found = cut(support_paths(edges, pairs, hops, most))
    forth = found.filter("not pair.reversed").select("pair.source_zone", "pair.target_zone").distinct()
    flat = found.select("pair.*", "rank", "path", "relations", "confidence_millis")
    return flat.filter("not reversed").unionByName(flat.filter("reversed").join(forth, ["source_zone", "target_zone"], "left_anti").select(*flat.columns))
