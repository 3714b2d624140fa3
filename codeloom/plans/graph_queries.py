"""Registered queries over edges and file graphs, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import edges as ed
from codeloom.operators import graph as gr
from codeloom.plans import bindings as b
from codeloom.plans.bindings import duck, frame

Q, O = {}, {}
E_, C_, S_, FI_ = (f"({duck(x)})" for x in (b.EDGES, b.CYCLES, b.SYMBOLS, b.FILES))
DEP = "kind IN ('Import','TypeImport','Call','Type','Extends','Implements')"


def add(name, oracle=None):
    def put(f):
        Q[name] = f
        if oracle:
            O[name] = oracle
        return f

    return put


def edges(s, d):
    return frame(s, d, b.EDGES)


def cycles(s, d):
    return frame(s, d, b.CYCLES)


COUNTS = "layer, count(*) AS n, sum(confidence_millis)::BIGINT AS c"


@add("edge_views", f"SELECT 'structural' AS v, {COUNTS} FROM {E_} WHERE layer = 'Structural' GROUP BY layer UNION ALL SELECT 'runtime', {COUNTS} FROM {E_} WHERE layer IN ('Runtime','Framework','PolicyOverlay') GROUP BY layer")
def _(s, d):
    e = edges(s, d)
    per = lambda x, v: x.groupBy("layer").agg(F.count(F.lit(1)).alias("n"), F.sum("confidence_millis").alias("c")).select(F.lit(v).alias("v"), "layer", "n", "c")
    return per(ed.structural_view(e), "structural").unionByName(per(ed.runtime_view(e), "runtime"))


@add("dependency_edges", f"SELECT edge_index, kind FROM {E_} WHERE {DEP}")
def _(s, d):
    return ed.dependency_edges(edges(s, d)).select("edge_index", "kind")


@add("strong_dependency_edges", f"SELECT edge_index, kind, strength FROM {E_} WHERE {DEP} AND kind NOT IN ('Type','TypeImport') AND strength <> 'Inferred'")
def _(s, d):
    return ed.strong_edges(edges(s, d)).select("edge_index", "kind", "strength")


TEST = "(regexp_matches(lower(x), '(^|/)(tests|test|spec|__tests__)/') OR regexp_matches(lower(x), '(^|/)test_[^/]*$') OR regexp_matches(lower(x), '_test\\.(rs|go|py|php)$') OR regexp_matches(lower(x), '[-_]spec\\.php$') OR regexp_matches(lower(x), '[.](test|spec)[.][^/]*$'))"


@add("edge_admission", f"""WITH e AS (SELECT *, origin <> 'Policy' AND NOT {TEST.replace("(x)", "(source_file_path)")} AND {TEST.replace("(x)", "(target_file_path)")} AS doubt FROM {E_})
SELECT edge_index, CASE WHEN doubt THEN 'Inferred' ELSE strength END AS strength, CASE WHEN doubt THEN least(confidence_millis, 500) ELSE confidence_millis END AS confidence_millis, CASE WHEN doubt THEN reason || '{ed.TEST_NOTE}' ELSE reason END AS reason FROM e
WHERE NOT (relation_kind IN ('Extends','Implements','Overrides') AND source_symbol_id IS NOT DISTINCT FROM target_symbol_id)""")
def _(s, d):
    return ed.admitted_edges(edges(s, d)).select("edge_index", "strength", "confidence_millis", "reason")


RECOVERED = "SELECT DISTINCT file_path, true AS required_recovery FROM (" + b.SYMBOLS + ") AS s WHERE symbol_index % 7 = 0"


@add("recovery_downgrade", f"""WITH r AS ({duck(RECOVERED)}), e AS (SELECT *, origin <> 'Policy' AND (source_file_path IN (SELECT file_path FROM r) OR target_file_path IN (SELECT file_path FROM r)) AS hit FROM {E_})
SELECT edge_index, CASE WHEN hit THEN 'Inferred' ELSE strength END AS strength, CASE WHEN hit THEN least(confidence_millis, 500) ELSE confidence_millis END AS confidence_millis, CASE WHEN hit THEN reason || '{ed.RECOVERY_NOTE}' ELSE reason END AS reason FROM e""")
def _(s, d):
    return ed.recovery_downgrade(edges(s, d), frame(s, d, RECOVERED)).select("edge_index", "strength", "confidence_millis", "reason")


SNAKE = "lower(regexp_replace({x}, '([a-z])([A-Z])', '\\1_\\2', 'g'))"
EXPORT = f"""k AS (SELECT id, arg_min(kind, symbol_index) AS kind FROM {S_} GROUP BY id),
x AS (SELECT e.*, CASE WHEN source_symbol_id IS NULL OR a.kind IS NULL OR a.kind = 'Module' THEN 'file:' || source_file_path ELSE source_symbol_id END AS f,
 CASE WHEN c.kind IS NULL OR c.kind = 'Module' THEN 'file:' || target_file_path ELSE target_symbol_id END AS t,
 CASE WHEN relation_kind = 'Call' AND e.kind = 'Call' AND c.kind IN ('Class','Struct') THEN 'INSTANTIATE' WHEN relation_kind = 'Call' AND e.kind = 'Call' AND source_symbol_id IS NULL THEN 'TOP_LEVEL_CALL' ELSE upper({SNAKE.format(x='relation_kind')}) END AS ty
 FROM {E_} e LEFT JOIN k a ON a.id = source_symbol_id LEFT JOIN k c ON c.id = target_symbol_id)"""
RANK_S = "CASE strength WHEN 'Hard' THEN 3 WHEN 'Inferred' THEN 2 WHEN 'Dynamic' THEN 1 ELSE 0 END"
RANK_T = "CASE resolution_tier WHEN 'SameFile' THEN 2 WHEN 'ImportScoped' THEN 1 ELSE 0 END"


@add("dependency_edge_rollup", f"""WITH RECURSIVE {EXPORT},
g AS (SELECT f, t, ty, {SNAKE.format(x='kind')} AS rk, lower(ty) AS rel, {SNAKE.format(x='layer')} AS la, reason, count(*) AS n, min(edge_index) AS ei, min(line) AS line, max(confidence_millis) AS c, max({RANK_S}) AS sr, max({RANK_T}) AS tr, min(origin) AS o1, max(origin) AS o2 FROM x GROUP BY ALL),
h AS (SELECT f, t, ty, rk, rel, la, sum(n)::BIGINT AS n, min(line) AS line, max(c) AS c, max(sr) AS sr, max(tr) AS tr, min(o1) AS o1, max(o2) AS o2, list(reason ORDER BY ei) AS rs FROM g GROUP BY ALL)
SELECT f AS "from", t AS "to", ty AS type, rk AS reference_kind, rel AS relation_kind, la AS layer, CASE sr WHEN 3 THEN 'hard' WHEN 2 THEN 'inferred' WHEN 1 THEN 'dynamic' ELSE 'synthetic' END AS strength, CASE WHEN o1 = o2 THEN lower(o1) ELSE 'mixed' END AS origin,
 CASE tr WHEN 2 THEN 'same_file' WHEN 1 THEN 'import_scoped' ELSE 'global' END AS resolution_tier, c AS confidence_millis, list_reduce(rs, lambda p, q: CASE WHEN contains(p, q) THEN p ELSE p || ' | ' || q END) AS reason, line, n AS occurrence_count FROM h""")
def _(s, d):
    return ed.dependency_rollup(edges(s, d), frame(s, d, b.SYMBOLS))


@add("evidence_edges", f"WITH {EXPORT} SELECT 'evidence:' || edge_index AS evidence_id, f AS \"from\", t AS \"to\", ty AS type, kind AS reference_kind, layer, strength, origin, resolution_tier, confidence_millis, reason, line, occurrence_index FROM x")
def _(s, d):
    return ed.evidence(edges(s, d), frame(s, d, b.SYMBOLS))


@add("graph_nodes", f"""WITH l AS (SELECT path, language FROM {FI_}), n AS (SELECT 'file:' || path AS id, 'FILE' AS kind, path AS file_path, 0 AS o, 0 AS i FROM l UNION ALL SELECT id, upper(kind), file_path, 1, symbol_index FROM {S_} WHERE kind <> 'Module')
SELECT id, kind, n.file_path, language FROM n LEFT JOIN l ON l.path = n.file_path QUALIFY row_number() OVER (PARTITION BY id ORDER BY o, i) = 1""")
def _(s, d):
    return ed.graph_nodes(frame(s, d, b.FILES), frame(s, d, b.SYMBOLS)).select("id", "kind", "file_path", "language")


@add("atlas_edges", f"""SELECT source_file_path, target_file_path, count(*) AS edge_count, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds, CASE max({RANK_T}) WHEN 2 THEN 'SameFile' WHEN 1 THEN 'ImportScoped' ELSE 'Global' END AS strongest_tier, (sum(confidence_millis) // count(*))::INT AS average_confidence FROM {E_} GROUP BY ALL""")
def _(s, d):
    return ed.atlas(edges(s, d))


@add("inout_edge_counts", f"SELECT path, sum(o)::BIGINT AS out_edges, sum(i)::BIGINT AS in_edges FROM (SELECT source_file_path AS path, 1 AS o, 0 AS i FROM {E_} UNION ALL SELECT target_file_path, 0, 1 FROM {E_}) GROUP BY path")
def _(s, d):
    return ed.inout_edge_counts(edges(s, d))


@add("inout_file_counts", f"WITH p AS (SELECT DISTINCT source_file_path AS a, target_file_path AS z FROM {C_}) SELECT path, sum(o)::BIGINT AS out_files, sum(i)::BIGINT AS in_files FROM (SELECT a AS path, 1 AS o, 0 AS i FROM p UNION ALL SELECT z, 0, 1 FROM p) GROUP BY path")
def _(s, d):
    return ed.inout_file_counts(cycles(s, d))


FG = f"l AS (SELECT DISTINCT source_file_path AS src, target_file_path AS dst FROM {C_} WHERE {DEP} AND source_file_path <> target_file_path), nd AS (SELECT src AS path FROM l UNION SELECT dst FROM l), mc AS (SELECT split_part(src, '/', 1) AS a, split_part(dst, '/', 1) AS z, count(*) AS n FROM l WHERE split_part(src, '/', 1) <> split_part(dst, '/', 1) GROUP BY ALL)"
CO = FG + ", co AS (SELECT m, coalesce(aff, 0) AS aff, coalesce(eff, 0) AS eff, CASE WHEN coalesce(aff, 0) + coalesce(eff, 0) = 0 THEN 0 ELSE round(1000.0 * coalesce(eff, 0) / (coalesce(aff, 0) + coalesce(eff, 0))) END::INT AS ins FROM (SELECT DISTINCT split_part(path, '/', 1) AS m FROM nd) LEFT JOIN (SELECT z AS m, count(*) AS aff FROM mc GROUP BY z) USING (m) LEFT JOIN (SELECT a AS m, count(*) AS eff FROM mc GROUP BY a) USING (m))"


@add("file_graph", f"WITH {FG} SELECT src, dst FROM l")
def _(s, d):
    return gr.file_graph(cycles(s, d))[1]


@add("module_coupling", f"WITH {CO} SELECT m AS module, aff AS afferent, eff AS efferent, ins AS instability_millis FROM co")
def _(s, d):
    return gr.coupling(*gr.file_graph(cycles(s, d)))


@add("module_dependency_counts", f"WITH {FG} SELECT a AS source_module, z AS target_module, n AS dependency_count FROM mc")
def _(s, d):
    return gr.module_counts(gr.file_graph(cycles(s, d))[1])


@add("hub_like_smells", f"WITH {CO}, st AS (SELECT list_sort(list(aff + eff)) AS s, max(aff + eff) AS m FROM co) SELECT 'HubLikeDependency' AS kind, co.m AS subject, round(1000.0 * (aff + eff) / st.m)::INT AS severity_millis FROM co, st WHERE aff >= 2 AND eff >= 2 AND aff + eff >= greatest(6, s[least(floor(len(s) * 0.8)::INT, len(s) - 1) + 1])")
def _(s, d):
    return gr.hub_smells(gr.coupling(*gr.file_graph(cycles(s, d))))


#: Links between modules whose numbers make 20 the other way round: the steadiest then rely on the least steady.
TURNED = "CAST(substr(split_part(source_file_path, '/', 1), 2) AS INT) + CAST(substr(split_part(target_file_path, '/', 1), 2) AS INT) = 20"
TURNED_ = f"(SELECT * REPLACE (CASE WHEN {TURNED} THEN target_file_path ELSE source_file_path END AS source_file_path, CASE WHEN {TURNED} THEN source_file_path ELSE target_file_path END AS target_file_path) FROM {C_})"


@add("unstable_dependencies", f"WITH {CO.replace(C_, TURNED_)} SELECT 'UnstableDependency' AS kind, a AS subject, z AS related, y.ins - x.ins AS severity_millis, a || ' -> ' || z || ' (' || n || ' cross-module links)' AS preview FROM mc JOIN co x ON x.m = a JOIN co y ON y.m = z WHERE x.aff >= 2 AND y.ins >= x.ins + 250")
def _(s, d):
    e = cycles(s, d).withColumn("turned", F.expr(TURNED))
    e = e.withColumn("x", F.col("source_file_path")).withColumn("source_file_path", F.when(F.col("turned"), F.col("target_file_path")).otherwise(F.col("x"))).withColumn("target_file_path", F.when(F.col("turned"), F.col("x")).otherwise(F.col("target_file_path")))
    nodes, links = gr.file_graph(e)
    pairs = gr.cut(gr.module_counts(links))
    return gr.unstable_smells(gr.coupling(nodes, links, pairs), pairs)


@add("neighbour_modules", f"WITH {FG}, n AS (SELECT m AS module, x AS other, sum(o)::BIGINT AS out_count, sum(i)::BIGINT AS in_count FROM (SELECT a AS m, z AS x, n AS o, 0 AS i FROM mc UNION ALL SELECT z, a, 0, n FROM mc) GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY module ORDER BY out_count + in_count DESC, other)::INT AS rank FROM n QUALIFY rank <= 3")
def _(s, d):
    return gr.neighbour_modules(gr.module_counts(gr.file_graph(cycles(s, d))[1]))


@add("graph_density", f"WITH {FG}, n AS (SELECT count(*) AS c FROM nd), e AS (SELECT count(*) AS c FROM l) SELECT n.c AS node_count, e.c AS edge_count, CASE WHEN n.c < 2 THEN 0 ELSE round(1000.0 * e.c / (n.c * (n.c - 1))) END::INT AS density_millis FROM n, e")
def _(s, d):
    return gr.density(*gr.file_graph(cycles(s, d)))


@add("orphan_files", f"WITH {FG} SELECT DISTINCT src AS path, 'orphan' AS status FROM l WHERE src NOT IN (SELECT dst FROM l)")
def _(s, d):
    return gr.zero_inbound(*gr.file_graph(cycles(s, d)))


REACH = f"WITH RECURSIVE {FG}, r(a, z) AS (SELECT src, dst FROM l UNION SELECT r.a, l.dst FROM r JOIN l ON l.src = r.z)"


@add("scc_components", REACH + " SELECT x.a AS path, min(least(x.a, x.z)) AS component, count(*)::INT AS size FROM r x JOIN r y ON x.a = y.z AND x.z = y.a GROUP BY x.a HAVING count(*) > 1")
def _(s, d):
    return gr.strong_components(gr.file_graph(cycles(s, d))[1])


@add("scc_components_distributed", O["scc_components"])
def _(s, d):
    return gr.strong_components(gr.file_graph(cycles(s, d))[1], local_edges=-1)


@add("cycle_classes", REACH + f""", m AS (SELECT x.a AS path, min(least(x.a, x.z)) AS c, count(*) AS n FROM r x JOIN r y ON x.a = y.z AND x.z = y.a GROUP BY x.a HAVING count(*) > 1),
i AS (SELECT p.c, p.n, e.* FROM {C_} e JOIN m p ON p.path = source_file_path JOIN m q ON q.path = target_file_path WHERE p.c = q.c AND {DEP} AND source_file_path <> target_file_path),
sl AS (SELECT DISTINCT source_file_path AS src, target_file_path AS dst FROM i WHERE confidence_millis >= 900), sr(a, z) AS (SELECT src, dst FROM sl UNION SELECT sr.a, sl.dst FROM sr JOIN sl ON sl.src = sr.z),
sc AS (SELECT x.a AS path, count(*) AS k FROM sr x JOIN sr y ON x.a = y.z AND x.z = y.a GROUP BY x.a), core AS (SELECT c, max(k) AS k FROM m LEFT JOIN sc USING (path) GROUP BY c),
tr AS (SELECT c, relation_kind, count(*) AS k, CASE relation_kind WHEN 'Import' THEN 0 WHEN 'Call' THEN 1 WHEN 'TypeUse' THEN 6 WHEN 'Extends' THEN 7 ELSE 8 END AS o FROM i GROUP BY c, relation_kind QUALIFY row_number() OVER (PARTITION BY c ORDER BY k DESC, o) <= 3)
SELECT c AS component, n::INT AS size, CASE WHEN n >= 8 AND coalesce((SELECT k FROM core WHERE core.c = g.c), 0) < 0.6 * n THEN 'ProbableArtifact' WHEN lo <> hi THEN 'Mixed' ELSE lo END AS cycle_class, CASE WHEN lo <> hi THEN 'Structural,Runtime' ELSE lo END AS layers, (SELECT string_agg(relation_kind, ',' ORDER BY k DESC, o) FROM tr WHERE tr.c = g.c) AS top_relations, edge_count
FROM (SELECT c, n, min(layer) AS lo, max(layer) AS hi, count(*) AS edge_count FROM i GROUP BY c, n) g""")
def _(s, d):
    e = cycles(s, d)
    return gr.cycle_classes(e, gr.strong_components(gr.file_graph(e)[1]))


@add("cycle_witness")
def _(s, d):
    links = gr.file_graph(cycles(s, d))[1]
    return gr.cycle_witness(links, gr.strong_components(links))


@add("betweenness")
def _(s, d):
    return gr.betweenness(*gr.file_graph(cycles(s, d)))


@add("bottlenecks_top20")
def _(s, d):
    return gr.bottlenecks(gr.betweenness(*gr.file_graph(cycles(s, d))))


@add("impact_radius", f"WITH RECURSIVE {FG}, t AS (SELECT min(dst) AS x FROM l), r(p, k) AS (SELECT x, 0 FROM t UNION SELECT l.src, k + 1 FROM r JOIN l ON l.dst = r.p WHERE k < 3) SELECT p AS path, min(k)::INT AS depth FROM r GROUP BY p HAVING min(k) > 0")
def _(s, d):
    links = gr.file_graph(cycles(s, d))[1]
    return gr.impact_radius(links, links.agg(F.min("dst")).first()[0] or "", 3)


USE = f"u AS (SELECT source_file_path AS src, target_file_path AS dst, min(((CASE relation_kind WHEN 'Call' THEN -5 ELSE -1 END) * 1000000 + line) * 10 + CASE relation_kind WHEN 'Call' THEN 0 ELSE 1 END) AS e FROM {C_} WHERE relation_kind IN ('Import','Call') AND strength <> 'Inferred' AND source_file_path <> target_file_path GROUP BY ALL), roots AS (SELECT DISTINCT src AS p FROM u WHERE src LIKE 'm1/%' OR src LIKE 'm2/%')"


RANKED = "CASE relation_kind WHEN 'Call' THEN 5 WHEN 'Dispatch' THEN 4 WHEN 'ContainerResolution' THEN 3 WHEN 'EventPublish' THEN 2 WHEN 'Import' THEN 1 ELSE 0 END"
STEPS = f"st AS (SELECT source_file_path AS src, target_file_path AS dst, -{RANKED} AS r, line, relation_kind AS rel FROM {C_} WHERE relation_kind IN ('Import','Call') AND strength <> 'Inferred' AND source_file_path <> target_file_path QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY r, line, rel) = 1)"


def entry_levels(most):
    """One CTE for each level: who is reached first, and by what."""
    out = [STEPS, "l0 AS (SELECT DISTINCT src AS path, 0 AS depth, src AS root, NULL::VARCHAR AS relation, NULL::VARCHAR AS via FROM st WHERE src LIKE 'm1/%' OR src LIKE 'm2/%'), s0 AS (FROM l0)"]
    for k in range(1, most + 1):
        out.append(f"l{k} AS (SELECT dst AS path, {k} AS depth, root, rel AS relation, st.src AS via FROM l{k - 1} JOIN st ON st.src = path WHERE dst NOT IN (SELECT path FROM s{k - 1}) QUALIFY row_number() OVER (PARTITION BY dst ORDER BY root, r, line, rel, st.src) = 1), s{k} AS (FROM s{k - 1} UNION ALL FROM l{k})")
    return ", ".join(out)


@add("entry_reachability", f"WITH {entry_levels(8)} SELECT path, depth, root, relation, via FROM s8")
def _(s, d):
    e = cycles(s, d)
    use = e.filter("relation_kind IN ('Import','Call') AND strength != 'Inferred' AND source_file_path != target_file_path")
    roots = use.select(F.col("source_file_path").alias("path")).filter("path LIKE 'm1/%' OR path LIKE 'm2/%'")
    return gr.entry_reachability(e, roots, 8)


TRACED = f"""sq AS (SELECT source_file_path AS src, target_file_path AS dst, relation_kind AS rel, (-{RANKED}) * 1000000 - confidence_millis * 100 + CASE layer WHEN 'Structural' THEN 0 ELSE 1 END AS e FROM {C_} WHERE source_file_path <> target_file_path QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY e, rel) = 1),
sp AS (SELECT * FROM sq QUALIFY row_number() OVER (PARTITION BY src ORDER BY e, rel, dst) <= 12),
t AS (SELECT min(src) AS a FROM sp), w(path, rels, hops) AS (SELECT [a], []::VARCHAR[], 0 FROM t UNION ALL SELECT list_append(path, dst), list_append(rels, rel), hops + 1 FROM w JOIN sp ON sp.src = path[-1] WHERE hops < 4 AND NOT list_contains(path, dst)),
g AS (SELECT max(path[-1]) AS z FROM w WHERE hops = 3)"""


@add("graph_traces", f"WITH RECURSIVE {TRACED} SELECT array_to_string(path, ' > ') AS path, array_to_string(rels, ',') AS relations, hops FROM w, g WHERE path[-1] = z AND NOT list_contains(path[1:len(path)-1], z) ORDER BY hops, path LIMIT 5")
def _(s, d):
    e = cycles(s, d)
    source = e.filter("source_file_path != target_file_path").agg(F.min("source_file_path")).first()[0] or ""
    far = gr.traces(e, source, "", 3, ways=True).agg(F.max(F.element_at("path", -1))).first()[0] or ""
    found = gr.traces(e, source, far, 4, k=5)
    return found.select(F.array_join("path", " > ").alias("path"), F.array_join("relations", ",").alias("relations"), "hops")


@add("shortest_trace", f"WITH RECURSIVE {FG}, t AS (SELECT (SELECT min(src) FROM l) AS a), r(p, k) AS (SELECT a, 0 FROM t UNION SELECT l.dst, k + 1 FROM r JOIN l ON l.src = r.p WHERE k < 8) SELECT p AS path, min(k)::INT AS depth FROM r GROUP BY p")
def _(s, d):
    links = gr.file_graph(cycles(s, d))[1]
    return gr.levels(links, links.agg(F.min("src").alias("path")).filter("path is not null"), 8)


@add("required_radius", f"WITH {FG}, a AS (SELECT path FROM nd WHERE path LIKE 'm3/%') SELECT path FROM (SELECT dst AS path FROM l WHERE src IN (FROM a) UNION SELECT src FROM l WHERE dst IN (FROM a)) WHERE path NOT IN (FROM a) ORDER BY path LIMIT 50")
def _(s, d):
    nodes, links = gr.file_graph(cycles(s, d))
    return gr.required_radius(links, nodes.filter("path LIKE 'm3/%'"))


@add("graph_neighbors", f"""WITH t AS (SELECT min(source_file_path) AS p FROM {C_}), b AS (SELECT CASE WHEN source_file_path = p THEN target_file_path ELSE source_file_path END AS path, CASE WHEN source_file_path = p THEN 'out' ELSE 'in' END AS d, confidence_millis FROM {C_}, t WHERE (source_file_path = p OR target_file_path = p) AND source_file_path <> target_file_path)
SELECT path, count(*) AS edge_count, (sum(confidence_millis) // count(*))::INT AS average_confidence, CASE WHEN min(d) = max(d) THEN min(d) ELSE 'mixed' END AS direction FROM b GROUP BY path""")
def _(s, d):
    e = cycles(s, d)
    return ed.neighbours(e, e.agg(F.min("source_file_path")).first()[0] or "")


@add("relation_histogram", f"WITH t AS (SELECT min(source_file_path) AS p FROM {C_}) SELECT CASE WHEN source_file_path = p THEN target_file_path ELSE source_file_path END AS path, relation_kind, count(*) AS n FROM {C_}, t WHERE (source_file_path = p OR target_file_path = p) AND source_file_path <> target_file_path GROUP BY ALL")
def _(s, d):
    e = cycles(s, d)
    return ed.relation_histogram(e, e.agg(F.min("source_file_path")).first()[0] or "")


@add("topology_zones", f"SELECT split_part(source_file_path, '/', 1) AS source_zone, split_part(target_file_path, '/', 1) AS target_zone, count(*) AS relations FROM {C_} WHERE split_part(source_file_path, '/', 1) <> split_part(target_file_path, '/', 1) GROUP BY ALL ORDER BY relations DESC, source_zone, target_zone LIMIT 40")
def _(s, d):
    return gr.zone_links(cycles(s, d))
