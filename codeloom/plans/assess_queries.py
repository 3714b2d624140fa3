"""Registered queries over findings: assessments, policies, differences, verdicts, plugins; each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import assess as az
from codeloom.operators import plugins as pl
from codeloom.operators import review as rv
from codeloom.operators import scanners as sn
from codeloom.operators import surface as sf
from codeloom.plans import bindings as b
from codeloom.plans.bindings import duck, frame

Q, O = {}, {}
FD_, C_, S_, E_, BE_, NO_, CODE_ = (f"({duck(x)})" for x in (b.FINDINGS, b.CYCLES, b.SYMBOLS, b.EDGES, b.BEFORE, b.NOW, b.CODE))


def add(name, oracle=None):
    def put(f):
        Q[name] = f
        if oracle:
            O[name] = oracle
        return f

    return put


CENTRAL = "SELECT 'm' || CAST(o_custkey % 20 AS STRING) || '/f' || CAST(o_custkey AS STRING) AS path, CAST(max(o_orderkey % 1000) AS BIGINT) AS centrality_millis FROM {orders} GROUP BY 1"
CE_ = f"({duck(CENTRAL)})"
W = "CASE family WHEN 'dead_code' THEN 1 WHEN 'hardwiring' THEN 2 ELSE 3 END"


@add("warning_hotspots", f"""WITH n AS (SELECT path, count(*) AS count, sum({W})::BIGINT AS weight, array_to_string(list_sort(list(DISTINCT family)), ',') AS families, count(DISTINCT family) AS k FROM {FD_} GROUP BY path), x AS (SELECT * FROM n JOIN {CE_} USING (path) WHERE centrality_millis >= 250 AND count >= 3 AND weight >= 4 AND (k >= 2 OR weight >= 6))
SELECT path, count, weight, families, round((centrality_millis * 1000.0 / max(centrality_millis) OVER () + weight * 1000.0 / max(weight) OVER ()) / 2)::INT AS severity_millis FROM x""")
def _(s, d):
    return az.warning_hotspots(frame(s, d, b.FINDINGS), frame(s, d, CENTRAL))


@add("hotspots_top20", f"""WITH n AS (SELECT path, count(*) AS finding_count FROM {FD_} GROUP BY path), e AS (SELECT path, sum(o)::BIGINT AS out_edges, sum(i)::BIGINT AS in_edges FROM (SELECT source_file_path AS path, 1 AS o, 0 AS i FROM {C_} UNION ALL SELECT target_file_path, 0, 1 FROM {C_}) GROUP BY path)
SELECT path, finding_count, coalesce(centrality_millis, 0) AS centrality_millis, coalesce(out_edges, 0) + coalesce(in_edges, 0) AS edges FROM n LEFT JOIN {CE_} USING (path) LEFT JOIN e USING (path) ORDER BY finding_count DESC, centrality_millis DESC, edges DESC, path LIMIT 20""")
def _(s, d):
    from codeloom.operators.edges import inout_edge_counts
    from codeloom.plans.api import hotspots

    return hotspots(frame(s, d, b.FINDINGS), frame(s, d, CENTRAL), inout_edge_counts(frame(s, d, b.CYCLES))).select("path", "finding_count", "centrality_millis", "edges")


LAYERS = {"core": ["m1", "m2", "m3"], "edge": ["m4", "m5", "m6", "m6/f6"], "ui": ["m7", "m8", "m6/f26"]}
ALLOWED = {"edge": ["core"], "ui": ["edge"], "core": []}
LAY = "CASE WHEN split_part({0}, '/', 1) IN ('m1','m2','m3') THEN 'core' WHEN {0} = 'm6/f26' OR {0} LIKE 'm7/%' OR {0} LIKE 'm8/%' THEN 'ui' WHEN split_part({0}, '/', 1) IN ('m4','m5','m6') THEN 'edge' END"


@add("layer_violations", f"""WITH x AS (SELECT *, {LAY.format('source_file_path')} AS source_layer, {LAY.format('target_file_path')} AS target_layer FROM {C_})
SELECT source_file_path, target_file_path, source_layer, target_layer, count(*) AS edge_count, array_to_string((list(line ORDER BY edge_index))[1:5], ',') AS sample_lines, (700 + 10 * least(count(*), 28))::INT AS severity_millis FROM x WHERE source_layer IS NOT NULL AND target_layer IS NOT NULL AND source_layer <> target_layer AND NOT (source_layer = 'edge' AND target_layer = 'core') AND NOT (source_layer = 'ui' AND target_layer = 'edge') GROUP BY ALL""")
def _(s, d):
    return az.layer_violations(frame(s, d, b.CYCLES), LAYERS, ALLOWED)


MEMBERS = "SELECT 'p' || CAST(p_partkey AS STRING) AS id, 'Method' AS kind, CASE WHEN p_partkey % 4 = 1 THEN 'Private' ELSE 'Public' END AS visibility, CASE WHEN p_partkey % 5 = 0 THEN 'getThing' ELSE p_name END AS name, p_brand AS parent_symbol_id, p_brand || '.php' AS file_path FROM {part}"


@add("broad_interfaces", f"""WITH m AS (SELECT * FROM ({duck(MEMBERS)}) WHERE visibility = 'Public'), z AS (SELECT parent_symbol_id AS c, count(*) FILTER (NOT regexp_matches(name, '^(get|set|is|has)[A-Z_]')) AS n, min(file_path) AS f FROM m GROUP BY 1), u AS (SELECT parent_symbol_id AS c, name, source_file_path AS sf FROM {E_} e JOIN m ON m.id = e.target_symbol_id WHERE source_file_path <> target_file_path),
t AS (SELECT c, name, count(*) AS k FROM u GROUP BY c, name QUALIFY row_number() OVER (PARTITION BY c ORDER BY k DESC, name) <= 5)
SELECT c AS class_id, f AS file_path, n AS methods, k AS dependents, (SELECT string_agg(name, ',' ORDER BY t.k DESC, name) FROM t WHERE t.c = z.c) AS top_methods, round((8 * least(n, 80) + 4 * least(k, 100)) * 1000.0 / 1040)::INT AS severity_millis FROM z JOIN (SELECT c, count(DISTINCT sf) AS k FROM u GROUP BY c) USING (c) WHERE n >= 25 AND k >= 10""")
def _(s, d):
    return az.broad_interfaces(frame(s, d, MEMBERS), frame(s, d, b.EDGES))


NAMES = "SELECT 'f' || CAST(p_partkey % 91 AS STRING) AS file_path, CASE p_partkey % 3 WHEN 0 THEN replace(p_name, ' ', '_') WHEN 1 THEN replace(p_name, ' ', '-') ELSE split_part(p_name, ' ', 1) || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) END AS name FROM {part}"


@add("split_identity", f"""WITH x AS (SELECT file_path, name, replace(replace(lower(name), '_', ''), '-', '') AS stem, CASE WHEN contains(name, '_') THEN 's' WHEN contains(name, '-') THEN 'k' ELSE 'c' END AS style FROM ({duck(NAMES)})), pf AS (SELECT stem, file_path, count(DISTINCT style) AS st, count(*) AS n FROM x GROUP BY ALL)
SELECT stem, variants, occurrences, files, least(300 + 60 * least(variants, 5) + 10 * least(occurrences, 40), 1000)::INT AS severity_millis FROM (SELECT stem, count(*) AS files, max(st) AS mixed, sum(n)::BIGINT AS occurrences FROM pf GROUP BY stem) JOIN (SELECT stem, count(DISTINCT name) AS variants FROM x GROUP BY stem) USING (stem) WHERE variants >= 2 AND occurrences >= 5 AND mixed >= 2 AND files >= 2""")
def _(s, d):
    return az.split_identity(frame(s, d, NAMES))


#: Every part forwards to the next one; chains end after some keys of each forty, and one key has two targets.
FORWARDS = """SELECT 'k' || CAST(p_partkey AS STRING) AS source, CASE WHEN p_partkey % 40 IN (2, 9, 10, 19, 39) THEN 'end' ELSE 'k' END || CAST(p_partkey + 1 AS STRING) AS target FROM {part}
 UNION ALL SELECT 'k' || CAST(p_partkey AS STRING) AS source, 'other' || CAST(p_partkey AS STRING) AS target FROM {part} WHERE p_partkey % 40 = 34"""


@add("forwarder_chains", f"""WITH RECURSIVE f AS (SELECT source, min(target) AS target FROM ({duck(FORWARDS)}) GROUP BY source HAVING count(DISTINCT target) = 1), w(s, t, c, n) AS (SELECT source, target, source || ' -> ' || target, 2 FROM f WHERE source NOT IN (SELECT target FROM f) UNION ALL SELECT s, f.target, c || ' -> ' || f.target, n + 1 FROM w JOIN f ON f.source = w.t WHERE n < 9)
SELECT s AS start, n::INT AS length, c AS chain, 650 AS severity_millis FROM w WHERE n > 3 AND n <= 8 AND t NOT IN (SELECT source FROM f)""")
def _(s, d):
    return az.forwarder_chains(frame(s, d, FORWARDS))


COSTS = "SELECT 'c' || CAST(o_custkey AS STRING) || '.py' AS file_path, CAST(o_orderkey AS INT) AS line, CASE o_orderkey % 4 WHEN 0 THEN 'sort' WHEN 1 THEN 'nested_loop' WHEN 2 THEN 'filesystem_read' ELSE 'collection_scan' END AS subtype, o_orderpriority AS token FROM {orders}"
DEPTHS = "SELECT 'c' || CAST(c_custkey AS STRING) || '.py' AS path, CAST(c_custkey % 3 AS INT) AS depth, CASE c_custkey % 2 WHEN 0 THEN 'Call' ELSE 'Import' END AS relation FROM {customer}"


@add("complexity_groups", f"""WITH c AS (SELECT * FROM ({duck(COSTS)})), g AS (SELECT file_path, subtype, count(*) AS count, array_to_string((list(token ORDER BY line, token))[1:4], '|') AS tokens FROM c GROUP BY ALL)
SELECT file_path, subtype, count, tokens, least(1000, CASE subtype WHEN 'nested_loop' THEN 500 WHEN 'filesystem_read' THEN 560 WHEN 'collection_scan' THEN 460 ELSE 520 END + least(30 * (count - 1), 150) + CASE WHEN depth = 0 THEN 60 WHEN depth > 0 THEN 80 ELSE 0 END + CASE WHEN relation = 'Call' THEN 40 ELSE 0 END)::INT AS severity_millis FROM g LEFT JOIN ({duck(DEPTHS)}) ON path = file_path""")
def _(s, d):
    return az.complexity_groups(frame(s, d, COSTS), frame(s, d, DEPTHS))


BODIES = "SELECT 'b' || CAST(o_orderkey AS STRING) AS id, 'k' || CAST(o_custkey AS STRING) AS k1, 'q' || o_orderpriority AS k2, 's' || CAST(o_orderkey % 5 AS STRING) AS s1, 's' || CAST(o_custkey % 4 AS STRING) AS s2 FROM {orders}"


@add("behavior_pairs", f"""WITH x AS (SELECT id, k1, k2, list_sort(list_distinct([s1, s2])) AS sel FROM ({duck(BODIES)})), k AS (SELECT id, sel, unnest([k1, k2]) AS key FROM x), g AS (SELECT key FROM k GROUP BY key HAVING count(*) BETWEEN 2 AND 64), p AS (SELECT DISTINCT a.id AS a, z.id AS b, a.sel AS sa, z.sel AS sb FROM k a JOIN k z ON a.key = z.key AND a.id < z.id WHERE a.key IN (FROM g)),
q AS (SELECT *, round(1000.0 * len(list_intersect(sa, sb)) / len(list_distinct(list_concat(sa, sb))))::INT AS m FROM p)
SELECT a, b, m AS similarity_millis, CASE WHEN m = 1000 THEN 'Identical' WHEN len(list_intersect(sa, sb)) = len(sa) THEN 'Subset' WHEN len(list_intersect(sa, sb)) = len(sb) THEN 'Superset' WHEN m >= 500 THEN 'Similar' ELSE 'Divergent' END AS relation FROM q""")
def _(s, d):
    x = frame(s, d, BODIES)
    return az.behavior_pairs(x.select("id", F.array("k1", "k2").alias("keys"), F.array("s1", "s2").alias("selectors")))


@add("truncated_searches", f"WITH k AS (SELECT id, unnest([k1, k2]) AS key FROM ({duck(BODIES)})) SELECT id, count(*)::INT AS keys_skipped, 0 AS keys_left_out FROM k WHERE key IN (SELECT key FROM k GROUP BY key HAVING count(*) > 64) GROUP BY id")
def _(s, d):
    return az.truncated_searches(frame(s, d, BODIES).select("id", F.array("k1", "k2").alias("keys")))


def rules(s):
    policy = {"accept": [{"id": "p1", "family": "dead_code", "path": "m3/**"}, {"id": "p2", "value": "5-LOW", "below": 200}]}
    exclusions = {"rules": [{"id": "r1", "type": "hardwiring", "path": "m?/f1*"}, {"id": "r2", "path": "m1*/**", "below": 50}]}
    return rv.policy_rules(s, policy, exclusions)


REVIEWED = f"""v AS (SELECT *, CASE WHEN family = 'dead_code' AND regexp_matches(path, '^m3/.*$') THEN 'p1' WHEN value = '5-LOW' AND severity_millis < 200 THEN 'p2' WHEN family = 'hardwiring' AND regexp_matches(path, '^m[^/]/f1[^/]*$') THEN 'r1' WHEN regexp_matches(path, '^m1[^/]*/.*$') AND severity_millis < 50 THEN 'r2' END AS rule_id FROM {FD_}),
w AS (SELECT *, CASE WHEN rule_id IS NULL THEN 'Visible' WHEN rule_id LIKE 'p%' THEN 'AcceptedByPolicy' ELSE 'SuppressedByRule' END AS status FROM v)"""


@add("suppression_overlay", f"WITH {REVIEWED} SELECT fingerprint, status, rule_id FROM w")
def _(s, d):
    return rv.suppressed(frame(s, d, b.FINDINGS), rules(s)).select("fingerprint", "status", "rule_id")


@add("review_summary", f"WITH {REVIEWED} SELECT count(*) AS total, count(*) FILTER (status = 'Visible') AS visible, count(*) FILTER (status = 'AcceptedByPolicy') AS accepted, count(*) FILTER (status = 'SuppressedByRule') AS suppressed FROM w")
def _(s, d):
    return rv.review_summary(rv.suppressed(frame(s, d, b.FINDINGS), rules(s)))


@add("triage_clusters", f"WITH {REVIEWED} SELECT split_part(path, '/', 1) AS zone, family, count(*) AS findings, max(severity_millis) AS worst, sum(severity_millis)::BIGINT AS weight FROM w WHERE status = 'Visible' GROUP BY ALL ORDER BY weight DESC, worst DESC, zone, family LIMIT 10")
def _(s, d):
    return rv.triage(rv.suppressed(frame(s, d, b.FINDINGS), rules(s)))


DELTA = f"""g AS (SELECT fingerprint, count(*) AS n, max(severity_millis) AS s, max(confidence_millis) AS c, min(path) AS p FROM {BE_} GROUP BY 1), h AS (SELECT fingerprint, count(*) AS n, max(severity_millis) AS s, max(confidence_millis) AS c, min(path) AS p FROM {NO_} GROUP BY 1),
dl AS (SELECT coalesce(g.fingerprint, h.fingerprint) AS fingerprint, CASE WHEN g.n IS NULL THEN 'New' WHEN h.n IS NULL THEN 'Resolved' WHEN h.s > g.s OR h.c > g.c + 75 THEN 'Worsened' WHEN h.s < g.s OR h.c < g.c - 75 THEN 'Improved' ELSE 'Unchanged' END AS status, g.n AS before_count, h.n AS now_count, g.s AS before_severity, h.s AS now_severity, coalesce(h.p, g.p) AS path FROM g FULL JOIN h ON g.fingerprint = h.fingerprint)"""


@add("convergence_diff", f"WITH {DELTA} SELECT * FROM dl")
def _(s, d):
    return rv.convergence(frame(s, d, b.BEFORE), frame(s, d, b.NOW))


@add("verify_change", f"WITH {DELTA} SELECT fingerprint, status, CASE WHEN status IN ('New','Worsened') THEN 'regression' ELSE 'fix' END AS kind FROM dl WHERE path IN ('c1/f.py','c7/f.py','c8/f.py','c10/f.py','c11/f.py') AND status <> 'Unchanged'")
def _(s, d):
    from codeloom.plans.api import verify_change

    return verify_change(rv.convergence(frame(s, d, b.BEFORE), frame(s, d, b.NOW)), ["c1/f.py", "c7/f.py", "c8/f.py", "c10/f.py", "c11/f.py"]).select("fingerprint", "status", "kind")


@add("attention_items", f"WITH {DELTA} SELECT fingerprint, now_severity FROM dl WHERE status IN ('New','Worsened') AND now_severity >= 300 ORDER BY now_severity DESC, fingerprint LIMIT 20")
def _(s, d):
    return rv.attention(rv.convergence(frame(s, d, b.BEFORE), frame(s, d, b.NOW)), 300).select("fingerprint", "now_severity")


@add("guard_decision", f"WITH {DELTA}, c AS (SELECT count(*) FILTER (status = 'Worsened') AS w, count(*) FILTER (status = 'New') AS n FROM dl) SELECT CASE WHEN w > 0 THEN 'Block' WHEN n > 0 THEN 'Warn' ELSE 'Allow' END AS verdict, CASE WHEN w > 0 THEN 'security_regression' WHEN n > 0 THEN 'visible_findings_grew' ELSE '' END AS reason FROM c")
def _(s, d):
    delta = rv.convergence(frame(s, d, b.BEFORE), frame(s, d, b.NOW))
    return rv.guard(delta.agg(F.count_if(F.col("status") == "Worsened").alias("security_regressions"), F.count_if(F.col("status") == "New").alias("visible_delta"))).select("verdict", F.coalesce("reason", F.lit("")).alias("reason"))


@add("finding_counts_per_file", f"SELECT path, family, count(*) AS n FROM {FD_} GROUP BY ALL")
def _(s, d):
    return frame(s, d, b.FINDINGS).groupBy("path", "family").agg(F.count(F.lit(1)).alias("n"))


#: Nine users share an identity, so that identities grow with the table.
REG = "SELECT 'a' || CAST(user_id AS STRING) || '.py' AS file_path, CAST(event_id % 100 AS INT) AS line, event_type || CAST(CAST(floor(user_id / 9) AS BIGINT) AS STRING) AS identity, 'h' || CAST(user_id AS STRING) AS handler, CASE WHEN event_id % 3 = 0 THEN 'publish' ELSE 'subscribe' END AS side FROM {events}"


@add("pubsub_edges", f"WITH r AS (SELECT * FROM ({duck(REG)})) SELECT DISTINCT p.file_path AS source_file_path, q.file_path AS target_file_path, q.handler AS target_symbol_id, p.identity, 'EventPublish' AS relation_kind, 650 AS confidence_millis FROM r p JOIN r q ON p.identity = q.identity WHERE p.side = 'publish' AND q.side = 'subscribe'")
def _(s, d):
    r = frame(s, d, REG)
    return pl.published(r.filter("side = 'publish'"), r.filter("side = 'subscribe'")).select("source_file_path", "target_file_path", "target_symbol_id", "identity", "relation_kind", "confidence_millis")


@add("queue_dispatch_edges", f"SELECT edge_index, 'Dispatch' AS relation_kind, 'Runtime' AS layer, 'Dynamic' AS strength, 700 AS confidence_millis FROM {E_} WHERE kind = 'Call' AND reference_target_name = 'red bolt'")
def _(s, d):
    return pl.queue_dispatch(frame(s, d, b.EDGES), ["red bolt"]).select("edge_index", "relation_kind", "layer", "strength", "confidence_millis")


@add("cypher_match", f"SELECT source_file_path AS a, target_file_path AS b, relation_kind AS t FROM {C_} WHERE confidence_millis >= 900 AND relation_kind IN ('Call','Import') ORDER BY a, b, t LIMIT 50")
def _(s, d):
    from codeloom.plans.cypher import run

    e = frame(s, d, b.CYCLES)
    nodes = e.select(F.explode(F.array("source_file_path", "target_file_path")).alias("id")).distinct()
    relations = e.select(F.col("source_file_path").alias("from"), F.col("target_file_path").alias("to"), F.col("relation_kind").alias("type"), F.col("confidence_millis").alias("confidenceMillis"))
    return run(nodes, relations, "MATCH (a:CodeNode)-[r:CodeRelation]->(b:CodeNode) WHERE r.confidenceMillis >= 900 AND r.type IN ['Call', 'Import'] RETURN a.id AS a, b.id AS b, r.type AS t ORDER BY a, b, t LIMIT 50")


@add("cypher_aggregate", f"SELECT relation_kind AS t, count(*) AS n FROM {C_} GROUP BY 1")
def _(s, d):
    from codeloom.plans.cypher import run

    e = frame(s, d, b.CYCLES)
    nodes = e.select(F.explode(F.array("source_file_path", "target_file_path")).alias("id")).distinct()
    return run(nodes, e.select(F.col("source_file_path").alias("from"), F.col("target_file_path").alias("to"), F.col("relation_kind").alias("type")), "MATCH (a)-[r]->(b) RETURN r.type AS t, count(*) AS n")


@add("streaming_event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(s, d):
    from codeloom.streaming.refresh import windowed_counts

    return windowed_counts(s, f"{d}/events.parquet")


@add("overview", f"SELECT (SELECT count(*) FROM ({duck(b.FILES)})) AS files, (SELECT count(*) FROM {S_}) AS symbols, (SELECT count(*) FROM {C_}) AS edges, (SELECT count(*) FROM {C_} WHERE layer = 'Structural') AS structural_edges, (SELECT count(*) FROM {FD_}) AS findings")
def _(s, d):
    return sf.overview(frame(s, d, b.FILES), frame(s, d, b.SYMBOLS), frame(s, d, b.CYCLES), frame(s, d, b.FINDINGS)).select("files", "symbols", "edges", "structural_edges", "findings")


@add("highlights", f"SELECT family, row_number() OVER (PARTITION BY family ORDER BY severity_millis DESC, path, fingerprint)::INT AS rank, fingerprint, path, severity_millis FROM {FD_} QUALIFY rank <= 5")
def _(s, d):
    return sf.highlights(frame(s, d, b.FINDINGS))


SIZED = "SELECT 'm' || CAST(c_custkey % 22 AS STRING) || '/g' || CAST(c_custkey AS STRING) AS path, CASE c_custkey % 3 WHEN 0 THEN 'Python' ELSE 'Rust' END AS language, CAST(c_custkey * 3 AS BIGINT) AS size_bytes FROM {customer}"


@add("zone_summary", f"""WITH f AS (SELECT split_part(path, '/', 1) AS zone, count(*) AS files, sum(size_bytes)::BIGINT AS bytes, array_to_string(list_sort(list(DISTINCT language)), ',') AS languages FROM ({duck(SIZED)}) GROUP BY 1), n AS (SELECT split_part(path, '/', 1) AS zone, count(*) AS findings FROM {FD_} GROUP BY 1), e AS (SELECT split_part(path, '/', 1) AS zone, count(*) AS entries FROM {CE_} GROUP BY 1)
SELECT zone, coalesce(files, 0) AS files, coalesce(bytes, 0)::BIGINT AS bytes, languages, coalesce(findings, 0) AS findings, coalesce(entries, 0) AS entries FROM f FULL JOIN n USING (zone) FULL JOIN e USING (zone)""")
def _(s, d):
    return sf.zones(frame(s, d, SIZED), frame(s, d, b.FINDINGS), frame(s, d, CENTRAL).select("path"))


@add("work_packets", f"""WITH {REVIEWED}, x AS (SELECT path, count(*) AS findings, max(severity_millis) AS worst, array_to_string(list_sort(list(DISTINCT family)), ',') AS families FROM w WHERE status = 'Visible' GROUP BY path)
SELECT path, findings, worst, families, (worst + 40 * least(findings, 10) + least(floor(coalesce(centrality_millis, 0) / 10), 300))::BIGINT AS weight FROM x LEFT JOIN {CE_} USING (path) ORDER BY weight DESC, path LIMIT 8""")
def _(s, d):
    return sf.packets(rv.suppressed(frame(s, d, b.FINDINGS), rules(s)), frame(s, d, CENTRAL)).select("path", "findings", "worst", "families", "weight")


@add("framework_misuse", f"SELECT file_path, line, 'framework_misuse/rust/raw_env_outside_config' AS rule FROM {CODE_} WHERE file_path LIKE '%.rs' AND content LIKE '%env::var(%' AND content NOT LIKE '//%'")
def _(s, d):
    return sf.misuse(frame(s, d, b.CODE))


ACCESS = "SELECT CAST(p_partkey AS BIGINT) AS symbol_index, 'p' || CAST(p_partkey AS STRING) AS id, 'Method' AS kind, p_brand AS parent_symbol_id, CASE p_partkey % 4 WHEN 0 THEN 'set' WHEN 1 THEN 'add' WHEN 2 THEN 'get' ELSE 'has' END || upper(substr(p_name, 1, 1)) || replace(substr(p_name, 2), ' ', '') AS name, CAST(p_partkey % 997 AS INT) AS start_line FROM {part}"


@add("state_flows", f"""WITH u AS (SELECT target_symbol_id AS id, count(*) AS uses FROM {E_} WHERE kind = 'Call' GROUP BY 1), m AS (SELECT parent_symbol_id AS carrier, id, name LIKE 'set%' OR name LIKE 'add%' AS writes, regexp_replace(lower(substr(name, 4)), 's$', '') AS slot, start_line, coalesce(uses, 0) AS uses FROM ({duck(ACCESS)}) LEFT JOIN u USING (id)),
k AS (SELECT *, row_number() OVER (PARTITION BY carrier, slot, writes ORDER BY uses DESC, start_line, id DESC) AS n FROM m)
SELECT a.carrier, a.slot, a.id AS writer, z.id AS reader, least(780, 560 + CASE WHEN a.uses > 0 AND z.uses > 0 THEN 120 ELSE 0 END + CASE WHEN abs(a.start_line - z.start_line) <= 40 THEN 60 ELSE 0 END)::INT AS confidence_millis FROM k a JOIN k z ON a.carrier = z.carrier AND a.slot = z.slot AND a.writes AND NOT z.writes WHERE a.n = 1 AND z.n = 1""")
def _(s, d):
    return sf.state_flows(frame(s, d, ACCESS), frame(s, d, b.EDGES))


@add("class_wiring", f"SELECT id, count(e.edge_index) FILTER (relation_kind = 'Implements') AS implementers, count(e.edge_index) FILTER (relation_kind = 'Call') AS calls FROM {S_} s LEFT JOIN {E_} e ON e.target_symbol_id = s.id WHERE s.kind = 'Class' GROUP BY id")
def _(s, d):
    none = s.createDataFrame([], "symbol_id string")
    return sf.wiring(frame(s, d, b.SYMBOLS), frame(s, d, b.EDGES), none).select("id", "implementers", "calls")


PLACES = "SELECT 'n' || CAST(s_nationkey AS STRING) || '/s' || CAST(l_suppkey AS STRING) || '.py' AS file_path, CAST(l_linenumber AS INT) AS line, CASE WHEN l_returnflag = 'R' THEN NULL ELSE p_name END AS target_name FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {part} ON l_partkey = p_partkey WHERE l_quantity > 45"


@add("edges_at_places", f"WITH p AS (SELECT DISTINCT * FROM ({duck(PLACES)})) SELECT edge_index, kind, line FROM {E_} e WHERE EXISTS (SELECT 1 FROM p WHERE p.file_path = e.source_file_path AND p.line = e.line AND (p.target_name IS NULL OR p.target_name = e.reference_target_name))")
def _(s, d):
    return sn.edges_at(frame(s, d, b.EDGES), frame(s, d, PLACES)).select("edge_index", "kind", "line")


NATIVE = "SELECT 'e' || CAST(event_id AS STRING) AS fingerprint, 'app/e' || CAST(user_id AS STRING) || '.py' AS file_path, CAST(event_id AS INT) AS line, event_type AS category, CASE WHEN user_id % 2 = 0 THEN 'native' ELSE 'taint' END AS scanner FROM {events} WHERE event_type IN ('click', 'view', 'error')"
STRUCTURAL = "SELECT 'e' || CAST(event_id AS STRING) AS fingerprint, 'app/e' || CAST(user_id AS STRING) || '.py' AS file_path, CAST(event_id AS INT) AS line, 'match' AS category, 'structural' AS scanner FROM {events} WHERE event_type NOT IN ('click')"


@add("scanner_merge", f"WITH x AS (SELECT *, 0 AS o FROM ({duck(NATIVE)}) UNION ALL SELECT *, 1 FROM ({duck(STRUCTURAL)})) SELECT fingerprint, arg_min(file_path, o) AS file_path, arg_min(line, o) AS line, arg_min(category, o) AS category, string_agg(scanner, ',' ORDER BY o, scanner) AS scanners FROM x GROUP BY fingerprint")
def _(s, d):
    return sn.merged(frame(s, d, NATIVE), frame(s, d, STRUCTURAL)).withColumn("scanners", F.array_join("scanners", ","))


MATCHES = "SELECT 'm' || CAST(o_custkey AS STRING) || '.py' AS file_path, CAST(o_orderkey AS INT) AS line, CASE o_orderstatus WHEN 'F' THEN 'complexity/' WHEN 'O' THEN 'security/' ELSE 'framework_misuse/' END || 'python/' || o_orderpriority AS rule, o_orderstatus AS token, o_orderpriority AS message, CASE o_orderpriority WHEN '1-URGENT' THEN 'High' WHEN '2-HIGH' THEN 'High' WHEN '3-MEDIUM' THEN 'Medium' ELSE 'Low' END AS severity FROM {orders}"
MA_ = f"({duck(MATCHES)})"


@add("scanner_family_counts", f"SELECT count(*) FILTER (rule LIKE 'complexity/%') AS complexity_matches, count(*) FILTER (rule LIKE 'security/%') AS security_matches, count(*) FILTER (rule LIKE 'framework_misuse/%') AS misuse_matches FROM {MA_}")
def _(s, d):
    return sn.family_counts(frame(s, d, MATCHES))


for name, order, keys in (
    ("security_order_top100", "CASE severity WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 ELSE 2 END, file_path, line, message", sn.security_order),
    ("literal_order_top100", "file_path, line, rule", lambda: sn.literal_order("rule")),
    ("match_order_top100", "file_path, line, rule, token", sn.match_order),
):

    @add(name, f"SELECT file_path, line, rule, row_number() OVER (ORDER BY {order})::INT AS rank FROM {MA_} QUALIFY rank <= 100")
    def _(s, d, keys=keys):
        return sn.told(frame(s, d, MATCHES), keys(), 100).select("file_path", "line", "rule", "rank")


def reach_levels(most):
    """One CTE for each level of the frontier: the best-scored way to each file."""
    out = [f"st AS (SELECT source_file_path AS src, target_file_path AS dst, max(CASE relation_kind WHEN 'Call' THEN 5 ELSE 1 END) AS r FROM {C_} WHERE relation_kind IN ('Import','Call') AND source_file_path <> target_file_path GROUP BY ALL)", "rt AS (SELECT DISTINCT src AS path FROM st WHERE src LIKE 'm4/%')", "l0 AS (SELECT path, 0 AS score, [path] AS way FROM rt)"]
    for k in range(1, most + 1):
        out.append(f"l{k} AS (SELECT dst AS path, score + r - 1 AS score, list_append(way, dst) AS way FROM l{k - 1} JOIN st ON src = path WHERE NOT list_contains(way, dst) QUALIFY row_number() OVER (PARTITION BY dst ORDER BY score + r - 1 DESC, list_append(way, dst)) = 1)")
    out.append("al AS (" + " UNION ALL ".join(f"SELECT *, {k} AS depth FROM l{k}" for k in range(1, most + 1)) + ")")
    return ", ".join(out)


@add("security_reachability", f"WITH {reach_levels(8)} SELECT path, min(depth) OVER (PARTITION BY path)::INT AS depth, score::INT AS score, array_to_string(way, ' > ') AS way FROM al WHERE path NOT IN (FROM rt) QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, al.depth, way) = 1")
def _(s, d):
    e = frame(s, d, b.CYCLES)
    use = e.filter("relation_kind IN ('Import','Call') AND source_file_path != target_file_path")
    roots = use.select(F.col("source_file_path").alias("path")).filter("path LIKE 'm4/%'")
    return sn.security_reach(e, roots, 8).withColumn("way", F.array_join("way", " > "))


@add("assessment_counts", f"SELECT family AS kind, count(*) AS n FROM {FD_} GROUP BY 1")
def _(s, d):
    f = frame(s, d, b.FINDINGS)
    return az.counts_by_kind(*[(k, f.filter(F.col("family") == k)) for k in ("dead_code", "hardwiring", "security")])


@add("explain_finding", f"WITH {REVIEWED}, t AS (SELECT min(fingerprint) AS f FROM w), x AS (SELECT w.* FROM w, t WHERE fingerprint = f) SELECT fingerprint, path, family, severity_millis, status, rule_id, (SELECT count(*) FROM w q WHERE q.path = x.path AND q.fingerprint <> x.fingerprint) AS beside, (SELECT count(*) FROM w q WHERE q.family = x.family AND q.severity_millis > x.severity_millis) AS worse FROM x")
def _(s, d):
    from codeloom.plans.api import explain_finding

    w = rv.suppressed(frame(s, d, b.FINDINGS), rules(s))
    return explain_finding(w, w.agg(F.min("fingerprint")).first()[0] or "")


@add("repository_topology", f"""WITH l AS (SELECT split_part(source_file_path, '/', 1) AS a, split_part(target_file_path, '/', 1) AS z, count(*) AS n FROM {C_} GROUP BY ALL),
f AS (SELECT split_part(path, '/', 1) AS zone, count(DISTINCT path) AS files FROM (SELECT source_file_path AS path FROM {C_} UNION ALL SELECT target_file_path FROM {C_}) GROUP BY 1)
SELECT zone, files, coalesce((SELECT sum(n) FROM l WHERE a = zone AND z = zone), 0)::BIGINT AS inner_relations, coalesce((SELECT sum(n) FROM l WHERE a = zone AND z <> zone), 0)::BIGINT AS outgoing, coalesce((SELECT sum(n) FROM l WHERE z = zone AND a <> zone), 0)::BIGINT AS incoming FROM f""")
def _(s, d):
    from codeloom.plans.api import repository_topology

    return repository_topology(frame(s, d, b.CYCLES))


@add("quality_evaluation", f"WITH {REVIEWED} SELECT family, count(*) AS total, count(*) FILTER (status = 'Visible') AS visible, coalesce(max(severity_millis) FILTER (status = 'Visible'), 0)::INT AS worst, count(DISTINCT path) FILTER (status = 'Visible') AS files, round(1000.0 * count(*) FILTER (status <> 'Visible') / count(*))::INT AS suppressed_millis FROM w GROUP BY family")
def _(s, d):
    from codeloom.plans.api import quality_evaluation

    return quality_evaluation(rv.suppressed(frame(s, d, b.FINDINGS), rules(s)))


#: An assessment for each customer, of ten focuses, with up to three other files.
FOCUSES = ["hand_rolled_parsing", "algorithmic_complexity_hotspot", "sanctioned_path_bypass", "duplicate_mechanism", "abstraction_sprawl", "compatibility_scar", "split_identity_model"]
_NEAR = "'m' || CAST((c_custkey + {k}) % 20 AS STRING) || '/f' || CAST(c_custkey + {k} AS STRING)"
_FOCUS = "CASE c_custkey % 7 " + " ".join(f"WHEN {k} THEN '{f}'" for k, f in enumerate(FOCUSES)) + " END"
ASSESSED = f"SELECT {_FOCUS} AS focus, {_NEAR.format(k=0)} AS path, CAST(c_custkey * 37 % 1000 AS INT) AS severity_millis, CASE WHEN c_custkey % 4 = 0 THEN array({_NEAR.format(k=1)}, {_NEAR.format(k=2)}, {_NEAR.format(k=3)}) ELSE array({_NEAR.format(k=1)}) END AS related FROM {{customer}}"
_HOT = f"SELECT path FROM ({CENTRAL}) AS c WHERE centrality_millis >= 600"
_CYC = f"SELECT path FROM ({CENTRAL}) AS c WHERE path LIKE 'm7/%'"
_AS = duck(ASSESSED).replace("array(", "list_value(")
PACKETS = f"""{REVIEWED}, b AS (SELECT path, count(*) AS n, count(*) FILTER (family = 'security') AS sec, count(*) FILTER (family = 'hardwiring') AS lit, bool_or(family = 'security' AND severity_millis >= 900) AS exposed FROM w WHERE status = 'Visible' GROUP BY path),
ab AS (SELECT b.*, coalesce(centrality_millis, 0) AS central, b.path LIKE 'm7/%' AS cyc, coalesce(centrality_millis, 0) >= 600 AS hot FROM b LEFT JOIN {CE_} USING (path)),
lb AS (SELECT *, concat_ws(',', CASE WHEN central > 0 THEN 'bottleneck:' || central END, CASE WHEN cyc THEN 'strong_cycle' END) AS labels FROM ab),
pk AS (SELECT 'security_hotspot' AS focus, CASE WHEN exposed THEN 3 ELSE 2 END AS pr, path, [path] AS files, CASE WHEN exposed THEN 870 ELSE 760 END AS conf, sec AS n, labels, 7 AS fr, 'security_hotspot:' || path AS id FROM lb WHERE sec > 0
 UNION ALL SELECT 'warning_heavy_hotspot', CASE WHEN sec > 0 OR cyc OR central >= 700 THEN 3 ELSE 2 END, path, [path], CASE WHEN sec > 0 THEN 760 ELSE 640 END, n, labels, 0, 'warning_heavy_hotspot:' || path FROM lb WHERE hot AND NOT (lit >= n - 1 OR (lit > 2 * (n - lit) AND sec = 0))
 UNION ALL SELECT 'dead_code_proof', 3, path, [path], 800, 1, '', 5, 'dead_code_proof:' || fingerprint FROM w WHERE status = 'Visible' AND family = 'dead_code'
 UNION ALL SELECT focus, CASE WHEN focus = 'abstraction_sprawl' THEN 1 WHEN focus = 'algorithmic_complexity_hotspot' AND severity_millis >= 820 OR focus NOT LIKE 'alg%' AND severity_millis >= 700 OR len(related) >= 2 AND focus IN ('hand_rolled_parsing', 'duplicate_mechanism', 'compatibility_scar', 'split_identity_model') THEN 3 ELSE 2 END,
  path, list_sort(list_append(related, path)), severity_millis, 1, '', CASE focus WHEN 'hand_rolled_parsing' THEN 5 WHEN 'algorithmic_complexity_hotspot' THEN 5 WHEN 'sanctioned_path_bypass' THEN 4 WHEN 'duplicate_mechanism' THEN 4 WHEN 'abstraction_sprawl' THEN 3 WHEN 'compatibility_scar' THEN 2 ELSE 1 END, focus || ':' || path FROM ({_AS})),
ch AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY again, -pr, -fr, files, focus, id)::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY focus ORDER BY -pr, -fr, files, focus, id) > 1 AS again FROM pk) QUALIFY rank <= 12),
ft AS (SELECT id, unnest(files) AS path FROM ch), ln AS MATERIALIZED (SELECT DISTINCT source_file_path AS src, target_file_path AS dst FROM {C_} WHERE source_file_path <> target_file_path),
ra AS (SELECT id, path, bool_or(inc) AS inc, bool_or(NOT inc) AS outg FROM (SELECT id, dst AS path, false AS inc FROM ft JOIN ln ON src = path UNION ALL SELECT id, src, true FROM ft JOIN ln ON dst = path) GROUP BY ALL HAVING (id, path) NOT IN (SELECT (id, path) FROM ft))"""


@add("guardian_packets", f"""WITH {PACKETS} SELECT rank, id, CASE pr WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS priority, focus, path AS primary_file, array_to_string(files, ',') AS target_files, conf::INT AS confidence_millis, n AS findings, labels,
 CASE WHEN focus IN ('security_hotspot', 'algorithmic_complexity_hotspot') THEN 2 ELSE 1 END AS obligations, (SELECT count(*) FROM ra WHERE ra.id = ch.id AND inc) AS radius_in, (SELECT count(*) FROM ra WHERE ra.id = ch.id AND outg) AS radius_out,
 CASE WHEN focus IN ('security_hotspot', 'warning_heavy_hotspot', 'dead_code_proof') THEN n ELSE 0 END AS members FROM ch""")
def _(s, d):
    from codeloom.operators import graph as gr
    from codeloom.operators import packets as pk

    w = rv.suppressed(frame(s, d, b.FINDINGS), rules(s))
    made = pk.of_findings(w, frame(s, d, CENTRAL), frame(s, d, _CYC), frame(s, d, _HOT)).unionByName(pk.of_assessments(frame(s, d, ASSESSED)))
    got = gr.cut(pk.chosen(made, 12))
    _, links = gr.file_graph(frame(s, d, b.CYCLES))
    near = pk.radius(got, links).groupBy("id").agg(F.count_if("incoming").alias("radius_in"), F.count_if("outgoing").alias("radius_out"))
    mine = pk.members(got, w).groupBy("id").agg(F.count(F.lit(1)).alias("members"))
    out = got.join(near, "id", "left").join(mine, "id", "left").na.fill(0, ["radius_in", "radius_out", "members"])
    return out.select("rank", "id", "priority", "focus", "primary_file", F.array_join("target_files", ",").alias("target_files"), "confidence_millis", "findings", F.array_join("labels", ",").alias("labels"), F.size("obligations").alias("obligations"), "radius_in", "radius_out", "members")


#: A line for each order, in a file for each customer: parsing by hand, old ways, timers, decoded manifests, environment.
ORDER_LINES = """SELECT CASE o_custkey % 4 WHEN 0 THEN 'lib/m' || CAST(o_custkey % 48 AS STRING) || '/parser' || CAST(o_custkey AS STRING) || '.php' WHEN 1 THEN 'app/schedule/cron' || CAST(o_custkey AS STRING) || '.js'
 WHEN 2 THEN 'app/page/route' || CAST(o_custkey AS STRING) || '.php' ELSE 'app/x/policy' || CAST(o_custkey AS STRING) || '.py' END AS file_path, CAST(o_orderkey AS INT) AS line, o_orderpriority AS priority,
 CASE o_orderkey % 6 WHEN 0 THEN 'x = substr(a)' WHEN 1 THEN 'preg_match(b); explode(c)' WHEN 2 THEN '// Legacy fallback' WHEN 3 THEN 'setTimeout(f)' WHEN 4 THEN 'json.loads(s)' ELSE 'env("k"); strpos(d)' END AS content FROM {orders}"""
AS_ = f"({duck(ORDER_LINES)})"


def assessed(s, d):
    return frame(s, d, ORDER_LINES).select("file_path", "line", "content")


@add("compatibility_scars", f"SELECT file_path, count_if(content LIKE '%Legacy%') AS keyword_hits, count_if(priority = '1-URGENT') AS split_names, least(350 + 80 * count_if(content LIKE '%Legacy%') + 100 * count_if(priority = '1-URGENT'), 1000)::INT AS severity_millis FROM {AS_} GROUP BY file_path HAVING count_if(content LIKE '%Legacy%') >= 2 OR count_if(priority = '1-URGENT') >= 2")
def _(s, d):
    return az.compatibility_scars(frame(s, d, ORDER_LINES).filter("priority = '1-URGENT'").select("file_path"), assessed(s, d))


@add("sanctioned_bypass", f"SELECT file_path, count_if(content LIKE 'env%') AS n, least(520 + 70 * least(count_if(content LIKE 'env%'), 4) + least(max(line % 1000) // 200, 180), 1000)::INT AS severity_millis FROM {AS_} WHERE file_path NOT LIKE 'app/schedule/%' GROUP BY file_path HAVING n > 0 AND count_if(content LIKE 'json%') > 0")
def _(s, d):
    x = assessed(s, d)
    centrality = x.groupBy(F.col("file_path").alias("path")).agg(F.max(F.col("line") % 1000).alias("centrality_millis"))
    return az.sanctioned_bypass(x.filter("content like 'env%'"), x, r"\bjson\.loads\b", "^app/schedule/", centrality)


@add("hand_rolled_parsing", f"""WITH f AS (SELECT file_path, sum(CASE left(content, 3) WHEN 'x =' THEN 1 WHEN 'pre' THEN 2 WHEN 'env' THEN 1 ELSE 0 END)::BIGINT AS score FROM {AS_} WHERE file_path LIKE 'lib/%' GROUP BY file_path HAVING score >= 3)
SELECT regexp_replace(file_path, '/[^/]*$', '') AS directory, count(*) AS files, sum(score)::BIGINT AS score, least(400 + 20 * sum(score), 1000)::INT AS severity_millis FROM f GROUP BY 1 HAVING count(*) >= 2 AND sum(score) >= 8""")
def _(s, d):
    return az.hand_rolled_parsing(assessed(s, d)).select("directory", "files", "score", "severity_millis")


@add("home_made_stacks", " UNION ALL ".join(f"SELECT '{name}' AS stack, min(file_path) AS file_path, count(DISTINCT file_path) AS files, count(*) AS score, least(450 + 40 * least(count(DISTINCT file_path), 8) + 5 * least(count(*), 40), 1000)::INT AS severity_millis FROM {AS_} WHERE file_path LIKE '{path}' AND content LIKE '{sign}' HAVING files >= 2" for name, path, sign in (("scheduler", "app/schedule/%", "setTimeout%"), ("page_resolution", "app/page/%", "preg%"), ("manifest_policy", "app/x/%", "json%"))))
def _(s, d):
    return az.stacks(assessed(s, d))
