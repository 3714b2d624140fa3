"""Secret scans with corpus-wide ownership frequency, in built-in functions only.

Base spans are leftmost non-overlapping matches of three kinds. Spark returns matches without offsets, so a span's
start is the sum of what split() leaves before it and of the earlier matches.

The method adds bare values: tokens of a live look (long, letters and digits, varied) anywhere in a text. Every
candidate value is hashed and counted by distinct repositories and distinct owners over the whole corpus. A value of
up to MAX_OWNERS owners and MAX_REPOSITORIES repositories is owner-specific and counts as live; one that more have is a
widely copied example, be it by many owners or through many repositories of one.
A bare value is added as a span of kind `owned` where it is live and touches no base span; base spans always stay.

Defined results: null or empty text has no spans, base_sha256 of the empty string and an empty `spans`; repeated rows
each give a row with all their spans; a null owner or repository isn't counted as one, so that a value of null owners
only is owner-specific; a null doc_id is carried through; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import cut

#: The patterns of the base kinds and the least length of what must be long enough (group 2; whole match).
KINDS = [
    ("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 16),
    ("hex", r"[0-9a-f]{32,}", 32),
]
#: Of an assign match, all before the value: name, sign and quotes.
BEFORE_VALUE = r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?"""
#: A bare value: as long, of these characters.
BARE = r"[A-Za-z0-9+/_-]{24,}"
BARE_LEAST, BARE_DISTINCT = 24, 10
#: A value with more owners, or in more repositories, than this is a widely copied example.
MAX_OWNERS, MAX_REPOSITORIES = 1, 4
#: Matches are placed in runs of so many, so that a text of many matches costs no square of them.
RUN = 1024
#: Parts that the rows of one hash are joined in.
SALTS = 8
NO_SPANS = "array<struct<start:int,end:int,value:string>>"
SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, value>>, ends exclusive, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.slice(F.zip_with(F.transform(gaps, F.char_length), found, lambda g, m: F.struct(g.alias("gap"), m.alias("m"))), F.lit(1), F.size(found))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.char_length(x["m"])
        span = F.struct(begin.alias("start"), end.alias("end"), x["m"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    nothing = F.struct(F.lit(0).alias("at"), F.array().cast(NO_SPANS).alias("out"))
    # Places within each run first, then each run moved on by the length of those before it.
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / RUN).cast("int")), lambda k: F.aggregate(F.slice(pairs, k * RUN + 1, RUN), nothing, step))

    def chain(acc: Column, run: Column) -> Column:
        moved = F.struct(acc["at"].alias("by"), run["out"].alias("out"))
        return F.struct((acc["at"] + run["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    none_yet = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<by:int,out:{NO_SPANS}>>").alias("out"))
    chained = F.aggregate(runs, none_yet, chain, lambda acc: acc["out"])
    placed = F.flatten(F.transform(chained, lambda r: F.transform(r["out"], lambda m: F.struct((m["start"] + r["by"]).alias("start"), (m["end"] + r["by"]).alias("end"), m["value"].alias("value")))))
    return F.when(text.rlike(pattern), placed).otherwise(F.array().cast(NO_SPANS))


def base_spans(text: Column) -> Column:
    """All base spans by start, then kind: array<struct<start, kind, end, value>>; value is what is secret of the match."""
    text = F.coalesce(text, F.lit(""))
    return F.array_sort(F.concat(*[_of_kind(text, k) for k in range(len(KINDS))]))


def _of_kind(text: Column, k: int) -> Column:
    kind, pattern, least = KINDS[k]

    def made(m: Column) -> Column:
        value = F.regexp_replace(m["value"], BEFORE_VALUE, "") if kind == "assign" else m["value"]
        return F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end"), value.alias("value"))

    # Of the other kinds a match is a whole run, so the pattern may ask for the least length; an assign pattern that
    # did would shift later matches, so all are taken and the short ones dropped.
    return F.filter(F.transform(matches(text, pattern), made), lambda s: F.char_length(s["value"]) >= least)


def live_look(value: Column) -> Column:
    """Long, with letters and digits, of many different characters."""
    return (F.char_length(value) >= BARE_LEAST) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= BARE_DISTINCT)


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k, *_ in KINDS], F.lit("owned"))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _exploded(rows: DataFrame) -> DataFrame:
    return rows.filter(F.size("__all") > 0).select("__row", "__owner", "__repo", F.explode("__all").alias("s")).withColumn("hash", F.sha2("s.value", 256))


def ownership(each: DataFrame) -> DataFrame:
    """Candidate hashes by distinct owners and repositories. Two levels, so that a common value is counted by many tasks."""
    once = each.groupBy("hash", "__owner", "__repo").agg(F.count(F.lit(1)).alias("n"))
    return once.groupBy("hash").agg(F.count_distinct("__owner").alias("owners"), F.count_distinct("__repo").alias("repositories"), F.sum("n").alias("copies"))


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", owner: str | None = "source", repository: str | None = None, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs → key, keep..., n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, found.

    owner, repository: columns that name who holds a document and where (by default each document is its own).
    n_live, n_example: base spans whose value is live, or a copied example. found: all spans by start and
    kind, with value, owners, repositories, copies and live.
    """
    owner_of = F.col(owner).cast("string") if owner else F.lit(None).cast("string")
    repo_of = F.col(repository or key).cast("string")
    whole = F.coalesce(F.col(text), F.lit(""))
    kept = [F.col(c) for c in dict.fromkeys((key, *keep))]
    base = docs.select(F.struct(*kept).alias("__kept"), owner_of.alias("__owner"), repo_of.alias("__repo"), base_spans(whole).alias("__base"), F.filter(matches(whole, BARE), lambda m: live_look(m["value"])).alias("__bare"))
    free = F.filter("__bare", lambda m: ~F.exists("__base", lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"])))
    bare = F.transform(free, lambda m: F.struct(m["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), m["end"].alias("end"), m["value"].alias("value")))
    # The texts are scanned once; what goes on is the spans.
    rows = cut(base.select("__kept", "__owner", "__repo", F.concat("__base", bare).cast(SPANS).alias("__all"))).withColumn("__row", F.monotonically_increasing_id())
    each = _exploded(rows)
    span = F.struct("s.start", "s.kind", "s.end", "s.value", "owners", "repositories", "copies", ((F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)).alias("live"))
    # A copied example may have a large share of all rows: they meet their hash in SALTS parts.
    known = ownership(each).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = each.withColumn("__salt", F.pmod(F.xxhash64("__row"), F.lit(SALTS)).cast("int"))
    judged = salted.join(known, ["hash", "__salt"]).groupBy("__row").agg(F.array_sort(F.collect_list(span)).alias("found"))
    with_any = rows.filter(F.size("__all") > 0).join(judged, "__row").select("__kept", "found")
    kind_of = judged.schema["found"].dataType.simpleString()
    both = with_any.unionByName(rows.filter(F.size("__all") == 0).select("__kept", F.array().cast(kind_of).alias("found")))
    own, all_ = F.filter("found", lambda s: s["kind"] < len(KINDS)), F.filter("found", lambda s: (s["kind"] < len(KINDS)) | s["live"])

    def of(k: int) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")

    counts = [of(k).alias(f"n_{kind}") for k, (kind, *_) in enumerate(KINDS)]
    live = F.size(F.filter(own, lambda s: s["live"])).cast("long").alias("n_live")
    example = F.size(F.filter(own, lambda s: ~s["live"])).cast("long").alias("n_example")
    return both.select("__kept.*", *counts, F.sha2(listed(own), 256).alias("base_sha256"), listed(all_).alias("spans"), live, example, all_.alias("found"))


def redact(docs: DataFrame, text: str = "text", key: str = "doc_id", owner: str | None = "source", marker: str = "[secret]", **options) -> DataFrame:
    """docs with every found span of the text replaced by a marker (overlapping spans by one); all rows and columns stay, and a column named n_chars follows the text."""
    marked = docs.withColumn("__h", F.xxhash64(text))
    found = scan(marked, text, key, owner, keep=("__h",), **options).filter(F.size("found") > 0)
    # Rows of the same key and text have the same spans.
    found = found.groupBy(F.col(key).alias("__k"), F.col("__h").alias("__g")).agg(F.first("found").alias("__found"))
    joined = marked.join(found, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__h") == F.col("__g")), "left")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        between = F.substring(F.col(text), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        more = F.when(s["start"] >= acc["at"], F.concat(acc["out"], between, F.lit(marker))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), more.alias("out"))

    clean = F.aggregate("__found", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.char_length(F.col(text)))))
    out = joined.withColumn(text, F.when(F.col("__found").isNull(), F.col(text)).otherwise(clean))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__found").isNull(), F.col("n_chars")).otherwise(F.char_length(text)).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def oracle() -> str:
    """The same as SQL for DuckDB over `documents` (owner: source; repository: doc_id), but for the extra column found."""
    quoted = [x.replace("'", "''") for x in (*[p for _, p, _ in KINDS], BARE)]
    scans = " UNION ALL ".join(f"SELECT r, {k} AS kind, regexp_extract_all(t, '{p}') AS m, regexp_split_to_array(t, '{p}') AS g FROM d WHERE regexp_matches(t, '{p}')" for k, p in enumerate(quoted))
    before = BEFORE_VALUE.replace("'", "''")
    least = " ".join(f"WHEN {k} THEN {n}" for k, (*_, n) in enumerate(KINDS))
    names = " ".join(f"WHEN {k} THEN '{n}'" for k, (n, *_) in enumerate(KINDS))
    text = f"string_agg(CASE kind {names} ELSE 'owned' END || ':' || s || ':' || e, ',' ORDER BY s, kind)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
raw AS ({scans}),
each AS (SELECT r, kind, unnest(range(1, 1 + len(m)))::BIGINT AS i, unnest(m) AS v0, length(unnest(g[1:len(m)])) AS gap FROM raw),
placed AS (SELECT r, kind, v0, sum(gap + length(v0)) OVER (PARTITION BY r, kind ORDER BY i) - length(v0) AS s FROM each),
sp AS (SELECT r, kind, s::BIGINT AS s, (s + length(v0))::BIGINT AS e, CASE WHEN kind = 0 THEN regexp_replace(v0, '{before}', '') ELSE v0 END AS v FROM placed),
base AS (SELECT * FROM sp WHERE kind < {len(KINDS)} AND length(v) >= CASE kind {least} END),
bare AS (SELECT * FROM sp WHERE kind = {len(KINDS)} AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND len(list_distinct(string_split(v, ''))) >= {BARE_DISTINCT}
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = sp.r AND b.s < sp.e AND sp.s < b.e)),
cand AS (SELECT * FROM base UNION ALL SELECT * FROM bare),
own AS (SELECT v, count(DISTINCT source) AS owners, count(DISTINCT doc_id) AS repositories FROM cand JOIN d USING (r) GROUP BY v),
judged AS (SELECT cand.*, owners <= {MAX_OWNERS} AND repositories <= {MAX_REPOSITORIES} AS live FROM cand JOIN own USING (v)),
per AS (SELECT r, {", ".join(f"count(*) FILTER (kind = {k}) AS n_{n}" for k, (n, *_) in enumerate(KINDS))},
  {text} FILTER (kind < {len(KINDS)}) AS b, {text} FILTER (kind < {len(KINDS)} OR live) AS a,
  count(*) FILTER (kind < {len(KINDS)} AND live) AS n_live, count(*) FILTER (kind < {len(KINDS)} AND NOT live) AS n_example FROM judged GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{n}, 0) AS n_{n}" for n, *_ in KINDS)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN per USING (r)"""
