"""The best tier of each reference, in cells of files and names.

A reference meets symbols by its file, its imports, the files that these lead to, and its name. Files are dealt into columns and names into lines; a reference goes
to the one cell of its file and name, imports go to all cells of their file, symbols to all of their name. So a cell holds all that its references may mean, and
what lies between, a row for each reference and imported file, is made and used up in one task, some rows at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from codeloom.operators.graph import cut

#: References of a cell where there are many, and where there are few; facts that make another line or column; rows that a cell makes at once.
CELL_ROWS, LEAST_ROWS, CELL_FACTS, AT_ONCE = 400_000, 20_000, 2_000_000, 2_000_000
SYMBOL, DECLARED, IMPORTED = 0, 1, 2
LAST = np.iinfo(np.int64).max


def grid(refs: int, imported: int, symbols: int, partitions: int) -> tuple[int, int]:
    """Columns (of files) and lines (of names): as many cells as references ask for, of the shape that copies the fewest facts."""
    cells = max(-(-refs // CELL_ROWS), min(-(-refs // LEAST_ROWS), partitions), 1)
    lines = max(min(round(math.sqrt(cells * max(symbols, 1) / max(imported, 1))), cells), -(-symbols // CELL_FACTS), 1)
    return max(-(-cells // lines), -(-imported // CELL_FACTS)), lines


#: What a reference is asked for by.
ASKED = ["file_path", "target_name", "arity"]


def best_rows(refs: DataFrame, symbols: DataFrame, imports: DataFrame, imported_files: DataFrame) -> DataFrame:
    """(ref_index, rank: twice the tier, and one where no parameter count fits, symbol_index and id of the first candidate of that rank, n: how many there are): a row for each reference that means anything."""
    return _best(refs, symbols, imports, imported_files, ["ref_index"])


def best_asks(refs: DataFrame, symbols: DataFrame, imports: DataFrame, imported_files: DataFrame) -> DataFrame:
    """The same for each file, name and number of arguments: file_path, target_name, arity, rank, symbol_index, id, n."""
    return _best(refs, symbols, imports, imported_files, ASKED)


def _best(refs: DataFrame, symbols: DataFrame, imports: DataFrame, imported_files: DataFrame, by: list[str]) -> DataFrame:
    spark = refs.sparkSession
    signature = ["total", "required"]
    s = symbols.select(F.col("symbol_index").cast("long").alias("symbol_index"), "id", F.col("file_path").alias("file"), "name", F.col("parameter_count").cast("int").alias("total"), F.col("required_parameter_count").cast("int").alias("required"))
    first = F.min(F.struct("symbol_index", "id")).alias("f")
    named = cut(s.filter("name is not null").groupBy("file", "name", *signature).agg(F.count(F.lit(1)).alias("n"), first).select("file", "name", *signature, "n", "f.*"))
    near = cut(imported_files.filter("file_path is not null and imported_path is not null").select(F.col("file_path").alias("file"), F.col("imported_path").alias("imported")).distinct())
    declared = imports.filter("file_path is not null and binding is not null").select(F.col("file_path").alias("file"), F.col("binding").alias("name"), F.col("qualified").alias("q")).distinct()
    through = declared.join(s.drop("file", "name"), F.col("q") == F.col("id"), "left").groupBy("file", "name", *signature).agg(F.count("id").alias("n"), F.min(F.when(F.col("id").isNotNull(), F.struct("symbol_index", "id"))).alias("f")).select("file", "name", *signature, "n", "f.*")
    r = refs.filter("target_name is not null").withColumn("arity", F.col("arity").cast("int")).select(*dict.fromkeys([*by, *ASKED]))
    columns, lines = grid(r.count(), near.count(), named.count(), int(spark.conf.get("spark.sql.shuffle.partitions")))

    def cell(column, line):
        return (column * lines + line).cast("long").alias("cell")

    def of(x, n):
        return F.pmod(F.xxhash64(x), F.lit(n))

    def facts(df: DataFrame, kind: int, place) -> DataFrame:
        fields = {"file": "string", "name": "string", "imported": "string", "total": "int", "required": "int", "n": "long", "symbol_index": "long", "id": "string"}
        return df.select(place, F.lit(kind).alias("kind"), *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in fields.items()])

    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    known = (
        facts(named.select("*", every(columns, "column")), SYMBOL, cell(F.col("column"), of("name", lines)))
        .unionByName(facts(through, DECLARED, cell(of("file", columns), of("name", lines))))
        .unionByName(facts(near.select("*", every(lines, "line")), IMPORTED, cell(of("file", columns), F.col("line"))))
    )
    schema = StructType([*r.select(*by).schema.fields, StructField("rank", LongType()), StructField("symbol_index", LongType()), StructField("id", StringType()), StructField("n", LongType())])
    asking = r.select(cell(of("file_path", columns), of("target_name", lines)), "*")
    return asking.groupBy("cell").cogroup(known.groupBy("cell")).applyInArrow(lambda left, right: _best_of_cell(left, right, by), schema)


def _codes(*columns: pa.ChunkedArray) -> tuple[list[np.ndarray], int]:
    """The same number for the same string in all columns (-1: null), and how many there are."""
    d = pa.chunked_array([x for c in columns for x in c.chunks], type=pa.string()).combine_chunks().dictionary_encode()
    found = d.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(found, np.cumsum([len(c) for c in columns])[:-1]), max(len(d.dictionary), 1)


def _ints(column: pa.ChunkedArray, null: int) -> np.ndarray:
    return column.fill_null(null).to_numpy().astype(np.int64)


def _spread(low: np.ndarray, high: np.ndarray):
    """Ranges → (owner, place) for every place in them, so many at once."""
    counts = high - low
    ends = np.cumsum(counts)
    at = 0
    while at < len(counts):
        before = ends[at - 1] if at else 0
        to = max(int(np.searchsorted(ends, before + AT_ONCE, "right")), at + 1)
        c = counts[at:to]
        owner = np.repeat(np.arange(at, to), c)
        yield owner, np.arange(len(owner)) + np.repeat(low[at:to] - (ends[at:to] - c - before), c)
        at = to


def _sums(keys: list[np.ndarray], n: np.ndarray, order: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Rows summed up by keys, in the order of these: keys, n, the least order."""
    by = np.lexsort(keys[::-1])
    keys = [k[by] for k in keys]
    starts = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])) if len(by) else np.zeros(0, int)
    if not len(by):
        return keys, n, order
    return [k[starts] for k in keys], np.add.reduceat(n[by], starts), np.minimum.reduceat(order[by], starts)


def _best_of_cell(refs: pa.Table, facts: pa.Table, by: list[str]) -> pa.Table:
    (rf, ff, fi), _ = _codes(refs["file_path"], facts["file"], facts["imported"])
    (rn, fn), names = _codes(refs["target_name"], facts["name"])
    null = np.iinfo(np.int32).min
    kind, n, total, required = facts["kind"].to_numpy(), _ints(facts["n"], 0), _ints(facts["total"], null), _ints(facts["required"], 0)
    row_of = pc.sort_indices(facts, [("symbol_index", "ascending"), ("id", "ascending")], null_placement="at_start").to_numpy().astype(np.int64)
    order = np.empty(len(row_of), np.int64)
    order[row_of] = np.arange(len(row_of))

    # Equal references of a file are asked for once.
    arities, ra = np.unique(_ints(refs["arity"], null), return_inverse=True)
    asked, one, back = np.unique((rf * names + rn) * len(arities) + ra, return_index=True, return_inverse=True)
    arity, pair = arities[asked % len(arities)], asked // len(arities)
    file, name = pair // names, pair % names
    rank, best, count = np.full(len(asked), -1), np.full(len(asked), LAST), np.zeros(len(asked), np.int64)

    def meet(tier: int, who: np.ndarray, low: np.ndarray, high: np.ndarray, table, through: np.ndarray | None = None, keys: np.ndarray | None = None) -> None:
        """Asks `who` meet their ranges of the table's rows, or of the imports `through` which they meet the rows with their keys."""
        total, required, n, order = table
        firsts, sums = np.full((2, len(who)), LAST), np.zeros((2, len(who)), np.int64)
        there = None
        if through is not None:
            bits = max(int(len(keys)).bit_length() + 3, 10)
            there = np.zeros(1 << bits, bool)
            there[keys & ((1 << bits) - 1)] = True
        for owner, place in _spread(low, high):
            if through is not None:
                key = through[place] * names + name[who[owner]]
                some = there[key & (len(there) - 1)]
                key, owner = key[some], owner[some]
                inner = list(_spread(np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")))
                pieces = [(owner[o], p) for o, p in inner]
            else:
                pieces = [(owner, place)]
            for o, p in pieces:
                a = arity[who[o]]
                fit = (a == null) | (total[p] == null) | ((required[p] <= a) & (a <= total[p]))
                for k, x in ((0, fit), (1, slice(None))):
                    np.minimum.at(firsts[k], o[x], order[p[x]])
                    np.add.at(sums[k], o[x], n[p[x]])
        for k in (1, 0):
            hit = sums[k] > 0
            w = who[hit]
            rank[w], best[w], count[w] = tier * 2 + k, firsts[k][hit], sums[k][hit]

    def ranges(keys: np.ndarray, wanted: np.ndarray):
        return np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")

    sym = np.flatnonzero(kind == SYMBOL)
    at = sym[np.argsort(ff[sym] * names + fn[sym], kind="stable")]
    at = at[ff[at] >= 0]
    keys, table = ff[at] * names + fn[at], (total[at], required[at], n[at], order[at])
    who = np.flatnonzero(file >= 0)
    meet(0, who, *ranges(keys, pair[who]), table)
    dec = np.flatnonzero(kind == DECLARED)
    stops = np.isin(pair, ff[dec] * names + fn[dec]) & (file >= 0)
    dec = dec[n[dec] > 0]  # a declared import that leads nowhere only stops here
    d = dec[np.argsort(ff[dec] * names + fn[dec], kind="stable")]
    who = np.flatnonzero((rank < 0) & stops)
    meet(1, who, *ranges(ff[d] * names + fn[d], pair[who]), (total[d], required[d], n[d], order[d]))
    imp = np.flatnonzero(kind == IMPORTED)
    imp = imp[np.argsort(ff[imp], kind="stable")]
    who = np.flatnonzero((rank < 0) & ~stops & (file >= 0))
    meet(2, who, *ranges(ff[imp], file[who]), table, fi[imp], keys)
    (kn, kt, kr), n3, o3 = _sums([fn[sym], total[sym], required[sym]], n[sym], order[sym])
    who = np.flatnonzero((rank < 0) & ~stops)
    meet(3, who, *ranges(kn, name[who]), (kt, kr, n3, o3))

    mine = np.flatnonzero(rank >= 0) if by == ASKED else back[rank[back] >= 0]
    whose = refs.select(by).take(pa.array(one[mine] if by == ASKED else np.flatnonzero(rank[back] >= 0)))
    first = facts.select(["symbol_index", "id"]).take(pa.array(row_of[best[mine]]))
    return pa.table({**{c: whose[c] for c in by}, "rank": pa.array(rank[mine]), "symbol_index": first["symbol_index"], "id": first["id"], "n": pa.array(count[mine])})
