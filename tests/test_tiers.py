import random

import numpy as np
from codeloom.operators import resolution, tiers


def wanted(refs, symbols, imports, imported):
    """What resolve says, reference by reference."""
    found = {}
    for i, f, t, a in refs:
        declared = {q for g, n, q in imports if (g, n) == (f, t) and f is not None}
        beside = {g for h, g in imported if h == f and f is not None}
        levels = [
            [s for s in symbols if s[2] is not None and (s[2], s[3]) == (f, t)], [s for s in symbols if s[1] in declared],
            [s for s in symbols if not declared and s[2] in beside and s[3] == t], [s for s in symbols if not declared and s[3] == t],
        ]
        for k, level in enumerate(levels):
            for s in level if t is not None else []:
                found.setdefault(i, []).append((k, not (a is None or s[4] is None or (s[5] or 0) <= a <= s[4]), s[0], s[1]))
    out = set()
    for i, all_ in found.items():
        k = min(x[0] for x in all_)
        some = [x for x in all_ if x[0] == k]
        some = [x for x in some if not x[1]] or some
        if k < 3 or len(some) == 1:
            out.add((i, min(x[2:] for x in some)[1], ["SameFile", "ImportScoped", "ImportScoped", "Global"][k]))
    return out


def test_tiers_in_many_cells(spark, monkeypatch):
    monkeypatch.setattr(tiers, "LEAST_ROWS", 20)
    r = random.Random(3)
    files, names = [*"abcdef", None], [f"n{k}" for k in range(14)] + [None]
    symbols = [(r.randrange(60), f"s{r.randrange(70)}", r.choice(files), r.choice(names), r.choice([None, 0, 1, 2]), r.choice([None, 0, 1])) for _ in range(40)]
    refs = [(r.randrange(180), r.choice([*files, "z"]), r.choice(names), r.choice([None, 0, 1, 2, 3])) for _ in range(200)]
    imports = [(r.choice(files), r.choice(names), r.choice([None, "nowhere", *(s[1] for s in symbols)])) for _ in range(25)]
    imported = [(r.choice(files), r.choice(files)) for _ in range(9)]
    made = [
        spark.createDataFrame(refs, "ref_index long, file_path string, target_name string, arity int"),
        spark.createDataFrame(symbols, "symbol_index long, id string, file_path string, name string, parameter_count int, required_parameter_count int"),
        spark.createDataFrame(imports, "file_path string, binding string, qualified string"), spark.createDataFrame(imported, "file_path string, imported_path string"),
    ]
    assert {tuple(x)[:3] for x in resolution.resolve(*made).collect()} == wanted(refs, symbols, imports, imported)
    for k in range(4):
        some = [x.limit(0) if n == k else x for n, x in enumerate(made)]
        assert {tuple(x)[:3] for x in resolution.resolve(*some).collect()} == wanted(*([] if n == k else x for n, x in enumerate((refs, symbols, imports, imported))))


def test_references_are_shuffled_once_however_many_files_they_import(spark):
    """A row for each reference and imported file stays in its task."""
    refs = spark.range(50).selectExpr("id as ref_index", "'a.py' as file_path", "concat('n', id) as target_name", "cast(null as int) as arity")
    symbols = spark.range(50).selectExpr("id as symbol_index", "concat('s', id) as id", "concat('f', id) as file_path", "concat('n', id) as name", "cast(null as int) as parameter_count", "cast(null as int) as required_parameter_count")
    none = spark.createDataFrame([], "file_path string, binding string, qualified string")
    imported = spark.range(40).selectExpr("'a.py' as file_path", "concat('f', id) as imported_path")
    got = resolution.resolve(refs, symbols, none, imported)
    assert {(x.ref_index, x.resolution_tier) for x in got.collect()} == {(k, "ImportScoped" if k < 40 else "Global") for k in range(50)}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("imported_path") == 0  # no join goes by it


def test_rows_made_at_once_are_bounded(monkeypatch):
    monkeypatch.setattr(tiers, "AT_ONCE", 10)
    low = np.array([0, 5, 5, 100, 7])
    pieces = list(tiers._spread(low, low + [4, 4, 0, 25, 1]))
    assert [len(p) for _, p in pieces] == [8, 25, 1]
    assert np.concatenate([p for _, p in pieces]).tolist() == [*range(4), *range(5, 9), *range(100, 125), 7]
    assert tiers.grid(216_000_000, 19_400_000, 7_000_000, 200) == (39, 14) and tiers.grid(0, 0, 0, 8) == (1, 1)
