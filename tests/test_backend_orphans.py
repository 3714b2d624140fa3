"""Backend files that nothing leads to: each channel that lets a file off, and the empty cases."""

from codeloom.operators import deadcode
from codeloom.plans.analyze import analyze

FILES = {
    "app/Services/Consumer.php": "<?php\nclass Consumer { function run() { (new UsedService())->go(); } }",
    "app/Services/UsedService.php": "<?php\nclass UsedService {}",
    "app/Services/DeadService.php": "<?php\nclass DeadService {}",
    "app/Services/StringWired.php": "<?php\nclass StringWired {}",
    "app/Providers/Wiring.php": "<?php\nclass Wiring { function map() { return ['handler' => StringWired::class]; } }",
    "app/Entities/User/User.hooks.php": "<?php\nclass UserHooksUnusual {}",
    "app/Entities/Order/Order.hooks.php": "<?php\nclass OrderHooksUnusual {}",
    "app/Entities/Order/Order.lone.php": "<?php\nclass LoneShape {}",
    "app/Support/helpers_extra.php": "<?php\nfunction nobody() { return 1; }",
    "app/Calc/Orchestrator.php": "<?php\nclass RecomputeOrchestrator { function r($t) {\n $c = 'App\\\\Calc\\\\'.trim($t).'RecalculationService';\n if (!class_exists($c)) { return null; } return app($c); } }",
    "app/Calc/AutomaticInvoiceRecalculationService.php": "<?php\nclass AutomaticInvoiceRecalculationService {}",
    "app/Calc/DirectReporter.php": "<?php\nclass DirectReporter {}",
    "app/Calc/Made.php": "<?php\nclass MadeByCall { function x($t) { return make('A\\\\'.$t.'Reporter'); } }",
    "app/Mod/A/AProvider.php": "<?php\nclass ProviderOfA {}",
    "app/Mod/B/BProvider.php": "<?php\nclass ProviderOfB {}",
    "app/Mod/C/CProvider.php": "<?php\nclass ProviderOfC {}",
    "app/Mod/C/CTwice.php": "<?php\nclass TwiceOfC {}",
    "lib/Legacy.php": "<?php\nclass LegacyThing {}",
    "web/list.js": "load('lib/legacy.php/')",
    "lib/Abc.php": "<?php\nclass Abc {}",
    "lib/Größe.php": "<?php\nclass Größe {}",
    "lib/Größer.php": "<?php\nclass Größer {}  // Größe",
    "database/migrations/M.php": "<?php\nclass MigratedOnce {}",
    "views/x.blade.php": "<?php\nclass BladeOnly {}",
    "tests/DeadServiceTest.php": "<?php\nclass DeadServiceTest { function t() { new DeadService(); new TwiceOfC(); } }",
}
CLASSES = {f: t.split("class ", 1)[1].split()[0] for f, t in FILES.items() if "\nclass " in t}


def tables(spark, files):
    symbols = [(f, "Class", c, None) for f, c in CLASSES.items() if f in files] + [("app/Support/helpers_extra.php", "Function", "nobody", None)]
    edges = [("app/Services/Consumer.php", "app/Services/UsedService.php"), ("tests/DeadServiceTest.php", "app/Services/DeadService.php"), ("lib/Abc.php", "lib/Abc.php")]
    return (
        spark.createDataFrame([*files.items(), *list(files.items())[:3]], "file_path string, text string"),
        spark.createDataFrame(symbols, "file_path string, kind string, name string, parent_symbol_id string"),
        spark.createDataFrame(edges, "source_file_path string, target_file_path string"),
    )


def names(df):
    rows = df.collect()
    assert all((r.category, r.line, r.tier) == ("OrphanModule", 1, "Heuristic") for r in rows)
    return sorted(r["name"] for r in rows)


def test_every_channel(spark):
    t = tables(spark, FILES)
    contracts = spark.createDataFrame([("app/Services/Consumer.php",), ("app/Providers/Wiring.php",)], "file_path string")
    every = ["CTwice", "DeadService", "Größer", "Made", "Orchestrator", "Order"]
    assert names(deadcode.orphan_backend_modules(*t, contracts)) == every
    assert names(deadcode.orphan_backend_modules(*t)) == sorted([*every, "Consumer", "Wiring"])
    # Texts beyond the slice only take findings away, whole identifiers alone.
    beyond = spark.createDataFrame([("xDeadService TwiceOfC()",), (None,), ("new ($x . 'Shape')",)], "text string")
    assert names(deadcode.orphan_backend_modules(*t, contracts, beyond)) == ["DeadService", "Größer", "Made", "Orchestrator"]


def test_empty_tables_and_null_texts(spark):
    t = tables(spark, FILES)
    assert deadcode.orphan_backend_modules(*(x.limit(0) for x in t)).count() == 0
    assert deadcode.orphan_backend_modules(t[0], t[1].limit(0), t[2]).count() == 0
    alone = spark.createDataFrame([("a/X.php", None)], "file_path string, text string")
    assert names(deadcode.orphan_backend_modules(alone, spark.createDataFrame([("a/X.php", "Class", "Lonely", None)], t[1].schema), t[2])) == ["X"]


def test_part_of_the_analysis(spark):
    kept = {f: FILES[f] for f in ("app/Services/DeadService.php", "app/Services/StringWired.php", "app/Providers/Wiring.php")}
    done = analyze(spark.createDataFrame(list(kept.items()), "file_path string, text string"))
    assert {(r.path, r.value) for r in done.findings.filter("category = 'OrphanModule'").collect()} >= {("app/Services/DeadService.php", "DeadService")}
    assert not done.findings.filter("category = 'OrphanModule' and value = 'StringWired'").count()


def test_texts_are_dealt_out_before_they_are_searched(spark):
    sources = spark.createDataFrame([("a/X.php", "class Lonely {}"), ("a/Y.php", "")], "file_path string, text string").coalesce(1)
    symbols = spark.createDataFrame([("a/X.php", "Class", "Lonely", None)], "file_path string, kind string, name string, parent_symbol_id string")
    got = deadcode.orphan_backend_modules(sources, symbols, spark.createDataFrame([], "source_file_path string, target_file_path string"))
    assert [r.path for r in got.collect()] == ["a/X.php"]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    searched, _, read = plan.partition("RepartitionByExpression")
    assert "regexp_extract_all" in searched and read and "regexp_extract_all" not in read.split("Join")[0]
