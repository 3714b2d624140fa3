import pytest

from codeloom.functions import shapes
from codeloom.operators import rules


def found(spark, *files):
    rows = rules.structural_findings(spark.createDataFrame(list(files), "file_path string, text string")).collect()
    return sorted((r.file_path, r.rule_id.split("/", 1)[1], r.line, r.token) for r in rows)


def test_patterns_become_shapes():
    assert rules.compiled("$TARGET.sort()") == ("sort", r"^.+\.sort\(0\)$")
    assert rules.compiled("process.env.$NAME")[0] == "env.*"
    assert rules.compiled("$TARGET.innerHTML = $VALUE")[0] == "innerHTML="
    assert rules.compiled("$MODEL.exists?($$$ARGS)")[0] == "exists?"
    assert len({r[:1] + r[7:] for r in rules.rule_rows() if r[1] is None}) == len([r for r in rules.rule_rows() if r[1] is None])


@pytest.mark.parametrize(
    "path, text, want",
    [
        ("src/order.js", "function reorder(groups){for(const group of groups){group.sort();}}\n", [("javascript/sort_in_loop", 1, "group.sort()")]),
        ("src/loader.ts", 'import fs from "fs";\nexport function all(paths: string[]) {\n  for (const path of paths) {\n    out.push(fs.readFileSync(path, "utf8"));\n  }\n}\n', [("javascript/filesystem_read_in_loop", 4, 'fs.readFileSync(path, "utf8")')]),
        ("src/f.rs", "fn c(items: &[String]) {\n    for item in items {\n        let _ = Regex::new(item);\n        foo::<Vec<_>>().sort();\n    }\n    Regex::new(a);\n}\n", [("rust/regex_compile_in_loop", 3, "Regex::new(item)"), ("rust/sort_in_loop", 4, "foo::<Vec<_>>().sort()")]),
        ("src/i.py", "import json\ndef load(lines):\n    for line in lines:\n        rows.append(json.loads(line))\n    return json.loads(x)\n", [("python/json_decode_in_loop", 4, "json.loads(line)")]),
        ("src/k.py", "for a in b:\n    x.sort(key=f)\n    (y or z).sort()\n", [("python/sort_in_loop", 3, "(y or z).sort()")]),
        ("src/s.py", "x = [\n  a for a in sorted(b)]\nwhile 1: sorted(\n  c)\n", [("python/sort_in_loop", 3, "sorted( c)")]),
        ("src/e.js", "eval(code); obj.eval(code); new Function('x', y)", [("javascript/eval", 1, "eval(code)"), ("javascript/eval", 1, "new Function('x', y)")]),
        ("src/e.php", '<?php $a = $_ENV["K"]; $b = $other["K"]; $c = $_SERVER["K"]; getenv("X"); \\getenv("X"); Foo::getenv("X");', [("php/raw_env_outside_config", 1, '$_ENV["K"]'), ("php/raw_env_outside_config", 1, 'getenv("X")')]),
        ("config/app.php", '<?php env("K");', []),
        ("app/settings.py", 'os.environ["K"]', []),
        ("src/x.py", 'os.environ["K"]\nos.environ.get("K")\nfoo.os.environ["K"]\n', [("python/raw_env_outside_config", 1, 'os.environ["K"]'), ("python/raw_env_outside_config", 2, 'os.environ.get("K")')]),
        ("src/x.rs", 'env!("A"); option_env!("B"); println!("env"); std::env::var("C").unwrap();', [("rust/raw_env_outside_config", 1, 'env!("A")'), ("rust/raw_env_outside_config", 1, 'option_env!("B")'), ("rust/raw_env_outside_config", 1, 'std::env::var("C")')]),
        ("lib/x.rb", "Marshal.load(x)\nobj.instance_eval(y)\ninstance_eval(y)\nENV.fetch('A')", [("ruby/deserialize", 1, "Marshal.load(x)"), ("ruby/eval", 3, "instance_eval(y)"), ("ruby/raw_env_outside_config", 4, "ENV.fetch('A')")]),
        ("app/models/x.rb", "# Rails.\nfor u in users do\n  if u then v end\n  User.where(a: 1)\nend\nUser.where(b: 1)", [("ruby/framework/rails_db_query_in_loop", 4, "User.where(a: 1)")]),
        ("src/c.vue", "<template>eval(a)</template>\n<script>\neval(b)\n</script>", [("javascript/eval", 3, "eval(b)")]),
        ("src/w.js", "for (;;) { a.sort() }\nfor (const x of y) z.sort();\ndo { a.sort() } while (x)\nwhile (x) { if (y) { b\n.sort(c) } }", [("javascript/sort_in_loop", 4, "b .sort(c)")]),
        ("src/h.js", "for (const a of list.sort()) { }", [("javascript/sort_in_loop", 1, "list.sort()")]),
        ("src/b.js", "while (a) { b.sort(; ) } } eval(c)", [("javascript/eval", 1, "eval(c)"), ("javascript/sort_in_loop", 1, "b.sort(; )")]),
        ("src/n.py", "", []),
        ("src/n.go", "eval(a)", []),
    ],
)
def test_found(spark, path, text, want):
    assert [x[1:] for x in found(spark, (path, text))] == want


def test_null_texts_repeated_rows_and_other_columns(spark):
    rows = [("a.py", None, 1), (None, "eval(x)", 1), ("b.py", "eval(x)", 2), ("b.py", "eval(x)", 2)]
    got = rules.structural_findings(spark.createDataFrame(rows, "file_path string, text string, line int")).collect()
    assert [(r.file_path, r.rule_id, r.line) for r in got] == [("b.py", "security/python/eval", 1)]
    assert rules.structural_findings(spark.createDataFrame([], "file_path string, text string")).count() == 0


def test_framework_rules_need_the_framework(spark):
    text = "<?php foreach ($a as $b) { Cache::get($b); } app(X::class);"
    assert found(spark, ("src/a.php", text)) == [("src/a.php", "php/framework/laravel_cache_lookup_in_loop", 1, "Cache::get($b)"), ("src/a.php", "php/raw_container_lookup_outside_boundary", 1, "app(X::class)")]
    assert found(spark, ("src/a.php", text.replace("app(X::class);", ""))) == []
    assert found(spark, ("src/app/providers/a.php", text)) == [("src/app/providers/a.php", "php/framework/laravel_cache_lookup_in_loop", 1, "Cache::get($b)")]


def test_bounded_lists(spark):
    rows = rules.structural_findings(spark.createDataFrame([("a.ts", "while (x) { ['a', 1, null].includes(x); [y].includes(x); z.includes(x) }")], "file_path string, text string")).collect()
    assert sorted((r.token, r.max_items) for r in rows) == [("['a', 1, null].includes(x)", 3), ("[y].includes(x)", None), ("z.includes(x)", None)]


def test_long_sources_and_snippets(spark):
    text = "\n".join(f"x{i} = sorted(a)" for i in range(20_000)) + "\nfor a in b:\n" + "".join(f"    if c{i}:\n        d = [1]\n" for i in range(5000)) + "    sorted(z)\n"
    assert [x[2] for x in found(spark, ("a.py", text))] == [30_002]
    assert shapes.compact("é" * 100) == "é" * 78 + "..."
