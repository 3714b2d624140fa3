"""From files of a small repository to findings, views and a verdict; and the parts on the way."""

import json

import pytest

from codeloom.functions import masks
from codeloom.operators import plugins, resolution
from codeloom.plans import cypher
from codeloom.plans.analyze import analyze_folder
from codeloom.sources import parsers, scan, sinks

FILES = {
    "app/main.py": "import os\nfrom app.util import helper, unused\n\n\ndef run(x):\n    helper(x)\n    os.system(x)\n\n\nif __name__ == '__main__':\n    import sys\n    run(sys.argv[1])\n",
    "app/util.py": "class Base:\n    def go(self):\n        return 1\n\n\nclass Child(Base):\n    def go(self):\n        for a in self.b:\n            for c in a:\n                sorted(c)\n\n    def _hidden(self):\n        return 2\n\n\ndef helper(x):\n    return Child().go()\n\n\ndef unused(y):\n    return y\n",
    "src/lib.rs": "use crate::a::{b, c};\npub struct S { x: u8 }\nimpl S {\n    pub fn go(&self, n: u8) -> u8 { helper(n) }\n}\nfn helper(n: u8) -> u8 { if mode == \"production\" { 1 } else { n } }\n#[cfg(test)]\nmod tests {\n    fn t() { if x == \"ignored\" {} }\n}\n",
    "web/a.ts": "import { b } from './b';\nimport type { T } from './b';\nexport class A extends b {\n  private go(n: number) { return fetch('/api/x'); }\n}\n",
    "web/b.ts": "export class b {}\nexport const f = (x) => eval(x);\n",
    "p/C.php": "<?php\nuse App\\Models\\User;\nclass C extends D implements E, F {\n  public function go($a, $b = 1) { return unserialize($_GET['x']); }\n}\n",
    "r/x.rb": "require_relative 'y'\nclass X < Y\n  def go(a)\n    system(a)\n  end\nend\n",
    "v/w.vue": "<template><p>eval(x)</p></template>\n<script>\nimport q from './q'\nfunction z() { return 1 }\n</script>\n",
    "broken.py": "def (:\n",
    "node_modules/x.js": "eval(1)\n",
    "README.md": "text\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("repo")
    for name, text in FILES.items():
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_text(text)
    return str(base)


@pytest.fixture(scope="module")
def done(spark, root):
    return analyze_folder(spark, root)


def test_scan(spark, root):
    files = scan.scan(spark, root)
    assert {r.relative_path for r in files.select("relative_path").collect()} == {f for f in FILES if not f.startswith("node_modules")}
    assert {r.relative_path for r in scan.admitted(files).collect()} == {f for f in FILES if not f.startswith("node_modules") and f != "README.md"}
    assert {tuple(r) for r in scan.structure(files.filter("relative_path = 'app/main.py'")).collect()} == {("", "app", False), ("app", "app/main.py", True)}
    assert scan.can_load(files, scan.scan(spark, root), {"v": 1}, {"v": 1}) and not scan.can_load(files, files, {"v": 1}, {"v": 2})
    assert scan.is_stable(files, scan.scan(spark, root))
    assert len(scan.input_fingerprint(files).first()[0]) == 64
    with pytest.raises(ValueError):
        scan.scan_config('{"generated": ["../x"]}')
    assert scan.boundary_truth("/r/sub", "/r", []) == "TruncatedSlice" and scan.boundary_truth("/r", "/r/", []) == "CompleteRepository"


def test_symbols_and_edges(done):
    names = {(r.file_path, r.kind, r.name) for r in done.symbols.collect()}
    assert {("app/util.py", "Class", "Child"), ("app/util.py", "Method", "_hidden"), ("app/main.py", "Function", "run"), ("src/lib.rs", "Struct", "S"), ("src/lib.rs", "Method", "go"), ("web/a.ts", "Class", "A"), ("p/C.php", "Method", "go"), ("r/x.rb", "Method", "go"), ("v/w.vue", "Function", "z")} <= names
    pairs = {(r.source_file_path, r.target_file_path, r.kind) for r in done.edges.collect()}
    assert ("app/main.py", "app/util.py", "Import") in pairs and ("app/main.py", "app/util.py", "Call") in pairs and ("web/a.ts", "web/b.ts", "Import") in pairs
    assert ("app/util.py", "app/util.py", "Extends") in pairs
    assert [r.file_path for r in done.outcomes.filter("required_recovery").collect()] == ["broken.py"]
    assert done.coverage.first().recovered == 1


def test_findings(done):
    found = {(r.path, r.category, r.value) for r in done.findings.collect()}
    assert ("app/main.py", "python-command-exec", "python-command-exec") in found
    assert ("p/C.php", "php-unserialize", "php-unserialize") in found and ("r/x.rb", "ruby-command-exec", "ruby-command-exec") in found and ("web/b.ts", "javascript-eval", "javascript-eval") in found
    assert ("src/lib.rs", "MagicString", "production") in found
    assert not [f for f in found if f[2] == "ignored"]
    assert ("app/util.py", "UnusedPrivateFunction", "_hidden") in found and ("app/main.py", "UnusedImport", "unused") in found
    assert not any(p == "v/w.vue" and c.startswith("javascript") for p, c, _ in found)
    assert {(r.file_path, r.subtype) for r in done.complexity.collect()} >= {("app/util.py", "nested_loop"), ("app/util.py", "sort")}
    assert ("http_calls", "/api/x") in {(r.category, r.value) for r in done.contracts.collect()}
    security = {r.file_path: r for r in done.security.collect()}
    assert security["p/C.php"].severity == "High" and security["p/C.php"].inputs == ["4:RequestQuery"]
    assert done.verdict.first().verdict == "Block" and done.verdict.first().reason == "incomplete_parse_coverage"
    assert done.review_summary.first().visible == done.findings.count()


def test_masks():
    assert masks.mask('x = "a#b" # c\n', "Python") == 'x = "   "    \n'
    assert masks.mask("a /* x\ny */ b // c", "JavaScript", strings=False) == "a     \n     b     "
    assert masks.test_ranges(FILES["src/lib.rs"]) == [(7, 10)]
    assert masks.vue_script("<p>\n<script>x</script>") == "   \n        x         "


def test_rust_use_and_import_paths(spark):
    assert parsers.expand_use("crate::a::{self, b as c}") == ["crate::a", "crate::a::b"]
    files = spark.createDataFrame([("web/b.ts",), ("web/d/index.ts",), ("pkg/__init__.py",), ("pkg/m.py",), ("src/a/b.rs",), ("src/Models/User.php",)], "path string")
    imports = [("web/a.ts", "TypeScript", "./b"), ("web/a.ts", "TypeScript", "./d"), ("pkg/x.py", "Python", ".m"), ("x.py", "Python", "pkg"), ("src/lib.rs", "Rust", "crate::a::b"), ("p.php", "Php", "App\\Models\\User"), ("x.py", "Python", "none")]
    got = {(r.file_path, r.target): r.imported_path for r in resolution.import_targets(spark.createDataFrame(imports, "file_path string, language string, target string"), files).collect()}
    assert got == {("web/a.ts", "./b"): "web/b.ts", ("web/a.ts", "./d"): "web/d/index.ts", ("pkg/x.py", ".m"): "pkg/m.py", ("x.py", "pkg"): "pkg/__init__.py", ("src/lib.rs", "crate::a::b"): "src/a/b.rs", ("p.php", "App\\Models\\User"): "src/Models/User.php"}


def test_linearisation(spark):
    rows = [("D", "B", 0, "r"), ("D", "C", 1, "r"), ("B", "A", 0, "r"), ("C", "A", 0, "r"), ("X", "P", 0, "q"), ("X", "Q", 1, "q"), ("P", "Q", 0, "q"), ("Q", "P", 0, "q")]
    got = {}
    for r in resolution.linearised(spark.createDataFrame(rows, "child string, parent string, place int, root string")).collect():
        got.setdefault(r.child, []).append((r.depth, r.ancestor))
    assert [a for _, a in sorted(got["D"])] == ["B", "C", "A"]
    assert [a for _, a in sorted(got["X"])] == ["P", "Q"]  # inconsistent: breadth first


def test_lexical_binding_goes_first(spark):
    resolved = spark.createDataFrame([(1, "t1", "Global", 500), (2, "t2", "Global", 500), (3, "t3", "Global", 500)], "ref_index long, target_symbol_id string, resolution_tier string, confidence_millis int")
    bound = spark.createDataFrame([(1, "own"), (2, None)], "ref_index long, target_symbol_id string")
    assert {(r.ref_index, r.target_symbol_id) for r in resolution.with_lexical(resolved, resolved.select("ref_index"), bound).collect()} == {(1, "own"), (3, "t3")}


def test_hooks_and_signals(spark):
    lines = spark.createDataFrame([("a.php", 1, "add_action('init', 'boot');"), ("b.php", 2, "do_action('init');"), ("c.py", 3, "post_save.connect(on_save)"), ("d.py", 4, "post_save.send(x)")], "file_path string, line int, content string")
    sub, pub = plugins.hooks(lines)
    assert [tuple(r) for r in plugins.published(pub, sub).select("source_file_path", "target_file_path", "target_symbol_id").collect()] == [("b.php", "a.php", "boot")]
    sub, pub = plugins.signals(lines)
    assert [tuple(r) for r in plugins.published(pub, sub).select("source_file_path", "target_symbol_id").collect()] == [("d.py", "on_save")]


def test_config_and_reports(spark):
    assert json.loads(scan.jsonc('{"a": "x//y", // c\n "b": [1, 2,], /* d */}')) == {"a": "x//y", "b": [1, 2]}
    configs = {"tsconfig.json": '{"extends": "./base", "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"]}}}', "base.json": '{"compilerOptions": {"paths": {"@/*": ["no"], "~/*": ["lib/*"]}}}'}
    assert scan.path_aliases(configs) == {"@/*": ["src/*"], "~/*": ["lib/*"]}
    assert scan.namespaces('{"autoload": {"psr-4": {"App\\\\": "app/"}}}') == {"App\\": ["app/"]}
    assert [tuple(r)[:4] for r in scan.tool_findings(spark, "ruff", '[{"filename": "a.py", "location": {"row": 3}, "code": "F401", "message": "m"}]').collect()] == [("ruff", "a.py", 3, "F401")]
    assert scan.tool_findings(spark, "pip-audit", '{"dependencies": [{"vulns": [{"id": "V1"}, {"id": "V2"}]}, {}]}').count() == 2
    assert not scan.tool_findings(spark, "npm-audit", None, complete=False).first().complete


def graph(spark):
    nodes = spark.createDataFrame([("a", "FILE"), ("b", "CLASS"), ("c", "METHOD")], "id string, kind string")
    return nodes, spark.createDataFrame([("a", "b", "IMPORT", 3), ("b", "c", "CALL", 9)], "from string, to string, type string, line int")


def test_cypher(spark):
    g = graph(spark)
    run = lambda q: [tuple(r) for r in cypher.run(*g, q).collect()]
    assert run("MATCH (x {kind: 'CLASS'})<-[r:CodeRelation]-(y) RETURN y.id AS id, r.line AS line") == [("a", 3)]
    assert run("MATCH (x)-[*1..2]->(y) WHERE x.id = 'a' RETURN y.id AS id ORDER BY id") == [("b",), ("c",)]
    assert run("MATCH (x)-[r]->(y), (y)-[s]->(z) RETURN x.id AS x, z.id AS z") == [("a", "c")]
    assert run("MATCH (n) WHERE n.kind STARTS WITH 'ME' OR n.id IN ['a'] RETURN count(*) AS n") == [(2,)]
    empty = cypher.run(*g, "MATCH (n) WHERE n.id = 'none' RETURN n.id AS one, n.kind AS two")
    assert empty.columns == ["one", "two"] and empty.count() == 0
    for bad in ("RETURN 1 AS duplicate, 2 AS duplicate", "RETURN 1 AS a; RETURN 2 AS b", "CREATE (n)", "MATCH (a)-[*1..99]->(b) RETURN a.id AS a"):
        with pytest.raises(cypher.CypherError):
            cypher.run(*g, bad)


def test_publication(spark, tmp_path):
    nodes, relations = graph(spark)
    at = f"file://{tmp_path}/out"
    assert sinks.current(spark, at) == {}
    first = sinks.publish(spark, at, {"nodes": nodes})
    second = sinks.publish(spark, at, {"nodes": nodes.limit(1), "relations": relations})
    assert first != second and sinks.current(spark, at)["nodes"].count() == 1 and sinks.current(spark, at)["relations"].count() == 2
    sinks.export_graph(nodes, relations, f"{at}/csv")
    with pytest.raises(ValueError):
        sinks.export_graph(nodes.filter("id != 'c'"), relations, f"{at}/csv")
    sinks.register_views(nodes, relations)
    assert spark.sql("select count(*) from code_relation r join code_node n on n.id = r.to").first()[0] == 2
    assert "| a | FILE |" in sinks.report("R", {"Nodes": nodes})
