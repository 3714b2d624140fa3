"""Names to the declarations that their scopes bind."""

from codeloom.operators import bindings

ARROWS = """
import { format } from './lib';
export function setup() {
    const copyText = async (text: string) => format(text);
    const child = () => copyText('nested');
    copyText('direct');
    child();
    const onlyLocal = () => 1;
    onlyLocal();
}
function parameters(copyText: (text: string) => void) { copyText('unknown'); }
function sibling() { onlyLocal(); }
function shadowImport() { const format = () => 'private'; return format(); }
"""
BLOCKS = """
function blocks() { { const local = () => 1; local(); } { const local = () => 2; local(); } local(); }
const recur = function internal(n) { return n ? internal(n - 1) : 0; };
recur(1); internal(1);
let changed = () => 1;
changed = unknown;
changed();
function masked({ recur }) { recur(); }
const single = value => value;
single(1);
const loop = () => 1;
for (const loop of values) loop();
loop();
"""
CLASSES = """
function first() {
    class Local {
        own() { this.own(); }
        static build(): void { other(); }
    }
    const instance = new Local();
    function typed(value: Local) {}
    function generic<Local>(value: Local) {}
    class Child extends Local {}
    { class Local { own() {} } const nested = new Local(); }
}
function second() { class Local { own() {} } new Local().own(); }
function outside() { new Local(); }
function shadow(Local: unknown) { new Local(); }
"""
PYTHON = """
def first():
    class Local: pass
    value = Local()
    def closure():
        nonlocal Local
        return Local()
def outside():
    return Local()
def parameter(Local):
    return Local()
def changed():
    class Changed: pass
    def replace():
        nonlocal Changed
        Changed = callback
    return Changed()
"""
NAMESPACES = """
class Local: pass
def factory():
    class Local: pass
    def with_default(Local=Local()): pass
    def typed(value: Local): pass
    class Holder:
        class Local: pass
        made = Local()
        def method(self):
            return Local()
    def global_reader():
        global Local
        return Local()
    values = [Local() for Local in values]
    class Child(Local): pass
"""


def run(spark, *files):
    return bindings.bound_uses(bindings.facts(spark.createDataFrame(list(files), "file_path string, text string")))


def of(rows, name):
    return sorted((r.line, r.occurrence, r.target_line) for r in rows if r.name == name)


def test_arrows_and_imports(spark):
    rows = run(spark, ("popup.ts", ARROWS)).collect()
    assert of(rows, "copyText") == [(5, 0, 4), (6, 0, 4), (11, 0, None)]
    assert of(rows, "onlyLocal") == [(9, 0, 8)] and of(rows, "child") == [(7, 0, 5)]
    assert of(rows, "format") == [(13, 0, 13)]  # line 4's is the import


def test_blocks_of_one_line_and_written_names(spark):
    rows = run(spark, ("scope.js", BLOCKS)).collect()
    local = [r for r in rows if r.name == "local"]
    assert [(r.occurrence, r.line) for r in sorted(local, key=lambda r: r.start)] == [(0, 2), (1, 2)] and len({r.target_start for r in local}) == 2
    assert [(r.target_name, r.line) for r in rows if r.name == "internal"] == [("recur", 3)]
    assert of(rows, "recur") == [(4, 0, 3), (8, 0, None)]
    assert of(rows, "changed") == [(7, 0, None)]
    assert of(rows, "single") == [(10, 0, 9)] and of(rows, "loop") == [(12, 0, None), (13, 0, 11)]


def test_classes(spark):
    rows = run(spark, ("classes.ts", CLASSES), ("other.ts", "function foreign() { new Local(); }")).collect()
    assert of(rows, "Local") == [(7, 0, 3), (8, 0, 3), (9, 0, None), (10, 0, 3), (11, 0, 11), (13, 0, 13), (15, 0, None)]
    assert not [r for r in rows if r.name in ("own", "build", "other")]


def test_python(spark):
    rows = run(spark, ("local.py", PYTHON)).collect()
    assert of(rows, "Local") == [(4, 0, 3), (7, 0, 3), (11, 0, None)] and of(rows, "Changed") == [(17, 0, None)]
    rows = run(spark, ("scopes.py", NAMESPACES)).collect()
    assert of(rows, "Local") == [(5, 0, 4), (6, 0, 4), (9, 0, 8), (11, 0, 4), (14, 0, 2), (15, 0, None), (16, 0, 4)]


def test_odd_sources(spark):
    deep = "x = " + "(" * 150 + "1" + ")" * 150 + "\n"
    rows = run(spark, ("a.py", None), ("b.py", ""), ("c.py", "def ("), ("d.js", "function (((( { const ="), ("e.py", deep), ("f.vue", "<p>f()</p>\n<script>\nconst f = () => 1; f();\n</script>"), ("g.rb", "f()")).collect()
    assert of(rows, "f") == [(3, 0, 3)] and len(rows) == 1
    assert run(spark, *[("z.rb", "x")]).count() == 0


def test_analysis_goes_by_scopes(spark):
    from codeloom.plans.analyze import analyze

    sources = [("popup.ts", ARROWS), ("lib.ts", "export const format = (text: string) => text;\nformat('module');\n"), ("foreign.ts", "export function copyText(text: string) { return text; }\n"), ("scope.js", BLOCKS), ("twice.js", "{ const second = x => 1; } { const second = x => 2; second(1); }")]
    done = analyze(spark.createDataFrame(sources, "file_path string, text string"))
    edges = [e for e in done.edges.collect() if e.kind == "Call"]
    by = lambda name: sorted((e.source_file_path, e.line, e.target_file_path, e.reason) for e in edges if e.reference_target_name == name)
    lexical = "call:lexical-binding"
    assert by("copyText") == [("popup.ts", 5, "popup.ts", lexical), ("popup.ts", 6, "popup.ts", lexical)]
    assert by("onlyLocal") == [("popup.ts", 9, "popup.ts", lexical)]
    assert ("lib.ts", 2, "lib.ts", lexical) in by("format") and ("popup.ts", 13, "popup.ts", lexical) in by("format")
    assert len(by("local")) == 2 and not by("changed") and by("internal") == [("scope.js", 3, "scope.js", lexical)]
    assert [e.target_symbol_id for e in edges if e.reference_target_name == "second"] == ["twice.js#second#1#2"]


def test_uses_are_spread_once(spark):
    """One exchange and no checkpoint of all facts: a copy of each use for each scope around it went over the network before, and facts and uses to disk twice."""
    x = spark.createDataFrame([("a.js", BLOCKS), ("b.js", "function f() { f(); }")], "file_path string, text string")
    uses = bindings.bound_uses(bindings.facts(x, keep=False))
    plan = uses._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "MapInPandas" in plan
    kept = bindings.bound_uses(bindings.facts(x))
    assert sorted(map(str, uses.collect())) == sorted(map(str, kept.collect())) and uses.count() >= 5


def test_meant_where_parsed(spark):
    """Uses that are bound where their file is parsed are those of the rows of facts, also for a path with two texts, and nothing is shuffled behind the parser."""
    python = "import os\ndef f(a):\n    def g(): return a()\n    g(); f(g); os()\n    global h\n    h = g\nclass C:\n    def m(self): return C()\nh()\n"
    files = [("src/a.ts", ARROWS), ("src/a.ts", BLOCKS), ("src/b.js", BLOCKS), ("src/c.ts", CLASSES), ("src/d.py", python), ("src/e.ts", ""), ("src/f.ts", None), (None, BLOCKS), ("src/g.md", BLOCKS), ("src/h.vue", f"<script>{ARROWS}</script>"), ("src/i.py", "def")]
    x = spark.createDataFrame([*files, *[(f"src/n{i}.ts", BLOCKS + "f0();" * i) for i in range(20)]], "file_path string, text string")
    want = bindings.bound_uses(bindings.facts(x))
    got = bindings.meant_uses(x)
    assert got.columns == want.select(*got.columns).columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(*got.columns).collect()))
    assert got._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0].count("Exchange") == 0
    from codeloom.plans import source_queries

    text = source_queries.Q["lexical_bindings"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in text and "Exchange" not in text.split("MapInArrow")[0]
