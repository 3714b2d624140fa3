"""The command line over a small repository in a folder."""

import io
import json

import pytest

import codeloom

from codeloom import __main__ as cli
from codeloom.sources import sinks

FILES = {
    "app/main.py": "from app.util import helper\n\n\ndef run(x):\n    helper(x)\n    eval(x)\n",
    "app/util.py": "def helper(x):\n    return x == \"production-mode\"\n",
    "lib/b.py": "def go(x):\n    return x == \"production-mode\"\n",
    "gen/z.py": "def made():\n    return eval('1')\n",
    "hooks/a.php": "<?php\nadd_action('init', 'boot');\n",
    "hooks/b.php": "<?php\ndo_action('init');\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("cli")
    for name, text in FILES.items():
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_text(text)
    (base / ".codeloom").mkdir()
    (base / ".codeloom/scan.json").write_text('{"generated": ["gen"]}')
    return str(base)


def called(spark, *argv):
    out = io.StringIO()
    return cli.main(list(argv), spark, out), out.getvalue()


def test_settings_and_prefixes(spark, root):
    names = lambda **d: {r[0] for r in cli.scanned(spark, root, None, d).select("relative_path").collect()}
    assert names() == {f for f in FILES if not f.startswith("gen/")}
    assert names(include=["app/", "lib/b.py"]) == {"app/main.py", "app/util.py", "lib/b.py"}
    assert names(include=["ap"]) == set()
    with pytest.raises(ValueError):
        cli.scanned(spark, root, f"{root}/none.json")


def test_wrong_calls(spark, root, capsys):
    assert called(spark, "nothing", root)[0] == 1 and called(spark, "graph", root)[0] == 1
    assert called(spark, "info", root, "--config", f"{root}/none.json")[0] == 1
    assert called(spark, "version") == (0, f"codeloom {codeloom.__version__}\n")


def test_parts(spark, root):
    code, text = called(spark, "info", root)
    assert code == 0 and "| Python | 3 |" in text and "| Php | 2 |" in text
    code, text = called(spark, "plugins", root)
    assert code == 0 and "| hooks/b.php | hooks/a.php | boot |" in text
    code, text = called(spark, "tune", root)
    assert code == 0 and text.startswith("# Thresholds")


def test_analysis(spark, root, tmp_path):
    code, text = called(spark, "analyze", root, "--out", f"{tmp_path}/out")
    assert code == 0 and "## verdict" in text
    kept = sinks.current(spark, f"{tmp_path}/out")
    assert set(kept) == set(cli.MEMBERS) and {r.path for r in kept["findings"].filter("family = 'security'").collect()} == {"app/main.py"}
    code, text = called(spark, "cypher", root, "MATCH (x)-[r]->(y) WHERE r.type = 'CALL' RETURN y.name AS name, y.file_path AS path")
    assert code == 0 and {"name": "helper", "path": "app/util.py"} in [json.loads(x) for x in text.splitlines()]
    code, _ = called(spark, "graph", root, "--out", f"{tmp_path}/graph")
    assert code == 0 and spark.read.csv(f"{tmp_path}/graph/nodes").count() >= 5
    code, text = called(spark, "surface", root, "--include", "app")
    assert code == 0 and "## zones" in text


def test_incomplete(spark, tmp_path):
    (tmp_path / "bad.py").write_text("def (:\n")
    assert called(spark, "report", str(tmp_path))[0] == cli.INCOMPLETE
