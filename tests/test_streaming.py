"""Revisions, live refresh and windows that survive a restart."""

import datetime
import os
import shutil

import pytest

from codeloom.streaming import refresh
from codeloom.streaming.revisions import Revisions, put_once


def test_log_of_revisions(spark, tmp_path):
    r = Revisions(spark, f"file://{tmp_path}/log")
    assert r.status() == {"observed": 0, "published": 0, "stale": False, "dirty": 0, "last_error": None}
    first, second = r.edit(["b", "a", "a"]), r.edit(["b"])
    assert first["paths"] == ["a", "b"] and first["min_revision"] < second["min_revision"] and not r.fresh(first)
    assert r.publish(first["min_revision"]) and r.fresh(first) and not r.fresh(second)
    # What was edited after the published revision stays dirty; another process sees the same.
    other = Revisions(spark, f"file://{tmp_path}/log")
    assert [(x.file_path, x.number) for x in other.dirty().collect()] == [("b", second["min_revision"])]
    other.failed(second["min_revision"], "no memory")
    assert r.status()["last_error"] == "no memory" and r.status()["stale"] and r.status()["dirty"] == 1
    assert r.publish(second["min_revision"]) and not other.publish(first["min_revision"])
    assert not other.status()["stale"] and other.status()["last_error"] is None
    assert r.observe(spark.createDataFrame([], "file_path string")) is None
    told = r.observe(spark.createDataFrame([("x",), ("x",), ("y",)], "file_path string"))
    assert r.status()["dirty"] == 2 and not r.fresh(told)


def test_a_number_is_given_once(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/log"
    assert put_once(spark, f"{root}/side", f"{root}/x/1", "a") and not put_once(spark, f"{root}/side", f"{root}/x/1", "b")
    assert (tmp_path / "log/x/1").read_text() == "a"
    a, b = Revisions(spark, root), Revisions(spark, root)
    one = a.edit(["p"])
    # Between b's look at the log and its entry, a publishes more: b's result is late by then and is dropped.
    two = a.edit(["q"])
    state, asked = b._state, []

    def look():
        got = state()
        if not asked:
            asked.append(1)
            assert a.publish(two["min_revision"])
        return got

    monkeypatch.setattr(b, "_state", look)
    assert not b.publish(one["min_revision"]) and a.fresh(two)


def test_a_stopped_stream_goes_on(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(refresh, "DELTAS", 2)
    folder, shared = tmp_path / "in", f"file://{tmp_path}/shared"
    (folder / "sub").mkdir(parents=True)
    texts = {"a.py": "x = 1\n", "sub/b[1].py": "y = 2\n", "notes.md": "n\n"}
    for name, text in texts.items():
        (folder / name).write_text(text)

    def step(tell=None, rebuild=None):
        """A new start: nothing is kept in memory."""
        r, seen = Revisions(spark, f"{shared}/log"), []
        receipt = r.edit(tell) if tell else refresh.poll(spark, str(folder), shared, r)
        keep = rebuild or (lambda df, n: seen.append({(x.file_path, x.text) for x in df.collect()}))
        refresh.watch(spark, str(folder), shared, keep, r).awaitTermination()
        assert receipt is None or r.fresh(receipt)
        return set().union(*seen)

    assert step() == {("a.py", "x = 1\n"), ("sub/b[1].py", "y = 2\n")}
    assert step() == set()
    # The same content at another time is no change; other content at the same path is.
    os.utime(folder / "a.py", (1, 1))
    (folder / "sub/b[1].py").write_text("y = 3\n")
    assert step() == {("sub/b[1].py", "y = 3\n")}
    assert step(["a.py", "gone.py"]) == set()
    # A rebuild that fails leaves its edits dirty, and the next start does them.
    (folder / "a.py").write_text("x = 9\n")

    def broken(df, n):
        raise ValueError("broken")

    with pytest.raises(Exception, match="broken"):
        step(["a.py"], broken)
    r = Revisions(spark, f"{shared}/log")
    assert "broken" in r.status()["last_error"] and [x.file_path for x in r.dirty().collect()] == ["a.py"]
    seen = []
    refresh.watch(spark, str(folder), shared, lambda df, n: seen.extend(x.text for x in df.collect()), r).awaitTermination()
    assert seen == ["x = 9\n"] and not r.status()["stale"]
    (folder / "a.py").unlink()
    monkeypatch.setattr(refresh, "BY_NAME", 0)
    (folder / "c.py").write_text("z\n")
    assert step() == {("a.py", None), ("c.py", "z\n")}
    state = {x.file_path for x in refresh.file_state(spark, shared).filter("content_hash is not null").collect()}
    assert state == {"sub/b[1].py", "c.py"} and any(n.startswith("full") for n in os.listdir(tmp_path / "shared/state"))


def test_windows_go_on_and_drop_late_events(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 10, 5)
    hour = datetime.timedelta(hours=1)

    def more(name, rows):
        spark.createDataFrame(rows, "ts timestamp, event_type string").coalesce(1).write.parquet(f"file://{tmp_path}/{name}")
        (tmp_path / "events").mkdir(exist_ok=True)
        part = next(p for p in (tmp_path / name).iterdir() if p.suffix == ".parquet")
        shutil.copy(part, tmp_path / "events" / f"{name}.parquet")

    def counts():
        return sorted((str(r.start), r.event_type, r.n) for r in refresh.windowed_counts(spark, f"file://{tmp_path}/events", shared=f"file://{tmp_path}/shared").collect())

    more("one", [(at, "a"), (at, "a"), (at + hour, "a"), (at + 5 * hour, "b")])
    assert counts() == [("2024-01-01 10:00:00", "a", 2), ("2024-01-01 11:00:00", "a", 1), ("2024-01-01 15:00:00", "b", 1)]
    more("two", [(at, "a"), (at + 5 * hour, "b")])  # the first is hours behind the watermark
    assert counts() == [("2024-01-01 10:00:00", "a", 2), ("2024-01-01 11:00:00", "a", 1), ("2024-01-01 15:00:00", "b", 2)]
    assert counts() == [("2024-01-01 10:00:00", "a", 2), ("2024-01-01 11:00:00", "a", 1), ("2024-01-01 15:00:00", "b", 2)]
