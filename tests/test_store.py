"""The snapshot log: readers see whole writes, writers lose nothing, crashes leave the last snapshot."""

import threading
from datetime import datetime

import pytest

from panelforge.sources.files import Files
from panelforge.sources.schemas import BARS
from panelforge.sources.store import BarStore, Conflict, FileSource


def bars(spark, rows):
    return spark.createDataFrame([(t, datetime(2024, 1, d), c, c, c, c, 10) for t, d, c in rows], BARS)


def closes(df):
    return {(r.ticker, r.timestamp.day): r.close for r in df.collect()}


@pytest.fixture
def store(spark, tmp_path):
    return BarStore(spark, str(tmp_path / "s"))


def test_publish_once(spark, tmp_path):
    files, path = Files(spark), str(tmp_path / "log" / "1.json")
    assert files.publish(path, "é") and not files.publish(path, "other")
    assert files.read(path) == "é" and files.names(str(tmp_path / "log")) == ["1.json"]
    won = []
    threads = [threading.Thread(target=lambda k=k: won.append(k) if files.publish(str(tmp_path / "log" / "2.json"), str(k)) else None) for k in range(8)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert len(won) == 1 and files.read(str(tmp_path / "log" / "2.json")) == str(won[0])
    files.replace(path, "new")
    assert files.read(path) == "new"


def test_earlier_snapshots_stay_readable(spark, store):
    assert store.write(bars(spark, [("A", 1, 1.0), ("B/C D", 1, 4.0)])) == 1
    assert store.upsert(bars(spark, [("A", 1, 7.0), ("A", 2, 2.0)])) == 2
    assert closes(store.load(version=1)) == {("A", 1): 1.0, ("B/C D", 1): 4.0}
    assert closes(store.load()) == {("A", 1): 7.0, ("A", 2): 2.0, ("B/C D", 1): 4.0}
    assert closes(store.load(["B/C D"])) == {("B/C D", 1): 4.0} and store.load(["none"]).count() == 0
    with pytest.raises(ValueError):
        store.load(version=9)
    assert {(r.ticker, r.end.day, r.source) for r in store.manifest().collect()} == {("A", 2, "file"), ("B/C D", 1, "file")}


def test_only_the_files_of_a_ticker_are_read(spark, store):
    store.write(bars(spark, [(t, 1, 1.0) for t in "ABCDE"]))
    assert all("ticker=B/" in f for f in store.load(["B"]).inputFiles()) and len(store.load(["B"]).inputFiles()) == 1


def test_a_crash_before_publishing_leaves_the_old_snapshot(spark, store, monkeypatch):
    store.write(bars(spark, [("A", 1, 1.0)]))

    def dies(*_):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(store, "_publish", dies)
        with pytest.raises(OSError):
            store.upsert(bars(spark, [("A", 1, 9.0), ("B", 1, 1.0)]))
    assert closes(store.load()) == {("A", 1): 1.0} and store.versions() == [1]
    assert len(store.files.names(f"{store.path}/bars")) == 2
    store.vacuum()
    assert len(store.files.names(f"{store.path}/bars")) == 1 and closes(store.load()) == {("A", 1): 1.0}


def test_two_writers_lose_nothing(spark, store):
    """Both prepare on the same snapshot: one rebases tickers of its own, the other merges the shared ticker anew."""
    store.write(bars(spark, [("A", 1, 1.0)]))
    ready, errors = threading.Barrier(3), []

    def upsert(rows):
        try:
            own = BarStore(spark, store.path)
            stage, first = own._stage, []

            def staged(*args):
                out = stage(*args)
                if not first:
                    first.append(1)
                    ready.wait(120)  # nobody publishes before all have prepared
                return out

            own._stage = staged
            own.upsert(bars(spark, rows))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=upsert, args=(rows,)) for rows in ([("A", 2, 2.0), ("B", 1, 5.0)], [("A", 3, 3.0)], [("C", 1, 6.0)])]
    [t.start() for t in threads], [t.join() for t in threads]
    assert not errors
    assert closes(store.load()) == {("A", 1): 1.0, ("A", 2): 2.0, ("A", 3): 3.0, ("B", 1): 5.0, ("C", 1): 6.0}
    assert store.versions() == [1, 2, 3, 4]


def test_a_writer_that_never_wins(spark, store, monkeypatch):
    monkeypatch.setattr(store, "_publish", lambda *_: False)
    monkeypatch.setattr(BarStore, "ATTEMPTS", 3)
    with pytest.raises(Conflict):
        store.write(bars(spark, [("A", 1, 1.0)]))


def test_vacuum_keeps_what_is_asked_for(spark, store):
    for d in (1, 2, 3):
        store.upsert(bars(spark, [("A", d, float(d))]))
    store.vacuum(keep=2)
    assert store.versions() == [2, 3] and store.load(version=2).count() == 2 and store.load().count() == 3


def test_nothing_to_write(spark, store, tmp_path):
    assert store.write(spark.createDataFrame([], BARS)) == 0 and store.load() is None
    bars(spark, [("B", 1, 1.0)]).write.parquet(str(tmp_path / "vendor"))
    assert store.fetch("A", datetime(2024, 1, 1), datetime(2024, 1, 5), FileSource(str(tmp_path / "vendor"))).count() == 0
