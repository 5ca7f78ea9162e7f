"""Committed tables: visibility, numbering, interleaved writers."""
import os

import pytest

from ledgerline.sources import commits, sinks
from ledgerline.sources.commits import CommitLog, read_committed

SCHEMA = "object_key string, v string"


def _rows(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def _values(spark, root, version=None):
    return sorted((r.object_key, r.v) for r in read_committed(spark, root, version).collect())


def test_a_crashed_writer_leaves_nothing_visible(spark, scratch):
    log = CommitLog(spark, scratch)
    log.append(_rows(spark, ("a", "1")))
    lost = log.stage(_rows(spark, ("b", "2")))
    assert _values(spark, scratch) == [("a", "1")] and log.unreferenced() == [lost]
    log.append(_rows(spark, ("c", "3")))
    assert _values(spark, scratch) == [("a", "1"), ("c", "3")] and log.latest() == 2


def test_a_version_has_one_writer(spark, scratch):
    log = CommitLog(spark, scratch)
    one, two = log.stage(_rows(spark, ("a", "1"))), log.stage(_rows(spark, ("a", "2")))
    assert log.commit(1, [one]) and not log.commit(1, [two])
    assert _values(spark, scratch) == [("a", "1")]
    assert not [n for n in os.listdir(os.path.join(scratch, "_commits")) if n.endswith(".draft")]


def test_empty_and_old_versions(spark, scratch):
    log = CommitLog(spark, scratch)
    assert log.latest() == 0 and log.live() == [] and not log.exists()
    with pytest.raises(FileNotFoundError):
        log.read()
    schema = _rows(spark, ("a", "1")).schema
    assert log.read(schema=schema).count() == 0
    log.append(_rows(spark))
    log.append(_rows(spark, ("a", "1")))
    folder = log.stage(_rows(spark, ("z", "9")))
    log.commit(3, [folder], drop=log.live(2))
    assert _values(spark, scratch) == [("z", "9")] and _values(spark, scratch, 2) == [("a", "1")] and _values(spark, scratch, 1) == []


def test_live_lists_shorten_the_log(spark, scratch, monkeypatch):
    monkeypatch.setattr(commits, "LIVE_EVERY", 3)
    log = CommitLog(spark, scratch)
    for i in range(7):
        log.append(_rows(spark, (f"k{i}", "x")))
    names = os.listdir(os.path.join(scratch, "_commits"))
    assert sum(n.endswith(".live.json") for n in names) == 2
    for version in (1, 2):  # the lists alone are enough for later versions
        os.replace(os.path.join(scratch, "_commits", f"{version:020d}.json"), os.path.join(scratch, f"{version}.json"))
    assert len(log.live(7)) == 7 and len(_values(spark, scratch, 4)) == 4


@pytest.mark.parametrize("overtaken", [1, 2])
def test_interleaved_writers_seal_each_key_once(spark, scratch, monkeypatch, overtaken):
    """Another writer commits between this one's staging and its claim, also
    while it compares again."""
    sinks.append_audit(spark, _rows(spark, ("k0", "old")), scratch)
    stage, calls = CommitLog.stage, []

    def interrupted(self, df, partition_by=()):
        folder = stage(self, df, partition_by)
        calls.append(folder)
        if len(calls) <= overtaken:
            other = stage(self, _rows(spark, (f"k{len(calls)}", "theirs")))
            assert self.commit(self.latest() + 1, [other])
        return folder

    monkeypatch.setattr(CommitLog, "stage", interrupted)
    sinks.append_audit(spark, _rows(spark, ("k0", "mine"), ("k1", "mine"), ("k2", "mine"), ("k3", "mine")), scratch)
    monkeypatch.undo()
    expected = {"k0": "old", "k1": "theirs", "k2": "theirs" if overtaken == 2 else "mine", "k3": "mine"}
    got = _values(spark, scratch)
    assert len(got) == 4 and dict(got) == expected


def test_partitioned_write_without_rows(spark, scratch):
    log = CommitLog(spark, scratch)
    log.append(_rows(spark), ["v"])
    assert log.read().columns == ["object_key", "v"] and log.read().count() == 0
    log.append(_rows(spark, ("a", "1"), ("b", "2")), ["v"])
    assert _values(spark, scratch) == [("a", "1"), ("b", "2")]
