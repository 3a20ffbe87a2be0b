"""Versioned tables: atomic publish, commit log, backups by reference, in fresh scratch folders."""

import datetime as dt
import os
import threading

import pytest
from helpers import rows
from pyspark.sql import functions as F

from ledgerlake.plans import store as S


def frame(spark, values, month="2024-01-01"):
    return spark.createDataFrame([(v, dt.date.fromisoformat(month) if month else None) for v in values], "v int, month date")


def files(base):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(base) for f in names if f.endswith(".parquet"))


def test_append_read_and_prune(spark, scratch):
    t = S.month_table(spark, f"{scratch}/t")
    assert t.manifest() == S.Manifest() and t.versions() == []
    t.append(frame(spark, [1, 2]), "a", 0)
    t.append(frame(spark, [3], "2024-02-01").unionByName(frame(spark, [4], None)), "a", 1)
    m = t.append(frame(spark, []), "a", 2)  # a batch without rows is a commit too
    assert m.version == 3 and m.count == 4 and m.has("a", 2)
    assert rows(t.read(), "v") == [(1,), (2,), (3,), (4,)]
    assert rows(t.read([dt.date(2024, 2, 1), None]), "v") == [(3,), (4,)]
    assert rows(t.read(version=1), "v") == [(1,), (2,)]
    assert rows(t.read([dt.date(1999, 1, 1)]), "v") == []
    assert t.read([dt.date(2024, 2, 1)]).inputFiles() == [f for f in t.read().inputFiles() if "month=2024-02" in f]


def test_same_batch_number_of_two_sources_keeps_every_row(spark, scratch):
    t = S.month_table(spark, f"{scratch}/t")
    t.append(frame(spark, [1]), "stream-1", 0)
    t.append(frame(spark, [2]), "manual", 0)
    t.append(frame(spark, [3]), "stream-2", 0)  # a stream whose checkpoint was reset is another source
    assert rows(t.read(), "v") == [(1,), (2,), (3,)]


def test_replays_change_nothing(spark, scratch):
    t = S.month_table(spark, f"{scratch}/t")
    for _ in range(3):
        m = t.append(frame(spark, [1]), "s", 0)
    t.append(frame(spark, [2]), "s", 1)
    t.append(frame(spark, [99]), "s", 0)  # late replay with other rows
    assert m.version == 1 and rows(t.read(), "v") == [(1,), (2,)]


@pytest.mark.parametrize("where", ["_publish", "_put"])
def test_job_killed_before_publish_leaves_the_old_version(spark, scratch, monkeypatch, where):
    t = S.month_table(spark, f"{scratch}/t")
    t.append(frame(spark, [1]), "s", 0)
    before = t.manifest()

    def killed(*a, **k):
        raise KeyboardInterrupt

    with monkeypatch.context() as p:
        p.setattr(S.Table, where, killed)
        with pytest.raises(KeyboardInterrupt):
            t.overwrite(frame(spark, [5, 6]), "s", 1)
    assert len(files(f"{scratch}/t/data")) > len(before.folders)  # rows were written ...
    assert t.manifest() == before and rows(t.read(), "v") == [(1,)]  # ... and nobody sees them
    t.overwrite(frame(spark, [5, 6]), "s", 1)  # the job run again
    assert rows(t.read(), "v") == [(5,), (6,)] and rows(t.read(version=1), "v") == [(1,)]


def test_rows_that_do_not_read_back_are_not_published(spark, scratch, monkeypatch):
    t = S.month_table(spark, f"{scratch}/t")
    t.append(frame(spark, [1]), "s", 0)
    scan = S.Table._scan
    with monkeypatch.context() as p:
        p.setattr(S.Table, "_scan", lambda self, f, s: scan(self, f, s).limit(1))
        with pytest.raises(S.Damaged):
            t.append(frame(spark, [2, 3]), "s", 1)
    assert rows(t.read(), "v") == [(1,)] and t.versions() == [1]


def test_replace_rewrites_only_the_named_partitions(spark, scratch):
    t = S.month_table(spark, f"{scratch}/t")
    jan, feb = dt.date(2024, 1, 1), dt.date(2024, 2, 1)
    base = t.append(frame(spark, [1, 2]).unionByName(frame(spark, [3], "2024-02-01")), "s", 0)
    kept = base.parts["2024-02-01"]
    m = t.replace(frame(spark, [7]), [jan], "edit", 0, base)
    assert m.parts["2024-02-01"] == kept and rows(t.read(), "v") == [(3,), (7,)]
    with pytest.raises(S.Conflict):  # computed from a state that is gone
        t.replace(frame(spark, [8]), [jan], "edit", 1, base)
    assert t.replace(frame(spark, [9], "2024-02-01"), [feb], "edit", 2, base).version == 3  # other partitions don't matter
    with pytest.raises(ValueError):
        t.replace(frame(spark, [9], "2024-02-01"), [jan], "edit", 3, t.manifest())
    assert t.replace(frame(spark, []), [jan], "edit", 4, t.manifest()).parts.keys() == {"2024-02-01"}
    with pytest.raises(ValueError):
        t.append(spark.createDataFrame([(1,)], "x int").withColumn("month", F.lit(jan)), "s", 9)


def test_two_writers_at_once_lose_nothing(spark, scratch):
    path, errors = f"{scratch}/t", []

    def work(k):
        try:
            S.month_table(spark, path).append(frame(spark, [k]), f"writer-{k}", 0)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(4)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    t = S.month_table(spark, path)
    assert not errors and t.versions() == [1, 2, 3, 4] and rows(t.read(), "v") == [(0,), (1,), (2,), (3,)]


def test_backup_by_reference_restore_and_vacuum(spark, scratch):
    t = S.month_table(spark, f"{scratch}/t")
    assert not t.backup(dt.date(2024, 3, 1))  # nothing to keep
    t.append(frame(spark, [1]), "s", 0)
    on_disk = files(f"{scratch}/t")
    assert t.backup(dt.date(2024, 3, 1)) and files(f"{scratch}/t") == on_disk  # no copy
    for k in range(2, 6):
        t.overwrite(frame(spark, [k]), "s", k)
    assert t.backup(dt.date(2024, 3, 2))
    t.overwrite(frame(spark, [6]), "s", 6)
    assert t.backup(dt.date(2024, 3, 2))  # the same day again
    assert rows(t.read(backup=dt.date(2024, 3, 1)), "v") == [(1,)] and rows(t.read(backup=dt.date(2024, 3, 2)), "v") == [(6,)]
    assert t.vacuum(keep=2) == []  # too young
    assert len(t.vacuum(keep=2, min_age_seconds=0)) == 3
    assert t.versions() == [5, 6] and t.backups() == [dt.date(2024, 3, 1), dt.date(2024, 3, 2)]
    assert rows(t.read(backup=dt.date(2024, 3, 1)), "v") == [(1,)]
    t.restore(backup=dt.date(2024, 3, 1))
    assert rows(t.read(), "v") == [(1,)] and t.manifest().version == 7
    assert t.append(frame(spark, [9]), "s", 6).version == 7  # still committed


def test_compaction_keeps_rows(spark, scratch):
    t = S.month_table(spark, f"{scratch}/t")
    for k in range(4):
        t.append(frame(spark, [k, k]), "s", k)
    m = t.compact([dt.date(2024, 1, 1)])
    assert len(m.folders) == 1 and rows(t.read(), "v") == sorted([(k,) for k in range(4)] * 2)


def test_table_without_partitions(spark, scratch):
    t = S.Table(spark, f"{scratch}/t")
    t.append(frame(spark, [1]), "s", 0)
    t.append(frame(spark, [2]), "s", 1)
    assert rows(t.read(), "v") == [(1,), (2,)]
