"""Session helpers: the checkpoint folder named by the session wins; cluster settings apply."""

import os

import pytest

from ledgerlake.session import CLUSTER_CONF, apply_cluster_conf, shared_dir


def test_shared_dir_is_the_named_one_or_none(spark):
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert shared_dir(spark) == named  # no stand-in is made up


def test_apply_cluster_conf(spark):
    keep = {k: spark.conf.get(k, None) for k in CLUSTER_CONF}
    try:
        apply_cluster_conf(spark, {"spark.sql.shuffle.partitions": "12"})
        assert spark.conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"
        assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1"
        assert spark.conf.get("spark.sql.shuffle.partitions") == "12"
    finally:
        for k, v in keep.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["dedup_fuzzy", "predict_category", "budget_upsert"])
def test_frames_read_several_times_are_stored_once(spark, scratch, monkeypatch, name):
    """With a shared folder the plan reads stored frames; the rows are the same, and cleaning removes them."""
    from ledgerlake import session
    from ledgerlake.plans import queries as Q

    sf = "/root/testdata/sf0.001"
    lazy = Q.REGISTRY[name](spark, sf)
    want = sorted(map(repr, lazy.collect()))
    monkeypatch.setattr(session, "shared_dir", lambda s: scratch)
    stored = Q.REGISTRY[name](spark, sf)
    assert any(f.startswith(f"file:{scratch}") or scratch in f for f in stored.inputFiles()) and not any(scratch in f for f in lazy.inputFiles())
    assert sorted(map(repr, stored.collect())) == want
    session.drop_stored(spark)
    assert os.listdir(scratch) == []
