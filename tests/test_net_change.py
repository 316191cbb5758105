"""Net changes and states: the truth table, order independence, random histories."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from driftline.operators import netchange as N
from driftline.operators import state

SCHEMA = "table_name string, start_lsn binary, seqval binary, op int, id bigint, v string"


def lsn(n):
    return n.to_bytes(10, "big")


def log(spark, changes):
    """``changes``: (key, lsn, op, value) in any order."""
    return spark.createDataFrame([("dbo.t", lsn(n), lsn(n), op, k, v) for k, n, op, v in changes], SCHEMA)


TRUTH = [
    (1, 1, 2, "a"),
    (2, 1, 2, "a"), (2, 2, 3, "a"), (2, 2, 4, "b"),
    (3, 1, 2, "a"), (3, 2, 1, "a"),
    (4, 1, 3, "a"), (4, 1, 4, "b"), (4, 2, 3, "b"), (4, 2, 4, "c"),
    (5, 1, 3, "a"), (5, 1, 4, "b"), (5, 2, 3, "b"), (5, 2, 4, "a"),
    (6, 1, 3, "a"), (6, 1, 4, "b"), (6, 2, 1, "b"),
    (7, 1, 1, "a"),
    (8, 1, 1, "a"), (8, 2, 2, "z"),
]
NET = [(1, 2, None, "a"), (2, 2, None, "b"), (4, 4, "a", "c"), (6, 1, "a", None), (7, 1, "a", None), (8, 4, "a", "z")]


@pytest.mark.parametrize("seed", [None, 1, 2])
def test_truth_table_in_any_row_order(spark, listed, seed):
    changes = list(TRUTH)
    if seed is not None:
        random.Random(seed).shuffle(changes)
    net = N.net_flat(N.net_change(log(spark, changes), ["id"]), ["id"])
    assert listed(net, "id", "op", "old_v", "new_v") == NET


def test_records_are_sparse(spark):
    net = N.net_change(log(spark, TRUTH), ["id"])
    records = {r.pk: r.fields for r in N.net_records(net, ["id"], F.col("id")).collect()}
    assert {k for k in records["1"] if not k.startswith("__$")} == {"new_v"}
    assert {k for k in records["4"] if not k.startswith("__$")} == {"old_v", "new_v"}
    assert {k for k in records["7"] if not k.startswith("__$")} == {"old_v"}
    assert records["4"]["__$operation"].val == "4" and records["4"]["__$primary_key"].val == "4"
    assert records["4"]["__$table"].val == "dbo.t"


def test_update_touching_nothing_is_dropped_and_nulls_compare(spark, listed):
    changes = [(1, 1, 3, None), (1, 1, 4, None), (2, 1, 3, None), (2, 1, 4, "x"), (3, 1, 3, "x"), (3, 1, 4, None)]
    net = N.net_flat(N.net_change(log(spark, changes), ["id"]), ["id"])
    assert listed(net, "id", "old_v", "new_v") == [(2, None, "x"), (3, "x", None)]


def test_after_image_alone_is_an_update(spark, listed):
    net = N.net_change(log(spark, [(1, 1, 4, "b")]), ["id"])
    assert listed(net, "id", "op") == [(1, 4)]


def test_composite_key(spark, listed):
    df = spark.createDataFrame([("t", lsn(1), lsn(1), 2, 1, "x", 5), ("t", lsn(2), lsn(2), 2, 1, "y", 6)],
                               "table_name string, start_lsn binary, seqval binary, op int, a int, b string, v int")
    net = N.net_change(df, ["a", "b"])
    assert listed(net, "a", "b", "op") == [(1, "x", 2), (1, "y", 2)]
    assert listed(N.net_records(net, ["a", "b"], F.lit(0)), "pk") == [("1|x",), ("1|y",)]
    assert N.net_change(df, ["a", "b"], parity=True).count() == 1


def test_parity_reads_first_images_and_swapped_codes(spark, listed):
    net = N.net_flat(N.net_change(log(spark, TRUTH), ["id"], parity=True), ["id"])
    assert listed(net, "id", "op", "old_v", "new_v") == [
        (1, 2, "a", None), (2, 4, "a", "b"), (3, 1, None, "a"), (4, 4, "a", "b"), (5, 4, "a", "b"),
        (6, 1, None, "b"), (7, 1, None, "a"), (8, 2, "z", None)]


def history(seed):
    """A random valid history per key, with the states before and after."""
    rng = random.Random(seed)
    before = {k: rng.choice("abc") for k in range(40) if rng.random() < 0.6}
    now, changes = dict(before), []
    for n in range(1, 200):
        k = rng.randrange(40)
        if k not in now:
            now[k] = rng.choice("abc")
            changes.append((k, n, 2, now[k]))
        elif rng.random() < 0.3:
            changes.append((k, n, 1, now.pop(k)))
        else:
            old, now[k] = now[k], rng.choice("abc")
            changes += [(k, n, 3, old), (k, n, 4, now[k])]
    rng.shuffle(changes)
    return before, now, changes


@pytest.mark.parametrize("seed", range(3))
def test_net_change_of_a_history_is_the_state_difference(spark, listed, seed):
    before, after, changes = history(seed)
    state_of = lambda d: spark.createDataFrame(list(d.items()), "id bigint, v string")
    b, a = state_of(before), state_of(after)
    net = N.net_change(log(spark, changes), ["id"])
    shown = listed(N.net_flat(net, ["id"]), "id", "op", "old_v", "new_v")
    direct = state.snapshot_net(b, a, ["id"], "dbo.t", F.lit(lsn(1)))
    folded = N.net_change(state.snapshot_diff(b, a, ["id"], "dbo.t", F.lit(lsn(1))), ["id"])
    assert shown == listed(N.net_flat(direct, ["id"]), "id", "op", "old_v", "new_v")
    assert shown == listed(N.net_flat(folded, ["id"]), "id", "op", "old_v", "new_v")
    assert listed(state.apply_changes(b, net, ["id"])) == listed(a)
    assert state.validate_replay(b, net, a, ["id"]).first().is_match
    assert not state.validate_replay(b, net.limit(0), a, ["id"]).first().is_match or listed(a) == listed(b)


def test_snapshot_diff_images(spark, listed):
    b = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, None, 1)], "id int, v string, w int")
    a = spark.createDataFrame([(1, "a", None), (2, "c", 1), (4, "d", 2)], "id int, v string, w int")
    rows = state.snapshot_diff(b, a, ["id"], "t", F.lit(lsn(1)))
    assert listed(rows, "id", "op", "v", "w") == [
        (2, 3, "b", 1), (2, 4, "c", 1), (3, 1, None, 1), (4, 2, "d", 2)]


def test_states_with_other_columns(spark, listed):
    """Dropped, added and retyped columns; a column that isn't there is no null."""
    b = spark.createDataFrame([(1, "a", 1), (2, None, 2), (3, "c", 3)], "id int, v string, w int")
    a = spark.createDataFrame([(1, None, 1), (2, None, 2), (4, "n", 9)], "id int, n string, w long")
    assert listed(state.state_differences(b, a, ["id"])) == [
        (1, "Changed"), (2, "Changed"), (3, "Removed"), (4, "Added")]
    rows = state.snapshot_diff(b, a, ["id"], "t", F.lit(lsn(1)))
    assert listed(rows.where("id = 2"), "op", "v", "n", "w", "absent_columns") == [
        (3, None, None, 2, '["n"]'), (4, None, None, 2, '["v"]')]
    net = N.net_change(rows, ["id"])
    assert listed(net, "id", "op") == listed(state.snapshot_net(b, a, ["id"], "t", F.lit(lsn(1))), "id", "op")
    after = state.apply_changes(b, net, ["id"])
    assert listed(after, "id", "v", "n", "w", "absent_columns") == [
        (1, None, None, 1, '["v"]'), (2, None, None, 2, '["v"]'), (4, None, "n", 9, '["v"]')]
    assert state.validate_replay(b, net, a, ["id"]).first().is_match
    assert not state.validate_replay(b, net.where("id <> 2"), a, ["id"]).first().is_match
    # Equal columns in another order are no difference; a whole number and its text are equal as text.
    assert state.state_differences(b, b.select("w", "v", "id"), ["id"]).count() == 0
    assert state.state_differences(b, b.withColumn("w", F.col("w").cast("string")), ["id"]).count() == 0
    assert state.apply_changes(b, net.limit(0), ["id"]).where("absent_columns <> '[\"n\"]'").count() == 0


def test_last_by_key_is_an_aggregate(spark, listed):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, o int, v string")
    assert listed(N.last_by_key(df, ["k"], F.col("o"))) == [(1, 2, "b"), (2, 1, "c")]
