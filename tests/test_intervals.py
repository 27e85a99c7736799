import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quern.operators import intervals as iv

SCHEMA = "e string, k string, a double, b double, t string, entity string, shard int, start_u string, runs string, `kind` string"


def brute(items):
    """Periods and gaps of (entity, start, end) in milliseconds by sorting."""
    out = []
    for e in {x[0] for x in items}:
        runs = []
        for _, a, b in sorted(x for x in items if x[0] == e):
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
        out += [(e, "period", a, b) for a, b in runs]
        out += [(e, "gap", x[1], y[0]) for x, y in zip(runs, runs[1:])]
    return sorted(out, key=repr)


def frame(spark, items):
    return spark.createDataFrame([(e, f"k{i}", None if a is None else a / 1000, None if b is None else b / 1000, "t", "x", 1, "y", "z", "w") for i, (e, a, b) in enumerate(items)], SCHEMA)


def test_periods_match_sorting(spark, rows):
    rng = random.Random(1)
    span = iv.SHARD_UNITS
    items = []
    for e in "ABC":
        for _ in range(150):
            a = rng.randrange(0, 6 * span)
            items.append((e, a, a + rng.choice([1, 5, 1000, span // 40, 3 * span if rng.random() < 0.02 else 7])))
    items += [("D", 0, span), ("D", span, 2 * span), ("D", 2 * span + 1, 3 * span), ("E", -span - 5, -span + 5)]
    items += items[:20]
    got = rows(iv.continuous_periods(frame(spark, items), "e", "a", "b"))
    assert got == brute(items)


def test_unusable_rows_and_empty_table(spark, rows):
    items = [("A", None, 5), ("A", 5, None), ("A", 9, 9), ("A", 9, 3), (None, 1, 2), ("A", float("nan"), 1e9), ("A", 1, float("inf")), ("A", 10, 20), ("A", 20, 30)]
    assert rows(iv.continuous_periods(frame(spark, items), "e", "a", "b")) == [("A", "period", 10, 30)]
    assert rows(iv.continuous_periods(frame(spark, items[:0]), "e", "a", "b")) == []


def test_members_lie_in_their_period(spark):
    items = [("A", 0, 10), ("A", 10, 20), ("A", 25, 26), ("A", 0, 10), ("B", 1, iv.SHARD_UNITS + 9), ("B", iv.SHARD_UNITS + 9, iv.SHARD_UNITS + 10)]
    got = {(r.key, r.period_start_u, r.period_end_u) for r in iv.period_members(frame(spark, items), "e", "k", "a", "b", ["t"]).collect()}
    assert got == {("k0", 0, 20), ("k1", 0, 20), ("k2", 25, 26), ("k3", 0, 20), ("k4", 1, iv.SHARD_UNITS + 10), ("k5", 1, iv.SHARD_UNITS + 10)}


@given(st.lists(st.tuples(st.integers(0, 200), st.integers(1, 30)), min_size=1, max_size=40))
def test_containers_are_sets(pairs):
    import numpy as np

    a = np.array([p[0] for p in pairs])
    b = a + np.array([p[1] for p in pairs])
    half = len(pairs) // 2
    containers = [iv.encode(*iv.unite(a[:half], b[:half])), iv.encode(*iv.unite(a[half:], b[half:]))]
    x, y = iv.decode(iv.merge_containers(containers))
    assert {u for i, j in zip(x, y) for u in range(i, j)} == {u for i, j in zip(a, b) for u in range(i, j)}
    assert all(j < i for j, i in zip(y, x[1:]))


@pytest.mark.parametrize("keys", [["k"]])
def test_latest_rows(spark, rows, keys):
    from quern.operators.latest import latest_rows

    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", None, "z"), ("b", None, None), (None, 3, "n"), ("a", 2, "y")], "k string, version int, v string")
    assert rows(latest_rows(df, keys, "version", ["k", "v"])) == [("a", "y"), ("b", None)]
