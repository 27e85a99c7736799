import random
import re

import numpy as np
import pytest

from quern.llm import neardup as n

SCHEMA = "kind string, key string, version int, text string, rid int, band string, a int, size string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], SCHEMA)


def sets(rows, k, least):
    out = {}
    for kind, key, _, text in rows:
        if text is not None and key is not None:
            w = re.findall(r"[^\W_]+", text.lower())
            if len(w) >= max(least, k):
                out[kind, key] = set(zip(*(w[i:] for i in range(k))))
    return out


def brute(rows, k, t, least):
    s = sorted(sets(rows, k, least).items())
    return {(a[0], a[1], b[1]) for i, (a, x) in enumerate(s) for b, y in s[i + 1 :] if a[0] == b[0] and len(x & y) / len(x | y) >= t}


def corpus(n_texts=300, seed=0, hot=0):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(n_texts):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(15, 120))]
        rows.append(("chunk" if i % 3 else "segment", f"k{i:04d}", 1, " ".join(words)))
        if i % 4 == 0:
            edited = list(words)
            edited[rng.randrange(len(edited))] = "changed"
            rows.append((rows[-1][0], f"k{i:04d}e", 1, " ".join(edited).upper() + "!"))
    boiler = " ".join(f"b{i}" for i in range(120))
    rows += [("chunk", f"hot{i:03d}", 1, boiler + " " + " ".join(rng.choice(vocabulary) for _ in range(220))) for i in range(hot)]
    return rows


def test_pairs_match_brute_force(spark):
    rows = corpus()
    got = {tuple(r) for r in n.similar_pairs(frame(spark, rows), 3, 0.55, 20).collect()}
    want = brute(rows, 3, 0.55, 20)
    assert len(want) > 50
    assert got <= want and len(got & want) / len(want) >= 0.97


@pytest.mark.parametrize(("heavy", "sampled"), [(1000, 32), (20, 1)])
def test_hot_bands_are_banded_again(spark, monkeypatch, heavy, sampled):
    monkeypatch.setattr(n, "HOT_BAND", 10)
    monkeypatch.setattr(n, "HEAVY", heavy)
    monkeypatch.setattr(n, "SAMPLED", sampled)
    rows = corpus(60, 5, hot=80)
    rows += [("chunk", "hot000e", 1, next(r[3] for r in rows if r[1] == "hot000") + " end"), ("chunk", "hot001e", 1, "start " + next(r[3] for r in rows if r[1] == "hot001"))]
    got = {tuple(r) for r in n.similar_pairs(frame(spark, rows), 3, 0.55, 20).collect()}
    want = brute(rows, 3, 0.55, 20)
    assert {("chunk", "hot000", "hot000e"), ("chunk", "hot001", "hot001e")} <= want
    assert got <= want and len(got & want) / len(want) >= 0.95


def test_copies(spark, monkeypatch):
    text = " ".join(f"x{i}" for i in range(30))
    rows = [("chunk", f"c{i}", 1, text) for i in range(5)] + [("chunk", "d", 1, text + " tail"), ("segment", "c0", 1, text)]
    got = {tuple(r) for r in n.similar_pairs(frame(spark, rows + rows[:2]), 3, 0.55, 20).collect()}
    assert got == brute(rows, 3, 0.55, 20) and len(got) == 15
    monkeypatch.setattr(n, "PAIRED_COPIES", 3)
    star = {tuple(r) for r in n.similar_pairs(frame(spark, rows), 3, 0.55, 20).collect()}
    assert star == {("chunk", "c0", f"c{i}") for i in range(1, 5)} | {("chunk", "c0", "d")}


def test_a_cluster_of_different_texts_keeps_all_its_links(spark, monkeypatch):
    monkeypatch.setattr(n, "HOT_BAND", 4)
    words = [f"q{i}" for i in range(300)]
    rows = [("chunk", f"s{i:02d}", 1, " ".join(words[:i] + ["other"] + words[i + 1 :])) for i in range(0, 90, 3)]
    got = {tuple(r) for r in n.similar_pairs(frame(spark, rows), 3, 0.55, 20).collect()}
    want = brute(rows, 3, 0.55, 20)
    assert len(want) == 30 * 29 // 2 and len(got & want) / len(want) >= 0.99


def test_groups(spark):
    words = [f"y{i}" for i in range(60)]
    chain = [("chunk", f"g{i}", 1, " ".join(words[i * 4 : i * 4 + 40])) for i in range(6)] + [("chunk", "lone", 1, " ".join(f"z{i}" for i in range(40)))]
    got = {r.key: (r.class_id, r.links) for r in n.similar_groups(frame(spark, chain), 3, 0.7, 20).collect()}
    assert {got[f"g{i}"][0] for i in range(6)} == {"g0"} and got["lone"] == ("lone", 0)
    assert got["g0"][1] == 1 and got["g3"][1] == 2


def test_sketch_estimates():
    rng = random.Random(1)
    base = [f"t{rng.randrange(10**9)}" for _ in range(900)]
    for shared in (300, 600, 850):
        a, b = " ".join(base), " ".join(base[:shared] + [f"u{rng.randrange(10**9)}" for _ in range(900 - shared)])
        at, sh, starts, _ = n.shingle_sets([a, b], 1, 1)
        r = n.sketches(sh, starts)
        j, _ = n.jaccard_estimate(r[:1], r[1:], np.array([900]), np.array([900]))
        assert abs(j[0] - shared / (1800 - shared)) < 0.15
        assert (n.densify(r) > 0).all()


def test_nulls_short_long_and_versions(spark):
    text = " ".join(f"x{i}" for i in range(30))
    long = " ".join(f"l{i}" for i in range(60_000))
    rows = [("chunk", "a", 1, text), ("chunk", "a", 2, "now another text " * 10), ("chunk", "b", None, text), ("chunk", "c", 1, text), (None, "d", 1, text), ("chunk", None, 1, text), ("chunk", "e", 1, None), ("chunk", "f", 1, ""), ("chunk", "g", 1, "few words"), ("chunk", "h", 1, long), ("chunk", "i", 1, long + " more")]
    assert {tuple(r) for r in n.similar_pairs(frame(spark, rows), 3, 0.55, 20).collect()} == {("chunk", "b", "c"), ("chunk", "h", "i")}


def test_empty_table(spark):
    assert n.similar_pairs(frame(spark, []), 3, 0.55, 20).count() == 0
    assert n.similar_groups(frame(spark, [])).count() == 0
