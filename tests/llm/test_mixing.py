import random
from itertools import combinations

import pytest

from pyspark.sql import functions as F

from quern.llm import mixing as m

DOCS = "doc_id bigint, text string, source string, slot int, block string, share double, `copy` int, n_tokens string"
TARGETS = "source string, target_share double, max_repeats int, block int"


def frames(spark, docs, targets):
    return spark.createDataFrame([(*d, 1, "b", 0.5, 2, "n") for d in docs], DOCS), spark.createDataFrame([(*t, 1) for t in targets], TARGETS)


def corpus():
    rng = random.Random(1)
    docs = [(i, "word " * rng.randint(5, 60), rng.choice(["Big Source", "BIG_SOURCE ", "big_source"])) for i in range(900)]
    docs += [(1000 + i, "word " * rng.randint(5, 60), "small") for i in range(120)]
    return docs + [(2000 + i, "word " * rng.randint(5, 60), "mid") for i in range(300)]


def test_shares_and_caps(spark):
    d, t = frames(spark, corpus(), [("big_source", 0.5, 1), ("SMALL", 0.3, 3), ("mid", 0.2, 2)])
    mix = m.mix_sources(d, t)
    report = {r.source: r for r in m.mix_report(mix, t).collect()}
    assert all(abs(r.actual_share - r.target_share) < 0.01 for r in report.values())
    assert report["big_source"].most_copies == 1 and report["small"].most_copies <= 3
    assert mix.groupBy("doc_id", "copy").count().where("count > 1").count() == 0
    assert report["small"].documents == 120  # the scarcest source is used up


def test_every_stretch_is_mixed(spark):
    d, t = frames(spark, corpus(), [("big_source", 0.5, 1), ("small", 0.3, 3), ("mid", 0.2, 2)])
    mix = m.mix_sources(d, t)
    last = mix.agg(F.max("slot")).collect()[0][0]
    for lo, hi in ((0, last // 2), (last // 2, last + 1)):
        part = {r.source: r.t for r in mix.where((F.col("slot") >= lo) & (F.col("slot") < hi)).groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
        assert abs(part["big_source"] / sum(part.values()) - 0.5) < 0.05


def test_cases(spark):
    docs = [(1, "a b c d", "x"), (2, None, "x"), (3, "", "x"), (4, "a b c d e", None), (None, "a b", "x"), (5, "other words here", "unlisted"), (6, "a b c d", "y"), (6, "a b c d", "y")]
    d, t = frames(spark, docs[:7], [("x", 0.5, 1), ("y", 0.5, None), ("z", 0.3, 2), ("bad", None, 1), (None, 0.1, 1), ("neg", -1.0, 1)])
    got = m.mix_sources(d, t).collect()
    assert {r.doc_id for r in got} == {1, 6} and all(r.copy == 0 for r in got)
    report = {r.source: r for r in m.mix_report(m.mix_sources(d, t), t).collect()}
    assert report["z"].tokens == 0 and report["z"].actual_share == 0
    for docs_, targets in (([], [("x", 1.0, 1)]), (docs[:1], [])):
        assert m.mix_sources(*frames(spark, docs_, targets)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_nearest_subset_against_brute_force(seed):
    rng = random.Random(seed)
    sizes, wanted = [rng.randint(1, 400) for _ in range(9)], [rng.random() < 0.5 for _ in range(9)]
    target = rng.uniform(0, 1500)
    best = min(abs(sum(c) - target) for n in range(10) for c in combinations(sizes, n))
    assert abs(sum(sizes[i] for i in m.nearest_subset(sizes, wanted, target)) - target) == pytest.approx(best)


def test_few_documents_come_as_near_as_any_choice(spark):
    sizes = {"few": [120, 174, 239, 736, 90], "one": [2000], "two": [700, 541]}
    docs = [(100 * i + j, "word " * n, s) for i, (s, ns) in enumerate(sizes.items()) for j, n in enumerate(ns)] + [(1000 + i, "word " * 40, "big") for i in range(200)]
    d, t = frames(spark, docs, [("few", 0.1, 1), ("one", 0.05, 1), ("two", 0.05, 1), ("big", 0.8, 1)])
    sel = m.mix_sources(d, t)
    counts = {r.doc_id: r.n_tokens for r in m.with_token_counts(d, ["doc_id"], "text").collect()}
    budget = min(sum(counts[x[0]] for x in docs if x[2] == s) / share for s, share in (("few", 0.1), ("one", 0.05), ("two", 0.05), ("big", 0.8)))
    got = {r.source: r.t for r in sel.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    for s, share in (("few", 0.1), ("one", 0.05), ("two", 0.05)):
        mine = [counts[x[0]] for x in docs if x[2] == s]
        best = min(abs(sum(c) - budget * share) for n in range(len(mine) + 1) for c in combinations(mine, n))
        assert abs(got.get(s, 0) - budget * share) == pytest.approx(best, abs=1e-6), s


def test_large_documents_do_not_spoil_shares(spark):
    docs = corpus() + [(9000, "word " * 60_000, "big_source"), (9001, "word " * 20_000, "small")]
    d, t = frames(spark, docs, [("big_source", 0.6, 1), ("small", 0.1, 1), ("mid", 0.3, 1)])
    report = m.mix_report(m.mix_sources(d, t), t).collect()
    assert all(abs(r.actual_share - r.target_share) < 0.02 for r in report)
