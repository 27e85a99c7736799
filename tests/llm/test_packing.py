import random

import pytest
from pyspark.sql import functions as F

from quern.llm import packing as p
from quern.llm import tokens

SCHEMA = "doc_id bigint, n bigint, length string, container int, rank string, `key` string, piece string, offset int"


def frame(spark, sizes):
    return spark.createDataFrame([(i, n, "l", 1, "r", "k", "p", 2) for i, n in enumerate(sizes)], SCHEMA)


def test_best_fill_is_optimal():
    rng = random.Random(1)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 4) for _ in range(rng.randint(1, 6))}
        room = rng.randint(0, 60)
        sums = {0}
        for x, n in counts.items():
            sums = {s + x * k for s in sums for k in range(n + 1)}
        chosen = p.best_fill(dict(counts), room)
        assert sum(x * k for x, k in chosen.items()) == max(s for s in sums if s <= room)
        assert all(k <= counts[x] for x, k in chosen.items())


def test_histogram_uses_every_item_once():
    rng = random.Random(2)
    histogram = {rng.randint(1, 100): rng.randint(1, 50) for _ in range(40)}
    used: dict[int, int] = {}
    for often, pattern in p.pack_histogram(histogram, 100):
        assert sum(x * k for x, k in pattern.items()) <= 100
        for x, k in pattern.items():
            used[x] = used.get(x, 0) + often * k
    assert used == histogram


@pytest.mark.parametrize("sizes", [[], [0], [0, 0, 5], [10] * 40, [11], [25, 3, 7, None, 10, 0, 1]])
def test_assignment(spark, sizes):
    out = p.fill_containers(frame(spark, sizes), "doc_id", "n", 10).collect()
    total: dict[str, int] = {}
    for r in out:
        total[r.container] = total.get(r.container, 0) + r.length
    assert all(v <= 10 for v in total.values())
    by_doc = {}
    for r in sorted(out, key=lambda r: r.offset):
        assert by_doc.get(r.doc_id, 0) == r.offset
        by_doc[r.doc_id] = r.offset + r.length
    assert by_doc == {i: n or 0 for i, n in enumerate(sizes)}


def test_no_worse_than_best_fit_with_a_hot_length(spark):
    rng = random.Random(3)
    sizes = [37] * 700 + [rng.randint(1, 100) for _ in range(1400)]
    out = p.fill_containers(frame(spark, sizes), "doc_id", "n", 100)
    report = p.fill_report(out, 100).collect()[0]
    room: list[int] = []
    for n in sorted(sizes, reverse=True):  # best fit decreasing
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= n
        else:
            room.append(100 - n)
    assert report.tokens == sum(sizes) and report.containers <= len(room)
    assert out.groupBy("container").agg(F.sum("length").alias("s")).where("s > 100").count() == 0
    assert out.select("doc_id", "piece").distinct().count() == out.count() == len(sizes)


def test_whole_texts_are_counted(spark):
    texts = [(1, "hello world"), (2, None), (3, ""), (4, "word " * 100_000), (None, "x"), (5, "<|endoftext|>")]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = {r.doc_id: r.n_tokens for r in p.token_items(df, "doc_id", "text").collect()}
    assert got == {i: tokens.count_tokens(t) for i, t in texts if i is not None} and got[4] >= 100_000 and got[2] == got[3] == 0
