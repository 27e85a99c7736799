import os
import sys

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quern.llm import toxicity as x
from quern.llm.voters import CLASSES, VOTERS, votes

sys.path.insert(0, os.path.dirname(__file__))
import toxic_sentences as apart  # noqa: E402

SCHEMA = "doc_id bigint, text string, source string, score int, passage string, flagged int"
PLAIN = ["The valve was checked in March and the pump was replaced.", "Figure 12 compares load with baseline values.", "La section 12 traite de la pompe.", "Die Pumpe wurde im Mai geliefert."]
BAD = ["You are a stupid moron and everyone knows it.", "Foreigners are vermin and should be driven out.", "Send me your nudes and I will approve the order.", "I hope you choke on your report, you pathetic liar.", "Du bist ein elender Idiot, halt endlich die Fresse.", "Tu es un pauvre con, ferme ta gueule.", "Eres un imbécil de mierda, cállate ya.", "Watch your back, Sam, accidents happen near the crane."]
CLEAN = ["The moderation policy bans insults, threats and hate speech.", "Kill the stuck process and abort the job before it restarts.", "The breast screening was moved to August.", "This damn printer crashed twice, please help.", "What a stupid mistake of mine, I forgot the key.", "Use a male and a female connector.", "Refugees and immigrants receive the leaflet in 30 languages."]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "p", 0) for i, t, s in rows], SCHEMA)


@pytest.mark.parametrize(
    ("disguised", "plain"),
    [("mоrоn", "moron"), ("m0r0n", "moron"), ("m o r o n", "moron"), ("m.o.r.o.n.", "moron"), ("m_o_r_o_n", "moron"), ("morrrrron", "moron"), ("p4ra$!te", "parasite"), ("ver­min", "vermin"), ("fvck", "fuck"), ("1mbéc1l", "imbécil"), ("Fresssssse", "fresse")],
)
def test_disguises(disguised, plain):
    assert plain in x.undisguised(x.plain_letters(f"you {disguised} there"))


def test_stars_stand_for_a_word_of_that_shape():
    assert set(x.undisguised("you w*******s there").split()) & CLASSES["slur"]


def test_plain_texts_are_left_alone():
    for text in ("grade: h2o, code: TU-3665, a1, b5", "the book, a b c list", "see 333 pages", "cooperation"):
        assert x.undisguised(text.lower()) == text.lower()


def test_voters_and_classifier(spark):
    rows = [(i, PLAIN[i % 4], "s") for i in range(40)]
    rows += [(100 + i, f"{PLAIN[i % 4]} {b} {PLAIN[0]}", "Bad Source") for i, b in enumerate(BAD * 3)] + [(200 + i, f"{PLAIN[1]} {c}", "clean") for i, c in enumerate(CLEAN * 4)]
    got = {r.doc_id: r for r in x.score_documents(frame(spark, rows)).collect()}
    assert all(got[100 + i].flagged for i in range(len(BAD) * 3))
    assert [(i, r.score) for i, r in got.items() if r.flagged and not 100 <= i < 200] == []
    rates = {r.source: r for r in x.rates_by_source(x.score_documents(frame(spark, rows))).collect()}
    assert rates["bad_source"].rate == 1.0 and rates["clean"].flagged == 0 and rates["s"].documents == 40


def test_sentences_written_apart():
    """Recall and precision on sentences from no table, after fitting on a table."""
    source = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(source):
        pytest.skip("no tables")
    held = sorted({s for t in pq.read_table(source, columns=["text"]).column(0).to_pylist() if t for s in x.sentences(t)})
    weights, bias = x.fit(held)
    bad, good = (np.array([x.score_sentences(x.sentences(t), weights, bias).max() for _, t in apart.lines(block)]) >= x.FLAGGED for block in (apart.ABUSIVE, apart.CLEAN))
    assert bad.mean() >= 0.85 and bad.sum() / (bad.sum() + good.sum()) >= 0.9


def test_gates_let_every_match_through():
    for _, t in apart.lines(apart.ABUSIVE) + apart.lines(apart.CLEAN):
        s = " ".join(x.undisguised(q) for q in x.sentences(t))
        tried = {j for _, j in x.featured([s])[2].tolist()}
        assert {j for j, v in enumerate(votes(s)) if v > 0} == {j for j in tried if VOTERS[j].vote > 0}, t


def test_sentences():
    assert x.sentences("One line\r\ngoes on. Next\nRow 3\n\nlast") == ["one line goes on.", "next", "row 3", "last"]
    long = x.sentences("word " * 400)
    assert len(long) > 3 and max(map(len, long)) <= x.MAX_SENTENCE and all(a[x.MAX_SENTENCE // 2 :].strip() in b for a, b in zip(long, long[1:], strict=False))
    assert x.sentences("") == [] and x.sentences(" . ") == []


def test_label_model_finds_the_bad_voter():
    rng = np.random.default_rng(1)
    truth = rng.random(2000) < 0.4
    good = [np.where(rng.random(2000) < 0.9, truth, ~truth) for _ in range(4)]
    bad = rng.random(2000) < 0.5
    matrix = np.stack([np.where(v, 1, -1) * (rng.random(2000) < 0.7) for v in [*good, bad]], axis=1).astype(float)
    posterior, accuracy, _ = x.fit_label_model(matrix)
    heard = (matrix > 0).any(axis=1)
    assert accuracy[:4].min() > 0.8 and accuracy[4] < 0.75
    assert ((posterior > 0.5) == truth)[heard].mean() > 0.9


def test_label_model_finds_dependent_voters():
    rng = np.random.default_rng(2)
    truth = rng.random(4000) < 0.5
    fire = lambda good, bad: np.where(truth, rng.random(4000) < good, rng.random(4000) < bad)
    first = fire(0.5, 0.1)
    copy = first & (rng.random(4000) < 0.95)
    matrix = np.stack([first, copy, fire(0.5, 0.1), fire(0.5, 0.1), -1 * ~fire(0.5, 0.1)], axis=1).astype(float)
    parent = x.fit_label_model(matrix)[2]
    assert parent.get(1) == 0 or parent.get(0) == 1


def test_cases(spark):
    rows = [(1, None, "s"), (2, "", "s"), (None, BAD[0], "s"), (3, "calm words " * 100_000 + BAD[0], None), (4, BAD[0], "s"), (4, PLAIN[0], "s"), (5, BAD[0].upper(), "S ")]
    got = {r.doc_id: r for r in x.score_documents(frame(spark, rows)).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and got[1].score == got[2].score == 0
    assert got[3].flagged and got[4].flagged and got[5].flagged and got[5].source == "s" and got[3].source is None
    assert x.score_documents(frame(spark, [])).count() == 0
    assert x.scored_documents(frame(spark, [(1, PLAIN[0], "s")])).where(F.col("score") >= x.FLAGGED).count() == 0
