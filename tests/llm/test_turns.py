import re
from pyspark.sql import functions as F

from quern.llm import turns as t

UTT = "document_id string, utterance_id bigint, text string, start_sec double, end_sec double, speaker string, ingested_at int, label string, shard int, part string"
WRD = "document_id string, utterance_id bigint, pos int, word string, punctuated_word string, speaker string, start_sec double, end_sec double, type string, confidence double, label int, turned string"


def utterances(spark, rows):
    return spark.createDataFrame([(*r, *([1] * (7 - len(r))), "l", 2, "p") for r in rows], UTT)


def words(spark, rows):
    return spark.createDataFrame([(d, u, p, w, w, s, a, None if a is None else a + 0.2, k, 0.5, 1, "t") for d, u, p, w, s, a, k in rows], WRD)


def starts(spark, u, w=()):
    return {(r.document_id, r.first_utterance_id, r.first_pos, r.speaker) for r in t.turn_starts(utterances(spark, u), words(spark, list(w))).collect()}


def test_labels(spark):
    names = ["[Speaker 1]", "SPEAKER_01", "Speaker-1:", " 1 ", "spk1", "speaker_b", "spk B", "Speaker_B:", "?", "", "unknown", "UNKNOWN", "-1", None, "0", "00", "SPEAKER_10"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(names)], "i int, s string")
    assert [r[0] for r in df.orderBy("i").select(t.speaker_label(F.col("s"))).collect()] == ["1"] * 5 + ["B"] * 3 + [None] * 6 + ["0", "0", "10"]


def test_stamps_and_text_labels(spark):
    texts = ["<00:54> x", "[01:00:59]x", "(00:16) y", "02:00 - no", "plain 12:30 inside", "[crosstalk 00:12] z", "[Speaker 2] hi", ">> Speaker 0: a", "  SPEAKER 1 - can", "[00:10] [Speaker B] c", "the speaker 5 people"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, s string").orderBy("i")
    assert [r[0] for r in df.select(t.text_stamp(F.col("s"))).collect()] == [54, 3659, 16, 120, None, None, None, None, None, 10, None]
    assert [r[0] for r in df.select(t.text_label(F.col("s"))).collect()] == [None] * 6 + ["2", "0", "1", "B", None]


def test_noise_is_removed(spark):
    texts = ["um, [laughter] So uh the *sighs* plan", "(coughs) hmm", "äh [Musik]", "{beep} <noise>", "♪", "Human resources", "", None, "[Speaker 1] uh Who signed", "er ehm mhm"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, s string").orderBy("i")
    got = [r[0] for r in df.select(t.clean_text(F.col("s"))).collect()]
    assert got[0] == "So the plan" and got[5] == "Human resources" and got[8] == "Who signed"
    assert [bool(x and re.search(r"\w", x)) for x in got] == [True, False, False, False, False, True, False, False, True, False]


def test_noise_neither_starts_nor_breaks(spark):
    u = [("d", 9, "Hello", 0.0, 1.0, "0"), ("d", 2, "[laughter] uh", 1.5, 2.0, "1"), ("d", 5, "again", 2.5, 3.0, "speaker_0"), ("d", 1, "Yes", 4.0, 5.0, "SPEAKER_01"), ("d", 3, "(00:06) late", None, None, "?")]
    assert starts(spark, u) == {("d", 9, 0, "0"), ("d", 1, 0, "1"), ("d", 3, 0, "unknown")}


def test_words_divide_and_date(spark):
    u = [("d", 1, "a b c d", None, None, "A"), ("d", 2, "e", 1.0, 2.0, "B"), ("d", 3, "g", None, None, None)]
    w = [("d", 1, 0, "a", "spk A", 5.0, "word"), ("d", 1, 1, " ", None, None, "spacing"), ("d", 1, 2, "b", None, 5.2, "word"), ("d", 1, 3, " ", "B", None, "spacing"), ("d", 1, 4, "c", "Speaker B", 5.4, "word"), ("d", 1, 5, "d", "b", 5.6, "word"), ("d", 3, 0, "g", "c", 3.0, "word")]
    assert starts(spark, u, w + w[:3]) == {("d", 2, 0, "B"), ("d", 3, 0, "C"), ("d", 1, 0, "A"), ("d", 1, 4, "B")}


def test_label_precedence_versions_and_nulls(spark):
    u = [("d", 1, "[Speaker 3] x", 0.0, 1.0, "", 1), ("d", 2, "[Speaker 3] y", 1.0, 2.0, "2", 1), ("d", 2, "[laughter]", 1.0, 2.0, "2", 0), (None, 3, "z", 2.0, 3.0, "1", 1), ("d", None, "z", 2.0, 3.0, "1", 1), ("d", 4, None, 3.0, 4.0, "9", 1), ("d", 5, "", None, None, None, None), ("d", 6, "no time at all", None, None, "007", None)]
    assert starts(spark, u) == {("d", 1, 0, "3"), ("d", 2, 0, "2"), ("d", 6, 0, "7")}


def test_turns_cross_shards(spark):
    u = [("d", i, f"w{i}", i * 100.0, i * 100.0 + 5, "1" if i < 9 else "2") for i in range(12)]
    assert starts(spark, u) == {("d", 0, 0, "1"), ("d", 9, 0, "2")}
    texts = t.turn_texts(utterances(spark, u), words(spark, [])).orderBy("part", "first_utterance_id").collect()
    assert {r.first_utterance_id for r in texts} == {0, 9} and sum(r.n_pieces for r in texts) == 12
    assert " ".join(r.text for r in texts if r.first_utterance_id == 0) == " ".join(f"w{i}" for i in range(9))


def test_speech_without_times_is_spread_and_ordered(spark):
    u = [("d", i, f"w{i}", None, None, "1" if i < 1500 else "2") for i in (-2500, -1, 0, 1, 1499, 1500, 9000)] + [("d", 7, "first", 4.0, 5.0, "9")]
    assert starts(spark, u) == {("d", 7, 0, "9"), ("d", -2500, 0, "1"), ("d", 1500, 0, "2")}
    texts = t.turn_texts(utterances(spark, u), words(spark, [])).where("first_utterance_id = -2500").orderBy("part").collect()
    assert [r.part for r in texts] == [1, 2, 3, 4] and " ".join(r.text for r in texts) == "w-2500 w-1 w0 w1 w1499"


def test_words_that_speak(spark):
    df = spark.createDataFrame([(x,) for x in ("hello", "um", "Uh,", "[laughter]", "don't", "00:12", "A.", "...", "mhm", "hour", None)], "s string")
    assert [bool(r[0]) for r in df.select(t.word_speaks(F.col("s"))).collect()] == [bool(r[0]) for r in df.select(t.has_speech(t.clean_text(F.col("s")))).collect()]


def test_long_text_and_empty_tables(spark):
    assert starts(spark, [("d", 1, "word " * 50_000, 0.0, 1.0, "1")]) == {("d", 1, 0, "1")}
    assert starts(spark, []) == set()
    assert t.turn_texts(utterances(spark, []), words(spark, [])).count() == 0
