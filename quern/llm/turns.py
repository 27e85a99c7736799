"""Speech transcripts into clean, ordered speaker turns.

Fields (stamps, labels, hesitations, sound annotations) are taken out of the text with SQL expressions, speakers of
words are forward-filled by windows, marked noise is removed, and consecutive pieces of one speaker are
aggregated by gaps-and-islands identifiers. Windows over a recording have two levels (see ``runtime.carry``): rows
are sorted within five-minute shards (speech without any time by ranges of its ids), and shards hand their last speaker on, so a
recording that holds a third of all rows is spread over its shards. The pieces are written once, and all windows read them there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.operators.latest import latest_rows
from quern.runtime import carry, cut_lineage

SHARD_S, SHARD_IDS = 300.0, 1000
#: Where no time is known at all, speech comes last in its recording.
LAST_S = 1e9

# How transcription services spell labels, stamps, annotations and hesitations.
SPEAKER_WORD = r"(?:speaker|spk|sprecher|sprecherin|locuteur|intervenant|hablante|orador)"
LABEL = rf"(?i)^\W*(?:{SPEAKER_WORD})?[\s_\-]*(\d+|[a-z])\W*$"
NO_LABEL = r"^\s*-\s*\d+\s*$"
TEXT_LABEL = rf"(?i)(?:>>\s*)?\[?\s*\b{SPEAKER_WORD}[\s_\-]*(\d{{1,4}}|[a-z])\s*(?:\]\s*:?|:|\s-\s)"
STAMP = r"(?:\d{1,3}:)?\d{1,2}:\d{2}(?:[.,]\d{1,3})?"
BRACKETED_STAMP = rf"[\[(<{{]\s*{STAMP}\s*[\])>}}]"
LEADING_STAMP = rf"^\s*{STAMP}\s*(?:-|–|—|:)?\s"
ANNOTATION = r"\[[^\[\]]{0,80}\]|\([^()]{0,80}\)|<[^<>]{0,80}>|\{[^{}]{0,80}\}|\*[^*\n]{1,80}\*|[♪♫#]+"
HESITATION = r"(?iU)(?<![\w'’-])(?:u+h*m*h*|e+r+m*|e+h*m+|e+h+|h+m+|m+h+m*|m{2,}|a+h+m*|ä+h*m*|ö+h*m*|e+u+h*|h+e+u+|h+u+m+|o+h+m*)(?![\w'’-])[.,…!?]*"


def speaker_label(c: Column) -> Column:
    """Bare number without leading zeros or bare capital letter; null if the label names nobody."""
    bare = F.regexp_extract(c, LABEL, 1)
    plain = F.upper(F.regexp_replace(bare, r"^0+(?=\d)", ""))
    return F.when(c.isNotNull() & ~c.rlike(NO_LABEL) & (bare != ""), plain)


def text_label(c: Column) -> Column:
    bare = F.regexp_extract(c, TEXT_LABEL, 1)
    return F.when(bare != "", F.upper(F.regexp_replace(bare, r"^0+(?=\d)", "")))


def text_stamp(c: Column) -> Column:
    """Seconds of the first stamp, bracketed or at the text's start; null if there is none."""
    first = F.coalesce(F.nullif(F.regexp_extract(c, rf"[\[(<{{]\s*({STAMP})\s*[\])>}}]", 1), F.lit("")), F.nullif(F.regexp_extract(c, rf"^\s*({STAMP})\s*(?:-|–|—|:)?\s", 1), F.lit("")))
    parts = F.transform(F.split(F.translate(first, ",", "."), ":"), lambda x: x.cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda acc, x: acc * 60 + x)


def clean_text(c: Column) -> Column:
    """The words spoken: without stamps, labels, annotations and hesitations, white space collapsed."""
    for pattern in (BRACKETED_STAMP, LEADING_STAMP, TEXT_LABEL, LEADING_STAMP, r"^\s*>>", ANNOTATION, HESITATION):
        c = F.regexp_replace(c, pattern, " ")
    c = F.regexp_replace(c, r"\s+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\s+([.,;:!?…])", "$1"), r"^[\s.,;:!?…\-–—]+", ""))


def has_speech(c: Column) -> Column:
    return F.coalesce(c.rlike(r"[\p{L}\p{N}]"), F.lit(False))


#: A word of letters and digits with punctuation behind it, which holds nothing to take out unless it is a hesitation.
PLAIN_WORD = r"^[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*[.,;:!?…]*$"
#: Letters of which all hesitations consist; other words need no further look.
NO_HESITATION = r"(?iU)[^uhermaäöo.,…!?]"


def word_speaks(c: Column) -> Column:
    """Whether a word is more than noise: what :func:`clean_text` leaves of it holds a letter or digit."""
    return F.when(c.rlike(PLAIN_WORD) & c.rlike(NO_HESITATION), F.lit(True)).otherwise(has_speech(clean_text(c)))


def speech_pieces(utterances: DataFrame, words: DataFrame) -> DataFrame:
    """One row per stretch of an utterance by one speaker that holds speech:
    (document_id, utterance_id, first_pos, start_sec, end_sec, speaker, text)."""
    utt = latest_rows(utterances, ["document_id", "utterance_id"], "ingested_at", ["document_id", "utterance_id", "text", "start_sec", "end_sec", "speaker"])
    utt = utt.select("document_id", "utterance_id", "text", F.when(~F.isnan("start_sec"), F.col("start_sec")).alias("u_start"), F.when(~F.isnan("end_sec"), F.col("end_sec")).alias("u_end"), speaker_label(F.col("speaker")).alias("u_label"), text_label(F.col("text")).alias("t_label"), text_stamp(F.col("text")).alias("stamp"), clean_text(F.col("text")).alias("clean"))

    cols = ["word", "punctuated_word", "speaker", "start_sec", "end_sec", "type"]
    known = words.where("document_id is not null and utterance_id is not null and pos is not null")
    once = known.groupBy("document_id", "utterance_id", "pos").agg(F.max(F.struct(*cols)).alias("w")).select("document_id", "utterance_id", "pos", "w.*")
    spoken = once.where("coalesce(type, 'word') <> 'spacing'").withColumn("label", speaker_label(F.col("speaker")))
    shown = F.coalesce("punctuated_word", "word")
    noise = (F.coalesce("type", F.lit("word")) == "audio_event") | ~word_speaks(shown)
    order = Window.partitionBy("document_id", "utterance_id").orderBy("pos")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    spoken = spoken.withColumn("turned", F.coalesce(F.col("label") != F.last("label", True).over(before), F.lit(False)).cast("int"))
    spoken = spoken.withColumn("part", F.sum("turned").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~noise, F.struct("pos", shown.alias("s"))))), lambda x: x["s"]), " ")
    parts = spoken.groupBy("document_id", "utterance_id", "part").agg(F.min("pos").alias("pos"), F.min("start_sec").alias("w_start"), F.max("end_sec").alias("w_end"), F.first("label", True).alias("w_label"), said.alias("said"))
    whole = Window.partitionBy("document_id", "utterance_id")
    parts = parts.withColumns({"n_parts": F.count(F.lit(1)).over(whole), "first_start": F.min("w_start").over(whole)})

    both = utt.join(parts, ["document_id", "utterance_id"], "left")
    divided = F.coalesce(F.col("n_parts") > 1, F.lit(False))
    text = F.when(divided | ~has_speech(F.col("clean")) & F.col("text").isNull(), F.col("said")).otherwise(F.col("clean"))
    pieces = both.select(
        "document_id",
        "utterance_id",
        F.when(divided & (F.col("part") > 0), F.col("pos")).otherwise(F.lit(0)).cast("int").alias("first_pos"),
        F.coalesce("u_start", "first_start", "stamp", F.lit(LAST_S)).alias("start_sec"),
        F.when(divided, F.coalesce("w_end", "u_end")).otherwise(F.coalesce("u_end", "w_end")).alias("end_sec"),
        F.when(divided, F.coalesce("w_label", "u_label")).otherwise(F.coalesce("u_label", "w_label", "t_label")).alias("label"),
        text.alias("text"),
    )
    return pieces.where(has_speech(F.col("text"))).select("document_id", "utterance_id", "first_pos", "start_sec", "end_sec", F.coalesce("label", F.lit("unknown")).alias("speaker"), "text")


def _marked(pieces: DataFrame) -> tuple[DataFrame, list[str]]:
    order = ["start_sec", "utterance_id", "first_pos"]
    timed = F.col("start_sec") < LAST_S
    shards = pieces.withColumn("shard", F.struct((~timed).alias("last"), F.when(timed, F.floor(F.col("start_sec") / SHARD_S)).otherwise(F.floor(F.col("utterance_id") / SHARD_IDS)).alias("at")))
    back = carry(shards, ["document_id"], "shard", order, "speaker", "previous", inclusive=False)
    return back.withColumn("opens", F.coalesce(F.col("speaker") != F.col("previous"), F.lit(True))), order


def turn_starts(utterances: DataFrame, words: DataFrame) -> DataFrame:
    """One row per clean turn: (document_id, first_utterance_id, first_pos, speaker).

    Rows without document_id or utterance_id take no part; of repeated rows the latest counts once; utterances
    without any speech neither start nor break a turn; without any known time they come last; without any label
    the speaker is ``unknown``. Empty tables give an empty result; further columns aren't read."""
    marked, _ = _marked(cut_lineage(speech_pieces(utterances, words).drop("text", "end_sec")))
    return marked.where("opens").select("document_id", F.col("utterance_id").alias("first_utterance_id"), "first_pos", "speaker")


def turn_texts(utterances: DataFrame, words: DataFrame) -> DataFrame:
    """The turns with their text, one row per turn and shard that it touches; ``part`` counts a turn's rows in order:
    (document_id, first_utterance_id, first_pos, part, speaker, start_sec, end_sec, n_pieces, text).

    A turn is thus whole in its rows' order, and no turn, however long, is gathered in one task."""
    marked, order = _marked(cut_lineage(speech_pieces(utterances, words)))
    marked = cut_lineage(marked).withColumn("own", F.when(F.col("opens"), F.struct("utterance_id", "first_pos"))).drop("previous")
    turns = carry(marked, ["document_id"], "shard", order, "own", "turn", inclusive=True)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "text"))), lambda x: x["text"]), " ")
    keys = [F.col("document_id"), F.col("turn.utterance_id").alias("first_utterance_id"), F.col("turn.first_pos").alias("first_pos"), F.col("shard"), F.col("speaker")]
    rows = turns.groupBy(*keys).agg(F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), F.count(F.lit(1)).alias("n_pieces"), text.alias("text"))
    w = Window.partitionBy("document_id", "first_utterance_id", "first_pos").orderBy("shard")  # one row per shard
    return rows.select("document_id", "first_utterance_id", "first_pos", F.row_number().over(w).alias("part"), "speaker", "start_sec", "end_sec", "n_pieces", "text")
