"""Chunking: recursive splitting, row clustering, greedy packing of ordered pieces, and transcript rendering."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Separators for prose, and per language the starts of definitions before the prose ones.
PROSE = ["\n\n", "\n", ".", " ", ""]
LANGUAGE_SEPARATORS: dict[str, list[str]] = {
    "python": ["\nclass ", "\ndef ", "\n\tdef "],
    "js": ["\nfunction ", "\nconst ", "\nlet ", "\nvar ", "\nclass "],
    "go": ["\nfunc ", "\nvar ", "\nconst ", "\ntype "],
    "java": ["\nclass ", "\npublic ", "\nprotected ", "\nprivate ", "\nstatic "],
    "markdown": ["\n# ", "\n## ", "\n### ", "\n#### "],
}
CHUNK_SIZE, CHUNK_OVERLAP = 1500, 200


def separators(language: str | None) -> list[str]:
    return [*LANGUAGE_SEPARATORS.get(language or "", []), *(PROSE if not language else ["\n\n", "\n", " ", ""])]


def recursive_split(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, marks: list[str] | None = None) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the coarsest separator that occurs, each beginning with up to ``overlap``
    characters of whole parts of the one before. Separators stay with the part that follows them."""
    marks = PROSE if marks is None else marks
    here = next((i for i, m in enumerate(marks) if not m or m in text), None)
    if here is None:
        return [text.strip()] if text.strip() else []
    mark, finer = marks[here], marks[here + 1 :]
    parts = list(text) if not mark else [p for p in re.split(f"(?={re.escape(mark)})", text) if p]
    out: list[str] = []
    held: list[str] = []
    total = 0

    def emit() -> None:
        piece = "".join(held).strip()
        if piece:
            out.append(piece)

    for part in parts:
        if len(part) > size:
            if held:
                emit()
                held, total = [], 0
            if finer:
                out += recursive_split(part, size, overlap, finer)
            else:
                out.append(part)
            continue
        if held and total + len(part) > size:
            emit()
            while held and (total > overlap or total + len(part) > size):
                total -= len(held.pop(0))
        held.append(part)
        total += len(part)
    if held:
        emit()
    return out


def split_texts(df: DataFrame, key: str, text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, language: str | None = None) -> DataFrame:
    """(key, piece, text) of every text, whole."""
    import pandas as pd

    marks = separators(language)
    pieces = F.pandas_udf(lambda s: pd.Series([recursive_split(t, size, overlap, marks) if t else [] for t in s], dtype=object), "array<string>")
    return df.select(F.col(key).alias("key"), F.posexplode(pieces(F.col(text))).alias("piece", "text"))


SENTENCE_CHARS, SENTENCE_OVERLAP = 1000, 100
_SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?]+|\n|$)\s*")


def sentence_pieces(text: str, size: int = SENTENCE_CHARS, overlap: int = SENTENCE_OVERLAP) -> list[str]:
    """Whole sentences packed into pieces of at most ``size`` characters, each beginning with the last sentences of the one before that
    together have at most ``overlap`` characters. A sentence longer than ``size`` is a piece of its own, cut into such lengths."""
    parts = []
    for s in (m.group() for m in _SENTENCE.finditer(text) if m.group()):
        parts += [s[i : i + size] for i in range(0, len(s), size)]
    out: list[str] = []
    held: list[str] = []
    for part in parts:
        if held and sum(map(len, held)) + len(part) > size:
            out.append("".join(held))
            back: list[str] = []
            for s in reversed(held):
                if sum(map(len, back)) + len(s) > overlap or sum(map(len, back)) + len(s) + len(part) > size:
                    break
                back.insert(0, s)
            held = back
        held.append(part)
    if held:
        out.append("".join(held))
    return [p.strip() for p in out if p.strip()]


def sentence_chunks(df: DataFrame, key: str, text: str, title: str) -> DataFrame:
    """(key, chunk, text) of every text in sentence pieces, with the title on a line before a piece that doesn't hold it; a null or
    blank title adds nothing, null and blank texts give no chunk."""
    import pandas as pd

    pieces = F.pandas_udf(lambda s: pd.Series([sentence_pieces(t) if t else [] for t in s], dtype=object), "array<string>")
    cut = df.select(F.col(key).alias("key"), F.trim(F.coalesce(F.col(title), F.lit(""))).alias("__h"), F.posexplode(pieces(F.col(text))).alias("chunk", "text"))
    bare = (F.col("__h") == "") | F.contains("text", "__h")
    return cut.select("key", "chunk", F.when(bare, F.col("text")).otherwise(F.concat("__h", F.lit("\n"), "text")).alias("text"))


_TERM = re.compile(r"(?u)\b\w\w+\b")


def row_clusters(texts: list[str], group_size: int, seed: int = 42, terms: int = 1000) -> np.ndarray:
    """k-means labels of rows by the cosine of their weighted terms; k is the rounded (half to even) number of groups."""
    import unicodedata

    k = max(1, round(len(texts) / group_size))
    if k == 1:
        return np.zeros(len(texts), dtype=int)
    plain = ["".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c)) for t in texts]
    docs = [_TERM.findall(t) for t in plain]
    total: dict[str, int] = {}
    for d in docs:
        for w in d:
            total[w] = total.get(w, 0) + 1
    vocabulary = {w: i for i, w in enumerate(sorted(sorted(total), key=lambda w: -total[w])[:terms])}
    x = np.zeros((len(docs), max(1, len(vocabulary))))
    for i, d in enumerate(docs):
        for w in d:
            if w in vocabulary:
                x[i, vocabulary[w]] += 1
    df = (x > 0).sum(axis=0)
    x = np.where(x > 0, 1 + np.log(np.maximum(x, 1)), 0) * (np.log((1 + len(docs)) / (1 + df)) + 1)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    rng = np.random.default_rng(seed)
    best, labels = np.inf, np.zeros(len(docs), dtype=int)
    for _ in range(5):
        centres = x[rng.permutation(len(docs))[:k]].copy()
        own = labels
        for _ in range(25):
            own = (x @ centres.T - 0.5 * (centres**2).sum(axis=1)).argmax(axis=1)
            moved = np.zeros_like(centres)
            np.add.at(moved, own, x)
            size = np.bincount(own, minlength=k)
            moved[size > 0] /= size[size > 0, None]
            moved[size == 0] = centres[size == 0]
            if np.allclose(moved, centres):
                break
            centres = moved
        inertia = float(((x - centres[own]) ** 2).sum())
        if inertia < best:
            best, labels = inertia, own
    return labels


def cluster_rows(df: DataFrame, scope: list[str], row: str, terms: str, group_size: int) -> DataFrame:
    """Rows with a ``cluster`` label within their buffer (``scope``), which bounds what a task clusters at once."""
    kinds = df.select(*scope, row).schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds)

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by(row)
        labels = row_clusters([t or "" for t in table.column(terms).to_pylist()], group_size)
        return table.select([*scope, row]).append_column("cluster", pa.array(labels, pa.int32()))

    return df.select(*scope, row, terms).groupBy(*scope).applyInArrow(one, ddl + ", cluster int")


def greedy_packs(df: DataFrame, scope: list[str], order: list[str], limits: dict[str, float], glue: str | None = None) -> DataFrame:
    """Adds ``pack``: consecutive rows of a scope in order, a new pack where a row would bring one of the sums of ``limits`` (column ->
    greatest sum) over it and the pack isn't empty, but never between rows of equal, non-null ``glue``.

    A scope is a recording slice or an input buffer, which is bounded; rows stream through, sorted within partitions, and only
    the running sums are held. Null amounts count as 0."""
    weights = list(limits)
    held = df.withColumns({f"__w{i}": F.coalesce(F.col(w).cast("double"), F.lit(0.0)) for i, w in enumerate(weights)} | {"__glue": F.col(glue).cast("string") if glue else F.lit(None).cast("string")})
    kept = df.columns
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", pack int"
    caps = [float(limits[w]) for w in weights]
    places = [kept.index(s) for s in scope]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums, pack, filled, stuck = None, [0.0] * len(caps), 0, False, None
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in places), strict=True))
            amounts = list(zip(*(batch.column(len(kept) + i).to_pylist() for i in range(len(caps))), strict=True))
            packs = []
            for key, amount, g in zip(keys, amounts, batch.column(len(kept) + len(caps)).to_pylist(), strict=True):
                if key != at:
                    at, sums, pack, filled, stuck = key, [0.0] * len(caps), 0, False, None
                if filled and any(s + a > c for s, a, c in zip(sums, amount, caps, strict=True)) and not (g is not None and g == stuck):
                    sums, pack = [0.0] * len(caps), pack + 1
                sums, filled, stuck = [s + a for s, a in zip(sums, amount, strict=True)], True, g
                packs.append(pack)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(packs, pa.int32())], names=[*kept, "pack"])

    return held.repartition(*scope).sortWithinPartitions(*scope, *order).mapInArrow(run, ddl)


def clock(seconds: Column) -> Column:
    """mm:ss, or hh:mm:ss from an hour on; ``--:--`` for null."""
    s = F.floor(seconds).cast("int")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    short = F.concat(two(F.floor(s / 60)), F.lit(":"), two(s % 60))
    long = F.concat(two(F.floor(s / 3600)), F.lit(":"), two(F.floor(s % 3600 / 60)), F.lit(":"), two(s % 60))
    return F.when(s.isNull(), "--:--").when(s >= 3600, long).otherwise(short)


def speaker_blocks(df: DataFrame, scope: list[str], order: list[str], speaker: str, text: str, start: str, end: str) -> DataFrame:
    """Consecutive rows of one speaker as one block: (scope, block, speaker, start, end, n, text with its header line)."""
    w = Window.partitionBy(*scope).orderBy(*order)
    who = F.coalesce(F.col(speaker), F.lit("unknown"))
    marked = df.withColumn("__who", who).withColumn("__new", F.coalesce(F.col("__who") != F.lag("__who").over(w), F.lit(True)).cast("int"))
    numbered = marked.withColumn("block", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("__t"))))
    blocks = numbered.groupBy(*scope, "block", "__who").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count(F.lit(1)).alias("n"), F.array_join(F.transform(rows, lambda x: x["__t"]), " ").alias("said"))
    name = F.regexp_replace("__who", "^speaker_", "")
    header = F.concat(F.lit("[Speaker "), name, F.lit(" | "), clock(F.col("start")), F.lit(" - "), clock(F.col("end")), F.lit("]"))
    return blocks.select(*scope, "block", name.alias("speaker"), "start", "end", "n", F.concat(header, F.lit("\n"), F.coalesce("said", F.lit(""))).alias("text"))


def core_window(df: DataFrame, start: str, end: str, overlap: float, core: float, offset: Column) -> DataFrame:
    """Segments that begin in a slice's core, moved to the time of the whole recording."""
    inside = df.where((F.col(start) >= overlap) & (F.col(start) < overlap + core))
    return inside.withColumns({start: F.col(start) - overlap + offset, end: F.col(end) - overlap + offset})


def drop_repeated_speech(df: DataFrame, scope: list[str], order: list[str], text: str, out: str = "fresh") -> DataFrame:
    """Transcripts of overlapping segments without what the segment before already had: equal to it or contained in it
    blank, an extension of it its tail. The segment before is the last one whose own transcript isn't blank."""
    said = F.trim(F.coalesce(F.col(text), F.lit("")))
    w = Window.partitionBy(*scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col("__said") != "", F.col("__said")), True).over(w)
    held = df.withColumn("__said", said).withColumn("__before", F.coalesce(before, F.lit("")))
    fresh = (
        F.when(F.col("__before") == "", F.col("__said"))
        .when(F.contains("__before", "__said"), "")
        .when(F.startswith("__said", "__before"), F.trim(F.substr(F.col("__said"), F.length("__before") + 1)))
        .otherwise(F.col("__said"))
    )
    return held.withColumn(out, fresh).drop("__said", "__before")


def render_segments(labels: dict[str, str]) -> Column:
    """``Label: value`` lines of the columns that hold something, in the given order."""
    return F.concat_ws("\n", *[F.when(F.trim(F.col(c)) != "", F.concat(F.lit(f"{label}: "), F.trim(F.col(c)))) for c, label in labels.items()])


def words_to_utterances(words: DataFrame, scope: list[str], speaker: str, end_utterance: str | None = None) -> DataFrame:
    """Words as utterances of one speaker each: spacing dropped, missing labels taken from the word before, islands of one label
    joined: (scope, part, speaker, first_pos, start_sec, end_sec, n_words, text, confidence)."""
    spoken = words.where(F.coalesce("type", F.lit("word")) != "spacing")
    w = Window.partitionBy(*scope).orderBy("pos")
    filled = spoken.withColumn("__who", F.coalesce(F.last(F.col(speaker), True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit("unknown")))
    marked = filled.withColumn("__new", F.coalesce(F.col("__who") != F.lag("__who").over(w), F.lit(True)).cast("int"))
    numbered = marked.withColumn("part", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("punctuated_word", "word").alias("t"))))
    return numbered.groupBy(*scope, "part", F.col("__who").alias("speaker")).agg(F.min("pos").alias("first_pos"), F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), F.count(F.lit(1)).alias("n_words"), F.array_join(F.transform(rows, lambda x: x["t"]), " ").alias("text"), F.avg("confidence").alias("confidence"))


# How each transcription service counts time and names unknown speakers.
def normalise_utterances(df: DataFrame) -> DataFrame:
    """Utterances of several services in one form: times in seconds, speakers null where the service has none or doesn't know
    them, confidence as a probability."""
    kind, speaker = F.col("provider"), F.trim(F.col("speaker"))
    scale = F.when(kind == "assemblyai", 0.001).otherwise(1.0)
    who = F.when(kind == "groq", None).when(speaker.isin("-1", "", "?", "unknown", "UNKNOWN"), None).otherwise(speaker)
    sure = F.when(kind == "groq", 1 - F.col("confidence")).otherwise(F.col("confidence"))
    return df.withColumns({"start_sec": F.col("start_sec") * scale, "end_sec": F.col("end_sec") * scale, "speaker": who, "confidence": sure})
