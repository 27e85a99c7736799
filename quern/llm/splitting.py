"""Splitting oversized texts at natural boundaries by lexical cohesion.

A text's units are its sentences and rows. Sliding blocks of words on either side of each unit end are compared by
cosine; a unit end whose similarity lies in a valley between two peaks marks a change of topic, and its depth is how far
the peaks rise above it. Within each size window the deepest valley is cut, paragraph ends before row ends before
sentence ends where depths tie; word ends and, last, plain characters serve where a window has no unit end. The next
piece begins the wanted overlap before the cut. Only texts above their limit leave the JVM.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.latest import latest_rows

MB = 1_048_576
#: Words in the block on either side of a gap.
BLOCK_WORDS = 40
#: Cuts are sought between this share of a window and its end, and before it only where there are none.
FILL = 0.5

WORD = re.compile(r"[^\W_]+")
UNIT_END = re.compile(r"(?:\r?\n[ \t]*){2,}|\r?\n|(?<=[.!?…。！？;])[\"'”’»)\]]*\s+|(?<=>)(?=<)|(?<=\},)\s*")
SPACE = re.compile(r"\s+")


def byte_offsets(text: str) -> np.ndarray | None:
    """UTF-8 bytes before each character and in all; None for plain ASCII, where they equal the characters."""
    if text.isascii():
        return None
    code = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    return np.concatenate(([0], np.cumsum(1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))))


def cohesion_depths(text: str, ends: list[int]) -> np.ndarray:
    """Depth of the similarity valley at each unit end (0 where there is none)."""
    tokens, at = [], []
    for m in WORD.finditer(text):
        tokens.append(m.group().lower())
        at.append(m.start())
    positions = np.searchsorted(np.array(at), np.array(ends, dtype=np.int64)).tolist()
    left: Counter[str] = Counter()
    right: Counter[str] = Counter(tokens[:BLOCK_WORDS])
    dot, nl, nr, n, p = 0, 0, sum(c * c for c in right.values()), len(tokens), 0
    sims = []
    for target in positions:
        while p < target:
            w = tokens[p]
            # the gap moves past one word: it leaves the right block and enters the left one
            dot -= left[w]
            nr -= 2 * right[w] - 1
            right[w] -= 1
            dot += right[w]
            nl += 2 * left[w] + 1
            left[w] += 1
            if p + BLOCK_WORDS < n:
                x = tokens[p + BLOCK_WORDS]
                dot += left[x]
                nr += 2 * right[x] + 1
                right[x] += 1
            if p >= BLOCK_WORDS:
                y = tokens[p - BLOCK_WORDS]
                dot -= right[y]
                nl -= 2 * left[y] - 1
                left[y] -= 1
            p += 1
        sims.append(dot / (nl * nr) ** 0.5 if nl > 0 and nr > 0 else 0.0)
    depths = np.zeros(len(sims))
    rise = [0.0] * len(sims)
    for i in range(1, len(sims)):  # highest peak reached while climbing away on the left ...
        rise[i] = max(sims[i - 1], rise[i - 1]) if sims[i - 1] >= sims[i] else sims[i]
        depths[i] += rise[i] - sims[i]
    rise = [0.0] * len(sims)
    for i in range(len(sims) - 2, -1, -1):  # ... and on the right
        rise[i] = max(sims[i + 1], rise[i + 1]) if sims[i + 1] >= sims[i] else sims[i]
        depths[i] += rise[i] - sims[i]
    return depths


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """Pieces as (start, end, boundary) in characters; each has at most ``limit`` bytes (4 at least), successive
    pieces share ``overlap`` characters (fewer where these would fill more than half of a piece), and the cut is at
    ``boundary``: paragraph, row, sentence, word, character, or end."""
    limit = max(limit, 4)
    offsets = byte_offsets(text)
    size = len(text) if offsets is None else int(offsets[-1])
    if size <= limit:
        return [(0, len(text), "end")]
    ends, kinds = [], []
    for m in UNIT_END.finditer(text):
        gap = m.group()
        if 0 < m.end() < len(text):
            ends.append(m.end())
            kinds.append(2 if gap.count("\n") > 1 else 1 if "\n" in gap or not gap else 0)
    depths, where, kind = cohesion_depths(text, ends) if ends else np.zeros(0), np.array(ends, dtype=np.int64), np.array(kinds, dtype=np.int64)
    spaces = np.fromiter((m.end() for m in SPACE.finditer(text)), dtype=np.int64)
    names = ("sentence", "row", "paragraph")

    def at_byte(b: int) -> int:
        return b if offsets is None else int(np.searchsorted(offsets, b, side="right")) - 1

    def byte_of(i: int) -> int:
        return i if offsets is None else int(offsets[i])

    pieces, start, fresh = [], 0, 0
    while True:
        if size - byte_of(start) <= limit:
            pieces.append((start, len(text), "end"))
            return pieces
        far = at_byte(byte_of(start) + limit)
        far = max(far, fresh + 1)
        cut, boundary = 0, ""
        for low in (max(fresh + 1, at_byte(byte_of(start) + int(limit * FILL))), fresh + 1):
            i, j = np.searchsorted(where, [low, far + 1])
            if i < j:
                best = max(range(i, j), key=lambda k: (round(float(depths[k]), 6), kind[k], where[k]))
                cut, boundary = int(where[best]), names[kind[best]]
                break
        if not cut:
            i, j = np.searchsorted(spaces, [fresh + 1, far + 1])
            cut, boundary = (int(spaces[j - 1]), "word") if i < j else (far, "character")
        pieces.append((start, cut, boundary))
        back = min(overlap, cut - start - 1)
        while back > 0 and byte_of(cut) - byte_of(cut - back) > min(limit // 2, limit - 4):
            back //= 2
        start, fresh = cut - back, cut


def split_oversized(chunks: DataFrame, variables: DataFrame) -> DataFrame:
    """Numbered pieces of every chunk whose text exceeds its project's limit:
    (chunk_id, piece int, pieces int, start int, end int, n_bytes bigint, boundary string, text).

    Of repeated rows of a chunk_id the latest counts. Rows with a null chunk_id, text or project, projects without a row, and
    limits that are null, not a number or not positive give no case; a null or negative overlap is 0. Empty tables give an empty
    result; only the columns named here are read."""
    limits = variables.where("project_id is not null").groupBy("project_id").agg(F.min("max_chunk_size_mb").alias("limit_mb"), F.max("chunk_overlap").alias("overlap"))
    limits = limits.where("limit_mb > 0 and not isnan(limit_mb)").select("project_id", F.floor(F.col("limit_mb") * MB).cast("bigint").alias("limit"), F.greatest(F.coalesce("overlap", F.lit(0)), F.lit(0)).alias("overlap"))
    large = chunks.select("chunk_id", "project_id", "text", "updated_at").join(limits, "project_id").where(F.octet_length("text") > F.col("limit"))
    once = latest_rows(large, ["chunk_id"], "updated_at", ["chunk_id", "text", "limit", "overlap"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for chunk, text, limit, overlap in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                cuts = split_text(text, limit, overlap)
                rows += [(chunk, k, len(cuts), a, b, len(text[a:b].encode()), why, text[a:b]) for k, (a, b, why) in enumerate(cuts)]
            if rows:
                types = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["chunk_id", "piece", "pieces", "start", "end", "n_bytes", "boundary", "text"])

    return once.mapInArrow(run, "chunk_id string, piece int, pieces int, start int, end int, n_bytes bigint, boundary string, text string")
