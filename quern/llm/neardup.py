"""Near-duplicate records with small edits, by HyperMinHash.

A record is the set of its runs of ``n`` successive words. Its sketch has 128 buckets; each keeps the number of
leading zeros of its smallest hash and ten mantissa bits behind them, two bytes in all. Bands of three registers (empty
ones borrow from another bucket, in an order all records share) make candidates; the collision-corrected Jaccard estimate of
two sketches sorts out most of them; the rest is verified on the sets themselves.

Records with the same words are one class and are represented once. Bands that more than HOT_BAND classes share are not
paired but banded again by other registers within the band, level by level; what still shares a band after LEVELS levels agrees in so
many registers that its pairs are links, and is paired. Bands that hold more than a HEAVYth of all classes are told from a sample
beforehand and go to the next level without being gathered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.runtime import cut_lineage

BUCKET_BITS, MANTISSA_BITS = 7, 10
BUCKETS = 1 << BUCKET_BITS
BANDS, ROWS = 32, 3
HOT_BAND, LEVELS = 64, 4
#: A band is heavy if it holds more than one in HEAVY of the classes (so there are at most BANDS x HEAVY heavy bands), as told from one class in SAMPLED.
HEAVY, SAMPLED = 1000, 32
#: Classes of copies up to this size are written as all their pairs, larger ones as links to their smallest key (see similar_pairs).
PAIRED_COPIES = 64

WORD = re.compile(r"[^\W_]+")
# The expected share of chance collisions of sketches (Yu & Weber, HyperMinHash), and splitmix64's constants.
COLLISIONS = 0.169919487159739093975315012348
MIX_ADD, MIX_1, MIX_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

_hashes: dict[str, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = x + MIX_ADD
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def _hash_words(words: list[str]) -> np.ndarray:
    import xxhash

    if len(_hashes) > 1_000_000:
        _hashes.clear()
    try:
        return np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    except KeyError:
        for w in set(words):
            if w not in _hashes:
                _hashes[w] = xxhash.xxh64_intdigest(w.encode())
        return np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_sets(texts: list[str], n: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Of the texts with at least ``min_words`` words: their positions, their sets of shingles as sorted 32-bit hashes laid
    end to end, where each set begins, and a digest of each text's words."""
    kept, words, counts, digests = [], [], [], []
    for i, text in enumerate(texts):
        found = WORD.findall(text.lower())
        if len(found) >= max(min_words, n):
            kept.append(i)
            words += found
            counts.append(len(found))
            digests.append(blake2b(" ".join(found).encode(), digest_size=8).digest())
    if not kept:
        return np.zeros(0, int), np.zeros(0, np.uint32), np.zeros(1, int), []
    h, size = _hash_words(words), np.array(counts)
    runs = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for k in range(n):
        runs = runs * np.uint64(0x100000001B3) + _mix(h[k : len(h) - n + 1 + k] + np.uint64(k))
    doc = np.repeat(np.arange(len(size)), size)[: len(runs)]
    whole = np.arange(len(runs)) <= np.repeat(np.cumsum(size) - n, size)[: len(runs)]
    unique = np.unique((doc[whole].astype(np.uint64) << np.uint64(32)) | (_mix(runs[whole]) >> np.uint64(32)))
    starts = np.searchsorted(unique, np.arange(len(size) + 1, dtype=np.uint64) << np.uint64(32))
    return np.array(kept), (unique & np.uint64(0xFFFFFFFF)).astype(np.uint32), starts, digests


def sketches(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Registers (records x buckets, 16 bits; 0 is empty)."""
    n = len(starts) - 1
    doc = np.repeat(np.arange(n), np.diff(starts))
    v = _mix(shingles.astype(np.uint64))
    least = np.full(n * BUCKETS, np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(least, doc * BUCKETS + (v >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), v << np.uint64(BUCKET_BITS))
    fraction, exponent = np.frexp(least.astype(np.float64))
    zeros = np.clip(64 - exponent, 0, 62) + 1
    registers = (zeros.astype(np.uint16) << MANTISSA_BITS) | np.minimum((fraction - 0.5) * (2 << MANTISSA_BITS), (1 << MANTISSA_BITS) - 1).astype(np.uint16)
    registers[least == np.iinfo(np.uint64).max] = 0
    return registers.reshape(n, BUCKETS)


@lru_cache(maxsize=1)
def _borrow_order() -> np.ndarray:
    return np.random.default_rng(11).integers(0, BUCKETS, size=(64, BUCKETS))


def densify(registers: np.ndarray) -> np.ndarray:
    """Registers with every empty one filled from the first non-empty bucket of its borrowing order."""
    full = registers.astype(np.int64)
    empty = full == 0
    for attempt, source in enumerate(_borrow_order()):
        if not empty.any():
            return full
        lent = registers[:, source].astype(np.int64)
        take = empty & (lent > 0)
        full[take] = (lent + ((attempt + 1) << 16))[take]
        empty &= ~take
    for shift in range(1, BUCKETS):
        lent = np.roll(registers, -shift, axis=1).astype(np.int64)
        take = empty & (lent > 0)
        full[take] = (lent + ((64 + shift) << 16))[take]
        empty &= ~take
    return full


@lru_cache(maxsize=8)
def _band_registers(level: int) -> np.ndarray:
    rng = np.random.default_rng(100 + level)
    return np.stack([rng.choice(BUCKETS, ROWS, replace=False) for _ in range(BANDS)])


def band_keys(registers: np.ndarray, level: int, within: np.ndarray | None = None) -> np.ndarray:
    """Band keys (records x BANDS, signed 64 bits)."""
    full = densify(registers).astype(np.uint64)
    picked = full[:, _band_registers(level)]
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(level * 1000), picked.shape[:2])
    if within is not None:
        key = key + _mix(within.astype(np.uint64))[:, None]
    for r in range(ROWS):
        key = _mix(key * np.uint64(31) + picked[:, :, r])
    return key.astype(np.int64)


def jaccard_estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of row pairs of registers, and how many buckets each rests on."""
    both = ((a == b) & (a > 0)).sum(axis=1)
    used = ((a > 0) | (b > 0)).sum(axis=1)
    ratio = np.maximum(na, nb) / np.maximum(np.minimum(na, nb), 1)
    chance = COLLISIONS * 2.0**-MANTISSA_BITS * 4 * ratio / (1 + ratio) ** 2 * used
    return np.maximum(both - chance, 0) / np.maximum(used, 1), used


def sketch_records(records: DataFrame, n: int, min_words: int) -> DataFrame:
    """(kind, key, version, rid bigint, size int, registers binary, shingles binary) of every record with enough words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                piece = batch.slice(lo, 1000)
                at, shingles, starts, digests = shingle_sets(piece.column(3).to_pylist(), n, min_words)
                if len(at):
                    registers = sketches(shingles, starts)
                    kinds = piece.column(0).take(pa.array(at))
                    rid = [int.from_bytes(blake2b(d + k.encode(), digest_size=8).digest(), "little", signed=True) for d, k in zip(digests, kinds.to_pylist(), strict=True)]
                    sets = [shingles[i:j].tobytes() for i, j in zip(starts[:-1], starts[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [kinds, piece.column(1).take(pa.array(at)), piece.column(2).take(pa.array(at)), pa.array(rid, pa.int64()), pa.array(np.diff(starts), pa.int32()), pa.array([r.tobytes() for r in registers], pa.binary()), pa.array(sets, pa.binary())],
                        names=["kind", "key", "version", "rid", "size", "registers", "shingles"],
                    )

    usable = records.where("kind is not null and key is not null and text is not null").select("kind", "key", "version", "text")
    version = usable.schema["version"].dataType.simpleString()
    return usable.mapInArrow(run, f"kind string, key string, version {version}, rid bigint, size int, registers binary, shingles binary")


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(-1, BUCKETS)


def _bands(classes: DataFrame, level: int, within: str) -> DataFrame:
    """Band keys (rid, band) of every class at a level; classes that differ in the column ``within`` never share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                piece = batch.slice(lo, 2000)
                keys = band_keys(_registers(piece.column(1)), level, piece.column(2).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(piece.column(0).to_numpy(zero_copy_only=False), BANDS)), pa.array(keys.ravel())], names=["rid", "band"])

    return classes.select("rid", "registers", within).mapInArrow(run, "rid bigint, band bigint")


def _candidates(classes: DataFrame) -> DataFrame:
    """Pairs of classes (a, b), a < b, that share a band which few classes share, on some level.

    At every level the sizes of bands are counted; heavy bands, which a sample tells, never come together in one task. A hot
    band's classes are banded again by registers of their own level within the band; at the last level all bands are paired."""
    out, rows = None, classes.select("rid", "registers", "domain")
    for level in range(LEVELS):
        bands = _bands(rows, level, "domain")
        last = level == LEVELS - 1
        if not last:
            n = rows.count()
            sample = _bands(rows.where(F.pmod(F.xxhash64("rid"), F.lit(SAMPLED)) == 0), level, "domain")
            heavy = sample.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * SAMPLED * HEAVY > max(n, HOT_BAND * SAMPLED * HEAVY)).select("band", F.lit(True).alias("heavy"))
            bands = bands.join(F.broadcast(cut_lineage(heavy)), "band", "left")  # at most BANDS x HEAVY rows
            light = bands.where("heavy is null").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("band"))).where("n > 1").select("rid", "band", (F.col("n") > HOT_BAND).alias("hot"))
            bands = cut_lineage(light.unionByName(bands.where("heavy").select("rid", "band", F.lit(True).alias("hot"))))
            again = bands.where("hot").select("rid", "band")
            bands = bands.where("not hot").select("rid", "band")
        pairs = _pairs(bands)
        out = pairs if out is None else out.unionByName(pairs)
        if last or again.limit(1).count() == 0:
            break
        # one row per class and hot band
        rows = cut_lineage(again.join(classes.select("rid", "registers"), "rid").select("rid", "registers", F.col("band").alias("domain")))
    assert out is not None
    return out.distinct()


def _pairs(bands: DataFrame) -> DataFrame:
    a, b = bands.select(F.col("rid").alias("a"), "band"), bands.select(F.col("rid").alias("b"), "band")
    return a.join(b, "band").where("a < b").select("a", "b")


def _judge(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs whose estimate, less three deviations, does not exclude the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 8192):
                piece = batch.slice(lo, 8192)
                sizes = [piece.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in (2, 4)]
                j, used = jaccard_estimate(_registers(piece.column(3)), _registers(piece.column(5)), *sizes)
                keep = j + 3 * np.sqrt(threshold * (1 - threshold) / np.maximum(used, 1)) >= threshold
                keep &= np.minimum(*sizes) >= threshold * np.maximum(*sizes)
                yield pa.RecordBatch.from_arrays([piece.column(i).filter(pa.array(keep)) for i in (0, 1)], names=["a", "b"])

    side = lambda s: classes.select(F.col("rid").alias(s), F.col("size").alias(f"size_{s}"), F.col("registers").alias(f"reg_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "size_a", "reg_a", "size_b", "reg_b")
    return both.mapInArrow(run, "a bigint, b bigint")


def _verify(pairs: DataFrame, drawn: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard) of the pairs whose sets reach the threshold. One set per class moves, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sims = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, dtype="<u4"), np.frombuffer(y, dtype="<u4")
                shared = len(p) + len(q) - len(np.union1d(p, q))
                sims.append(shared / max(len(p) + len(q) - shared, 1))
            s = pa.array(sims, pa.float64())
            keep = pa.array([x >= threshold for x in sims], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), s.filter(keep)], names=["a", "b", "jaccard"])

    sets = drawn.groupBy("rid").agg(F.first("shingles").alias("shingles"))
    side = lambda s: sets.select(F.col("rid").alias(s), F.col("shingles").alias(f"set_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a bigint, b bigint, jaccard double")


def similar_classes(records: DataFrame, n: int = 5, threshold: float = 0.8, min_words: int = 0) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (kind, key, rid) assign every record with enough words to the class of records with
    the same words; links (a, b, jaccard), a < b, are the pairs of classes of one kind whose similarity reaches ``threshold``.

    ``records`` has kind, key, version and text. Rows with a null kind, key or text, and texts with fewer than ``min_words``
    (or ``n``) words, take no part; of repeated keys the row of the greatest version counts, null being the least.
    Empty tables give empty results."""
    drawn = cut_lineage(sketch_records(records, n, min_words))
    latest = drawn.groupBy("kind", "key").agg(F.max(F.struct("version", "rid")).alias("last")).select("kind", "key", F.col("last.rid").alias("rid"))
    members = cut_lineage(latest)
    # one row per class; copies are folded before the shuffle, which all joins by class then share
    classes = drawn.groupBy("rid").agg(F.first(F.xxhash64("kind")).alias("domain"), F.first("size").alias("size"), F.first("registers").alias("registers"))
    candidates = _candidates(classes)
    near = cut_lineage(_judge(candidates, classes, threshold))
    links = _verify(near, drawn, threshold)
    for end in ("a", "b"):  # classes of outdated rows only are no one's
        links = links.join(members.select(F.col("rid").alias(end)).distinct(), end, "left_semi")
    return members, cut_lineage(links.select("a", "b", "jaccard"))


def similar_pairs(records: DataFrame, n: int = 5, threshold: float = 0.8, min_words: int = 0, paired_copies: int | None = None) -> DataFrame:
    """Pairs of different records (kind, key_a, key_b), key_a < key_b, whose similarity reaches ``threshold``.

    Every link between classes of different words is written for all their members. Members of one class are paired with
    each other where there are at most ``paired_copies`` of them (PAIRED_COPIES by default); a larger class is written as the links of its
    members to its smallest key, and its links to other classes through that key, which together lose no connection."""
    most = PAIRED_COPIES if paired_copies is None else paired_copies
    members, links = similar_classes(records, n, threshold, min_words)
    size = members.groupBy("rid").agg(F.count(F.lit(1)).alias("copies"), F.min("key").alias("head"))
    known = members.join(size, "rid")
    out = known.where((F.col("copies") <= most) | (F.col("key") == F.col("head")))
    x = out.select(F.col("rid").alias("a"), "kind", F.col("key").alias("ka"))
    y = out.select(F.col("rid").alias("b"), F.col("key").alias("kb"))
    across = links.select("a", "b").join(x, "a").join(y, "b").select("kind", "ka", "kb")
    small = known.where((F.col("copies") > 1) & (F.col("copies") <= most))
    inside = small.select("rid", "kind", F.col("key").alias("ka")).join(small.select("rid", F.col("key").alias("kb")), "rid").where("ka < kb").select("kind", "ka", "kb")
    star = known.where((F.col("copies") > most) & (F.col("key") != F.col("head"))).select("kind", F.col("head").alias("ka"), F.col("key").alias("kb"))
    return across.unionByName(inside).unionByName(star).select("kind", F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b"))


def components(links: DataFrame) -> DataFrame:
    """(rid, root): the smallest id reachable from every id that occurs in ``links`` (a, b).

    Every round takes the smallest root of the neighbours and then the root's root; the table is written each round,
    so rounds don't pile up, and their number grows with the logarithm of a chain's length."""
    edges = cut_lineage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    roots = edges.groupBy(F.col("a").alias("rid")).agg(F.least(F.min("b"), F.first("a")).alias("root"))
    while True:
        offered = edges.join(roots.withColumnRenamed("rid", "b"), "b").groupBy(F.col("a").alias("rid")).agg(F.min("root").alias("offer"))
        lower = roots.join(offered, "rid", "left").select("rid", F.col("root").alias("old"), F.least("root", F.coalesce("offer", "root")).alias("root"))
        jump = lower.select(F.col("rid").alias("root"), F.col("root").alias("next"))
        after = cut_lineage(lower.join(jump, "root", "left").select("rid", "old", F.least("root", F.coalesce("next", "root")).alias("root")))
        changed = after.where("root <> old").limit(1).count()
        roots = after.select("rid", "root")
        if not changed:
            return roots


def similar_groups(records: DataFrame, n: int = 5, threshold: float = 0.8, min_words: int = 0) -> DataFrame:
    """One row per record with enough words: (kind, key, class_id, links): the smallest key of its group of transitively
    similar records and the number of other classes it is linked to."""
    members, links = similar_classes(records, n, threshold, min_words)
    roots = components(links)
    degree = links.select(F.col("a").alias("rid")).unionByName(links.select(F.col("b").alias("rid"))).groupBy("rid").agg(F.count(F.lit(1)).alias("links"))
    rooted = members.join(roots, "rid", "left").join(degree, "rid", "left").select("kind", "key", F.coalesce("root", "rid").alias("root"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
    names = rooted.groupBy("root").agg(F.min("key").alias("class_id"))
    return rooted.join(names, "root").select("kind", "key", "class_id", "links")
