"""Most similar vectors for every vector, by randomly rotated one-bit codes.

Vectors are laid into cells around k-means centroids fitted on a bounded sample. A base vector's residual to its centroid is
rotated by a fixed random rotation and kept as one bit per dimension with correction scalars (the residual's length, its inner product with
its own code, the vector's inner product with the centroid) and, behind them, as eight bits per dimension. A query is sent to its nearest
cells as four bits per dimension of its own rotated residual. There, inner products are estimated from the packed bits alone, by
popcounts of the query's bit planes with the codes, and each estimate has an error bound; pairs whose upper bound can still reach the wanted
similarity and the query's k-th best lower bound are estimated again from the eight-bit residuals under tighter bounds. What is left is reranked with
exact cosines. Only codes are shuffled to the cells; whole vectors move once, to the pairs that the bounds let through.

Cells with many rows are divided into blocks on either side, so that no task holds more than BASE_BLOCK base vectors
and QUERY_BLOCK queries. Copies of one vector share a key, and every task lays a key once.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.runtime import cut_lineage

#: The index is fitted on at most so many vectors; all vectors are indexed.
FIT_ROWS = 131_072
FIT_ROUNDS = 4
#: Cells grow with the root of the number of vectors up to this number, and with the cells the number that a query visits.
MAX_CELLS = 65_536
BASE_BLOCK, QUERY_BLOCK = 8192, 32_768
#: Bounds hold for all but a vanishing share of pairs at this many deviations.
EPSILON = 3.0
#: Bits and levels of a query's coordinates and of the finer code of a base vector.
QUERY_BITS, FINE_LEVELS = 4, 127
#: A list of ids that is counted and no longer than this is broadcast.
BROADCAST_ROWS = 100_000
LAID = "cell int, bs int, qs int, is_query boolean, load binary"
KEY_BYTES = 16


@lru_cache(maxsize=4)
def rotation(dim: int, seed: int = 5) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def probes_for(cells: int, least: float) -> int:
    """How many cells a query visits: a quarter of the root of their number if only close vectors are wanted, more else."""
    close = least >= 0.7
    return min(cells, max(6 if close else 16, math.ceil(math.sqrt(cells) * (0.25 if close else 0.65))))


def unit_rows(raw: np.ndarray) -> np.ndarray:
    wide = raw.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def _words_of(bits: np.ndarray) -> np.ndarray:
    """Rows of bits packed into 64-bit words."""
    packed = np.packbits(bits, axis=-1)
    wide = -(-packed.shape[-1] // 8) * 8
    full = np.zeros((*packed.shape[:-1], wide), dtype=np.uint8)
    full[..., : packed.shape[-1]] = packed
    return full.view(np.uint64)


def base_codes(unit: np.ndarray, centroid: np.ndarray, rotate: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of base vectors: code words, finer codes, and scalars (radius, inner product with the code, inner product with the
    centroid, step of the finer code)."""
    residual = unit - centroid
    radius = np.linalg.norm(residual, axis=1)
    turned = (residual / np.maximum(radius, 1e-12)[:, None]) @ rotate
    aligned = np.maximum(np.abs(turned).sum(axis=1) / math.sqrt(unit.shape[1]), 1e-6)
    offset = np.einsum("ij,ij->i", unit, np.broadcast_to(centroid, unit.shape))
    step = np.maximum(np.abs(turned).max(axis=1), 1e-12) / FINE_LEVELS
    fine = np.rint(turned / step[:, None]).astype(np.int8)
    return _words_of(turned > 0), fine, np.stack([radius, aligned, offset, step], axis=1).astype(np.float32)


def query_codes(unit: np.ndarray, centroid: np.ndarray, rotate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of queries: bit planes (rows, QUERY_BITS, words), lowest first, and scalars (residual's length, lowest level, step, inner product with the
    centroid)."""
    residual = unit - centroid
    reach = np.linalg.norm(residual, axis=1)
    turned = (residual / np.maximum(reach, 1e-12)[:, None]) @ rotate
    low = turned.min(axis=1)
    step = np.maximum(turned.max(axis=1) - low, 1e-12) / ((1 << QUERY_BITS) - 1)
    level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
    planes = np.stack([_words_of((level >> b) & 1) for b in range(QUERY_BITS)], axis=1)
    across = np.einsum("ij,ij->i", unit, np.broadcast_to(centroid, unit.shape))
    return planes, np.stack([reach, low, step, across], axis=1).astype(np.float32)


def _levels(planes: np.ndarray, dim: int) -> np.ndarray:
    bits = np.unpackbits(planes.view(np.uint8), axis=-1, count=dim)
    return sum(bits[:, b].astype(np.float32) * (1 << b) for b in range(QUERY_BITS))


def estimate(planes: np.ndarray, asks: np.ndarray, codes: np.ndarray, facts: np.ndarray, dim: int, squared: float) -> tuple[np.ndarray, np.ndarray]:
    """Cosines (queries x base) estimated from packed bits and scalars, and their error bounds; ``squared`` is the squared length
    of the centroid."""
    counts = np.zeros((len(planes), len(codes)), dtype=np.float32)
    for b in range(QUERY_BITS):
        for w in range(codes.shape[1]):
            counts += np.bitwise_count(planes[:, b, w, None] & codes[None, :, w]).astype(np.float32) * (1 << b)
    ones = np.bitwise_count(codes).sum(axis=1).astype(np.float32)
    levels = sum(np.bitwise_count(planes[:, b]).sum(axis=1).astype(np.float32) * (1 << b) for b in range(QUERY_BITS))
    reach, low, step, across = (asks[:, i, None] for i in range(4))
    radius, aligned, offset = (facts[None, :, i] for i in range(3))
    # the query's coordinates are low + step x level, the code's are +-1 / sqrt(dim)
    signed = step * (2 * counts - levels[:, None]) + low * (2 * ones - dim)[None, :]
    scale = reach * radius
    cosine = signed / (aligned * math.sqrt(dim)) * scale + offset + across - squared
    spread = EPSILON * np.sqrt(np.maximum(1 / aligned**2 - 1, 0) / max(dim - 1, 1) + step**2 / (12 * aligned**2))
    return cosine, scale * spread + 1e-5


def refine(planes: np.ndarray, asks: np.ndarray, fine: np.ndarray, facts: np.ndarray, i: np.ndarray, j: np.ndarray, dim: int, squared: float) -> tuple[np.ndarray, np.ndarray]:
    """Cosines of pairs estimated from the finer codes, and their error bounds."""
    level, out = _levels(planes, dim), np.empty(len(i), dtype=np.float32)
    for a in range(0, len(i), 1 << 16):
        p, q = i[a : a + (1 << 16)], j[a : a + (1 << 16)]
        out[a : a + (1 << 16)] = np.einsum("ij,ij->i", asks[p, 1, None] + asks[p, 2, None] * level[p], fine[q].astype(np.float32))
    scale = asks[i, 0] * facts[j, 0]
    cosine = out * facts[j, 3] * scale + facts[j, 2] + asks[i, 3] - squared
    return cosine, scale * EPSILON * np.sqrt((asks[i, 2] ** 2 + facts[j, 3] ** 2) / 12) + 1e-5


def _k_best(i: np.ndarray, cosine: np.ndarray, bound: np.ndarray, k: int, least: float) -> np.ndarray:
    """Pairs that may be among their query's ``k`` best with at least ``least``; ``i`` is sorted."""
    keep = cosine + bound >= least
    if len(i):
        order = np.lexsort((-(cosine - bound), i))
        rank = np.arange(len(i)) - np.searchsorted(i[order], i[order])
        kth = np.full(int(i.max()) + 1, -np.inf)
        at = order[rank == k - 1]
        kth[i[at]] = cosine[at] - bound[at]
        keep &= cosine + bound >= kth[i]
    return keep


def candidates_of_block(planes: np.ndarray, asks: np.ndarray, codes: np.ndarray, fine: np.ndarray, facts: np.ndarray, same: np.ndarray, centroid: np.ndarray, k: int, least: float) -> tuple[np.ndarray, ...]:
    """(query, base, cosine, bound) of the pairs of a block that may be among each query's k best with a cosine of at least ``least``; ``same``
    is the position in the block of the query itself, or -1."""
    dim, squared, out = fine.shape[1], float(centroid @ centroid), []
    step = max(1, (1 << 21) // max(1, len(codes)))
    for lo in range(0, len(planes), step):
        part, ask = planes[lo : lo + step], asks[lo : lo + step]
        cosine, bound = estimate(part, ask, codes, facts, dim, squared)
        own = same[lo : lo + step]
        rows = np.flatnonzero(own >= 0)
        cosine[rows, own[rows]] = -np.inf
        upper = cosine + bound
        mask = upper >= least
        crowded = np.flatnonzero(mask.sum(axis=1) > k)
        if len(crowded):
            kth = -np.partition(bound[crowded] - cosine[crowded], k - 1, axis=1)[:, k - 1]
            mask[crowded] &= upper[crowded] >= kth[:, None]
        i, j = np.nonzero(mask)
        c, b = refine(part, ask, fine, facts, i, j, dim, squared)
        keep = _k_best(i, c, b, k, least)
        out.append((i[keep] + lo, j[keep], c[keep], b[keep]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f4").reshape(-1, dim)


def raw_vectors(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(id string, lead array<float>, key binary, vec binary) of every row with a usable vector; ``key`` is equal exactly for equal vectors."""
    v = F.col("v")
    rows = df.select(F.col(key).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) == dim) & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype("<f4") + np.float32(0)
                vecs = [x.tobytes() for x in raw.reshape(-1, dim)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([hashlib.blake2b(x, digest_size=KEY_BYTES).digest() for x in vecs], pa.binary()), pa.array(vecs, pa.binary())], names=["id", "lead", "key", "vec"])

    return rows.select("id", F.slice("v", 1, 8).alias("lead"), "v").mapInArrow(pack, "id string, lead array<float>, key binary, vec binary")


def usable_vectors(df: DataFrame, key: str, vector: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """(ids, vectors): ids (id, key), written, has every id once; vectors (key, vec) are read from the rows, which may repeat a key.

    Null ids, and vectors that are null, of another length than ``dim``, all zero, or hold a null, infinite or
    not-a-number element take no part. Of several usable vectors of one id the greatest counts, by its first eight elements and then by its key."""
    raw = raw_vectors(df, key, vector, dim)
    ids = cut_lineage(raw.groupBy("id").agg(F.max(F.struct("lead", "key")).alias("x")).select("id", F.col("x.key").alias("key")))
    outdated = cut_lineage(raw.select("id", "key").join(ids.withColumnRenamed("key", "live"), "id").where("key <> live").select("id", "key").distinct())
    if (n := outdated.count()) == 0:
        return ids, raw.select("key", "vec")
    return ids, raw.join(F.broadcast(outdated) if n <= BROADCAST_ROWS else outdated, ["id", "key"], "left_anti").select("key", "vec")


def _fit(vectors: DataFrame, n: int, cells: int, dim: int) -> np.ndarray:
    """Spherical k-means on a hash sample of at most FIT_ROWS vectors."""
    share = min(1.0, FIT_ROWS * 0.95 / max(n, 1))
    picked = vectors.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(2 * FIT_ROWS).toArrow()
    rows = sorted(dict(zip(picked.column("key").to_pylist(), picked.column("vec").to_pylist(), strict=True)).items())[:FIT_ROWS]
    sample = unit_rows(np.frombuffer(b"".join(v for _, v in rows), dtype="<f4").reshape(-1, dim)).astype(np.float32)
    centres = sample[np.random.default_rng(3).permutation(len(sample))[:cells]].copy()
    for _ in range(FIT_ROUNDS):
        nearest = nearest_cells(sample, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        length = np.linalg.norm(sums, axis=1)
        centres[length > 0] = sums[length > 0] / length[length > 0, None]
    return centres


def _scan(laid: DataFrame, centres: np.ndarray, dim: int, k: int, least: float) -> DataFrame:
    """Per (cell, block): the pairs that the bounds let through (q binary, n binary, cosine float, bound float)."""
    shared = laid.sparkSession.sparkContext.broadcast(centres)  # at most MAX_CELLS x dim floats
    words = -(-dim // 64)

    def unique(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
        loads = np.frombuffer(b"".join(table.column("load").to_pylist()), dtype=np.uint8).reshape(table.num_rows, width)
        keys = np.ascontiguousarray(loads[:, :KEY_BYTES]).view(f"V{KEY_BYTES}").ravel()
        _, first = np.unique(keys, return_index=True)
        return keys[first], loads[first, KEY_BYTES:]

    def block(group: pa.Table) -> pa.Table:
        asks = group.column("is_query").to_numpy(zero_copy_only=False).astype(bool)
        base, query = group.filter(pa.array(~asks)), group.filter(pa.array(asks))
        if not base.num_rows or not query.num_rows:
            return pa.table({"q": pa.array([], pa.binary()), "n": pa.array([], pa.binary()), "cosine": pa.array([], pa.float32()), "bound": pa.array([], pa.float32())})
        names, load = unique(base, KEY_BYTES + 8 * words + dim + 16)
        wanted, ask = unique(query, KEY_BYTES + 8 * words * QUERY_BITS + 16)
        codes = np.ascontiguousarray(load[:, : 8 * words]).view(np.uint64)
        fine, facts = np.ascontiguousarray(load[:, 8 * words : 8 * words + dim]).view(np.int8), np.ascontiguousarray(load[:, 8 * words + dim :]).view(np.float32)
        planes = np.ascontiguousarray(ask[:, : 8 * words * QUERY_BITS]).view(np.uint64).reshape(len(ask), QUERY_BITS, words)
        scalars = np.ascontiguousarray(ask[:, 8 * words * QUERY_BITS :]).view(np.float32)
        place = {x.tobytes(): i for i, x in enumerate(names)}
        centre = shared.value[group.column("cell")[0].as_py() % len(shared.value)]
        i, j, cosine, bound = candidates_of_block(planes, scalars, codes, fine, facts, np.array([place.get(x.tobytes(), -1) for x in wanted]), centre, k, least)
        return pa.table({"q": pa.array([wanted[a].tobytes() for a in i], pa.binary()), "n": pa.array([names[b].tobytes() for b in j], pa.binary()), "cosine": pa.array(cosine, pa.float32()), "bound": pa.array(bound, pa.float32())})

    return laid.groupBy("cell", "bs", "qs").applyInArrow(block, "q binary, n binary, cosine float, bound float")


def _rows(cell, bs, qs, ask: bool, load: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int32()) for x in (cell, bs, qs)] + [pa.array(np.full(len(load), ask)), pa.array([x.tobytes() for x in load], pa.binary())], names=["cell", "bs", "qs", "is_query", "load"])


def _joined(*parts: np.ndarray) -> np.ndarray:
    """Arrays of rows side by side as bytes."""
    return np.concatenate([np.ascontiguousarray(p.reshape(len(p), -1)).view(np.uint8) for p in parts], axis=1)


def _once(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys as bytes, unit vectors) of a task's rows, every key once as far as the task remembers."""
    seen: set[bytes] = set()
    for batch in batches:
        for lo in range(0, batch.num_rows, 2048):
            piece = batch.slice(lo, 2048)
            keys, at = piece.column(0).to_pylist(), []
            for i, x in enumerate(keys):
                if x not in seen:
                    seen.add(x)
                    at.append(i)
            if len(seen) > 1_000_000:
                seen.clear()
            if at:
                unit = unit_rows(_matrix(piece.column(1).take(pa.array(at)), dim)).astype(np.float32)
                yield np.frombuffer(b"".join(keys[i] for i in at), dtype=np.uint8).reshape(len(at), KEY_BYTES), unit


def nearest_cells(unit: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` nearest cells of every vector, nearest first."""
    out, step = [], max(1, (1 << 22) // len(centres))
    for lo in range(0, len(unit), step):
        sims = unit[lo : lo + step] @ centres.T
        top = np.argpartition(-sims, probes - 1, axis=1)[:, :probes]
        out.append(np.take_along_axis(top, np.argsort(-np.take_along_axis(sims, top, axis=1), axis=1), axis=1))
    return np.concatenate(out) if out else np.zeros((0, probes), dtype=np.int64)


def _lay_cells(vectors: DataFrame, centres: np.ndarray, dim: int, probes: int) -> DataFrame:
    """Every vector once as a base row of its cell and ``probes`` times as a query, divided into blocks."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, query = np.zeros(len(shared.value), dtype=np.int64), np.zeros(len(shared.value), dtype=np.int64)
        for _, unit in _once(batches, dim):
            top = nearest_cells(unit, shared.value, probes)
            base += np.bincount(top[:, 0], minlength=len(base))
            query += np.bincount(top.ravel(), minlength=len(base))
        some = np.flatnonzero(query)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(base[some]), pa.array(query[some])], names=["cell", "b", "q"])

    sizes = vectors.mapInArrow(count, "cell int, b bigint, q bigint").groupBy("cell").agg(F.sum("b").alias("b"), F.sum("q").alias("q")).collect()  # at most MAX_CELLS rows
    cut_b, cut_q = np.ones(len(centres), dtype=np.int64), np.ones(len(centres), dtype=np.int64)
    for r in sizes:
        cut_b[r["cell"]], cut_q[r["cell"]] = max(1, -(-r["b"] // BASE_BLOCK)), max(1, -(-r["q"] // QUERY_BLOCK))
    rotate = rotation(dim)

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, unit in _once(batches, dim):
            salt = keys[:, :4].copy().view("<u4").ravel().astype(np.int64)
            top = nearest_cells(unit, shared.value, probes)
            home = top[:, 0]
            load = _joined(keys, *base_codes(unit, shared.value[home], rotate))
            at = np.repeat(np.arange(len(keys)), cut_q[home])
            turn = np.arange(len(at)) - np.repeat(np.cumsum(cut_q[home]) - cut_q[home], cut_q[home])
            yield _rows(home[at], (salt % cut_b[home])[at], turn, False, load[at])
            cell, who = top.ravel(), np.repeat(np.arange(len(keys)), top.shape[1])
            load = _joined(keys[who], *query_codes(unit[who], shared.value[cell], rotate))
            at = np.repeat(np.arange(len(cell)), cut_b[cell])
            turn = np.arange(len(at)) - np.repeat(np.cumsum(cut_b[cell]) - cut_b[cell], cut_b[cell])
            yield _rows(cell[at], turn, (salt[who] % cut_q[cell])[at], True, load[at])

    return vectors.mapInArrow(lay, LAID)


def _rerank(candidates: DataFrame, vectors: DataFrame, dim: int, k: int, least: float, mutual: bool) -> DataFrame:
    """(q, n, sim double): exact cosines of the pairs that may be among a query's ``k`` best over all its blocks.

    ``mutual`` offers every pair to either end. Of each query only pairs whose upper bound reaches its k-th lower bound get their vectors; each
    unordered pair gets them once."""
    if mutual:
        candidates = candidates.unionByName(candidates.select(F.col("n").alias("q"), F.col("q").alias("n"), "cosine", "bound"))
    lower, upper = F.col("cosine") - F.col("bound"), F.col("cosine") + F.col("bound")
    # the k-th of distinct neighbours is among the first 2 k rows, since a pair comes at most twice
    firm = candidates.select("q", "n", lower.alias("low")).withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("low")))).where(F.col("r") <= 2 * k)
    firm = firm.groupBy("q", "n").agg(F.max("low").alias("low")).withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("low")))).where(F.col("r") == k).select("q", F.col("low").alias("kth"))
    open_ = candidates.join(firm, "q", "left").where(F.col("kth").isNull() | (upper >= F.col("kth"))).select("q", "n")
    open_ = cut_lineage(open_.distinct())

    def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sim = np.einsum("ij,ij->i", unit_rows(_matrix(batch.column(2), dim)), unit_rows(_matrix(batch.column(3), dim)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sim, pa.float64())], names=["a", "b", "sim"])

    pairs = open_.select(F.least("q", "n").alias("a"), F.greatest("q", "n").alias("b")).distinct()
    once = vectors.groupBy("key").agg(F.first("vec").alias("vec"))
    side = lambda s: once.select(F.col("key").alias(s), F.col("vec").alias(f"v{s}"))
    known = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "va", "vb").mapInArrow(cosines, "a binary, b binary, sim double").where(F.col("sim") >= least)
    known = cut_lineage(known)
    if mutual:
        return known.select(F.col("a").alias("q"), F.col("b").alias("n"), "sim").unionByName(known.select(F.col("b").alias("q"), F.col("a").alias("n"), "sim"))
    return open_.join(known, (F.col("a") == F.least("q", "n")) & (F.col("b") == F.greatest("q", "n"))).select("q", "n", "sim")


def _with_copies(ids: DataFrame, near: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """From neighbouring vectors to neighbouring ids: (id, neighbour, similarity, rank); of equal similarity the smaller id first."""
    w = Window.partitionBy("key").orderBy("id")
    first = ids.select("key", "id").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    copies = first.groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "n"))).where(F.col("r") <= k)
    others = best.join(copies.withColumnRenamed("key", "n"), "n").select(F.col("q").alias("key"), "sim", "ids")
    own = copies.where(F.size("ids") > 1).select("key", F.lit(1.0).alias("sim"), "ids")
    lists = others.unionByName(own).groupBy("key").agg(F.collect_list(F.struct("sim", "ids")).alias("lists"))
    ranked = F.array_sort(F.flatten(F.transform("lists", lambda x: F.transform(x["ids"], lambda i: F.struct((-x["sim"]).alias("s"), i.alias("id"))))))
    joined = asked.select("id", "key").join(lists, "key").select("id", F.slice(F.filter(ranked, lambda x: x["id"] != F.col("id")), 1, k).alias("top"))
    return joined.select("id", F.posexplode("top").alias("pos", "x")).select("id", F.col("x.id").alias("neighbour"), (-F.col("x.s")).alias("similarity"), (F.col("pos") + 1).alias("rank"))


def similar_vectors(df: DataFrame, key: str, vector: str, dim: int, k: int, least: float, probes: int | None = None) -> DataFrame:
    """For every usable vector the at most ``k`` most similar others with a cosine of at least ``least``:
    (id, neighbour, similarity double, rank int).

    Approximate in which cells are visited (``probes``, by default :func:`probes_for`; recall is measured in the tests) and in bounds that
    hold for nearly all pairs, exact in the similarities. Copies of one vector are each other's neighbours at 1. Fewer than two usable vectors give an
    empty result."""
    ids, vectors = usable_vectors(df, key, vector, dim)
    n = ids.agg(F.approx_count_distinct("key", 0.01)).collect()[0][0]
    cells = int(min(MAX_CELLS, max(1, round(2 * math.sqrt(n)))))
    centres = _fit(vectors, n, cells, dim) if n else np.zeros((1, dim), dtype=np.float32)
    visits = min(probes or probes_for(len(centres), least), len(centres))
    found = _scan(_lay_cells(vectors, centres, dim, visits), centres, dim, k, least)
    return _with_copies(ids, _rerank(cut_lineage(found), vectors, dim, k, least, True), ids, k)


def nearest_for_queries(df: DataFrame, queries: DataFrame, key: str, vector: str, dim: int, k: int) -> DataFrame:
    """The ``k`` most similar of all vectors for each id of ``queries`` (its column ``key``), whatever their
    similarity: (id, neighbour, similarity, rank). Every query meets the codes of all vectors, block by block."""
    ids, vectors = usable_vectors(df, key, vector, dim)
    asked = ids.join(queries.select(F.col(key).cast("string").alias("id")).distinct(), "id", "left_semi")
    asked_keys = asked.select("key").distinct()
    blocks = max(1, -(-ids.count() // BASE_BLOCK))
    slices = max(1, -(-asked_keys.count() // QUERY_BLOCK))
    mean = np.zeros((1, dim), dtype=np.float32)  # residuals to the origin: the code is of the vector itself
    rotate = rotation(dim)

    def lay(ask: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for keys, unit in _once(batches, dim):
                salt = keys[:, :4].copy().view("<u4").ravel().astype(np.int64)
                times = blocks if ask else slices
                at, turn = np.repeat(np.arange(len(keys)), times), np.tile(np.arange(times), len(keys))
                block, part = (turn, salt[at] % slices) if ask else (salt[at] % blocks, turn)
                load = _joined(keys, *(query_codes if ask else base_codes)(unit, mean[0], rotate))
                yield _rows(np.zeros(len(at)), block, part, ask, load[at])

        return run

    laid = vectors.mapInArrow(lay(False), LAID).unionByName(vectors.join(asked_keys, "key", "left_semi").mapInArrow(lay(True), LAID))
    near = _rerank(cut_lineage(_scan(laid, mean, dim, k, -2.0)), vectors, dim, k, -2.0, False)
    return _with_copies(ids, near, asked, k)
