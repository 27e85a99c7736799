"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's documents are shuffled (hash order) and laid end to end; the tokens are cut into blocks of equal size. Slots 0, 1, 2, ...
carry golden-ratio points, each mapped through the cumulative target weights to a source, so every stretch of the schedule holds
each source close to its share. A slot's rank among its source's slots is the block of that source's tokens which it takes, repetition after
repetition. As many slots are used as the scarcest source allows with its permitted repetitions.

A source's last repetition is usually a part of its documents. Documents of up to a SMALLth of that part are taken in hash order,
larger ones in hash order up to their share of the source's tokens, and among the documents around both ends the subset is chosen, by
bitset subset sums, that brings the source as near to its due as can be. Ranks and token offsets are two-level scans, so a
source that holds a third of all rows is spread over its shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.tokens import DEFAULT_VOCABULARY, with_token_counts
from quern.runtime import cut_lineage, exclusive_scan

GOLDEN = 0.6180339887498949
SLOTS_PER_SHARD = 1 << 14
#: Blocks are no larger than this, and small enough that the smallest share is made of about BLOCKS_AT_LEAST of them.
BLOCK_TOKENS, BLOCKS_AT_LEAST = 4096, 100
#: Documents above a SMALLth of a source's partial repetition are placed one by one; as many small ones on either side of the end are exchanged.
SMALL = 64


def canonical_source(c: Column) -> Column:
    """Lower case, trimmed, runs of other characters than letters and digits as one underscore; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "_"), r"^_+|_+$", ""), F.lit(""))


def nearest_subset(sizes: list[int], wanted: list[bool], target: float) -> list[int]:
    """Positions of a subset whose sum is as near to ``target`` as any; of those, one that keeps many of the ``wanted``."""
    order = sorted(range(len(sizes)), key=lambda i: wanted[i])  # those wanted are decided on first, going back
    reach, trail = 1, []
    most = max(0, int(target)) * 2 + 1
    for i in order:
        trail.append(reach)
        reach |= (reach << sizes[i]) & ((1 << (most + 1)) - 1)
    below = (reach & ((1 << (max(0, int(target)) + 1)) - 1)).bit_length() - 1
    above = reach >> (below + 1)
    total = below
    if above:
        higher = below + (above & -above).bit_length()
        total = higher if abs(higher - target) < abs(below - target) else below
    out = []
    for i, before in zip(reversed(order), reversed(trail), strict=True):
        without, with_it = before >> total & 1, sizes[i] <= total and before >> (total - sizes[i]) & 1
        if with_it and (wanted[i] or not without):
            out.append(i)
            total -= sizes[i]
    return sorted(out)


def mix_sources(documents: DataFrame, targets: DataFrame, seed: int = 7, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """The selection: (slot bigint, source string, doc_id bigint, copy int, n_tokens bigint), one row per use of a document.

    ``documents`` has doc_id, text and source, ``targets`` source, target_share and max_repeats. Rows without doc_id
    or source, documents without tokens, and sources without a positive target take no part; a null max_repeats is 1. If a
    targeted source has no document at all, the others keep their proportions. Of several target rows of one
    source the shares add up and the largest max_repeats holds. No documents or no targets give an empty result."""
    spark = documents.sparkSession
    wanted = targets.select(canonical_source(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.greatest(F.coalesce(F.col("max_repeats").cast("int"), F.lit(1)), F.lit(0)).alias("repeats"))
    wanted = wanted.where("source is not null and share > 0 and not isnan(share)").groupBy("source").agg(F.sum("share").alias("share"), F.max("repeats").alias("repeats"))
    known = documents.where("doc_id is not null").select("doc_id", "text", canonical_source(F.col("source")).alias("source")).where("source is not null")
    counted = cut_lineage(with_token_counts(known, ["doc_id", "source"], "text", path=vocabulary).where("n_tokens > 0"))

    # one row per target, which is configuration and doesn't grow with the documents
    have = counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    plan = sorted((r["source"], r["share"], r["repeats"], r["tokens"]) for r in wanted.join(have, "source").collect() if r["repeats"] > 0)
    total = sum(share for _, share, _, _ in plan)
    budget = min((repeats * tokens / (share / total) for _, share, repeats, tokens in plan), default=0)
    due = {s: budget * share / total for s, share, _, _ in plan}
    block = max(1, int(min([BLOCK_TOKENS, *(x / BLOCKS_AT_LEAST for x in due.values())])))
    slots = int(budget / block)
    whole = {s: min(repeats, int(due[s] / tokens + 1e-9)) for s, _, repeats, tokens in plan}
    part = {s: due[s] - whole[s] * tokens if whole[s] < repeats else 0.0 for s, _, repeats, tokens in plan}

    pick, below = F.lit(plan[-1][0] if plan else None).cast("string"), 0.0
    point = F.col("slot") * F.lit(GOLDEN) - F.floor(F.col("slot") * F.lit(GOLDEN))
    if plan:
        edges = []
        for _, share, _, _ in plan:
            below += share / total
            edges.append(below)
        names, steps = F.array(*(F.lit(s) for s, *_ in plan)), F.array(*(F.lit(x) for x in edges[:-1])) if len(edges) > 1 else F.array().cast("array<double>")
        pick = F.get(names, F.size(F.filter(steps, lambda e: e <= point)))
    timeline = spark.range(slots).select(F.col("id").alias("slot"), F.floor(F.col("id") / SLOTS_PER_SHARD).alias("shard")).withColumn("source", pick)
    ranked = exclusive_scan(timeline, ["source"], ["slot"], "shard", F.lit(1), "rank").select("slot", "source", F.col("rank").cast("bigint").alias("rank"))

    facts = spark.createDataFrame([(s, float(whole[s]), float(part[s]), float(tokens)) for s, _, _, tokens in plan], "source string, whole double, part double, tokens double")
    h = F.xxhash64("doc_id", F.lit(seed))
    laid = counted.join(F.broadcast(facts), "source").withColumns({"h": h, "shard": F.shiftright(h, 54)})  # one row per target
    laid = exclusive_scan(laid, ["source"], ["h", "doc_id"], "shard", F.col("n_tokens"), "start")
    small = (F.col("n_tokens") * SMALL <= F.col("part")).cast("bigint")
    laid = cut_lineage(exclusive_scan(laid.withColumn("small", small), ["source"], ["h", "doc_id"], "shard", F.col("n_tokens") * F.col("small"), "start_small"))

    uses = laid.select("source", "doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), F.col("whole").cast("int"))).alias("copy"), "whole", "part", "tokens", "start", "start_small", "small", "h").where("copy < whole")
    full = uses.select("source", "doc_id", "copy", "n_tokens", (F.col("copy") * F.col("tokens") + F.col("start")).alias("position"))

    # the partial repetition: how much of it is to be large documents, and which; all lists here are bounded by sources x 4 SMALL rows
    fits = laid.where("part > 0 and n_tokens <= 2 * part")
    sums = {r["source"]: (r["s"] or 0, r["l"] or 0) for r in fits.where("n_tokens <= part").groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("small")).alias("s"), F.sum(F.col("n_tokens") * (1 - F.col("small"))).alias("l")).collect()}
    first = Window.partitionBy("source").orderBy("h", "doc_id")
    large: dict[str, list] = {}
    for r in fits.where("small = 0").withColumn("r", F.row_number().over(first)).where(F.col("r") <= 2 * SMALL).select("source", "h", "doc_id", "n_tokens", "start").orderBy("source", "h", "doc_id").collect():
        large.setdefault(r["source"], []).append(r)
    need, taken_large = {}, {}
    for s in part:
        s_sum, l_sum = sums.get(s, (0, 0))
        aim, got, taken_large[s] = part[s] * l_sum / max(s_sum + l_sum, 1), 0, set()
        for r in large.get(s, ()):
            if got + r["n_tokens"] <= aim:
                got += r["n_tokens"]
                taken_large[s].add(r["start"])
        need[s] = max(0.0, part[s] - got)
    needs = spark.createDataFrame([(s, float(x)) for s, x in need.items()], "source string, need double")
    minor = fits.where("small = 1").join(F.broadcast(needs), "source").withColumn("inside", F.col("start_small") + F.col("n_tokens") <= F.col("need"))
    near = lambda cond, order: minor.where(cond).withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(*order))).where(F.col("r") <= SMALL).select("source", "h", "doc_id", "n_tokens", "start", "start_small", "inside")
    border: dict[str, list] = {}
    for r in near("inside", [F.desc("start_small"), F.desc("h"), F.desc("doc_id")]).unionByName(near("not inside", ["start_small", "h", "doc_id"])).orderBy("source", "start_small", "start").collect():
        border.setdefault(r["source"], []).append(r)
    chosen, cuts = [], []
    for s in part:
        pool = [*large.get(s, ()), *border.get(s, ())]
        keep = [r["start"] in taken_large[s] for r in large.get(s, ())] + [r["inside"] for r in border.get(s, ())]
        cut = min((r["start_small"] for r in border.get(s, ())), default=0)
        chosen += [(s, pool[i]["start"]) for i in nearest_subset([r["n_tokens"] for r in pool], keep, part[s] - cut)] if part[s] > 0 else []
        cuts.append((s, float(cut)))
    before = minor.join(F.broadcast(spark.createDataFrame(cuts, "source string, cut double")), "source").where("start_small < cut")
    exchanged = laid.join(F.broadcast(spark.createDataFrame(chosen, "source string, start bigint")), ["source", "start"])
    spread = F.pmod("h", F.lit(1 << 20)) / F.lit(float(1 << 20)) * F.col("part")
    partial = before.select("source", "doc_id", "whole", "n_tokens", "tokens", (F.col("start_small") * F.col("part") / F.greatest("need", F.lit(1.0))).alias("at")).unionByName(exchanged.select("source", "doc_id", "whole", "n_tokens", "tokens", spread.alias("at")))
    partial = partial.select("source", "doc_id", F.col("whole").cast("int").alias("copy"), "n_tokens", (F.col("whole") * F.col("tokens") + F.col("at")).alias("position"))

    last = F.broadcast(ranked.groupBy("source").agg(F.max("rank").alias("last")))  # one row per target
    placed = full.unionByName(partial).join(last, "source").withColumn("rank", F.least(F.floor(F.col("position") / block).cast("bigint"), "last"))
    return placed.join(ranked, ["source", "rank"]).select("slot", "source", "doc_id", "copy", "n_tokens")


def mix_report(selection: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, tokens, actual_share, miss, documents, most_copies) per target; ``miss`` is the actual share less the target's."""
    wanted = targets.select(canonical_source(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share")).where("source is not null").groupBy("source").agg(F.sum("share").alias("target_share"))
    per_doc = selection.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t"))
    got = per_doc.groupBy("source").agg(F.sum("t").alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("n").alias("most_copies"))
    all_tokens = got.agg(F.sum("tokens").alias("all"))
    joined = wanted.join(got, "source", "left").crossJoin(F.broadcast(all_tokens))  # one row
    zero = F.lit(0).cast("bigint")
    actual = F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0))
    return joined.select("source", "target_share", F.coalesce("tokens", zero).alias("tokens"), actual.alias("actual_share"), (actual - F.col("target_share")).alias("miss"), F.coalesce("documents", zero).alias("documents"), F.coalesce("most_copies", zero).alias("most_copies"))
