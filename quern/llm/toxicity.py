"""Abusive, hateful and sexually explicit language, by weak supervision.

Texts are read through common disguises (look-alike and invisible characters, digits for letters, spaced, stretched and
starred-out words) and divided into sentences. Many lexicon and pattern voters (see ``voters``) vote on a sentence: for, against, or not
at all. A generative label model, fitted by expectation maximisation, estimates how accurate every voter is and which voters depend
on which (a tree of the strongest dependencies given the label; a voter's weight differs where its parent votes too). Its
posteriors are the labels of a linear classifier over a sentence's words, word pairs, word classes and voters, in which sentences without any vote
count as probably harmless. The classifier scores every sentence of every document, whether a voter speaks or not; a document's
score is its worst sentence's.

The label model and the classifier are fitted on the sentences of at most FIT_DOCUMENTS documents, a hash sample.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.mixing import canonical_source
from quern.llm.voters import BIT, CLASSES, KNOWN, VOTERS, compiled, gates, word_masks

#: At most so many documents fit the models; all are scored. Of their sentences without a vote, one in QUIET_EVERY is used.
FIT_DOCUMENTS = 20_000
QUIET_EVERY = 24
FEATURES = 1 << 17
FLAGGED = 0.5
#: A vote counts as so many features of a sentence.
VOTE_COUNTS = 6
#: So many rows without features and probably harmless belong to every fit, which matters where there are few others.
PRIOR_ROWS = 100
#: Rows that are probably abusive are weighted to make up at least this share.
POSITIVE_SHARE = 0.3
#: Longer sentences are read in windows of this many characters, each overlapping the next by half.
MAX_SENTENCE = 300
#: Taken probability that a sentence on which no voter speaks is abusive.
UNHEARD = 0.02

# Characters that look like Latin letters, invisible ones, and signs written for letters.
HOMOGLYPHS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ո": "n", "ⅼ": "l", "ɡ": "g", "α": "a", "ο": "o", "ε": "e", "ι": "i", "ν": "v", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "А": "A", "Е": "E", "О": "O", "Р": "P", "С": "C", "Х": "X", "І": "I", "Ѕ": "S", "Ј": "J", "В": "B", "К": "K", "М": "M", "Т": "T", "Н": "H"}
INVISIBLE = "­​‌‍‎‏⁠﻿᠎͏"
DIGITS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "€": "e", "£": "l", "v": "u", "(": "c", "+": "t"}

_TABLE = {ord(k): v for k, v in HOMOGLYPHS.items()} | {ord(c): None for c in INVISIBLE}
_SQUEEZE = re.compile(r"(.)\1+")
_STRETCHED = re.compile(r"\w*?(\w)\1{2,}\w*")
_SPACED = re.compile(r"(?<![^\W_])[^\W_]([ ._\-*/])[^\W_](?:\1[^\W_])+(?![^\W_])(?:\1(?=\W|$))?")
_CODED = re.compile(r"[^\W_]*[0-9@$!|€£+(][^\W_]*(?:[0-9@$!|€£+(]+[^\W_]*)*")
# A digit or sign inside or before letters; other signs of a disguise are told from a sentence's words (see ``_Words``).
_SIGNS = re.compile(r"[0-9@$!|€£](?:(?<=[^\W\d_].)[0-9@$!|€£]*[^\W\d_]|(?<!\w.)[^\W\d_]{2})|\*\*")
_ODD = re.compile("[" + "".join(HOMOGLYPHS) + INVISIBLE + "]")
_VFORU = re.compile(r"(?<![^\W_])[a-z]*v[a-z]*(?![^\W_])")
_STARRED = re.compile(r"(?<![\w*])[^\W\d_](?:[^\W\d_]{0,2})\*{2,}[^\W\d_]{0,2}(?![\w*])")


@lru_cache(maxsize=1)
def _squeezed() -> dict[str, str]:
    return {_SQUEEZE.sub(r"\1", w): w for w in sorted(KNOWN)}


@lru_cache(maxsize=1)
def _v_words() -> dict[str, str]:
    """Rude words with v for u, where that is no word of its own."""
    every = word_masks()
    return {v: w for name in ("profane", "insult", "slur") for w in sorted(CLASSES[name]) if "u" in w and len(w) > 3 and (v := w.replace("u", "v")) not in every}


def _spaced(m: re.Match[str]) -> str:
    word = re.sub(r"[ ._\-*/]", "", m.group())
    for candidate, before, after in ((word, "", ""), (word[1:], word[0] + " ", ""), (word[:-1], "", " " + word[-1])):
        plain = _decode(candidate)
        if plain:
            return before + plain + after
    return m.group()


def _decode(word: str) -> str | None:
    """The lexicon word that ``word`` stands for when digits and signs are read as letters."""
    if word in KNOWN:
        return word
    if not any(c.isalpha() for c in word):
        return None
    forms = [""]
    for c in word:
        options = DIGITS.get(c, c) if c != "v" else "vu"
        forms = [f + o for f in forms for o in options]
        if len(forms) > 64:
            return None
    return next((f for f in forms if f in KNOWN), None)


def _starred(m: re.Match[str]) -> str:
    token = m.group()
    head, tail = re.split(r"\*+", token)
    n = len(token)
    for w in _by_shape().get((head[0], n), ()):
        if w.startswith(head) and w.endswith(tail):
            return w
    if not tail:  # the last star may have been taken for the end of the sentence
        for w in _by_shape().get((head[0], n + 1), ()):
            if w.startswith(head):
                return w
    return token


@lru_cache(maxsize=1)
def _by_shape() -> dict[tuple[str, int], list[str]]:
    """Words by first letter and length, insults and profanity before others."""
    shapes: dict[tuple[str, int], list[str]] = {}
    seen: set[str] = set()
    for name in ("profane", "insult", "slur", "mean", "demean", "bare", "part", "act"):
        for w in sorted(CLASSES[name] - seen):
            shapes.setdefault((w[0], len(w)), []).append(w)
        seen |= CLASSES[name]
    return shapes


def _stretched(m: re.Match[str]) -> str:
    return _squeezed().get(_SQUEEZE.sub(r"\1", m.group()), m.group())


def _coded(m: re.Match[str]) -> str:
    token = m.group()
    plain = _decode(token)
    if plain is None and token[-1] in "!|(+":
        tail = len(token) - len(token.rstrip("!|(+"))
        plain = _decode(token[:-tail])
        return plain + token[-tail:] if plain else token
    return plain or token


def plain_letters(text: str) -> str:
    """Lower case, without invisible characters, look-alikes as the Latin letters they imitate."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        if _ODD.search(text):
            text = text.translate(_TABLE)
    return text.lower()


def undisguised(low: str) -> str:
    """A sentence in lower case with disguised lexicon words in their plain spelling."""
    low = _SPACED.sub(_spaced, low)
    low = _CODED.sub(_coded, low)
    if "**" in low:
        low = _STARRED.sub(_starred, low)
    if "v" in low:
        swaps = _v_words()
        low = _VFORU.sub(lambda m: swaps.get(m.group(), m.group()), low)
    return _STRETCHED.sub(_stretched, low)


_WRAP = re.compile(r"\n(?<=[^\W\d_]\n|[,;’']\n)[ \t]*(?=[a-zß-öø-ÿ])")
_BREAK = re.compile(r"[.!?…\r\n](?:(?<=[\r\n])[\r\n]*|[.!?…]*(?=\s|$))")
#: Letters; not those of codes such as ab-12.
_WORDS = re.compile(r"[^\W\d_]++(?!-?\d)")


def sentences(text: str) -> list[str]:
    """The sentences of a text in plain letters, white space collapsed; very long ones as overlapping windows. A single line end
    within a sentence is white space."""
    if "\n" in text:
        text = _WRAP.sub(" ", text.replace("\r\n", "\n"))
    low = plain_letters(text).replace(" lol ", " lol. ")
    out, start = [], 0
    for end in [*(m.end() for m in _BREAK.finditer(low)), len(low)]:
        s = " ".join(low[start:end].split())
        start = end
        if len(s) > MAX_SENTENCE:
            out += [s[i : i + MAX_SENTENCE] for i in range(0, len(s) - MAX_SENTENCE // 2, MAX_SENTENCE // 2)]
        elif len(s) > 2:
            out.append(s)
    return out


_ODD_BIT, _LETTER_BIT = 62, 61


class _Words(dict):
    """Word -> place in ``numbers`` and ``masks``, computed once per word. A mask has a bit for each class of the word, for a
    word that is stretched or written with v for u, and for a letter that stands alone."""

    def __init__(self):
        super().__init__()
        self.numbers, self.masks = np.zeros(1 << 16, dtype=np.uint64), np.zeros(1 << 16, dtype=np.uint64)

    def __missing__(self, word: str) -> int:
        i = len(self)
        if i == len(self.numbers):
            self.numbers, self.masks = np.concatenate([self.numbers, self.numbers]), np.concatenate([self.masks, self.masks])
        mask = word_masks().get(word, 0)
        if len(word) == 1:
            mask |= 1 << _LETTER_BIT
        elif word in _v_words() or _STRETCHED.fullmatch(word):
            mask |= 1 << _ODD_BIT
        self.numbers[i], self.masks[i] = crc32(word.encode()), mask
        self[word] = i
        return i


_seen = _Words()
#: Classes of words that are seldom used without offence.
CHARGED = ("insult", "slur", "profane", "smell", "bare")
_CLASS_AT, _VOTER_AT, _PAIR_AT = np.uint64(0x51ED270B), np.uint64(0x9E3779B1), np.uint64(0x85EBCA77)


def _slots(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(47)).astype(np.int64)  # FEATURES is 2 ** 17


def _tokenised(held: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per sentence its number of words; per word its number and mask."""
    if len(_seen) > 2_000_000:
        _seen.clear()
    words = [_WORDS.findall(s) for s in held]
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    at = np.fromiter(map(_seen.__getitem__, chain.from_iterable(words)), dtype=np.int64, count=int(size.sum()))
    return size, _seen.numbers[at], _seen.masks[at]


def _disguised(held: list[str], size: np.ndarray, mask: np.ndarray) -> list[int]:
    """The sentences that show a sign of a disguise."""
    who = np.repeat(np.arange(len(held)), size)
    odd = set(who[(mask >> np.uint64(_ODD_BIT) & np.uint64(1)) == 1].tolist())
    alone = (mask >> np.uint64(_LETTER_BIT) & np.uint64(1)) == 1
    run = alone[2:] & alone[1:-1] & alone[:-2] & (who[2:] == who[:-2]) if len(who) > 2 else np.zeros(0, dtype=bool)
    odd |= set(who[2:][run].tolist())
    odd |= {i for i, s in enumerate(held) if _SIGNS.search(s)}
    return sorted(odd)


def featured(held: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of sentences as (sentence, slot) pairs, and the votes as (sentence, voter) pairs; disguised sentences are read plainly.

    A voter is tried only where the sentence holds every class that it names, and voters against only where one votes for or the
    sentence holds a word of a CHARGED class."""
    size, number, mask = _tokenised(held)
    odd = _disguised(held, size, mask)
    if odd:
        held = list(held)
        for i in odd:
            held[i] = undisguised(held[i])
        size, number, mask = _tokenised(held)
    who = np.repeat(np.arange(len(held)), size)
    held_by = np.zeros(len(held), dtype=np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        held_by[full] = np.bitwise_or.reduceat(mask, (np.cumsum(size) - size)[full])
    together = np.flatnonzero(who[1:] == who[:-1]) if len(who) else np.zeros(0, np.int64)
    pair = (number[together] * np.uint64(31) + number[together + 1]) ^ _PAIR_AT
    rows, slots = [who, who[together]], [_slots(number), _slots(pair)]
    for bit in BIT.values():
        at = np.flatnonzero(held_by >> np.uint64(bit) & np.uint64(1))
        rows.append(at)
        slots.append(np.broadcast_to(_slots(np.array([bit], dtype=np.uint64) ^ _CLASS_AT), at.shape))
    spoke: list[tuple[int, int]] = []
    tried = np.arange(len(held))
    for j, (voter, gate, pattern) in enumerate(zip(VOTERS, gates(), compiled(), strict=True)):
        if voter.vote < 0 and VOTERS[j - 1].vote > 0:
            charged = np.flatnonzero(held_by & np.uint64(sum(1 << BIT[n] for n in CHARGED)))
            tried = np.unique(np.concatenate([charged, np.array([i for i, _ in spoke], dtype=np.int64)]))
        need = np.uint64(gate)
        spoke += [(i, j) for i in tried[(held_by[tried] & need) == need].tolist() if pattern.search(held[i])]
    voted = np.array(spoke, dtype=np.int64).reshape(-1, 2)
    rows.append(np.repeat(voted[:, 0], VOTE_COUNTS))
    slots.append(np.repeat(_slots(voted[:, 1].astype(np.uint64) ^ _VOTER_AT), VOTE_COUNTS))
    return np.concatenate(rows), np.concatenate(slots), voted


def fit_label_model(matrix: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
    """Posterior probability of each row of votes (-1, 0, 1), each voter's accuracy, and each dependent voter's parent.

    Voters may depend on one another given the label: in every round the conditional dependencies of voters that vote alike are estimated and
    the strongest, as far as they exceed chance, form a forest. The weight of a voter whose parent votes too is estimated from the
    rows on which both vote. Rows for which no voter speaks say nothing about the voters; their posterior is UNHEARD."""
    m = matrix.shape[1]
    heard = (matrix > 0).any(axis=1)
    votes_, spoke = matrix[heard], (matrix[heard] != 0).astype(np.float64)
    n = len(votes_)
    accuracy, parent = np.full(m, 0.85), {}
    pair_weight: dict[int, float] = {}
    prior = float(np.clip(((votes_.sum(axis=1) > 0).sum() + 1) / (n + 2), 0.3, 0.7))
    posterior = np.full(n, prior)
    counts = spoke.T @ spoke
    sign = np.where((votes_ > 0).any(axis=0), 1.0, -1.0)
    for turn in range(rounds):
        weight = np.log(accuracy / (1 - accuracy))
        logit = np.log(prior / (1 - prior)) + votes_ @ weight
        for j, p in parent.items():
            logit += (spoke[:, j] * spoke[:, p]) * (sign[j] * (pair_weight[j] - weight[j]))
        posterior = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        right = np.where(votes_ > 0, posterior[:, None], 1 - posterior[:, None]) * spoke
        accuracy = np.clip((right.sum(axis=0) + 6.8) / (spoke.sum(axis=0) + 8), 0.55, 0.99)
        prior = float(np.clip((posterior.sum() + 5) / (n + 10), 0.3, 0.7))
        if turn < 3:
            continue
        # how much more often two voters of one sign vote together than they would if independent given the label
        by_class = [(posterior, spoke.T @ (spoke * posterior[:, None])), (1 - posterior, spoke.T @ (spoke * (1 - posterior)[:, None]))]
        expected = sum(np.outer(spoke.T @ q, spoke.T @ q) / max(q.sum(), 1e-9) for q, _ in by_class)
        excess = (counts - expected) / np.sqrt(expected + 1)
        excess[np.outer(sign, sign) < 0] = 0
        parent, tree = {}, list(range(m))

        def root(x: int) -> int:
            while tree[x] != x:
                x = tree[x]
            return x

        for flat in np.argsort(-excess, axis=None)[: m * m]:
            a, b = divmod(int(flat), m)
            if excess[a, b] < 3 or a >= b:
                if excess[a, b] < 3:
                    break
                continue
            child, other = (a, b) if spoke[:, a].sum() <= spoke[:, b].sum() else (b, a)
            if child in parent:
                child, other = other, child
            if child not in parent and root(child) != root(other):
                parent[child] = other
                tree[root(child)] = root(other)
        for j, p in parent.items():
            both = spoke[:, j] * spoke[:, p]
            share = (float((right[:, j] * both).sum()) + 6.8) / (float(both.sum()) + 8)
            share = float(np.clip(share, 0.55, 0.99))
            # what both say together, less what the parent says, and never more than the voter says alone
            pair_weight[j] = float(np.clip(np.log(share / (1 - share)) - np.log(accuracy[p] / (1 - accuracy[p])), 0.1, np.log(accuracy[j] / (1 - accuracy[j]))))
    out = np.full(len(matrix), UNHEARD)
    out[heard] = posterior
    return out, accuracy, parent


def fit_classifier(n: int, who: np.ndarray, what: np.ndarray, labels: np.ndarray, weight: np.ndarray, rounds: int = 200, l2: float = 1.0, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Logistic regression of ``n`` weighted rows on soft labels by full-batch adaptive gradient steps."""
    scale = 1 / np.sqrt(np.maximum(np.bincount(who, minlength=n), 1))
    likely = labels > 0.5
    if likely.any():
        weight = np.where(likely, weight * max(1.0, POSITIVE_SHARE / (1 - POSITIVE_SHARE) * (weight[~likely].sum() + PRIOR_ROWS) / weight[likely].sum()), weight)
    weights, seen, seen_b = np.zeros(FEATURES), np.full(FEATURES, 1e-8), 1e-8
    total = max(weight.sum(), 1.0)
    bias = float(np.log(UNHEARD / (1 - UNHEARD)))
    for _ in range(rounds):
        z = np.bincount(who, weights[what], n) * scale + bias
        error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / total
        grad = np.bincount(what, (error * scale)[who], FEATURES) + l2 * weights / total
        grad_b = error.sum() + PRIOR_ROWS * (1 / (1 + np.exp(-bias)) - UNHEARD) / total
        seen += grad**2
        seen_b += grad_b**2
        weights -= rate * grad / np.sqrt(seen)
        bias -= rate * grad_b / np.sqrt(seen_b)
    return weights, bias


def fit(held: list[str], weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """The classifier's weights and bias, from sentences without labels."""
    who, what, voted = featured(held)
    matrix = np.zeros((len(held), len(VOTERS)))
    matrix[voted[:, 0], voted[:, 1]] = np.array([v.vote for v in VOTERS])[voted[:, 1]]
    posterior, *_ = fit_label_model(matrix)
    return fit_classifier(len(held), who, what, posterior, np.ones(len(held)) if weight is None else weight)


def score_sentences(held: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    who, what, _ = featured(held)
    n = np.maximum(np.bincount(who, minlength=len(held)), 1)
    return 1 / (1 + np.exp(-(np.bincount(who, weights[what], len(held)) / np.sqrt(n) + bias)))


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sentence, heard): sentences on which a voter speaks, and one in QUIET_EVERY of the others by hash."""
    for batch in batches:
        held = [s for t in batch.column(0).to_pylist() for s in set(sentences(t))]
        *_, voted = featured(held)
        heard = np.zeros(len(held), dtype=bool)
        heard[voted[:, 0]] = True
        kept = [i for i, s in enumerate(held) if heard[i] or crc32(s.encode()) % QUIET_EVERY == 0]
        yield pa.RecordBatch.from_arrays([pa.array([held[i] for i in kept], pa.string()), pa.array(heard[kept], pa.bool_())], names=["sentence", "heard"])


def scored_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, score) of the documents that hold a sentence; all others have score 0."""
    usable = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    n = usable.count()
    share = min(1.0, FIT_DOCUMENTS / max(n, 1))
    drawn = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) <= int(share * (1 << 20))).select("text")
    # bounded by FIT_DOCUMENTS; equal sentences count once
    table = drawn.mapInArrow(_training_rows, "sentence string, heard boolean").distinct().toArrow()
    rows = sorted(zip(table.column("sentence").to_pylist(), table.column("heard").to_pylist(), strict=True))
    weights, bias = fit([s for s, _ in rows], np.array([1.0 if h else float(QUIET_EVERY) / 4 for _, h in rows]))
    shared = documents.sparkSession.sparkContext.broadcast((weights.astype(np.float32), bias))  # FEATURES numbers
    kind = documents.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                piece = batch.slice(lo, 500)
                split = [sentences(t) for t in piece.column(1).to_pylist()]
                held = [s for x in split for s in x]
                sizes = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
                worst, full = np.zeros(len(split)), np.flatnonzero(sizes)
                if len(full):
                    worst[full] = np.maximum.reduceat(score_sentences(held, w, b), (np.cumsum(sizes) - sizes)[full])
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(worst, pa.float64())], names=["doc_id", "score"])

    return usable.mapInArrow(score, f"doc_id {kind}, score double").groupBy("doc_id").agg(F.max("score").alias("score"))


def score_documents(documents: DataFrame) -> DataFrame:
    """One row per document: (doc_id, source, score double, flagged boolean).

    Documents without a doc_id take no part; null, empty and wordless texts score 0; repeated rows of a doc_id count once, with
    their worst score. An empty table gives an empty result."""
    every = documents.where("doc_id is not null").groupBy("doc_id").agg(F.min(canonical_source(F.col("source"))).alias("source"))
    joined = every.join(scored_documents(documents), "doc_id", "left")
    return joined.select("doc_id", "source", F.coalesce("score", F.lit(0.0)).alias("score")).withColumn("flagged", F.col("score") >= FLAGGED)


def rates_by_source(scores: DataFrame) -> DataFrame:
    """(source, documents, flagged, rate, mean_score) per source."""
    hit = F.col("flagged").cast("bigint")
    return scores.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(hit).alias("flagged"), F.avg(hit).alias("rate"), F.avg("score").alias("mean_score"))
