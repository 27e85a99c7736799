"""Text of scanned pages repaired into continuous readable paragraphs.

A first pass over all chunks tells scanned uploads from others by the layout of their chunks; a second counts the words of the
other uploads, the most frequent of which are the lexicon. Every chunk of a scanned upload is a page, whatever its own layout. Running
headers (numbered, or repeated in their document) and page numbers are taken out of a page. Where the rest holds words that the lexicon
doesn't know, or words broken at a line's end, the characters around them are read as one stream without line ends, and a joint
segmentation is decoded by dynamic programming over character positions: a word may begin and end anywhere, run through blanks (any number of merges),
line ends and line-end hyphens, end within a token (any number of splits), and be read through character confusions, each at a cost
against the word's probability. Confusions cost what their frequency in the pages says. Paragraph boundaries between lines are chosen by a second
dynamic program over how full the lines are.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.latest import latest_rows
from quern.runtime import cut_lineage

#: The lexicon holds at most so many words, each seen at least MIN_COUNT times.
LEXICON_WORDS, MIN_COUNT = 200_000, 3
MAX_WIDTH = 90
FULL_SHARE = 0.8

# What a character is often read as -> what it was; hyphens at line ends; formats that aren't scanned pages.
CONFUSIONS = [("c", "e"), ("æ", "a"), ("f", "t"), ("!", "i"), ("|", "i"), ("!", "l"), ("|", "l"), ("0", "o"), ("ri", "n"), ("1", "l"), ("1", "i"), ("5", "s"), ("ii", "u"), ("cl", "d"), ("b", "h"), ("9", "g"), ("rn", "m"), ("vv", "w"), ("8", "b"), ("6", "b"), ("$", "s"), ("€", "e")]
SIGNS = "0158969!|æ$€"
HYPHENS = "-‐‑¬­"
NOT_SCANNED = ("audio", "video", "csv", "excel", "json", "xml", "yaml", "code", "html", "markdown")

WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
COMPOUND = re.compile(r"[^\W\d_]{2,}(?:-[^\W\d_]{2,})+")
_PAGE_WORD = r"(?:page|pages|pg|p|seite|s|página|pagina|pág|folio|blatt)"
_NUMBER = r"\d{1,4}(?:\s*(?:of|von|de|sur|/)\s*\d{1,4})?"
_PAGE = rf"(?:{_PAGE_WORD}\.?\s*{_NUMBER}|\[\s*{_NUMBER}\s*\]|[-–—~]\s*{_NUMBER}\s*[-–—~]|\d{{1,4}}\s*/\s*\d{{1,4}})"
PAGE_LINE = re.compile(rf"^\s*(?:{_PAGE}|\d{{1,4}})\s*$", re.I)
PAGE_BEFORE = re.compile(rf"^\s*(?:{_PAGE}|\d{{1,4}})\s*[|·•]\s*|^\s*{_PAGE}\s{{2,}}", re.I)
PAGE_AFTER = re.compile(rf"\s*[|·•]\s*(?:{_PAGE}|\d{{1,4}})\s*$|\s{{2,}}(?:{_PAGE}|\d{{1,4}})\s*$", re.I)
_ENDS = ".!?;:,"


def wrap_share(text: str) -> float | None:
    """Of the long lines, the share that could not have taken the next line's first word; None if too few lines tell, 0 if
    a line is longer than a scanned page's."""
    lines = [x.rstrip() for x in text.split("\n")]
    lines = [x for x in lines if x.strip()]
    width = max(map(len, lines), default=0)
    if width > MAX_WIDTH:
        return 0.0
    if len(lines) < 4:
        return None
    full = told = 0
    for a, b in pairwise(lines):
        if len(a) >= 0.6 * width:
            told += 1
            full += len(a) + 1 + len(b.split(maxsplit=1)[0]) > width - 1
    return full / told if told >= 2 else None


def _layout(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, n): for every document its hard-wrapped chunks less the others whose layout tells."""
    for batch in batches:
        votes: Counter[str] = Counter()
        for doc, text in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
            share = wrap_share(text)
            if share is not None:
                votes[doc] += 1 if share >= FULL_SHARE else -1
        yield pa.RecordBatch.from_arrays([pa.array(list(votes), pa.string()), pa.array(list(votes.values()), pa.int64())], names=["doc", "n"])


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind, a, doc, n, text): counts of words of unscanned uploads (w), compound counts (c), pages of scanned ones (p)."""
    words: Counter[str] = Counter()
    compounds: Counter[str] = Counter()

    def counts() -> pa.RecordBatch:
        rows = [("w", w, None, n, None) for w, n in words.items()] + [("c", w, None, n, None) for w, n in compounds.items()]
        words.clear(), compounds.clear()
        return _batch(rows)

    for batch in batches:
        pages = []
        for chunk, doc, text, scanned in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if scanned:
                pages.append(("p", chunk, doc, None, text))
            else:
                words.update(WORD.findall(text.lower()))
            if "-" in text:
                compounds.update(COMPOUND.findall(text.lower()))
        if pages:
            yield _batch(pages)
        if len(words) > 200_000:
            yield counts()
    yield counts()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["kind", "a", "doc", "n", "text"])


class Lexicon:
    def __init__(self, words: dict[str, int], compounds: dict[str, int], costs: dict[tuple[str, str], float] | None = None):
        self.words, self.compounds = words, compounds
        self.total = math.log(sum(words.values()) + 1)
        self.frequent = max(math.exp(self.total) / 500, 2)
        self.sorted = sorted(words)
        self._read: dict[str, tuple[str, int] | None] = {}
        self.confusions: dict[str, list[tuple[str, str, float]]] = {}
        for seen, meant in CONFUSIONS:
            self.confusions.setdefault(seen[0], []).append((seen, meant, (costs or {}).get((seen, meant), CONFUSED)))

    def begins(self, form: str) -> bool:
        """Whether a word begins with ``form``."""
        i = bisect_left(self.sorted, form)
        return i < len(self.sorted) and self.sorted[i].startswith(form)

    def unknown(self, size: int) -> float:
        return self.total + 2 + 0.5 * size + max(0, size - 14)

    def words_from(self, s: str, start: int) -> Iterator[tuple[int, str, float, int, bool, int]]:
        """Words that the characters from ``start`` on may spell: (end, word, cost of the reading, confusions, whether a line-end hyphen was dropped,
        blanks run through)."""
        stack = [(start, "", 0.0, 0, False, 0)]
        low = s.lower()
        while stack:
            at, form, cost, edits, joined, merged = stack.pop()
            if len(form) > 1 and form in self.words:
                yield at, form, cost, edits, joined, merged
            if at >= len(s):
                continue
            c, nxt = low[at], []
            if c.isalpha() or c in "'’":
                nxt.append((at + 1, form + c, cost, edits, joined, merged))
            elif form and c == " " and merged < MOST_MERGES:
                nxt.append((at + 1, form, cost + MERGED, edits, joined, merged + 1))
            elif form and c == "\n" and merged < MOST_MERGES:
                nxt.append((at + 1, form, cost + MERGED + 1, edits, joined, merged + 1))
            elif form and c in HYPHENS and low[at + 1 : at + 2] == "\n":
                nxt.append((at + 2, form, cost + DROPPED_HYPHEN, edits, True, merged))
            if edits < 3:
                for seen, meant, price in self.confusions.get(c, ()):
                    if low.startswith(seen, at):
                        nxt.append((at + len(seen), form + meant, cost + price, edits + 1, joined, merged))
            stack += [x for x in nxt if x[1] == form or self.begins(x[1])]

    def cost(self, word: str) -> float:
        n = self.words.get(word.lower(), 0)
        return self.total - math.log(n) if n else self.unknown(len(word))

    def knows(self, word: str) -> bool:
        return word.lower() in self.words

    def read(self, token: str) -> tuple[str, int] | None:
        """The most probable known word that ``token`` may be a misreading of, and by how many confusions."""
        if token not in self._read:
            if len(self._read) > 500_000:
                self._read.clear()
            self._read[token] = self._search(token)
        return self._read[token]

    def _search(self, token: str) -> tuple[str, int] | None:
        if len(token) > 40:
            return None
        forms = {token.lower()}
        for edits in (1, 2, 3):
            nxt = set()
            for f in forms:
                for seen, meant in CONFUSIONS:
                    i = f.find(seen)
                    while i >= 0:
                        nxt.add(f[:i] + meant + f[i + len(seen) :])
                        i = f.find(seen, i + 1)
            found = [(self.words[f], f) for f in nxt if len(f) > 2 and f in self.words]
            if found:
                return max(found)[1], edits
            forms = nxt if len(nxt) <= 3000 else set()
        return None


@dataclass
class Page:
    paragraphs: list[str] = field(default_factory=list)
    defects: set[str] = field(default_factory=set)
    titles: list[str] = field(default_factory=list)


def title_key(line: str) -> str:
    """A header line's letters, read through the commonest confusions."""
    low = line.lower()
    for seen, meant in (("0", "o"), ("1", "l"), ("5", "s"), ("|", "l"), ("!", "i"), ("æ", "a"), ("rn", "m"), ("ii", "u"), ("cl", "d"), ("i", "l")):
        low = low.replace(seen, meant)
    return re.sub(r"[\W\d_]+", "", low)


def _title_like(line: str) -> bool:
    words = [w for w in re.findall(r"[|!]?[^\W_]+", line) if not w.isdigit()]
    return len(words) >= 2 and len(line) <= 80 and all(w[0].isupper() or w[0] in SIGNS for w in words) and line.rstrip()[-1:] not in _ENDS and line.rstrip()[-1:] not in HYPHENS


def strip_furniture(lines: list[str], heads: frozenset[str] | set[str] = frozenset()) -> tuple[list[str], Page]:
    """The body's lines, and a page with the defects found on the way. A standing line of capitalised words that ends in a
    number is a header; other such lines at the page's edges are candidates, which are headers if they are among ``heads``, the
    titles that repeat in the document."""
    page, body = Page(), []
    capitals = sum(1 for x in lines if x.isupper()) > 0.5 * max(1, len(lines))
    inked = [i for i, x in enumerate(lines) if x.strip()]
    for i, line in enumerate(lines):
        if PAGE_LINE.match(line):
            page.defects.add("page_number")
            continue
        rest = PAGE_AFTER.sub("", PAGE_BEFORE.sub("", line)).strip()
        if not rest or not _title_like(rest):
            body.append(line)
            continue
        numbered = re.search(r"(?:^|\s)[\dlIoO|!]{1,4}$", rest) is not None
        edge = bool(inked) and i in (inked[0], inked[-1], *inked[1:2])
        if edge:
            page.titles.append(title_key(rest))
        if numbered and len(rest.split()) >= 3 and not capitals or edge and (title_key(rest) in heads or numbered and capitals):
            page.defects.add("running_header")
        elif edge and rest != line.strip() and not capitals:
            body.append(rest)  # a title of its own beside a page number
        else:
            body.append(line)
            continue
        if rest != line.strip():
            page.defects.add("page_number")
    return body, page


_CORE = re.compile(r"^([\"'“”‘’«»(\[]*)(.*?)([\"'“”‘’«»)\].,;:?…]*)$", re.S)
_SIGNED = re.compile(r"[^\W\d_][0159689!|æ$€]+[^\W\d_]|^[015!|]+[^\W\d_]{3,}|[^\W\d_]{3,}[015!|]+$")


def _match_case(word: str, like: str) -> str:
    if like.isupper() and len(like) > 1:
        return word.upper()
    return word[:1].upper() + word[1:] if like[:1].isupper() else word


CONFUSED, MERGED, SPLIT, SPLIT_FREQUENT, KEPT_HYPHEN, DROPPED_HYPHEN, STRAY_HYPHEN = 5.0, 6.0, 8.0, 3.0, 1.0, 0.5, 3.0
MOST_MERGES = 6
_POST = "\"'“”‘’«»)].,;:!?…"


def _sure(core: str, lexicon: Lexicon) -> bool:
    """Whether a token needs no reading: a known word, a number, a code, or no letters at all."""
    return not core or lexicon.knows(core) or not any(c.isalpha() for c in core) or re.fullmatch(r"[A-Z]{1,4}-?\d+", core) is not None or ("-" in core and lexicon.compounds.get(core.lower(), 0) > 1)


def _token_arcs(s: str, start: int, end: int, follow: int, lexicon: Lexicon) -> Iterator[tuple[int, float, str, str]]:
    """Readings of a whole token, and of a token broken at a line's end with the next, that need no lexicon word: (end, cost, text, how).

    ``follow`` is the end of the next token if this one is broken, else 0."""
    token = s[start:end]
    if follow:
        head, tail = re.match(r"^(\W*)(.*)$", token[:-1]).groups()  # type: ignore[union-attr]
        nxt, right, rest = _CORE.match(s[end + 1 : follow]).groups()  # type: ignore[union-attr]
        joined, compound, last = tail + right, tail + "-" + right, tail.rpartition("-")[2]
        whole = lexicon.compounds.get(compound.lower(), 0)
        solid = lexicon.words.get(joined.lower(), 0) or (lexicon.compounds.get(joined.lower(), 0) if "-" in joined else 0)
        join = DROPPED_HYPHEN + (lexicon.total - math.log(solid) if solid else lexicon.unknown(len(joined)))
        keep = math.inf
        if not right[:1].isalpha() and right[:1] not in SIGNS or right[:1].isupper() and not tail.isupper():
            keep = KEPT_HYPHEN
        elif token[-1] in "-‐‑" and whole:
            keep = KEPT_HYPHEN + lexicon.total - math.log(whole)
        elif token[-1] in "-‐‑" and lexicon.knows(last) and lexicon.knows(right):
            keep = min(join - 1, KEPT_HYPHEN + lexicon.unknown(len(last + right))) if not solid else math.inf
        if keep < math.inf:
            yield follow, keep, head + compound + rest, "keep"
        yield follow, join, head + nxt + joined + rest, "join"
        yield end, lexicon.cost(tail) + STRAY_HYPHEN, token[:-1] if lexicon.knows(tail) else token, "keep"
        return
    pre, core, post = _CORE.match(token).groups()  # type: ignore[union-attr]
    if core[-1:] == "!" and (lexicon.knows(core[:-1]) or not lexicon.read(core)):
        core, post = core[:-1], "!" + post  # it ends the sentence
    plain = lexicon.cost(core or token)
    yield end, plain, token, "keep"
    if _sure(core, lexicon):
        return
    if "-" in core:
        parts = core.split("-")
        reads = [(p, 0) if lexicon.knows(p) else lexicon.read(p) for p in parts]
        if all(reads) and any(r[1] for r in reads):  # type: ignore[index]
            yield end, plain - 1, pre + "-".join(_match_case(r[0], p) for r, p in zip(reads, parts, strict=True)) + post, "read"  # type: ignore[index]
    elif _SIGNED.search(core) and sum(c.isalpha() for c in core) >= 4:
        yield end, plain - 1, token, "signed"


def _read_stream(s: str, lexicon: Lexicon) -> list[tuple[int, str, str]]:
    """The most probable reading of a stream of characters (blanks between tokens, line ends between lines): (start, text, how) of its words."""
    n = len(s)
    ends: dict[int, int] = {m.start(): m.end() for m in re.finditer(r"[^ \n]+", s)}
    stop = {j for i, e in ends.items() for j in range(i, e)}
    token_end = [0] * (n + 1)
    for i, e in ends.items():
        token_end[i : e + 1] = [e] * (e + 1 - i)
    best: list[tuple[float, int, str, str]] = [(math.inf, 0, "", "")] * (n + 1)
    best[0] = (0.0, 0, "", "")

    def offer(to: int, cost: float, start: int, text: str, how: str) -> None:
        if cost < best[to][0]:
            best[to] = (cost, start, text, how)

    for i in range(n):
        at = best[i][0]
        if at == math.inf:
            continue
        if i not in stop:
            offer(i + 1, at, i, "", "skip")
            continue
        begin = i
        if i in ends:
            e = ends[i]
            broken = s[e : e + 1] == "\n" and e - i > 1 and s[e - 1] in HYPHENS and s[e - 2].isalpha() and e + 1 in ends
            for to, cost, text, how in _token_arcs(s, i, e, ends[e + 1] if broken else 0, lexicon):
                offer(to, at + cost, i, text, how)
            while begin < e and not s[begin].isalnum() and s[begin] not in SIGNS:
                begin += 1
        for end, word, cost, edits, joined, merged in lexicon.words_from(s, begin):
            close = end
            while close < n and s[close] in _POST:
                close += 1
            whole = close >= n or close not in stop
            if not (edits or joined or merged) and whole and i in ends:
                continue  # the token as it stands
            price = at + lexicon.cost(word) + cost - (3 if edits else 0)
            shown = s[i:begin] + _match_case(word, s[begin:end]) + s[end:close]
            how = ("join-read" if edits else "join") if joined else "read" if edits else "merge" if merged else "split"
            if whole:
                offer(close, price, i, shown, how)
            elif s[close] in HYPHENS and s[close + 1 : close + 2] == "\n" and (edits or merged):
                offer(close + 1, price + STRAY_HYPHEN, i, shown, how)  # a whole word before a stray hyphen
            elif not edits and not joined and not merged and s[end].isalpha() and token_end[end] - end > 1:
                often = lexicon.words.get(word, 0) > lexicon.frequent or i not in ends
                offer(end, price + (SPLIT_FREQUENT if often else SPLIT) + (6 if s[begin].isupper() and not s[end].isupper() else 0), i, s[i:begin] + s[begin:end], "split")
    steps, i = [], n
    while i > 0:
        _, start, text, how = best[i]
        if how != "skip":
            steps.append((start, text, how))
        i = start
    return steps[::-1]


def decode(lines: list[str], lexicon: Lexicon) -> tuple[list[list[str]], bool, bool]:
    """Words of every line (a word joined across lines belongs to the first), whether any was hyphenated, whether any was misread."""
    out: list[list[str]] = [[] for _ in lines]
    tokens = [(t, i) for i, line in enumerate(lines) for t in line.split()]
    n, doubt = len(tokens), set()
    for k, (t, line) in enumerate(tokens):
        broken = k + 1 < n and tokens[k + 1][1] != line and len(t) > 1 and t[-1] in HYPHENS and t[-2].isalpha()
        if broken or not _sure(_CORE.match(t).group(2), lexicon):  # type: ignore[union-attr]
            doubt |= {k - 1, k, k + 1}
    hyphenated = misread = False
    k = 0
    while k < n:
        if k not in doubt:
            out[tokens[k][1]].append(tokens[k][0])
            k += 1
            continue
        first = k
        while k < n and k in doubt:
            k += 1
        # the stretch as one stream, with the line of every position
        stream, line_at = "", []
        for t, line in tokens[first:k]:
            if line_at:
                stream += " " if line_at[-1] == line else "\n"
                line_at.append(line)
            stream += t
            line_at += [line] * len(t)
        for start, text, how in _read_stream(stream, lexicon):
            out[line_at[start]].append(text)
            hyphenated |= how.startswith("join")
            misread |= how in ("read", "join-read", "signed")
    return out, hyphenated, misread


def _single_readings(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """(seen, meant, n): how often a page's unknown token is a known word but for one confusion."""
    lexicon, counts = None, Counter()
    for batch in batches:
        lexicon = lexicon or Lexicon(*shared.value)
        for text in batch.column(0).to_pylist():
            for token in text.lower().split():
                core = _CORE.match(token).group(2)  # type: ignore[union-attr]
                if core and not _sure(core, lexicon) and len(core) > 3:
                    for seen, meant in CONFUSIONS:
                        i = core.find(seen)
                        if i >= 0 and lexicon.knows(core[:i] + meant + core[i + len(seen) :]):
                            counts[seen, meant] += 1
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in counts], pa.string()), pa.array([x[1] for x in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["seen", "meant", "n"])


def confusion_costs(counts: dict[tuple[str, str], int]) -> dict[tuple[str, str], float]:
    """What each confusion costs: CONFUSED at an even share of all, more the rarer it is."""
    total = sum(counts.values()) + len(CONFUSIONS)
    return {c: min(8.0, max(3.5, CONFUSED + 0.5 * (math.log(total / len(CONFUSIONS)) - math.log(counts.get(c, 0) + 1)))) for c in CONFUSIONS}


def paragraph_starts(lines: list[str]) -> list[bool]:
    """Which lines open a paragraph: the segmentation of least cost, where a break is cheap after a short line that ends a
    sentence and dear after a full one, and every paragraph costs a little."""
    width = max((len(x) for x in lines), default=0)
    cost_break, cost_join = [0.0], [0.0]
    for a, b in pairwise(lines):
        slack = width - len(a) - 1 - len(b.split(maxsplit=1)[0]) if b.split() else width
        ends = a.rstrip()[-1:] in ".!?…:"
        begins = b.lstrip()[:1].isupper() or b.lstrip()[:1].isdigit() or b[:1] in " \t•-*"
        cost_break.append(2.0 + (0 if slack > 3 else 4) + (0 if ends else 5) + (0 if begins else 3))
        cost_join.append(0.0 if slack <= 3 else 3.0 + (2.0 if ends and begins else 0.0))
    joined, opened, back = math.inf, 0.0, [(False, False)]
    for k in range(1, len(lines)):
        from_open, from_join = opened, joined
        least, via = min((from_open, True), (from_join, False))
        joined, opened = least + cost_join[k], least + cost_break[k]
        back.append((via, via))
    starts, state = [False] * len(lines), opened < joined
    for k in range(len(lines) - 1, 0, -1):
        starts[k] = state
        state = back[k][0]
    if starts:
        starts[0] = True
    return starts


def repair(text: str, lexicon: Lexicon, heads: frozenset[str] | set[str] = frozenset()) -> Page:
    """One page's paragraphs and defects; ``heads`` are the titles that repeat in its document."""
    lines = [x.rstrip() for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    body, page = strip_furniture(lines, heads)
    blank_before, kept = set(), []
    for x in body:
        if x.strip():
            kept.append(x)
        else:
            blank_before.add(len(kept))
    words, hyphenated, misread = decode([x.strip() for x in kept], lexicon)
    if hyphenated:
        page.defects.add("hyphenation")
    if misread:
        page.defects.add("misread")
    starts = paragraph_starts(kept)
    current: list[str] = []
    for i, tokens in enumerate(words):
        if (starts[i] or i in blank_before) and current:
            page.paragraphs.append(" ".join(current))
            current = []
        current += tokens
    if current:
        page.paragraphs.append(" ".join(current))
    return page


def repair_scans(chunks: DataFrame, uploads: DataFrame) -> DataFrame:
    """One row per chunk of a scanned upload: (chunk_id, document_id, paragraphs array<string>, defects array<string>).

    An upload counts as scanned by its pages' layout: most of its chunks whose layout tells are hard-wrapped; where none
    tells, by its latest ``is_ocr_needed``. Then all its chunks are repaired. Formats that hold no pages don't count. Rows with a null or blank
    text, chunk_id or document_id take no part; of differing rows of one chunk the greatest text counts; documents without an
    upload are judged by layout alone. Defects are hyphenation, misread, running_header and page_number. Empty tables
    give an empty result; columns not named here aren't read."""
    rows = chunks.where("chunk_id is not null and document_id is not null and trim(text) <> ''").select("chunk_id", "document_id", "text")
    votes = rows.select("document_id", "text").mapInArrow(_layout, "doc string, n bigint").groupBy("doc").agg(F.sum("n").alias("vote"))
    up = latest_rows(uploads, ["id"], "updated_at", ["id", "type", "is_ocr_needed"]).select(F.col("id").alias("doc"), F.lower(F.trim("type")).alias("type"), F.coalesce("is_ocr_needed", F.lit(False)).alias("ocr"))
    vote = F.coalesce("vote", F.lit(0))
    by_layout = (vote > 0) | ((vote == 0) & F.coalesce("ocr", F.lit(False)))
    judged = cut_lineage(votes.join(up, "doc", "full").where(by_layout & ~F.coalesce(F.col("type").isin(*NOT_SCANNED), F.lit(False))).select(F.col("doc").alias("document_id"), F.lit(True).alias("scanned")))
    marked = rows.join(judged, "document_id", "left").select("chunk_id", "document_id", "text", F.coalesce("scanned", F.lit(False)).alias("scanned"))
    seen = cut_lineage(marked.mapInArrow(_survey, "kind string, a string, doc string, n bigint, text string"))

    def most(kind: str) -> dict[str, int]:
        counted = seen.where(F.col("kind") == kind).groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") >= (MIN_COUNT if kind == "w" else 2))
        return {r["a"]: r["n"] for r in counted.orderBy(F.desc("n"), "a").limit(LEXICON_WORDS).collect()}

    sc = chunks.sparkSession.sparkContext
    words = (most("w"), most("c"))
    shared = sc.broadcast(words)  # at most 2 x LEXICON_WORDS words
    scanned = seen.where("kind = 'p'").groupBy(F.col("a").alias("chunk_id")).agg(F.max(F.struct("text", "doc")).alias("x")).select("chunk_id", "x.doc", "x.text")
    pages = seen.where("kind = 'p'").select("text")
    counted = pages.mapInArrow(lambda batches: _single_readings(batches, shared), "seen string, meant string, n bigint").groupBy("seen", "meant").agg(F.sum("n").alias("n"))
    costs = confusion_costs({(r["seen"], r["meant"]): r["n"] for r in counted.collect()})  # one row per confusion

    # titles at the edges of a document's pages that repeat there
    titled = seen.where("kind = 'p'").select("a", "doc", "text").mapInArrow(_titles, "chunk_id string, doc string, title string").distinct()
    repeated = titled.groupBy("doc", "title").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc", "title")
    heads = titled.join(repeated, ["doc", "title"]).groupBy("chunk_id").agg(F.collect_set("title").alias("heads"))  # at most three titles a page

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = None
        for batch in batches:
            lexicon = lexicon or Lexicon(*shared.value, costs)
            done = [repair(t, lexicon, set(h or ())) for t, h in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            lists = [[p.paragraphs for p in done], [sorted(p.defects) for p in done]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.list_(pa.string())) for x in lists)], names=["chunk_id", "document_id", "paragraphs", "defects"])

    ready = scanned.join(heads, "chunk_id", "left").select("chunk_id", F.col("doc").alias("document_id"), "text", "heads")
    return ready.mapInArrow(run, "chunk_id string, document_id string, paragraphs array<string>, defects array<string>")


def _titles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for chunk, doc, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            _, page = strip_furniture([x.rstrip() for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n")])
            rows += [(chunk, doc, t) for t in page.titles if len(t) > 5]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["chunk_id", "doc", "title"])
