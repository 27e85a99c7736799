"""Words: stop list, portable tokens, query analysis and lane normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words.
STOP_WORDS = sorted(
    set(
        """a an the and or but if in on at to for of with by from as is was are were be been being have has one two three four five six
        seven eight nine ten had do does did will would could should may might shall can not no nor so yet both either neither each every
        all any few more most other some such than then that this these those what which who whom when where why how its our your his her
        their we they he she it you i me him us them my mine hers ours yours theirs am into up out about after before between through
        during above below over under again further once here there while although though because since until unless whether also however
        therefore thus hence often usually generally typically using used use uses based given made make makes allow allows provide
        provides include includes result results approach method system different various large small high low real time data first
        second third well show shows need needs mean means call calls just like much many without within across along around behind
        beside""".split()
    )
)
# Endings of technical nouns, lanes in order of precedence, and what each signal adds to a lane.
TECHNICAL = "tion|ment|ism|ity|ing|ence|ance|ness|ture|ware|work|base"
LANES = ("tag", "keyword", "phrase", "entity", "concept", "acronym")
BASELINE, ACRONYM, SINGLE_KEYWORD, SINGLE_TAG, MULTI_CONCEPT, MULTI_KEYWORD, TECHNICAL_KEYWORD = 0.1, 3.0, 2.0, 1.0, 1.5, 0.5, 0.8

RUN = r"[\p{L}\p{N}_]+"
#: Words that hold a letter or digit outside ASCII: no pattern of ASCII letters may match inside them.
FOREIGN = r"[\p{L}\p{N}_]*[^\x00-\x7F\p{P}\p{S}\p{Z}\p{C}\p{M}][\p{L}\p{N}_]*"
TECHNICAL_START = rf"^[a-z]{{4,}}(?:{TECHNICAL})([^\p{{L}}\p{{N}}_]|$)"


#: The same for Java's matcher, which looks back so as to start at words only and thus stays linear in long runs.
FOREIGN_JAVA = r"(?<![\p{L}\p{N}_])[A-Za-z0-9_]*+[^\x00-\x7F\p{P}\p{S}\p{Z}\p{C}\p{M}][\p{L}\p{N}_]*+"


def not_stop(word: Column) -> Column:
    return ~word.isin(*STOP_WORDS)


def runs(text: Column) -> Column:
    """Maximal runs of letters, digits and underscores, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(RUN), F.lit(0))


def content_words(text: Column, shape: str = "^[a-z]{4,}$") -> Column:
    """Runs of the given shape that aren't stop words, in order."""
    return F.filter(runs(text), lambda w: w.rlike(shape) & not_stop(w))


def is_acronym(query: Column) -> Column:
    return F.trim(F.replace(query, F.lit("."), F.lit(""))).rlike("^[A-Z]{2,6}$")


def query_tokens(query: Column) -> Column:
    return F.filter(F.split(F.lower(F.trim(query)), r"\s+"), lambda t: (t != "") & not_stop(t))


def lane_scores(query: Column) -> Column:
    """Array of (lane, score), best first, equal ones in the order of LANES."""
    tokens = query_tokens(query)
    single, multi = F.size(tokens) == 1, F.size(tokens) > 2
    technical = F.size(F.filter(tokens, lambda t: t.rlike(TECHNICAL_START)))
    zero = F.lit(0.0)
    added = {
        "tag": F.when(single, SINGLE_TAG).otherwise(zero),
        "keyword": F.when(single, SINGLE_KEYWORD).otherwise(zero) + F.when(multi, MULTI_KEYWORD).otherwise(zero) + technical * F.lit(TECHNICAL_KEYWORD),
        "concept": F.when(multi, MULTI_CONCEPT).otherwise(zero),
        "acronym": F.when(is_acronym(query), ACRONYM).otherwise(zero),
    }
    rows = [F.struct((-F.round(added.get(lane, zero) + BASELINE, 4)).alias("s"), F.lit(i).alias("i"), F.lit(lane).alias("lane")) for i, lane in enumerate(LANES)]
    return F.transform(F.array_sort(F.array(*rows)), lambda r: F.struct(r["lane"].alias("lane"), (-r["s"]).alias("score")))


def _without_stops(c: Column) -> Column:
    return F.array_join(F.filter(F.split(c, " "), not_stop), " ")


def _plain(value: Column) -> Column:
    split = F.regexp_replace(value, "([a-z])([A-Z])", "$1 $2")
    return F.trim(F.regexp_replace(F.lower(F.translate(split, "_-", "  ")), r"\s+", " "))


def lane_value(value: Column, lane: str) -> Column:
    """A node's value as it is compared in a lane."""
    if lane == "acronym":
        return F.upper(F.trim(F.replace(value, F.lit("."), F.lit(""))))
    if lane == "entity":
        return F.trim(F.regexp_replace(F.translate(value, "_-", "  "), r"\s+", " "))
    return _without_stops(_plain(value)) if lane in ("tag", "keyword") else _plain(value)


def lane_query(query: Column, lane: str) -> Column:
    """A query as it is compared in a lane: as a value, except that entities keep hyphens and only acronyms become acronyms."""
    if lane == "acronym":
        return F.when(is_acronym(query), lane_value(query, lane)).otherwise(F.trim(query))
    if lane == "entity":
        return F.trim(F.regexp_replace(F.translate(query, "_", " "), r"\s+", " "))
    return lane_value(query, lane)
