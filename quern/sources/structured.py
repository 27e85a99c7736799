"""Semi-structured scans: JSON, NDJSON, XML, YAML, HTML and Markdown."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KV = "array<struct<k:string,v:string>>"
# Content tags, the least length of a content unit, and the Markdown patterns.
CONTENT_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "article", "section", "li")
LEAST_UNIT = 30
HEADING = r"(?m)^#{1,6}\s+.*$"
DATA_VALUE = re.compile(r"^[\s$€£(+-]*\d[\d,.\s%)]*$")
FRAGMENT_ROWS, CONTEXT_CHARS = 3, 400
STOCK_VOID = {"br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}


def scalar_text(value: object) -> str:
    return "" if value is None else str(value)


def flatten(value: object, prefix: str = "") -> list[tuple[str, str]]:
    """Ordered key-value pairs: dotted keys for objects, ``_count`` and, if the first item is a scalar, ``_sample`` for lists, '' for null."""
    if not isinstance(value, dict):
        return []
    out: list[tuple[str, str]] = []
    for k, v in value.items():
        name = f"{prefix}.{k}" if prefix else str(k)
        if isinstance(v, dict):
            out += flatten(v, name)
        elif isinstance(v, list):
            out.append((f"{name}_count", str(len(v))))
            if v and not isinstance(v[0], dict | list):
                out.append((f"{name}_sample", scalar_text(v[0])))
        else:
            out.append((name, scalar_text(v)))
    return out


def _pandas_udf(function, returns):
    import pandas as pd

    return F.pandas_udf(lambda s: pd.Series([function(x) for x in s], dtype=object), returns)


def flatten_json(c: Column) -> Column:
    """Flattened pairs of a JSON object of any depth; null for anything else."""

    def one(text: str | None):
        try:
            value = json.loads(text) if text else None
        except ValueError:
            return None
        return [{"k": k, "v": v} for k, v in flatten(value)] if isinstance(value, dict) else None

    return _pandas_udf(one, KV)(c)


def flat_json_entries(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, k, v) of JSON objects without nesting, in the JVM."""
    return df.select(key, F.explode(F.from_json(F.col(text), "map<string,string>")).alias("k", "v")).select(key, "k", F.coalesce("v", F.lit("")).alias("v"))


def sniff_json(text: str) -> tuple[str, str]:
    """(shape, path): root_array, ndjson, or root_object with the path of the first list found anywhere."""
    body = text.lstrip("﻿ \t\r\n")
    if body.startswith("["):
        return "root_array", "item"
    lines = [x for x in body.splitlines() if x.strip()]
    if len(lines) > 1:
        try:
            if all(isinstance(json.loads(x), dict) for x in lines[:2]):
                return "ndjson", ""
        except ValueError:
            pass

    def search(value: object, prefix: str) -> str | None:
        for k, v in value.items() if isinstance(value, dict) else ():
            name = f"{prefix}.{k}" if prefix else k
            if isinstance(v, list):
                return f"{name}.item"
            found = search(v, name)
            if found:
                return found
        return None

    try:
        path = search(json.loads(body), "")
    except ValueError:
        path = None
    return ("root_object", path) if path else ("error", "")


def valid_ndjson(df: DataFrame, line: str) -> DataFrame:
    """Lines that hold a JSON object; blank and malformed ones are left out, and line numbers stay those of the file."""
    parsed = F.from_json(F.col(line), "map<string,string>")
    return df.where((F.trim(line) != "") & parsed.isNotNull() & F.rlike(F.trim(line), F.lit(r"^\{[\s\S]*\}$")))


def record_tag(edges: DataFrame, scope: list[str]) -> DataFrame:
    """Of element names with at least two different child names the one with most children per scope (ties: the first seen):
    (scope, tag, children). ``edges`` has parent, child and position."""
    counted = edges.groupBy(*scope, "parent").agg(F.count(F.lit(1)).alias("children"), F.countDistinct("child").alias("kinds"), F.min("position").alias("seen")).where("kinds >= 2")
    best = counted.groupBy(*scope).agg(F.max_by(F.struct("parent", "children"), F.struct("children", (-F.col("seen")).alias("s"))).alias("b"))
    return best.select(*scope, F.col("b.parent").alias("tag"), F.col("b.children").alias("children"))


def xml_edges(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, parent, child, position) of every element below another, read as a stream of tags; malformed rests are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag = re.compile(r"<(/?)([A-Za-z_][\w.:-]*)[^<>]*?(/?)>")
        for batch in batches:
            rows: list[tuple] = []
            for k, xml in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                stack: list[str] = []
                for m in tag.finditer(xml or ""):
                    if m[1]:
                        while stack and stack.pop() != m[2]:
                            pass
                    else:
                        if stack:
                            rows.append((k, stack[-1], m[2], m.start()))
                        if not m[3]:
                            stack.append(m[2])
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["key", "parent", "child", "position"])

    return df.select(F.col(key).cast("string"), text).mapInArrow(run, "key string, parent string, child string, position bigint")


def xml_records(df: DataFrame, key: str, text: str, tag: str | None = None) -> DataFrame:
    """(key, record, field, value): direct children of every ``tag`` element (by default the element that :func:`record_tag` finds in each
    text), children of those as ``parent.child``; attributes
    and deeper levels are left out; of equal names in a record the last counts."""
    known = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("__text"))
    if tag is None:
        found = record_tag(xml_edges(known, "key", "__text"), ["key"]).select(F.col("key").alias("__key"), F.col("tag").alias("__tag"))
        known = known.join(found, F.col("key").cast("string") == F.col("__key"))
    else:
        known = known.withColumn("__tag", F.lit(tag))
    # quoted, since names may hold dots
    name = F.concat(F.lit(r"\Q"), "__tag", F.lit(r"\E"))
    bodies = F.regexp_extract_all(F.regexp_replace("__text", r"(?s)<!--.*?-->", ""), F.concat(F.lit("(?s)<"), name, F.lit(r"(?:\s[^<>]*)?>(.*?)</"), name, F.lit(">")), 1)
    records = known.select("key", F.posexplode(bodies).alias("record", "body"))

    def fields(body: str | None):
        out: dict[str, str] = {}
        cdata = re.compile(r"(?s)<!\[CDATA\[(.*?)\]\]>")
        item = re.compile(r"(?s)<([A-Za-z_][\w.:-]*)(?:\s[^<>]*)?(?:/>|>(.*?)</\1>)")
        for m in item.finditer(body or ""):
            inner = list(item.finditer(m[2] or ""))
            if inner:
                out |= {f"{m[1]}.{n[1]}": n[2].strip() for n in inner if n[2] and "<" not in n[2]}
            else:
                out[m[1]] = cdata.sub(r"\1", m[2] or "").strip()
        return [{"k": k, "v": v} for k, v in out.items()]

    entries = _pandas_udf(fields, KV)(F.col("body"))
    return records.select("key", "record", F.explode(entries).alias("e")).select("key", "record", F.col("e.k").alias("field"), F.col("e.v").alias("value"))


def sniff_yaml(text: str, scan: int = 100) -> str:
    for line in text.splitlines()[:scan]:
        if line.startswith("---"):
            return "multi_doc"
        if line.startswith("- "):
            return "sequence"
    return "mapping"


def yaml_objects(text: str | None) -> list[dict]:
    """Objects of a YAML text: documents, items of a root sequence, or values of root keys; a document with the single key of
    a list of objects gives its items; blocks that don't parse are skipped."""
    import yaml

    if not text:
        return []
    shape = sniff_yaml(text)
    if shape == "multi_doc":
        blocks = re.split(r"(?m)^---.*$", text)
    elif shape == "sequence":
        blocks = re.split(r"(?m)^(?=- )", text)
    else:
        blocks = re.split(r"(?m)^(?=[^\s#-][^\n]*:)", text)
    out: list[dict] = []
    for block in blocks:
        try:
            value = yaml.safe_load(block)
        except yaml.YAMLError:
            continue
        if isinstance(value, dict) and len(value) == 1:
            only = next(iter(value.values()))
            if isinstance(only, list) and only and all(isinstance(x, dict) for x in only):
                value = only
        out += [x for x in (value if isinstance(value, list) else [value]) if isinstance(x, dict)]
    return out


def yaml_records(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, object, k, v): flattened objects of YAML texts."""
    objects = _pandas_udf(lambda t: [[{"k": k, "v": v} for k, v in flatten(o)] for o in yaml_objects(t)], f"array<{KV}>")(F.col(text))
    return df.select(F.col(key).alias("key"), F.posexplode(objects).alias("object", "pairs")).select("key", "object", F.explode("pairs").alias("p")).select("key", "object", F.col("p.k").alias("k"), F.col("p.v").alias("v"))


class _Units(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.units: list[tuple[str, str, str, list[tuple[str, str]]]] = []
        self.open: list[tuple[str, list[str]]] = []
        self.tables, self.headers, self.cells, self.cell = 0, [], [], None

    def handle_starttag(self, tag, attrs):
        if tag in STOCK_VOID:
            return
        if tag == "table":
            self.tables, self.headers = self.tables + 1, []
        elif tag == "tr":
            self.cells = []
        if tag in ("td", "th"):
            self.cell = []
        self.open.append((tag, []))

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)
        for _, text in self.open:
            text.append(data)

    def handle_endtag(self, tag):
        if tag not in [t for t, _ in self.open]:
            return
        while self.open:
            name, text = self.open.pop()
            words = " ".join("".join(text).split())
            if name in CONTENT_TAGS and not self.tables and len(words) >= LEAST_UNIT:
                self.units.append(("content", name, words, []))
            elif name in ("td", "th") and self.cell is not None:
                (self.headers if name == "th" else self.cells).append(" ".join("".join(self.cell).split()))
                self.cell = None
            elif name == "tr" and self.cells:
                pairs = [(self.headers[i] if i < len(self.headers) and self.headers[i] else f"col_{i}", v) for i, v in enumerate(self.cells)]
                self.units.append(("row", "tr", "", pairs))
                self.cells = []
            elif name == "table":
                self.tables -= 1
            if name == tag:
                return


def html_unit_list(html: str | None) -> list[dict]:
    """Content units and table rows in order of their ends. Texts are whole, with the inline elements in them."""
    parser = _Units()
    parser.feed(html or "")
    parser.close()
    return [{"kind": kind, "tag": tag, "text": text, "cells": [{"k": k, "v": v} for k, v in cells]} for kind, tag, text, cells in parser.units]


def html_units(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, unit, kind, tag, rendered): ``[P] text`` for content, ``k: v, ...`` for table rows."""
    units = _pandas_udf(html_unit_list, f"array<struct<kind:string,tag:string,text:string,cells:{KV}>>")(F.col(html))
    flat = df.select(F.col(key).alias("key"), F.posexplode(units).alias("unit", "u"))
    return flat.select("key", "unit", F.col("u.kind").alias("kind"), F.col("u.tag").alias("tag"), render_unit(F.col("u.kind"), F.col("u.tag"), F.col("u.text"), F.col("u.cells")).alias("rendered"))


def render_unit(kind: Column, tag: Column, text: Column, cells: Column) -> Column:
    return F.when(kind == "row", F.array_join(F.transform(cells, lambda x: F.concat_ws(": ", x["k"], x["v"])), ", ")).otherwise(F.concat(F.lit("["), F.upper(tag), F.lit("] "), text))


def parse_table(markdown: str) -> tuple[list[str], list[list[str]]]:
    """(headers, rows) of a pipe table. A first line that looks like data, or names no column but the first, is a row."""
    lines = [x.strip() for x in markdown.splitlines() if x.strip().startswith("|")]
    cells = [[c.strip().strip("*_") for c in x.strip("|").split("|")] for x in lines]
    if len(lines) < 2 or not re.match(r"^\|[\s:|-]+$", lines[1]):
        return [], cells
    head = cells[0]
    data = any(DATA_VALUE.match(h) for h in head[1:] if h) or not any(head[1:])
    return ([], [head, *cells[2:]]) if data else (head, cells[2:])


def sentence_of_row(headers: Column, row: Column, title: Column) -> Column:
    """``title — label: h: v, ...`` without empty cells; null if no cell but the label is filled."""
    label = F.when(row[0] != "", row[0]).otherwise("Row")
    pairs = F.zip_with(headers, row, lambda h, v: F.when((F.coalesce(h, F.lit("")) != "") & (F.coalesce(v, F.lit("")) != ""), F.concat(h, F.lit(": "), v)))
    named = F.filter(F.slice(pairs, 2, F.greatest(F.size(row) - 1, F.lit(0))), lambda x: x.isNotNull())
    bare = F.filter(F.slice(row, 2, F.greatest(F.size(row) - 1, F.lit(0))), lambda x: x != "")
    parts = F.when(F.size(headers) > 0, named).otherwise(bare)
    return F.when(F.size(parts) > 0, F.concat(F.when(title != "", F.concat(title, F.lit(" — "))).otherwise(""), label, F.lit(": "), F.array_join(parts, ", ")))


def markdown_parts(text: str | None) -> list[dict]:
    """A Markdown text as parts in order: tables (runs of pipe lines) and the text between them, with character positions."""
    parts, at, held, start, table = [], 0, [], 0, False

    def flush(end: int) -> None:
        body = "".join(held)
        if body.strip():
            parts.append({"kind": "table" if table else "text", "start": start, "end": end, "text": body.strip("\n")})

    for line in (text or "").splitlines(keepends=True):
        is_table = line.lstrip().startswith("|")
        if is_table != table and held:
            flush(at)
            held = []
        if not held:
            start, table = at, is_table
        held.append(line)
        at += len(line)
    flush(at)
    return parts


MD_CHUNK = "array<struct<start:int,kind:string,table_index:int,text:string>>"


def markdown_chunks(text: str | None) -> list[dict]:
    """Chunks of a Markdown text in order of position: text parts with their heading, small tables whole with what precedes them,
    and every row of larger tables as a sentence under the nearest heading before it."""
    parts, out, heading, context, tables = markdown_parts(text), [], "", "", 0
    for p in parts:
        if p["kind"] == "text":
            found = re.findall(HEADING, p["text"])
            title = found[-1].lstrip("#").strip().strip("*") if found else ""
            body = p["text"].strip()
            shown = body if not heading or heading in body else f"{heading}\n{body}"
            out.append({"start": p["start"], "kind": "text", "table_index": None, "text": shown})
            heading, context = title or heading, body[-CONTEXT_CHARS:]
            continue
        headers, rows = parse_table(p["text"])
        title = heading or context[:120].strip()
        sentences = []
        for row in rows:
            if any(row):
                pairs = [f"{headers[i]}: {v}" for i, v in enumerate(row[1:], 1) if i < len(headers) and headers[i] and v] if headers else [v for v in row[1:] if v]
                if pairs:
                    sentences.append((f"{title} — " if title else "") + f"{row[0] or 'Row'}: " + ", ".join(pairs))
        if len(rows) <= FRAGMENT_ROWS or not sentences:
            kind = "fragment_table" if len(rows) <= FRAGMENT_ROWS else "unparsed_table"
            out.append({"start": p["start"], "kind": kind, "table_index": tables, "text": f"{context}\n{p['text']}".strip()})
        else:
            out += [{"start": p["start"], "kind": "table_row", "table_index": tables, "text": s} for s in sentences]
        tables += 1
    return out


def markdown_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, number, start, kind, table_index, text) of every Markdown text."""
    chunks = _pandas_udf(markdown_chunks, MD_CHUNK)(F.col(text))
    return df.select(F.col(key).alias("key"), F.posexplode(chunks).alias("number", "c")).select("key", "number", "c.*")


def table_to_markdown(rows: list[list[str | None]]) -> str:
    """A table of a page: empty rows dropped, the first row the header, white space collapsed, pipes escaped, rows padded or cut."""
    clean = [[re.sub(r"\s+", " ", c or "").strip().replace("|", "\\|") for c in r] for r in rows]
    clean = [r for r in clean if any(r)]
    if not clean:
        return ""
    width = len(clean[0])
    fit = [(r + [""] * width)[:width] for r in clean]
    lines = ["| " + " | ".join(r) + " |" for r in fit]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


def garbled_share(c: Column) -> Column:
    """Of the text's first 200 characters, the share that is private use, unassigned, surrogate, control or the replacement character."""
    head = F.substring(c, 1, 200)
    bad = F.length(head) - F.length(F.regexp_replace(head, r"[\p{Co}\p{Cn}\p{Cs}�[\p{Cc}&&[^\t\n\r]]]", ""))
    return F.when(F.length(head) > 0, bad / F.length(head)).otherwise(0.0)


def is_garbled(c: Column, limit: float = 0.3) -> Column:
    """Whether a text layer is unusable: glyph codes ``(cid:n)`` or too many unreadable characters."""
    return F.coalesce(c.rlike(r"\(cid:\d+\)") | (garbled_share(c) >= limit), F.lit(False))


