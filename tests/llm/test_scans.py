import random
import textwrap

from quern.llm import scans as s

CHUNKS = "chunk_id string, document_id string, text string, doc int, kind string, n string, paragraphs int"
UPLOADS = "id string, type string, is_ocr_needed boolean, updated_at int, doc string"
WORDS = "pump valve gasket reading meter pressure table section report triage bearing return entries because between number nominal sequence temperature manual".split()


def prose(rng, n=60):
    out = []
    for _ in range(n // 6):
        out.append(" ".join(rng.choice(WORDS) for _ in range(6)).capitalize() + ".")
    return " ".join(out)


def page(text, width=50):
    return "\n".join(textwrap.wrap(text, width, break_long_words=False, break_on_hyphens=False))


def frames(spark, chunks, uploads):
    return spark.createDataFrame([(*c, 1, "k", "n", 2) for c in chunks], CHUNKS), spark.createDataFrame([(*u, "d") for u in uploads], UPLOADS)


def test_defects_and_paragraphs(spark):
    rng = random.Random(1)
    clean = [(f"x{i}", "plain", prose(rng, 90), ) for i in range(30)]
    text = prose(rng)
    scans = {
        "none": page(text),
        "hyphen": page(text).replace("gasket", "gas-\nket", 1) if "gasket" in text else page(text) + "\ngas-\nket",
        "misread": page(text).replace("valve", "va1ve"),
        "number": page(text) + "\nPage 3 of 9",
        "header": "Annual Pump Report Vol. 12\n" + page(text),
        "compound": page(text + " long-term and long-term") + "\nlong-\nterm reading of the pump",
    }
    chunks = clean + [(k, "doc", t) for k, t in scans.items()] + [("c", "plain", "a long-term view. " * 12)] + [("c2", "plain", "some long-term plan. " * 12)]
    out = {r.chunk_id: r for r in s.repair_scans(*frames(spark, chunks, [("doc", " PDF", False, 1), ("plain", "text", True, 1)])).collect()}
    assert set(out) == set(scans)
    assert {k: set(r.defects) for k, r in out.items()} == {"none": set(), "hyphen": {"hyphenation"}, "misread": {"misread"}, "number": {"page_number"}, "header": {"running_header"}, "compound": set()}
    assert " ".join(out["none"].paragraphs) == text and " ".join(out["number"].paragraphs) == text and " ".join(out["header"].paragraphs) == text
    assert " ".join(out["misread"].paragraphs) == text


def lexicon():
    return s.Lexicon({w: 100 for w in [*WORDS, "the", "was"]}, {"long-term": 5})


def test_joint_segmentation():
    lex = lexicon()
    assert s.decode(["the pres sure was"], lex)[0] == [["the", "pressure", "was"]]
    assert s.decode(["valvegasket was"], lex)[0] == [["valve", "gasket", "was"]]
    words, hyphenated, misread = s.decode(["the tempe¬", "rafure was"], lex)
    assert words == [["the", "temperature"], ["was"]] and hyphenated and misread
    assert s.decode(["long-", "term"], lex) == ([["long-term"], []], False, False)
    assert s.decode(["Va|ve! the"], lex)[0] == [["Valve!", "the"]]


def test_any_number_of_merges_and_splits():
    lex = s.Lexicon({w: 100 for w in [*WORDS, "approved", "budget", "council", "pro", "member"]} | {"was": 2000, "of": 4000, "the": 5000}, {})
    assert s.decode(["was ap pro ved by"], lex)[0] == [["was", "approved", "by"]]
    assert s.decode(["the budgetwasapproved"], lex)[0] == [["the", "budget", "was", "approved"]]
    assert s.decode(["table ofthe meter"], lex)[0] == [["table", "of", "the", "meter"]]
    assert s.decode(["the coun cil-", "of"], lex)[0][0][:2] == ["the", "council"]
    assert s.decode(["the bud-", "g et was"], lex) == ([["the", "budget"], ["was"]], True, False)
    assert s.decode(["Morroline TU-3665 Ostrava"], lex)[0] == [["Morroline", "TU-3665", "Ostrava"]]


def test_costs_follow_the_pages():
    costs = s.confusion_costs({("rn", "m"): 900, ("1", "l"): 90})
    assert costs["rn", "m"] < costs["1", "l"] < costs["vv", "w"] <= 8


def test_headers_leave_the_paragraphs(spark):
    rng = random.Random(6)
    clean = [(f"x{i}", "plain", prose(rng, 90)) for i in range(30)]
    texts = [prose(rng) for _ in range(4)]
    heads = ["Annual Water Report | 12", "Annual Water Report | 13", "Annual Water Report", "Pump Table Section"]
    chunks = clean + [(f"p{i}", "doc", f"{h}\n{page(t)}") for i, (h, t) in enumerate(zip(heads, texts, strict=True))]
    out = {r.chunk_id: r for r in s.repair_scans(*frames(spark, chunks, [("doc", "pdf", True, 1), ("plain", "text", False, 1)])).collect()}
    assert {k: set(r.defects) for k, r in out.items()} == {"p0": {"running_header", "page_number"}, "p1": {"running_header", "page_number"}, "p2": {"running_header"}, "p3": set()}
    for i in range(3):
        assert " ".join(out[f"p{i}"].paragraphs) == texts[i]
    assert "Pump Table Section" in " ".join(out["p3"].paragraphs)


def test_paragraph_choice():
    full = ["some words that fill the whole line up" for _ in range(3)]
    lines = [*full, "short end.", *("New words that fill the whole line up" for _ in range(3)), "last."]
    assert [i for i, b in enumerate(s.paragraph_starts(lines)) if b] == [0, 4]
    assert s.paragraph_starts([]) == [] and s.paragraph_starts(["one"]) == [True]


def test_page_numbers():
    for line in ("[42]", "- 5 -", "Page 2 of 9", "7", "— 9 —", "3 / 8", "PAGE 12", "p. 4", "Seite 3"):
        assert s.PAGE_LINE.match(line), line
    for line in ("12 pumps", "EJ-12.", "at 9 hours.", "line 9"):
        assert not s.PAGE_LINE.match(line), line


def test_unscanned_text_has_no_defects(spark):
    rng = random.Random(2)
    chunks = [(f"c{i}", "d", prose(rng, 200) + " va1ve") for i in range(5)] + [(None, "d", "x"), ("n", None, "x"), ("t", "d", None), ("e", "d", ""), ("b", "d", "  ")]
    assert s.repair_scans(*frames(spark, chunks, [("d", "pdf", False, 1)])).count() == 0
    assert s.repair_scans(*frames(spark, [], [])).count() == 0


def test_repeated_rows_long_pages_and_missing_uploads(spark):
    rng = random.Random(3)
    text = page(prose(rng, 6000))
    out = s.repair_scans(*frames(spark, [("a", "d", text), ("a", "d", text), ("b", "e", text)], [("e", None, None, None), ("e", "audio", True, 2)])).collect()
    assert [r.chunk_id for r in out] == ["a"] and sum(len(p) for p in out[0].paragraphs) > 30_000


def test_every_chunk_of_a_scanned_upload_is_a_page(spark):
    rng = random.Random(4)
    plain = [(f"x{i}", "plain", prose(rng, 90)) for i in range(30)]
    pages = [(f"p{i}", "doc", page(prose(rng))) for i in range(4)]
    wide = " ".join(prose(rng, 24).split()) + "\nPage 4 of 9\n" + page(prose(rng))
    loose = page(prose(rng)).split("\n")
    loose = "\n".join([*loose[:2], "The va1ve", *loose[2:4], "The pump", *loose[4:6], "- 5 -"])
    ragged = "\n".join(["Valve pressure table reading", "Pump meter section report", "Valve pressure table reading", "Pump meter section report", "- 6 -"])
    chunks = [*plain, *pages, ("wide", "doc", wide), ("loose", "doc", loose), ("ragged", "doc", ragged)]
    assert s.wrap_share(wide) == 0.0 and s.wrap_share(ragged) < s.FULL_SHARE
    out = {r.chunk_id: set(r.defects) for r in s.repair_scans(*frames(spark, chunks, [("doc", "pdf", True, 1), ("plain", "text", False, 1)])).collect()}
    assert set(out) == {"p0", "p1", "p2", "p3", "wide", "loose", "ragged"}
    assert out["wide"] == {"page_number"} and out["loose"] == {"page_number", "misread"} and out["ragged"] == {"page_number"}
