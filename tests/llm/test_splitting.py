import random

from quern.llm import splitting as s

CHUNKS = "chunk_id string, project_id string, text string, updated_at int, `limit` int, overlap string, piece int, pieces int"
VARIABLES = "project_id string, max_chunk_size_mb double, chunk_overlap int, text string"


def frames(spark, chunks, variables):
    return spark.createDataFrame([(*c, 1, "o", 2, 3) for c in chunks], CHUNKS), spark.createDataFrame([(*v, "t") for v in variables], VARIABLES)


def check(text, limit, overlap, pieces):
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(len(text[a:b].encode()) <= max(limit, 4) for a, b, _ in pieces)
    assert all(y[0] <= x[1] and x[1] < y[1] and x[0] < y[0] for x, y in zip(pieces, pieces[1:]))
    rebuilt = "".join(text[max(a, e) : b] for (a, b, _), e in zip(pieces, [0, *(p[1] for p in pieces)]))
    assert rebuilt == text


def test_pieces_rebuild_the_text():
    rng = random.Random(2)
    for _ in range(400):
        text = "".join(rng.choice(["a", "é", "\n", " ", ". ", "😀", "word ", "\n\n", "zzzzzzzzz"]) for _ in range(rng.randint(1, 400)))
        limit, overlap = rng.randint(4, 200), rng.randint(0, 60)
        pieces = s.split_text(text, limit, overlap)
        check(text, limit, overlap, pieces)
        if limit >= 4 * overlap + 8 and len(pieces) > 1:
            assert all(x[1] - y[0] == min(overlap, x[1] - x[0] - 1) for x, y in zip(pieces, pieces[1:]))


def test_cuts_follow_topics():
    animals = "The cat chased the dog. A dog barked at the cat. The cat and the dog slept. "
    metals = "Iron melts in the furnace. The furnace heats iron and copper. Copper and iron cool. "
    text = animals * 2 + metals * 2
    pieces = s.split_text(text, int(len(text) * 0.62), 0)
    assert len(pieces) == 2 and pieces[0][1] == len(animals) * 2


def test_natural_ends_are_preferred():
    assert all(b != "character" for *_, b in s.split_text("some words in a row " * 50, 100, 10))
    assert {b for *_, b in s.split_text("x" * 500, 100, 10)} == {"character", "end"}
    assert s.split_text("<a>1</a><a>2</a><a>3</a>" * 20, 60, 0)[0][2] == "row"


def test_operator_cases(spark, rows):
    big = "Sentence number one. " * 40
    chunks, variables = frames(spark, [("a", "p", big, 1), ("a", "p", big, 2), ("b", "q", big, 1), ("c", "p", None, 1), ("d", None, big, 1), (None, "p", big, 1), ("e", "p", "", 1), ("f", "p", "short", 1), ("g", "none", big, 1), ("h", "nan", big, 1), ("i", "zero", big, 1), ("j", "tiny", "word " * 30_000, None)], [("p", 0.0002, 20), ("q", None, 20), (None, 0.0001, 3), ("nan", float("nan"), 1), ("zero", 0.0, 1), ("tiny", 0.0001, None)])
    out = s.split_oversized(chunks, variables).collect()
    assert {r.chunk_id for r in out} == {"a", "j"}
    a = sorted((r for r in out if r.chunk_id == "a"), key=lambda r: r.piece)
    assert [r.piece for r in a] == list(range(a[0].pieces)) and all(r.n_bytes <= int(0.0002 * s.MB) for r in a)
    assert all(x.end - y.start == 20 for x, y in zip(a, a[1:]))
    assert max(r.end for r in out if r.chunk_id == "j") == 150_000


def test_empty_tables(spark):
    chunks, variables = frames(spark, [], [])
    assert s.split_oversized(chunks, variables).count() == 0
