import random

import numpy as np
import pytest
from oracle import same, views

from markwise.llm import queries, spans


def brute(rows, least):
    """Runs by comparing every window of every text."""
    held = {}
    for doc, text in rows:
        for i in range(len(text or "") - least + 1):
            held.setdefault(text[i : i + least], set()).add(doc)
    out = set()
    for doc, text in set(rows):
        run = None
        for i in range(len(text or "") - least + 1):
            if len(held[text[i : i + least]]) > 1:
                if run and i <= run[1]:
                    run[1] = i + least
                else:
                    out |= {(doc, run[0], run[1] - run[0])} if run else set()
                    run = [i, i + least]
        out |= {(doc, run[0], run[1] - run[0])} if run else set()
    return out


def got(spark, rows, least):
    frame = spark.createDataFrame([(d, t, 1, "x", 2) for d, t in rows], "doc_id long, text string, pos int, doc string, h int")
    return sorted(map(tuple, spans.shared_spans(frame, least=least).collect()))


@pytest.mark.parametrize("least", [1, 2, 3, 10, 25])
def test_random_texts(spark, least):
    rng = random.Random(least)
    passages = ["".join(rng.choice("ab的😀") for _ in range(rng.randint(1, 60))) for _ in range(6)]
    texts = ["".join(rng.choice([*passages, rng.choice("xyz") * rng.randint(0, 9)]) for _ in range(rng.randint(0, 5))) for _ in range(40)]
    rows = list(enumerate(texts))
    assert got(spark, rows, least) == sorted(brute(rows, least))


def test_edges(spark):
    a = "".join(chr(0x4E00 + i) for i in range(30))
    b = "".join(chr(0x6000 + i) for i in range(30))
    rows = [(1, a + b), (2, a), (3, b), (4, "q" * 100), (4, "q" * 100), (5, "zz" + a[:10] + "é"), (6, None), (7, ""), (8, a[:9])]
    assert got(spark, rows, 10) == sorted(brute(rows, 10)) == [(1, 0, 60), (2, 0, 30), (3, 0, 30), (5, 2, 10)]
    assert got(spark, [(None, a), (1, a)], 10) == []
    assert spans.shared_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_long_text_and_many_copies(spark):
    rng = random.Random(1)
    text = "".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(40_000))
    rows = [(1, text), (2, "x" + text[10_000:30_000])] + [(10 + i, "same " * 60) for i in range(200)] + [(999, "y" * 50_000)]
    assert got(spark, rows, 200) == sorted([(1, 10_000, 20_000), (2, 1, 20_000)] + [(10 + i, 0, 300) for i in range(200)])


def test_blocks_of_the_hash_agree(monkeypatch):
    points = np.random.default_rng(0).integers(0, 3, 5000).astype(np.uint32)
    whole = spans.window_hashes(points, 7, 0)
    monkeypatch.setattr(spans, "_BLOCK", 64)
    assert (spans.window_hashes(points, 7, 0) == whole).all()
    picked = np.array([0, 5, 63, 64, 4000])
    assert (spans.window_hashes(points, 7, 0, picked) == whole[picked]).all()


def test_the_test_data_by_brute_force(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    found = sorted(map(tuple, queries.p8_found(spark, data).collect()))
    assert found == sorted(brute(rows, 200)) and found
    shares = {r["doc_id"]: r for r in queries.p8_shares(spark, data).collect()}
    assert len(shares) == len(rows) and sum(r["shared_chars"] for r in shares.values()) == sum(f[2] for f in found)


@pytest.mark.parametrize("name", ["p8_lines", "p8_clean", "p8_found", "p8_shares"])
def test_queries_equal_their_sql(spark, data, name):
    same(queries.queries()[name](spark, data), views(data), queries.oracle_sql()[name])


@pytest.mark.parametrize("least", [3, 10])
def test_fingerprints_of_many_surroundings(spark, monkeypatch, least):
    monkeypatch.setattr(spans, "FEW", 1)
    rng = random.Random(least)
    passages = ["".join(rng.choice("ab的") for _ in range(rng.randint(5, 30))) for _ in range(4)]
    rows = list(enumerate("".join(rng.choice([*passages, rng.choice("xyz") * rng.randint(0, 9)]) for _ in range(rng.randint(0, 5))) for _ in range(40)))
    assert got(spark, rows, least) == sorted(brute(rows, least))


def test_lines_without_repeats(spark):
    long = "a line that is long enough to be compared"
    rows = [(1, f"{long}\nx\n"), (2, f"x\n\u3000{long}\r\ny"), (3, None), (4, ""), (5, long)]
    frame = spark.createDataFrame([(d, t, "e") for d, t in rows], "doc_id long, text string, line string")
    got_ = {r["doc_id"]: tuple(r)[1:] for r in spans.without_repeats(frame, spans.line_units(frame)).collect()}
    assert got_ == {1: (rows[0][1], 3, 0, ""), 2: ("x\ny", 2, 1, "2:43"), 3: (None, None, 0, ""), 4: ("", 1, 0, ""), 5: ("", 0, 1, "0:41")}
    assert spans.line_units(spark.createDataFrame([], "doc_id long, text string")).count() == 0
