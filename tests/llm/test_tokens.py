import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from markwise.llm import tokens

RANKS = tokens.vocabulary()
MERGER = tokens.Merger(RANKS)
OWN = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=MERGER.rank, special_tokens={})


def test_every_token_is_its_own_encoding():
    for token, rank in MERGER.rank.items():
        if rank % 7 == 0:
            assert MERGER.one(token) == (rank,)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=30))
def test_any_text(texts):
    assert list(tokens.encode(MERGER, texts)) == [OWN.encode_ordinary(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=2, max_size=70), min_size=1, max_size=20))
def test_trees_together_and_one_by_one_agree(pieces):
    size = max(2, 1 << (max(map(len, pieces)) - 1).bit_length())
    assert MERGER.together(pieces, size) == [MERGER.one(p) for p in pieces]


def test_corpus_against_the_library(spark, data):
    from markwise.llm.queries import p6_ids

    rows = {r["doc_id"]: list(r["ids"]) for r in p6_ids(spark, data).collect()}
    texts = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(texts)
    for r in texts:
        assert rows[r["doc_id"]] == (OWN.encode_ordinary(r["text"]) if r["text"] else [])


def test_null_empty_long_special_and_clashing(spark):
    long = "ab的" * 50_000
    special = "a<|endoftext|>b"
    rows = [(1, None, 0), (2, "", 0), (3, long, 0), (4, special, 0), (4, special, 0), (None, "x", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = [(r["doc_id"], list(r["ids"])) for r in tokens.with_ids(frame).collect()]
    assert got == [(d, OWN.encode_ordinary(t) if t else []) for d, t, _ in rows]
    assert [r["tokens"] for r in tokens.with_token_count(frame).collect()] == [len(i) for _, i in got]
    assert tokens.with_ids(frame.limit(0)).count() == 0


def test_round_trip(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").where("text is not null").limit(50)
    back = tokens.with_ids(docs).select("text", tokens.decoded(tokens.F.col("ids"), MERGER.rank).alias("again"))
    assert all(r["text"] == r["again"] for r in back.collect())
