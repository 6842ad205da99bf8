import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cellweave.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.exists(f"{tokens.TOKENIZER_DIR}/{tokens.VOCABULARY}"), reason="no vocabulary here")
#: The public split pattern of the vocabulary, for the comparison only.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def ours():
    return tokens.Vocabulary()


@pytest.fixture(scope="module")
def theirs(ours):
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ours.ranks, special_tokens={})


def ids_of(vocabulary, texts):
    ids, edges = vocabulary.encode(texts)
    return [ids[a:b].tolist() for a, b in zip(edges, edges[1:])]


def test_same_ids_on_tricky_texts(ours, theirs):
    parts = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", "a", "B", "7", "½", "é", "日", "́", " ", "-", "!", "👩‍🔬", "\x1c", "ſ", "S", "<|endoftext|>"]
    draw = random.Random(1)
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 15))) for _ in range(20000)] + ["'" * 999, "'s" * 500, " " * 5000, "a" * 3000, "\n" * 40 + "'s"]
    assert ids_of(ours, texts) == [theirs.encode_ordinary(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(), max_size=6))
def test_same_ids_and_round_trip(texts):
    vocabulary = tokens.vocabulary(tokens.TOKENIZER_DIR, tokens.VOCABULARY)
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    for text, ids in zip(texts, ids_of(vocabulary, texts)):
        assert vocabulary.decode(ids) == text


def test_table(spark, ours):
    rows = [(1, None), (2, ""), (3, "Hello world"), (4, "x " * 200_000), (5, "Hello world")]
    df = spark.createDataFrame([(k, t, "clash", 1) for k, t in rows], "doc_id long, text string, ids string, value int")
    out = {r["doc_id"]: r["ids"] for r in tokens.encode(df, "doc_id").collect()}
    assert out[1] == [] and out[2] == [] and out[3] == out[5] == [15496, 995] and len(out[4]) == 200_001
    sizes = {r["doc_id"]: r["tokens"] for r in tokens.count(df, "doc_id").collect()}
    assert sizes == {k: len(v) for k, v in out.items()}
    assert tokens.encode(df.limit(0), "doc_id").count() == 0


def test_offsets_and_decoding(spark):
    texts = ["It's  a test.\n\nFür 12 日本 ✓", None, "", "  x", "a" * 5000 + " b", "It's  a test.\n\nFür 12 日本 ✓"]
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, starts string")
    rows = {r["doc_id"]: r for r in tokens.located(df, "doc_id").collect()}
    words = tokens.vocabulary(tokens.TOKENIZER_DIR, tokens.VOCABULARY)
    for k, text in enumerate(texts):
        ids, starts = rows[k]["ids"], rows[k]["starts"]
        assert len(ids) == len(starts)
        cuts = sorted(set(starts)) + [len(text or "")]
        for a, b in zip(cuts, cuts[1:]):
            assert words.decode([i for i, s in zip(ids, starts) if s == a]) == text[a:b]
    decoded = {r["doc_id"]: r["text"] for r in tokens.decode(tokens.encode(df, "doc_id"), "doc_id").collect()}
    assert decoded == {k: t or "" for k, t in enumerate(texts)}
    none = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert tokens.decode(none, "doc_id").first()["text"] is None and tokens.decode(none.limit(0), "doc_id").count() == 0
