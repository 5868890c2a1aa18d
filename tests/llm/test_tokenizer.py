from __future__ import annotations

import base64
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

pytest.importorskip("skytide.llm")
from skytide.llm.queries import TOKENIZERS  # noqa: E402
from skytide.llm.tokenizer import PATTERN, Encoder, Merges, encode  # noqa: E402

FILE = f"{TOKENIZERS}/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(FILE), reason="no vocabulary file")


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    return Encoder(Merges.read(FILE)), lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


HARD = ["", " ", "a", "aaaaaaa" * 900, "aaaa aaa   \n\n  x <|endoftext|>", "'s's'll don't DON'T", "日本語のテキスト。", "Привет, мир!", "😀👩‍🚀", "‮abc​", "x" * 3 + "\x00\x1f", "٣ ½ ²", "the the the the"]


def test_hard_texts(both):
    mine, theirs = both
    assert mine.encode(HARD) == theirs(HARD)


def test_equal_to_the_library_on_documents(both, spark):
    mine, theirs = both
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if r.text]
    assert mine.encode(texts) == theirs(texts)


def test_any_text(both):
    mine, theirs = both

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40), max_size=5))
    def check(texts):
        assert mine.encode(texts) == theirs(texts)

    check()


def test_frame(spark, both):
    rows = [(1, None, 5), (2, "", 5), (3, "hello hello", 5), (3, "hello hello", 5), (None, "x", 5)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, ids INT")
    got = encode(df, F.col("doc_id"), F.col("text"), FILE)
    want = both[1](["hello hello", "x"])
    assert sorted(((r.key, list(r.ids)) for r in got.collect()), key=str) == sorted([(1, []), (2, []), (3, want[0]), (3, want[0]), (None, want[1])], key=str)
    assert encode(df.limit(0), F.col("doc_id"), F.col("text"), FILE).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_other_vocabularies(spark, name):
    """Equal to their own libraries."""
    path = f"{TOKENIZERS}/{name}"
    texts = HARD + [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if r.text]
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        want = [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    else:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        want = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary_batch(texts)
    assert Encoder(Merges.read(path)).encode(texts) == want
