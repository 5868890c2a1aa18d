from __future__ import annotations

import random
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

pytest.importorskip("skytide.llm")
from skytide.llm.leakage import leaks, tile  # noqa: E402
from skytide.llm.words import words  # noqa: E402

ITEM = "In the café trial of 1848, the botanist Hel grew 4046 seedlings beside Gor, while Fel kept only 316 under glass"
DISGUISES = [
    ITEM, ITEM.upper(), unicodedata.normalize("NFD", ITEM), ITEM.replace(" ", " "), ITEM.replace(" ", "\n> "), ITEM.replace(" ", " ** "), ITEM.replace("seed", "se​ed­"),
    "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in ITEM), ITEM.replace(",", "").replace(" ", "  \r\n"), "x. " + " ".join(ITEM.split()[3:11]) + " y",
]


@pytest.mark.parametrize("text", DISGUISES)
def test_disguises(text):
    assert tile(words(text), words(ITEM), 8)


def test_seven_words_are_none():
    ws = ITEM.split()
    for text in (" ".join(ws[:7]), " ".join([*ws[:7], "other", *ws[8:14]])):
        assert not tile(words(text), words(ITEM), 8)


def test_tiles_are_reordered_and_not_overlapping():
    item = [str(k) for k in range(30)]
    doc = item[20:30] + ["x"] + item[0:12] + ["y"] + item[5:15]
    assert tile(doc, item, 8) == [(11, 0, 12), (0, 20, 10)]
    assert tile(["a"] * 50, ["a"] * 20, 8) == [(0, 0, 20)]
    assert tile(["a"] * 20, ["a"] * 50, 8) == [(0, 0, 20)]
    assert tile([*"abcdefgh", "x"] * 3, list("abcdefgh" * 3), 8) == [(0, 0, 8), (9, 8, 8), (18, 16, 8)]
    assert tile([], item, 8) == tile(doc, [], 8) == []


def slowly(doc, item, least):
    """Lengths of the tiles by looking at every pair of places."""
    fd, fi, out = [True] * len(doc), [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for q in range(len(item)):
            for p in range(len(doc)):
                k = 0
                while p + k < len(doc) and q + k < len(item) and fd[p + k] and fi[q + k] and doc[p + k] == item[q + k]:
                    k += 1
                best = max(best, (k, -q, -p))
        k, q, p = best[0], -best[1], -best[2]
        if k < least:
            return out
        fd[p : p + k], fi[q : q + k] = [False] * k, [False] * k
        out.append(k)


def test_lengths_fall_as_by_brute_force():
    r = random.Random(3)
    for _ in range(60):
        doc, item = r.choices("ab", k=r.randrange(60)), r.choices("ab", k=r.randrange(40))
        got = tile(doc, item, 4)
        assert [k for _, _, k in got] == sorted((k for _, _, k in got), reverse=True)
        assert all(doc[p : p + k] == item[q : q + k] for p, q, k in got)
        assert len({p + j for p, _, k in got for j in range(k)}) == len({q + j for _, q, k in got for j in range(k)}) == sum(k for _, _, k in got)
        want = slowly(doc, item, 4)
        assert [k for _, _, k in got][:1] == want[:1] and bool(got) == bool(want)


def test_repeated_words_take_seconds():
    began = time.time()
    assert tile(["a"] * 100_000, ["a"] * 200, 8) == [(0, 0, 200)]
    doc = (["a"] * 9 + ["b"]) * 10_000
    assert sum(k for _, _, k in tile(doc, ["a"] * 200, 8)) == 198
    assert time.time() - began < 10


def test_matches_brute_force(spark):
    r = random.Random(4)
    vocab = [f"w{k}" for k in range(6)]
    items = [(k, " ".join(r.choices(vocab, k=r.randrange(5, 30)))) for k in range(12)] + [(50, None), (51, "")]
    docs = [(k, " ".join(r.choices(vocab, k=r.randrange(0, 900)))) for k in range(40)] + [(90, None), (91, ""), (0, "again")]
    docs += [(100 + k, f"a {t} b") for k, t in items if t]
    grams = lambda t: {tuple(w[i : i + 8]) for w in [words(t)] for i in range(len(w) - 7)}
    want = {(d, i) for d, t in docs for i, u in items if grams(t) & grams(u)}
    df = spark.createDataFrame([(*x, 1) for x in docs], "doc_id BIGINT, text STRING, item INT")
    it = spark.createDataFrame(items, "item_id BIGINT, item_text STRING")
    got = leaks(df, F.col("doc_id"), F.col("text"), it, F.col("item_id"), F.col("item_text"))
    assert {(x.key, x.item) for x in got.collect()} == want
    assert all(8 <= x.longest <= x.covered <= x.item_words for x in got.collect())
    half = leaks(df, F.col("doc_id"), F.col("text"), it, F.col("item_id"), F.col("item_text"), coverage=0.5)
    assert {tuple(x) for x in half.collect()} == {tuple(x) for x in got.collect() if x.covered >= 0.5 * x.item_words}
    assert leaks(df, F.col("doc_id"), F.col("text"), it.limit(0), F.col("item_id"), F.col("item_text")).count() == 0
    assert leaks(df.limit(0), F.col("doc_id"), F.col("text"), it, F.col("item_id"), F.col("item_text")).count() == 0
