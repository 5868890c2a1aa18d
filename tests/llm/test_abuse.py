from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

pytest.importorskip("skytide.llm")
from skytide.llm.abuse import WORDS, Judge, scores, source_rates  # noqa: E402
from skytide.llm.channel import KNOWN, Channel, CharModel  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def samples(spark):
    return [(r.sample_text, r.verdict != "clean") for r in spark.read.parquet(f"{SF}/review_samples.parquet").orderBy("sample_id").collect()]


@pytest.fixture(scope="module")
def judge(samples):
    return Judge([t for t, _ in samples], [b for _, b in samples])


def right(judge, held):
    return sum((judge.score(t) >= 0.5) == b for t, b in held) / len(held)


def test_held_out_accuracy(samples):
    """Samples of a kind of last sentence are held out together, so that none like them is fitted on."""
    kind = lambda t: " ".join(WORDS.findall(t.casefold())[-3:])
    kinds = sorted({kind(t) for t, _ in samples})
    out = []
    for k in range(3):
        held = set(kinds[k::3])
        rest = [x for x in samples if kind(x[0]) not in held]
        j = Judge([t for t, _ in rest], [b for _, b in rest])
        out.append(right(j, [x for x in samples if kind(x[0]) in held]))
    assert min(out) >= 0.95


def test_without_samples(samples):
    assert right(Judge([], []), samples) >= 0.95


@pytest.mark.parametrize(
    "text,meant",
    [
        ("such a s c u m b a g", "such a scumbag"), ("you m.o.r.o.n", "you moron"), ("you 1d107", "you idiot"), ("veeeermin", "vermin"), ("you аsshоlе", "you asshole"), ("a mo*on", "a moron"),
        ("du Id​iot", "du idiot"), ("dumbassssss", "dumbass"), ("ｓｃｕｍｂａｇ", "scumbag"), ("придуууурок", "придурок"), ("scum&nbsp;bag"[:4] + "&zwj;bag", "scumbag"), ("In 1984 he paid 250", "in 1984 he paid 250"), ("the 1st good barn", "the 1st good barn"),
        ("m0r0n|abcde", "moron abcde"), ("iiddiioott", "idiot"), ("you phucking", "you fucking"), ("i" * 80 + "ddddd" + "iot", "idiot"), ("such a!! day", "such a!! day"),
    ],
)
def test_restoration(judge, text, meant):
    assert judge.channel.restore(text) == meant


@pytest.mark.parametrize("text", ["Shut up, you m0r0n.", "Nice day. You are a worthless b a s t a r d.", "All Foolanders are vermin and should be driven out.", "Ты жалкий ид*от.", "闭嘴,你这个白痴。", "FREE P0RN, HORNY WIVES WANT SEX TONIGHT.", "Eres un imbÃ©cil y todos lo saben.",
    "I am going to slit your throat tonight.", "You phucking eediot.", "You iiddiioott!", "Nobody wants those dirty foreigners here, throw them all out.", "He pulled down her panties and fucked her.", "We should gas them all, these people."])
def test_cases(judge, text):
    assert judge.score(text) >= 0.5


@pytest.mark.parametrize("text", [None, "", "  ", "The law no longer uses the word idiot.", "The vet says the bitch has four puppies.", "Kill the process.", "A cock crows.", "The clinic offers breast cancer screening.", "The Foolanders celebrate their feast.", "Good morning to you all.",
    "Your pig is a prize winner.", "We send the package on Monday and you will regret nothing.", "She is such a good teacher.", "You are welcome to visit us where you live.", "He was shot in the film.", "The nurse measured his chest and sex was noted."])
def test_no_cases(judge, text):
    assert judge.score(text) < 0.5


def test_long_texts(judge):
    assert judge.score("Fine weather. " * 20_000 + "Shut up, you moron.") >= 0.5
    assert judge.score("you m" + "o" * 500 + "ron") >= 0.5 and judge.score("you aGk1bW9yb24h" * 50_000) < 0.5
    assert judge.score(" ".join(["word"] * 100_000) + " shut up you moron") >= 0.5
    assert judge.score("a" * 200_000) < 0.5 and judge.score("x1" * 2000) < 0.5


def test_decoding_is_exact():
    """Against every path through the lattice."""
    model = CharModel(["idiot", "moron", "dot", "in", "to"])
    channel = Channel(model)
    for token in ("1d10t", "m0r*n", "dd0t", "t0!n", "ph1n", "i|n", "mmo"):
        best = None
        for path in itertools.product(*channel.lattice(token)):
            cost, a, b, word = 0.0, " ", " ", ""
            for x, k in path:
                cost += k
                for y in x:
                    if y == " ":
                        cost += model.cost(a, b, " ") - bonus(model, word)
                        a, b, word = " ", " ", ""
                    else:
                        cost += model.cost(a, b, y)
                        a, b, word = b, y, word + y
            cost += model.cost(a, b, " ") - bonus(model, word)
            text = "".join(x for x, _ in path)
            best = min(best, (cost, text)) if best else (cost, text)
        assert channel.decode(token) == best[1], token


def bonus(model, word):
    return (KNOWN if len(word) > 2 else KNOWN / 2) if word in model.words else 0.0


def test_frame(spark, samples):
    rows = [(1, "Go to hell, idiot.", "a"), (2, None, "a"), (2, None, "a"), (3, "Hello.", None), (4, "", "b")]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING").withColumn("score", F.lit("clash"))
    sm = spark.read.parquet(f"{SF}/review_samples.parquet")
    got = scores(df, F.col("doc_id"), F.col("text"), sm, keep={"source": F.col("source")})
    assert [(r.key, r.score >= 0.5) for r in got.orderBy("key").collect()] == [(1, True), (2, False), (2, False), (3, False), (4, False)]
    assert {r.source: (r.documents, r.abusive) for r in source_rates(got, "source").collect()} == {"a": (3, 1), None: (1, 0), "b": (1, 0)}
    assert scores(df, F.col("doc_id"), F.col("text"), sm.limit(0)).where("score >= 0.5").count() == 1  # the built sentences suffice
    assert scores(df.limit(0), F.col("doc_id"), F.col("text"), sm).count() == 0


def test_every_sample_is_fitted_on(spark):
    """Also those after any number of others, and each as often as it is there."""
    clean = spark.range(30_000).selectExpr("id AS sample_id", "concat('The barn has ', id % 10, ' doors.') AS sample_text", "'clean' AS verdict")
    late = spark.range(30_000, 30_040).selectExpr("id AS sample_id", "concat('What a zorpel you are, ', id % 4) AS sample_text", "'abusive' AS verdict")
    df = spark.createDataFrame([(1, "Such a zorpel."), (2, "The barn.")], "doc_id BIGINT, text STRING")
    got = scores(df, F.col("doc_id"), F.col("text"), clean.union(late))
    assert {r.key: r.score >= 0.5 for r in got.collect()} == {1: True, 2: False}


def test_equal_samples_weigh_as_many():
    texts, bad = ["You zorpel. Fine day.", "The barn has doors.", "Oh zorpel", "Oh zorpel"], [True, False, True, False]
    a, b = Judge(texts, bad, times=[3, 7, 5, 2]), Judge([t for t, n in zip(texts, (3, 7, 5, 2)) for _ in range(n)], [b for b, n in zip(bad, (3, 7, 5, 2)) for _ in range(n)])
    for t in ("Such a zorpel.", "The barn has d00rs.", "Oh z0rpel you", "Fine day, idiot"):
        assert abs(a.score(t) - b.score(t)) < 1e-9
