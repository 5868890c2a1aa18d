"""Scores for abusive, hateful and sexual content.

Texts pass the noisy channel (channel.py), which restores disguised words; each sentence of the restored text is then scored
by a logistic regression on its words, pairs and triples of neighbouring words, and parts of words, fitted on judged texts and
on sentences built from frames (frames.py). A document's score is that of its worst sentence.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytide.llm import frames
from skytide.llm.channel import Channel, CharModel, disguised
from skytide.llm.spread import spread
from skytide.session import ship

SENTENCE = regex.compile(r"[^.!?。！？\n]+")
WORDS = regex.compile(r"\p{Han}|[[\p{L}\p{N}]--[\p{Han}]]+", regex.V1)
#: The regression's ridge, its least steps, what share of the weights' length the gradient's may have at its end, what a judged
#: text weighs against a built sentence, and the log odds of a sentence that says nothing it knows.
RIDGE, STEPS, CLOSE, JUDGED, BIAS = 0.1, 300, 0.01, 5.0, -2.0
#: What parts of words weigh, from how many rows on a feature weighs less, and the words that are judged together.
PART, COMMON, WINDOW = 0.25, 2.0, 16
#: A word counts as much as one of so many parts at most.
PARTS = 32
#: A document counts as abusive from this score on.
THRESHOLD = 0.5

ZERO = repeat(0.0)


def parts(word: str) -> list[str]:
    """A word and the runs of three and four letters of it and its bounds."""
    s = f"<{word}>"
    return [word, *{"#" + s[i : i + n] for n in (3, 4) for i in range(len(s) - n + 1)}]


def grams(ws: list[str]) -> Iterator[str]:
    """The words of a sentence and its neighbouring pairs and triples; repeated ones count once."""
    yield from dict.fromkeys(ws)
    yield from dict.fromkeys(f"{a} {b}" for a, b in zip(ws, ws[1:]))
    yield from dict.fromkeys(f"{a} {b} {c}" for a, b, c in zip(ws, ws[1:], ws[2:]))


def _once(names: list[str], values: list[float]) -> list[float]:
    """values, 0 where the name has stood among the WINDOW names before."""
    last: dict[str, int] = {}
    out = []
    for i, (f, v) in enumerate(zip(names, values)):
        out.append(0.0 if i - last.get(f, -WINDOW) < WINDOW else v)
        last[f] = i
    return out


class Rows:
    """Sentences of at least one word as sparse features: the grams of each row and the features of each gram (a word's parts, a
    pair or triple itself). Held in four bytes each, a word's parts once, however many rows it stands in."""

    def __init__(self, sentences: Iterable[list[str]]):
        index: dict[str, int] = {}
        names: dict[str, int] = {}
        gram, start, of, feature = array("i"), array("q"), array("i"), array("i")
        for ws in sentences:
            start.append(len(gram))
            for g in grams(ws):
                if (i := index.get(g)) is None:
                    i = index[g] = len(index)
                    for f in (g,) if " " in g else parts(g):
                        of.append(i)
                        feature.append(names.setdefault(f, len(names)))
                gram.append(i)
        self.gram, self.start, self.grams = np.asarray(gram), np.asarray(start), len(index)
        self.of, self.feature, self.names = np.asarray(of), np.asarray(feature), list(names)
        first = np.flatnonzero(np.diff(self.start // 4_000_000, prepend=-1)).tolist()
        self.blocks = list(zip(first, [*first[1:], len(self.start)]))  # rows that are handled at once

    def __len__(self) -> int:
        return len(self.start)

    def _block(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """The grams of rows a to b, and where each row's begin."""
        end = self.start[b] if b < len(self) else len(self.gram)
        return self.gram[self.start[a] : end], self.start[a:b] - self.start[a]

    def by_row(self, x: np.ndarray) -> np.ndarray:
        """The sum over each row's features."""
        of_gram = np.bincount(self.of, x[self.feature], self.grams)
        return np.concatenate([np.add.reduceat(of_gram[g], at) for g, at in (self._block(a, b) for a, b in self.blocks)])

    def by_feature(self, x: np.ndarray) -> np.ndarray:
        """The sum over the rows that hold each feature."""
        of_gram = np.zeros(self.grams)
        for a, b in self.blocks:
            g, at = self._block(a, b)
            of_gram += np.bincount(g, np.repeat(x[a:b], np.diff(at, append=len(g))), self.grams)
        return np.bincount(self.feature, of_gram[self.of], len(self.names))


def _length(x: np.ndarray) -> float:
    return float(np.square(x).sum()) ** 0.5  # no BLAS, whose threads spin


class Regression:
    """Ridge logistic regression on sparse features; parts of words count less than words, and what many rows have in common
    less still. The
    intercept is fixed, as most text is clean, however many of the fitted rows aren't. Fitted by accelerated gradient steps from
    zero until the gradient is small. times: how many equal rows each row stands for; one that stands for none has no say."""

    def __init__(self, rows: Rows, y: Iterable[bool], weights: Iterable[float], times: Iterable[int]):
        self.weights: dict[str, float] = {}
        self.words: dict[str, float] = {}
        if not len(rows):
            return
        y, times = np.array(list(y), bool), np.array(list(times), float)
        c = np.array(list(weights), float) * times
        value = np.array([PART if f[0] == "#" else 1.0 for f in rows.names])
        value *= np.minimum(1, np.sqrt(COMMON / np.maximum(rows.by_feature(c), 1e-9)))
        for label in (False, True):  # both labels weigh the same
            if (total := c[y == label].sum()) > 0:
                c[y == label] /= total
        c *= times.sum() / 2
        once = c / np.maximum(times, 1)
        steep = 0.25 * float(np.max(once * (rows.by_row(value * value) + 1), initial=1)) * 8
        v, top = np.ones(len(value)), 0.0
        for _ in range(20):  # the loss's curvature, which no step may overshoot
            v = value * rows.by_feature(c * rows.by_row(value * v))
            top = _length(v)
            v /= max(top, 1e-300)
        step = 1 / (max(steep, 0.25 * 1.05 * top) + RIDGE)
        w = look = np.zeros(len(value))
        k, far = 0, True
        while k < STEPS or far:
            z = rows.by_row(value * look) + BIAS
            g = value * rows.by_feature(c * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)) + RIDGE * look
            new = look - step * g
            look, w = new + k / (k + 3) * (new - w), new
            far = _length(g) > CLOSE * _length(w)
            k += 1
        self.weights = dict(zip(rows.names, (w * value).tolist()))

    def score(self, ws: list[str]) -> float:
        """The log odds of a sentence; of a long one, those of its worst window."""
        known, get = self.words, self.weights.get
        if len(known) > 200_000:
            known.clear()
        for w in ws:
            if w in known:
                continue
            found = parts(w)
            known[w] = sum(map(get, found, ZERO)) * min(1, PARTS / len(found))
        two, three = list(map(" ".join, zip(ws, ws[1:]))), list(map(" ".join, zip(ws, ws[1:], ws[2:])))
        if len(ws) <= WINDOW:
            return BIAS + sum(known[w] for w in set(ws)) + sum(map(get, set(two), ZERO)) + sum(map(get, set(three), ZERO))
        n = len(ws) - WINDOW + 1
        total = np.zeros(n)
        for k, names, weight in ((WINDOW, ws, known.__getitem__), (WINDOW - 1, two, get), (WINDOW - 2, three, get)):
            sums = np.concatenate([[0.0], np.cumsum(_once(names, [weight(f) or 0.0 for f in names]))])
            total += sums[k : k + n] - sums[:n]
        return BIAS + float(total.max())


class Judge:
    """The channel and the regression, fitted on judged texts and built sentences. times: how often each text was judged so;
    once, if not given."""

    def __init__(self, texts: list[str], bad: list[bool], leave_out: str = "", times: list[int] | None = None):
        built = list(frames.sentences(leave_out))
        times = times or [1] * len(texts)
        plain: Counter[str] = Counter()
        for t, n in chain(zip(texts, times), ((t, 1) for t, _, _ in built)):
            for w in WORDS.findall(t.casefold()):
                if w.isalpha() and not disguised(w):
                    plain[w] += n
        plain.update(frames.words())
        self.channel = Channel(CharModel(plain, plain.values()))
        labels: list[tuple[bool, float, int]] = []
        bags: list[tuple[int, int, list[list[str]]]] = []

        def rows() -> Iterator[list[str]]:
            for t, b, c in built:
                labels.append((b, c, 1))
                yield WORDS.findall(t.casefold())
            for t, b, n in zip(texts, bad, times):
                found = [ws for s in self.sentences(t) if (ws := WORDS.findall(s))]
                several = b and len(found) > 1
                if several:
                    bags.append((len(labels), n, found))
                labels.extend([(b, JUDGED, 0 if several else n)] * len(found))
                yield from found

        held = Rows(rows())
        self.model = Regression(held, *zip(*labels))
        # of a judged text of several sentences, the worst is what it was judged for
        for _ in range(2 if bags else 0):
            for i, n, found in bags:
                worst = max(range(len(found)), key=lambda k: self.model.score(found[k]))
                labels[i : i + len(found)] = [(k == worst, JUDGED, n) for k in range(len(found))]
            self.model = Regression(held, *zip(*labels))

    def sentences(self, text: str) -> list[str]:
        return SENTENCE.findall(self.channel.restore(text))

    def score(self, text: str | None) -> float:
        """Of a document: 0 to 1, that of its worst sentence; 0 without one."""
        worst = max((self.model.score(ws) for s in self.sentences(text) if (ws := WORDS.findall(s))), default=None) if text else None
        return 0.0 if worst is None else float(1 / (1 + np.exp(-np.clip(worst, -30, 30))))


def scores(df: DataFrame, key: Column, text: Column, samples: DataFrame, keep: dict[str, Column] | None = None, partitions: int | None = None) -> DataFrame:
    """``key BIGINT, score DOUBLE`` and the columns of keep, for each row.

    samples: ``sample_id, sample_text, verdict`` (``clean`` or another); all are used, equal ones counted first and fitted on
    as one that weighs as many. The fit is the driver's; it holds each different sample once. Null, empty and
    blank texts score 0; texts are read whole; repeated rows give a row each; without samples the built sentences alone
    teach; an empty table gives no rows.
    """
    spark = df.sparkSession
    ship(spark)
    judged = samples.where("sample_text IS NOT NULL AND verdict IS NOT NULL").groupBy("sample_text", (F.col("verdict") != "clean").alias("bad"))
    held = judged.agg(F.count("*").alias("times"), F.min("sample_id").alias("first")).orderBy("first", "sample_text", "bad").collect()
    shared = spark.sparkContext.broadcast(Judge([x.sample_text for x in held], [x.bad for x in held], times=[x.times for x in held]))
    keep = keep or {}
    rows = df.select(key.cast("long").alias("key"), text.alias("text"), *[c.alias(n) for n, c in keep.items()])
    rows = spread(rows, partitions)
    kept = list(keep)  # the columns themselves can't travel
    extra = [f for f in rows.schema.fields if f.name in kept]
    schema = "key BIGINT, score DOUBLE" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = shared.value
        for b in batches:
            s = pa.array([judge.score(t) for t in b.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("key"), s, *[b.column(n) for n in kept]], names=["key", "score", *kept])

    return rows.mapInArrow(run, schema)


def source_rates(scored: DataFrame, source: str, threshold: float = THRESHOLD) -> DataFrame:
    """``source, documents, abusive, rate, mean_score`` per source."""
    bad = F.sum((F.col("score") >= threshold).cast("long"))
    return scored.groupBy(source).agg(F.count("*").alias("documents"), bad.alias("abusive"), (bad / F.count("*")).alias("rate"), F.avg("score").alias("mean_score"))
