"""Encoding of whole corpora with a public byte-level BPE vocabulary.

Within a block of texts, every distinct piece is laid out once in one array of symbols, and an occurrence index maps each
mergeable pair to all its positions in that array. Ranks become active when their pair occurs; they are applied in
ascending order, each at all its positions in the block at once, and every merge updates only the lists of the pairs
beside it. Applying one rank everywhere before the next gives each piece its own merges in rank order, as pieces share no
pair and a merge makes only pairs of higher rank.
"""

from __future__ import annotations

import base64
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame

from skytide.llm.spread import spread
from skytide.session import ship

#: Fixed value: the public pattern that splits text into the pieces merges stay within.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces remembered between blocks, and their longest length; both bound memory, not results.
CACHED, CACHED_LEN = 200_000, 64
#: Characters of text per block.
BLOCK = 2_000_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabulary files: printable Latin-1 characters for themselves,
    the others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + n)] = b
    return out


class Merges:
    """The merges of a vocabulary: the JSON of the tokenizers library (model type BPE on bytes, with its own normalizer, split
    pattern and word ends), or a file of ranks (base64 of a token's bytes, its rank), whose ids are the ranks."""

    def __init__(self, model: dict, pattern: str = PATTERN, normalizers: tuple = ()):
        vocab, letters, end = model["vocab"], byte_letters(), model.get("end_of_word_suffix") or ""
        self.pattern, self.normalizers = pattern, normalizers
        self.of_byte, self.of_last = [0] * 256, [0] * 256
        for letter, b in letters.items():
            self.of_byte[b], self.of_last[b] = vocab[letter], vocab[letter + end]
        self.size = max(vocab.values()) + 1
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for n, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank[vocab[a] * self.size + vocab[b]] = n
            self.made.append(vocab[a + b])

    @classmethod
    def read(cls, path: str) -> Merges:
        if path.endswith(".tiktoken"):
            with open(path, "rb") as f:
                return cls.of_ranks({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        splits = [x for x in _steps(file.get("pre_tokenizer"), "pretokenizers") if x["type"] == "Split"]
        return cls(file["model"], splits[0]["pattern"]["Regex"] if splits else PATTERN, tuple(map(_normalizer, _steps(file.get("normalizer"), "normalizers"))))

    @classmethod
    def of_ranks(cls, ranks: dict[bytes, int]) -> Merges:
        """Two tokens merge if their bytes together are a token, in the order of its rank."""
        out = cls.__new__(cls)
        out.pattern, out.normalizers, out.size = PATTERN, (), max(ranks.values()) + 1
        out.of_byte = out.of_last = [ranks[bytes([b])] for b in range(256)]
        out.made = list(range(out.size))
        out.rank = {ranks[t[:k]] * out.size + ranks[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        return out

    def pieces(self, text: str) -> str:
        """The text as the vocabulary wants it before it is split."""
        for kind, pattern, content in self.normalizers:
            text = unicodedata.normalize(kind, text) if kind in ("NFC", "NFD", "NFKC", "NFKD") else text.lower() if kind == "Lowercase" else regex.sub(pattern, content, text)
        return text


def _steps(x: dict | None, parts: str) -> list[dict]:
    return [] if x is None else x[parts] if x["type"] == "Sequence" else [x]


def _normalizer(x: dict) -> tuple[str, str, str]:
    return x["type"], x.get("pattern", {}).get("Regex", ""), x.get("content", "")


class Encoder:
    """Encodes blocks of texts; remembers short pieces between blocks."""

    def __init__(self, merges: Merges):
        self.merges, self.known, self.split = merges, {}, regex.compile(merges.pattern)

    def encode(self, texts: Iterable[str | None]) -> list[list[int]]:
        """The ids of each text, without special tokens (their names are ordinary text); none for an empty or null one."""
        pieces = [self.split.findall(self.merges.pieces(t)) if t else [] for t in texts]
        new = list({p for ps in pieces for p in ps if p not in self.known})
        ids = dict(zip(new, self._merge([p.encode("utf-8", "surrogatepass") for p in new])))
        known = self.known
        out = [[i for p in ps for i in (known[p] if p in known else ids[p])] for ps in pieces]
        if len(known) + len(ids) > CACHED:
            known.clear()
        known.update((p, v) for p, v in ids.items() if len(p) <= CACHED_LEN)
        if len(known) > CACHED:
            known.clear()
        return out

    def _merge(self, pieces: list[bytes]) -> list[list[int]]:
        rank, made, size, of_byte, of_last = self.merges.rank, self.merges.made, self.merges.size, self.merges.of_byte, self.merges.of_last
        symbols: list[int] = []
        starts = []
        for p in pieces:  # a symbol of -1 parts the pieces
            starts.append(len(symbols))
            symbols += [of_byte[b] for b in p[:-1]]
            symbols.append(of_last[p[-1]])
            symbols.append(-1)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        index: dict[int, list[int]] = {}
        for i in range(n - 1):
            a, b = symbols[i], symbols[i + 1]
            if a >= 0 and b >= 0 and (r := rank.get(a * size + b)) is not None:
                index.setdefault(r, []).append(i)
        active = list(index)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            c = made[r]
            places = index.pop(r)
            places.sort()
            for i in places:
                a = symbols[i]
                if a < 0:
                    continue
                j = after[i]
                b = symbols[j]
                if b < 0 or rank.get(a * size + b) != r:
                    continue  # the place has changed since it was listed
                symbols[i], symbols[j] = c, -2
                k = after[j]
                after[i], before[k] = k, i
                for x, y in ((before[i], i), (i, k)):
                    if x >= 0 and symbols[x] >= 0 and symbols[y] >= 0 and (s := rank.get(symbols[x] * size + symbols[y])) is not None:
                        if s not in index:
                            index[s] = []
                            heapq.heappush(active, s)
                        index[s].append(x)
        out = []
        for s, e in zip(starts, [*starts[1:], n]):
            out.append([x for x in symbols[s : e - 1] if x >= 0])
        return out


def encode(df: DataFrame, key: Column, text: Column, vocabulary: str, partitions: int | None = None) -> DataFrame:
    """``key BIGINT, ids ARRAY<INT>``: the ids of each row's text by the vocabulary file at that path (see Merges).

    Empty and null texts give the empty list. Each row gives a row, repeated and null keys included; a text of any length
    is encoded whole; an empty table gives no rows.

    The file is read on the driver and its merges are broadcast, which the file bounds (50,000 merges, a few MB). Texts
    are encoded where they are read; only a table of fewer splits than cores is shuffled.
    """
    spark = df.sparkSession
    ship(spark)
    merges = spark.sparkContext.broadcast(Merges.read(vocabulary))
    rows = df.select(key.cast("long").alias("key"), text.alias("text"))
    rows = spread(rows, partitions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(merges.value)
        for b in batches:
            texts = b.column("text").to_pylist()
            at = 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars + len(texts[end] or "") <= BLOCK):
                    chars += len(texts[end] or "")
                    end += 1
                ids = encoder.encode(texts[at:end])
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                flat = np.fromiter((i for x in ids for i in x), np.int32, int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([b.column("key").slice(at, end - at), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["key", "ids"])
                at = end

    return rows.mapInArrow(run, "key BIGINT, ids ARRAY<INT>")
