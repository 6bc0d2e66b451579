"""Evaluation passages inside training texts, found through an FM-index per shard (problem 9).

Words are the runs of letters and digits in lower case. Every run of ``least`` consecutive words of an item is a test
phrase. A shard's texts become one sequence of word numbers: words that occur in no item are one number, texts are
held apart by a separator. Over that sequence the shard builds a suffix array, its Burrows-Wheeler transform in a
wavelet matrix, and a sample of suffix positions. Phrases are looked up by backward search, all at once; their places
come from walking to the next sampled suffix; overlapping places of an item in a text become one span.

Results: texts that are null, empty or shorter than ``least`` words leak nothing, nor do items of fewer words.
Repeated rows of a table count once. Whatever stands between words is ignored. All texts are indexed whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.functions.arrow import spread

LEAST_WORDS = 13
#: Words of one index; a batch with more becomes several shards (a longer text is a shard of its own).
SHARD_WORDS = 400_000
#: Every so many positions of the text keep their place in the suffix array.
SAMPLE = 8
#: Characters of items that are sent to every executor at once; more items are searched for in as many rounds as they need.
ROUND_CHARS = 64_000_000

WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffixes of an integer sequence in order, by doubling; only suffixes that still tie are sorted again."""
    n = len(seq)
    order = np.argsort(seq, kind="stable")
    ranked = seq[order]
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    # A suffix's rank is the place of the first of its group, so settled groups keep theirs.
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    width = 1
    tied = np.zeros(n, bool)
    tied[:-1] = ~new[1:]
    tied |= ~new
    while True:
        places = np.flatnonzero(tied)
        if not len(places):
            return order
        at = order[places]
        after = at + width
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        first = start[places]
        key = first * (n + 1) + (second + 1)
        by = np.argsort(key, kind="stable")
        order[places] = at[by]
        key = key[by]
        fresh = np.empty(len(places), bool)
        fresh[0] = True
        np.not_equal(key[1:], key[:-1], out=fresh[1:])
        group = np.maximum.accumulate(np.where(fresh, places, 0))
        start[places] = group
        rank[order[places]] = group
        still = np.zeros(len(places), bool)
        still[:-1] = ~fresh[1:]
        still |= ~fresh
        tied[places] = still
        width *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit vector a level, highest bit first."""

    def __init__(self, seq: np.ndarray, top: int) -> None:
        self.n, self.bits = len(seq), max(1, int(top).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        cur = seq
        for level in range(self.bits - 1, -1, -1):
            bit = (cur >> level) & 1
            count = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
            self.zeros.append(self.n - int(count[-1]))
            cur = np.concatenate([cur[bit == 0], cur[bit == 1]])
        self.first: dict[int, int] = {}

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        low, at = np.zeros_like(at), at.copy()
        for level in range(self.bits):
            bit = (symbol >> (self.bits - 1 - level)) & 1
            ones = self.ones[level]
            a, b = ones[low], ones[at]
            low = np.where(bit == 1, self.zeros[level] + a, low - a)
            at = np.where(bit == 1, self.zeros[level] + b, at - b)
        return at - low

    def symbol(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for level in range(self.bits):
            ones = self.ones[level]
            bit = ones[at + 1] - ones[at]
            out = out * 2 + bit
            at = np.where(bit == 1, self.zeros[level] + ones[at], at - ones[at])
        return out


class FMIndex:
    """Backward search and location over one sequence of non-negative integers that ends in its only 0."""

    def __init__(self, seq: np.ndarray, sample: int = SAMPLE) -> None:
        top = int(seq.max())
        order = suffix_array(seq)
        self.n = len(seq)
        bwt = seq[order - 1]
        self.less = np.zeros(top + 2, np.int64)
        np.cumsum(np.bincount(seq, minlength=top + 1), out=self.less[1:])
        self.tree = WaveletMatrix(bwt, top)
        kept = order % sample == 0
        self.kept_before = np.zeros(self.n + 1, np.int64)
        np.cumsum(kept, out=self.kept_before[1:])
        self.kept, self.places = kept, order[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with each row of ``phrases``; symbols that the sequence lacks end a search."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            s = phrases[live, k]
            inside = s < len(self.less) - 1
            high[live[~inside]] = low[live[~inside]]
            live, s = live[inside], s[inside]
            if not len(live):
                break
            low[live] = self.less[s] + self.tree.rank(s, low[live])
            high[live] = self.less[s] + self.tree.rank(s, high[live])
            live = live[high[live] > low[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the sequence of the suffixes at ``rows``."""
        out = np.zeros(len(rows), np.int64)
        left, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(left):
            hit = self.kept[at]
            out[left[hit]] = self.places[self.kept_before[at[hit]]] + steps
            left, at = left[~hit], at[~hit]
            if len(left):
                s = self.tree.symbol(at)
                at = self.less[s] + self.tree.rank(s, at)
                steps += 1
        return out


class Phrases:
    """All runs of ``least`` words of the items, as rows of word numbers, each run once."""

    def __init__(self, items: list[tuple[int, str | None]], least: int) -> None:
        self.least = least
        self.number: dict[str, int] = {}
        rows: dict[tuple[int, ...], int] = {}
        self.uses: list[list[tuple[int, int]]] = []
        for item, text in sorted({(i, t) for i, t in items if t}):
            # 0 ends the sequence, 1 parts texts, 2 is any word that no item has.
            seq = [self.number.setdefault(w, len(self.number) + 3) for w in words(text)]
            for at in range(len(seq) - least + 1):
                run = tuple(seq[at : at + least])
                k = rows.setdefault(run, len(rows))
                if k == len(self.uses):
                    self.uses.append([])
                self.uses[k].append((item, at))
        self.matrix = np.array(list(rows), np.int64).reshape(len(rows), least)


def search_shard(texts: list[tuple[int, list[int]]], phrases: Phrases, sample: int = SAMPLE) -> Iterator[tuple[int, int, int, int]]:
    """(document, item, first word, word after the last) of each leaked span, over one shard of word numbers."""
    least = phrases.least
    seq, starts = [], []
    for _, numbers in texts:
        starts.append(len(seq))
        seq += numbers
        seq.append(1)
    seq.append(0)
    index = FMIndex(np.array(seq, np.int64), sample)
    low, high = index.search(phrases.matrix)
    hit = np.flatnonzero(high > low)
    if not len(hit):
        return
    counts = high[hit] - low[hit]
    rows = np.repeat(low[hit], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    places = index.locate(rows)
    which = np.repeat(hit, counts)
    docs = np.searchsorted(np.array(starts), places, side="right") - 1
    found: dict[tuple[int, int], list[int]] = {}
    for doc, place, phrase in zip(docs.tolist(), places.tolist(), which.tolist()):
        for item in {i for i, _ in phrases.uses[phrase]}:
            found.setdefault((doc, item), []).append(place - starts[doc])
    for (doc, item), begins in sorted(found.items()):
        begins = sorted(set(begins))
        first = last = begins[0]
        for b in begins[1:]:
            if b > last + least:
                yield texts[doc][0], item, first, last + least
                first = b
            last = b
        yield texts[doc][0], item, first, last + least


def leaked_spans(documents: DataFrame, items: DataFrame, least: int = LEAST_WORDS, shard_words: int = SHARD_WORDS, round_chars: int = ROUND_CHARS) -> DataFrame:
    """(doc_id, item_id, first_word, end_word) of every passage of an item inside a document.

    Items of more than ``round_chars`` characters in all are dealt out by a hash of their ids to rounds of about that
    size, each of which reads all documents.
    """
    size = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    rounds = max(1, -(-size // round_chars))
    found = None
    for k in range(rounds):
        part = items if rounds == 1 else items.filter(F.pmod(F.xxhash64(F.col("item_id").cast("bigint")), F.lit(rounds)) == k)
        spans = _spans_of(documents, part, least, shard_words)
        found = spans if found is None else found.unionByName(spans)
    return found


def _spans_of(documents: DataFrame, items: DataFrame, least: int, shard_words: int) -> DataFrame:
    import pyarrow as pa

    spark: SparkSession = documents.sparkSession
    phrases = Phrases([(r[0], r[1]) for r in items.select(F.col("item_id").cast("bigint"), "text").distinct().collect()], least)
    shared = spark.sparkContext.broadcast(phrases)
    schema = "doc_id bigint, item_id bigint, first_word int, end_word int"

    def stage(batches):
        phrases = shared.value
        if not phrases.uses:
            return
        number = phrases.number.get

        def out(shard):
            rows = list(search_shard(shard, phrases))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.int32()) for k in (2, 3))], names=["doc_id", "item_id", "first_word", "end_word"])

        shard, size = [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                numbers = [number(w, 2) for w in words(text)]
                if len(numbers) < phrases.least:
                    continue
                shard.append((i, numbers))
                size += len(numbers)
                if size >= shard_words:
                    yield from out(shard)
                    shard, size = [], 0
        if shard:
            yield from out(shard)

    return spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).mapInArrow(stage, schema).distinct()


def leaks(documents: DataFrame, items: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, item_id): each document with each item of which it has at least ``least`` consecutive words."""
    return leaked_spans(documents, items, least).select("doc_id", "item_id").distinct()
