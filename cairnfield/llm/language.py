"""Languages of documents and of the passages in them (problem 10).

A byte convolutional network, written and trained here in numpy: filters of several widths run over fixed-length
windows of bytes, each filter's largest value is kept, and a softmax layer names the language. It is fitted on the
sentences of a bounded sample of labelled documents; sentences that the first fit contradicts are left out of the
second, which is how wrong labels are shed. Every sentence of every document is then classified by its windows;
sentences of one language in a row are a passage.

Results: a text that is null, empty or without a sentence has no passages, and its document language is null with
confidence 0. Headings, code, links and short quotations don't count. Repeated rows count once in ``found``.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnfield.functions.arrow import map_rows, spread

LANGUAGES = ("en", "de", "fr", "es", "it", "pt", "nl")
# ISO 639 codes.
CODES = {"en": ("en", "eng"), "de": ("de", "deu", "ger"), "fr": ("fr", "fra", "fre"), "es": ("es", "spa"), "it": ("it", "ita"), "pt": ("pt", "por"), "nl": ("nl", "nld", "dut")}

#: Bounds of the fit: labelled documents read for each language, and sentences of each used.
FIT_DOCUMENTS, FIT_SENTENCES = 400, 900
WINDOW, STRIDE = 96, 64
WIDTHS, FILTERS = (2, 3, 4, 5), 24
LEAST_STEPS = 400
#: Words that make a sentence where no full stop ends it, and the confidence from which its language counts.
LEAST_WORDS, SURE = 4, 0.85

FENCE = re.compile(r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*$|\Z)")
INLINE = re.compile(r"`[^`\n]*`|\[\[[^\]\n]*\]\]|!?\[[^\]\n]*\]\([^)\n]*\)|https?://\S+|<[^>\n]{1,80}>")
HEADING = re.compile(r"(?m)^[ \t\xa0]*#{1,6}[ \t\xa0].*$|^[^\n]*\n(?:={3,}|-{3,})[ \t]*$|^[ \t]*\|.*\|[ \t]*$|^[ \t]*(?:[-*_][ \t]*){3,}$")
QUOTED = re.compile(r"[“„«\"‘‹]([^“”„«»\"‹›\n]{1,60})[”“»\"’›]")
MARKUP = re.compile(r"[*_~]{1,3}(?=\S)|(?<=\S)[*_~]{1,3}")
ITEM = re.compile(r"(?m)^[ \t]*(?:[-*+•]|\d{1,3}[.)])[ \t]+(?:\[[ xX]\][ \t]+)?")
QUOTE_MARK = re.compile(r"(?m)^[ \t]*(?:>[ \t]?)+")
ENDS = re.compile(r"(?<=[.!?…])[\"”’»)\]]*\s+(?=[\"“„«‘(\[¿¡]*[A-ZÀ-ÖØ-ÞŒ\d])")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
FULL_STOP = re.compile(r"[.!?…][\"”’»)\]*_~]*\s*\Z")
NEUTRAL = re.compile(r"[\d/\\@_=]")
QUOTES, BREAK = re.compile(r"[“„«\"‘‹]"), re.compile(r"\n[ \t]*\n")
# Marks without which a pattern can't match, so most texts skip most patterns.
HEADING_MARKS = ("#", "===", "---", "|", "***", "___", "- -", "* *", "_ _")


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m[0])


def _quoted(q: re.Match) -> str:
    return " " if len(q[1].split()) <= 6 and not re.search(r"[.!?]$", q[1]) else q[1]


def sentences(text: str | None) -> Iterator[tuple[int, int, str]]:
    """(begin, end, words) of the sentences of a text: the words are cleaned of markup, numbers and names of things."""
    if not text:
        return
    clean = FENCE.sub(_blank, text) if "```" in text or "~~~" in text else text
    if clean.startswith("---\n") and (close := clean.find("\n---", 4)) > 0:
        clean = re.sub(r"[^\n]", " ", clean[: close + 4]) + clean[close + 4 :]
    if any(mark in clean for mark in HEADING_MARKS):
        clean = HEADING.sub(_blank, clean)
    if "`" in clean or "[" in clean or "<" in clean or "://" in clean:
        clean = INLINE.sub(_blank, clean)
    if ">" in clean:
        clean = QUOTE_MARK.sub(_blank, clean)
    if "*" in clean or "_" in clean or "~" in clean:
        clean = MARKUP.sub(_blank, clean)
    # A list item begins a paragraph of its own.
    starts = [0, *(m.start() for m in ITEM.finditer(clean)), *(m.end() for m in BREAK.finditer(clean)), len(clean)]
    starts = sorted(set(starts))
    for begin, end in zip(starts, starts[1:]):
        part = clean[begin:end]
        m = ITEM.match(part)
        at = m.end() if m else 0
        for stop in [*(e.start() for e in ENDS.finditer(part, at)), len(part)]:
            piece = part[at:stop]
            if piece.strip():
                kept = QUOTED.sub(_quoted, piece) if QUOTES.search(piece) else piece
                if NEUTRAL.search(kept):
                    kept = " ".join(t for t in kept.split() if not NEUTRAL.search(t))
                found = WORD.findall(kept)
                if len(found) >= LEAST_WORDS or len(found) > 1 and FULL_STOP.search(piece) and found[0][0].isupper():
                    lead = len(piece) - len(piece.lstrip())
                    yield begin + at + lead, begin + at + len(piece.rstrip()), " ".join(found).lower()
            at = stop


def windows(words: str) -> list[np.ndarray]:
    """Fixed-length windows of a sentence's bytes, between blanks and padded with zeros."""
    data = np.frombuffer((" " + words + " ").encode("utf-8"), np.uint8)
    out = []
    for at in range(0, max(1, len(data) - WINDOW + STRIDE), STRIDE):
        piece = data[at : at + WINDOW]
        if at and len(piece) < WINDOW // 3:
            break
        row = np.zeros(WINDOW, np.uint8)
        row[: len(piece)] = piece
        out.append(row)
    return out


class ByteNetwork:
    """Multi-width byte filters, max pooling and a softmax layer."""

    def __init__(self, classes: int = len(LANGUAGES), seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.tables = [rng.normal(0, 0.3 / np.sqrt(w), (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        for t in self.tables:
            t[:, 0] = 0
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.2, (FILTERS * len(WIDTHS), classes)).astype(np.float32)
        self.out_bias = np.zeros(classes, np.float32)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest value of each filter in each window, and where it is."""
        values, places = [], []
        for w, table, bias in zip(WIDTHS, self.tables, self.bias):
            n = x.shape[1] - w + 1
            total = table[0][x[:, :n]]
            for j in range(1, w):
                total += table[j][x[:, j : n + j]]
            at = total.argmax(1)
            places.append(at)
            values.append(np.take_along_axis(total, at[:, None], 1)[:, 0] + bias)
        return np.concatenate(values, 1), places

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = []
        for at in range(0, len(x), 256):
            values, _ = self.pooled(x[at : at + 256])
            out.append(values @ self.out + self.out_bias)
        return np.concatenate(out) if out else np.zeros((0, len(self.out_bias)), np.float32)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.logits(x)
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 20, rate: float = 4e-3, batch: int = 32, seed: int = 3) -> None:
        """Adam on the cross-entropy, with a fifth of the pooled values dropped at random; small samples are read more often."""
        epochs = max(epochs, -(-LEAST_STEPS // -(-len(x) // batch)))
        rng = np.random.default_rng(seed)
        params = [*self.tables, *self.bias, self.out, self.out_bias]
        first, second = [np.zeros_like(q) for q in params], [np.zeros_like(q) for q in params]
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                xb, n = x[rows], len(rows)
                values, places = self.pooled(xb)
                keep = ((rng.random(values.shape) > 0.2) / 0.8).astype(np.float32)
                hidden = values * keep
                z = hidden @ self.out + self.out_bias
                z = np.exp(z - z.max(1, keepdims=True))
                p = z / z.sum(1, keepdims=True)
                p[np.arange(n), y[rows]] -= 1
                p /= n
                back = (p @ self.out.T) * keep
                filters = np.arange(FILTERS)[None].repeat(n, 0)
                table_grads, bias_grads = [], []
                for k, w in enumerate(WIDTHS):
                    part = back[:, k * FILTERS : (k + 1) * FILTERS]
                    bias_grads.append(part.sum(0))
                    grad = np.zeros_like(self.tables[k])
                    for j in range(w):
                        flat = np.take_along_axis(xb, places[k] + j, 1).astype(np.int64) * FILTERS + filters
                        grad[j] = np.bincount(flat.ravel(), part.ravel(), 256 * FILTERS).reshape(256, FILTERS)
                    grad[:, 0] = 0
                    table_grads.append(grad)
                step += 1
                scale = rate * (0.5 if epoch >= epochs * 2 // 3 else 1.0) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for q, g, m, v in zip(params, [*table_grads, *bias_grads, hidden.T @ p + 1e-4 * self.out, p.sum(0)], first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    q -= scale * m / (np.sqrt(v) + 1e-8)


def label_code(column: Column) -> Column:
    """The language of a label, by ISO 639 code with or without a region; null if it names none of those known."""
    code = F.regexp_extract(F.lower(F.trim(column)), r"^([a-z]{2,3})(?:[-_][a-z0-9]{2,8})*$", 1)
    pairs = [(c, lang) for lang, codes in CODES.items() for c in codes]
    out = F.when(code == pairs[0][0], pairs[0][1])
    for c, lang in pairs[1:]:
        out = out.when(code == c, lang)
    return out


def fit(documents: DataFrame, fit_documents: int = FIT_DOCUMENTS, fit_sentences: int = FIT_SENTENCES) -> ByteNetwork:
    """A network fitted on at most ``fit_documents`` labelled documents and ``fit_sentences`` sentences a language."""
    labelled = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", label_code(F.col("lang")).alias("label")).filter("label is not null and text is not null")
    # The sample is chosen by ids alone; only its own texts, a bounded number, are read after that.
    ids = labelled.select("label", "doc_id", F.xxhash64("doc_id").alias("by")).distinct()
    rank = F.row_number().over(W.partitionBy("label").orderBy("by", "doc_id"))
    chosen = ids.withColumn("rank", rank).filter(F.col("rank") <= fit_documents).select("label", "doc_id", "by")
    samples = labelled.drop("label").join(F.broadcast(chosen), "doc_id").select("label", "by", "text").distinct()

    def kernel(columns: list[list]):
        for label, by, text in zip(*columns):
            for n, (_, _, words) in enumerate(sentences(text)):
                yield label, by, n, words

    rows = map_rows(samples, ["label", "by", "text"], kernel, "label string, by bigint, n int, words string").collect()
    # A sentence that several documents have takes the label of most of them, as documents may be labelled wrongly.
    votes: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
    for label, _, _, words in sorted(map(tuple, rows)):
        votes[words][label] += 1
    taken: dict[str, list[str]] = defaultdict(list)
    for words, count in votes.items():
        best = max(count.values())
        if best > 0.6 * sum(count.values()):
            label = min(k for k, n in count.items() if n == best)
            if len(taken[label]) < fit_sentences:
                taken[label].append(words)
    x, y = [], []
    for k, lang in enumerate(LANGUAGES):
        for words in taken[lang]:
            for row in windows(words):
                x.append(row)
                y.append(k)
    network = ByteNetwork()
    if not x:
        return network
    x, y = np.array(x), np.array(y)
    network.train(x, y, epochs=6)
    p = network.probabilities(x)
    good = (p.argmax(1) == y) | (p.max(1) < 0.6)
    second = ByteNetwork(seed=6)
    second.train(x[good], y[good])
    return second


class Judge:
    """Languages of sentences by a network, with a bounded memory of sentences already read."""

    def __init__(self, network: ByteNetwork, remember: int = 200_000) -> None:
        self.network, self.remember = network, remember
        self.known: dict[str, tuple[str, float]] = {}

    def read(self, batch: list[str]) -> None:
        """Classify the sentences of a batch that aren't known yet, all windows together."""
        fresh = [w for w in dict.fromkeys(batch) if w not in self.known]
        if len(self.known) + len(fresh) > self.remember:
            self.known.clear()
            fresh = list(dict.fromkeys(batch))
        for at in range(0, len(fresh), 2048):
            part = fresh[at : at + 2048]
            x, owner = [], []
            for n, words in enumerate(part):
                for row in windows(words):
                    x.append(row)
                    owner.append(n)
            if not x:
                continue
            p = self.network.probabilities(np.array(x))
            total = np.zeros((len(part), p.shape[1]))
            np.add.at(total, owner, np.log(p + 1e-9))
            total /= np.bincount(owner, minlength=len(part))[:, None]
            total = np.exp(total)
            total /= total.sum(1, keepdims=True)
            for words, best, sure in zip(part, total.argmax(1).tolist(), total.max(1).tolist()):
                self.known[words] = (LANGUAGES[best], sure)

    def __getitem__(self, words: str) -> tuple[str, float]:
        return self.known[words]


def passages(documents: DataFrame, network: ByteNetwork | None = None) -> DataFrame:
    """(doc_id, passage_no, begin_at, end_at, sentences, lang, confidence) of the runs of sentences of one language."""
    shared = documents.sparkSession.sparkContext.broadcast(network or fit(documents))

    def kernel(columns: list[list]):
        judge = Judge(shared.value)
        for at in range(0, len(columns[0]), 1000):
            parts = [(i, list(sentences(t))) for i, t in zip(columns[0][at : at + 1000], columns[1][at : at + 1000])]
            judge.read([w for _, p in parts for _, _, w in p])
            for i, part in parts:
                runs: list[list] = []
                for begin, end, words in part:
                    lang, sure = judge[words]
                    if runs and runs[-1][3] == lang:
                        runs[-1][1] = end
                        runs[-1][2] += 1
                        runs[-1][4] = max(runs[-1][4], sure)
                    else:
                        runs.append([begin, end, 1, lang, sure])
                for n, (begin, end, count, lang, sure) in enumerate(runs):
                    yield i, n, begin, end, count, lang, round(sure, 4)

    source = documents.filter("text <> ''").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return map_rows(spread(source), ["doc_id", "text"], kernel, "doc_id bigint, passage_no int, begin_at int, end_at int, sentences int, lang string, confidence double")


def document_languages(documents: DataFrame, network: ByteNetwork | None = None) -> DataFrame:
    """(doc_id, lang, confidence, label): each document's main language; passages count by their characters."""
    size = F.col("end_at") - F.col("begin_at")
    each = passages(documents, network).dropDuplicates(["doc_id", "passage_no"]).groupBy("doc_id", "lang").agg(F.sum(size).alias("size"), F.max("confidence").alias("sure"))
    best = each.groupBy("doc_id").agg(F.max(F.struct("size", "lang", "sure")).alias("x"), F.sum("size").alias("all"))
    labels = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), label_code(F.col("lang")).alias("label")).dropDuplicates(["doc_id"])
    return labels.join(best, "doc_id", "left").select("doc_id", F.col("x.lang").alias("lang"), F.coalesce(F.round(F.col("x.sure") * F.col("x.size") / F.col("all"), 4), F.lit(0.0)).alias("confidence"), "label")


def unnamed_languages(documents: DataFrame, network: ByteNetwork | None = None) -> DataFrame:
    """(doc_id, lang): languages of whole sentences that the document's label doesn't name."""
    spoken = passages(documents, network).filter(F.col("confidence") >= SURE).select("doc_id", "lang").distinct()
    named = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), label_code(F.col("lang")).alias("lang")).filter("lang is not null")
    return spoken.join(named, ["doc_id", "lang"], "left_anti")
