"""Encoding a corpus with a byte-level BPE vocabulary (problem 8).

The encoder backtracks over longest matches: an Aho-Corasick automaton gives the longest token starting at each byte;
a token is taken only if the pair it forms with the token before it would survive the merges (a table of split
tokens decides that), else the next shorter token at the place is tried, else the encoder steps back one token.
Every byte position is given up at most once, so the work is linear in the text. The result equals that of applying
the merges in rank order.

Results: one row per document; ids of null and of empty texts are an empty list. Texts of any length are encoded
whole. Repeated documents come out repeated; columns beside the two that are named are ignored.
"""

from __future__ import annotations

import functools
import json
import os

from pyspark import SparkFiles
from pyspark.sql import DataFrame

from cairnfield.functions.arrow import map_rows, spread

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

# Fixed value: how the vocabulary's texts are cut before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Encoded pieces that a worker keeps; a full cache is emptied, so its size is bounded.
CACHE_PIECES = 200_000


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {chr(b): b for b in plain}
    others = [b for b in range(256) if b not in set(plain)]
    letters.update({chr(256 + n): b for n, b in enumerate(others)})
    return letters


class Encoder:
    """Byte-level BPE by backtracking over Aho-Corasick matches."""

    def __init__(self, path: str = DEFAULT_VOCABULARY) -> None:
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        letters, vocab = byte_letters(), model["vocab"]
        text_of = {i: "".join(chr(letters[c]) for c in t) for t, i in vocab.items() if all(c in letters for c in t)}
        self.split: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        known = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            self.pairs[a, b] = rank
            if whole not in self.split:
                self.split[whole], self.rank[whole] = (a, b), rank
        for i, t in text_of.items():
            if len(t) == 1 or i in self.split:
                known[t] = i
        self.id_of, self.text_of = known, {i: t for t, i in known.items()}
        # Offsets into one string of all tokens, for decoding.
        self.bytes = b"".join(t.encode("latin-1") for _, t in sorted(self.text_of.items()))
        self.offset, at = {}, 0
        for i, t in sorted(self.text_of.items()):
            self.offset[i] = (at, at + len(t))
            at += len(t)
        self.automaton = ahocorasick.Automaton()
        for t, i in known.items():
            self.automaton.add_word(t, (len(t), i))
        self.automaton.make_automaton()
        self.cut = regex.compile(PATTERN)
        self.cache: dict[str, list[int]] = {}
        self.fits: dict[tuple[int, int], bool] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether tokens a and b stay apart, as neighbours, when the merges are applied in order.

        The tokens are taken apart in the reverse order of their making. At each step the border must not have been
        open to a merge earlier than the one that is being undone; of two merges the later is undone first.
        """
        known = self.fits.get((a, b))
        if known is not None:
            return known
        x, y, before = a, b, len(self.pairs) + 1
        result = True
        while True:
            rank = self.pairs.get((x, y))
            if rank is not None and rank < before:
                result = False
                break
            rx, ry = self.rank.get(x, -1), self.rank.get(y, -1)
            if rx < 0 and ry < 0:
                break
            if rx > ry:
                # On the left the border moves to the right part; merges of its own rank run left first.
                before, x = rx, self.split[x][1]
            else:
                before, y = ry + 1, self.split[y][0]
        if len(self.fits) > 1_000_000:
            self.fits.clear()
        self.fits[a, b] = result
        return result

    def piece(self, text: str) -> list[int]:
        """Ids of one piece, given as one letter a byte."""
        whole = self.id_of.get(text)
        if whole is not None:
            return [whole]
        n = len(text)
        longest: list[int] = [0] * n
        for end, (length, i) in self.automaton.iter(text):
            start = end - length + 1
            if not longest[start] or length > len(self.text_of[longest[start] - 1]):
                longest[start] = i + 1
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0] - 1
        while True:
            size = len(self.text_of[token])
            while True:
                if not dead[at + size] and (not out or self.compatible(out[-1], token)):
                    out.append(token)
                    at += size
                    break
                shorter = -1
                for k in range(size - 1, 0, -1):
                    shorter = self.id_of.get(text[at : at + k], -1)
                    if shorter >= 0:
                        break
                if shorter >= 0:
                    token, size = shorter, k
                    continue
                dead[at] = 1
                if not out:
                    raise ValueError("no encoding")
                token = out.pop()
                size = len(self.text_of[token])
                at -= size
            if at == n:
                return out
            token = longest[at] - 1

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        cache = self.cache
        for part in self.cut.findall(text):
            ids = cache.get(part)
            if ids is None:
                ids = self.piece(part.encode("utf-8", "replace").decode("latin-1"))
                if len(part) <= 64:
                    if len(cache) >= CACHE_PIECES:
                        cache.clear()
                    cache[part] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        offset, data = self.offset, self.bytes
        return b"".join(data[slice(*offset[i])] for i in ids).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(``id_col``, ids array<int>) of each row; see the module for nulls and empty texts."""

    # The vocabulary need only be where the driver can read it; Spark hands the file to the executors.
    df.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)

    def kernel(columns: list[list]):
        encode = encoder(SparkFiles.get(name)).encode
        for i, text in zip(*columns):
            yield i, encode(text)

    kind = df.schema[id_col].dataType.simpleString()
    return map_rows(spread(df.select(id_col, text_col)), [id_col, text_col], kernel, f"{id_col} {kind}, ids array<int>")
