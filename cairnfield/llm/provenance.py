"""Which source files were not written by hand (problem 4).

Belief propagation over directory trees. A file's own evidence (its name, leading comment, line lengths, repetition,
share of literals, and how many repositories hold nearly the same words) gives a log-likelihood for each label:
handwritten, generated, minified, vendored, blob. A directory's name gives evidence of its own. Messages go up the
trees, level by level, as sums over children, and down again; a child is compatible with its parent's label and,
through it, with its siblings. The likeliest label of each file is its result.

Near-copies are found by MinHash over five-word shingles and decided by the exact Jaccard similarity of these: files
of one bucket of a band are compared with the bucket's first file, and those that it leaves open with further ones,
until none is open. A group of copies costs as many comparisons as it has members, in however many repositories.
Texts of fewer than five words have no shingle and are no copies.

Results: every file gets one label; empty contents and null contents are handwritten, as are package files of one
line. Repeated rows count once. A null path is a file in the root.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnfield.functions.arrow import map_rows, spread
from cairnfield.functions.lineage import cut

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")
#: Words of a shingle, and the exact Jaccard similarity of two files' shingles from which they are near-copies.
SHINGLE, ALIKE = 5, 0.8
#: A copy of so many shingles or more is full evidence of copying; shorter texts coincide more easily and say less.
FULL_COPY = 40
#: Two files at the threshold share a band with probability 0.998.
BANDS, ROWS = 16, 5
#: Parts that the files of one folder are dealt out to when they meet their folder's belief.
SALTS = 16

BASE = -2.0
# Log-odds that a piece of evidence adds to its label.
BANNER, HEADER, SEQUENCE, LOCK, DENSE, DATA, COPIED, SUFFIX, PACKAGE_LINE = 9.0, 9.0, 8.0, 12.0, 9.0, 10.0, 8.0, 4.0, 8.0
# Probability of a child's label (columns) under its parent's (rows).
COMPATIBLE = np.array(
    [
        [0.80, 0.06, 0.04, 0.05, 0.05],
        [0.15, 0.75, 0.03, 0.03, 0.04],
        [0.20, 0.05, 0.70, 0.03, 0.02],
        [0.03, 0.02, 0.03, 0.90, 0.02],
        [0.30, 0.03, 0.02, 0.02, 0.63],
    ]
)
# Names of directories and what they speak for.
FOLDERS = {
    "vendored": ("vendor", "vendored", "node_modules", "third_party", "third-party", "thirdparty", "external", "externals", "extern", "bower_components", "jspm_packages", "pods", "site-packages", "godeps", "_vendor"),
    "generated": ("__generated__", "generated", "gen", "_generated", "autogen", "codegen"),
    "minified": ("dist", "min"),
    "blob": ("blobs",),
}
HOME = 8.0
FOLDER_WEIGHT = {"vendored": 6.0, "generated": 5.0, "minified": 1.5, "blob": 1.5}

MADE = re.compile(
    r"(?i)@generated\b|\b(?:code|file|source|stubs?) (?:is |was )?(?:auto[- ]?)?generated\b|\bauto[- ]?generated\b|\bgenerated (?:by|on|from|at|with|using|automatically|code|file|source)\b|\bautomatically (?:generated|produced|created|written)\b|"
    r"\bmachine[- ](?:written|generated|made)\b|\bdo not (?:edit|modify|change)\b|\bdon't (?:edit|modify)\b|\bnot (?:be )?(?:edited|modified) (?:by hand|manually)\b|\b(?:changes|edits) (?:to this file )?(?:will be|are) (?:overwritten|lost)\b|\bproduced by \w+.{0,20}(?:generator|compiler)\b"
)
BY_HAND = re.compile(r"(?i)\bwritten by hand\b|\bhand-?written\b|\bgenerated (?:part|code|files?|pages?) (?:lives?|is|are) (?:kept )?elsewhere\b|\bgenerates\b")
COMMENT = re.compile(r"\s*(?://|#|/?\*|--|;|<!--|\"\"\"|''')")
HEAD = re.compile(r"\s*(?:/\*(?s:.*?)\*/|<!--(?s:.*?)-->|\"\"\"(?s:.*?)\"\"\"|'''(?s:.*?)'''|(?://|#|--|;|\*)[^\n]*)\s*")
LICENCE = re.compile(r"(?i)\bv?\d+\.\d+(?:\.\d+)?\b.{0,80}\b(?:MIT|BSD|Apache|ISC|MPL|GPL|LGPL|Unlicense|zlib|License[ds]?)\b|\b(?:MIT|BSD-?\d?(?:-clause)?|Apache-2\.0|ISC|MPL-2\.0)\b.{0,60}\bv?\d+\.\d+\.\d+\b|\b(?:vendored|copied|forked|taken) (?:verbatim )?from (?:https?:|github|upstream)")
LOCK_NAME = re.compile(r"(?i)(?:^|[/.-])(?:package-lock|npm-shrinkwrap|pnpm-lock|yarn|composer|poetry|pipfile|cargo|gemfile|mix|podfile|flake|module|deps|go|bun|uv|pdm)?[.-]?lock(?:\.(?:json|ya?ml|toml|lockb?))?$|(?:^|/)go\.sum$|\.lock$|[.-]lock\.(?:json|ya?ml)$")
MADE_NAME = re.compile(r"(?i)(?:[._-](?:pb|pb2|pb2_grpc|pb\.gw|g|gen|generated|designer|freezed|grpc)\.[a-z]+|_pb2(?:_grpc)?\.py|\.g\.[a-z]+|zz_generated\.[\w.]+)$")
SMALL_NAME = re.compile(r"(?i)(?:[.-]min|[.-]bundle|[.-]packed|\.prod)\.(?:m?js|cjs|css|ts)$")
PLAIN_NAME = re.compile(r"(?i)(?:\.(?:md|rst|txt|env|ya?ml|toml|ini|cfg|conf|pem|key|crt|json|properties|xml|csv)|(?:^|/)\.[\w.]+|(?:^|/)(?:readme|licen[cs]e|makefile|dockerfile)[\w.]*)$")
WORDS = re.compile(r"\w+")
TEMPLATE = re.compile(r"[A-Za-z_]\w*|\d[\w.]*")
NUMBERED = re.compile(r"[A-Za-z_]{3,}(\d{1,4})\b")
IMPORTS = re.compile(r"\s*(?:import|from|export \*|require|use|using|#\s*include|package)\b")
# A line made of literals alone, with at most a key.
LITERAL_LINE = re.compile(r"\s*[\[({]*\s*(?:(?:\"[^\"\n]*\"|'[^'\n]*'|-?(?:0x[0-9a-fA-F]+|\d[\d.eE+_-]*)|true|false|null|None|True|False|[A-Za-z_]\w*(?=\s*:))\s*[,:;{}\[\])(]*\s*)+\r?")


def leading_comment(body: str) -> str:
    """All comments before a text's first line of code, block comments up to their end; blank lines count as part of it."""
    at = 0
    while m := HEAD.match(body, at):
        at = m.end()
    return body[:at]


def evidence(path: str | None, text: str | None) -> list[float]:
    """Log-likelihoods of the labels from a file alone; the handwritten one is the zero line."""
    path, text = path or "", text or ""
    phi = [0.0] + [BASE] * 4
    body = text.lstrip("﻿").strip()
    if not body:
        phi[0] = 50.0
        return phi
    if LOCK_NAME.search(path):
        phi[1] += LOCK
        return phi
    plain = bool(PLAIN_NAME.search(path))
    lines = body.split("\n")
    head = leading_comment(body)
    if head and MADE.search(head) and not BY_HAND.search(head) and not plain:
        phi[1] += HEADER
    if head and LICENCE.search(head) and not plain:
        phi[3] += BANNER
    if plain:
        phi[0] += 6.0
        return phi
    if len(lines) == 1 and len(body) < 120:
        phi[0] += PACKAGE_LINE
    if MADE_NAME.search(path):
        phi[1] += SUFFIX
    if SMALL_NAME.search(path):
        phi[2] += SUFFIX
    code = [line for line in lines if line.strip() and not COMMENT.match(line)]
    size = sum(map(len, code))
    if not code:
        return phi
    spaces = sum(line.count(" ") for line in code)
    literal = 0
    for line in code:
        # Most lines of code can be told by their ends.
        bare_line = line.strip()
        if bare_line[0] in "\"'[{(-0123456789}])" or bare_line[-1] == "," and "(" not in bare_line and "=" not in bare_line:
            if LITERAL_LINE.fullmatch(line):
                literal += len(line)
    share = literal / size
    if share > 0.5 and size > 200:
        phi[4] += DATA * min(1.0, (share - 0.5) / 0.25)
    else:
        longest = max(map(len, code))
        if not share > 0.5 and size > 400 and (longest > 150 or spaces < 0.06 * size):
            # One-line data: quoted or numeric literals take up nearly all of the text.
            bare = len(re.sub(r"\"[^\"\n]*\"|'[^'\n]*'|`[^`]*`|\b(?:0x[0-9a-fA-F]+|\d[\d.]*)\b|[\s,:\[\]{}()+-]", "", "".join(code)))
            if bare < 0.12 * size:
                phi[4] += DATA
        if size > 250 and size / len(code) > 160 and longest > 300 and spaces < 0.12 * size and phi[4] < 0:
            phi[2] += DENSE
        elif size > 250 and longest > 500 and spaces < 0.08 * size and phi[4] < 0:
            phi[2] += DENSE
    # Repetition: the same line shape again and again, with names that count up.
    code = [line for line in code if not IMPORTS.match(line)]
    if len(code) >= 6:
        numbers = [int(x) for x in NUMBERED.findall("\n".join(code))]
        seen, run = set(numbers), 0
        while run in seen:
            run += 1
        if run >= 5 and sum(1 for n in numbers if n < run) >= 0.5 * len(numbers):
            shapes = Counter(TEMPLATE.sub("w", line) for line in code)
            if sum(n for _, n in shapes.most_common(6)) >= 0.7 * len(code) and run >= 0.25 * len(code) / len(shapes):
                phi[1] += SEQUENCE
    return phi


_A = np.random.default_rng(11).integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_B = np.random.default_rng(12).integers(0, 1 << 62, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str, known: dict[str, int]) -> np.ndarray:
    """Hashes of the distinct runs of five words of a text, sorted."""
    words = WORDS.findall(text)
    if len(words) < SHINGLE:
        return np.zeros(0, np.uint64)
    if len(known) > 500_000:
        known.clear()
    for w in set(words).difference(known):
        known[w] = zlib.crc32(w.encode("utf-8", "replace")) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
    seq = np.array(list(map(known.__getitem__, words)), np.uint64)
    n = len(seq) - SHINGLE + 1
    with np.errstate(over="ignore"):
        grams = np.zeros(n, np.uint64)
        for k in range(SHINGLE):
            grams = grams * np.uint64(0x100000001B3) + seq[k : k + n]
        grams ^= grams >> np.uint64(29)
        return np.unique(grams * np.uint64(0xBF58476D1CE4E5B9))


def bands(grams: np.ndarray) -> list[int]:
    """A hash of each band of the MinHashes of a text's shingles."""
    with np.errstate(over="ignore"):
        least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(grams), 4096):
            values = grams[at : at + 4096, None] * _A + _B
            values ^= values >> np.uint64(31)
            least = np.minimum(least, values.min(0))
        rows = least.reshape(BANDS, ROWS)
        keys = np.zeros(BANDS, np.uint64)
        for r in range(ROWS):
            keys = (keys ^ rows[:, r]) * np.uint64(0x94D049BB133111EB)
            keys ^= keys >> np.uint64(28)
    return keys.view(np.int64).tolist()


def packed(grams: np.ndarray) -> bytes:
    """The shingles as 32-bit hashes, sorted: a chance of about one in four thousand million that two differ and look alike."""
    return np.unique((grams >> np.uint64(32)).astype("<u4")).tobytes()


def jaccard(a: bytes, b: bytes) -> float:
    """Similarity of two packed sets of shingles."""
    if a == b:
        return 1.0
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    if min(len(x), len(y)) < ALIKE * max(len(x), len(y)):
        return 0.0  # below the threshold whatever they share
    both = np.sort(np.concatenate([x, y]))
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)


def _features(files: DataFrame) -> DataFrame:
    def kernel(columns: list[list]):
        known: dict[str, int] = {}
        for i, repository, path, text in zip(*columns):
            phi = evidence(path, text)
            grams = shingles(text, known) if text and not PLAIN_NAME.search(path or "") and not LOCK_NAME.search(path or "") else ()
            yield i, repository, (path or "").rpartition("/")[0], phi, bands(grams) if len(grams) else None, packed(grams) if len(grams) else None

    source = files.select(F.col("id").cast("bigint").alias("file_id"), F.col("repository_id").cast("bigint").alias("repository_id"), "path", "content")
    return map_rows(spread(source), ["file_id", "repository_id", "path", "content"], kernel, "file_id bigint, repository_id bigint, dir string, phi array<double>, bands array<bigint>, grams binary", out_rows=1024)


def near_copies(features: DataFrame) -> DataFrame:
    """(file_id, copy_class, repositories): files of which at least two repositories hold near-copies, with their class.

    Rounds: in each bucket the smallest files that are still open are compared with all of its members. A class that
    two repositories hold settles its members; its first file is done in the bucket either way. What stays open goes
    on to a round of more representatives, until nothing is open, so a bucket of n files needs about log4(n) rounds.
    """
    own = features.filter("bands is not null").select("file_id", "repository_id", "bands", "grams")
    rows = own.select("file_id", "repository_id", F.posexplode("bands").alias("band", "key"))
    # Partial aggregation keeps hot buckets small; only buckets of several repositories go on.
    buckets = rows.groupBy("band", "key").agg(F.min("repository_id").alias("a"), F.max("repository_id").alias("b")).filter("a <> b").select("band", "key")
    members = cut(rows.join(buckets, ["band", "key"]).select("band", "key", "file_id").distinct())
    # Shingles travel only for files that share a bucket with another repository's, and once.
    sigs = cut(own.select("file_id", "repository_id", "grams").join(members.select("file_id").distinct(), "file_id").dropDuplicates(["file_id"]))

    def kernel(columns: list[list]):
        for i, repository, first, a, b in zip(*columns):
            if i == first or jaccard(a, b) >= ALIKE:
                yield i, repository, first

    pending, width, found = members, 1, None
    while found is None or not pending.isEmpty():
        if width == 1:
            first = pending.groupBy("band", "key").agg(F.min("file_id").alias("copy_class"))
        else:
            place = F.row_number().over(W.partitionBy("band", "key").orderBy("file_id"))
            first = pending.withColumn("place", place).filter(F.col("place") <= width).select("band", "key", F.col("file_id").alias("copy_class"))
        pairs = members.join(first, ["band", "key"]).select("file_id", "copy_class").distinct()
        both = pairs.join(sigs, "file_id").join(sigs.select(F.col("file_id").alias("copy_class"), F.col("grams").alias("first_grams")), "copy_class")
        alike = map_rows(both, ["file_id", "repository_id", "copy_class", "grams", "first_grams"], kernel, "file_id bigint, repository_id bigint, copy_class bigint")
        alike = cut(alike)
        held = alike.select("copy_class", "repository_id").distinct().groupBy("copy_class").agg(F.count("*").alias("repositories")).filter("repositories > 1")
        settled = cut(alike.join(held, "copy_class").groupBy("file_id").agg(F.max(F.struct("repositories", F.col("copy_class"))).alias("x")))
        found = settled if found is None else found.unionByName(settled)
        left = pending.join(first.withColumnRenamed("copy_class", "file_id"), ["band", "key", "file_id"], "left_anti")
        pending = cut(left.join(settled.select("file_id"), "file_id", "left_anti").select("band", "key", "file_id"))
        width *= 4
    return found.groupBy("file_id").agg(F.max("x").alias("x")).select("file_id", F.col("x.copy_class").alias("copy_class"), F.col("x.repositories").alias("repositories"))


LOG_COMPATIBLE = np.log(COMPATIBLE)


def _lse(x: np.ndarray) -> np.ndarray:
    top = x.max(-1, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(-1, keepdims=True)))[..., 0]


def _scaled(x: np.ndarray) -> np.ndarray:
    """Messages with their largest value at 0, so that sums over many children stay finite."""
    return x - x.max(-1, keepdims=True)


def up(phi: np.ndarray) -> np.ndarray:
    """Messages to the parents from the children's log-beliefs, one a row."""
    return _scaled(_lse(phi[:, None, :] + LOG_COMPATIBLE[None]))


def down(over: np.ndarray) -> np.ndarray:
    """Messages to the children from their parents' log-beliefs, each without the child's own message."""
    return _scaled(_lse(over[:, None, :] + LOG_COMPATIBLE.T[None]))


def _with_up(df: DataFrame, keep: list[str], leaves: bool = False) -> DataFrame:
    """``df`` with the message that each row's ``phi`` sends to its parent, as ``up``."""
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)

    def kernel(columns: list[list]):
        if columns[-1]:
            phi = np.array(columns[-1])
            sent = up(phi)
            # What is handwritten for being empty, a setting or a text says nothing about its folder.
            if leaves:
                sent[phi[:, 0] > 5] = 0.0
            yield from zip(*columns, sent.tolist())

    return map_rows(df, [*keep, "phi"], kernel, f"{kinds}, phi array<double>, up array<double>")


def _sum(name: str) -> Column:
    return F.array(*(F.sum(F.col(name)[k]) for k in range(5)))


def _folder_evidence() -> Column:
    """Log-evidence of a folder's name. A folder outside of all named ones is somebody's own until much speaks against it."""
    parts = F.split(F.lower("dir"), "/")
    last = F.element_at(parts, -1)
    every = [name for names in FOLDERS.values() for name in names]
    own = F.when(F.exists(parts, lambda p: p.isin(*every)), 0.0).otherwise(HOME)
    return F.array(own, *(F.when(last.isin(*FOLDERS[label]), FOLDER_WEIGHT[label]).otherwise(0.0) for label in LABELS[1:]))


def labelled_files(files: DataFrame) -> DataFrame:
    """(file_id, repository_id, label, confidence) of each file."""
    features = cut(_features(files))
    copies = near_copies(features).select("file_id", "repositories")
    leaf = features.withColumn("size", F.octet_length("grams") / 4).drop("bands", "grams").dropDuplicates(["file_id"]).join(copies, "file_id", "left")
    added = F.when((F.col("repositories") > 1) & (F.col("phi")[0] < 20), COPIED * F.least(F.lit(1.0), F.col("size") / FULL_COPY)).otherwise(0.0)
    leaf = leaf.withColumn("phi", F.array(*(F.col("phi")[k] + (added if k == 3 else F.lit(0.0)) for k in range(5))))
    leaf = cut(_with_up(leaf.withColumn("depth", F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))), ["file_id", "repository_id", "dir", "depth"], leaves=True))

    # Directories with what their files say; ancestors without files of their own are added.
    own = leaf.groupBy("repository_id", "dir", "depth").agg(_sum("up").alias("below"))
    chain = own.select("repository_id", F.explode(F.transform(F.sequence(F.lit(0), F.col("depth")), lambda n: F.struct(n.alias("depth"), F.when(n == 0, "").otherwise(F.array_join(F.slice(F.split("dir", "/"), 1, F.greatest(n, F.lit(1))), "/")).alias("dir")))).alias("x"))
    folders = chain.select("repository_id", "x.dir", "x.depth").distinct().join(own.select("repository_id", "dir", "below"), ["repository_id", "dir"], "left")
    zero = F.array(*(F.lit(0.0) for _ in range(5)))
    folders = cut(folders.select("repository_id", "dir", "depth", F.zip_with(F.coalesce("below", zero), _folder_evidence(), lambda a, b: a + b).alias("phi"), F.when(F.col("depth") <= 1, "").otherwise(F.array_join(F.slice(F.split("dir", "/"), 1, F.greatest(F.col("depth") - 1, F.lit(1))), "/")).alias("parent")))
    deepest = folders.agg(F.max("depth")).first()[0] or 0

    # Up, one level at a time. A level is written once: the way down reads it again.
    levels: dict[int, DataFrame] = {}
    above: DataFrame | None = None
    for depth in range(deepest, -1, -1):
        level = folders.filter(F.col("depth") == depth)
        if above is not None:
            level = level.join(above, ["repository_id", "dir"], "left").withColumn("phi", F.zip_with("phi", F.coalesce("sent", zero), lambda a, b: a + b)).drop("sent")
        levels[depth] = level = cut(_with_up(level, ["repository_id", "dir", "parent"]))
        above = level.groupBy("repository_id", F.col("parent").alias("dir")).agg(_sum("up").alias("sent"))

    def settle(columns: list[list]):
        *keys, phis, ups, overs = columns
        if phis:
            sent = down(np.array(overs) - np.array(ups))
            yield from zip(*keys, (np.array(phis) + sent).tolist())

    # Down: what a folder believes without the child, through the compatibility.
    belief = levels[0].select("repository_id", "dir", F.col("phi").alias("belief"))
    all_beliefs = [belief]
    for depth in range(1, deepest + 1):
        parents = belief.select("repository_id", F.col("dir").alias("parent"), F.col("belief").alias("over"))
        belief = map_rows(levels[depth].join(parents, ["repository_id", "parent"]), ["repository_id", "dir", "phi", "up", "over"], settle, "repository_id bigint, dir string, belief array<double>")
        belief = cut(belief)
        all_beliefs.append(belief)
    beliefs = all_beliefs[0]
    for b in all_beliefs[1:]:
        beliefs = beliefs.unionByName(b)

    def label(columns: list[list]):
        *keys, phis, ups, overs = columns
        if not phis:
            return
        total = np.array(phis) + down(np.array(overs) - np.array(ups))
        best = total.argmax(1)
        sure = np.exp(total.max(1) - _lse(total))
        yield from zip(*keys, (LABELS[k] for k in best.tolist()), sure.round(6).tolist())

    # Every file's folder is in the tree, but keys that are null join nothing: they keep what the file says.
    # The files of a folder are dealt out: one folder may hold a third of all.
    beliefs = beliefs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    leaf = leaf.withColumn("salt", F.pmod(F.xxhash64("file_id"), F.lit(SALTS)).cast("int"))
    final = leaf.join(beliefs, (leaf.repository_id.eqNullSafe(beliefs.repository_id)) & (leaf.dir == beliefs.dir) & (leaf.salt == beliefs.salt), "left").select(leaf.file_id, leaf.repository_id, leaf.phi, leaf.up, F.coalesce("belief", "up").alias("over"))
    return map_rows(final, ["file_id", "repository_id", "phi", "up", "over"], label, "file_id bigint, repository_id bigint, label string, confidence double")


def not_handwritten(files: DataFrame) -> DataFrame:
    """(file_id) of the generated, minified, vendored and data files."""
    return labelled_files(files).filter("label <> 'handwritten'").select("file_id").distinct()
