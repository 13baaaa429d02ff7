"""The most alike of two sets of titled texts, exactly: a bound from letter counts orders the pairs, and only what may still be among the best is compared.

Likeness is 0.7 of the titles' and 0.3 of the artists' ratio, a ratio being
twice the longest common subsequence by both lengths, over texts whose words
are sorted. A common subsequence is never longer than the letters that both
texts hold, each as often as the rarer of its counts. This bound is the sum of
minima over 32 counts a text, for whole blocks of texts at once, and it leaves
room for long and short texts, repeated letters and any threshold: shared
n-grams would not do, as texts that are just alike enough need not share any.

Blocks of both sides meet in one task each. A task takes a text's partners in
the order of their bounds, compares some of them, and goes on until the bound
of the rest is below the worst of the best that it has, or below the least
likeness. Spark keeps the best of all blocks. No pair that may come out is left
out, and none is capped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block on either side, pairs that are compared at once, and counts a text.
ASKED, HELD, AT_ONCE, BINS = 2_000, 20_000, 128, 32
TITLE, ARTIST = 0.7, 0.3


def common_subsequence(a: str, b: str) -> int:
    """The length of the longest common subsequence: one step a character of `b`, in which all of `a` are bits of one number."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for y in b:
        hit = row & at.get(y, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def common_subsequences(a: str, others: np.ndarray) -> np.ndarray:
    """The same for many at once: `others` are rows of code points, 0 beyond their ends. Texts of over 64 characters go one by one."""
    if len(a) > 64:
        return np.array([common_subsequence(a, "".join(map(chr, row[row > 0]))) for row in others], np.int64)
    letters, codes = sorted(set(a)), np.zeros(1, np.int64)
    if letters:
        codes = np.array([ord(x) for x in letters])
    masks = np.array([sum(1 << i for i, x in enumerate(a) if x == y) for y in letters] + [0], np.uint64)
    place = np.minimum(np.searchsorted(codes, others), len(codes) - 1)
    known = (codes[place] == others) & (others > 0)
    hits = masks[np.where(known, place, len(masks) - 1)]
    row = np.full(len(others), 2 ** len(a) - 1, np.uint64)
    for j in range(others.shape[1]):
        hit = row & hits[:, j]
        # bits beyond the text's length stay as they may: they are cut off at the end
        row = (row + hit) | (row - hit)
    return len(a) - np.bitwise_count(row & np.uint64(2 ** len(a) - 1)).astype(np.int64)


class _Texts:
    """Distinct texts with sorted words, their lengths, letter counts and code points."""

    def __init__(self, texts: pd.Series):
        coded, uniques = pd.factorize(texts.map(lambda t: " ".join(sorted(t.split()))))
        self.of, self.texts = coded, list(uniques)
        self.lengths = np.array([len(t) for t in self.texts], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.points = np.frombuffer("".join(self.texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        counts = np.zeros((len(self.texts), BINS), np.int64)
        np.add.at(counts, (np.repeat(np.arange(len(self.texts)), self.lengths), self.points % BINS), 1)
        # a count that 255 stands in for has no bound
        self.counts, self.wide = np.minimum(counts, 255).astype(np.uint8), (counts > 255).any(axis=1)

    def bound(self, of: _Texts, i: int) -> np.ndarray:
        """For each text here what its ratio to text `i` of `of` is at most."""
        common = np.minimum(self.counts, of.counts[i]).sum(axis=1, dtype=np.int64)
        if of.wide[i] or self.wide.any():
            common = np.where(self.wide | of.wide[i], np.minimum(self.lengths, of.lengths[i]), common)
        return _ratio(common, self.lengths + of.lengths[i])

    def exact(self, of: _Texts, i: int, rows: np.ndarray) -> np.ndarray:
        lengths = self.lengths[rows]
        place = np.arange(max(1, lengths.max(initial=1)))
        inside = place < lengths[:, None]
        points = np.where(inside, self.points[np.where(inside, self.starts[rows][:, None] + place, 0)], 0) if len(self.points) else np.zeros(inside.shape, np.int64)
        common = common_subsequences(of.texts[i], points)
        return _ratio(common, self.lengths[rows] + of.lengths[i])


def _ratio(common: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.where(lengths > 0, 200.0 * common / np.maximum(lengths, 1), 100.0)


def _best(least: float, k: int):
    """For each asked text of a block the k best of the other block, by score and then `first`."""

    def run(key: tuple, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(held):
            titles, artists = (_Texts(held[c]) for c in ("t", "a"))
            own_t, own_a = (_Texts(asked[c]) for c in ("t", "a"))
            first, ids = held["first"].to_numpy(), held["of"].to_numpy()
            for n, text in enumerate(asked["text"]):
                i, j = own_t.of[n], own_a.of[n]
                bound = TITLE * titles.bound(own_t, i)[titles.of] + ARTIST * artists.bound(own_a, j)[artists.of]
                left = np.flatnonzero(bound >= least - 1e-6)
                left = left[np.argsort(-bound[left], kind="stable")]
                rows, scores, beat = np.zeros(0, np.int64), np.zeros(0), least
                for at in range(0, len(left), AT_ONCE):
                    some = left[at : at + AT_ONCE]
                    if bound[some[0]] < beat - 1e-6:
                        break
                    score = TITLE * titles.exact(own_t, i, titles.of[some]) + ARTIST * artists.exact(own_a, j, artists.of[some])
                    rows, scores = np.concatenate([rows, some]), np.concatenate([scores, np.round(score, 6)])
                    order = np.lexsort((first[rows], -scores))[:k]
                    order = order[scores[order] >= least]
                    rows, scores = rows[order], scores[order]
                    beat = scores[-1] if len(rows) == k else least
                out += [(text, ids[r], s) for r, s in zip(rows, scores, strict=True)]
        return pd.DataFrame(out, columns=["text", "of", "score"])

    return run


def most_alike(asked: DataFrame, held: DataFrame, least: float, k: int) -> DataFrame:
    """text, of and score: for each of `asked` (text, t, a) the k most alike of `held` (of, t, a, first), those of `least` or more; of equally alike ones those of smaller `first`.

    Both sides are dealt into blocks by hash, each pair of blocks is one group:
    a row travels once for each block of the other side.
    """
    n_asked, n_held = (max(1, -(-df.count() // size)) for df, size in ((asked, ASKED), (held, HELD)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    one = asked.select("text", "t", "a", block("text", n_asked).alias("x"), every(n_held).alias("y"))
    two = held.select("of", "t", "a", "first", block("of", n_held).alias("y"), every(n_asked).alias("x"))
    found = one.groupBy("x", "y").cogroup(two.groupBy("x", "y")).applyInPandas(_best(least, k), "text string, of string, score double")
    order = Window.partitionBy("text").orderBy(F.desc("score"), "first")
    ranked = found.join(held.select("of", "first"), "of").withColumn("nth", F.row_number().over(order))
    return ranked.where(F.col("nth") <= k).select("text", "of", "score")
