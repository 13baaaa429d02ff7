"""Word shingles as 64-bit numbers, a whole Arrow batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Odd multipliers, one for each place in a shingle: from a rule, so that any width has its own.
PLACES = [int.from_bytes(xxhash.xxh3_128_digest(f"place {i}")[:8], "little") | 1 for i in range(64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit (the finaliser of MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, lower-cased in ASCII and parted at ASCII white space, and each text's number of words."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    flat, ends = lists.flatten(), np.asarray(lists.offsets)
    coded = flat.dictionary_encode()
    vocabulary = coded.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocabulary), np.uint64, len(vocabulary))
    codes = np.asarray(coded.indices)
    real = np.fromiter((w != "" for w in vocabulary), bool, len(vocabulary))[codes] if len(codes) else np.zeros(0, bool)
    before = np.concatenate([[0], np.cumsum(real)])
    ends = before[ends - ends[0]]
    return hashes[codes[real]] if len(codes) else np.zeros(0, np.uint64), np.diff(ends)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's set of hashed shingles, sorted, all in one array, and each set's size.

    A text of fewer words than the width has its whole sequence as its one
    shingle; a text without words has none.
    """
    h, counts = word_hashes(texts)
    starts = np.concatenate([[0], np.cumsum(counts)])[:-1]
    many = np.where(counts >= width, counts - width + 1, 0)
    sizes = np.where(counts >= width, many, np.minimum(counts, 1))
    ends = np.cumsum(sizes)
    # places where a shingle starts: the first `many` words of each text
    first = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(starts, many)
    long = np.zeros(len(first), np.uint64)
    for j in range(width):
        long += h[first + j] * np.uint64(PLACES[j])
    few = np.flatnonzero((counts > 0) & (counts < width))
    short = np.zeros(len(few), np.uint64)
    for j in range(width - 1):
        has = counts[few] > j
        short[has] += h[starts[few][has] + j] * np.uint64(PLACES[j])
    short += counts[few].astype(np.uint64) * np.uint64(PLACES[-1])
    value = np.zeros(sizes.sum(), np.uint64)
    value[np.repeat(many > 0, sizes)] = mix(long)
    value[ends[few] - 1] = mix(short)
    # each text's values are sorted in their place: one sort by text and value takes several times as long
    for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
        value[a:b].sort()
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    new[(ends - sizes)[sizes > 0]] = True
    doc = np.repeat(np.arange(len(counts)), sizes)
    return value[new], np.bincount(doc[new], minlength=len(counts))
