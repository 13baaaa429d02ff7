"""Sets of shingles: as sorting by text and value gives them, and no slower for it."""

import random
import time

import numpy as np
import pyarrow as pa

from tagloom.llm.shingles import PLACES, mix, shingle_sets, word_hashes


def plain(texts, width):
    h, counts = word_hashes(texts)
    value, sizes, at = [], [], 0
    for n in counts.tolist():
        own = h[at : at + n]
        at += n
        if n >= width:
            got = {int(mix(sum((own[i + j : i + j + 1] * np.uint64(PLACES[j]) for j in range(width)), np.zeros(1, np.uint64)))[0]) for i in range(n - width + 1)}
        elif n:
            last = np.array([n], np.uint64) * np.uint64(PLACES[-1])
            got = {int(mix(sum((own[j : j + 1] * np.uint64(PLACES[j]) for j in range(n)), last))[0])}
        else:
            got = set()
        value += sorted(got)
        sizes.append(len(got))
    return value, sizes


def test_sets_equal_the_plain_form():
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abc") for _ in range(n)) for n in (0, 1, 2, 3, 4, 5, 6, 40, 0, 7, 4, 300, 0)] + [None, "a b c d e", "a b c d e", ""]
    for part in (texts, texts[:1], texts[1:3], texts[-1:], texts[::-1]):
        value, sizes = shingle_sets(pa.array(part, pa.string()), 5)
        want, n = plain(pa.array(part, pa.string()), 5)
        assert value.tolist() == want and sizes.tolist() == n


def test_sorting_takes_a_small_share():
    rng = np.random.default_rng(1)
    texts = pa.array([" ".join(map(str, rng.integers(0, 5000, 300))) for _ in range(1500)])
    words, sets = [], []
    for _ in range(5):
        t = time.process_time()
        _, counts = word_hashes(texts)
        words.append(time.process_time() - t)
        t = time.process_time()
        shingle_sets(texts, 5)
        sets.append(time.process_time() - t - words[-1])
        # what was done before: one sort by text and value
        t = time.process_time()
        doc = np.repeat(np.arange(len(counts)), counts)
        np.lexsort((rng.integers(0, 1 << 63, len(doc)), doc))
        words[-1] = time.process_time() - t
    assert min(sets) < min(words)
