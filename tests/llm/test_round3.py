"""Vector codes, SimHash and divergence of sources against brute force, with nulls, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tagloom.llm import divergence, simhash, vector_codes

LOW = {i: i + 32 for i in range(65, 91)}
SPACED = re.compile("[^\x20\x09-\x0d]+")
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
#: Columns that clash with names inside the operators.
DOCS = "doc_id long, text string, lang string, source string, fp long, n long, p long, term string"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, 1, 1, 1, "t") for r in rows], DOCS)


# op11


def coded(rows):
    """The contract, a vector at a time: (vec_id, embedding, label) to (vec_id, code, error, label_error, digest)."""
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    m = len(kept[0][1]) // 8
    parts = [[v[p * m : p * m + m] for p in range(8)] for _, v, _ in kept]
    first = sorted({i for i, _, _ in kept if i is not None})[:16]
    seeds = [min(v for i, v, _ in kept if i == f) for f in first]
    books = [[s[p * m : p * m + m] for s in seeds] for p in range(8)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(6):
        new = []
        for p in range(8):
            at = defaultdict(list)
            for x in parts:
                at[near(x[p], books[p])[1]].append(x[p])
            new.append([[sum(c) // len(at[e]) for c in zip(*at[e], strict=True)] if e in at else books[p][e] for e in range(len(books[p]))])
        books = new
    found = [[near(x[p], books[p]) for p in range(8)] for x in parts]
    error = [sum(d for d, _ in f) for f in found]
    by = Counter()
    for (_, _, label), e in zip(kept, error, strict=True):
        by[label] += e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((str(i), "".join(f"{e:02x}" for _, e in f), r, by[label], digest) for (i, _, label), f, r in zip(kept, found, error, strict=True))


def codes_of(spark, rows):
    schema = "vec_id long, embedding array<double>, label int, v int, part int, total long"
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], schema)
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.compress(df).collect())


def vectors_of(n, dims, seed):
    rng = random.Random(seed)
    return [(i, [rng.choice([rng.gauss(0, 1), 0.25, -0.5]) for _ in range(dims)], rng.choice([None, 1, 2])) for i in range(n)]


def test_vector_codes(spark):
    rows = vectors_of(60, 24, 1)
    rows += [(i + 100, [0.5] * 24, 1) for i in range(30)]  # a common vector, and ties between equal entries
    rows += [(200, None, 1), (201, [None] + [0.0] * 23, 1), (202, [float("nan")] * 24, 1), (203, [float("inf")] * 24, 1), (None, [0.1] * 24, None), (3, rows[3][1], 2)]
    rows[1] = (1, rows[0][1], 1)
    assert codes_of(spark, rows) == coded(rows)
    # of other lengths, of a length that has no eight parts, and too large: left out
    more = [(300, [0.5] * 16, 1), (301, [0.5] * 25, 1), (302, [], 1), (303, [1e30] * 24, 1)]
    assert codes_of(spark, rows + more) == coded(rows)
    assert codes_of(spark, [r for r in more if r[0] in (301, 302)]) == codes_of(spark, rows[:0]) == []


def test_vector_codes_of_few_large_and_long_vectors(spark):
    few = vectors_of(5, 8, 2)
    assert codes_of(spark, few) == coded(few)
    large = [(i, [x * 20_000 for x in v], k) for i, v, k in vectors_of(40, 16, 3)]
    assert codes_of(spark, large) == coded(large)
    long = vectors_of(25, 512, 4)
    assert codes_of(spark, long) == coded(long)
    with pytest.raises(ValueError, match="vec_id"):
        codes_of(spark, [(None, [0.5] * 8, 1)])


def test_bounds_leave_the_nearest_entry_in():
    rng = np.random.default_rng(5)
    for width in (1, 2, 3, 7, 8, 30):
        for scale in (1, 1000, 2**29 // 8):
            x, c = rng.integers(-scale, scale, (200, width)), rng.integers(-scale, scale, (16, width))
            c[7] = c[3]
            x[:20] = c[rng.integers(0, 16, 20)]
            best, distance = vector_codes.nearest(x, c)
            each = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
            assert (best == each.argmin(axis=1)).all() and (distance == each.min(axis=1)).all()


# op12


def fingerprint(text):
    w = SPACED.findall((text or "").translate(LOW))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(ids, prints):
    """The smallest id that is reachable from each, by comparing all."""
    up = list(range(len(ids)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                up[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


def test_simhash(spark):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(400)] + ["É", "日本"]
    texts = [None, "", " \n\x0b ", "one", "One", "a b", "A\x0cB", "a b c", "x " * 3000, "é\x85b c d", "z" * 20000]
    for n in (30, 200, 500):
        base = [rng.choice(vocab) for _ in range(n)]
        texts.append(" ".join(base))
        for _ in range(12):
            other = list(base)
            other[rng.randrange(n)] = rng.choice(vocab)
            texts += [" ".join(other), "  ".join(other).upper() + "\t"]
    ids = list(range(5, 5 + len(texts)))
    ids[3] = None
    rows = [(i, t, None, None) for i, t in zip(ids, texts, strict=True)] + [(9, texts[4], None, None)]
    ids, texts = [r[0] for r in rows], [r[1] for r in rows]
    got = simhash.near_components(docs_of(spark, rows)).collect()
    prints = [fingerprint(t) for t in texts]
    want = [(str(i), f"{f:016x}", c) for i, f, c in zip(ids, prints, linked(ids, prints), strict=True)]
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == sorted(want)
    assert simhash.near_components(docs_of(spark, [])).collect() == []
    named = spark.createDataFrame([("b", "same text here"), ("a", "same text here")], "doc_id string, text string")
    assert {(r.doc_id, r.component_id) for r in simhash.near_components(named).collect()} == {("a", "a"), ("b", "a")}


def test_star_links_connect_all_that_is_near(spark):
    rng = random.Random(7)
    prints = {rng.getrandbits(64) for _ in range(300)} | {0, 1, 3, 7, 2**64 - 1, 2**63}
    for p in rng.sample(sorted(prints), 60):
        for _ in range(4):
            for b in rng.sample(range(64), rng.randint(1, 4)):
                p ^= 1 << b
            prints.add(p)
    prints = sorted(prints)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    links = [(r.a % 2**64, r.b % 2**64) for r in simhash.star_links(df).collect()]
    assert all(0 < (a ^ b).bit_count() <= 3 for a, b in links)
    up = {p: p for p in prints}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[max(find(a), find(b))] = min(find(a), find(b))
    want = linked(prints, prints)
    assert [find(p) for p in prints] == want and len(set(want)) < len(prints)


def test_fingerprints_do_not_depend_on_how_many_shingles_are_held(monkeypatch):
    texts = pa.array(["a b c d e f g", None, "x", "a b c d e f g h i j k l m n o p"])
    want = simhash.fingerprints(texts, 3).tolist()
    monkeypatch.setattr(simhash, "AT_ONCE", 3)
    assert simhash.fingerprints(texts, 3).tolist() == want == [fingerprint(t) for t in texts.to_pylist()]
    assert simhash.fingerprints(texts.slice(2), 3).tolist() == want[2:]


# op13


def audited(rows, min_docs, top):
    groups, df, n = {}, Counter(), Counter()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.setdefault(lang, set()).add(source)
        words = TERM.findall((text or "").translate(LOW))
        df.update((lang, w) for w in set(words))
        n.update((lang, source, w) for w in words)
    out = []
    for lang, sources in groups.items():
        kept = sorted(w for (x, w), k in df.items() if x == lang and k >= min_docs)

        def shares(count):
            total = sum(count(w) for w in kept)
            return {w: 1 + 10**9 * (count(w) + 2) // (total + 2 * len(kept)) for w in kept}

        p = {s: shares(lambda w, s=s: n[lang, s, w]) for s in sources}
        q = shares(lambda w: sum(n[lang, s, w] for s in sources))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(f(p[s][w], p[t][w]) for w in kept), t.encode(), t) for t in sources if t != s)
            terms = sorted((-f(p[s][w], q[w]), w.encode(), w) for w in kept if n[lang, s, w] and p[s][w] > q[w])[:top]
            out += [(lang, s, part, item, -v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, _, item) in enumerate(found)]
    return sorted(out)


def audit(spark, rows, min_docs, top):
    return sorted(tuple(r) for r in divergence.divergence(docs_of(spark, rows), min_docs, top).select("lang", "source", "part", "item", "value", "rank").collect())


def test_divergence(spark, monkeypatch):
    # so few that tasks hand on what they have added up before their end
    monkeypatch.setattr(divergence, "GATHERED", 50)
    rng = random.Random(8)
    words = ["the", "The", "été", "Été", "日本", "x1y", "a_b", "it's", *(f"w{chr(97 + i)}" for i in range(20))]
    rows = []
    for i in range(200):
        lang, source = rng.choice(["en", "en", "de", None, ""]), rng.choice([None, "s1", "s2", "s2", "s2", "Z", "é"])
        text = rng.choice([" ", "\x0b", "1"]).join(rng.choice(words[: 8 + 4 * len(source or "")]) for _ in range(rng.randint(0, 12)))
        rows.append((i, text, lang, source))
    rows += [(1, None, "en", "silent"), (1, "", "fr", "alone"), (1, "rare", "it", "a"), (1, "rare", "it", "b"), (2, "rare", "it", "c"), (None, "long " * 30000, "en", "s1")]
    rows += rows[:10]
    assert audit(spark, rows, 10, 3) == audited(rows, 10, 3)
    assert audit(spark, rows, 1, 10) == audited(rows, 1, 10)
    assert audit(spark, [], 10, 10) == []
