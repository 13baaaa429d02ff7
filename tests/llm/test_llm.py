"""Operators against brute force on small tables, with nulls, ties, repeats and clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tagloom.llm import bpe, decontaminate, licenses, line_dedup, ngram_join, quality, reply_trees, toxicity, url_filters
from tagloom.llm.queries import tokenizer

LOW = {i: i + 32 for i in range(65, 91)}
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SPACED = re.compile("[^\x20\x09-\x0d]+")
#: Columns that clash with names inside the operators.
DOCS = "doc_id long, text string, lang string, source string, n long, w string, key string, part int"


def docs_of(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, f"s{(i or 0) % 3}" if i != 4 else None, 1, "w", "k", 1) for i, t in zip(ids, texts, strict=True)], DOCS)


def make_texts():
    rng = random.Random(5)
    vocab = [f"word{i}" for i in range(300)] + ["É", "the", "of"]
    base = [" ".join(rng.choice(vocab) for _ in range(n)) for n in (8, 30, 60, 120, 300)]
    out = [None, "", "  \n ", "one", "One", "a b c d", "a b  c\td", "x " * 4000, "z" * 30000]
    for b in base:
        out += [b, b, b.upper()]
        for edits in (1, 2, 4, 8):
            w = b.split()
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            out.append(" ".join(w))
    shared = " ".join(rng.choice(vocab) for _ in range(55))
    out += [" ".join(rng.choice(vocab) for _ in range(20)) + " " + shared + f"\nline number {i}" for i in range(15)]
    return out


TEXTS = make_texts()


def test_ngram_join(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs_of(spark, TEXTS)).collect()}
    sets = []
    for t in TEXTS:
        w = SPACED.findall((t or "").translate(LOW))
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    assert got == {i: (len(s), find(i)) for i, s in enumerate(sets)}


def test_ngram_join_of_none_and_repeats(spark):
    d = docs_of(spark, ["a b c d e f", "a b c d e f", None], [1, 1, None])
    assert sorted(tuple(r) for r in ngram_join.jaccard_components(d).collect()) == [(1, 2, 1), (1, 2, 1)]
    assert ngram_join.jaccard_components(d.limit(0)).collect() == []


def test_signatures_are_shared_by_all_similar_sets():
    import numpy as np

    rng = np.random.default_rng(0)
    for n in [1, 2, 3, 4, 5, 7, 8, 12, 20, 33, 50, 111, 240]:
        for _ in range(20):
            m = rng.integers(int(np.ceil(0.75 * n)), n + 1)
            low = -(-3 * (n + m) // 7)
            common = rng.integers(min(low, m), m + 1)
            pool = np.unique(rng.integers(0, 2**63, 3 * n + 10).astype(np.uint64))
            rng.shuffle(pool)
            a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:common], pool[n : n + m - common]]))
            if 100 * common < 75 * (n + m - common):
                continue
            doc, _, sig = ngram_join.signatures(np.concatenate([a, b]), np.array([len(a), len(b)]))
            assert set(sig[doc == 0]) & set(sig[doc == 1])


def test_decontaminate(spark):
    items = [(0, " ".join(TEXTS[12].split()[2:20])), (1, "one"), (2, None), (3, "!!"), (4, " ".join((TEXTS[-1]).split()[25:60])), (None, "the of")]
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs_of(spark, TEXTS), spark.createDataFrame(items, "item_id long, text string")).collect()}
    windows = defaultdict(set)
    for i, t in items:
        w = WORD.findall((t or "").translate(LOW))
        if w and i is not None:
            for j in range(max(1, len(w) - 9)):
                windows[tuple(w[j : j + 10])].add(str(i))
    for i, t in enumerate(TEXTS):
        w = WORD.findall((t or "").translate(LOW))
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if (k := tuple(w[j : j + n])) in windows:
                    hit |= set(range(j, j + n))
                    found |= windows[k]
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(found), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontaminate.decontaminate(docs_of(spark, TEXTS), none).collect())
    assert {r.doc_id for r in decontaminate.clean_only(docs_of(spark, TEXTS), none).collect()} == set(range(len(TEXTS)))


def test_licenses(spark):
    texts = [None, "", "All rights reserved. all RIGHTS reserved", "CC-BY 4.0", "the GNU General Public License", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "cc\u212aby cc by", "x " * 5000]
    got = {r.doc_id: r for r in licenses.scan(docs_of(spark, texts + ["plain text"] * 60)).collect()}
    assert [got[i].n_base for i in range(len(texts))] == [0, 0, 2, 1, 1, 0, 0, 1, 0]
    assert (got[2].first_word, got[2].last_word) == (0, 3)
    assert got[2].labels == got[2].base_labels == "reserved"
    assert got[5].labels == "mit" and got[6].labels == "apache-2.0" and got[0].labels == ""
    assert all(0 <= r.score <= 1 for r in got.values())
    assert licenses.scan(docs_of(spark, texts).limit(0)).collect() == []


def test_quality(spark):
    got = {r.doc_id: r for r in quality.quality(docs_of(spark, TEXTS)).collect()}
    for i, t in enumerate(TEXTS):
        t = t or ""
        w = SPACED.findall(t)
        tri = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        c, rep = Counter(tri), set()
        for j, q in enumerate(tri):
            if c[q] > 1:
                rep |= {j, j + 1, j + 2}
        lines = [x for x in t.split("\n") if SPACED.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(rep))
        assert r.base_failed == (len(w) < 50 or 100 * len(rep) > 50 * len(w))
        assert not (r.kept and r.base_failed)


def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.Example.NET/en/x?q#f", "http://example.net/en", "http://net/", "http://xnet/", "https://b.example.com/de/", "x://org/fr/a", "http://net?x/", "http://example.net.evil.org/fr/", "a://b://net/", "http://...net/en/"]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)] * 2, "page_id long, url string, host string, path string")
    got = url_filters.judge(pages, url_filters.rules_table(spark)).collect()
    assert len(got) == 2 * len(urls)
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert by[0] == by[1] == by[2] == ("", "", None, "allow")
    assert by[3] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert by[4] == ("example.net", "/en", "net/", "block")
    assert by[5][2:] == ("net/", "block") and by[6][2:] == (None, "allow")
    assert by[7][2:] == ("example.com/de/", "block") and by[8][2:] == ("org/fr/", "allow")
    assert by[9] == ("net", "", None, "allow") and by[10][2:] == ("org/fr/", "allow")


def test_nested_rules_pop(spark):
    rules = spark.createDataFrame([("h", "/", "block"), ("h", "/a/", "allow"), ("h", "/a/b/", "block"), ("h", "/a/b/", "allow")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "x://h/a/b/c"), (2, "x://h/a/c"), (3, "x://h/b"), (4, "x://h/a/b0")], "page_id long, url string")
    assert {r.page_id: (r.rule, r.verdict) for r in url_filters.judge(pages, rules).collect()} == {1: ("h/a/b/", "block"), 2: ("h/a/", "allow"), 3: ("h/", "block"), 4: ("h/a/", "allow")}


def test_chat_formatting(spark):
    said = ["</s>[INST] ok [/INST]", "<\\s>[\\\\/INST]", "<s", "[/INST]</s><s>[INST]user\n", None, "", "\\", "<<s>[[INST]]"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(said)] + [(2, 0, "a\nb%[INST]", "x"), (2, 0, None, "x"), (2, 0, None, "x"), (None, 1, "assistant", "y")]
    got = {r.conv_id: r for r in reply_trees.conversation_digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for conv in (1, 2, None):
        turns = sorted((t, r or "", x or "") for c, t, r, x in rows if c == conv)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_best_branch(spark):
    rows = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "bad", 0.1), ("t", 3, 1, "assistant", "good", 0.9), ("t", 4, 3, "user", "more", 0.9), ("t", 5, 99, "user", "stray", 0.2)]
    out = reply_trees.format_trees(spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")).collect()
    assert [s.text for s in out[0].segments if s.text in ("q", "bad", "good", "more", "stray")] == ["q", "good", "more"]
    assert [s.text for s in out[0].segments if s.loss] == ["good"]


def test_lines(spark):
    long = "The quick brown fox jumps over the lazy dog near the river bank today and sleeps in the sun until evening" + " while many other animals of the wood look on and wonder how long it will stay there before the rain comes down again" * 2
    near = long.replace("today", "tonight")
    texts = [long + "\nshort", "own line that nobody else has written\n" + long, near, None, "", "short", long + "\n" + long, "日本語のとても長い文章がここにありますので確かめてください一二三四五"]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(docs_of(spark, texts)).collect()}
    assert out[0].text == long + "\nshort"
    assert out[1].text == "own line that nobody else has written"
    assert out[2].text == "" and out[6].text == ""
    # equal lines of any length are one line
    assert out[3].text is None and out[4].text == "" and out[5].text == "" and out[7].text == texts[7]
    assert out[0].w == "w"


def test_lines_of_edge_cases(spark):
    kind = "doc_id long, text string, _drop long, drop long, of string, k long, c long, line string"
    rows = [(1, "a\n\n  \na\n\nb", 1, 2, "x", 3, 4, "l"), (2, "b\nc\n", 1, 2, "x", 3, 4, "l"), (2, "b\nc\n", 1, 2, "x", 3, 4, "l"), (None, "a\nb", 1, 2, "x", 3, 4, "l"), (3, None, None, None, None, None, None, None), (4, "z" * 50000 + "\n" + "z" * 50001, 1, 2, "x", 3, 4, "l")]
    d = spark.createDataFrame(rows, kind)
    out = line_dedup.dedup_lines(d)
    assert out.columns == d.columns
    got = sorted(((r.doc_id or 0, r.text) for r in out.collect()), key=str)
    # blank lines stay; repeated rows keep the same lines; rows without doc_id stay as they are
    assert got == sorted([(1, "a\n\n  \n\nb"), (2, "c\n"), (2, "c\n"), (0, "a\nb"), (3, None), (4, "z" * 50000)], key=str)
    assert line_dedup.dedup_lines(d.limit(0)).collect() == []


def test_lines_of_one_template(spark):
    # half of each line is the same, so that unlike lines meet in the same buckets
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8)))
    head = " ".join(word() for _ in range(25))
    lines = []
    for _ in range(60):
        body = [word() for _ in range(20)]
        lines.append(head + " " + " ".join(body))
        for _ in range(3):
            own = list(body)
            own[rng.randrange(20)] = word()
            lines.append(head + " " + " ".join(own))
    want, got = brute_lines(lines), line_lists(spark, lines)
    assert sum(want) == 180 and not any(g and not w for g, w in zip(got, want, strict=True))
    assert sum(got) >= 0.98 * sum(want)


@pytest.mark.parametrize("leaf", [1, 3, 17])
def test_tree_equals_library(leaf):
    enc, tokens = bpe.vocabulary(*tokenizer())
    rng = random.Random(leaf)
    for n in range(1500):
        t = "".join(rng.choice("ab 's'll\n\t  1é日.!x'r\x1c\x85\u3000") for _ in range(rng.randint(0, 80)))
        ids = bpe.encode(t, enc, tokens, leaf)
        assert ids == enc.encode_ordinary(t)
        assert bpe.decode(ids, tokens, leaf) == t.encode()


def test_bpe_and_histogram(spark):
    enc, _ = bpe.vocabulary(*tokenizer())
    got = {r.doc_id: r for r in bpe.tokenized(docs_of(spark, TEXTS), *tokenizer(), leaf=100, ids=True, digests=True).collect()}
    sizes = []
    for i, t in enumerate(TEXTS):
        ids = enc.encode_ordinary(t or "")
        sizes.append(len(ids))
        assert got[i].ids == ids and got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    hist = bpe.length_histogram(bpe.tokenized(docs_of(spark, TEXTS), *tokenizer())).cache()
    for r in hist.collect():
        assert (r.n_docs, r.docs_over, r.tokens_over, r.truncated_total) == (sizes.count(r.length), sum(s > r.length for s in sizes), sum(s for s in sizes if s > r.length), sum(min(s, r.length) for s in sizes))
    at = bpe.totals_at(hist, [0, 10, 10**6]).collect()
    assert {r.limit: r.truncated_total for r in at} == {0: 0, 10: sum(min(s, 10) for s in sizes), 10**6: sum(sizes)}
    assert bpe.quantiles(hist, [1.0]).first().length == max(sizes)
    assert bpe.length_histogram(bpe.tokenized(docs_of(spark, TEXTS).limit(0), *tokenizer())).collect() == []


def test_toxicity(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        s = [" ".join(rng.choice("alpha beta gamma delta eps zeta".split()) for _ in range(6)) for _ in range(5)]
        bad = i % 4 == 0
        if bad:
            s[rng.randrange(5)] += " " + rng.choice(["vilemonger", "vilemongers", "nastyx"])
        rows.append(". ".join(s))
        labels.append((i, int(bad)))
    rows[7] = None
    d, y = docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.score_documents(d, y).collect()}
    held = [r for r in out.values() if r.held_out]
    assert 40 < len(held) < 120
    assert sum(r.predicted == labels[r.doc_id][1] for r in held) >= 0.95 * len(held)
    assert out[7].score == 0.0
    hits = [s.text for r in held if labels[r.doc_id][1] for s in r.offending]
    assert hits and all("vile" in t or "nasty" in t for t in hits)
    kept = toxicity.without_toxic(d, y)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if not r.predicted}
    assert toxicity.score_documents(d, y.limit(0)).where(F.col("predicted") == 1).count() == 0
    assert toxicity.score_documents(d.limit(0), y).collect() == []


def test_pipeline_runs(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"] and out.count() > 100


def line_lists(spark, lines):
    return [r.text == "" for r in sorted(line_dedup.dedup_lines(docs_of(spark, lines)).collect(), key=lambda r: r.doc_id)]


def brute_lines(lines, shingle=8):
    """Which lines go: exact Jaccard of all pairs."""
    sets = [{x[j : j + shingle] for j in range(len(x) - shingle + 1)} for x in lines]
    up = list(range(len(lines)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(lines)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return [find(i) != i for i in range(len(lines))]


def test_short_near_lines_equal_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    lines = []
    for n in (10, 14, 18, 22, 26, 30) * 12:
        w = [word() for _ in range(n)]
        lines.append(" ".join(w))
        w[rng.randrange(n)] = word()
        lines.append(" ".join(w))
    lines += ["See https://example.com/a1 for details", "See https://example.com/b2 for details", "x" * 30, "x" * 31]
    lines += [f"Download it from https://example.com/files/of/the/archive/{t}" for t in ("alpha-release-notes", "omega-source-tarball")]
    want = brute_lines(lines)
    assert sum(want) > 20 and not any(want[-2:]) and want[-3] and not want[-5]
    got = line_lists(spark, lines)
    assert not any(g and not w for g, w in zip(got, want, strict=True))
    # bands find pairs by chance: nearly all
    assert sum(got) >= 0.95 * sum(want)


def test_lines_that_their_bucket_s_smallest_does_not_resemble(spark):
    import xxhash

    # a shared header whose shingles hold the smallest hashes: each bucket is one of all lines
    rng = random.Random(9)
    signed = lambda t: (xxhash.xxh64_intdigest(t.encode("utf-32-be"), 42) + 2**63) % 2**64
    small = sorted(("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(60000)), key=signed)[:8]
    lines = []
    for _ in range(12):
        body = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(40))
        lines += [" ".join(small) + " " + body, " ".join(small) + " " + body[:-1] + "z"]
    want = brute_lines(lines)
    assert sum(want) == 12 and line_lists(spark, lines) == want


def test_a_notice_that_most_files_carry(spark):
    got = licenses.scan(docs_of(spark, ["Released under the MIT license.", "Released under the MIT license.", "plain text"])).collect()
    assert {r.doc_id: r.labels for r in got} == {0: "mit", 1: "mit", 2: ""}


def brute_labels(text):
    w, out = WORD.findall((text or "").translate(LOW)), set()
    for label, ws, at, n in licenses._templates():
        for o in range(-at, len(w) - at - n + 1):
            if w[o + at : o + at + n] == ws[at : at + n] and sum(0 <= o + k < len(w) and w[o + k] == x for k, x in enumerate(ws)) >= licenses.COVERAGE * len(ws):
                out.add(label)
    for p, label in licenses.BASE.items():
        if any(w[o : o + len(p.split())] == p.split() for o in range(len(w))):
            out.add(label)
    return ",".join(sorted(out))


def test_licenses_equal_brute_force(spark):
    notice = "Released under the MIT license."
    long = licenses.TEMPLATES[1][1]
    # a notice in most of a small table, beside a text of rarer words, and at the very start
    texts = [notice, notice, "plain text", f"{long}. Licensed under the Apache License, Version 2.0.", "under the MIT license", "MIT license", f"{long} cc by nc 4 0", "licensed under cc by sa", "Lesser General Public License", None]
    got = {r.doc_id: r.labels for r in licenses.scan(docs_of(spark, texts)).collect()}
    assert got == {i: brute_labels(t) for i, t in enumerate(texts)}
    assert got[0] == "mit" and got[3] == "apache-2.0,mit" and got[4] == "mit" and got[5] == ""


def test_circles_and_repeated_nodes_in_trees(spark):
    kind = "tree string, node long, parent long, role string, text string, score double"
    rows = [("c", 1, 2, "user", "a", 0.1), ("c", 2, 1, "assistant", "b", 0.5), ("c", 3, 2, "user", "d", 0.9)]
    rows += [("r", 1, None, "user", "q", 0.0)] * 3 + [("r", 2, 1, "assistant", "x", 0.0), ("r", 2, 1, "assistant", "w", 0.0)]
    got = {r.tree: [s.text for s in r.segments][1::3] for r in reply_trees.format_trees(spark.createDataFrame(rows, kind)).collect()}
    # both messages of the circle are roots; the branch of 3 goes down from 2
    assert got == {"c": ["b", "d"], "r": ["q", "w"]}
    assert reply_trees.format_trees(spark.createDataFrame([], kind)).collect() == []


def test_clashing_names_in_the_filters(spark):
    rows = [(i, "clean words here " * 3, "t", "s", "u", "v") for i in range(6)] + [(None, None, "t", None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, scored_text string, _text string, Text2 string, _scored_text string")
    y = spark.createDataFrame([(1, 0), (2, 1), (2, None)], "doc_id long, toxic int")
    kept = toxicity.without_toxic(d, y)
    assert kept.columns == d.columns and kept.count() == 7
    assert toxicity.without_toxic(d.limit(0), y).collect() == []


def test_shared_folder_is_needed_on_a_cluster():
    from types import SimpleNamespace

    from tagloom.llm.common import shared_dir

    sc = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        shared_dir(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d: d)))


@pytest.fixture(scope="module")
def duck():
    from pathlib import Path

    import duckdb

    c = duckdb.connect()
    for f in Path("/root/testdata/sf0.001").glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def same(df, found):
    cols = sorted(df.columns)
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    key = lambda r: [(v is None, str(v)) for v in r]
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key) == sorted((tuple(r[names.index(c)] for c in cols) for r in found.fetchall()), key=key)


@pytest.mark.parametrize("name", ["op5_ngram_join", "op7_reply_trees", "op8_host_rules", "op9_decontaminate", "op10_url_filter"])
def test_queries_equal_sql(spark, duck, name):
    from tagloom.llm import oracles, queries

    same(queries.QUERIES[name](spark, "/root/testdata/sf0.001"), duck.execute(oracles.ORACLE_SQL[name]))


def test_hosts_are_shrunk_and_ties_fall_together(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good if i % 4 else "few", None, f"h{i % 2}", 1, "w", "k", 1) for i in range(40)] + [(100 + i, "bad", None, "worst", 1, "w", "k", 1) for i in range(10)] + [(200, good, None, "worst", 1, "w", "k", 1), (201, good, None, None, 1, "w", "k", 1)]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, DOCS)).collect()}
    # h0 fails in half of its texts, h1 in none, worst in 10 of 11; the null host's lone text is drawn to the mean
    k, n = [10, 0, 10, 0], [20, 20, 11, 1]
    rates = [a / b for a, b in zip(k, n, strict=True)]
    mean = sum(rates) / 4
    var = sum((r - mean) ** 2 for r in rates) / 4
    size = mean * (1 - mean) / var - 1
    want = [round((a + mean * size) / (b + size), 9) for a, b in zip(k, n, strict=True)]
    assert [got[0].host_rate, got[1].host_rate, got[200].host_rate, got[201].host_rate] == pytest.approx(want, abs=1e-8)
    assert not got[200].kept and not got[200].rule_failed and got[201].kept and got[1].kept and not got[0].kept
    assert quality.quality(spark.createDataFrame([], DOCS)).collect() == []


def test_ids_and_their_digest(spark):
    out = bpe.tokenized(docs_of(spark, TEXTS[:20]), *tokenizer(), ids=True, digests=True).collect()
    import struct

    for r in out:
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(r.ids)}I", *r.ids)).hexdigest() and r.n_tokens == len(r.ids)


def test_pipeline_stages_on_edge_cases(spark, tmp_path):
    """Nulls, empty tables, repeats and clashing names go through every stage; each keeps the columns of documents."""
    import corpus_pipeline

    kind = "doc_id long, text string, lang string, source string, n_chars long, of string, drop string, _text string, component_id long, hits long"
    clean = " ".join(f"plain{i}" for i in range(30))
    rows = [(1, clean, "l", "s", 1, "o", "d", "t", 9, 9), (1, clean, "l", "s", 1, "o", "d", "t", 9, 9), (2, None, None, None, None, None, None, None, None, None), (3, "", "l", "s", 0, "o", "d", "t", 9, 9), (None, "no id\nno id", "l", "s", 1, "o", "d", "t", 9, 9), (4, "own " * 40, "l", "s", 1, "o", "d", "t", 9, 9)]
    spark.createDataFrame([(1, 0, 0), (4, 0, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([("b", " ".join(f"bench{i}" for i in range(12)))], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows, kind)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        none = stage(spark, docs.limit(0), str(tmp_path))
        if name == "bpe":
            assert out.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
        else:
            assert out.columns == docs.columns, name
        assert none.collect() == [] and out.count() >= 5, name


def test_ngram_join_of_texts_without_words_alone(spark):
    got = ngram_join.jaccard_components(docs_of(spark, [None, "", " \n"])).collect()
    assert sorted(tuple(r) for r in got) == [(0, 0, 0), (1, 0, 1), (2, 0, 2)]
    assert ngram_join.one_of_each(docs_of(spark, [None, "", "a", "a"])).count() == 3
