"""The whole pipeline on planted documents: exactly which stay, and with what text."""

import hashlib
import os
import random


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_pipeline_keeps_exactly_what_it_should(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9)))
    said = lambda n: " ".join(word() for _ in range(n))
    docs, labels = {}, []
    for i in range(60):
        sentences = [said(12) + "." for _ in range(4)]
        if i % 3 == 0:
            sentences.insert(rng.randint(0, 4), "You vile rotten wretch, " + said(5) + ".")
        docs[i] = " ".join(sentences)
        labels.append((i, 1, int(i % 3 == 0)))
    shared, own = "this one line is found in more than one of all documents", said(20)
    docs[100], docs[101] = said(20) + "\n" + shared, own + "\n" + shared
    # the same words in lines of other lengths: no line is near another, the texts are
    words = said(120).split()
    docs[110], docs[111] = ("\n".join(" ".join(words[j : j + n]) for j in range(0, 120, n)) for n in (7, 11))
    item = said(14)
    docs[120], docs[121] = said(10) + " " + item.upper() + " " + said(10), said(10) + " " + " ".join(item.split()[:9]) + " " + said(10)
    docs[130], docs[131] = None, ""
    docs[140] = said(12) + ". You rotten, vile wretch. " + said(12)
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([("q1", item), ("q2", None)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {i for i in range(60) if i % 3} | {100, 101, 110, 121, 130, 131}
    want = docs | {101: own, 130: ""}
    assert {i: r.decoded_sha256 for i, r in got.items()} == {i: digest(want[i]) for i in got}
    assert got[130].n_tokens == got[131].n_tokens == 0 and len(got[100].ids) == got[100].n_tokens


def test_pipeline_leaves_its_last_stage_alone(spark):
    import corpus_pipeline
    from tagloom.llm.common import shared_dir

    root = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(root))
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 100
    own = out.inputFiles()[0].removeprefix("file://").removeprefix("file:").split("/tables-")[1].split("/")[0]
    assert os.listdir(f"{root}/tables-{own}") == ["5"] and f"tables-{own}" not in before
