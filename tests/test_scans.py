"""Scans of a temporary tree, changed and scanned again."""

import os

import pytest
from pyspark.sql import functions as F

from tagloom.operators import scans
from tagloom.operators.scans import Library


def put(root, path, text="x", at=1_600_000_000):
    p = root / path
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text)
    os.utime(p, (at, at))


def describe_of(root):
    """Contents stand in for fingerprints."""

    def describe(files):
        paths = [r.normalized_path for r in files.collect()]
        rows = [(p, (root / p).read_text(), 10.0) for p in paths]
        return files.sparkSession.createDataFrame(rows, "normalized_path string, fingerprint string, duration double")

    return describe


def state(lib, version=None):
    files = sorted((r.normalized_path, r.file_size, r.modified_ms, r.fingerprint) for r in lib.table("files", version).collect())
    folders = sorted((r.folder, r.file_count) for r in lib.table("folders", version).collect())
    return files, folders


def changes(lib):
    return sorted((r.status, r.normalized_path, r.old_path) for r in lib.table("changes").collect())


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "music"
    for path, text in [("top.mp3", "t"), ("a/1.flac", "a1"), ("a/2.MP3", "a2"), ("a/notes.txt", "no"), ("a/deep/er/3.ogg", "d3"), ("b/4.wav", "b4"), ("b/.wav", "hid"), ("é 日/5.opus", "e5")]:
        put(root, path, text)
    (root / "empty").mkdir()
    return root


def test_a_scan_after_changes_equals_a_scan_from_nothing(spark, tmp_path, tree):
    lib = Library(spark, str(tree), str(tmp_path / "store"))
    assert lib.table("files").count() == 0
    assert lib.scan(describe=describe_of(tree)) == 1
    assert lib.counts() == {"new": 7, "changed": 0, "moved": 0, "missing": 0, "errors": 0}
    assert [f for f, _ in state(lib)[1]] == ["", "a", "a/deep", "a/deep/er", "b", "empty", "é 日"]
    ids = {r.normalized_path: r.file_id for r in lib.table("files").collect()}
    assert len(set(ids.values())) == 7
    # nothing changed: no new version, and no folder is opened
    assert lib.scan(describe=describe_of(tree)) == 1 == lib.scan(full=True)
    listing = scans.list_tree(spark, str(tree), lib.table("folders"), str(tmp_path / "look"))
    assert {r.kind for r in listing.collect()} == {"same"}

    put(tree, "a/1.flac", "a1 changed", 1_600_000_100)
    os.utime(tree / "a", (1_600_000_050, 1_600_000_050))
    (tree / "new/one").mkdir(parents=True)
    os.rename(tree / "a/2.MP3", tree / "new/one/moved.mp3")
    put(tree, "new/6.aac", "n6")
    os.remove(tree / "b/4.wav")
    os.rename(tree / "é 日", tree / "ü")
    put(tree, "a/deep/er/7.m4a", "d3")
    assert lib.scan(describe=describe_of(tree)) == 2
    assert changes(lib) == [
        ("changed", "a/1.flac", None),
        ("missing", "b/4.wav", None),
        ("moved", "new/one/moved.mp3", "a/2.MP3"),
        ("moved", "ü/5.opus", "é 日/5.opus"),
        ("new", "a/deep/er/7.m4a", None),
        ("new", "new/6.aac", None),
    ]
    fresh = Library(spark, str(tree), str(tmp_path / "fresh"))
    fresh.scan(describe=describe_of(tree))
    assert state(lib) == state(fresh)
    after = {r.normalized_path: r.file_id for r in lib.table("files").collect()}
    assert after["ü/5.opus"] == ids["é 日/5.opus"] and after["new/one/moved.mp3"] == ids["a/2.MP3"] and after["a/1.flac"] == ids["a/1.flac"]
    assert len(set(after.values())) == len(after)
    # the version before is as it was
    assert len(state(lib, 1)[0]) == 7


def test_unchanged_folders_are_skipped_but_for_a_full_scan(spark, tmp_path, tree):
    lib = Library(spark, str(tree), str(tmp_path / "store"))
    lib.scan()
    before = os.stat(tree / "b")
    put(tree, "b/4.wav", "longer than before", 1_600_000_500)
    os.utime(tree / "b", ns=(before.st_atime_ns, before.st_mtime_ns))
    # a file written in place leaves its folder's time: the quick scan takes it for unchanged
    assert lib.scan() == 1
    assert lib.scan(full=True) == 2 and changes(lib) == [("changed", "b/4.wav", None)]


def test_errors_of_a_folder_are_rows_and_nothing_is_lost(spark, tmp_path, tree, monkeypatch):
    lib = Library(spark, str(tree), str(tmp_path / "store"))
    lib.scan()
    want = state(lib)
    # a file where a folder was: it can be asked for its time, but not be opened
    os.rename(tree / "b", tmp_path / "b")
    (tree / "b").write_text("")
    assert lib.scan() == 2
    assert [r.path for r in lib.table("errors").collect()] == ["b"] and lib.counts()["missing"] == 0
    assert state(lib)[0] == want[0]
    os.remove(tree / "b")
    os.rename(tmp_path / "b", tree / "b")
    assert lib.scan() == 3 and state(lib)[0] == want[0] and lib.counts()["errors"] == 0
    # what fails before it is published leaves the last version
    put(tree, "a/9.mp3", "n")
    with monkeypatch.context() as m:
        m.setattr(scans, "files_after", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            lib.scan()
    assert state(lib)[0] == want[0]
    assert lib.scan() == 4 and lib.counts()["new"] == 1
    with pytest.raises(FileNotFoundError):
        Library(spark, str(tmp_path / "none"), str(tmp_path / "store")).scan()


def test_a_folder_that_is_gone_takes_its_files(spark, tmp_path, tree):
    import shutil

    lib = Library(spark, str(tree), str(tmp_path / "store"))
    lib.scan()
    shutil.rmtree(tree / "a")
    lib.scan()
    assert [c[:2] for c in changes(lib)] == [("missing", "a/1.flac"), ("missing", "a/2.MP3"), ("missing", "a/deep/er/3.ogg")]
    assert [f for f, _ in state(lib)[1]] == ["", "b", "empty", "é 日"]
    assert lib.table("files").where(F.col("normalized_path").startswith("a/")).count() == 0
