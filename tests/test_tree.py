"""Trees walked with kinds, listings over them, and stored results pruned on disk."""

import os

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import jobs, paths
from corpuslens.sources import corpora, tree


def make(at):
    for name in ("a.txt", "deep/er/b.txt", ".git/c", "deep/d f+%41.txt", "outside/o.txt"):
        (at / "top" / name).parent.mkdir(parents=True, exist_ok=True)
        (at / "top" / name).write_text(name)
    (at / "top" / "empty").mkdir()
    (at / "elsewhere").mkdir()
    (at / "elsewhere" / "x.txt").write_text("x")
    (at / "top" / "link").symlink_to(at / "elsewhere")
    (at / "top" / "broken").symlink_to(at / "none")
    (at / "top" / "loop").symlink_to(at / "top")
    os.mkfifo(at / "top" / "pipe")


@pytest.mark.parametrize("budget", [1, 3, 1000])
def test_kinds_of_a_tree(spark, tmp_path, budget):
    make(tmp_path)
    rows = tree.scan_tree(spark, "me", {"home": f"file://{tmp_path}/top", "gone": str(tmp_path / "none")}, ("outside/**",), budget).collect()
    assert sorted((r["rel_path"], r["kind"], r["size"]) for r in rows) == [
        ("a.txt", "file", 5),
        ("broken", "other", None),
        ("deep", "directory", None),
        ("deep/d f+%41.txt", "file", 16),
        ("deep/er", "directory", None),
        ("deep/er/b.txt", "file", 13),
        ("empty", "directory", None),
        ("link", "other", None),
        ("loop", "other", None),
        ("pipe", "other", None),
    ]
    assert all((r["modified_ms"] is not None) == (r["kind"] == "file") and r["error"] is None for r in rows)


def test_trees_of_other_file_systems_are_refused(spark):
    with pytest.raises(ValueError, match="mounted"):
        tree.scan_tree(spark, "me", {"home": "s3a://somewhere/x"})


def test_a_directory_that_cannot_be_read(spark, tmp_path):
    # A directory is replaced by a file between the rounds: the walk goes on and says so.
    (tmp_path / "a").write_text("")
    start = [("home", f"{tmp_path}/", None, f"{tmp_path}/a")]
    rows = spark.createDataFrame(start, "root string, base string, device long, path string").mapInArrow(tree._walk(None, 10), tree.ENTRIES).collect()
    assert [(r["path"], r["kind"], r["todo"]) for r in rows] == [(f"{tmp_path}/a", "directory", False)] and rows[0]["error"]


def test_links_are_left_out_of_scans(spark, tmp_path):
    make(tmp_path)
    os.unlink(tmp_path / "top" / "pipe")
    os.unlink(tmp_path / "top" / "loop")
    os.unlink(tmp_path / "top" / "broken")
    roots = {"home": f"{tmp_path}/top"}
    files = corpora.scan_files(spark, "me", roots)
    assert "link/x.txt" in {r["rel_path"] for r in files.collect()}
    known = tree.scan_tree(spark, "me", roots)
    assert sorted(r["rel_path"] for r in tree.regular_files(files, known).collect()) == ["a.txt", "deep/d f+%41.txt", "deep/er/b.txt", "outside/o.txt"]


def test_listings_of_a_tree(spark, tmp_path):
    make(tmp_path)
    top = f"{tmp_path}/top"
    rows = tree.scan_tree(spark, "me", {"home": top})
    places = corpora.locations(spark, {"me": {"home": [top]}})
    see = lambda at: [(r["name"], r["kind"], r["size"], r["error"]) for r in paths.browse(rows, places, "me", at).collect()]
    assert see(top) == [("a.txt", "file", 5, None), ("broken", "other", None, None), ("deep", "directory", None, None), ("empty", "directory", None, None), ("link", "other", None, None), ("loop", "other", None, None), ("outside", "directory", None, None), ("pipe", "other", None, None)]
    assert see(f"{top}/empty") == [] and see(f"{top}/a.txt") == see(f"{top}/link") == [(None, None, None, "not a directory")]
    assert {r["name"] for r in paths.list_directory(rows, f"{top}/deep").collect()} == {"er", "d f+%41.txt"}
    assert [r["path"] for r in paths.find_paths(rows, "e").where(F.col("path").endswith("deep")).collect()] == []


def test_stored_results_are_pruned_oldest_first(spark, tmp_path):
    at = f"file://{tmp_path}/results"
    names = ["old", "a b", "c%41+d", "x=y", "new"]
    rows = spark.createDataFrame([(n, k) for k, n in enumerate([*names, "unknown"])], "job_id string, seq int")
    known = spark.createDataFrame([(n, 1000 * (k + 1)) for k, n in enumerate(names)], "job_id string, created_ms long")
    left = lambda: sorted(r["job_id"] for r in spark.read.schema("seq int, job_id string").parquet(at).collect())
    assert jobs.prune_results(spark, at, known, 0) == []
    jobs.store_results(rows, at)
    sizes = {r["job_id"]: r["size"] for r in jobs.stored_sizes(spark, at).collect()}
    assert set(sizes) == {*names, "unknown"} and min(sizes.values()) > 0
    assert jobs.prune_results(spark, at, known, 6000, 5000) == ["old"]
    assert jobs.prune_results(spark, at, known, 6000, 5000, 3) == ["a b"] and left() == ["c%41+d", "new", "unknown", "x=y"]
    assert jobs.prune_results(spark, at, known, 6000, 5000, most_bytes=sizes["new"] + sizes["x=y"]) == ["c%41+d"]
    assert jobs.prune_results(spark, at, known, 6000, 5000, most_bytes=sizes["new"] + sizes["x=y"]) == [] and left() == ["new", "unknown", "x=y"]
    assert jobs.prune_results(spark, at, known, 6000, 5000, most_bytes=0) == ["x=y", "new"] and left() == ["unknown"]
