"""Golden cases on small frames."""

import json
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuslens import options
from corpuslens.functions import patterns, text
from corpuslens.operators import backup, index, jobs, paths, registry, search, status
from corpuslens.operators.search import Search
from corpuslens.sources import corpora
from corpuslens.streaming import jobs as streaming

FILES = "host string, root string, path string, rel_path string, kind string, size long, modified_ms long, text string"


def files(spark, rows, host="a", root="home"):
    return spark.createDataFrame([(host, root, f"/{root}/{rel}", rel, "file", len(t.encode()), 1, t) for rel, t in rows], FILES)


CONFIG = [("config.rs", "prefix CUDA_BROKER_URL suffix\ncuda_broker_url\n"), ("target/config.rs", "CUDA_BROKER_URL\n")]


@pytest.mark.parametrize("mode,query,hits", [("literal", "CUDA_BROKER_URL", [(1, 8)]), ("case_insensitive_literal", "CUDA_BROKER_URL", [(1, 8), (2, 1)]), ("regex", "CUDA_.*URL", [(1, 1)])])
def test_modes(spark, mode, query, hits):
    rows = search.find_hits(files(spark, CONFIG), Search(query, mode=mode)).orderBy("line_number").collect()
    assert [(r["line_number"], r["column"]) for r in rows] == hits


def test_column_counts_bytes(spark):
    row = search.find_hits(files(spark, [("x", "é→ needle")]), Search("needle")).first()
    assert row["column"] == 7


def test_bad_requests(spark):
    corpus = files(spark, CONFIG)
    for bad in (Search("  "), Search("(", mode="regex"), Search("x", path_globs=("[",))):
        with pytest.raises(ValueError):
            search.find_hits(corpus, bad)
    with pytest.raises(ValueError):
        search.select_hosts(corpus, ("b",), {"a"})
    with pytest.raises(ValueError):
        search.select_hosts(corpus, ("*", "a"), {"a"})


@pytest.mark.parametrize("raw,lines", [("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\n\n", ["a", ""]), ("a\r\nb\r", ["a", "b"]), ("\n", [""]), ("a\r\r\n", ["a\r"])])
def test_line_splitting(spark, raw, lines):
    assert spark.createDataFrame([(raw,)], "t string").select(text.lines_of(F.col("t")).alias("l")).first()["l"] == lines


def test_binary_and_large_files_go(spark):
    corpus = files(spark, [("a", "needle\0"), ("b", "needle" * 10), ("c", "needle")])
    assert [r["path"] for r in search.find_hits(corpus, Search("needle", max_file_bytes=20)).collect()] == ["/home/c"]


def test_compaction(spark):
    ranges = search.compact(search.find_hits(files(spark, [("x", "before\nneedle one\nneedle two\nafter\n")]), Search("needle", context_lines=0)))
    assert [(r["data"], r["loc"]) for r in ranges.collect()] == [("needle one\nneedle two", "2-3")]
    hit = lambda host, path, *lines: [(host, path, n, [(n, f"l{n}")]) for n in lines]
    rows = hit("A", "/same.rs", 16, 17) + hit("B", "/same.rs", 204, 205, 206, 207) + hit("A", "/other.rs", 9)
    hits = spark.createDataFrame(rows, "host string, path string, line_number int, context array<struct<line_number:int,text:string>>")
    out = {(r["shown_host"], r["path"], r["loc"]) for r in search.show_hosts(search.compact(hits)).collect()}
    assert out == {("A", "/same.rs", "16-17"), ("B", "/same.rs", "204-207"), (None, "/other.rs", "9")}


def test_nested_ranges_merge(spark):
    rows = [("A", "/x", 5, [(n, str(n)) for n in range(1, 10)]), ("A", "/x", 3, [(3, "3")]), ("A", "/x", 10, [(10, "10")]), ("A", "/x", 13, [(13, "13")])]
    hits = spark.createDataFrame(rows, "host string, path string, line_number int, context array<struct<line_number:int,text:string>>")
    assert sorted(r["loc"] for r in search.compact(hits).collect()) == ["1-10", "13"]


def test_limits(spark):
    corpus = files(spark, [("many", "".join(f"MATCH_LIMIT_TOKEN_{k}\n" for k in range(128)))])
    ranges, said = search.search_text(corpus, Search("MATCH_LIMIT_TOKEN", limit=3, context_lines=0))
    assert ranges.first()["loc"] == "1-3" and said.first()["truncated"]
    hits = search.find_hits(corpus, Search("MATCH_LIMIT_TOKEN"))
    few = search.within_budget(hits, F.octet_length("text"), 64, ["host"], ["path", "line_number"]).collect()
    assert 0 < len(few) < 100 and few[0]["truncated"]


@pytest.mark.parametrize("glob,path,ignore,whole", [("*.rs", "src/a.rs", True, True), ("src/*.rs", "src/b/a.rs", False, True), ("src/**/a.rs", "src/a.rs", True, True), ("a?c", "abc", True, True), ("a?c", "x/abc", True, False), ("[!a]b", "cb", True, True), ("*.{rs,md}", "x/y.md", True, True), ("build/", "build/x", True, False)])
def test_globs(spark, glob, path, ignore, whole):
    match = lambda regex: spark.range(1).select(F.lit(path).rlike(regex)).first()[0]
    assert match(patterns.ignore_glob(glob)) is ignore
    assert match(patterns.path_glob(glob)) is whole


def test_paths(spark):
    corpus = files(spark, [("src/a.rs", "x"), ("note.txt", "fourteen bytes"), ("nested/x.txt", "y"), ("node_modules/hidden.js", "z")])
    found = lambda p: {r["path"] for r in paths.find_paths(corpus, p).collect()}
    assert (found("src/*.rs"), found("*src/*.rs"), found("./note"), found("*[")) == (set(), {"/home/src/a.rs"}, {"/home/note.txt"}, set())
    listed = {r["name"]: (r["kind"], r["size"]) for r in paths.list_directory(corpus, "/home").collect()}
    assert listed == {"src": ("directory", None), "nested": ("directory", None), "note.txt": ("file", 14)}


def test_reads(spark):
    corpus = files(spark, [("hello.txt", "hello\nworld\n")])
    asked = [(1, "a", "/home/hello.txt", 1, 2), (2, "a", "/home/hello.txt", 5, None), (3, "a", "/home/../etc", 1, 1), (4, "a", "/none", 1, 1), (5, "a", "/home/hello.txt", 2, 1)]
    got = {r["request_id"]: (r["start_line"], r["end_line"], r["data"], r["error"]) for r in paths.read_lines(spark.createDataFrame(asked, "request_id int, host string, path string, start int, end int"), corpus).collect()}
    assert got == {1: (1, 2, "hello\nworld", None), 2: (5, 5, "", None), 3: (None, None, None, "outside the roots"), 4: (None, None, None, "not found"), 5: (2, 2, "world", None)}


def test_roots(spark):
    corpus = files(spark, [("home.txt", "")]).unionByName(files(spark, [("opt.txt", "")], root="opt")).unionByName(files(spark, [("l.txt", "")], root="local"))
    names = lambda *r: {x["root"] for x in search.select_roots(corpus, r, {"home", "opt", "local"}).collect()}
    assert (names(), names("opt"), names("/home"), names("opt", "nowhere"), names("local")) == ({"home", "opt"}, {"opt"}, {"home"}, {"home", "opt"}, {"local"})
    with pytest.raises(ValueError):
        search.select_roots(corpus, ("nowhere",), {"home"}, strict=True)
    places = corpora.locations(spark, {"a": {"etc": ["/etc"], "home": ["/home", "/etc"], "opt": ["/opt"]}})
    assert [r["name"] for r in paths.ordered_roots(places).orderBy("rank", "path").collect()] == ["home", "home", "opt"]


def test_index(spark):
    corpus = files(spark, [("a", "pub struct HealthProducer"), ("b", "INDEX_ACCESS_TOKEN")])
    postings = index.build_postings(corpus)
    assert {r["path"] for r in postings.where("gram = 'ind'").collect()} == {"/home/b"}
    changed = index.replace_documents(postings, files(spark, [("a", "replacement body")]))
    assert index.candidates(changed, "HealthProducer").count() == 0
    assert [r["path"] for r in index.candidates(changed, "replacement").collect()] == ["/home/a"]
    assert index.candidates(changed, "ab") is None


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text("abAB ΑΣσςİiIéÉß\n", max_size=30), min_size=1, max_size=8), st.text("abAB ΑΣσςİiIéÉß", min_size=1, max_size=5))
def test_indexed_search_equals_full_scan(spark, texts, query):
    corpus = files(spark, [(str(k), t) for k, t in enumerate(texts)])
    for mode in ("literal", "case_insensitive_literal"):
        got = {r["path"] for r in index.indexed_files(corpus, index.build_postings(corpus), query, mode).collect()}
        fold = (lambda t: "".join({"Σ": "σ", "ς": "σ", "İ": "i"}.get(c, c.lower()) for c in t)) if mode != "literal" else str
        assert got == {f"/home/{k}" for k, t in enumerate(texts) if fold(query) in fold(t)}


def test_a_final_sigma_is_found_by_the_index(spark):
    corpus = files(spark, [("a", "ΑΑΣΑ"), ("b", "ΑΑΣ"), ("c", "DİYARBAKIR")])
    postings = index.build_postings(corpus)
    found = lambda q, mode: sorted(r["path"] for r in index.indexed_files(corpus, postings, q, mode).collect())
    assert found("ΑΑΣ", "literal") == found("αας", "case_insensitive_literal") == ["/home/a", "/home/b"]
    assert found("diyar", "case_insensitive_literal") == found("DİY", "literal") == ["/home/c"]
    assert index.worth_it(postings, "ΑΑΣ", 3, 0.7) and not index.worth_it(postings, "ΑΑΣ", 3, 0.5) and not index.worth_it(postings, "ΑΑ", 3, 1) and index.worth_it(postings, "nowhere", 3)


def test_excludes_of_the_user_are_added(spark):
    corpus = files(spark, [(".ssh/id", "needle"), ("own/x", "needle"), ("x", "needle"), (".jobs/j", "needle")])
    assert {r["path"] for r in search.find_hits(corpus, Search("needle", excludes=("own/**",))).collect()} == {"/home/x", "/home/.jobs/j"}
    assert options.all_excludes(("**/.git/**", "a"), "kept")[-2:] == ("**/kept/**", "a") and len(options.all_excludes(("**/.git/**",))) == len(options.EXCLUDES)


def test_search_status(spark):
    corpus = files(spark, [("x", "needle\n" * 5)]).unionByName(files(spark, [("y", "hay")], host="b"))
    _, said = search.search_text(corpus, Search("needle", limit=3), known_hosts={"a", "b"})
    assert [tuple(r) for r in said.collect()] == [("a", True, None, 5, True), ("b", True, None, 0, False)]
    for bad in (Search("(", mode="regex"), Search("x", path_globs=("[",))):
        ranges, said = search.search_text(corpus, bad)
        assert ranges.count() == 0 and [(r["host"], r["ok"], r["n_hits"]) for r in said.collect()] == [("a", False, 0), ("b", False, 0)] and all(r["error"] for r in said.collect())
    for hosts in (("c",), ("*", "a")):
        with pytest.raises(ValueError):
            search.search_text(corpus, Search("needle", hosts=hosts), known_hosts={"a", "b"})
    with pytest.raises(ValueError):
        search.search_text(corpus, Search(" "))
    hits, _ = search.search_text(corpus, Search("needle", context_lines=1, limit=2), verbose=True)
    assert [(r["line_number"], r["column"], len(r["context"])) for r in hits.orderBy("line_number").collect()] == [(1, 1, 2), (2, 1, 3)]


def test_many_queries_in_one_pass(spark):
    lines = corpora.lines(files(spark, [("x", "she sells shells\nno\n\n"), ("y", "shell")]))
    asked = spark.createDataFrame([(1, "shell"), (2, "he"), (3, ""), (4, "a\nb"), (5, "shell"), (6, " "), (7, None)], "query_id long, query string")
    for letters in (100, 6):
        got = sorted((r["query_id"], r["path"], r["line_number"]) for r in search.multi_search(asked, lines, letters).collect())
        assert got == [(1, "/home/x", 1), (1, "/home/y", 1), (2, "/home/x", 1), (2, "/home/y", 1), (5, "/home/x", 1), (5, "/home/y", 1)]
    assert search.multi_search(asked.limit(0), lines).count() == 0


def test_deadlines(spark):
    targets = spark.createDataFrame([("j", h, 100) for h in "ABCDE"], "job_id string, host string, started_ms long")
    arrivals = spark.createDataFrame([("j", "B", 110), ("j", "B", 151), ("j", "D", 120)], "job_id string, host string, arrival_ms long")
    done = spark.createDataFrame([("j", "A", 120, None), ("j", "B", 151, None), ("j", "C", 150, "peer-local-timeout"), ("j", "D", 150, None)], "job_id string, host string, finished_ms long, error string")
    got = {r["host"]: (r["ok"], r["error"], r["n_hits"]) for r in jobs.at_deadline(targets, arrivals, done, 50).collect()}
    assert got == {"A": (True, None, 0), "B": (False, "overall timeout", 1), "C": (False, "peer-local-timeout", 0), "D": (True, None, 1), "E": (False, "overall timeout", 0)}


def test_accepted_requests_of_hot_ids(spark):
    import random

    r = random.Random(1)
    rows = [("hot", r.randrange(5_000_000)) for _ in range(20_000)] + [(f"u{k % 300}", r.randrange(2_000_000)) for k in range(3000)] + [(None, 1), ("n", None), ("two", 5), ("two", 5)]
    times, expected = {}, set()
    for name, t in rows:
        if name is not None and t is not None:
            times.setdefault(name, []).append(t)
    for name, ts in times.items():
        last = None
        for t in sorted(ts):
            if last is None or t - last >= 60_000:
                expected.add((name, last := t))
    got = [tuple(x) for x in jobs.accepted(spark.createDataFrame(rows, "request_id string, at_ms long")).collect()]
    assert set(got) == expected and len(got) == len(expected)


@pytest.mark.parametrize("budget", [0, 40, 5_000, 10**9])
def test_newest_that_fit_over_many_ranges(spark, budget):
    import random

    r = random.Random(2)
    rows = [("hot" if k % 3 else f"k{k % 20}", k, r.randrange(9)) for k in range(3000)]
    expected, held = set(), {}
    for key, k, size in sorted(rows, key=lambda x: -x[1]):
        held[key] = held.get(key, 0) + size
        if held[key] <= budget:
            expected.add(k)
    made = spark.createDataFrame(rows, "key string, k int, size int").repartition(8)
    assert {x["k"] for x in jobs.newest_within(made, "size", budget, ["key"], [F.col("k").desc()]).collect()} == expected


def test_job_polls(spark):
    polls = spark.createDataFrame([("a", None, None), ("b", 1, 500), ("c", 0, 1), ("gone", None, None), ("old", 0, 5)], "job_id string, cursor int, page_size int")
    known = spark.createDataFrame([("a", 10, False, None), ("b", 10, True, None), ("c", 10, False, None), ("old", 0, False, None)], "job_id string, created_ms long, lost boolean, durability_error string")
    hosts = spark.createDataFrame([("a", "A", None), ("a", "B", True), ("b", "A", False), ("c", "A", True)], "job_id string, host string, ok boolean")
    results = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("c", 1), ("c", 2), ("old", 1)], "job_id string, seq int")
    said, pages = jobs.job_status(polls, known, hosts, results, 1000, 1000)
    got = {r["job_id"]: (r["state"], r["partial"], r["n_rows"], r["next_cursor"], r["error"] is None) for r in said.collect()}
    assert got == {"a": ("running", True, 1, 1, True), "b": ("lost", True, 1, None, True), "c": ("complete", False, 1, 1, True), "gone": ("expired", False, 0, None, False), "old": ("expired", False, 0, None, False)}
    assert sorted((r["job_id"], r["seq"]) for r in pages.collect()) == [("a", 1), ("b", 2), ("c", 1)]


def test_browsing(spark):
    corpus = files(spark, [("note.txt", "fourteen bytes"), ("nested/x.txt", "y"), ("node_modules/hidden.js", "z"), ("zz", "")])
    places = corpora.locations(spark, {"a": {"home": ["/home"]}, "b": {"home": ["/opt"]}})
    see = lambda at, host="a": [(r["name"], r["kind"], r["size"], r["error"]) for r in paths.browse(corpus, places, host, at).collect()]
    assert see("/home") == see("/home/") == [("nested", "directory", None, None), ("note.txt", "file", 14, None), ("zz", "file", 0, None)]
    assert see("/home", "b") == see("/etc") == see("/home/../etc") == [(None, None, None, "outside the roots")]
    assert see("/home/node_modules") == [(None, None, None, "excluded")] and see("/home/note.txt") == [(None, None, None, "not a directory")] and see("/opt", "b") == []


def test_reads_within_roots_and_budget(spark):
    corpus = files(spark, [("a", "one\ntwo\nthree")])
    asked = spark.createDataFrame([(1, "a", "/home/a", 1, None), (2, "b", "/home/a", 1, None)], "request_id int, host string, path string, start int, end int")
    rows = {r["request_id"]: (r["end_line"], r["data"], r["truncated"], r["error"]) for r in paths.read_lines(asked, corpus, locations=corpora.locations(spark, {"a": {"home": ["/home"]}}), budget=9).collect()}
    assert rows == {1: (2, "one\ntwo", True, None), 2: (None, None, False, "outside the roots")}


def test_limited_paths(spark):
    corpus = files(spark, [(f"candidate-{k:03}.txt", "") for k in range(128)])
    some = paths.search_paths(corpus, "candidate", limit=10, known_hosts={"a"}).collect()
    assert [r["path"] for r in some] == [f"/home/candidate-{k:03}.txt" for k in range(10)] and some[0]["truncated"]
    few = paths.search_paths(corpus, "candidate", budget=64).collect()
    assert len(few) == 2 and few[0]["truncated"]
    assert not any(r["truncated"] for r in paths.search_paths(corpus, "candidate-00", limit=10).collect())


def test_names_kinds_and_json(spark):
    said = spark.createDataFrame([("./a:3:x:y",), ("a:x:y",), ("a:99999999999:y",), ("no",)], "v string")
    assert [r["g"] and tuple(r["g"]) for r in said.select(text.grep_line(F.col("v")).alias("g")).collect()] == [("a", 3, "x:y"), None, None, None]
    modes = spark.createDataFrame([("drwx",), ("-rw",), ("lrwx",), ("brw",)], "m string")
    assert [r[0] for r in modes.select(text.kind_of(F.col("m"))).collect()] == ["directory", "file", "other", "other"]
    names = spark.createDataFrame([("x/job-a1-b.json", "/p", 1, 2), ("job-.json", "/q", 1, 2), ("job-a.json.tmp", "/r", 1, 2), ("xjob-a.json", "/s", 1, 2)], "rel_path string, path string, size long, modified_ms long")
    assert [(r["job_id"], r["path"]) for r in jobs.artifacts(names).collect()] == [("job-a1-b", "/p"), ("job-", "/q")]
    row = spark.createDataFrame([("a", 1, None)], "a string, n int, z string").select(text.encoded(F.struct("a", "n", "z")).alias("j"))
    assert row.first()["j"] == '{"a":"a","n":1}' and row.select(text.decoded(F.col("j"), "a string, n int, z string").alias("r")).first()["r"]["n"] == 1


def test_provider_json(spark, tmp_path):
    (tmp_path / "nodes.json").write_text(json.dumps([{"host_id": "A", "peer_url": "http://a", "more": 1}, {"host_id": "B", "endpoint": "http://b", "generation": 3}]))
    rows = registry.from_wire(corpora.read_registry(spark, f"file://{tmp_path}/nodes.json"), "A", 1000).collect()
    assert [(r["host"], r["local_url"], r["generation"]) for r in rows] == [("B", "http://b", 3)]


def test_index_follows_files(spark, tmp_path):
    at = lambda name: f"file://{tmp_path}/{name}"
    schema = FILES + ", error string, removed boolean"

    def add(*rows):
        made = [("a", "home", f"/home/{n}", n, "file", 1, t, text_, error, gone) for n, t, text_, error, gone in rows]
        spark.createDataFrame(made, schema).coalesce(1).write.mode("append").parquet(at("in"))
        streaming.refresh_index(spark.readStream.schema(schema).parquet(at("in")), at("index"), at("check"), once=True).awaitTermination()
        streaming.compact_index(spark, at("index"), at("flat"))
        log = spark.read.schema("root string, ok boolean, error string, indexed_files long, at_ms long").parquet(at("index") + "/log")
        return {(r["gram"], r["path"][6:]) for r in index.load_postings(spark, at("flat")).collect()}, index.latest_state(log).first()["state"]

    assert add(("x", 1, "abcd", None, None), ("y", 1, "abc", None, None)) == ({("abc", "x"), ("bcd", "x"), ("abc", "y")}, "ready")
    assert add(("x", 2, "zz", None, None), ("y", 2, None, "permission denied", None)) == ({("abc", "y")}, "degraded")
    assert add(("y", 3, None, None, True), ("w", 3, "new", None, None), ("w", 4, "newer", None, None)) == ({("new", "w"), ("ewe", "w"), ("wer", "w")}, "ready")


def test_refused_registry_keeps_the_last_good_one(spark, tmp_path):
    at = lambda name: f"file://{tmp_path}/{name}"

    def add(*rows):
        spark.createDataFrame([(h, url, None, None, None, None, [], [], 2) for h, url in rows], corpora.REGISTRY).coalesce(1).write.mode("append").parquet(at("in"))
        stream = spark.readStream.schema(corpora.REGISTRY).parquet(at("in"))
        streaming.refresh_registry(stream, lambda r: registry.from_wire(r, "me", 5000), at("out"), at("check"), once=True).awaitTermination()
        kept = spark.read.parquet(at("out"))
        newest = kept.agg(F.max("refresh")).first()[0]
        return sorted((r["host"], r["last_refresh_error"]) for r in kept.where(F.col("refresh") == newest).collect())

    assert add(("bad", "nowhere")) == []
    assert add(("B", "http://b"), ("C", "http://c")) == [("B", None), ("C", None)]
    assert add(("D", "")) == [(h, "registry refused: local_url of D") for h in "BC"]
    assert add(("E", "http://e"), ("E", "http://e")) == [(h, "registry refused: local_url of D") for h in "BC"]
    assert add(("F", "http://f")) == [("F", None)]


def test_node_status(spark):
    said = spark.createDataFrame([("b", True, None, 1), ("a", False, "x", 2), ("a", True, None, 1)], "host string, ok boolean, error string, seq int")
    states = spark.createDataFrame([("a", "ready", 3, 5, None)], "root string, state string, generation long, indexed_files long, last_error string")
    known = spark.createDataFrame([("b", 1000, 2000, None)], "host string, fetched_at_ms long, expires_at_ms long, last_refresh_error string")
    rows = [tuple(r) for r in status.node_status(said, files(spark, [("x", ""), ("y", "")]), states, known, 2100).collect()]
    assert rows == [("a", True, None, 2, "ready", 3, "empty"), ("b", True, None, 0, "missing", 0, "stale_but_usable")]


def test_folders_on_a_cluster_must_be_shared(spark):
    from corpuslens.sources import shared

    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: "spark://host:7077" if key == "spark.master" else default)

    with pytest.raises(ValueError):
        shared.shared_folder(Session)


def test_diagnostics_and_health(spark):
    lines = [("a", x) for x in ("rg: /x: Permission denied (os error 13)", "operation not permitted", "", "stale file handle")] + [("b", "regex parse error"), ("b", "permission denied"), ("c", " ")]
    got = {r["run"]: r["message"] for r in status.diagnostics(spark.createDataFrame(lines, "run string, line string")).collect()}
    assert got == {"a": "some configured paths were not readable", "b": None}
    said = spark.createDataFrame([("a", True, None), ("b", False, "x not readable"), ("c", False, "peer timeout")], "host string, ok boolean, error string")
    places = corpora.locations(spark, {"a": {"home": ["/h", "/g"]}, "d": {"home": ["/h"]}})
    out = {r["host"]: (r["roots"], r["health"]) for r in status.catalog(places, said).collect()}
    assert out == {"a": (["/g", "/h"], "healthy"), "b": ([], "degraded"), "c": ([], "offline"), "d": (["/h"], "offline")}


def test_jobs(spark, tmp_path):
    arrivals = spark.createDataFrame([("j", "B", "/z", 1, 5), ("j", "A", "/a", 1, 9), ("j", "B", "/z", 1, 20)], "job_id string, host string, path string, line_number int, arrival_ms long")
    assert [r["host"] for r in jobs.admit(arrivals, 1).collect()] == ["B"]
    assert jobs.page(jobs.admit(arrivals, 10), 1, 500).first()["host"] == "A"
    asked = spark.createDataFrame([("r", t * 1000) for t in (0, 50, 100, 130)], "request_id string, at_ms long")
    assert sorted(r["at_ms"] for r in jobs.accepted(asked).collect()) == [0, 100_000]
    results = jobs.admit(arrivals, 10)
    at = f"file://{tmp_path}/results"
    jobs.store_results(results, at)
    jobs.store_results(results.limit(1), at)
    known = spark.createDataFrame([("j", 0)], "job_id string, created_ms long")
    assert jobs.load_results(spark, at, "j", known, 999, 1000).count() == 1
    assert jobs.load_results(spark, at, "j", known, 1000, 1000).count() == 0
    states = [(1, False, 2, 1, None), (0, True, 2, 0, None), (0, False, 2, 0, None), (0, False, 2, 1, None), (1, False, 2, 2, "disk full")]
    rows = spark.createDataFrame(states, "p int, lost boolean, n int, ok int, e string").select(jobs.job_state(*map(F.col, ("p", "lost", "n", "ok", "e"))).alias("s"))
    assert [r["s"] for r in rows.collect()] == ["running", "lost", "failed", "complete", "failed"]


def test_registry(spark):
    fresh = lambda now, error=None: spark.range(1).select(registry.freshness(F.lit(1000), F.lit(2000), F.lit(error), F.lit(now))).first()[0]
    assert [fresh(1500), fresh(2100), fresh(302_001), fresh(1500, "down")] == ["fresh", "stale_but_usable", "expired", "stale_but_usable"]
    wire = spark.createDataFrame([("A", None, "http://a", None, None, None, [], [], 1), ("B", None, None, "http://b", None, None, None, ["/r"], 4), ("C", "http://c", None, None, None, None, [], [], 2)], corpora.REGISTRY)
    rows = {r["host"]: r for r in registry.from_wire(wire, "A", 1000).collect()}
    assert set(rows) == {"B", "C"} and rows["B"]["local_url"] == "http://b" and rows["C"]["routable_url"] == "http://c" and rows["C"]["generation"] == 4
    table = registry.from_wire(wire, "A", 1000)
    assert registry.failed_rules(table).where("size(reasons) > 0").count() == 0
    assert registry.failed_rules(table.unionByName(table)).where("array_contains(reasons, 'duplicate_host')").count() == 4
    stamped = registry.failed_refresh(table, "down")
    assert registry.merge(stamped, table.where("host = 'B'")).collect()[0]["last_refresh_error"] is None
    assert registry.merge(stamped, table.limit(0)).count() == 0


def test_backups(spark, tmp_path):
    (tmp_path / "ok.json").write_text(json.dumps({"schema_version": 1, "generated_at_ms": 1723840000000, "backups": [{"completed_at_ms": 1723839000000, "object_count": 4, "byte_count": 1200}, {"completed_at_ms": 1723839500000, "object_count": 6, "byte_count": 3400}]}, indent=1))
    (tmp_path / "bad.json").write_text('{"schema_version": "x", "generated')
    see = lambda name, now: tuple(backup.availability(spark, name and f"file://{tmp_path}/{name}", now, 60_000).first())
    assert see("ok.json", 1723840030000) == ("available", 2, 10, 4600, 1723839500000)
    assert see("ok.json", 1723840060001)[0] == "stale"
    assert see("bad.json", 0) == see("none.json", 0) == ("unavailable", 0, 0, 0, None)
    assert see(None, 0)[0] == "unconfigured"


def test_file_scan(spark, tmp_path):
    for name, data in (("a.txt", b"hello\n"), ("sub/b.txt", "é".encode()), (".git/c", b"x"), ("bad.bin", b"\xff\xfe"), ("nul", b"a\0b")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r["rel_path"]: r["text"] for r in corpora.scan_files(spark, "me", {"home": str(tmp_path)}).collect()}
    assert got == {"a.txt": "hello\n", "sub/b.txt": "é"}
    assert corpora.scan_files(spark, "me", {"home": str(tmp_path)}, with_content=False).count() == 4


def test_progressive_search_keeps_what_it_showed(spark, tmp_path):
    at = lambda name: f"file://{tmp_path}/{name}"

    def add(*rows):
        files(spark, rows).coalesce(1).write.mode("append").parquet(at("in"))
        stream = spark.readStream.schema(FILES).parquet(at("in"))
        streaming.progressive_search(stream, Search("needle"), 3, at("out"), at("check"), once=True).awaitTermination()
        return [(r["seq"], r["path"]) for r in spark.read.parquet(at("out")).orderBy("seq").collect()]

    assert add(("z", "needle")) == [(1, "/home/z")]
    assert add(("a", "needle\nno\nneedle"), ("b", "needle")) == [(1, "/home/z"), (2, "/home/a"), (3, "/home/a")]
    assert len(add(("c", "needle"))) == 3


def test_streamed_requests_are_deduplicated(spark, tmp_path):
    spark.createDataFrame([("r", datetime(2024, 1, 1, 0, 0, s)) for s in (0, 30)] + [("q", datetime(2024, 1, 1))], "request_id string, ts timestamp").write.parquet(f"file://{tmp_path}/in")
    rows = streaming.accepted_requests(spark.readStream.schema("request_id string, ts timestamp").parquet(f"file://{tmp_path}/in"))
    query = rows.writeStream.format("memory").queryName("accepted").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["request_id"] for r in spark.table("accepted").collect()) == ["q", "r"]


def test_streamed_requests_are_those_of_the_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("'u' || user_id % 3 request_id", "cast(ts as timestamp) ts")
    expected = {(r["request_id"], r["at_ms"]) for r in jobs.accepted(events.selectExpr("request_id", "unix_millis(ts) at_ms"), 60_000).collect()}
    events.orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 400).parquet(f"file://{tmp_path}/in")  # one after another
    rows = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    streaming.accepted_requests(rows).writeStream.format("memory").queryName("accepted_all").trigger(availableNow=True).start().awaitTermination()
    got = [tuple(r) for r in spark.sql("select request_id, unix_millis(ts) from accepted_all").collect()]
    assert set(got) == expected and len(got) == len(expected) > 3
