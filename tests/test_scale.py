"""Operators whose state or keys are dealt over tasks: stored index, change detection, bands, islands, owners, globs as data, split lines."""

import random
import time
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuslens.functions import patterns
from corpuslens.operators import index, index_store, paths, registry, search
from corpuslens.operators.search import Search
from corpuslens.sources import corpora
from corpuslens.streaming import jobs as streaming
from tests.test_operators import FILES, files


def many(spark, rows):
    """(root, name, modified_ms, text)"""
    return spark.createDataFrame([("a", root, f"/{root}/{n}", n, "file", len(t.encode()), ms, t) for root, n, ms, t in rows], FILES)


def found(df):
    return sorted(r["path"] for r in df.select("path").collect())


def same_postings(spark, at, rows):
    got = sorted(map(tuple, index_store.snapshot(spark, at).postings().collect()))
    assert got == sorted(map(tuple, index.build_postings(rows).collect()))


def test_a_search_is_right_while_the_index_is_behind(spark, tmp_path):
    at = f"file://{tmp_path}/index"
    old = many(spark, [("home", "same", 1, "needle here"), ("home", "changed", 1, "hay"), ("home", "emptied", 1, "needle"), ("home", "gone", 1, "needle"), ("opt", "late", 1, "needle"), ("home", "nul", 1, "needle\0")])
    assert found(index_store.search_files(old, index_store.snapshot(spark, at), "needle")) == ["/home/emptied", "/home/gone", "/home/same", "/opt/late"]
    first = index_store.refresh(spark, at, old, unready=("opt",))
    assert first.ready == ("home",) and found(first.files()) == ["/home/changed", "/home/emptied", "/home/gone", "/home/nul", "/home/same"]
    now = many(spark, [("home", "same", 1, "needle here"), ("home", "changed", 2, "a needle"), ("home", "emptied", 2, "hay"), ("home", "new", 3, "needle"), ("opt", "late", 1, "needle"), ("home", "nul", 1, "needle\0")])
    for mode in ("literal", "case_insensitive_literal", "regex"):
        for query in ("needle", "NEEDLE" if mode != "literal" else "hay", "ne", "nothing"):
            plain = now.where("instr(text, chr(0)) = 0").where(search.matches(F.col("text"), query, mode))
            assert found(index_store.search_files(now, first, query, mode)) == found(plain)
    # Only what the index doesn't know is scanned.
    assert found(index_store.files_to_read(now, first, "needle")) == ["/home/changed", "/home/emptied", "/home/new", "/home/same", "/opt/late"]
    assert index_store.refresh(spark, at, old, unready=("opt",)).generation == first.generation


def test_refreshes_and_a_merge_with_a_reader_open(spark, tmp_path):
    r, at = random.Random(1), f"file://{tmp_path}/index"
    state = {f"f{k}": (1, f"text {k} abc{k % 3}") for k in range(30)}
    rows = lambda: many(spark, [("home", n, ms, t) for n, (ms, t) in state.items()])
    index_store.refresh(spark, at, rows())
    reader = index_store.snapshot(spark, at)
    before = sorted(map(tuple, reader.postings().collect()))
    for step in range(2, 5):
        for n in r.sample(sorted(state), 4):
            del state[n]
        for n in r.sample(sorted(state), 5):
            state[n] = (step, f"changed {step}")
        state[f"new{step}"] = (step, "a new one")
        state["f0"] = (step, "here again")
        index_store.refresh(spark, at, rows())
        same_postings(spark, at, rows())
    assert len(index_store.snapshot(spark, at).runs) == 4
    half = index_store.merge_runs(spark, at, 2)
    assert len(half.runs) == 2
    same_postings(spark, at, rows())
    merged = index_store.merge_runs(spark, at)
    assert len(merged.runs) == 1 and found(merged.files()) == sorted(f"/home/{n}" for n in state)
    same_postings(spark, at, rows())
    assert sorted(map(tuple, reader.postings().collect())) == before
    index_store.drop_old(spark, at)
    assert sorted(p.name for p in (tmp_path / "index" / "runs").iterdir()) == list(merged.runs)
    same_postings(spark, at, rows())
    assert index_store.snapshot(spark, f"{at}/none").postings().count() == 0


def test_stored_postings_name_no_file(spark, tmp_path, monkeypatch):
    """A stored index has a row a gram and segment, whatever files have it; letters outside the first plane are letters, and long texts are taken in pieces."""
    at, r = f"file://{tmp_path}/index", random.Random(3)
    texts = ["", "ab", "abcabc", "\U0001f600\U0001f601xy\U0001f600", "\u03a3\u03c2\u0130\u00c9\u6c49", *("".join(r.choice("abcAB \n\U0001f600") for _ in range(200)) for _ in range(60))]
    rows = many(spark, [("home", f"f{k}", 1, t) for k, t in enumerate(texts)])
    folded = [t.translate(str.maketrans("\u03a3\u03c2\u0130", "\u03c3\u03c3i")).lower() for t in texts]
    expected = sorted((t[k : k + 3], "a", f"/home/f{n}") for n, t in enumerate(folded) for k in {t[k : k + 3]: k for k in range(len(t) - 2)}.values())
    assert sorted(map(tuple, index.build_postings(rows).collect())) == expected
    index.write_index(rows, at)
    assert sorted(map(tuple, index.load_postings(spark, at).collect())) == expected
    stored = spark.read.parquet(f"{at}/postings")
    assert stored.columns == ["gram", "segment", "files"] and stored.count() == stored.select("gram", "segment").distinct().count() < len(expected) / 4
    batch = pa.RecordBatch.from_pylist([{"segment": 1, "n": k, "text": t} for k, t in enumerate(folded)], pa.schema([("segment", pa.int64()), ("n", pa.int32()), ("text", pa.string())]))
    pieces = [(x["gram"], n) for out in index.posted(50)(iter([batch])) for x in out.to_pylist() for n in x["files"]]
    assert sorted((g, "a", f"/home/f{n}") for g, n in pieces) == expected


def test_a_watched_folder_is_indexed(spark, tmp_path):
    root, at = tmp_path / "root", f"file://{tmp_path}/index"
    root.mkdir()
    listed = lambda: corpora.scan_files(spark, "a", {"home": str(root)})
    for n in range(3):
        (root / f"{n}.txt").write_text(f"file number {n}")
    query = streaming.watch_files(spark, listed, at, f"file://{tmp_path}/check", interval="1 second", most_runs=2)

    def settles():
        for _ in range(120):
            if query.exception():
                raise query.exception()
            now = index_store.snapshot(spark, at)
            if now.generation and index_store.changes(now.files(), listed().select("host", "root", "path", "size", "modified_ms")).isEmpty():
                return now
            time.sleep(0.5)
        raise AssertionError("the index stays behind")

    try:
        settles()
        same_postings(spark, at, listed())
        for step in range(3):
            (root / "1.txt").write_text(f"another text of step {step} " + "x" * step)
            (root / f"more{step}.txt").write_text("added")
            (root / (f"{step}.txt" if step != 1 else "more0.txt")).unlink()
            now = settles()
            same_postings(spark, at, listed())
            assert len(now.runs) <= 3
    finally:
        query.stop()


def test_state_of_requests_ends(spark, tmp_path):
    day = datetime(2024, 1, 1)
    rows = [(f"r{k}", day + timedelta(seconds=10 * k)) for k in range(120)] + [("again", day + timedelta(seconds=40 * k)) for k in range(30)] + [("r3", day + timedelta(seconds=60)), ("r3", day + timedelta(seconds=95))]
    schema, at = "request_id string, ts timestamp", f"file://{tmp_path}/in"
    spark.createDataFrame(sorted(rows, key=lambda r: r[1]), schema).coalesce(1).write.option("maxRecordsPerFile", 15).parquet(at)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(at)
    query = streaming.accepted_requests(stream, "60 seconds").writeStream.format("memory").queryName("ended").trigger(availableNow=True).start()
    query.awaitTermination()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(states) < 60 and states[-1] < 25  # of 121 ids
    from corpuslens.operators import jobs

    batch = spark.createDataFrame(rows, schema).selectExpr("request_id", "unix_millis(ts) at_ms")
    expected = sorted(map(tuple, jobs.accepted(batch, 60_000).collect()))
    assert sorted((x["request_id"], x["at_ms"]) for x in spark.sql("select request_id, unix_millis(ts) at_ms from ended").collect()) == expected


def test_many_queries_equal_plain_search(spark):
    r = random.Random(2)
    words = ["a", "an", "ant", "the", "rare", "needle", "é", "😀", "", "x-y"]
    rows = [(str(k), "\n".join(" ".join(r.choice(words) for _ in range(r.randrange(7))) for _ in range(3))) for k in range(60)]
    asked = [(k, " ".join(r.choice(words) for _ in range(r.randrange(1, 5)))) for k in range(80)] + [(90, "nt t"), (91, "😀"), (92, "é "), (93, "n"), (94, "  "), (95, "needle"), (95, "needle")]
    lines = corpora.lines(files(spark, rows))
    texts = [(x["path"], x["line_number"], x["text"]) for x in lines.collect()]
    expected = sorted({(k, p, n) for k, q in asked if q.strip(" ") for p, n, t in texts if q in t})
    for letters in (10**6, 0):
        out = search.multi_search(spark.createDataFrame(asked, "query_id long, query string"), lines, letters)
        assert sorted((x["query_id"], x["path"], x["line_number"]) for x in out.collect()) == expected
    assert "Python" not in out._jdf.queryExecution().toString() and "InArrow" not in out._jdf.queryExecution().toString()


def test_queries_without_inner_words_meet_by_words(spark):
    """No line is cut into pieces for them; repeated rows come back as often, a line with several words that hold a part once."""
    lines = corpora.lines(files(spark, [("x", "nothing bothers\nthe thing things thin"), ("y", "a  thing")]))
    lines = lines.unionByName(lines)
    asked = [(1, "thing"), (2, "ing bo"), (3, "th"), (4, " t"), (5, "g t"), (6, "  "), (7, "zz"), (8, "h")]
    expected = sorted((k, x["path"], x["line_number"]) for k, q in asked if q.strip(" ") for x in lines.collect() if q in x["text"])
    out = search.multi_search(spark.createDataFrame(asked, "query_id long, query string"), lines)
    assert sorted((x["query_id"], x["path"], x["line_number"]) for x in out.collect()) == expected
    assert "regexp_extract_all" not in out._jdf.queryExecution().toString()


@pytest.mark.parametrize("c", [0, 1, 3])
def test_contexts_by_bands(spark, c):
    r = random.Random(c)
    numbers = sorted(r.sample(range(1, 400), 250))
    lines = spark.createDataFrame([("h", "/p", n, f"l{n}") for n in numbers], "host string, path string, line_number int, text string")
    hits = lines.where("line_number % 3 = 0")
    got = sorted((x["line_number"], x["context_line"], x["context_text"]) for x in search.join_context(hits, lines, c).collect())
    assert got == sorted((h, n, f"l{n}") for h in numbers if h % 3 == 0 for n in numbers if abs(n - h) <= c)


def test_islands_over_ranges(spark):
    r = random.Random(4)
    rows = []
    for path, top in (("/hot", 3000), ("/b", 60), ("/c", 9)):
        for start in r.sample(range(1, top), top // 3):
            end = start + r.choice([0, 1, 2, 2, 60 if r.random() < 0.02 else 4])
            rows.append(("h", path, start, [(n, str(n)) for n in range(start, end + 1)]))
    hits = spark.createDataFrame(rows, "host string, path string, line_number int, context array<struct<line_number:int,text:string>>").repartition(4)
    plain = sorted(map(tuple, search.compact(hits).collect()))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert sorted(map(tuple, search.compact_spread(hits).select("host", "path", "start_line", "end_line", "loc", "data").collect())) == plain and len(plain) > 50
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_overlapping_roots(spark):
    corpus = files(spark, [("project/x.txt", "needle\nno\nneedle\n")])
    corpus = corpus.unionByName(corpus.withColumn("root", F.lit("project")))
    hits, said = search.search_text(corpus, Search("needle", limit=2), verbose=True)
    assert [(r["line_number"], len(r["context"])) for r in hits.collect()] == [(1, 3), (3, 3)]
    assert [tuple(r) for r in said.collect()] == [("a", True, None, 2, False)]
    asked = spark.createDataFrame([(1, "a", "/home/project/x.txt", 1, 1)], "request_id int, host string, path string, start int, end int")
    assert [r["data"] for r in paths.read_lines(asked, corpus).collect()] == ["needle"]
    places = corpora.locations(spark, {"a": {"home": ["/home/"], "project": ["/home/project"], "local": ["/home/project/"], "top": ["/"]}, "b": {"home": ["/home/project"]}})
    assert [(r["root"], r["path"]) for r in paths.owned(corpus, places).collect()] == [("project", "/home/project/x.txt")] or [r["root"] for r in paths.owners(corpus, places).collect()] == ["local"]
    some = spark.createDataFrame([("a", p) for p in ("/home", "/homes", "/home/x", "/home/../etc", "/etc", "home/x")] + [("b", "/home/x"), ("b", "/home/project"), ("c", "/x")], "host string, path string")
    home = places.where("name <> 'top'")
    assert sorted(map(tuple, paths.contained(some, home).collect())) == [("a", "/home"), ("a", "/home/x"), ("b", "/home/project")]
    assert sorted(r["path"] for r in paths.contained(some.where("host = 'a'"), places).collect()) == ["/etc", "/home", "/home/x", "/homes"]


def test_globs_as_data(spark):
    r = random.Random(5)
    segments = ["src", "gen", "a.pem", "b.tar.gz", "x", "lib", "target", "id_rsa", "é.key", ""]
    globs = ["**/target/**", "**/id_rsa", "**/*.pem", "**/*.tar.gz", "proc/**", "src/*/x", "s*/gen/**", "**/{lib,gen}/x*", "*foo*", "l?b/a.pem", "[ls]*/x", "**/.cargo/registry/**", "src", "**/*.gz/**", "x/**/gen", "gen/*", "**/x/src/**", "*"]
    rel = sorted({"/".join(r.choice(segments) for _ in range(r.randrange(1, 5))) for _ in range(500)} | {"foo", "a\\target\\b", "proc", "proc/1", "target"})
    corpus = spark.createDataFrame([(x, 1) for x in rel], "rel_path string, kind int")
    for chosen in ([g] for g in globs):
        plain = corpus.where(~patterns.excluded(F.col("rel_path"), chosen))
        got = patterns.without_excluded(corpus, spark.createDataFrame([(g,) for g in chosen], "glob string"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect())), chosen
    every = globs[:-1]
    got = patterns.without_excluded(corpus, spark.createDataFrame([(g,) for g in [*every, *every]], "glob string"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, corpus.where(~patterns.excluded(F.col("rel_path"), every)).collect()))


def test_globs_that_share_a_part_meet_few_paths(spark):
    """Globs of a pattern each, all with the same plain part, are met by how another part begins; classes may hold a slash."""
    assert ("begin", "f12.") in [k[1:3] for k in patterns.glob_keys("lib*/gen/f12.[ch]")] and ("end", "b3") in [k[1:3] for k in patterns.glob_keys("l?b3/gen/*.c")]
    n = 4000
    corpus = spark.range(n).selectExpr("'lib' || id % 7 || '/gen/f' || id || '.c' rel_path").unionByName(spark.createDataFrame([("a/c/x",), ("l/b3/gen/y.c",)], "rel_path string"))
    globs = spark.range(n).where("id % 2 = 0").selectExpr("'lib*/gen/f' || id || '.[ch]' glob").unionByName(spark.createDataFrame([("a[b/]c/x",), ("l?b3/gen/y*.c",)], "glob string"))
    left = patterns.without_excluded(corpus, globs)
    assert {r["rel_path"] for r in left.collect()} == {f"lib{k % 7}/gen/f{k}.c" for k in range(1, n, 2)}
    counts = patterns.keyed_globs(globs).groupBy("kind", "key").count().where("kind = 'begin' and key like 'f%'").agg(F.max("count")).first()[0]
    assert counts == 1


def test_lines_of_split_files(spark, tmp_path):
    r = random.Random(6)
    root = tmp_path / "root"
    (root / "sub dir").mkdir(parents=True)
    texts = {"big.txt": "".join(f"{k} {'x' * r.randrange(60)}{r.choice([chr(10), chr(13) + chr(10)])}" for k in range(3000)), "sub dir/é +%.txt": "one\n\ntwo\r\rthree", "empty": "", "end": "\n"}
    for name, text in texts.items():
        (root / name).write_bytes(text.encode())
    (root / "nul").write_bytes(b"fine\n" * 3000 + b"a\0b\n")
    (root / "latin").write_bytes(b"fine\n" * 3000 + b"\xff\n")
    (root / ".git").mkdir()
    (root / ".git" / "x").write_text("hidden")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = sorted((x["path"], x["line_number"], x["text"]) for x in corpora.scan_lines(spark, "me", {"home": str(root)}).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    plain = spark.createDataFrame([("me", "home", f"{root}/{n}", t) for n, t in texts.items()], "host string, root string, path string, text string")
    assert got == sorted((x["path"], x["line_number"], x["text"]) for x in corpora.lines(plain).collect())


def test_a_registrys_generation_never_falls(spark):
    wire = lambda *rows: registry.from_wire(spark.createDataFrame([(h, f"http://{h}", None, None, None, None, [], [], g) for h, g in rows], corpora.REGISTRY), "me", 1000)
    merged = registry.merge(wire(("B", 9)), wire(("D", 4)))
    assert [(r["host"], r["generation"]) for r in merged.collect()] == [("D", 9)]
    assert [r["generation"] for r in registry.merge(wire(("B", 2)), wire(("D", 4))).collect()] == [4]


@pytest.mark.parametrize("budget", [0, 30, 400, 10**6])
def test_budgets_over_ranges(spark, budget):
    r = random.Random(budget)
    rows = [("hot" if k % 4 else f"k{k % 12}", k, r.randrange(6)) for k in r.sample(range(5000), 900)]
    made = spark.createDataFrame(rows, "key string, k int, n int").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(map(tuple, search.within_budget_spread(made, F.col("n"), budget, ["key"], ["k"]).collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == sorted(map(tuple, search.within_budget(made, F.col("n"), budget, ["key"], ["k"]).collect()))


def test_a_search_by_an_index_that_is_behind(spark, tmp_path):
    at = f"file://{tmp_path}/index"
    old = many(spark, [("home", "a", 1, "needle\nno"), ("home", "b", 1, "hay"), ("opt", "c", 1, "needle")])
    known = index_store.refresh(spark, at, old, unready=("opt",))
    now = many(spark, [("home", "a", 1, "needle\nno"), ("home", "b", 2, "hay\nneedle"), ("opt", "c", 1, "needle"), ("home", "d", 1, "needle")])
    hits, said = search.search_text(now, Search("needle"), verbose=True, index=known)
    assert [(r["path"], r["line_number"]) for r in hits.orderBy("path").collect()] == [("/home/a", 1), ("/home/b", 2), ("/home/d", 1), ("/opt/c", 1)]
    assert said.first()["n_hits"] == 4
