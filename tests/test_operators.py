"""Operators on small inputs with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import chunking, clones, corpus, fulltext, graph, introspect, ledger, planning, rules, trace


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_hashes_and_slugs(spark):
    assert one(spark, "hello", tx.file_hash) == "2cf24dba5fb0a30e26e83b2ac5b9e29e"
    assert one(spark, "Hello, Wörld!", tx.slug) == "hello-w-rld"
    assert one(spark, "!!", tx.slug) == "x"
    assert one(spark, [], tx.slug_path, "array<string>") == "(root)"
    assert one(spark, ["A b", "C"], tx.slug_path, "array<string>") == "a-b>c"


def test_content_hash_is_little_endian(spark):
    import hashlib

    want = format(int.from_bytes(hashlib.sha256(b"hello").digest()[:8], "little"), "x")
    assert one(spark, "hello", tx.content_hash) == want


def test_excerpt_and_lines(spark):
    assert one(spark, "  a\tb\r", tx.excerpt) == "a    b"
    assert len(one(spark, "x" * 200, tx.excerpt)) == 120
    assert one(spark, "ab\ncd", lambda c: tx.line_of(c, F.lit(3))) == 2
    assert one(spark, "a\n\n// c\n/* b\n c */ d\n e", tx.loc) == 3
    assert one(spark, "postgres://u:secret@h/x at /root/p/f", lambda c: tx.redact(c, "/root/p")) == "postgres://u:***@h/x at <root>/f"


def test_corpus_rules(spark):
    paths = ["README.md", "docs/a/b.md", "packages/x/README.md", "packages/x/CORRECTIONS.md", "packages/x/docs/README.md", "_bmad-output/planning-artifacts/adr-1.md", "_bmad-output/planning-artifacts/x/e.md", "docs/a.txt", "src/README.md", "docs/node_modules/a.md", "docs/.git/a.md", "docs.md"]
    got = {r.file: (r.kind, r.package) for r in corpus.classify(spark.createDataFrame([(p,) for p in paths], "file string")).collect()}
    assert got == {
        "README.md": ("Readme", None), "docs/a/b.md": ("Markdown", None), "packages/x/README.md": ("Readme", "x"), "packages/x/CORRECTIONS.md": ("Markdown", "x"),
        "_bmad-output/planning-artifacts/adr-1.md": ("Adr", None), "_bmad-output/planning-artifacts/x/e.md": ("Bmad", None),
    }


def test_incremental_run_changes_nothing_twice(spark):
    files = spark.createDataFrame([("a.md", 10, "x"), ("b.md", 20, " ")], "file string, mtime bigint, content string")
    none = spark.createDataFrame([], "file string, mtime bigint")
    first = corpus.changes(files, none)
    assert corpus.statistics(first).first().files_indexed == 1
    state = corpus.merged(none, first)
    again = corpus.statistics(corpus.changes(files, state)).first()
    assert (again.files_indexed, again.files_unchanged, again.files_skipped) == (0, 1, 1)
    assert corpus.statistics(corpus.changes(files, state, full=True)).first().files_indexed == 1


def test_drift_reports_newer_and_gone(spark):
    state = spark.createDataFrame([("a.md", 1000), ("gone.md", 5), ("same.md", 7)], "file string, mtime bigint")
    disk = spark.createDataFrame([("a.md", 2000), ("same.md", 7), ("new.md", 1)], "file string, mtime bigint")
    assert sorted(tuple(r) for r in corpus.drift(state, disk).select("file", "stored_mtime", "current_mtime").collect()) == [("a.md", 1000, 2000), ("gone.md", 5, -1)]


def test_collision_names_the_second_file(spark):
    assert [r.file for r in corpus.collisions(spark.createDataFrame([("i", "b")], "id string, file string"), spark.createDataFrame([("i", "a")], "id string, file string")).collect()] == ["b"]


def test_sections():
    text = "intro\n# T\nlead\n## A\none\n```\n## no\n```\n### B\ntwo\n#### C\nthree\n## A\nfour"
    got = list(chunking.sections(text))
    assert [(p, s, e) for p, _, s, e in got] == [(["T"], 1, 4), (["T", "A"], 4, 9), (["T", "A", "B", "C"], 9, 13), (["T", "A"], 13, 14)]
    assert got[0][1] == "intro\nlead" and "## no" in got[1][1]


def test_chunk_ids_and_parts(spark):
    body = "\n\n".join("p" * 800 for _ in range(3))
    files = spark.createDataFrame([("a.md", f"## H\n{body}\n## I\nx\n## I\ny"), ("b.md", "plain")], "file string, content string")
    rows = chunking.chunked(files).orderBy("file", "ordinal").collect()
    assert rows[0].id.endswith(":h#0") and rows[1].id.endswith(":h#1") and rows[1].body.startswith("p" * 200 + "\n\n")
    assert rows[2].id.endswith(":i") and rows[3].id.endswith(":i~2") and rows[4].id.endswith(":(root)")
    assert rows[0].heading_path == ["H", "part-0"]


def test_marks(spark):
    lines = ["// @implements FR37, FR38 (both)", " * @implements FRx, MISS-, Story 1", "/* @implements Story 1.2.3 */", "@implements FR37 see notes", "Epic 4", "# @implements Epic 4"]
    df = spark.createDataFrame([("src/a.ts" if k else "tests/a.test.ts", k, t) for k, t in enumerate(lines)], "file string, line int, text string")
    assert sorted(r.requirement for r in trace.sites(df).collect()) == ["Epic 4", "FR37", "FR38", "Story 1.2.3"]
    assert sorted(r.requirement for r in trace.gaps(trace.index(df)).collect()) == ["FR37", "FR38"]


@pytest.mark.parametrize(("files", "total", "want"), [(10, 1024, 5), (3, 1024, 3), (10, 40, 2)])
def test_scan_budget(spark, files, total, want):
    df = spark.createDataFrame([(f"f{k}", 19) for k in range(5)], "file string, size bigint")
    assert trace.within_budget(df, files, total).count() == want


def test_plan(spark):
    text = ["## Epic 1: One [done]", "```", "### Story 1.9: no", "```", "### Story 1.2: B", "x", "### Story 2.1: orphan", "## Epic 2: Two", "### Story 2.1: C [review]"]
    lines = spark.createDataFrame([(0, k, t) for k, t in enumerate(text, 1)], "plan int, line int, text string")
    ends = lines.groupBy("plan").agg(F.max("line").alias("last_line"))
    found = planning.headings(lines)
    assert [tuple(r) for r in planning.epics(found, ends).orderBy("epic").select("epic", "title", "badge", "start_line", "end_line").collect()] == [(1, "One", "done", 1, 7), (2, "Two", None, 8, 9)]
    status = ["development_status:", "  epic-1: review", "  1-2-b: in-progress # c", "  1-2-c: done", "  1-2-b: backlog", "other: x", "  2-1-c: done"]
    keys = planning.statuses(spark.createDataFrame([(0, k, t) for k, t in enumerate(status, 1)], "plan int, line int, text string"))
    rows = planning.story_status(planning.stories(found, ends), keys)
    assert sorted((r.epic, r.number, r.status) for r in rows.collect()) == [(1, 2, "backlog"), (2, 1, "review")]
    nxt = planning.next_story(rows).first()
    assert (nxt.epic, nxt.number) == (1, 2)


def test_status_rewrite_keeps_everything_else(spark):
    lines = spark.createDataFrame([(1, "a: 1"), (2, "  k:  old # note"), (3, "  k: second")], "line int, text string")
    assert [r.text for r in planning.rewritten_status(lines, "k", "done").orderBy("line").collect()] == ["a: 1", "  k:  done # note", "  k: second"]
    with pytest.raises(ValueError, match="status"):
        planning.rewritten_status(lines, "k", "nope")


def test_references(spark):
    df = spark.createDataFrame([("f", "see 33.7. and v1.33.7, but 1.1 here")], "file string, text string")
    assert {r.id for r in planning.story_refs(df).collect()} == {"33.7.", "1.33.7", "1.1"}
    hit = lambda t: spark.createDataFrame([(t,)], "t string").select(planning.mentions(F.col("t"), F.lit("FR-7"))).first()[0]
    assert hit("FR-7.1") and not hit("FR-70") and not hit("NFR-7")


LINKS = [("a", "b"), ("b", "a"), ("b", "c"), ("d", "d"), ("c", "e"), ("e", "f"), ("f", "c"), ("g", "a")]


@pytest.mark.parametrize("small", [100, 2])
def test_cycles(spark, small):
    got = {tuple(r) for r in graph.cycles(spark.createDataFrame(LINKS, "src string, dst string"), small).collect()}
    assert got == {("a", "a"), ("a", "b"), ("c", "c"), ("c", "e"), ("c", "f"), ("d", "d")}


def test_resolution_and_owners(spark):
    files = spark.createDataFrame([("p/src/a.ts",), ("p/src/b.ts",), ("p/src/b/index.ts",), ("p/q/c.tsx",)], "file string")
    imports = spark.createDataFrame([("p/src/a.ts", "./b"), ("p/src/a.ts", "./b.js"), ("p/src/a.ts", "../q/c"), ("p/src/a.ts", "./none"), ("p/src/a.ts", "lib")], "file string, specifier string")
    assert {r.specifier: r.target for r in graph.resolved(imports, files).collect()} == {"./b": "p/src/b.ts", "./b.js": "p/src/b.ts", "../q/c": "p/q/c.tsx"}
    owners = graph.owners(files, spark.createDataFrame([("outer", "p"), ("inner", "p/q")], "name string, dir string"))
    assert {r.file: r.name for r in owners.collect()}["p/q/c.tsx"] == "inner"


def test_clone_runs(spark):
    words = [str(k) for k in range(30)]
    df = spark.createDataFrame([("a", words), ("b", ["x", *words[:25], "y"])], "file string, words array<string>")
    assert [tuple(r) for r in clones.runs(clones.windows(df, 20), 20).collect()] == [("a", 1, "b", 2, 25)]
    assert one(spark, [1, 5, 12, 30], lambda c: clones.apart(c, F.lit(10)), "array<int>") == [1, 12, 30]


def test_rules(spark):
    lines = spark.createDataFrame([("f", 2, "raw(x) and raw(y)"), ("e", 1, "ok")], "file string, line int, text string")
    found = rules.scan(lines, [("raw", "high", "raw("), ("ok", "low", "ok")])
    assert [(r.check, r.line) for r in rules.ordered(found).collect()] == [("raw", 2), ("ok", 1)]
    with pytest.raises(ValueError, match="unknown"):
        rules.scan(lines, [("raw", "high", "raw(")], ["nope"])


def test_groups_and_events(spark):
    routes = spark.createDataFrame([("f", 5, "/x"), ("f", 50, "/y")], "file string, pos int, path string")
    groups = spark.createDataFrame([("f", 1, 10, "/api"), ("f", 3, 8, "/v2")], "file string, start int, stop int, prefix string")
    assert {r.path for r in introspect.grouped_routes(routes, groups).collect()} == {"/api/v2/x", "/y"}
    a, b = spark.createDataFrame([("e", "s1")], "event string, place string"), spark.createDataFrame([("e", "m1"), ("z", "m2")], "event string, place string")
    assert {r.event: (r.subscribers, r.emitters) for r in introspect.paired_events(a, b).collect()} == {"e": (["s1"], ["m1"]), "z": ([], ["m2"])}


def test_rollback_counts_numbers_or_batches(spark):
    led = spark.createDataFrame([("a", 1, "d"), ("b", 3, "d"), ("c", 5, "d")], "name string, batch int, executed_at string")
    assert {r.name for r in ledger.rollback(led, 2).collect()} == {"c"}
    assert {r.name for r in ledger.rollback(led, 2, preview=False).collect()} == {"b", "c"}
    assert ledger.rollback(led.limit(0), 2).count() == 0


def test_search_edges(spark):
    df = spark.createDataFrame([(1, "p", "K", "h", "foo bar"), (2, "p", "K", "h", "foobar baz")], "id bigint, package string, kind string, heading string, body string")
    assert [r.id for r in fulltext.bm25(df, "foo.bar").collect()] == [2]
    assert fulltext.bm25(df, "...").count() == 0
    assert [r.id for r in fulltext.bm25(df, "foo-bar").collect()] == [1]
    assert fulltext.confidence(True, False) == "medium"


def test_status_keys_are_checked(spark):
    lines = spark.createDataFrame([(0, 1, "  k: old"), (1, 1, "  k: old")], "plan int, line int, text string")
    assert {r.text for r in planning.rewritten_status(lines, "k", "done", "plan").collect()} == {"  k: done"}
    for key in ("a.c", "", "k:"):
        with pytest.raises(ValueError):
            planning.rewritten_status(lines, key, "done")


def test_get_story_prefers_its_own_file(spark):
    text = ["## Epic 1: One", "### Story 1.1: A", "first", "### Story 1.2: B", "second"]
    lines = spark.createDataFrame([(0, k, t) for k, t in enumerate(text, 1)], "plan int, line int, text string")
    ends = lines.groupBy("plan").agg(F.max("line").alias("last_line"))
    none = spark.createDataFrame([], "plan int, key string, value string, position int")
    rows = planning.story_texts(planning.story_status(planning.stories(planning.headings(lines), ends), none), lines)
    own = planning.artifacts(spark.createDataFrame([("x/1-1-a.md", "# Own title\nStatus: review\nmore"), ("x/notes.md", "# N")], "file string, text string"))
    assert tuple(planning.get_story("1.1", own, rows).first()) == ("implementation-artifact", "1.1", "Own title", "review", "# Own title\nStatus: review\nmore")
    assert tuple(planning.get_story("1.2", own, rows).first()) == ("epic-section", "1.2", "B", "backlog", "### Story 1.2: B\nsecond")
    assert planning.get_story("9.9", own, rows).count() == 0
    with pytest.raises(ValueError):
        planning.get_story("1-2", own, rows)


def test_clashing_files_fail_alone(spark):
    files = spark.createDataFrame([("a.md", 10, "x"), ("b.md", 20, "y")], "file string, mtime bigint, content string")
    changed = corpus.failed(corpus.changes(files, spark.createDataFrame([], "file string, mtime bigint")), spark.createDataFrame([("b.md",)], "file string"))
    row = corpus.statistics(changed).first()
    assert (row.files_indexed, row.files_failed) == (1, 1)


def test_clones_of_few_lines_or_on_themselves_are_left_out(spark):
    words = [f"w{k}" for k in range(30)]
    tokens = spark.createDataFrame([("a", words, list(range(1, 31))), ("b", words, list(range(5, 35))), ("c", words, [1] * 30), ("d", ["x"] * 60, list(range(60)))], "file string, words array<string>, lines array<int>")
    got = clones.long_enough(clones.runs(clones.windows(tokens)), tokens).collect()
    assert {(r.file_a, r.file_b, r.line_a, r.last_line_b) for r in got if r.file_a != "d"} == {("a", "b", 1, 34)}
    assert all(r.line_b - r.line_a >= r.tokens for r in got if r.file_a == "d")


def test_rolled_windows_tell_runs_apart(spark):
    df = spark.createDataFrame([(list(range(50)),), ([7] * 50,), ([1, 2],), ([],)], "marks array<bigint>")
    for k in (1, 2, 3, 7, 20, 32):
        rows = [r[0] for r in df.select(clones.rolled(df.marks, k)).collect()]
        assert [len(r) for r in rows] == [51 - k, 51 - k, max(0, 3 - k), 0]
        assert len(set(rows[0])) == 51 - k and len(set(rows[1])) == 1 and (k != 2 or rows[2][0] == rows[0][1])


def test_targets_by_package_name(spark):
    files = spark.createDataFrame([(f,) for f in ("p/a/src/x.ts", "p/a/src/x/index.ts", "p/a/y.tsx", "p/a/src/index.ts", "p/b/src/m.ts", "p/b/src/n.mts")], "file string")
    packages = spark.createDataFrame([("@s/a", "p/a", "p/a/src/index.ts"), ("b", "p/b", None)], "name string, dir string, entry string")
    asked = [("p/b/src/m.ts", s) for s in ("@s/a", "@s/a/x", "@s/a/y.js", "@s/a/none", "b", "b/n.mjs", "fs", "./n", "../../a/src/x")]
    found = graph.targets(spark.createDataFrame(asked, "file string, specifier string"), packages, files)
    assert {r.specifier: r.target for r in found.collect()} == {"@s/a": "p/a/src/index.ts", "@s/a/x": "p/a/src/x.ts", "@s/a/y.js": "p/a/y.tsx", "b/n.mjs": "p/b/src/n.mts", "../../a/src/x": "p/a/src/x.ts"}
    assert [tuple(r) for r in graph.package_edges(found, packages).collect()] == [("b", "@s/a", 1)]
    counts = graph.cycles_per_node(spark.createDataFrame([("a", "a"), ("a", "b"), ("a", "b")], "component string, node string"))
    assert sorted(tuple(r) for r in counts.collect()) == [("a", 1), ("b", 1)]


def test_gaps_and_traces_of_plans(spark):
    text = ["# P", "## Epic 1: One", "covers FR-7.1", "### Story 1.1: A", "NFR-2", "### Story 1.2: B", "FR-70"]
    lines = spark.createDataFrame([("p", k, t) for k, t in enumerate(text, 1)], "plan string, line int, text string")
    ends, found = lines.groupBy("plan").agg(F.max("line").alias("last_line")), planning.headings(lines)
    wanted = spark.createDataFrame([("FR-7", 1), ("FR-2", 2), ("NFR-2", 3), ("FR-70", 4), ("FR-8", 5)], "id string, line int")
    assert {r.id for r in planning.unmentioned(wanted, lines).collect()} == {"FR-2", "FR-8"}
    files = spark.createDataFrame([("a.ts", "x\n1.1 FR-7\nFR-7"), ("t/a.test.ts", "FR-7 1.1"), ("b.ts", "1.2. FR-70"), ("c.ts", None)], "file string, text string")
    assert [(r.number, r.in_code, r.in_tests) for r in planning.story_gaps(planning.stories(found, ends), files).collect()] == [(2, False, False)]
    hits = planning.requirement_trace("FR-7", lines, ends, found, files)
    assert sorted(tuple(r) for r in hits.collect()) == [("code", "a.ts", "", 2), ("epic", "p", "1", 3), ("test", "t/a.test.ts", "", 1)]


def test_imports_are_not_multiplied_by_their_candidates(spark):
    paths = [f"{d}/{n}{e}" for d in ("p/a", "p/a/src", "p/a/src/src") for n in ("x", "x.js", "y", "src") for e in ("", ".ts", ".tsx", ".js", ".mjs", ".mts", ".cts", "/index.ts", "/index.tsx", "/index.js")]
    listed = [p for k, p in enumerate(paths) if k % 3 != 1]
    files = spark.createDataFrame([(p,) for p in listed], "file string")
    inner = sorted({n + e for n in ("x", "x.js", "y", "src", "src/x", "z") for e in ("", ".js", ".mjs", ".cjs", ".ts")})
    asked = [("p/a/src/q.ts", at + i) for i in inner for at in ("./", "../", "@s/a/")]
    imports = spark.createDataFrame(asked, "file string, specifier string")

    def first(specifier):
        bare = lambda x: x[: -len(x.split(".")[-1]) - 1] if x.endswith((".js", ".mjs", ".cjs")) else x
        if specifier.startswith("@"):
            i = specifier[5:]
            tried = [f"p/a{at}{n}{e}" for at in graph.INSIDE for n, ends in ((i, graph.GIVEN), (bare(i), graph.WITHOUT), (i, graph.FOLDER)) for e in ends]
        else:
            b = "p/a/src/" + specifier[2:] if specifier.startswith("./") else "p/a/" + specifier[3:]
            tried = [b + e for e in graph.RELATIVE] + [bare(b) + e for e in graph.SWAPPED if bare(b) != b] + [b + e for e in graph.INDEX]
        return next((x for x in tried if x in listed), None)

    found = graph.targets(imports, spark.createDataFrame([("@s/a", "p/a", None)], "name string, dir string, entry string"), files).collect()
    assert sorted((r.specifier, r.target) for r in found) == sorted((s, t) for _, s in asked if (t := first(s)))
    assert graph._tries(imports, "specifier").count() == len(asked) + sum(s.endswith((".js", ".mjs", ".cjs")) for _, s in asked)


@pytest.mark.parametrize("k", [1, 2, 5, 20])
def test_windows_in_spans_equal_plain_windows(spark, k):
    import random

    rng = random.Random(k)
    texts = {f"f{n}": [rng.choice("abc" if n % 3 else "abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(60))] for n in range(24)}
    texts |= {"same": ["x"] * (k + 2), "turns": ["y", "z"] * k, "alone": [str(n) for n in range(50)], "copy": texts["f3"], "short": ["q"], "empty": []}
    places = {}
    for f, words in texts.items():
        for i in range(len(words) - k + 1):
            places.setdefault(tuple(words[i : i + k]), []).append((f, i + 1))
    want = sorted(x for found in places.values() if len(found) > 1 for x in found)
    df = spark.createDataFrame(list(texts.items()), "file string, words array<string>")
    assert sorted((r.file, r.start) for r in clones.windows(df, k).collect()) == want
    marks = df.select("file", F.transform("words", lambda w: F.xxhash64(w)).alias("marks"))
    assert "alone" not in {r.file for r in clones._likely(marks, k).collect()}


def test_import_targets_sends_no_listing_through_the_driver(spark):
    from conftest import SF

    from lodestone import catalog

    assert "Broadcast" not in catalog.QUERIES["import_targets"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_keys_of_imports_keep_names_and_paths_apart(spark):
    files = spark.createDataFrame([(p,) for p in ("a.ts", "b.ts", "p/src/b.ts", "p/src/d/index.ts", "q/b.ts", "r/b.ts")], "file string")
    packages = spark.createDataFrame([("x", "p", "p/src/b.ts"), ("x/y", "q", "q/b.ts"), ("@s", "r", "r/b.ts"), ("./b", "q", "q/b.ts"), (None, "r", None)], "name string, dir string, entry string")
    asked = [("a.ts", "./b"), ("a.ts", "x"), ("a.ts", "x/"), ("a.ts", "x/b.mjs"), ("a.ts", "x/d"), ("a.ts", "x/y"), ("a.ts", "x/y/b"), ("a.ts", "@s"), ("a.ts", "@s/b"), ("p/src/d/index.ts", "..//./b.js"), ("p/src/d/index.ts", "."), ("p/src/d/index.ts", None)]
    found = graph.targets(spark.createDataFrame(asked, "file string, specifier string"), packages, files).collect()
    assert sorted(tuple(r)[1:] for r in found) == [(".", "p/src/d/index.ts"), ("..//./b.js", "p/src/b.ts"), ("./b", "b.ts"), ("@s", "r/b.ts"), ("x", "p/src/b.ts"), ("x/", "p/src/b.ts"), ("x/b.mjs", "p/src/b.ts"), ("x/d", "p/src/d/index.ts")]


def test_dep_packages_reads_the_imports_once_and_broadcasts_nothing(spark):
    from conftest import SF

    from lodestone import catalog

    plan = catalog.QUERIES["dep_packages"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and sum("FileScan" in x and "l_linenumber" in x for x in plan.splitlines()) == 1


def test_rounds_of_cycles_and_reports_broadcast_nothing(spark, monkeypatch):
    plans, written = [], graph._written
    note = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(graph, "_written", lambda df: (note(df), written(df))[1])
    note(graph.cycles(spark.createDataFrame(LINKS, "src string, dst string"), 0))
    frame = lambda rows, schema: spark.createDataFrame(rows, schema).coalesce(1)
    files = frame([("p/a.ts", 3)], "file string, loc int")
    note(graph.package_report(files, frame([("p", "p")], "name string, dir string"), frame([("p/a.ts", "x")], "file string, export string"), frame([("p", 1)], "node string, cycles int"), frame([("p", 5)], "name string, coverage int")))
    assert len(plans) > 5 and not any("Broadcast" in p for p in plans)
