"""File scans, structured readers and the streamed index."""

import hashlib
import json

from pyspark.sql import functions as F

from lodestone.operators import trace
from lodestone.sources import files
from lodestone.streaming import incremental


def put(root, name, data):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())


def test_scans(spark, tmp_path):
    for name, data in {
        "README.md": "# Hi", "docs/a.md": "text", "docs/bad.md": b"\xff\xfe", "docs/big.md": "x" * 300_000, "node_modules/x/README.md": "no", "src/a.ts": "// @implements FR1\n", "src/a.d.ts": "no", "src/b.tsx": "x", "packages/p/README.md": "p", "t/x.inker": "{{{ a }}}",
    }.items():
        put(tmp_path, name, data)
    got = {r.file: (r.kind, r.package, r.content) for r in files.corpus(spark, str(tmp_path)).collect()}
    assert got == {"README.md": ("Readme", None, "# Hi"), "docs/a.md": ("Markdown", None, "text"), "docs/bad.md": ("Markdown", None, None), "docs/big.md": ("Markdown", None, None), "packages/p/README.md": ("Readme", "p", "p")}
    src = files.sources(spark, str(tmp_path))
    assert sorted(r.file for r in src.collect()) == ["src/a.ts", "src/b.tsx"]
    assert [(r.requirement, r.file, r.line) for r in trace.sites(files.traced_lines(src)).collect()] == [("FR1", "src/a.ts", 1)]
    assert [r.file for r in files.templates(spark, str(tmp_path)).collect()] == ["t/x.inker"]


def test_coverage_and_packages(spark):
    good = {"total": {p: {"pct": 81.26} for p in files.PARTS}}
    bad = {"total": {**good["total"], "lines": {}}}
    rows = spark.createDataFrame([(1, json.dumps(good)), (2, json.dumps(bad)), (3, "no json")], "k int, text string").select("k", files.coverage(F.col("text")).alias("c")).collect()
    assert [r.c and r.c.lines for r in sorted(rows)] == [81.3, None, None]
    made = files.packages(spark.createDataFrame([("p", '{"name": "@a/p", "main": "./lib/m.ts"}'), ("q", '{"name": "q"}')], "dir string, text string"), spark.createDataFrame([("p/lib/m.ts",), ("p/index.ts",)], "file string"))
    assert {(r.name, r.entry) for r in made.collect()} == {("@a/p", "p/lib/m.ts"), ("q", None)}


def test_manifest(spark):
    sha = hashlib.sha256(b"abc").hexdigest()
    found = spark.createDataFrame([("a", "abc"), ("b", "abcd"), ("c", "xyz")], "file string, content string")
    want = spark.createDataFrame([("a", 3, sha), ("b", 3, sha), ("c", 3, sha), ("d", 1, sha)], "file string, size int, sha256 string")
    assert {r.file: r.reason for r in files.verified(found, want).collect()} == {"b": "size", "c": "sha256", "d": "missing"}


def test_streamed_index(spark, tmp_path):
    schema = "file string, mtime bigint, content string"
    put(tmp_path, "in/1.json", '{"file":"a.md","mtime":1,"content":"x"}\n{"file":"b.md","mtime":1,"content":"y"}')
    stream = lambda: spark.readStream.schema(schema).json(str(tmp_path / "in"))
    state, check = str(tmp_path / "state"), str(tmp_path / "check")
    incremental.follow(stream(), state, check).awaitTermination()
    put(tmp_path, "in/2.json", '{"file":"a.md","mtime":2,"content":"z"}\n{"file":"b.md","mtime":1,"content":"changed"}')
    incremental.follow(stream(), state, check).awaitTermination()
    got = {r.file: r.mtime for r in incremental.current(spark, state).collect()}
    assert got == {"a.md": 2, "b.md": 1} and incremental.versions(spark, state) == [0, 1]
    incremental.follow(stream(), state, check).awaitTermination()
    assert incremental.versions(spark, state) == [0, 1]


def test_inside_follows_links(tmp_path):
    root = tmp_path / "root"
    root.mkdir()
    (tmp_path / "rooted").mkdir()
    (root / "out").symlink_to(tmp_path / "rooted")
    assert files.inside(str(root), str(root)) and files.inside(str(root / "a" / "b.ts"), str(root))
    assert not any(files.inside(str(p), str(root)) for p in (tmp_path / "rooted", root / "out" / "x", root / ".." / "x"))
