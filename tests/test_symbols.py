"""Ranked lookups."""

from lodestone.operators import symbols


def test_symbols(spark):
    files = spark.createDataFrame([("src/a.test.ts", "class A {}"), ("src/b.ts", "export class A { x() { function inner() {} } }\ntype T = 1;\nexport function f() {}"), ("src/c.ts", "interface A {}")], "file string, text string")
    found = symbols.symbols(files)
    assert sorted((r.name, r.kind) for r in found.filter("file = 'src/b.ts'").collect()) == [("A", "class"), ("T", "type"), ("f", "function")]
    top = symbols.explained(found, "A").first()
    assert (top.file, top.ambiguous) == ("src/b.ts", True) and symbols.explained(found, "none").count() == 0


def test_roots_and_versions(spark):
    tiers = spark.createDataFrame([(1, "x", False), (2, "y", True), (3, "z", True)], "tier int, path string, exists boolean")
    assert [r.path for r in symbols.plan_root(tiers).filter("used").collect()] == ["y"]
    packages = spark.createDataFrame([("a", "1.0", None), ("b", "2.0", True), ("c", "2.0", False)], "name string, version string, private boolean")
    assert tuple(symbols.versions_agree(packages, "1.0").first()) == (False, ["c"]) and symbols.versions_agree(packages, None).first().clean
