"""Tools over a small project on disk."""

import pytest

from lodestone.plans.tools import Project


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for name, text in {
        "packages/a/README.md": "# A\n## Entity\nEntity declaration decorator\n## Other\nwords",
        "_bmad-output/planning-artifacts/epics.md": "## Epic 1: One\n### Story 1.1: S\n## Epic 2: Two",
        "src/index.ts": 'import { b } from "./b";\nimport "reflect-metadata";\n// @implements FR37\nexport const a = db.query(`x ${b}`);',
        "src/b.ts": 'import { a } from "./index";\nrouter.get("/x", [C, "m"]);',
    }.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return Project(spark, str(root))


def test_tools(project):
    hit = project.docs_search("entity decorator").rows.first()
    assert hit.package == "a" and hit.kind == "Readme" and hit.score == 1.0
    assert project.docs_search("entity", kind="adr").rows.count() == 0 and project.docs_search("x").confidence == "low"
    assert project.docs_trace("FR37").known_gaps == [] and project.docs_trace("FR9").confidence == "medium"
    assert {r.node for r in project.dep_cycles().rows.collect()} == {"src/index.ts", "src/b.ts"}
    assert [(r.check, r.line) for r in project.security_scan().rows.collect()] == [("sql_interpolation", 4)]
    assert [r.name for r in project.introspect("route").rows.collect()] == ["/x"]
    assert [r.title for r in project.list_epics("_bmad-output/planning-artifacts/epics.md").rows.collect()] == ["One", "Two"]


def test_writing_needs_consent(project, spark, tmp_path):
    lines = spark.createDataFrame([(1, "  1-1-s: backlog")], "line int, text string")
    assert "dry run" in project.update_status(lines, "1-1-s", "done").known_gaps[0]
    project.update_status(lines, "1-1-s", "done", str(tmp_path / "out"), confirm=True)
    assert spark.read.text(str(tmp_path / "out")).first().value == "  1-1-s: done"


def test_tools_of_plans_and_packages(spark, tmp_path):
    for name, text in {
        "packages/a/package.json": '{"name": "@shop/a", "main": "src/index.ts"}',
        "packages/b/package.json": '{"name": "@shop/b"}',
        "packages/a/src/index.ts": 'import "@shop/b/util.js";\nexport const a = 1; // 1.1, FR-1',
        "packages/b/src/util.ts": 'import { a } from "@shop/a";',
        "packages/b/src/util.test.ts": "// 1.1",
        "planning/prd.md": "FR-1\nFR-2 and FR-3",
        "planning/epics.md": "## Epic 1: One\nFR-1\n### Story 1.1: S [done]\nFR-2.4\n### Story 1.2: T\n## Epic 2: Two\n### Story 2.1: U",
    }.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    project, plan = Project(spark, str(tmp_path)), "planning/epics.md"
    assert [tuple(r) for r in project.dep_graph("package").rows.collect()] == [("@shop/a", "@shop/b", 1), ("@shop/b", "@shop/a", 1)]
    assert {r.node for r in project.dep_cycles("package").rows.collect()} == {"@shop/a", "@shop/b"}
    assert any("color=red" in r.text for r in project.dep_graph("package", "dot").rows.collect())
    with pytest.raises(ValueError):
        project.dep_graph("folder")
    assert [(r.epic, r.number) for r in project.next_story(plan).rows.collect()] == [(1, 2)]
    assert [(r.epic, r.number) for r in project.next_story(plan, epic=2).rows.collect()] == [(2, 1)]
    assert [(r.kind, r.place, r.line) for r in project.trace("FR-1", plan).rows.collect()] == [("code", "packages/a/src/index.ts", 2), ("epic", "0", 2)]
    assert [(r.gap, r.id) for r in project.gap_report(plan).rows.collect()] == [("requirement without story", "FR-3"), ("story without code", "1.2"), ("story without code", "2.1"), ("story without test", "1.2"), ("story without test", "2.1")]
