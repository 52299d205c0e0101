"""TypeScript tokens, imports, clones and rules."""

import pytest

from lodestone.operators import clones, code_rules
from lodestone.sources import typescript as ts

DIRTY = '''import x from "y";
const q = db.query(`select ${id}`);
db?.execute("a" + b.c);
db.query(sql`safe ${x}`);
const h = unsafeHtml`<b>${v}</b>`;
defineConfig({ csrf: { enabled: false } });
res.cookie("a", "b", { secure: true });
ctx.cookies.set("a", "b", { secure: true, sameSite: "lax", httpOnly: false });
res.cookie("a", "b", { ...opts });
@Controller("/u")
class Users {
  @Post("/") create() { throw new Error("x"); }
  @UseGuards(G) @Delete("/:id") drop() {}
  @Get("/") list() { return [1, 2]; }
}
'''


def test_tokens():
    kinds = [(t.kind, t.text) for t in ts.tokenize("let a = /x[/]/g; // c\nb / 2 /* d */ `t${`u${1}`}`")]
    assert ("regex", "/x[/]/g") in kinds and ("template", "`t${`u${1}`}`") in kinds and not any("c" == t for _, t in kinds)
    assert ts.tokenize("a\n\nb")[1].line == 3 and ts.tokenize("f(a[1])")[1].match == 6
    assert ts.normalised(ts.tokenize("const aa = bb + 1")) == ["const", "$", "=", "$", "+", "1"]


def test_specifiers():
    text = 'import "a"; import b from "b"; import type { C } from "c"; import { type D } from "d"; export * from "./e"; export { f } from "./f"; const g = import("g"); export const h = 1; export type { I } from "i";'
    assert ts.specifiers(ts.tokenize(text)) == ["a", "b", "d", "./e", "./f"]


def test_rules(spark):
    files = spark.createDataFrame([("src/index.ts", DIRTY), ("src/main.ts", 'import "reflect-metadata";\n'), ("src/clean.ts", "export const a = 1;")], "file string, text string")
    got = sorted((r.check, r.file, r.line) for r in code_rules.scan_code(files).collect())
    assert got == [
        ("cookie_missing_flags", "src/index.ts", 7), ("cookie_missing_flags", "src/index.ts", 8), ("csrf_disabled", "src/index.ts", 6), ("missing_guard_on_mutation_route", "src/index.ts", 12),
        ("raw_error_not_structured", "src/index.ts", 12), ("sql_interpolation", "src/index.ts", 2), ("sql_interpolation", "src/index.ts", 3), ("xss_html_raw_output", "src/index.ts", 5),
    ]
    only = code_rules.scan_code(files.filter("file = 'src/index.ts'"), ["reflect_metadata_missing"]).collect()
    assert [(r.line, r.rank, len(r.id)) for r in only] == [(1, 2, 16)]
    with pytest.raises(ValueError, match="unknown"):
        code_rules.scan_code(files, ["nope"])


def test_renamed_clone(spark):
    body = "function {0}({1}) {{ const {2} = {1} + 1; if ({2} > 2) {{ return {2}; }} return 0; }}"
    files = spark.createDataFrame([("a.ts", body.format("f", "x", "y")), ("b.ts", body.format("g", "p", "q"))], "file string, text string")
    runs = clones.runs(clones.windows(ts.token_table(files), 20), 20).collect()
    assert len(runs) == 1 and runs[0].tokens == len(ts.tokenize(body.format("f", "x", "y")))
