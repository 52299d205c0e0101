"""Registered queries over derived source files and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import code_rules, facts, graph
from lodestone.plans.inputs import table
from lodestone.sources import typescript

#: One file per order; its text depends on the key alone.
TEXT = """case o_orderkey % 8 when 0 then concat('const q = db.query(`select ${', 'id', o_custkey, '}`);')
 when 1 then 'const a = 1;\ndefineConfig({ csrf: false });' when 2 then concat('\n\nconst h = rawHtml`<b>$', '{v}</b>`;') when 3 then 'res.cookie("a", "b", { secure: true, sameSite: "lax" });\nres.cookie("c", "d", { secure: true });'
 when 4 then concat('// db.query(`x $', '{y}`)\nconst s = "db.query(`x $', '{y}`)";') when 5 then concat('import { b } from "./f', o_orderkey + 1, '";\nexport * from "./f', o_orderkey - 1, '.js";\nimport type { T } from "./f0";')
 when 6 then concat('router.group(() => {\n router.get("/r', o_orderkey, '", [C', o_custkey % 10, ', "index"]);\n}).prefix("/g', o_custkey % 7, '");') else concat('db.execute("delete from t where id = " + id', o_custkey, ');') end"""


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("concat('src/m', o_orderkey % 20, '/f', o_orderkey, '.ts') as file", f"{TEXT.replace(chr(10) + ' when', ' when')} as text", "o_orderkey")


def code_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_rules.scan_code(code_files(spark, sf_dir).select("file", "text")).select("check", "severity", "file", "line", "excerpt")


def code_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = facts.facts(code_files(spark, sf_dir), ("route",))
    return found.select("file", "line", F.col("name").alias("path"), F.get_json_object("detail", "$.method").alias("method"), F.get_json_object("detail", "$.controller").alias("controller"), F.get_json_object("detail", "$.action").alias("action"))


def code_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports between files of one folder, resolved to the files that exist."""
    files = code_files(spark, sf_dir).select(F.concat(F.lit("src/"), F.element_at(F.split("file", "/"), -1)).alias("file"), "text")
    return graph.resolved(typescript.import_table(files), files)


def file_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in nested packages."""
    files = table(spark, sf_dir, "orders").selectExpr("concat('p', o_custkey % 9, case when o_orderkey % 3 = 0 then concat('/q', o_orderkey % 5) else '' end, '/src/f', o_orderkey, '.ts') as file")
    packages = table(spark, sf_dir, "supplier").filter("s_suppkey <= 40").selectExpr("concat('pkg', s_suppkey) as name", "concat('p', s_suppkey % 7, case when s_suppkey > 7 then concat('/q', s_suppkey % 4) else '' end) as dir").groupBy("dir").agg(F.min("name").alias("name"))
    return graph.owners(files, packages)


QUERIES = {f.__name__: f for f in (code_scan, code_routes, code_imports, file_owners)}
_FILE = "'src/m' || (o_orderkey % 20) || '/f' || o_orderkey || '.ts'"
SQL = {
    "code_scan": f"""SELECT 'sql_interpolation' AS "check", 'high' AS severity, {_FILE} AS file, 1::INT AS line, 'const q = db.query(`select ${{id' || o_custkey || '}}`);' AS excerpt FROM orders WHERE o_orderkey % 8 = 0
UNION ALL SELECT 'csrf_disabled', 'high', {_FILE}, 2, 'defineConfig({{ csrf: false }});' FROM orders WHERE o_orderkey % 8 = 1
UNION ALL SELECT 'xss_html_raw_output', 'medium', {_FILE}, 3, 'const h = rawHtml`<b>${{v}}</b>`;' FROM orders WHERE o_orderkey % 8 = 2
UNION ALL SELECT 'cookie_missing_flags', 'low', {_FILE}, 2, 'res.cookie("c", "d", {{ secure: true }});' FROM orders WHERE o_orderkey % 8 = 3
UNION ALL SELECT 'sql_interpolation', 'high', {_FILE}, 1, 'db.execute("delete from t where id = " + id' || o_custkey || ');' FROM orders WHERE o_orderkey % 8 = 7""",
    "code_routes": f"SELECT {_FILE} AS file, 2::INT AS line, '/g' || (o_custkey % 7) || '/r' || o_orderkey AS path, 'GET' AS method, 'C' || (o_custkey % 10) AS controller, 'index' AS action FROM orders WHERE o_orderkey % 8 = 6",
    "code_imports": """SELECT 'src/f' || a.o_orderkey || '.ts' AS file, s AS specifier, 'src/f' || b.o_orderkey || '.ts' AS target
FROM (SELECT o_orderkey, o_orderkey + 1 AS t, './f' || (o_orderkey + 1) AS s FROM orders WHERE o_orderkey % 8 = 5 UNION ALL SELECT o_orderkey, o_orderkey - 1, './f' || (o_orderkey - 1) || '.js' FROM orders WHERE o_orderkey % 8 = 5) a JOIN orders b ON b.o_orderkey = a.t""",
    "file_owners": """WITH f AS (SELECT 'p' || (o_custkey % 9) || CASE WHEN o_orderkey % 3 = 0 THEN '/q' || (o_orderkey % 5) ELSE '' END || '/src/f' || o_orderkey || '.ts' AS file FROM orders),
p AS (SELECT dir, min(name) AS name FROM (SELECT 'pkg' || s_suppkey AS name, 'p' || (s_suppkey % 7) || CASE WHEN s_suppkey > 7 THEN '/q' || (s_suppkey % 4) ELSE '' END AS dir FROM supplier WHERE s_suppkey <= 40) GROUP BY dir)
SELECT file, arg_max(name, len(dir)) AS name FROM f JOIN p ON starts_with(file, dir || '/') GROUP BY file""",
}
SQL["code_scan"] = SQL["code_scan"].replace("{{", "{").replace("}}", "}")
