"""Registered planning, graph, clone, rule, introspection and ledger queries and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import clones, graph, introspect, ledger, planning, rules
from lodestone.plans.inputs import table

PLAN_TEXT = """case when o_orderkey % 40 = 0 then concat('## Epic ', o_orderkey div 40, ': Title ', o_custkey, case when o_orderkey % 80 = 0 then ' [in-progress]' else '' end)
 when o_orderkey % 40 = 1 then '```' when o_orderkey % 40 = 3 then '```' when o_orderkey % 4 = 2 then concat('### Story ', (o_orderkey div 40) + (case when o_orderkey % 44 = 2 then 1 else 0 end), '.', o_orderkey % 40, ': Do ', o_custkey, case when o_orderkey % 3 = 0 then ' [done]' else '' end)
 else concat('text ', o_custkey) end"""
PLAN_SQL = """CASE WHEN o_orderkey % 40 = 0 THEN '## Epic ' || (o_orderkey // 40) || ': Title ' || o_custkey || CASE WHEN o_orderkey % 80 = 0 THEN ' [in-progress]' ELSE '' END
 WHEN o_orderkey % 40 = 1 THEN '```' WHEN o_orderkey % 40 = 3 THEN '```' WHEN o_orderkey % 4 = 2 THEN '### Story ' || ((o_orderkey // 40) + (CASE WHEN o_orderkey % 44 = 2 THEN 1 ELSE 0 END)) || '.' || (o_orderkey % 40) || ': Do ' || o_custkey || CASE WHEN o_orderkey % 3 = 0 THEN ' [done]' ELSE '' END
 ELSE 'text ' || o_custkey END"""


def plan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lines of plans of 1000 lines each."""
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey div 1000 as plan", "cast(o_orderkey % 1000 as int) as line", f"{PLAN_TEXT} as text")


def _ends(lines: DataFrame) -> DataFrame:
    return lines.groupBy("plan").agg(F.max("line").alias("last_line"))


def status_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A status file per plan, from orders: a header, keys of stories and epics, and pairs after the block."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey div 1000 as plan", "cast(o_orderkey % 1000 as int) as line",
        """case when o_orderkey % 1000 = 0 then 'development_status:' when o_orderkey % 1000 > 900 then concat(case when o_orderkey % 1000 = 901 then '' else '  ' end, 'other', o_orderkey, ': x')
        when o_orderkey % 5 = 0 then concat('  epic-', o_orderkey div 40, ': ', case when o_orderkey % 3 = 0 then 'done' else 'review' end)
        when o_orderkey % 2 = 0 then concat('  ', o_orderkey div 40, '-', o_orderkey % 40, '-slug', o_custkey, ': ', element_at(array('done', 'review', 'backlog'), cast(o_custkey % 3 as int) + 1), ' # note') else '  # nothing' end as text""",
    )


def _story_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = plan_lines(spark, sf_dir)
    rows = planning.stories(planning.headings(lines), _ends(lines))
    return planning.story_status(rows, planning.statuses(status_lines(spark, sf_dir)))


def epics_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = plan_lines(spark, sf_dir)
    found = planning.headings(lines)
    rows = planning.epic_status(planning.epics(found, _ends(lines)), planning.statuses(status_lines(spark, sf_dir)))
    counts = planning.stories(found, _ends(lines)).groupBy("plan", "epic").agg(F.count("*").alias("stories"))
    return rows.join(counts, ["plan", "epic"], "left").select("plan", "epic", "title", "status", "start_line", "end_line", F.coalesce("stories", F.lit(0)).alias("stories"))


def story_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _story_rows(spark, sf_dir).select("plan", "epic", "number", "title", "status", "start_line", "end_line")


def next_story(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.next_story(_story_rows(spark, sf_dir))


def status_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.rewritten_status(status_lines(spark, sf_dir), "epic-25", "done", "plan")


def story_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each story's part of its plan."""
    lines = plan_lines(spark, sf_dir)
    rows = planning.stories(planning.headings(lines), _ends(lines)).select("plan", "epic", "number", "title", "start_line", "end_line")
    return planning.story_texts(rows, lines)


def gap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of products that no document holds as a whole number."""
    ids = table(spark, sf_dir, "part").select(F.concat(F.col("p_size"), F.lit("."), F.col("p_partkey") % 100).alias("id")).unionByName(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"))).distinct()
    refs = planning.story_refs(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), "text"))
    return ids.join(refs, "id", "left_anti")


def requirement_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage, with the line of its first place."""
    docs, passages = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    # A passage may begin and end inside words of a document, but the words between its first and last are whole there: up to five
    # of them against each run of as many words of a document; texts join again only for the hits. Passages without any are tried everywhere.
    key = lambda w, i, n: F.xxhash64(F.array_join(F.slice(w, i, n), " "))
    items = passages.filter("passage is not null").groupBy("passage").agg(F.collect_list(F.struct("item_id")).alias("items"))
    split = items.withColumn("words", F.split("passage", "[ \n]")).withColumn("n", F.least(F.lit(5), F.size("words") - 2))
    lengths = sorted(r["n"] for r in split.select("n").distinct().collect())  # -1 to 5
    keyed = split.filter("n > 0").select("passage", "items", key(F.col("words"), F.lit(2), F.col("n")).alias("key"))
    words = docs.select("doc_id", F.explode(F.array(F.split("text", "[ \n]"))).alias("words"))  # stays one column, see clones.windows

    def keys_of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - n + 1))
        return F.transform(starts, lambda i: key(F.col("words"), i, F.lit(n)))

    whole = [keys_of(n) for n in lengths if n > 0]
    keys = words.select("doc_id", F.explode(F.array_distinct(F.concat(*whole) if whole else F.array().cast("array<bigint>"))).alias("key"))
    hits = keys.join(keyed, "key").select(F.col("doc_id").alias("_doc"), "passage", "items").distinct()
    found = docs.join(hits, F.col("doc_id").eqNullSafe(F.col("_doc"))).drop("_doc").filter(F.contains("text", F.col("passage")))
    if lengths and lengths[0] < 1:
        found = found.unionByName(docs.join(split.filter("n < 1").select("passage", "items"), F.contains("text", F.col("passage"))))
    lines = found.select("doc_id", "items", tx.line_of(F.col("text"), F.call_function("instr", F.col("text"), F.col("passage")) - 1).alias("line"))
    return lines.select("doc_id", F.explode("items").alias("item"), "line").select("item.item_id", "doc_id", "line")


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as imports between parts of one group of 16; the groups grow with the table."""
    return table(spark, sf_dir, "lineitem").selectExpr("concat('p', l_partkey) as src", "concat('p', l_partkey - l_partkey % 16 + l_suppkey % 16) as dst", "l_orderkey as importer")


def dep_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges(imports(spark, sf_dir))


def sparse_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as links to the next one or back to the first of eight."""
    return table(spark, sf_dir, "orders").selectExpr("concat('n', o_orderkey) as src", "concat('n', case when o_custkey % 3 = 0 then o_orderkey - o_orderkey % 8 else o_orderkey + 1 end) as dst")


def dep_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cycles(sparse_links(spark, sf_dir))


def dep_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = graph.edges(imports(spark, sf_dir))
    return graph.dot(links, graph.cycles(links.select("src", "dst"))).select("section", "text")


def clone_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.split(F.coalesce("text", F.lit("")), "[ \n]").alias("words"))
    return clones.groups(clones.windows(docs))


def clone_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.split(F.coalesce("text", F.lit("")), "[ \n]").alias("words"))
    return clones.runs(clones.windows(docs))


def package_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = docs.join(labels, "doc_id", "left").select("source", tx.loc(F.coalesce("text", F.lit(""))).alias("loc"), "lang", "quality", "toxic")
    return rows.groupBy("source").agg(F.count("*").alias("files"), F.sum("loc").alias("loc"), F.countDistinct("lang").alias("exports"), F.count_if(F.col("toxic") == 1).alias("lint_issues"), F.round(F.avg("quality") * 100, 1).alias("coverage"))


RULES = [("raw_script", "high", "<script"), ("nav_link", "low", "href="), ("style_block", "medium", "<style"), ("heading", "low", "<h1")]


def rule_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("page"), "page_id").alias("file"), F.posexplode(F.split("html", ">")).alias("line", "text"))
    return rules.scan(pages, RULES)


def events_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.concat(F.lit("e"), F.col("event_id") % 500).alias("event"), F.concat(F.lit("u"), "user_id").alias("place"), "event_type")
    both = introspect.paired_events(events.filter("event_type = 'signup'"), events.filter("event_type = 'purchase'"))
    return both.select("event", F.array_join("subscribers", ",").alias("subscribers"), F.array_join("emitters", ",").alias("emitters"))


def route_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    groups = orders.filter("o_orderkey % 2 = 0").selectExpr("o_custkey as file", "o_orderkey % 1000 as start", "o_orderkey % 1000 + o_custkey % 300 as stop", "concat('/g', o_orderkey) as prefix")
    routes = orders.filter("o_orderkey % 2 = 1").selectExpr("o_custkey as file", "o_orderkey * 2000 + o_orderkey % 1000 as pos0", "o_orderkey").selectExpr("file", "pos0 % 2000 as pos", "concat('/r', o_orderkey) as path")
    return introspect.grouped_routes(routes.groupBy("file", "pos").agg(F.min("path").alias("path")), groups)


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.filter("o_orderkey % 3 = 0").selectExpr("concat('m', o_orderkey) as name", "(year(o_orderdate) - 1992) * 12 + month(o_orderdate) as batch", "date_format(o_orderdate, 'yyyy-MM-dd') as executed_at")


def ledger_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger.status(table(spark, sf_dir, "orders").selectExpr("concat('m', o_orderkey) as name"), _ledger(spark, sf_dir))
    return rows.withColumn("batch", F.coalesce("batch", F.lit(0)))


def ledger_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.rollback(_ledger(spark, sf_dir), 2)


def confidence_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").selectExpr("source", "case when toxic = 1 and quality = 0 then 'low' when toxic = 1 then 'medium' else 'high' end as confidence")
    return introspect.worst_confidence(rows, "source")


QUERIES = {f.__name__: f for f in (epics_list, story_status, next_story, status_rewrite, story_bodies, gap_report, requirement_trace, dep_graph, dep_cycles, dep_dot, clone_groups, clone_runs, package_report, rule_scan, events_pairing, route_groups, ledger_status, ledger_rollback, confidence_rollup)}

_PLAN = rf"""pl AS (SELECT o_orderkey // 1000 AS plan, (o_orderkey % 1000)::INT AS line, {PLAN_SQL} AS text FROM orders),
fe AS (SELECT *, sum((text = '```')::INT) OVER (PARTITION BY plan ORDER BY line) AS f FROM pl),
hd AS (SELECT plan, line, CASE WHEN text LIKE '## Epic%' THEN 'epic' ELSE 'story' END AS kind, regexp_extract(text, '^#+ [A-Za-z]+ ([0-9]+)', 1)::INT AS epic, try_cast(regexp_extract(text, '^### Story [0-9]+\.([0-9]+)', 1) AS INT) AS number,
  regexp_extract(text, ': (.*?)( \[[a-z-]+\])?$', 1) AS title, nullif(regexp_extract(text, '\[([a-z-]+)\]$', 1), '') AS badge FROM fe WHERE f % 2 = 0 AND text LIKE '##%'),
hn AS (SELECT *, last_value(CASE WHEN kind = 'epic' THEN epic END IGNORE NULLS) OVER (PARTITION BY plan ORDER BY line) AS open, lead(line) OVER (PARTITION BY plan ORDER BY line) AS nl FROM hd),
en AS (SELECT plan, max(line) AS last_line FROM pl GROUP BY plan),
ep AS (SELECT plan, epic, title, badge, line AS start_line, (coalesce(lead(line) OVER (PARTITION BY plan ORDER BY line) - 1, last_line))::INT AS end_line FROM hd JOIN en USING (plan) WHERE kind = 'epic'),
st AS (SELECT plan, epic, number, title, badge, line AS start_line, (coalesce(nl - 1, last_line))::INT AS end_line FROM hn JOIN en USING (plan) WHERE kind = 'story' AND epic = open),
sl AS (SELECT o_orderkey // 1000 AS plan, o_orderkey % 1000 AS line, CASE WHEN o_orderkey % 5 = 0 THEN 'epic-' || (o_orderkey // 40) ELSE (o_orderkey // 40) || '-' || (o_orderkey % 40) || '-slug' || o_custkey END AS key,
  CASE WHEN o_orderkey % 5 = 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'done' ELSE 'review' END ELSE ['done', 'review', 'backlog'][o_custkey % 3 + 1] END AS value FROM orders
  WHERE o_orderkey % 1000 BETWEEN 1 AND 900 AND (o_orderkey % 5 = 0 OR o_orderkey % 2 = 0) AND EXISTS (FROM orders h WHERE h.o_orderkey = orders.o_orderkey // 1000 * 1000)),
ks AS (SELECT plan, key, arg_max(value, line) AS value, min(line) AS position FROM sl GROUP BY ALL),
fp AS (SELECT plan, regexp_extract(key, '^(\d+-\d+)-', 1) AS prefix, arg_min(value, position) AS v FROM ks WHERE regexp_matches(key, '^\d+-\d+-') GROUP BY ALL),
ss AS (SELECT st.*, coalesce(v, badge, 'backlog') AS status FROM st LEFT JOIN fp ON fp.plan = st.plan AND prefix = st.epic || '-' || st.number)"""
_IMPORTS = "im AS (SELECT * FROM (SELECT 'p' || l_partkey AS src, 'p' || (l_partkey - l_partkey % 16 + l_suppkey % 16) AS dst, l_orderkey AS importer FROM lineitem)), ed AS (SELECT src, dst, count(DISTINCT importer) AS weight FROM im WHERE src <> dst GROUP BY ALL)"
_REACH = "reach AS (SELECT src, dst FROM {e} UNION SELECT r.src, e.dst FROM reach r JOIN {e} e ON e.src = r.dst), cy AS (SELECT a.src AS node, min(a.dst) AS component FROM reach a JOIN reach b ON b.src = a.dst AND b.dst = a.src GROUP BY a.src)"
_WORDS = "w AS (SELECT doc_id AS file, regexp_split_to_array(coalesce(text, ''), '[ \\n]') AS ws FROM documents), win AS (SELECT file, i AS start, md5(array_to_string(ws[i:i + 19], chr(1))) AS signature FROM (SELECT file, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20))"
_LEDGER = "lg AS (SELECT 'm' || o_orderkey AS name, ((year(o_orderdate) - 1992) * 12 + month(o_orderdate))::INT AS batch, strftime(o_orderdate, '%Y-%m-%d') AS executed_at FROM orders WHERE o_orderkey % 3 = 0)"
SQL = {
    "epics_list": f"WITH {_PLAN} SELECT ep.plan, ep.epic, ep.title, coalesce(ks.value, ep.badge, 'backlog') AS status, ep.start_line, ep.end_line, (SELECT count(*) FROM st WHERE st.plan = ep.plan AND st.epic = ep.epic) AS stories FROM ep LEFT JOIN ks ON ks.plan = ep.plan AND ks.key = 'epic-' || ep.epic",
    "story_status": f"WITH {_PLAN} SELECT plan, epic, number, title, status, start_line, end_line FROM ss",
    "story_bodies": f"WITH {_PLAN} SELECT st.plan, epic, number, title, start_line, end_line, string_agg(text, chr(10) ORDER BY line) AS body FROM st JOIN pl ON pl.plan = st.plan AND line BETWEEN start_line AND end_line GROUP BY st.plan, epic, number, title, start_line, end_line",
    "next_story": f"WITH {_PLAN} SELECT plan, epic, number, title, status FROM (SELECT *, row_number() OVER (PARTITION BY plan ORDER BY epic, number) AS n FROM ss WHERE status <> 'done') WHERE n = 1",
    "gap_report": """WITH ids AS (SELECT p_size || '.' || (p_partkey % 100) AS id FROM part UNION SELECT p_partkey::VARCHAR FROM part),
refs AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[0-9.]+')) AS id FROM documents) SELECT id FROM ids WHERE id NOT IN (SELECT id FROM refs)""",
    "requirement_trace": "SELECT item_id, doc_id, (len(x) - len(replace(x, chr(10), '')) + 1)::INT AS line FROM (SELECT item_id, doc_id, substr(d.text, 1, instr(d.text, b.text) - 1) AS x FROM documents d, benchmark b WHERE contains(d.text, b.text))",
    "dep_graph": f"WITH {_IMPORTS} SELECT * FROM ed",
    "dep_cycles": f"WITH RECURSIVE e AS (SELECT 'n' || o_orderkey AS src, 'n' || CASE WHEN o_custkey % 3 = 0 THEN o_orderkey - o_orderkey % 8 ELSE o_orderkey + 1 END AS dst FROM orders), {_REACH.format(e='e')} SELECT component, node FROM cy",
    "dep_dot": f"""WITH RECURSIVE {_IMPORTS}, {_REACH.format(e='ed')} SELECT 0 AS section, '  "' || n || '";' AS text FROM (SELECT src AS n FROM ed UNION SELECT dst FROM ed)
UNION ALL SELECT 1, '  "' || src || '" -> "' || dst || '" [label=' || weight || CASE WHEN a.component = b.component THEN ', color=red' ELSE '' END || '];' FROM ed LEFT JOIN cy a ON a.node = src LEFT JOIN cy b ON b.node = dst""",
    "clone_groups": f"WITH {_WORDS} SELECT signature, count(*) AS places, count(DISTINCT file) AS files, min({{'f': file, 's': start}}).f AS file, min({{'f': file, 's': start}}).s::INT AS start FROM win GROUP BY signature HAVING count(*) > 1",
    "clone_runs": f"""WITH {_WORDS}, fs AS (SELECT signature, min({{'f': file, 's': start}}) AS f FROM win GROUP BY signature HAVING count(*) > 1),
p AS (SELECT f.f AS file_a, f.s AS start_a, file AS file_b, start AS start_b FROM win JOIN fs USING (signature) WHERE file <> f.f OR start <> f.s),
i AS (SELECT *, start_a - row_number() OVER (PARTITION BY file_a, file_b, start_b - start_a ORDER BY start_a) AS island FROM p)
SELECT file_a, min(start_a)::INT AS start_a, file_b, min(start_b)::INT AS start_b, count(*) + 19 AS tokens FROM i GROUP BY file_a, file_b, start_b - start_a, island""",
    "rule_scan": """WITH l AS (SELECT 'page' || page_id AS file, unnest(string_split(html, '>')) AS text, generate_subscripts(string_split(html, '>'), 1) - 1 AS line FROM pages),
r(chk, severity, rank, sign) AS (VALUES ('raw_script', 'high', 1, '<script'), ('nav_link', 'low', 3, 'href='), ('style_block', 'medium', 2, '<style'), ('heading', 'low', 3, '<h1')),
x AS (SELECT *, replace(trim(replace(text, chr(13), ''), ' '), chr(9), '    ') AS flat FROM l JOIN r ON contains(text, sign)),
c AS (SELECT *, CASE WHEN len(flat) > 120 THEN substr(flat, 1, 119) || '…' ELSE flat END AS excerpt FROM x)
SELECT substr(sha1(chk || ':' || file || ':' || line || ':' || excerpt), 1, 16) AS id, severity, rank, chk AS "check", file, line::INT AS line, excerpt FROM c""",
    "events_pairing": """WITH e AS (SELECT DISTINCT 'e' || (event_id % 500) AS event, 'u' || user_id AS place, event_type FROM events WHERE event_type IN ('signup', 'purchase'))
SELECT event, coalesce(string_agg(place, ',' ORDER BY place) FILTER (WHERE event_type = 'signup'), '') AS subscribers, coalesce(string_agg(place, ',' ORDER BY place) FILTER (WHERE event_type = 'purchase'), '') AS emitters FROM e GROUP BY event""",
    "route_groups": """WITH g AS (SELECT o_custkey AS file, o_orderkey % 1000 AS start, o_orderkey % 1000 + o_custkey % 300 AS stop, '/g' || o_orderkey AS prefix FROM orders WHERE o_orderkey % 2 = 0),
r AS (SELECT file, pos, min(path) AS path FROM (SELECT o_custkey AS file, (o_orderkey * 2000 + o_orderkey % 1000) % 2000 AS pos, '/r' || o_orderkey AS path FROM orders WHERE o_orderkey % 2 = 1) GROUP BY ALL)
SELECT r.file, r.pos, coalesce(string_agg(prefix, '' ORDER BY start, prefix), '') || min(path) AS path, count(prefix) AS depth FROM r LEFT JOIN g ON g.file = r.file AND start < pos AND pos < stop GROUP BY r.file, r.pos""",
    "ledger_status": f"WITH {_LEDGER} SELECT k.name, CASE WHEN batch IS NULL THEN 'pending' ELSE 'applied' END AS state, coalesce(batch, 0) AS batch, executed_at, coalesce((SELECT max(batch) FROM lg), 0) AS current_batch FROM (SELECT 'm' || o_orderkey AS name FROM orders) k LEFT JOIN lg ON lg.name = k.name",
    "ledger_rollback": f"WITH {_LEDGER} SELECT * FROM lg WHERE batch > greatest(0, (SELECT max(batch) FROM lg) - 2)",
    "package_report": """WITH d AS (SELECT source, lang, quality, toxic, (SELECT count(*) FROM (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS l) WHERE trim(l, ' ') <> '' AND NOT starts_with(trim(l, ' '), '//')) AS loc FROM documents LEFT JOIN labels USING (doc_id))
SELECT source, count(*) AS files, sum(loc)::BIGINT AS loc, count(DISTINCT lang) AS exports, count(*) FILTER (WHERE toxic = 1) AS lint_issues, round(avg(quality) * 100, 1) AS coverage FROM d GROUP BY source""",
    "status_rewrite": """WITH l AS (SELECT o_orderkey // 1000 AS plan, (o_orderkey % 1000)::INT AS line, CASE WHEN o_orderkey % 1000 = 0 THEN 'development_status:' WHEN o_orderkey % 1000 > 900 THEN CASE WHEN o_orderkey % 1000 = 901 THEN '' ELSE '  ' END || 'other' || o_orderkey || ': x'
  WHEN o_orderkey % 5 = 0 THEN '  epic-' || (o_orderkey // 40) || ': ' || CASE WHEN o_orderkey % 3 = 0 THEN 'done' ELSE 'review' END
  WHEN o_orderkey % 2 = 0 THEN '  ' || (o_orderkey // 40) || '-' || (o_orderkey % 40) || '-slug' || o_custkey || ': ' || ['done', 'review', 'backlog'][o_custkey % 3 + 1] || ' # note' ELSE '  # nothing' END AS text FROM orders),
f AS (SELECT plan, min(line) AS first FROM l WHERE starts_with(text, '  epic-25: ') GROUP BY plan)
SELECT l.plan, line, CASE WHEN line = first THEN '  epic-25: done' ELSE text END AS text FROM l LEFT JOIN f USING (plan)""",
    "confidence_rollup": "SELECT source, ['low', 'medium', 'high'][min(CASE WHEN toxic = 1 AND quality = 0 THEN 1 WHEN toxic = 1 THEN 2 ELSE 3 END)] AS confidence FROM labels JOIN documents USING (doc_id) GROUP BY source",
}
