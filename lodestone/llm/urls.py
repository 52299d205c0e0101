"""URL filter: host and path rules, then a ratio of two character models.

Rules decide first: a rule fits its host and all subdomains if the path starts with its path, and the
longest fitting rule wins. Their verdicts also label training data: three in four of the labelled urls
(by the digest of the url) train one character model of allowed urls and one of blocked urls, the fourth
calibrates. The last label of every host is masked, ruled or not: rules on whole domains fit there, and the
models would only learn those rules again.

Orders are variable: each character is predicted from the longest context, of at most CONTEXT characters, in use,
interpolated with all shorter ones and a uniform distribution; a context counts as often as it was seen against
how many different characters followed it. Contexts of LONG characters or more are in use only once they
were seen KEPT times. A url's score is the mean over its characters of log P(allowed) - log P(blocked);
the threshold is the score (in hundredths) that separates the urls held out best. Where those hold no two
labels, or no score separates them, it is 0.

Characters are lower-cased (A-Z), digits are one symbol, the mask and unknown characters another. The model has one
row for each different run of CONTEXT + 1 symbols, so it grows with the urls: it is broadcast only
up to BROADCAST_ROWS rows, and joined by shuffle beyond, with the same result.

A null url, or one without ://, has empty host and path, no rule, no mask, and the model's verdict (a null or
empty url scores 0). Urls of any length are taken whole. Rows are told apart by place, so repeated rows are judged
alike; of equally good thresholds the lowest holds; an empty table gives an empty result. Only the id and the url
are read, so other columns may have any name. All DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import Scratch, ascii_lower, table

#: Fixed values: (host, path, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Positions are codes from 2 on; 0 is any other character, 1 the start of a url.
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0-._/:?=&#%"
SIZE = len(SYMBOLS) + 2
#: The longest context, from which length on contexts must have been seen KEPT times, and what is broadcast (16 bytes a row).
CONTEXT, LONG, KEPT, BROADCAST_ROWS = 5, 3, 16, 1_000_000
#: Urls whose digest begins with one of these calibrate.
HELD = ("0", "1", "2", "3")
LABELS = ("allow", "block")


def parts(url: Column) -> tuple[Column, Column]:
    whole, pattern = F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return ascii_lower(F.regexp_extract(whole, pattern, 1)), F.regexp_extract(whole, pattern, 2)


def fitting(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null."""
    order = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in order]
    return F.coalesce(*fits)


def masked(url: Column) -> Column:
    """The url as the models read it: a control character for the last label of the host."""
    whole, pattern = F.coalesce(url, F.lit("")), r"(?s)^(.*?://(?:[^/?#]*\.)?)[^/?#.]*(.*)"
    plain = F.when(F.instr(whole, "://") > 0, F.concat(F.regexp_extract(whole, pattern, 1), F.lit("\x01"), F.regexp_extract(whole, pattern, 2))).otherwise(whole)
    return F.translate(ascii_lower(plain), "123456789", "000000000")


def grams(text: Column) -> Column:
    """For each character a number made of it and the CONTEXT symbols before, in base SIZE."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.when(F.instr(F.lit(SYMBOLS), c) > 0, F.instr(F.lit(SYMBOLS), c) + 1).otherwise(0).cast("bigint"))

    def numbers(held: Column) -> Column:
        padded = F.concat(F.array_repeat(F.lit(1).cast("bigint"), CONTEXT), held)
        out = F.slice(padded, 1, F.size(held))
        for k in range(2, CONTEXT + 2):
            out = F.zip_with(out, F.slice(padded, F.lit(k), F.size(held)), lambda a, b: a * SIZE + b)
        return out

    # An array of one binds the codes once instead of once for each use.
    return F.transform(F.array(codes), numbers)[0]


def model(counts: DataFrame) -> DataFrame:
    """From (gram, n_allow, n_block): (gram, ratio) for every gram given, seen in training or not."""
    lower = None
    for k in range(CONTEXT + 1):
        keyed = counts.groupBy((F.col("gram") % SIZE ** (k + 1)).alias("key")).agg(*[F.sum(f"n_{v}").alias(f"n_{v}") for v in LABELS])
        # One row for each symbol after a context: SIZE rows at most.
        context = Window.partitionBy(F.expr(f"key div {SIZE}"))
        keyed = keyed.select("key", *[c for v in LABELS for c in (F.col(f"n_{v}"), F.sum(f"n_{v}").over(context).alias(f"all_{v}"), F.count_if(F.col(f"n_{v}") > 0).over(context).alias(f"kinds_{v}"))])
        if lower is None:
            keyed = keyed.select("*", *[F.lit(1.0 / SIZE).alias(f"low_{v}") for v in LABELS])
        else:
            keyed = keyed.withColumn("shorter", F.col("key") % SIZE**k).join(lower, "shorter")
        used = F.lit(True) if k < LONG else F.col("all_allow") + F.col("all_block") >= KEPT
        p = lambda v: F.when(used & (F.col(f"all_{v}") > 0), (F.col(f"n_{v}") + F.col(f"kinds_{v}") * F.col(f"low_{v}")) / (F.col(f"all_{v}") + F.col(f"kinds_{v}"))).otherwise(F.col(f"low_{v}"))
        lower = keyed.select(F.col("key").alias("shorter"), *[p(v).alias(f"low_{v}") for v in LABELS])
    return lower.select(F.col("shorter").alias("gram"), (F.log("low_allow") - F.log("low_block")).alias("ratio"))


def scores(rows: DataFrame, keep: Scratch) -> DataFrame:
    """From (place, text, verdict, held): place and the score of every text with characters, six decimals."""
    trains = F.col("verdict").isNotNull() & ~F.col("held")
    each = rows.select((trains & (F.col("verdict") == "allow")).alias("a"), (trains & (F.col("verdict") == "block")).alias("b"), F.explode(grams(F.col("text"))).alias("gram"))
    counts = keep(each.groupBy("gram").agg(F.count_if("a").alias("n_allow"), F.count_if("b").alias("n_block")))
    ratios = keep(model(counts))
    small = F.broadcast(ratios) if ratios.count() <= BROADCAST_ROWS else ratios
    return rows.select("place", F.explode(grams(F.col("text"))).alias("gram")).join(small, "gram").groupBy("place").agg(F.round(F.avg("ratio"), 6).alias("score"))


def threshold(scored: DataFrame) -> DataFrame:
    """One row, at: the hundredth that splits held-out allowed from blocked urls best (the lowest of equals)."""
    bins = scored.filter("verdict is not null and held").groupBy(F.floor(F.col("score") * 100).alias("bin")).agg(F.count_if(F.col("verdict") == "allow").alias("a"), F.count_if(F.col("verdict") == "block").alias("b"))
    up = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # One row per hundredth of a bounded score. Gain: blocked urls below the cut less allowed urls below it, as shares.
    gain = (F.coalesce(F.sum("b").over(up), F.lit(0)) * F.sum("a").over(whole) - F.coalesce(F.sum("a").over(up), F.lit(0)) * F.sum("b").over(whole)).alias("gain")
    return bins.select("bin", gain).filter("gain > 0").agg(F.coalesce(F.max(F.struct("gain", (-F.col("bin")).alias("low")))["low"] * -1, F.lit(0)).alias("at"))


def filter_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """Per input row: id_col, host, path, rule, score (six decimals), verdict."""
    host, path = parts(df[url_col])
    keep = Scratch()
    rows = df.select(df[id_col].alias("id"), host.alias("host"), path.alias("path"), masked(df[url_col]).alias("text"), F.coalesce(F.substring(F.md5(df[url_col]), 1, 1).isin(*HELD), F.lit(False)).alias("held"))
    rows = rows.withColumn("by_rule", fitting(F.col("host"), F.col("path"), rules)).select("id", "host", "path", F.col("by_rule.rule").alias("rule"), F.col("by_rule.verdict").alias("verdict"), "text", "held", F.monotonically_increasing_id().alias("place"))
    rows = keep(rows)
    scored = keep(rows.drop("text").join(scores(rows, keep), "place", "left").withColumn("score", F.coalesce("score", F.lit(0.0))))
    for done in keep.tables[:-1]:
        keep.drop(done)
    # One row.
    judged = scored.join(F.broadcast(threshold(scored)))
    verdict = F.coalesce("verdict", F.when(F.floor(F.col("score") * 100) >= F.col("at"), "allow").otherwise("block"))
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", "score", verdict.alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    order = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    pick = lambda what: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{what(h, p, v)}'" for h, p, v in order) + " END"
    each = lambda text: ", ".join(text.replace("@", v) for v in LABELS)
    levels = []
    for k in range(CONTEXT + 1):
        used = "" if k < LONG else f"all_allow + all_block >= {KEPT} AND "
        low = f"(1.0 / {SIZE})::DOUBLE" if k == 0 else "l.p_@"
        levels.append(f"""
s{k} AS (SELECT gram % {SIZE ** (k + 1)} AS key, {each("sum(n_@) AS n_@")} FROM counts GROUP BY 1),
c{k} AS (SELECT key // {SIZE} AS context, {each("sum(n_@) AS all_@, count(*) FILTER (WHERE n_@ > 0) AS kinds_@")} FROM s{k} GROUP BY 1),
p{k} AS (SELECT s.key, {each(f"CASE WHEN {used}all_@ > 0 THEN (n_@ + kinds_@ * {low}) / (all_@ + kinds_@) ELSE {low} END AS p_@")}
  FROM s{k} AS s JOIN c{k} AS c ON c.context = s.key // {SIZE}{"" if k == 0 else f" JOIN p{k - 1} AS l ON l.key = s.key % {SIZE**k}"}),""")
    number = "padded[i]"
    for k in range(1, CONTEXT + 1):
        number = f"({number}) * {SIZE} + padded[i + {k}]"
    return rf"""
WITH u AS (SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path, substr(md5(url), 1, 1) IN {HELD} AS held,
    translate(regexp_replace(coalesce(url, ''), '(?s)^(.*?://(?:[^/?#]*\.)?)[^/?#.]*', '\1' || chr(1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000') AS x FROM pages),
r AS (SELECT *, {pick(lambda h, p, v: h + p)} AS rule, {pick(lambda h, p, v: v)} AS verdict,
    list_transform(string_split(x, ''), lambda c: CASE WHEN c <> '' AND instr('{SYMBOLS}', c) > 0 THEN instr('{SYMBOLS}', c) + 1 ELSE 0 END::BIGINT) AS codes FROM u),
q AS (SELECT *, list_concat({[1] * CONTEXT}::BIGINT[], codes) AS padded FROM r),
g AS (SELECT page_id, verdict, held, unnest(list_transform(range(1, len(codes) + 1), lambda i: {number})) AS gram FROM q WHERE x <> ''),
counts AS (SELECT gram, {each("count(*) FILTER (WHERE verdict = '@' AND NOT held) AS n_@")} FROM g GROUP BY gram),{"".join(levels)}
f AS (SELECT key AS gram, ln(p_allow) - ln(p_block) AS ratio FROM p{CONTEXT}),
m AS (SELECT page_id, round(avg(ratio), 6) AS score FROM g JOIN f USING (gram) GROUP BY page_id),
s AS (SELECT r.page_id, host, path, rule, verdict, held, coalesce(score, 0) AS score FROM r LEFT JOIN m USING (page_id)),
bins AS (SELECT floor(score * 100)::BIGINT AS bin, count(*) FILTER (WHERE verdict = 'allow') AS a, count(*) FILTER (WHERE verdict = 'block') AS b FROM s WHERE verdict IS NOT NULL AND held GROUP BY 1),
gains AS (SELECT bin, coalesce(sum(b) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * sum(a) OVER () - coalesce(sum(a) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * sum(b) OVER () AS gain FROM bins),
cut AS (SELECT coalesce((SELECT bin FROM gains WHERE gain > 0 ORDER BY gain DESC, bin LIMIT 1), 0) AS bar)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN floor(score * 100) >= bar THEN 'allow' ELSE 'block' END) AS verdict FROM s, cut
"""


SQL = _sql()
