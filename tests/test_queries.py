"""Every registered query of the library against its SQL."""

import math

import pytest
from conftest import SF

from lodestone import catalog


def rows(frame_rows, columns):
    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return round(float(v), 6) if isinstance(v, float) else v

    return sorted(repr(tuple(plain(r[c]) for c in columns)) for r in frame_rows)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, oracle, name):
    df = catalog.QUERIES[name](spark, SF)
    got = [r.asDict() for r in df.collect()]
    found = oracle.execute(catalog.SQL[name])
    names = [d[0] for d in found.description]
    want = [dict(zip(names, r, strict=True)) for r in found.fetchall()]
    assert sorted(df.columns) == sorted(names)
    assert rows(got, sorted(names)) == rows(want, sorted(names))


def test_diverse_equals_plain_loop(spark):
    from lodestone.operators import fulltext
    from lodestone.plans.inputs import chunks, table
    from lodestone.plans.search_queries import first_vector

    scored = fulltext.hybrid(chunks(spark, SF), table(spark, SF, "embeddings"), "that this", first_vector(spark, SF))
    left = [r.asDict() for r in scored.collect()]
    left.sort(key=lambda r: (-r["score"], -r["bm25"], r["id"]))

    def cos(a, b):
        if a is None or b is None:
            return 0.0
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    want = []
    while left and len(want) < 10:
        best, value = 0, -9.0
        for k, r in enumerate(left):
            v = 0.7 * r["score"] - 0.3 * max([0.0] + [cos(r["embedding"], s["embedding"]) for s in want])
            if v > value:
                best, value = k, v
        want.append(left[best])
        left[best] = left[-1]
        left.pop()
    got = fulltext.diverse(scored).orderBy("place").collect()
    assert [r["id"] for r in got] == [r["id"] for r in want]


def test_requirement_trace_finds_passages_across_lines_and_inside_words(spark, tmp_path):
    import duckdb

    docs = [
        (1, "one\ntwo three four five\nsix seven eight nine"), (2, "xone two three\nfour five six sevenx"), (None, "say one\ntwo three four five\nsix seven"), (4, None), (5, "a b\nc"),
        (6, "xa by\n\nhad c"), (7, ""), (8, "one  two"), (9, "in\ntwo three four five six seven eight"), (9, "\n\ntwo three four five six seven eight"),
    ]
    passages = [(1, "one\ntwo three four five\nsix seven"), (2, "one two three\nfour five six seven"), (3, "a b"), (4, "a"), (5, "e  t"), (6, None), (None, "two three four five six seven eight"), (8, "a b"), (9, "ne two three\nfour f"), (10, "b\nc")]
    spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(passages, "item_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = con.execute(catalog.SQL["requirement_trace"]).fetchall()
    got = [(r["item_id"], r["doc_id"], r["line"]) for r in catalog.QUERIES["requirement_trace"](spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert {(1, 1, 1), (1, None, 1), (2, 2, 1), (9, 2, 1), (None, 9, 3)} <= set(got)
