import random

import pytest
from pyspark.sql import functions as F

from quire.operators import context as K
from quire.operators import evaluation as E
from quire.operators import maintenance as M
from quire.operators import outline as L
from quire.session import scratch_path
from quire.streaming import jobs as J

LINE = "doc_id long, page int, line_no int, text string, font_size double, is_bold boolean, position string, y_position double, height double"
BODY = "This is the body text of the page, and it goes on with many words that say little."


@pytest.fixture(scope="module")
def page(spark):
    rows = [
        (1, 0, 0, "A Study of Quiet Things", 20.0, True, "center", 20.0, 14.0),
        (1, 0, 1, BODY, 11.0, False, "left", 90.0, 14.0),
        (1, 0, 2, "1. Introduction to things", 14.0, True, "left", 150.0, 14.0),
        (1, 0, 3, BODY, 11.0, False, "left", 180.0, 14.0),
        (1, 0, 4, BODY, 11.0, False, "left", 200.0, 14.0),
        (1, 0, 5, "1.1 Earlier findings here", 13.0, True, "left", 260.0, 14.0),
        (1, 0, 6, BODY, 11.0, False, "left", 290.0, 14.0),
        (1, 0, 7, "Page 1", 9.0, False, "center", 700.0, 14.0),
    ]
    return spark.createDataFrame(rows, LINE)


def test_title_and_outline(spark, page):
    assert L.best_title(page).first()["title"] == "A Study of Quiet Things"
    found = [(r["level"], r["text"]) for r in L.outline(page).orderBy("line_no").collect()]
    # spatial detection runs after the title is taken out, so a title set apart comes back
    assert found == [("H1", "A Study of Quiet Things"), ("H1", "1. Introduction to things"), ("H2", "1.1 Earlier findings here")]
    kept = L.exclude_title(page.withColumn("raw_level", F.lit(1)), L.best_title(page))
    assert "A Study of Quiet Things" not in [r["text"] for r in kept.collect()]


def test_characters(spark):
    rows = []
    for x, ch in enumerate("Big cat"):
        if ch != " ":
            rows.append((1, 0, ch, x * 6.0, x * 6.0 + 6, 10.0, 12.0, 14.0, "Sans-Bold"))
    rows.append((1, 0, "B", 0.4, 6.4, 10.0, 12.0, 14.0, "Sans-Bold"))  # printed twice
    rows += [(1, 0, ch, x * 6.0, x * 6.0 + 6, 30.0, 10.0, 14.0, "Sans") for x, ch in enumerate("low")]
    chars = spark.createDataFrame(rows, "doc_id long, page int, text string, x0 double, x1 double, top double, size double, height double, fontname string")
    lines = L.line_metrics(L.chars_to_lines(chars)).orderBy("line_no").collect()
    assert [(r["text"], r["is_bold"], r["font_size"]) for r in lines] == [("Big cat", True, 12.0), ("low", False, 10.0)]


def test_prominence_tiers(spark):
    sizes = [20.0, 19.5, 15.0, 12.0, 11.5, 9.0]
    rows = [(1, 0, i, "plain", s, False, "left", 0.0, 14.0) for i, s in enumerate(sizes)]
    titles = spark.createDataFrame([(1, 40.0)], "doc_id long, title_size double")
    got = [r["level"] for r in L.prominence_tiers(spark.createDataFrame(rows, LINE), titles).orderBy("line_no").collect()]
    assert got == [1, 1, 2, 3, 3, 4]


def test_outline_scores(spark):
    rows = "doc_id long, text string, level string"
    actual = spark.createDataFrame([(1, " A ", "H1"), (1, "B", "H2"), (2, "X", "H1")], rows)
    expected = spark.createDataFrame([(1, "A", "H1"), (1, "C", "H1"), (3, "Y", "H1")], rows)
    got = {r["doc_id"]: (r["precision"], r["recall"], r["matched"], r["extra"], r["missed"]) for r in E.outline_scores(actual, expected).collect()}
    assert got == {1: (0.5, 0.5, 1, 1, 1), 2: (0.0, 1.0, 0, 1, 0), 3: (1.0, 0.0, 0, 0, 1)}


def test_budget_stops_at_the_first_that_does_not_fit(spark):
    rows = [(1, f"c{i}", f"d{i}", "x" * n, i + 1) for i, n in enumerate([300, 400, 10])]
    hits = spark.createDataFrame(rows, "query_id long, chunk_id string, doc_name string, content string, rank int")
    kept = [r["chunk_id"] for r in K.budget_pack(hits, budget=500, sections=3).orderBy("place").collect()]
    assert kept == ["c0"]
    first = hits.withColumn("mine", F.lit("d2"))
    assert [r["chunk_id"] for r in K.budget_pack(first, 500, 3, prefer="mine").orderBy("place").collect()] == ["c2", "c0"]


def test_global_position(spark):
    rows = spark.range(0, 1000).select((F.col("id") * 3).alias("k"))
    got = K.global_position(rows, "k", F.floor(F.col("k") / 50)).orderBy("k").collect()
    assert [r["position"] for r in got] == list(range(1000))


def test_match_names(spark):
    docs = spark.createDataFrame([("s", 1, "alpha.pdf", 0), ("s", 2, "beta.pdf", 1), ("s", 3, "alphabet.pdf", 2)], "session_id string, doc_id long, doc_name string, position int")
    refs = spark.createDataFrame([("s", r) for r in ["beta.pdf", "alpha", "my beta.PDF", "bet", "gamma", ""]], "session_id string, ref string")
    got = {r["ref"]: (r["doc_id"], r["rule"]) for r in M.match_document_names(refs, docs).collect()}
    assert got == {
        "beta.pdf": (2, "exact"), "alpha": (1, "without_extension"), "my beta.PDF": (2, "contained"),
        "bet": (2, "contained"), "": (1, "contained"),
    }


def test_stream_equals_table(spark, tmp_path):
    rows = [(i, f"doc {i}. " + "word " * 300) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = J.read_stream(spark, str(tmp_path / "in"), docs.schema, files_per_batch=1)
    out = scratch_path(spark, "test")
    J.stream_ingest(stream, out, 200, 20).awaitTermination()
    got = spark.read.parquet(f"{out}/data").select("chunk_id", "content", "page_number")
    want = J.assign_pages(J.chunk_recursive(docs, 200, 20)).select("chunk_id", "content", "page_number")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    # nothing is ingested twice
    J.stream_ingest(J.read_stream(spark, str(tmp_path / "in"), docs.schema), out, 200, 20).awaitTermination()
    assert spark.read.parquet(f"{out}/data").count() == want.count()


def test_requests_pass_once_per_time_to_live_across_batches(spark, tmp_path):
    import datetime as dt

    day = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    batches = [[("a", day(0)), ("a", day(3)), ("b", day(1))], [("a", day(7)), ("a", day(13)), ("b", day(6))], [("a", day(14)), ("b", day(20))]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, "content string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / f"b={n}"))
    stream = spark.readStream.schema("content string, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = scratch_path(spark, "test")
    J.stream_dedupe_requests(stream, out).awaitTermination()
    got = sorted((r["content"], r["ts"]) for r in spark.read.parquet(f"{out}/data").select("content", "ts").collect())
    assert got == [("a", day(0)), ("a", day(7)), ("a", day(14)), ("b", day(1)), ("b", day(20))]


def _line_of(chars):
    """Plain loop: the text of a line's characters (x0, text, x1)."""
    out, last, right, text = "", None, None, None
    for x0, t, x1 in sorted(c for c in chars if c[1]):
        if last is not None and abs(x0 - last) < 1 and t == text:
            continue
        out += (" " if right is not None and x0 - right > 3 else "") + t
        last, right, text = x0, x1, t
    return out.strip()


def test_line_texts_equal_a_loop_with_overprints_and_no_list_of_characters_is_aggregated(spark):
    rng = random.Random(5)
    rows = [
        (d, p, rng.choice(["a", "b", "", "c"]), x0 := rng.choice([0.0, 0.3, 0.6, 0.9, 1.2, 1.5, 1.8, 6.0, 7.5, 20.0]) + 40 * rng.randrange(3), x0 + rng.choice([1.0, 6.0]), line * 60.0 + rng.choice([0.0, 1.0]), 10.0, rng.choice([None, 0.0, 14.0]), rng.choice(["Sans", "Sans-Bold"]))
        for d in range(3) for p in range(2) for line in range(3) for _ in range(60)
    ]
    chars = spark.createDataFrame(rows, "doc_id long, page int, text string, x0 double, x1 double, top double, size double, height double, fontname string")
    metrics = L.line_metrics(L.chars_to_lines(chars))
    got = {(r["doc_id"], r["page"], r["line_no"]): (r["raw_text"], r["is_bold"], r["height"]) for r in metrics.collect()}
    want = {}
    for d, p, line in {(r[0], r[1], int(r[5] // 60)) for r in rows}:
        own = [r for r in rows if (r[0], r[1], int(r[5] // 60)) == (d, p, line)]
        want[d, p, line] = (_line_of([(r[3], r[2], r[4]) for r in own]), sum("Bold" in r[8] for r in own) / len(own) > 0.5, 14.0)
    assert got == want
    plan = metrics._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "FlatMapGroupsInArrow" in plan


def test_lines_are_dealt_by_page_before_they_become_characters(spark):
    from quire.plans import fixtures as X

    plan = L.chars_to_lines(X.chars(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    deal, explode = plan.index("hashpartitioning(doc_id"), plan.index("Generate posexplode(split(text")
    assert explode < deal and plan.count("hashpartitioning") == 1
