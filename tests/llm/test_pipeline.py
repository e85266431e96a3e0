"""What the stages of the pipeline decide, and the queries against their SQL."""

import random
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from quire.llm.common import table
from quire.llm.queries import QUERIES

FOLDER = Path("/root/testdata/sf0.001")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")
@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    query, sql = QUERIES[name]
    cur = con.execute(sql)
    names = sorted(d[0] for d in cur.description)
    at = [[d[0] for d in cur.description].index(n) for n in names]
    wanted = sorted(str(tuple(r[i] for i in at)) for r in cur.fetchall())
    got = query(spark, str(FOLDER))
    assert sorted(got.columns) == names
    assert sorted(str(tuple(r[n] for n in names)) for r in got.collect()) == wanted


def write(spark, folder, docs, labels=(), benchmark=()):
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(benchmark), "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(1)
    pool = [f"{a}{b}" for a in "the of and to stone river light".split() for b in ("", "s", "ing", "ed", "ly")]
    clean = [" ".join(rng.choices(pool, k=80)) for _ in range(80)]
    junk = [" ".join(w + "!!" for w in rng.choices(pool, k=80)) for _ in range(40)]
    item = " ".join(f"exam{i}" for i in range(20))
    docs = [(i, t, "en", "a", len(t)) for i, t in enumerate(clean + junk)]
    labels = [(i, int(i < 80), 0) for i in range(0, 120)]
    extra = {200: clean[0].upper(), 201: clean[1] + " end", 202: f"{clean[2][:200]} {item} tail words", 203: f"write to joe@x.org or {clean[3][:300]}", 204: None, 205: ""}
    docs += [(i, t, None, None, None) for i, t in extra.items()]
    folder = write(spark, tmp_path / "t", docs, labels, [(1, item), (2, None)])
    step, seen = table(spark, folder, "documents"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, folder)
        assert step.columns == list(corpus_pipeline.COLUMNS)
        path = str(tmp_path / name)
        step.write.parquet(path)
        step = spark.read.parquet(path)
        seen[name] = {r["doc_id"]: r for r in step.collect()}
    assert set(range(80)) <= set(seen["quality"]) and not set(range(80, 120)) & set(seen["quality"])
    assert set(seen["quality"]) - set(seen["near_duplicates"]) == {200, 201}
    assert set(seen["near_duplicates"]) - set(seen["contamination"]) == {202}
    assert seen["personal_data"][203]["text"].startswith("write to [EMAIL] or ")
    assert seen["personal_data"][203]["n_chars"] == len(seen["personal_data"][203]["text"])
    assert all(seen["personal_data"][i]["text"] == clean[i] for i in range(80))
    last = corpus_pipeline.run(spark, folder)
    assert last.columns == ["doc_id", "lang", "source", "n_tokens", "ids"]
    assert {r["doc_id"] for r in last.collect()} == set(seen["personal_data"])


def test_stages_of_empty_tables(spark, tmp_path):
    folder = write(spark, tmp_path / "t", [])
    assert corpus_pipeline.run(spark, folder).count() == 0
    docs = [(None, None, None, None, None), (1, "a b c", "en", "x", 5), (1, "a b c", "en", "x", 5), (2, None, None, None, None), (2, None, None, None, None)]
    folder = write(spark, tmp_path / "u", docs)
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "2", "2", "None"]


def test_rows_without_an_id_are_judged_as_well(spark, tmp_path):
    rng = random.Random(2)
    one, two, item = (" ".join(rng.choices([f"w{i}" for i in range(3000)], k=60)) for _ in range(3))
    docs = [(None, one, "en", "a", 1), (7, one + " end", "en", "a", 1), (None, two, "en", "b", 1), (None, two, "en", "c", 1), (3, f"{item} tail", "en", "d", 1), (None, f"head {item}", "en", "e", 1), (3, "a clean text of the same id that has words of its own", "en", "f", 1)]
    folder = write(spark, tmp_path / "t", docs, [], [(1, item)])
    kept = corpus_pipeline.keep_one_of_a_kind(spark, table(spark, folder, "documents"), folder)
    assert sorted((r["doc_id"] or 0, r["text"][:9]) for r in kept.collect()) == sorted([(7, one[:9]), (0, two[:9]), (3, item[:9]), (3, "a clean t")])
    clean = corpus_pipeline.drop_contaminated(spark, table(spark, folder, "documents"), folder)
    assert sorted(r["source"] for r in clean.collect()) == ["a", "a", "b", "c", "f"]
