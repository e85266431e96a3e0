from quire.plans.registry import all_queries


def test_ingest_reads_a_table_that_is_a_folder_of_part_files(spark, tmp_path):
    rows = [(i, f"Text number {i}. " * 40, "en", "src0", 0) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, parts in (("folder", 3), ("file", 1)):
        docs.coalesce(1).write.parquet(str(tmp_path / name / "tables"))
    one = next((tmp_path / "file" / "tables").glob("part-*.parquet"))
    one.rename(tmp_path / "file" / "documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "folder" / "documents.parquet"))
    ingest = all_queries()["stream_ingest"][0]
    folder, file = (sorted(map(tuple, ingest(spark, str(tmp_path / name)).drop("batch").collect())) for name in ("folder", "file"))
    assert folder == file and {r[1] for r in folder} == set(range(6))
