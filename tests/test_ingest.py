"""Stream ingest: documents of few files reach all tasks."""

from levelloom.streaming import jobs


def test_documents_of_one_file_are_dealt_to_tasks(spark, tmp_path, monkeypatch):
    seen = []
    parse = jobs.parse_levels

    def spread(batch):
        seen.append(len({r[0] for r in batch.selectExpr("spark_partition_id()").collect()}))
        return parse(batch)

    monkeypatch.setattr(jobs, "parse_levels", spread)
    text = '{"_version":"2.2.0","_notes":[{"_time":1,"_lineIndex":1,"_lineLayer":0,"_type":0,"_cutDirection":1}]}'
    docs = spark.createDataFrame([(i, "Expert", text) for i in range(64)], "map_id bigint, difficulty string, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/in")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows end in one task
    try:
        stream = spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in")
        jobs.ingest_levels(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    assert seen and seen[0] > 1
    assert spark.read.parquet(f"{tmp_path}/out/events").where("kind = 'note'").count() == 64
