import pytest
from pyspark.sql import functions as F

from quern.plans import ingest_queries
from quern.sources import ingest
from quern.streaming import jobs


@pytest.fixture
def folder(spark, tmp_path):
    df = spark.range(300).selectExpr("id % 4 as user_id", "id as event_id", "timestamp_seconds(id * 600) as ts", "case when id % 3 = 0 then 'a' else 'b' end as event_type")
    path = tmp_path / "data"
    for i, part in enumerate([df.where("event_id < 100"), df.where("event_id between 100 and 249"), df.where("event_id >= 250")]):
        part.coalesce(1).write.parquet(str(path / f"part{i}" / "events.parquet"))
    return path


def test_buffers_go_on_over_batches(spark, folder):
    schema = spark.read.parquet(str(folder / "part0" / "events.parquet")).schema
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(folder))
    out = jobs.drain(jobs.advance_buffers(stream, "user_id", "event_id", 20), spark)
    ends = {(r.user_id, r.buffer): r.n for r in out.groupBy("user_id", "buffer").agg({"n": "max"}).withColumnRenamed("max(n)", "n").collect()}
    assert ends == {(u, b): 20 if b < 3 else 15 for u in range(4) for b in range(4)}


def test_stream_equals_batch(spark, folder):
    schema = spark.read.parquet(str(folder / "part0" / "events.parquet")).schema
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(folder))
    got = {tuple(r) for r in jobs.drain(jobs.windowed_counts(stream, "ts", "event_type", "1 hour", "30 days"), spark, "complete").collect()}
    batch = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(str(folder))
    assert got == {tuple(r) for r in jobs.windowed_counts(batch, "ts", "event_type", "1 hour", "30 days").collect()}


@pytest.mark.parametrize("parts", [1, 3])
def test_a_table_is_one_file_or_a_folder_of_files(spark, tmp_path, parts, rows):
    df = spark.range(30).select(F.col("id").alias("doc_id"), F.concat(F.lit("text of "), "id").alias("text"), F.lit("txt").alias("file_type"))
    df.repartition(parts).write.parquet(str(tmp_path / "written"))
    files, data = sorted((tmp_path / "written").glob("part-*")), tmp_path / "data"
    if parts == 1:
        data.mkdir()
        files[0].rename(data / "documents.parquet")
    else:
        data.mkdir()
        (tmp_path / "written").rename(data / "documents.parquet")
    spark.range(1).select(F.lit(99).cast("bigint").alias("doc_id"), F.lit("x").alias("text"), F.lit("txt").alias("file_type")).write.parquet(str(data / "old" / "documents.parquet"))
    assert rows(ingest_queries.stream_ingest(spark, str(data))) == sorted([(i, 1, "completed", len(f"text of {i}")) for i in range(30)], key=repr)


def test_steps_read_the_documents_once(spark, tmp_path):
    spark.createDataFrame([(1, "a", "txt"), (2, "b", "csv")], "doc_id bigint, text string, handler string").write.parquet(str(tmp_path / "d"))
    plan = ingest.steps(spark.read.parquet(str(tmp_path / "d")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_blank_documents_are_completed(spark, tmp_path, rows):
    held = [(1, "   ", "txt"), (2, "\t\n\t", "csv"), (3, "word", "txt"), (4, "", "txt"), (5, " \n ", "csv")]
    spark.createDataFrame(held, "doc_id bigint, text string, file_type string").write.parquet(str(tmp_path / "documents.parquet"))
    assert rows(ingest_queries.stream_ingest(spark, str(tmp_path))) == [(1, 1, "completed", 3), (2, 1, "completed", 2), (3, 1, "completed", 4)]
