"""Files of a stored index: as many as its postings ask for, also where they are of one term."""

from pyspark.sql import functions as F

from threadloom.operators import search, segments


def largest(spark, path):
    return spark.read.parquet(path).groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]


def test_postings_of_one_term_are_sorted_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "FILE_POSTINGS", 1000, raising=False)
    body = F.repeat(F.lit("the "), 40)
    made = lambda ids: ids.select(F.concat(F.lit("c"), "id").alias("conversation_id"), F.lit("the").alias("title"), F.lit("p").alias("provider"), F.lit("").alias("created_at"), body.alias("body"), F.length(body).cast("long").alias("char_count"))
    path, whole = str(tmp_path / "segments"), 200 * 41
    segments.create_index(made(spark.range(200)), path, 2)
    (name,) = segments._segments(spark, path)
    assert largest(spark, f"{path}/{name}/postings") < whole / 4
    segments.upsert_index(made(spark.range(100)), path, partitions=2)
    segments.merge_segments(spark, path, 2)
    (name,) = segments._segments(spark, path)
    assert largest(spark, f"{path}/{name}/postings") < whole / 4
    _, postings, stats = segments.open_segments(spark, path)
    assert postings.count() == whole and stats.filter("len = 41").count() == 200
    # without counted characters the bodies are measured
    search.store_index(made(spark.range(200)).drop("char_count"), str(tmp_path / "plain"), 2)
    assert largest(spark, str(tmp_path / "plain" / "postings")) < whole / 4
