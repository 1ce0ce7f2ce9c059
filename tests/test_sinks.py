"""File-per-row writer and resumable results under failing tasks."""

import json
import os

import pytest
from pyspark.sql import functions as F

from chorus.session import prepare, scratch_path
from chorus.sources import named_texts, resumable


def test_one_file_per_row_and_no_second_one_after_a_retry(spark):
    prepare(spark)
    path = scratch_path(spark, "files").removeprefix("file:")
    texts = [(f"u{i % 3}_{i}.txt", None if i == 5 else f"text {i}\nline ą\U0001f600 ") for i in range(50)] + [("a/b:%.txt", "odd")]
    df = spark.createDataFrame(texts, "file_name string, text string").repartition(4)
    named_texts.write_text_files(df, path)
    names = sorted(n for n in os.listdir(path) if not n.startswith((".", "_")))
    assert names == sorted(named_texts.safe_name(n) for n, _ in texts)
    assert json.load(open(f"{path}/_SUCCESS"))["files"] == 51 and not [n for n in os.listdir(path) if "attempt" in n]
    back = {r["file_name"]: r["text"] for r in named_texts.read_text_files(spark, path).collect()}
    assert back["u2_5.txt"] == "" and back["u1_4.txt"] == texts[4][1] and len(back) == 51
    # a second attempt of a task writes the same names
    w = named_texts.NamedTextWriter.__new__(named_texts.NamedTextWriter)
    w.path = path
    assert w.write([{"file_name": n, "text": t} for n, t in texts[:10]]).files == 10
    assert sorted(n for n in os.listdir(path) if not n.startswith((".", "_"))) == names
    with pytest.raises(Exception, match="exists"):
        named_texts.write_text_files(df, path)


def test_a_failed_job_leaves_no_folder(spark):
    prepare(spark)
    path = scratch_path(spark, "files").removeprefix("file:")
    with pytest.raises(Exception):
        named_texts.write_text_files(spark.createDataFrame([("a.txt", "x"), (None, "y")], "file_name string, text string"), path)
    assert not os.path.exists(path)


def test_only_missing_keys_are_computed_after_a_crash(spark):
    path = scratch_path(spark, "resume")
    todo = spark.createDataFrame([(f"k{i % 20}", i) for i in range(200)], "key string, v long")
    seen = []

    def compute(part, bad=None):
        seen.extend(r["key"] for r in part.select("key").distinct().collect())
        fail = F.when(F.col("key") == F.lit(bad), F.raise_error(F.lit("boom"))).otherwise(F.lit(0)).cast("long")
        return part.withColumn("v", F.col("v") + fail).groupBy("key").agg(F.sum("v").alias("total"))

    waves = {r["key"]: r["w"] for r in todo.select("key", F.pmod(F.xxhash64("key"), F.lit(4)).alias("w")).distinct().collect()}
    bad = next(k for k, w in sorted(waves.items()) if w == 2)
    with pytest.raises(Exception, match="boom"):
        resumable.compute_missing(todo, path, "key", lambda p: compute(p, bad), waves=4)
    stored = {k for k, w in waves.items() if w < 2}
    assert {r["key"] for r in resumable.stored_keys(spark, path, "key").collect()} == stored
    seen.clear()
    resumable.compute_missing(todo, path, "key", compute, waves=4)
    assert set(seen) == set(waves) - stored and len(seen) == len(set(seen))
    got = {r["key"]: r["total"] for r in resumable.read_results(spark, path).collect()}
    assert got == {f"k{i}": sum(range(i, 200, 20)) for i in range(20)}
    assert resumable.compute_missing(todo, path, "key", compute, waves=4) == 0
    # results without a manifest, as a crash leaves them, are neither stored nor read
    spark.createDataFrame([("half", 1)], "key string, total long").write.parquet(f"{path}/results/wave-half")
    assert resumable.read_results(spark, path).count() == 20
