import json
import os

import pytest
from pyspark.sql import functions as F

from fieldloom.sources import committed


def lines(spark, n, parts=3, bad=None):
    value = F.concat(F.lit("row "), F.col("id").cast("string"))
    if bad is not None:
        value = F.when(F.col("id") == bad, F.raise_error("task fails").cast("string")).otherwise(value)
    return spark.range(0, n, 1, parts).select(value.alias("value"))


def held(path):
    return sorted(x for _, _, names in os.walk(path) for x in names if x.startswith("part-"))


def test_sets_of_files_are_whole(spark, tmp_path):
    path = str(tmp_path / "log")
    assert committed.read_lines(spark, path).count() == 0
    committed.write_lines(lines(spark, 10), path, 1, header="value")
    committed.write_lines(lines(spark, 4), path, 2)
    got = sorted((r.batch, r.value) for r in committed.read_lines(spark, path).collect())
    assert got == sorted([("1", f"row {i}") for i in range(10)] + [("2", f"row {i}") for i in range(4)])
    headers = [p.read_text().startswith("value\n") for p in (tmp_path / "log/1").iterdir() if p.name.startswith("part-")]
    assert sum(headers) == 1 and len(headers) == 3


def test_a_batch_is_written_once(spark, tmp_path):
    path = str(tmp_path / "log")
    committed.write_lines(lines(spark, 5), path, "b")
    before = held(path)
    committed.write_lines(lines(spark, 9), path, "b")
    assert held(path) == before and committed.read_lines(spark, path).count() == 5


def test_a_failed_job_leaves_nothing_to_read(spark, tmp_path):
    path = str(tmp_path / "log")
    committed.write_lines(lines(spark, 3), path, 1)
    with pytest.raises(Exception, match="task fails"):
        committed.write_lines(lines(spark, 30, bad=29), path, 2)
    assert committed.read_lines(spark, path).count() == 3
    committed.write_lines(lines(spark, 30), path, 2)
    assert committed.read_lines(spark, path).count() == 33


def test_a_task_that_ran_twice_counts_once(tmp_path):
    """Two tasks and a second run of one: only what was reported is published; a second commit of the batch takes its files away."""
    writer = committed.LinesWriter(str(tmp_path), "7", None)
    (tmp_path / "7").mkdir()
    for name in ("part-00000-a.txt", "part-00000-again.txt", "part-00001-b.txt"):
        (tmp_path / "7" / name).write_text("x\n")
    writer.commit([committed.Written("part-00000-a.txt", 1, False), committed.Written("part-00001-b.txt", 1, False), None])
    assert [f["name"] for f in json.loads((tmp_path / "_commits/7.json").read_text())["files"]] == ["part-00000-a.txt", "part-00001-b.txt"]
    writer.commit([committed.Written("part-00000-again.txt", 1, False)])
    assert held(tmp_path) == ["part-00000-a.txt", "part-00001-b.txt"]
    writer.abort([committed.Written("missing", 1, False), None])


def test_streams_publish_each_batch_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / f"in/{i}.txt").write_text(f"a{i}\nb{i}\n")
    path = str(tmp_path / "log")

    def run():
        stream = spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in"))
        publish = lambda rows, batch: committed.write_lines(rows, path, batch)
        q = stream.writeStream.foreachBatch(lambda rows, batch: [publish(rows, batch) for _ in range(2)]).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    run()
    assert sorted(r.value for r in committed.read_lines(spark, path).collect()) == ["a0", "a1", "a2", "b0", "b1", "b2"]
