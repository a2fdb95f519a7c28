"""Jobs that may be repeated: appends by run, latest state with snapshots, scoring by model versions."""

import glob
import random
import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vozlake.operators import indexed, scoring
from vozlake.operators.scoring import LinearModel
from vozlake.sources import folders, journal
from vozlake.streaming import jobs

START = datetime(2024, 1, 1)
STATE = "k string, seq long, ts timestamp, v string"


def test_a_repeated_append_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "journal")
    assert journal.read_runs(spark, path, "a int").count() == 0
    lines = lambda *v: spark.createDataFrame([(x,) for x in v], "raw string")
    for run, rows in (("one", ('{"a":1}', '{"b":2}')), ("two", ('{"a":1}', '{"a":3}')), ("one", ('{"a":1}',)), ("two", ('{"a":9}',))):
        rejected = journal.append_records(lines(*rows), path, ["a"], run=run)
        assert rejected.count() == sum('"a"' not in r for r in rows)
    assert sorted(r.a for r in journal.read_runs(spark, path, "a int").collect()) == [1, 1, 3]
    # a run that was cut off is not read, and is replaced when it is repeated
    lines('{"a":7}', '{"a":7}').withColumnRenamed("raw", "value").write.text(folders.child(path, "run", "three"))
    folders.drop(spark, folders.child(path, "run", "three") + "/_SUCCESS")
    assert journal.read_runs(spark, path, "a int").count() == 3
    journal.append_records(lines('{"a":7}'), path, ["a"], run="three")
    assert sorted(r.a for r in journal.read_runs(spark, path, "a int").collect()) == [1, 1, 3, 7]
    with pytest.raises(ValueError):
        journal.append_records(lines('{"a":7}'), path, ["a"], run="../out")


def test_a_repeated_cost_append_adds_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("c", 1.5)], "case_id string, cost double")
    for _ in range(2):
        journal.append_costs(rows, str(tmp_path), ["case_id", "cost"], run="r")
    assert [tuple(r) for r in journal.read_costs(spark, str(tmp_path)).collect()] == [("c", 1.5)]


def arrivals(spark, folder, batches):
    for rows in batches:
        spark.createDataFrame([(k, s, START + timedelta(hours=h), v) for k, s, h, v in rows], STATE).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(STATE).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize("seed", [1, 2])
def test_latest_state_in_any_order(spark, tmp_path, seed):
    rnd = random.Random(7)
    records = [(rnd.choice(["a", "b", "c", None, "d"]), s, s, f"v{s}") for s in range(70)]
    random.Random(seed).shuffle(records)
    batches = [records[i::7] for i in range(7)]
    stream = arrivals(spark, f"{tmp_path}/in", batches + [batches[2]])
    jobs.finish(jobs.latest_state(stream, ["k"], "seq", f"{tmp_path}/out", f"{tmp_path}/ck", every=2))
    got = {r.k: (r.seq, r.v) for r in jobs.read_latest(spark, f"{tmp_path}/out", ["k"], "seq").collect()}
    expected = {}
    for k, s, _, v in sorted(records, key=lambda r: r[1]):
        expected[k] = (s, v)
    assert got == expected
    # eight batches, but a reader finds the last two snapshots and what lies between them
    assert len(glob.glob(f"{tmp_path}/out/snapshot-*")) == 2 and len(glob.glob(f"{tmp_path}/out/batch-*")) == 2


def test_expired_keys_go(spark, tmp_path):
    stream = arrivals(spark, f"{tmp_path}/in", [[("old", 1, 0, "x"), ("new", 2, 10, "y")], [("later", 3, 30, "z")], [("new", 4, 31, "w")]])
    jobs.finish(jobs.latest_state(stream, ["k"], "seq", f"{tmp_path}/out", f"{tmp_path}/ck", 2, "ts", "1 day"))
    rows = jobs.read_latest(spark, f"{tmp_path}/out", ["k"], "seq", "ts", "1 day").collect()
    assert sorted((r.k, r.v) for r in rows) == [("later", "z"), ("new", "w")]


def test_each_batch_by_the_version_in_force(spark, tmp_path):
    starter = LinearModel.starter()
    turned = LinearModel(starter.rows, (4.0, 0.0, -4.0))
    texts = [(k, t) for k, t in enumerate(["muy bueno, gracias", "terrible y muy malo", "la entrega", "excelente servicio", "no funciona"])]
    out, models = f"{tmp_path}/out", f"{tmp_path}/models"

    def arrive(rows):
        spark.createDataFrame(rows, "id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("id long, text string").parquet(f"{tmp_path}/in")
        jobs.finish(jobs.score_versions(stream, models, out, f"{tmp_path}/ck"))

    with pytest.raises(Exception, match="no model"):
        arrive(texts[:2])
    jobs.publish_model(starter.to_table(spark), models, 9)
    arrive(texts[2:3])
    jobs.publish_model(turned.to_table(spark), models, 10)
    with pytest.raises(ValueError):
        jobs.publish_model(turned.to_table(spark), models, 9)
    # a batch that has its version keeps it, although a newer one is there
    spark.createDataFrame([(9,)], "version long").write.mode("overwrite").parquet(folders.child(out, "choice", 2))
    arrive(texts[3:4])
    arrive(texts[4:])
    got = {r.id: (r.model_version, r.sentiment, round(r.confidence, 9)) for r in jobs.read_scored(spark, out).collect()}
    expected = {}
    for version, model, rows in ((9, starter, texts[:4]), (10, turned, texts[4:])):
        batch = scoring.prepare(spark.createDataFrame(rows, "id long, text string"))
        for r in indexed.score(batch, model.to_table(spark)).collect():
            expected[r.id] = (version, r.sentiment, round(r.confidence, 9))
    assert got == expected


def test_a_streamed_table_is_a_file_or_a_folder(spark, tmp_path):
    rows = spark.range(20).selectExpr("id", "'x' AS text")
    folder = f"{tmp_path}/in"
    rows.repartition(3).write.parquet(folder + "/folder.parquet")
    rows.coalesce(1).write.parquet(f"{tmp_path}/one")
    shutil.copy(glob.glob(f"{tmp_path}/one/part-*")[0], folder + "/file.parquet")
    rows.coalesce(1).write.parquet(folder + "/other.parquet")
    for name in ("folder", "file"):
        stream = jobs.read_table_stream(spark, f"{folder}/{name}.parquet", "id long, text string")
        jobs.finish(jobs.append(stream, f"{tmp_path}/{name}", f"{tmp_path}/{name}-ck"))
        assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/{name}").collect()) == list(range(20))
