import pytest
from pyspark.sql import functions as F

from tracefield.operators import sampling
from tracefield.sources import traces as source
from tracefield.streaming import summaries


def test_trace_csv_round_trip(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(",".join(source.TRACE_FIELDS) + ",radius_m\n1,2,3.5,0,0,0,1,1,nan\n1,x,4,1,0,0,1,1,2\n")
    rows = source.read_traces_csv(spark, str(path)).orderBy("observed_length_m").collect()
    assert rows[0]["radius_m"] is None and rows[1]["face_id"] is None and rows[1]["radius_m"] == 2
    out = str(tmp_path / "out")
    source.write_traces(source.read_traces_csv(spark, str(path)), out)
    assert source.read_traces(spark, out).count() == 2
    with pytest.raises(ValueError, match="missing columns"):
        source.require(spark.range(1), ["nope"])


def test_outline_cloud_and_documents(spark, tmp_path):
    (tmp_path / "o.dat").write_text("poly (0, 0) (1000, 0)\n(1000.5,-2e3)")
    points = [(r["y"], r["z"]) for r in source.read_outline(spark, str(tmp_path / "o.dat")).orderBy("line").collect()]
    assert points == [(0, 0), (1, 0), (pytest.approx(1.0005), -2)]
    (tmp_path / "c.ply").write_text("ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nend_header\n1 2 3\n4 5 6 7\n")
    assert source.read_ply(spark, str(tmp_path / "c.ply")).count() == 2
    (tmp_path / "c.json").write_text('{"dataset_name": "a", "sets": {"1": {"trend": 10}, "2": {"kappa": 5}}}')
    assert source.read_config(spark, str(tmp_path / "c.json")).count() == 2
    (tmp_path / "d.json").write_text('{"fractures": [{"id": 1, "set_id": 1, "radius_m": 2}, {"id": 2, "set_id": 1, "radius_m": 3}, {"id": 3, "set_id": 2, "radius_m": 9}]}')
    assert [r["id"] for r in source.read_domain(spark, str(tmp_path / "d.json"), 1, [1]).collect()] == [2]


def test_domain_of_many_discs_is_several_documents(spark, tmp_path):
    axis = F.array(*[F.col("id") * 1.0] * 3)
    rows = spark.range(1000).select(
        "id", (F.col("id") % 3).cast("int").alias("set_id"), F.lit("s").alias("label"), axis.alias("center_xyz_m"), axis.alias("normal_xyz"),
        (F.col("id") % 7 + 0.5).alias("radius_m"), F.lit("none").alias("reconstruction"), F.lit("lower").alias("radius_status"),
    )
    counts = {}
    for name, some in (("many", rows), ("few", rows.filter("id < 90")), ("none", rows.filter("id < 0"))):
        path = str(tmp_path / name)
        source.write_domain(some, path, F.struct(F.lit(1).alias("seed")), most=100)
        assert source.read_domain(spark, path).exceptAll(some).count() == 0 and source.read_domain(spark, path).count() == some.count()
        documents = spark.read.text(path).select(F.get_json_object("value", "$.meta.seed").alias("seed"), F.size(F.from_json("value", source.DOMAIN_SCHEMA)["fractures"]).alias("n")).collect()
        assert {r["seed"] for r in documents} == {"1"}
        counts[name] = [r["n"] for r in documents]
    assert len(counts["many"]) == 10 and max(counts["many"]) < 200 and counts["few"] == [90] and counts["none"] == [0]
    assert [r["id"] for r in source.read_domain(spark, str(tmp_path / "many"), 2, [1]).collect()] == [13, 34]


def test_defaults_take_the_first_source(spark):
    base = spark.createDataFrame([(1,), (2,), (3,)], "set_id int")
    a = spark.createDataFrame([(1, 10.0)], "set_id int, v double")
    b = spark.createDataFrame([(1, 20.0), (2, 30.0)], "set_id int, w double")
    got = source.with_defaults(base, (a, "v"), (b, "w"), key="set_id", default=F.lit(0.0))
    assert {r["set_id"]: r["value"] for r in got.collect()} == {1: 10.0, 2: 30.0, 3: 0.0}


def test_stream_equals_table(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", F.col("event_type").alias("set_id"), F.col("value").alias("len"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    run = summaries.windowed_summary(stream).writeStream.outputMode("complete").format("memory").queryName("sums").start()
    try:
        run.processAllAvailable()
        got = {(r["start"], r["set_id"]): r["n"] for r in spark.table("sums").collect()}
    finally:
        run.stop()
    assert got == {(r["start"], r["set_id"]): r["n"] for r in summaries.windowed_summary(events).collect()}


def test_discs_repeat_and_lie_in_range(spark):
    a = sampling.discs(spark, 2000, 1, (10.0, 10.0, 10.0), 2.6, 0.5, 50.0, 1e4, 90.0, 0.0)
    row = a.agg(F.min("radius"), F.max("radius"), F.min("n.x"), F.avg("c.x")).first()
    assert row[0] >= 0.5 and row[1] <= 50 and row[2] > 0.95 and abs(row[3]) < 0.5
    assert a.exceptAll(sampling.discs(spark.newSession(), 2000, 1, (10.0, 10.0, 10.0), 2.6, 0.5, 50.0, 1e4, 90.0, 0.0)).count() == 0


def test_bootstrap_weights_average_one(spark):
    n = sampling.bootstrap(spark.range(2000), 5, 3, "id").agg(F.sum("weight")).first()[0]
    assert abs(n / 10_000 - 1) < 0.05
