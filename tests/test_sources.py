from pyspark.sql import functions as F

from meridia.sources import tables
from meridia.streaming import events


def test_csv_and_geojson(spark, tmp_path):
    df = spark.createDataFrame([("1", None, 'a "b" | c'), ("2", "x", "")], "id string, v string, t string")
    tables.write_csv(df, str(tmp_path / "c"), ["id", "v", "t"])
    assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "c"), ["id", "v", "t"]).collect()))[0] == ("1", None, 'a "b" | c')
    f = tables.geojson_features(spark.createDataFrame([(1.5, 2.5, "n")], "x double, y double, name string"), tables.point_geometry("x", "y"), ["name"]).first().value
    (tmp_path / "g.json").write_text('{"type":"FeatureCollection","features":[' + f + "]}")
    assert tuple(tables.read_geojson(spark, str(tmp_path / "g.json"), "struct<name:string>").first())[:4] == ("n", "Point", 1.5, 2.5)
    (tmp_path / "k.json").write_text('{"a":{"n":1},"b":{"n":null}}')
    keyed = tables.read_keyed_json(spark, str(tmp_path / "k.json"), "id", "struct<n:int>")
    assert sorted(map(tuple, keyed.collect())) == [("a", 1), ("b", None)]
    todo = tables.pending(spark.createDataFrame([("a",), ("b",), ("c",)], "id string"), keyed, "id", "n")
    assert sorted(r.id for r in todo.collect()) == ["b", "c"]


def test_stream_equals_batch(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(path)
    (tmp_path / "in").mkdir()
    batch.write.parquet(str(tmp_path / "in" / "e"))
    stream = events.windowed_counts(events.new_files(spark, str(tmp_path / "in" / "e"), batch.schema))
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("counts").agg(F.sum("n")).first()[0]
    assert got == batch.count()
