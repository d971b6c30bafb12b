"""Scans and sinks: round trips on small folders."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinefold.functions import scalars as sc
from kinefold.operators import logs
from kinefold.sources import files


def test_catalog_skips_what_is_malformed(spark, tmp_path):
    for name, text in (("a", '{"id": "m_1", "created_at": "2026-01-01"}'), ("b", '{"id": "m_2", "created_at": "2026-01-02", "frame_count": 3}'), ("c", "{oops"), ("d", '{"name": "no id"}')):
        (tmp_path / name).mkdir()
        (tmp_path / name / "meta.json").write_text(text)
    assert [r.id for r in files.read_catalog(spark, f"{tmp_path}/*/meta.json").collect()] == ["m_2", "m_1"]
    assert {(r.sequence, r.path.rsplit("/", 1)[1]) for r in files.list_files(spark, str(tmp_path), "*.json").collect()} == {(c, "meta.json") for c in "abcd"}
    assert files.without(spark.createDataFrame([("a",), (None,), ("b",)], "id string"), ["a"]).count() == 2


def test_labels_perception_and_arrays(spark, tmp_path):
    (tmp_path / "labels.json").write_text(json.dumps({"images": [{"image_id": "i1"}, {"image_id": "i2"}], "annotations": [
        {"id": "1", "image_id": "i2", "track_id": 4, "supercategory": "object", "attributes": {"role": "player"}}, {"id": "2", "image_id": "i1", "supercategory": "pitch"}]}))
    assert [(r.id, r.frame, r.attributes.role) for r in files.read_labels(spark, str(tmp_path / "labels.json")).collect()] == [("1", 1, "player")]
    (tmp_path / "clip.json").write_text(json.dumps({"seq": "s", "rows": [{"frame": 1, "track": 2, "cls": "player", "bbox": [0, 0, 1, 1], "pitch": None, "jersey": {"p": [0.5], "pnone": 0.1}}]}))
    row = files.read_perception(spark, str(tmp_path / "clip.json")).first()
    assert (row.seq, row.frame, row.track, row.bbox, row.jersey.p) == ("s", 1, 2, [0, 0, 1, 1], [0.5])
    np.savez(tmp_path / "x.npz", frame=np.arange(3), score=np.array([0.5, 0.25, 1.0]), box=np.ones((3, 4)))
    out = files.read_arrays(spark, str(tmp_path), {"frame": "bigint", "score": "double", "box": "array<double>"}).orderBy("frame").collect()
    assert [(r.frame, r.score, r.box) for r in out] == [(0, 0.5, [1.0] * 4), (1, 0.25, [1.0] * 4), (2, 1.0, [1.0] * 4)]


def test_text_figures_and_results(spark, tmp_path):
    (tmp_path / "log.txt").write_text("rate 12.5 tok/s\nnoise\nrate 7 tok/s\n")
    assert files.read_text_figures(spark, str(tmp_path / "log.txt"), {"rate": r"rate ([\d.]+)"}).first().rate == [12.5, 7.0]
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.json").write_text('{"hota": 0.5, "config": {"tracker": "x"}}')
    (tmp_path / "r" / "b.json").write_text('{"hota": 0.4}')
    (tmp_path / "r" / "c.json").write_text("not json")
    got = {(r.hota, r.tracker, r.fps) for r in files.read_results(spark, str(tmp_path / "r"), {"hota": 0.0, "tracker": "none", "fps": 25}).where("hota > 0").collect()}
    assert got == {(0.5, "x", 25), (0.4, "none", 25)}
    a = spark.createDataFrame([("x",), ("x",), ("y",)], "value string")
    assert sorted(r.value for r in files.new_lines(a, a.limit(1)).collect()) == ["x", "y"]


def test_exports(spark, tmp_path):
    p = spark.createDataFrame([(1, 7, "left", None, "player", 1.0, 2.0), (1, 8, "left", "9", "player", None, None)], "frame bigint, id bigint, team string, jersey string, role string, x double, y double")
    files.write_positions(p, str(tmp_path / "p"))
    assert spark.read.option("header", True).csv(str(tmp_path / "p")).count() == 1
    boxes = spark.createDataFrame([(f, 1, [0.0, 0.0, 1.0, 1.0]) for f in (1, 2, 3)], "frame int, id int, box array<double>")
    files.write_boxes_until(boxes, 2, str(tmp_path / "gt"))
    assert spark.read.text(str(tmp_path / "gt")).count() == 2
    doc = json.loads(files.prediction_documents(spark.createDataFrame([("s", 2, 1, 0.5), ("s", 1, 3, None)], "seq string, frame bigint, track bigint, score double")).first().document)
    assert doc == {"predictions": [{"frame": 1, "track": 3, "score": None}, {"frame": 2, "track": 1, "score": 0.5}]}
    answers = spark.createDataFrame([("m", 0, f, 1, "player", "left", "7", 1.234, 2.0) for f in (1, 2)], "match_id string, delay int, frame bigint, id bigint, role string, team string, jersey string, x double, y double")
    lines = files.live_lines(answers)
    assert json.loads(files.newest_only(lines, 0).first().value) == {"frame": 2, "delay": 0, "people": [{"id": 1, "role": "player", "team": "left", "jersey": "7", "xy": [1.23, 2.0]}]}
    files.write_labels(answers.select("match_id", "frame"), str(tmp_path / "tsv"))
    assert spark.read.option("sep", "\t").csv(str(tmp_path / "tsv")).count() == 2


def test_live_sink_of_a_stream(spark, tmp_path):
    kind = "match_id string, delay int, frame bigint, id bigint, role string, team string, jersey string, x double, y double"
    spark.createDataFrame([("m", d, 1, 1, "player", "left", "7", 1.0, 2.0) for d in (0, 25)], kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = files.write_live(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {p.name for p in (tmp_path / "out").glob("delay=*")} == {"delay=0", "delay=25"}


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("v")).first().v
    assert get(sc.clock(F.lit(61.25))) == "1:01.2" and get(sc.clock(F.lit(float("nan")))) == "0:00.0" and get(sc.duration(F.lit(59.6))) == "1:00"
    assert get(sc.bytes_text(F.lit(1536))) == "1.5 KB" and get(sc.bytes_text(F.lit(3_145_728))) == "3.0 MB"
    assert get(sc.heat_colour(F.lit(5.0), F.lit(10.0))) == "rgb(255, 176, 32)" and get(sc.heat_colour(F.lit(1.0), F.lit(0.0))) == "rgb(13, 17, 16)"
    assert get(sc.display_name(F.lit("  "), F.lit("/a/b.c.jsonl"))) == "b.c" and get(sc.display_name(F.lit(None).cast("string"), F.lit(None).cast("string"))) == "match"
    assert get(sc.seconds_in(F.lit(" 60 "))) == 60 and get(sc.seconds_in(F.lit("nan"))) is None and get(sc.seconds_in(F.lit("4"))) is None
    assert get(sc.escaped(F.lit("<a & 'b'>"))) == "&lt;a &amp; &#x27;b&#x27;&gt;"
    d = get(sc.digits(F.lit(7)))
    assert (d.tens, d.ones) == (10, 7) and get(sc.number_of(F.lit(4), F.lit(2))) == 42
    tens, ones = np.full(11, 0.0), np.full(11, 0.0)
    tens[[1, 10]], ones[3] = (0.25, 0.75), 1.0
    p = get(sc.number_distribution(F.array(*map(F.lit, tens.tolist())), F.array(*map(F.lit, ones.tolist()))))
    assert p[3] == 0.75 and p[13] == 0.25 and sum(p) == 1.0
    assert get(sc.sharpened(F.array(F.lit(0.6), F.lit(0.2)), F.lit(0.2), power=2.0)) == pytest.approx([0.9, 0.1]) and get(sc.sharpened(F.array(F.lit(0.6)), F.lit(0.9), legible=0.5)) == [0.0]
    assert get(sc.softmax(F.array(F.lit(0.0), F.lit(0.0)))) == [0.5, 0.5]
    assert get(sc.clipped_box(F.array(*map(F.lit, (-5.0, 0.0, 10.0, 10.0))), 100, 100)) == [0.0, 0.0, 5.0, 10.0] and get(sc.clipped_box(F.array(*map(F.lit, (-50.0, 0.0, 10.0, 10.0))), 100, 100)) is None
    assert get(sc.retry_after(F.lit(9.5), F.lit(0.0), 10.0)) == 1 and get(sc.glide_rate(F.lit(9.0), 0.1)) == 0.29 and get(sc.swapped_team(F.lit("left"))) == "right"
    assert get(F.size(sc.chunk_ranges(F.lit(5), F.lit(4), 10))) == 0 and get(sc.chunk_start(F.lit(27), F.lit(5), 10)) == 25 and get(sc.half_up(F.lit(-0.5))) == 0
    many = spark.range(20_000).select(sc.hashed_noise(2.0, 1, F.col("id")).alias("v"), sc.hashed_share(3, F.col("id")).alias("u"))
    r = many.agg(F.avg("v").alias("m"), F.stddev("v").alias("s"), F.avg("u").alias("u")).first()
    assert abs(r.m) < 0.05 and abs(r.s - 2) < 0.05 and abs(r.u - 0.5) < 0.01


def test_logs(spark):
    e = spark.createDataFrame([("instance", "a", 1, 1, True), ("instance", "a", 1, 2, False), ("start", "a", 1, 3, None), ("instance", "b", 1, 1, True)], "event string, arm string, iid int, t int, resolved boolean")
    last = logs.last_records(e, ["arm", "iid"], "t")
    assert {(r.arm, r.resolved) for r in last.collect()} == {("a", False), ("b", True)}
    assert logs.paired_arms(last, "a", "b", "iid").first().asDict() == {"common": 1, "both": 0, "only_a": 0, "only_b": 1, "neither": 0}
    rows = spark.createDataFrame([("k", 0, 1.0), ("k", 1, None), ("k", 2, 2.0)], "k string, t int, v double")
    assert [round(r.v, 6) for r in logs.smoothed_looks(rows, ["k"], "t", "v").orderBy("t").collect()] == [1.0, 1.1]
