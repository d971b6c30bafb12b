"""Matching and evidence at size: what is compiled, read and shuffled, and that results stay the same."""

import pytest
from pyspark.sql import functions as F

from kinefold.functions.geometry import box_overlap
from kinefold.operators import evaluation as ev
from kinefold.operators import recording as rec
from kinefold.plans import evaluation_queries as queries

BOX = "f bigint, id bigint, box array<double>, score double"
#: Overlapping, apart, touching, empty, of negative size, with a null, with NaN and infinity.
BOXES = [[0.0, 0.0, 10.0, 10.0], [3.0, 0.0, 10.0, 10.0], [100.0, 0.0, 10.0, 10.0], [10.0, 0.0, 10.0, 10.0], [0.0, 0.0, 0.0, 0.0], [9.0, 9.0, -9.0, -9.0],
         [None, 0.0, 10.0, 10.0], [0.0, 0.0, None, 10.0], [float("nan"), 0.0, 10.0, 10.0], [0.0, 0.0, float("inf"), 10.0], [5.0, 5.0, -9.0, 20.0], [0.1, 0.2, 9.7, 10.3]]


@pytest.mark.parametrize("least", [0.5, 0.3, 0.0, -1.0])
def test_pairs_are_those_of_the_overlap_of_boxes(spark, least):
    t = spark.createDataFrame([(1, k, b, 1.0) for k, b in enumerate(BOXES)], BOX)
    p = t.select("f", (F.col("id") + 50).alias("id"), "box", "score")
    got = {(r.t, r.p, str(r.iou)) for r in ev.overlap_candidates(t, p, ["f"], least).collect()}
    pairs = t.select(F.col("id").alias("t"), F.col("box").alias("a")).crossJoin(p.select(F.col("id").alias("p"), F.col("box").alias("b")))
    all_pairs = pairs.withColumn("iou", box_overlap(F.col("a"), F.col("b"))).where(F.col("iou") >= least)
    assert got == {(r.t, r.p, str(r.iou)) for r in all_pairs.collect()} and len(got) > 10


def test_the_join_of_boxes_is_small_enough_to_be_compiled(spark):
    t = spark.createDataFrame([(1, k, b, 1.0) for k, b in enumerate(BOXES[:4])], BOX).hint("merge")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the plan has no code before it runs
    try:
        moved = F.array(*[F.get("box", F.lit(i)) + F.lit(1.0) for i in range(4)])
        plan = ev.overlap_candidates(t, t.withColumn("box", moved), ["f"])._jdf.queryExecution().executedPlan()
        code = getattr(getattr(spark.sparkContext._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenStringSeq(plan)
        sizes = [code.apply(i)._3().maxMethodCodeSize() for i in range(code.size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert sizes and max(sizes) <= 8000  # bytes; longer methods are interpreted


def test_people_carry_only_the_fields_asked_for(spark, make_frames, tmp_path):
    frames = make_frames([(("m", 1), [(1, 0, 0, "player"), (1, 1, 1, "referee"), (None, 0, 0), (2, 0, 0, "goalkeeper")]), (("m", 1), [(3, 0, 0), (3, 1, 1)]), (("m", 2), None), (("m", 3), [(4, 0, 0)])])
    frames.write.parquet(str(tmp_path / "frames.parquet"))
    read = spark.read.parquet(str(tmp_path / "frames.parquet"))
    assert {(r.frame, r.id, r.role) for r in rec.people_fields(read, "role").collect()} == {(1, 3, "player"), (3, 4, "player")}
    p = rec.people(rec.newest_lines(read)).select("match_id", "frame", "id", "box")
    assert sorted(map(repr, rec.people_fields(read, "box").collect())) == sorted(map(repr, p.collect()))
    plan = queries.tracking_counts(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert scans and not any(f"{name}:" in line for line in scans for name in ("role", "team", "jersey", "xy"))


EVIDENCE = "k bigint, o bigint, p array<double>, pnone double"


@pytest.mark.parametrize("sparse", [False, True])
def test_evidence_commits_at_the_first_moment(spark, sparse):
    unsure, seven = [0.1] * 10, [0.0] * 7 + [0.9, 0.1, 0.0]
    rows = [(1, o, seven if o % 3 else unsure, 0.0) for o in range(20)] + [(2, o, seven, 1.0) for o in range(9)] + [(3, o, [0.0, 1.0, 1.0], 0.0) for o in range(9)]
    rows += [(4, o, [0.0, 0.0, 1.0] if o < 3 else [1.0, 0.0, 0.0], 0.0) for o in range(12)] + [(5, 0, None, 0.0), (5, 1, [None, 5.0], 0.0)]
    want = {}
    for key in {r[0] for r in rows}:
        sums = {}
        for _, o, p, none in sorted(r for r in rows if r[0] == key and r[2]):
            for n, v in enumerate(p):
                sums[n] = sums.get(n, 0.0) + (v or 0.0) * (1 - none)
            s, n = max((s, -n) for n, s in sums.items())
            if key not in want and s >= 4 and s >= 0.6 * sum(sums.values()):
                want[key] = (-n, o)
    df = spark.createDataFrame(rows, EVIDENCE)
    if sparse:
        df = df.withColumn("p", F.map_from_entries(F.filter(F.transform("p", lambda v, i: F.struct(i.alias("n"), v.alias("v"))), lambda e: e["v"] != 0)))
    assert {r.k: (r.number, r.since) for r in ev.number_evidence(df, ["k"], "o").collect()} == want
    assert set(want) == {1, 4, 5}


def test_evidence_that_is_nought_is_not_shuffled(spark):
    rows = spark.range(200).select((F.col("id") % 4).alias("k"), F.col("id").alias("o"), F.transform(F.sequence(F.lit(0), F.lit(99)), lambda n: F.when(n == 7, 1.0).otherwise(0.0)).alias("p"), F.lit(0.0).alias("pnone"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = ev.number_evidence(rows, ["k"], "o")
        assert {(r.number, r.since) for r in df.collect()} == {(7, 12 + k) for k in range(4)}
        shuffled, nodes = [], [df._jdf.queryExecution().executedPlan()]
        while nodes:
            node = nodes.pop()
            if node.nodeName() == "Exchange":
                shuffled.append(node.metrics().apply("shuffleRecordsWritten").value())
            nodes += [node.children().apply(i) for i in range(node.children().size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert shuffled and max(shuffled) <= 200  # one for each row, not one for each row and number
