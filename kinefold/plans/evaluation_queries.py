"""Queries of matching, scores and statistics, on pairs made from the recording's own boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinefold.operators import evaluation as ev
from kinefold.operators import recording as rec
from kinefold.plans.registry import Registry
from kinefold.plans.sqlbase import BASE
from kinefold.session import table

REGISTRY = Registry()
KEY = ["match_id", "frame"]

#: Truth: a line's boxes. Prediction: the same boxes moved by a rule, every seventh id lost.
_SETS = """truth as (select match_id, frame, p.id as id, p.box as box from entries where p.id is not null and len(p.box) = 4 qualify row_number() over (partition by match_id, frame, p.id order by pos) = 1),
pred as (select match_id, frame, id, [box[1] + id % 5, box[2] + frame % 4, box[3], box[4]] as box, ((id * 37 + frame) % 101) / 101.0::double as score from truth where id % 7 <> 0)"""


def _truth(spark, sf, *more):
    return rec.people_fields(table(spark, sf, "frames"), "box", *more).where(F.size("box") == 4)


def _pred(truth):
    g = lambda i: F.get("box", F.lit(i))
    moved = F.array(g(0) + F.col("id") % 5, g(1) + F.col("frame") % 4, g(2), g(3))
    return truth.where("id % 7 <> 0").select("match_id", "frame", "id", moved.alias("box"), (((F.col("id") * 37 + F.col("frame")) % 101) / F.lit(101.0)).alias("score"))


_CAND = """cand as (select * from (select t.match_id, t.frame, t.id as t, p.id as p, p.score, greatest(0, least(t.box[1] + t.box[3], p.box[1] + p.box[3]) - greatest(t.box[1], p.box[1])) as w,
  greatest(0, least(t.box[2] + t.box[4], p.box[2] + p.box[4]) - greatest(t.box[2], p.box[2])) as h, t.box[3] * t.box[4] + p.box[3] * p.box[4] as s from truth t join pred p using (match_id, frame)) where s - w * h > 0 and w * h / (s - w * h) >= 0.5)"""


@REGISTRY.add("overlap_candidates", f"with {BASE}, {_SETS}, {_CAND} select match_id, frame, t, p, w * h / (s - w * h) as iou from cand")
def overlap_candidates(spark, sf):
    t = _truth(spark, sf)
    return ev.overlap_candidates(t, _pred(t), KEY).drop("score")


@REGISTRY.add("best_overlap", f"with {BASE}, {_SETS}, {_CAND} select match_id, frame, p, t, w * h / (s - w * h) as iou from cand qualify row_number() over (partition by match_id, frame, p order by w * h / (s - w * h) desc, t) = 1")
def best_overlap(spark, sf):
    t = _truth(spark, sf)
    return ev.best_overlap(ev.overlap_candidates(t, _pred(t), KEY), KEY)


@REGISTRY.add("greedy_matches")
def greedy_matches(spark, sf):
    t = _truth(spark, sf)
    return ev.greedy_matches(ev.overlap_candidates(t, _pred(t), KEY), KEY)


@REGISTRY.add("average_precision")
def average_precision(spark, sf):
    t = _truth(spark, sf)
    p = _pred(t)
    return ev.average_precision(p, t, ev.greedy_matches(ev.overlap_candidates(t, p, KEY), KEY, "score"), KEY)


@REGISTRY.add("tracking_counts")
def tracking_counts(spark, sf):
    t = _truth(spark, sf)
    p = _pred(t)
    return ev.tracking_counts(t, p, ev.greedy_matches(ev.overlap_candidates(t, p, KEY), KEY), "match_id", "frame")


@REGISTRY.add("roles_from_truth")
def roles_from_truth(spark, sf):
    t = _truth(spark, sf, "role")
    p = _pred(t).withColumn("role", F.lit("player"))
    m = ev.greedy_matches(ev.overlap_candidates(t, p, KEY), KEY)
    return ev.with_truth(p, t, m, KEY, ["role"]).groupBy("role").agg(F.count("*").alias("n"))


@REGISTRY.add("bootstrap_interval")
def bootstrap_interval(spark, sf):
    """Medians of matches (impossible values stay in) and the paired difference of two halves of a match."""
    half = lambda k: F.avg(F.when(F.col("id") % 2 == k, F.col("sprints")))
    per = table(spark, sf, "analytics").groupBy("match_id").agg(F.percentile("max_speed_ms", F.lit(0.5)).alias("speed"), F.avg("sprints").alias("sprints"), (half(0) - half(1)).alias("even_less_odd"))
    return ev.bootstrap(per, "match_id", ["speed", "sprints", "even_less_odd"])


_Z = 1.959963984540054


@REGISTRY.add("wilson_intervals", f"""with s as (select ext, count(*) filter (status = 'done') as hits, count(*) as n from jobs group by ext), p as (select *, hits / n::double as p from s)
select ext, hits, n, (p + {_Z ** 2}::double / (2 * n) - {_Z}::double * sqrt(p * (1 - p) / n + {_Z ** 2}::double / (4 * n * n))) / (1 + {_Z ** 2}::double / n) as low,
  (p + {_Z ** 2}::double / (2 * n) + {_Z}::double * sqrt(p * (1 - p) / n + {_Z ** 2}::double / (4 * n * n))) / (1 + {_Z ** 2}::double / n) as high from p""")
def wilson_intervals(spark, sf):
    s = table(spark, sf, "jobs").groupBy("ext").agg(F.count_if(F.col("status") == "done").alias("hits"), F.count("*").alias("n"))
    low, high = ev.wilson(F.col("hits"), F.col("n"))
    return s.select("ext", "hits", "n", low.alias("low"), high.alias("high"))


@REGISTRY.add("latency_summary", "select status, count(seconds) as n, quantile_cont(seconds, 0.5) as p50, quantile_cont(seconds, 0.95) as p95, quantile_cont(seconds, 0.99) as p99 from jobs group by status")
def latency_summary(spark, sf):
    return ev.latency_summary(table(spark, sf, "jobs"), ["status"], "seconds").select("status", "n", "p50", "p95", "p99")


@REGISTRY.add("running_percentiles", "select event_id, quantile_cont(value, 0.5) over w as p50, quantile_cont(value, 0.95) over w as p95 from events window w as (partition by user_id order by ts, event_id rows between 199 preceding and current row)")
def running_percentiles(spark, sf):
    return ev.running_summary(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "p50", "p95")


@REGISTRY.add("peak_rate", """with c as (select match_id, line_no, frame from frames where frame is not null), d as (select match_id, frame, count(*) as k from c group by all), r as (select match_id, frame, sum(k) over (partition by match_id order by frame) as total from d),
p as (select a.match_id, a.frame, a.total, b.frame as f0, b.total as t0 from r a asof join r b on a.match_id = b.match_id and a.frame - 250 >= b.frame) select match_id, max((total - t0) / (frame - f0)) as peak from p group by match_id""")
def peak_rate(spark, sf):
    from pyspark.sql import Window
    per = table(spark, sf, "frames").where("frame is not null").groupBy("match_id", "frame").agg(F.count("*").alias("k"))
    r = per.select("match_id", "frame", F.sum("k").over(Window.partitionBy("match_id").orderBy("frame")).alias("total"))
    return ev.peak_rate(r, ["match_id"], "frame", "total", 250).where("peak is not null")


@REGISTRY.add("fragmentation", f"with {BASE} select match_id, jersey, team, count(distinct id) as tracks, count(*) as rows from people where jersey is not null and team is not null group by all")
def fragmentation(spark, sf):
    p = rec.people(rec.newest_lines(table(spark, sf, "frames"))).where("jersey is not null and team is not null")
    return p.groupBy("match_id", "jersey", "team").agg(F.count_distinct("id").alias("tracks"), F.count("*").alias("rows"))


@REGISTRY.add("evidence_coverage", f"with {BASE}, t as (select match_id, id, bool_or(jersey is not null) as held from people group by all) select match_id, count(*) as tracks, 100.0::double * count(*) filter (held) / count(*) as pct from t group by match_id")
def evidence_coverage(spark, sf):
    p = rec.people(rec.newest_lines(table(spark, sf, "frames")))
    t = p.groupBy("match_id", "id").agg(F.bool_or(F.col("jersey").isNotNull()).alias("held"))
    return t.groupBy("match_id").agg(F.count("*").alias("tracks"), (F.lit(100.0) * F.count_if("held") / F.count("*")).alias("pct"))


@REGISTRY.add("attribute_agreement", f"""with {BASE}, r as (select match_id, id, frame, team, jersey, lag(team) over w as pt, lag(jersey) over w as pj, lag(frame) over w as pf from people window w as (partition by match_id, id order by frame))
select match_id, count(*) as n, count(*) filter (team is not distinct from pt) as same_team, count(*) filter (jersey is not distinct from pj) as same_jersey from r where pf is not null group by match_id""")
def attribute_agreement(spark, sf):
    from pyspark.sql import Window
    w = Window.partitionBy("match_id", "id").orderBy("frame")
    r = rec.people(rec.newest_lines(table(spark, sf, "frames"))).select("match_id", F.col("team").eqNullSafe(F.lag("team").over(w)).alias("t"), F.col("jersey").eqNullSafe(F.lag("jersey").over(w)).alias("j"), F.lag("frame").over(w).alias("pf"))
    return r.where("pf is not null").groupBy("match_id").agg(F.count("*").alias("n"), F.count_if("t").alias("same_team"), F.count_if("j").alias("same_jersey"))


@REGISTRY.add("pivot_by_status", "select lower(ext) as ext, count(*) filter (status = 'done') as done, count(*) filter (status = 'failed') as failed, count(*) filter (status = 'queued') as queued, count(*) filter (status = 'running') as running from jobs group by lower(ext)")
def pivot_by_status(spark, sf):
    j = table(spark, sf, "jobs").withColumn("ext", F.lower("ext"))
    return j.groupBy("ext").pivot("status", ["done", "failed", "queued", "running"]).agg(F.count(F.lit(1))).na.fill(0)


@REGISTRY.add("latest_job", "select job_id, status, progress, frames from jobs qualify row_number() over (partition by job_id order by case status when 'queued' then 0 when 'running' then 1 else 2 end desc, progress desc nulls last, finished_at desc nulls last, frames desc nulls last) = 1")
def latest_job(spark, sf):
    from pyspark.sql import Window
    stage = F.when(F.col("status") == "queued", 0).when(F.col("status") == "running", 1).otherwise(2)
    w = Window.partitionBy("job_id").orderBy(stage.desc(), F.desc_nulls_last("progress"), F.desc_nulls_last("finished_at"), F.desc_nulls_last("frames"))
    return table(spark, sf, "jobs").withColumn("_k", F.row_number().over(w)).where("_k = 1").select("job_id", "status", "progress", "frames")


@REGISTRY.add("kmeans_step")
def kmeans_step(spark, sf):
    e = table(spark, sf, "embeddings")
    name = next(c for c, t in e.dtypes if t.startswith("array"))
    features = e.select(F.transform(name, lambda v: v.cast("double")).alias("features"))
    seeds = [r.features for r in features.orderBy(F.xxhash64("features")).limit(2).collect()]
    return ev.kmeans_step(features, seeds)


@REGISTRY.add("number_evidence", f"""with {BASE}, r as (select match_id, id, frame, try_cast(jersey as int) as n from people),
c as (select *, row_number() over (partition by match_id, id, n order by frame) as hits, row_number() over (partition by match_id, id order by frame) as total from r where n between 0 and 99)
select match_id, id, arg_min(n, frame)::int as number, min(frame) as since from c where hits >= 4 and hits >= 0.6::double * total group by match_id, id""")
def number_evidence(spark, sf):
    """Shirt numbers of tracks from readings: full evidence for the number read, of a hundred; the others, 0, are left out."""
    p = rec.people_fields(table(spark, sf, "frames"), "jersey").withColumn("n", F.col("jersey").try_cast("int")).where("n between 0 and 99")
    return ev.number_evidence(p.select("match_id", "id", "frame", F.create_map("n", F.lit(1.0)).alias("p"), F.lit(0.0).alias("pnone")), ["match_id", "id"], "frame")
