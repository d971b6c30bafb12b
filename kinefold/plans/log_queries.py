"""Queries of scalars, logs and keyframes, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinefold.functions import scalars as sc
from kinefold.operators import logs
from kinefold.operators import recording as rec
from kinefold.plans.recording_queries import _lines, _people
from kinefold.plans.registry import Registry
from kinefold.plans.sqlbase import BASE
from kinefold.session import table

REGISTRY = Registry()


@REGISTRY.add("match_texts", r"""select id, printf('%d:%02d.%d', (t // 600)::int, ((t % 600) // 10)::int, (t % 10)::int) as clock, printf('%d:%02d', (d // 60)::int, (d % 60)::int) as duration,
 case when s < 1048576 then printf('%.1f KB', s / 1024) else printf('%.1f MB', s / 1048576) end as size, coalesce(nullif(trim(name), ''), id) as shown, case when length(name) > 20 then 'too long' when regexp_matches(name, '[\x00-\x1f\x7f]') then 'control character' end as problem,
 case when regexp_full_match(colors.left, '#[0-9A-Fa-f]{6}') then lower(colors.left) else '#888888' end as colour
from (select *, floor(coalesce(duration_s, 0) * 10 + 1e-9)::bigint as t, floor(coalesce(duration_s, 0) + 0.5)::bigint as d, coalesce(size_bytes, 0)::double as s from matches)""")
def match_texts(spark, sf):
    name = F.col("name")
    return table(spark, sf, "matches").select("id", sc.clock(F.col("duration_s")).alias("clock"), sc.duration(F.col("duration_s")).alias("duration"), sc.bytes_text(F.col("size_bytes")).alias("size"),
                                              sc.display_name(name, F.concat("id", F.lit(".jsonl"))).alias("shown"), sc.text_problem(name, 20).alias("problem"), sc.colour(F.col("colors.left"), "#888888").alias("colour"))


@REGISTRY.add("heat_colours", """with t as (select event_id, least(1, greatest(0, value / 100)) as t from events), f as (select *, case when t <= 0.5 then t / 0.5 else (t - 0.5) / 0.5 end as f from t)
select event_id, 'rgb(' || floor(case when t <= 0.5 then 13 + 242 * f else 255 + 0 * f end + 0.5)::int || ', ' || floor(case when t <= 0.5 then 17 + 159 * f else 176 - 117 * f end + 0.5)::int || ', ' || floor(case when t <= 0.5 then 16 + 16 * f else 32 + 16 * f end + 0.5)::int || ')' as colour from f""")
def heat_colours(spark, sf):
    return table(spark, sf, "events").select("event_id", sc.heat_colour(F.col("value"), F.lit(100.0)).alias("colour"))


@REGISTRY.add("shirt_digits", f"with {BASE}, n as (select match_id, id, frame, try_cast(jersey as int) as n from people) select match_id, id, frame, case when n < 10 then 10 else n // 10 end::int as tens, (n % 10)::int as ones, n as number from n where n between 0 and 99")
def shirt_digits(spark, sf):
    d = _people(spark, sf).select("match_id", "id", "frame", sc.digits(F.col("jersey").try_cast("int")).alias("d")).where("d is not null")
    return d.select("match_id", "id", "frame", "d.tens", "d.ones", sc.number_of(F.col("d.tens"), F.col("d.ones")).alias("number"))


@REGISTRY.add("chunk_ranges", f"with {BASE} select match_id, c as start, least(c + 999, last_frame) as \"end\" from (select match_id, last_frame, unnest(range(first_frame, last_frame + 1, 1000)) as c from firsts)")
def chunk_ranges(spark, sf):
    c = rec.catalog(_lines(spark, sf))
    return c.select("match_id", F.explode(sc.chunk_ranges(F.col("first_frame"), F.col("last_frame"), 1000)).alias("c")).select("match_id", "c.start", "c.end")


@REGISTRY.add("job_progress", "select job_id, status, frames, case when seconds is null or seconds = 0 then null when floor(seconds * 25) > 0 then least(1.0::double, greatest(frames, 0) / floor(seconds * 25)) else 1.0 end as progress from jobs")
def job_progress(spark, sf):
    return table(spark, sf, "jobs").select("job_id", "status", "frames", sc.progress_fraction(F.col("frames"), F.col("seconds")).alias("progress"))


@REGISTRY.add("jobs_after_restart", "select job_id, case when status = 'running' then 'failed' else status end as status, case when status = 'running' then coalesce(error, 'interrupted by a restart') else error end as error from jobs")
def jobs_after_restart(spark, sf):
    return logs.recovered(table(spark, sf, "jobs")).select("job_id", "status", "error")


@REGISTRY.add("jobs_kept", "select job_id, status, finished_at from jobs where not coalesce(status in ('done', 'failed') and epoch(timestamp '2026-06-01 00:00:00') - epoch(try_cast(replace(finished_at, 'Z', '') as timestamp)) > 24 * 3600, false)")
def jobs_kept(spark, sf):
    return logs.purged(table(spark, sf, "jobs"), "2026-06-01 00:00:00").select("job_id", "status", "finished_at")


_ARMS = "select coalesce(lower(ext), 'none') as arm, job_id as iid, status = 'done' as resolved, coalesce(seconds, 0) as wall_s, coalesce(frames, 0) as api_calls, case when status = 'failed' then 'LimitsExceeded' else status end as exit_status from jobs"


def _arms(spark, sf):
    s = F.col("status")
    return table(spark, sf, "jobs").select(F.coalesce(F.lower("ext"), F.lit("none")).alias("arm"), F.col("job_id").alias("iid"), (s == "done").alias("resolved"), F.coalesce("seconds", F.lit(0.0)).alias("wall_s"),
                                           F.coalesce("frames", F.lit(0)).alias("api_calls"), F.when(s == "failed", "LimitsExceeded").otherwise(s).alias("exit_status"))


@REGISTRY.add("arm_table", f"select arm, count(*) as instances, count(*) filter (resolved) as resolved, avg(wall_s) as mean_s, avg(api_calls) as mean_calls, count(*) filter (exit_status = 'LimitsExceeded') as limit_hits from ({_ARMS}) group by arm")
def arm_table(spark, sf):
    return logs.arm_table(_arms(spark, sf)).drop("low", "high")


_PAIRED = "select user_id as iid, event_type as arm, avg(value) > 50 as resolved from events group by user_id, event_type"


@REGISTRY.add("paired_arms", f"""with i as ({_PAIRED}), p as (select iid, bool_or(resolved) filter (arm = 'click') as ra, bool_or(resolved) filter (arm = 'view') as rb from i where arm in ('click', 'view') group by iid)
select count(*) as common, count(*) filter (ra and rb) as both, count(*) filter (ra and not rb) as only_a, count(*) filter (not ra and rb) as only_b, count(*) filter (not ra and not rb) as neither from p where ra is not null and rb is not null""")
def paired_arms(spark, sf):
    per = table(spark, sf, "events").groupBy(F.col("user_id").alias("iid"), F.col("event_type").alias("arm")).agg((F.avg("value") > 50).alias("resolved"))
    return logs.paired_arms(per, "click", "view", "iid")


@REGISTRY.add("concurrency_table", """with s as (select l_linenumber as level, l_suppkey % 5 as repeat, l_quantity as tokens, l_discount * 10 as start_s, l_discount * 10 + 1 + l_tax as end_s from lineitem),
r as (select level, repeat, sum(tokens) / (max(end_s) - min(start_s)) as a, avg(tokens / (end_s - start_s)) as p from s group by all) select level, floor(avg(a) * 10 + 0.487)::bigint as aggregate_d, floor(avg(p) * 10 + 0.487)::bigint as per_stream_d from r group by level""")
def concurrency_table(spark, sf):
    s = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("level"), (F.col("l_suppkey") % 5).alias("repeat"), F.col("l_quantity").alias("tokens"), (F.col("l_discount") * 10).alias("start_s"), (F.col("l_discount") * 10 + 1 + F.col("l_tax")).alias("end_s"))
    return logs.concurrency_table(s).select("level", F.floor(F.col("aggregate") * 10 + 0.487).alias("aggregate_d"), F.floor(F.col("per_stream") * 10 + 0.487).alias("per_stream_d"))


@REGISTRY.add("usage_statistics", """select event_type, count(*) as turns, count(case when user_id % 2 = 0 then user_id end) as tools, floor(sum(value) + 0.487)::bigint as output, max(user_id) as largest_context,
 max(case when user_id * 10 > 500 and value > 50 then value / (user_id * 10 / 1000.0::double) end) as top_rate from events group by event_type""")
def usage_statistics(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.when(F.col("user_id") % 2 == 0, F.col("user_id")).alias("tool"), F.col("value").alias("output"), F.col("user_id").alias("context"), (F.col("user_id") * 10).cast("double").alias("ms"))
    u = logs.usage_statistics(e, ["event_type"], "tool", "output", "context", "ms")
    return u.select("event_type", "turns", "tools", F.floor(F.col("output") + 0.487).alias("output"), "largest_context", "top_rate")


@REGISTRY.add("calibration_errors", f"""with {BASE}, e as (select b.match_id, sqrt((b.x - round(b.x)) * (b.x - round(b.x)) + (b.y - round(b.y)) * (b.y - round(b.y))) as err from balls b)
select match_id, count(err) as n, quantile_cont(err, 0.5) as median, quantile_cont(err, 0.9) as p90, count(*) filter (err < 0.4) / nullif(count(err), 0)::double as share_near from e group by match_id""")
def calibration_errors(spark, sf):
    """Distance of the ball from the nearest whole metre stands for a calibration error."""
    off = lambda c: F.col(c) - F.round(c)
    e = rec.balls(_lines(spark, sf)).select("match_id", F.sqrt(off("x") * off("x") + off("y") * off("y")).alias("err"))
    return logs.error_statistics(e, ["match_id"], "err", 0.4).select("match_id", "n", "median", "p90", "share_near")


@REGISTRY.add("cache_schedule", f"with {BASE} select match_id, count(*) as frames, count(*) filter (frame % 10 = 0) as keyframes, 1 - count(*) filter (frame % 10 = 0) / count(*)::double as hit_rate from lines group by match_id")
def cache_schedule(spark, sf):
    return logs.schedule(_lines(spark, sf).where("frame is not null and match_id is not null"), 10)


# Shifts along the pitch, in whole units: the carried shift is the keyframe's and those of the frames since.
@REGISTRY.add("carried_keyframes", f"""with {BASE}, r as (select match_id as seq, frame, row_number() over (partition by match_id order by frame) as n from lines), k as (select seq, frame as kf from r where n % 50 = 1),
a as (select r.seq, r.frame, max(kf) as keyframe from r join k on k.seq = r.seq and k.kf <= r.frame - 20 group by all)
select a.seq, a.frame, a.keyframe, (keyframe % 7 + coalesce((select sum(m.frame % 3) from r m where m.seq = a.seq and m.frame > a.keyframe and m.frame <= a.frame and m.n % 9 <> 0), 0))::double as shift from a""")
def carried_keyframes(spark, sf):
    """A keyframe on every 50th line, known 20 frames late; a motion on every line but each ninth."""
    from pyspark.sql import Window
    r = _lines(spark, sf).select(F.col("match_id").alias("seq"), "frame").withColumn("n", F.row_number().over(Window.partitionBy("seq").orderBy("frame")))
    shift = lambda c: F.array(*[F.lit(float(v)) if k != 2 else c.cast("double") for k, v in enumerate((1, 0, 0, 0, 1, 0, 0, 0, 1))])
    keys = r.where("n % 50 = 1").select("seq", "frame", shift(F.col("frame") % 7).alias("h"))
    motions = r.select("seq", "frame", F.when(F.col("n") % 9 != 0, shift(F.col("frame") % 3)).alias("m"))
    return logs.carried(keys, motions, 20).select("seq", "frame", "keyframe", F.get("h", F.lit(2)).alias("shift"))


@REGISTRY.add("rounded_readings", f"with {BASE} select match_id, frame, id, round(x, 1) + 0.0::double as x, round(y, 1) + 0.0::double as y from points where abs(x * 10 - floor(x * 10) - 0.5) > 1e-6 and abs(y * 10 - floor(y * 10) - 0.5) > 1e-6")
def rounded_readings(spark, sf):
    """Rounding inside a struct; halves, on which engines differ, are tested on their own."""
    half = lambda c: F.abs(F.col(c) * 10 - F.floor(F.col(c) * 10) - 0.5) > 1e-6
    p = rec.positioned(_people(spark, sf)).where(half("x") & half("y"))
    return sc.rounded(p.select("match_id", "frame", "id", F.struct("x", "y").alias("xy")), 1).select("match_id", "frame", "id", (F.col("xy.x") + 0.0).alias("x"), (F.col("xy.y") + 0.0).alias("y"))


@REGISTRY.add("between_frames", f"""with {BASE}, pairs as (select match_id, id, frame, x, y, lead(frame) over w as nf, lead(x) over w as nx, lead(y) over w as ny, lead(role) over w as nr, role from people window w as (partition by match_id, id order by frame)),
nl as (select match_id, frame, lead(frame) over (partition by match_id order by frame) as nf from lines)
select p.match_id, p.id, p.frame, 0.0::double + case when x is null or nx is null then x else x + (nx - x) * 0.25 end as x, 0.0::double + case when y is null or ny is null then y else y + (ny - y) * 0.25 end as y
from pairs p join nl on nl.match_id = p.match_id and nl.frame = p.frame and nl.nf = p.nf""")
def between_frames(spark, sf):
    lines = _lines(spark, sf)
    m = rec.between_frames(_people(spark, sf), lines, 0.25)
    return m.select("match_id", "id", "frame", (F.col("x") + 0.0).alias("x"), (F.col("y") + 0.0).alias("y"))
