"""Queries over recordings, each with its SQL twin.

Lengths are compared in whole units cut off-centre (see ``q``), as sums of doubles depend on
their order.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from kinefold.functions.geometry import box_overlap, determinant, foot_point, on_pitch, project
from kinefold.functions.labels import canonical_label
from kinefold.operators import features as feat
from kinefold.operators import recording as rec
from kinefold.plans.registry import Registry
from kinefold.plans.sqlbase import BASE, COUNTED, MODES, STEPS
from kinefold.session import table

REGISTRY = Registry()


def q(c, scale: int):
    """Whole units of 1 / scale; the cut lies where two-decimal inputs do not fall."""
    return F.floor(F.col(c) * scale + 0.487).cast("bigint") if isinstance(c, str) else F.floor(c * scale + 0.487).cast("bigint")


def qs(c: str, scale: int) -> str:
    """SQL twin of :func:`q`."""
    return f"cast(floor(({c}) * {scale} + 0.487) as bigint)"


def far(c: str) -> str:
    """Whole centimetres, beyond a kilometre whole metres (sums of large doubles keep fewer digits); reads the same in both dialects."""
    return f"case when abs({c}) < 1000 then cast(floor(({c}) * 100 + 0.487) as bigint) else cast(floor(({c}) + 0.487) as bigint) * 100 end"


def _lines(spark, sf):
    return rec.newest_lines(table(spark, sf, "frames"))


def _people(spark, sf):
    return rec.people(_lines(spark, sf))


def _points(spark, sf):
    return rec.positioned(_people(spark, sf))


def _balls(spark, sf):
    return rec.balls(_lines(spark, sf))


def _firsts(spark, sf):
    return _lines(spark, sf).groupBy("match_id").agg(F.min("frame").alias("first_frame"))


def nz(c: str):
    """The column with minus zero as zero."""
    return (F.col(c) + F.lit(0.0)).alias(c)


@REGISTRY.add("clean_lines", f"with {BASE} select match_id, frame, line_no, len(people) as people from lines")
def clean_lines(spark, sf):
    size = F.when(F.col("people").isNotNull(), F.size("people")).cast("bigint")
    return _lines(spark, sf).select("match_id", "frame", "line_no", size.alias("people"))


@REGISTRY.add("first_entries", f"with {BASE} select match_id, frame, id, pos, role, team, jersey, x + 0.0::double as x, y + 0.0::double as y from people")
def first_entries(spark, sf):
    return _people(spark, sf).select("match_id", "frame", "id", F.col("pos").cast("bigint").alias("pos"), "role", "team", "jersey", nz("x"), nz("y"))


@REGISTRY.add("catalog", f"""with {BASE} select l.match_id, f.frames as frame_count, f.first_frame, f.last_frame, (f.last_frame - f.first_frame + 1) / 25.0::double as duration_s, coalesce(l.delay, 0) as delay
from firsts f join lines l on l.match_id = f.match_id and l.frame = f.first_frame""")
def catalog(spark, sf):
    return rec.catalog(_lines(spark, sf)).drop("colors")


@REGISTRY.add("last_colors", f"""with {BASE} select match_id, colors.left as left_color, colors.right as right_color from (select *, row_number() over (partition by match_id order by frame desc) as k from lines where colors is not null) where k = 1""")
def last_colors(spark, sf):
    return rec.catalog(_lines(spark, sf)).where("colors is not null").select("match_id", F.col("colors.left").alias("left_color"), F.col("colors.right").alias("right_color"))


@REGISTRY.add("steps", f"with {BASE}, {STEPS} select match_id, id, f0, f1, gap, d, t, v, counted from steps")
def steps(spark, sf):
    return rec.steps(_points(spark, sf)).select("match_id", "id", "f0", "f1", "gap", "d", "t", "v", "counted")


@REGISTRY.add("player_summary", f"""with {BASE}, {STEPS}, {MODES},
moved as (select match_id, id, sum(case when counted then d end) as d, sum(case when counted then gap end) as g, max(case when counted then v end) as v from steps group by match_id, id),
runs as (select match_id, id, count(*) as s from sprints group by match_id, id),
who as (select match_id, id, count(*) as frames from people group by match_id, id)
select w.match_id, w.id, r.role, t.team, j.jersey, w.frames, w.frames / 25.0::double as seconds, {qs('coalesce(d, 0)', 10)} as distance_dm,
       {qs('coalesce(d / nullif(g / 25.0::double, 0), 0)', 100)} as avg_cm_s, coalesce(v, 0) as max_speed_ms, coalesce(s, 0) as sprints
from who w left join m_role r using (match_id, id) left join m_team t using (match_id, id) left join m_jersey j using (match_id, id) left join moved m using (match_id, id) left join runs s using (match_id, id)""")
def player_summary(spark, sf):
    s = rec.player_summary(_people(spark, sf))
    return s.select("match_id", "id", "role", "team", "jersey", "frames", "seconds", q("distance_m", 10).alias("distance_dm"), q("avg_speed_ms", 100).alias("avg_cm_s"), "max_speed_ms", "sprints")


@REGISTRY.add("player_summary_smoothed")
def player_summary_smoothed(spark, sf):
    p = _people(spark, sf)
    smooth = rec.smoothed(rec.positioned(p))
    return rec.player_summary(p.drop("x", "y").join(smooth, ["match_id", "id", "frame"], "left"))


@REGISTRY.add("sprint_runs", f"with {BASE}, {STEPS} select match_id, id, start_frame, end_frame, gap, {qs('mm / 1000.0::double', 10)} as distance_dm, v as max_speed from sprints")
def sprint_runs(spark, sf):
    s = rec.steps(_points(spark, sf))
    runs = rec.sprint_runs(s.withColumn("d", q("d", 1000)))
    return runs.select("match_id", "id", "start_frame", "end_frame", "gap", q(F.col("distance_m") / F.lit(1000.0), 10).alias("distance_dm"), "max_speed")


@REGISTRY.add("segments", f"""with {BASE}, cut as (select match_id, id, frame, sum(case when gap > 5 then 1 else 0 end) over (partition by match_id, id order by frame) as segment from (
  select *, frame - lag(frame) over (partition by match_id, id order by frame) as gap from points))
select match_id, id, segment, min(frame) as start_frame, max(frame) as end_frame, count(*) as points from cut group by match_id, id, segment""")
def segments(spark, sf):
    return rec.segments(_points(spark, sf)).groupBy("match_id", "id", "segment").agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.count("*").alias("points"))


@REGISTRY.add("smoothed", f"""with {BASE}, cut as (select *, sum(case when gap > 5 then 1 else 0 end) over (partition by match_id, id order by frame) as segment from (
  select *, frame - lag(frame) over (partition by match_id, id order by frame) as gap, count(*) over (partition by match_id, id) as n, lead(frame) over (partition by match_id, id order by frame) as nf from points)),
disp as (select *, x - lag(x) over w as dx, y - lag(y) over w as dy from cut window w as (partition by match_id, id, segment order by frame)),
med as (select *, case when dx is null then 0 else quantile_cont(dx, 0.5) over w end as mx, case when dy is null then 0 else quantile_cont(dy, 0.5) over w end as my
        from disp window w as (partition by match_id, id, segment order by frame rows between 6 preceding and 6 following)),
acc as (select *, first_value(x) over w + sum(mx) over w as sx, first_value(y) over w + sum(my) over w as sy from med window w as (partition by match_id, id, segment order by frame rows between unbounded preceding and current row))
select match_id, id, frame, {far('case when nf is null or n < 3 then x else sx end')} as x_cm, {far('case when nf is null or n < 3 then y else sy end')} as y_cm from acc""")
def smoothed(spark, sf):
    return rec.smoothed(_points(spark, sf)).select("match_id", "id", "frame", F.expr(far("x")).alias("x_cm"), F.expr(far("y")).alias("y_cm"))


@REGISTRY.add("moving_average", f"""with {BASE}, cut as (select *, sum(case when gap > 8 then 1 else 0 end) over (partition by match_id, id order by frame) as segment from (
  select *, frame - lag(frame) over (partition by match_id, id order by frame) as gap from points)),
ends as (select *, lag(frame) over w is null or lead(frame) over w is null as edge, cast(round(x * 100) as bigint) as cx, cast(round(y * 100) as bigint) as cy from cut window w as (partition by match_id, id, segment order by frame))
select match_id, id, frame, case when edge then cx * 1.0::double else sum(cx) over w / count(*) over w end as x_cm, case when edge then cy * 1.0::double else sum(cy) over w / count(*) over w end as y_cm
from ends window w as (partition by match_id, id, segment order by frame range between 5 preceding and 5 following)""")
def moving_average(spark, sf):
    p = _points(spark, sf).withColumns({c: F.round(F.col(c) * 100).cast("bigint") for c in ("x", "y")})
    m = rec.moving_average(p)
    return m.select("match_id", "id", "frame", F.col("x").cast("double").alias("x_cm"), F.col("y").cast("double").alias("y_cm"))


@REGISTRY.add("gap_filled", f"""with {BASE}, pairs as (select match_id, id, frame, x, y, lead(frame) over w as nf, lead(x) over w as nx, lead(y) over w as ny from points window w as (partition by match_id, id order by frame))
select match_id, id, f as frame, 0.0::double + case when f = frame then x else x + (nx - x) * ((f - frame) / (nf - frame)) end as x, 0.0::double + case when f = frame then y else y + (ny - y) * ((f - frame) / (nf - frame)) end as y, f <> frame as filled
from (select *, unnest(range(frame, case when nf - frame between 2 and 20 then nf else frame + 1 end)) as f from pairs)""")
def gap_filled(spark, sf):
    return rec.gap_filled(_points(spark, sf), 20).select("match_id", "id", "frame", nz("x"), nz("y"), "filled")


_HEAT = """select match_id, which, least(floor((y + 34) * 14 / 68), 13)::int as row, least(floor((x + 52.5) * 21 / 105), 20)::int as col, count(*) as n
from (select match_id, team as which, x, y from points where team in ('left', 'right') and role in ('player', 'goalkeeper') union all select match_id, 'ball', x, y from balls where x is not null)
where x between -52.5 and 52.5 and y between -34 and 34 group by all"""


def _heat(spark, sf):
    who = _points(spark, sf).where(F.col("team").isin("left", "right") & F.col("role").isin("player", "goalkeeper")).select("match_id", F.col("team").alias("which"), "x", "y")
    ball = _balls(spark, sf).where("x is not null").select("match_id", F.lit("ball").alias("which"), "x", "y")
    return rec.occupancy(who.unionByName(ball), ["match_id", "which"])


@REGISTRY.add("heatmap", f"with {BASE} {_HEAT}")
def heatmap(spark, sf):
    return _heat(spark, sf)


@REGISTRY.add("heatmap_dense", f"""with {BASE}, heat as ({_HEAT}), groups as (select distinct match_id, which from heat)
select g.match_id, g.which, r.row::int as row, c.col::int as col, coalesce(h.n, 0) as n from groups g, range(14) r(row), range(21) c(col) left join heat h on h.match_id = g.match_id and h.which = g.which and h.row = r.row and h.col = c.col""")
def heatmap_dense(spark, sf):
    return rec.dense_grid(_heat(spark, sf), ["match_id", "which"])


@REGISTRY.add("heatmap_share", f"with {BASE}, heat as ({_HEAT}) select *, n / max(n) over (partition by match_id, which)::double as share from heat")
def heatmap_share(spark, sf):
    from pyspark.sql import Window
    return _heat(spark, sf).withColumn("share", F.col("n") / F.max("n").over(Window.partitionBy("match_id", "which")))


@REGISTRY.add("team_shape", f"""with {BASE}, f as (select match_id, team, frame, avg(x) as x, avg(y) as y, max(y) - min(y) as w, max(x) - min(x) as l from points where role = 'player' and team in ('left', 'right') group by all having count(*) >= 3)
select match_id, team, count(*) as frames, {qs('avg(x)', 10)} as x_dm, {qs('avg(y)', 10)} as y_dm, {qs('avg(w)', 10)} as width_dm, {qs('avg(l)', 10)} as length_dm from f group by match_id, team""")
def team_shape(spark, sf):
    s = rec.team_shape(_people(spark, sf))
    return s.select("match_id", "team", "frames", q("x", 10).alias("x_dm"), q("y", 10).alias("y_dm"), q("width", 10).alias("width_dm"), q("length", 10).alias("length_dm"))


_BALLSTEPS = "bsteps as (select *, d / t as v from (select match_id, frame as f1, frame - lag(frame) over w as gap, (frame - lag(frame) over w) / 25.0::double as t, sqrt((x - lag(x) over w) * (x - lag(x) over w) + (y - lag(y) over w) * (y - lag(y) over w)) as d from balls where x is not null window w as (partition by match_id order by frame)) where gap is not null)"


@REGISTRY.add("ball_distance", f"with {BASE}, {_BALLSTEPS} select match_id, {qs('sum(d)', 10)} as distance_dm, count(*) as steps from bsteps where gap <= 5 and v <= 40 group by match_id")
def ball_distance(spark, sf):
    s = rec.steps(_balls(spark, sf).where("x is not null"), ("match_id",), cap=rec.BALL_CAP).where("counted")
    return s.groupBy("match_id").agg(q(F.sum("d"), 10).alias("distance_dm"), F.count("*").alias("steps"))


@REGISTRY.add("positions_export", f"with {BASE} select match_id, frame, p.id as id, p.team as team, p.jersey as jersey, p.role as role, p.xy[1] + 0.0::double as x, p.xy[2] + 0.0::double as y from entries where len(p.xy) >= 2 and p.xy[1] is not null and p.xy[2] is not null")
def positions_export(spark, sf):
    one = _lines(spark, sf).select("match_id", "frame", F.explode("people").alias("p"))
    return one.where((F.size("p.xy") >= 2) & F.get("p.xy", F.lit(0)).isNotNull() & F.get("p.xy", F.lit(1)).isNotNull()).select(
        "match_id", "frame", "p.id", "p.team", "p.jersey", "p.role", F.get("p.xy", F.lit(0)).alias("x"), F.get("p.xy", F.lit(1)).alias("y")).withColumns({"x": nz("x"), "y": nz("y")})


_BIG = "(select match_id from lines group by match_id order by count(*) desc, match_id limit 1)"


@REGISTRY.add("frame_slice", f"""with {BASE}, chosen as (select match_id, frame, row_number() over (order by frame) as n, count(*) over () as total from lines where match_id = {_BIG} and frame between 500 and 5000)
select match_id, frame, total from chosen where (n - 1) % 5 = 0""")
def frame_slice(spark, sf):
    lines = _lines(spark, sf)
    big = lines.groupBy("match_id").count().orderBy(F.desc("count"), "match_id").first().match_id
    return rec.frame_slice(lines, big, 500, 5000, 5).select("match_id", "frame", "total")


@REGISTRY.add("as_of_ball", f"""with {BASE}, seen as (select match_id, frame as bf, x as bx, y as by from balls where x is not null)
select p.match_id, p.id, p.frame, s.bf, s.bx + 0.0::double as bx, s.by + 0.0::double as by from points p asof left join seen s on p.match_id = s.match_id and p.frame >= s.bf""")
def as_of_ball(spark, sf):
    seen = _balls(spark, sf).where("x is not null").select("match_id", F.col("frame").alias("bf"), F.col("x").alias("bx"), F.col("y").alias("by"))
    left = _points(spark, sf).select("match_id", "id", "frame")
    return rec.as_of(left, seen.withColumn("since", F.col("bf")), ["match_id"], "frame", "since", ["bf", "bx", "by"]).withColumns({"bx": nz("bx"), "by": nz("by")})


@REGISTRY.add("adjacent_frames", f"""with {BASE} select a.match_id, a.id, a.frame, b.x - a.x as dx, b.y - a.y as dy from points a join points b on a.match_id = b.match_id and a.id = b.id and b.frame = a.frame + 1""")
def adjacent_frames(spark, sf):
    a = _points(spark, sf).select("match_id", "id", "frame", "x", "y")
    b = a.select("match_id", "id", (F.col("frame") - 1).alias("frame"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return a.join(b, ["match_id", "id", "frame"]).select("match_id", "id", "frame", (F.col("bx") - F.col("x")).alias("dx"), (F.col("by") - F.col("y")).alias("dy"))


@REGISTRY.add("trail_lengths", f"""with {BASE}, nth as (select match_id, frame, row_number() over (partition by match_id order by frame) as line from (select distinct match_id, frame from people)),
v as (select p.match_id, p.id, p.frame, line - row_number() over (partition by p.match_id, p.id order by p.frame) as island from people p join nth using (match_id, frame))
select match_id, id, frame, least(20, row_number() over (partition by match_id, id, island order by frame)) as points from v""")
def trail_lengths(spark, sf):
    return rec.trails(_people(spark, sf)).select("match_id", "id", "frame", F.size("trail").cast("bigint").alias("points"))


@REGISTRY.add("roster", f"with {BASE} select match_id, team, jersey, max(frame) as last_frame, try_cast(trim(jersey, E' \\t') as int) as number from people where (role <> 'referee') and jersey is not null and team is not null group by match_id, team, jersey")
def roster(spark, sf):
    return rec.roster(_people(spark, sf))


@REGISTRY.add("role_votes", f"""with {BASE}, said as (select match_id, id, frame, role from (select match_id, id, frame, regexp_replace(lower(role), '[^\\p{{L}}\\p{{N}}]+', '', 'g') as role from people) where role in ('player', 'goalkeeper', 'referee', 'other')),
firsts2 as (select match_id, id, role, min(frame) as f from said group by all),
votes as (select a.match_id, a.id, a.frame, f.role, count(b.frame) as n, f.f from said a join firsts2 f on f.match_id = a.match_id and f.id = a.id
          left join said b on b.match_id = a.match_id and b.id = a.id and b.role = f.role and b.frame between a.frame - 24 and a.frame + 25 group by all)
select match_id, id, frame, role from (select *, row_number() over (partition by match_id, id, frame order by n desc, f) as k from votes) where k = 1""")
def role_votes(spark, sf):
    """Labels that are only written differently count together."""
    return rec.role_votes(_people(spark, sf).withColumn("role", canonical_label(F.col("role"))), 25, 25)


@REGISTRY.add("hidden_ids", f"with {BASE} select match_id, id, count(*) as seen from people group by match_id, id having count(*) < 12")
def hidden_ids(spark, sf):
    return _people(spark, sf).groupBy("match_id", "id").agg(F.count("*").alias("seen")).where("seen < 12")


@REGISTRY.add("foot_points", f"""with {BASE} select match_id, frame, id, box[1] + box[3] / 2 as fx, box[2] + box[4] as fy, abs(x) <= 54.5 and abs(y) <= 36.0 as near_pitch
from (select match_id, frame, p.id as id, p.box as box, p.xy[1] as x, p.xy[2] as y, row_number() over (partition by match_id, frame, p.id order by pos) as nth from entries where p.id is not null)
where nth = 1 and x is not null and y is not null and isfinite(x) and isfinite(y)""")
def foot_points(spark, sf):
    fx, fy = foot_point(F.col("box"))
    return _points(spark, sf).select("match_id", "frame", "id", fx.alias("fx"), fy.alias("fy"), on_pitch(F.col("x"), F.col("y"), 2.0).alias("near_pitch"))


_H = [0.1, 0.01, -50.0, 0.002, 0.15, -40.0, 0.0001, 0.0002, 1.0]


@REGISTRY.add("projected_points", f"""with {BASE}, h as (select *, {_H[6]}::double * x + {_H[7]}::double * y + {_H[8]}::double as w from points)
select match_id, frame, id, ({_H[0]}::double * x + {_H[1]}::double * y + {_H[2]}::double) / w as px, ({_H[3]}::double * x + {_H[4]}::double * y + {_H[5]}::double) / w as py from h where w <> 0""")
def projected_points(spark, sf):
    h = F.array(*[F.lit(v) for v in _H])
    px, py = project(h, F.col("x"), F.col("y"))
    return _points(spark, sf).select("match_id", "frame", "id", px.alias("px"), py.alias("py")).where("px is not null")


@REGISTRY.add("box_overlaps", f"""with {BASE}, b as (select match_id, frame, p.id as id, p.box as b from entries where p.id is not null and len(p.box) = 4 qualify row_number() over (partition by match_id, frame, p.id order by pos) = 1),
pairs as (select x.match_id, x.id, x.frame, greatest(0, least(x.b[1] + x.b[3], y.b[1] + y.b[3]) - greatest(x.b[1], y.b[1])) as w, greatest(0, least(x.b[2] + x.b[4], y.b[2] + y.b[4]) - greatest(x.b[2], y.b[2])) as h, x.b[3] * x.b[4] + y.b[3] * y.b[4] as s
          from b x join b y on y.match_id = x.match_id and y.id = x.id and y.frame = x.frame + 1)
select match_id, id, frame, case when s - w * h > 0 then w * h / (s - w * h) else 0 end as iou from pairs""")
def box_overlaps(spark, sf):
    a = _people(spark, sf).where(F.size("box") == 4).select("match_id", "id", "frame", "box")
    b = a.select("match_id", "id", (F.col("frame") - 1).alias("frame"), F.col("box").alias("next"))
    return a.join(b, ["match_id", "id", "frame"]).select("match_id", "id", "frame", box_overlap(F.col("box"), F.col("next")).alias("iou"))


@REGISTRY.add("matrix_determinants", "select r_regionkey, (r_regionkey + 1) * (5 * 9 - 6 * 8) - 2 * (4 * 9 - 6 * 7) + 3 * (4 * 8 - 5 * 7)::double as det from region")
def matrix_determinants(spark, sf):
    h = F.array((F.col("r_regionkey") + 1).cast("double"), *[F.lit(float(v)) for v in range(2, 10)])
    return table(spark, sf, "region").select("r_regionkey", determinant(h).alias("det"))


_OWNER = """b as (select * from balls where x is not null),
near as (select p.match_id, p.frame, min(case when team = 'left' then d end) as l, min(case when team = 'right' then d end) as r from (
  select p.*, sqrt((p.x - b.x) * (p.x - b.x) + (p.y - b.y) * (p.y - b.y)) as d from points p join b using (match_id, frame) where role in ('player', 'goalkeeper') and team in ('left', 'right')) p group by p.match_id, p.frame),
owners as (select f.match_id, f.frame, case when l is null and r is null then 'none' when l = r then 'none' when least(l, r) > 3 then 'none' when r is null or l < r then 'left' else 'right' end as owner from balls f left join near using (match_id, frame)),
runs as (select match_id, owner, min(frame) as s, max(frame) as e, count(*) as n from (select *, frame - row_number() over (partition by match_id, owner order by frame) as i from owners) group by match_id, owner, i),
held as (select match_id, case when owner <> 'none' and (n - 1) / 25.0 < 0.5 then 'none' else owner end as owner, s, e from runs),
timeline as (select match_id, owner, min(s) as start_frame, max(e) as end_frame from (select *, sum(fresh) over (partition by match_id order by s) as k from (
  select *, case when owner = lag(owner) over w and s = lag(e) over w + 1 then 0 else 1 end as fresh from held window w as (partition by match_id order by s))) group by match_id, owner, k)"""


def _timeline(spark, sf):
    return feat.possession_timeline(feat.raw_owner(_people(spark, sf), _balls(spark, sf)))


@REGISTRY.add("raw_owner", f"with {BASE}, {_OWNER} select match_id, frame, owner from owners")
def raw_owner(spark, sf):
    return feat.raw_owner(_people(spark, sf), _balls(spark, sf))


@REGISTRY.add("possession_timeline", f"with {BASE}, {_OWNER} select match_id, owner, start_frame, end_frame from timeline")
def possession_timeline(spark, sf):
    return _timeline(spark, sf)


@REGISTRY.add("possession_counts", f"with {BASE}, {_OWNER} select match_id, owner, sum(end_frame - start_frame + 1) as frames from timeline group by match_id, owner")
def possession_counts(spark, sf):
    return feat.possession_counts(_timeline(spark, sf))


@REGISTRY.add("possession_windows", f"""with {BASE}, {_OWNER}, own as (select f.match_id, (f.frame - first_frame) // 7500 as "window", t.owner from balls f join firsts using (match_id) join timeline t on t.match_id = f.match_id and f.frame between t.start_frame and t.end_frame)
select match_id, "window", count(*) filter (owner = 'left') as "left", count(*) filter (owner = 'right') as "right", count(*) filter (owner = 'none') as "none" from own group by match_id, "window" """)
def possession_windows(spark, sf):
    return feat.possession_windows(_timeline(spark, sf), _firsts(spark, sf))


_PEAK = "peaks as (select match_id, f1 as frame, v as speed from (select *, row_number() over (partition by match_id, run order by v desc, f1) as k from (select *, sum(case when v > 15 then 0 else 1 end) over (partition by match_id order by f1) as run from bsteps) where v > 15) where k = 1)"
_LONG = """far as (select match_id, frame, sqrt((x - ax) * (x - ax) + (y - ay) * (y - ay)) as d from (select *, first_value(x) over w as ax, first_value(y) over w as ay from balls where x is not null window w as (partition by match_id order by frame range between 50 preceding and current row))),
longs as (select match_id, min(frame) as frame, max(d) as distance from (select *, sum(case when d > 25 then 0 else 1 end) over (partition by match_id order by frame) as run from far) where d > 25 group by match_id, run)"""
_CHANGE = """near1 as (select p.match_id, p.frame, p.id, p.team, row_number() over (partition by p.match_id, p.frame order by sqrt((p.x - b.x) * (p.x - b.x) + (p.y - b.y) * (p.y - b.y)), p.id) as k
  from points p join balls b on b.match_id = p.match_id and b.frame = p.frame and b.x is not null where role in ('player', 'goalkeeper') and team in ('left', 'right')),
changes as (select * from (select match_id, frame, id, team, lag(team) over (partition by match_id order by frame) as from_team from near1 where k = 1) where from_team <> team)"""


@REGISTRY.add("ball_speed_peaks", f"with {BASE}, {_BALLSTEPS}, {_PEAK} select * from peaks")
def ball_speed_peaks(spark, sf):
    return feat.ball_peaks(_balls(spark, sf))


@REGISTRY.add("long_balls", f"with {BASE}, {_LONG} select * from longs")
def long_balls(spark, sf):
    return feat.long_balls(_balls(spark, sf))


@REGISTRY.add("possession_changes", f"with {BASE}, {_CHANGE} select * from changes")
def possession_changes(spark, sf):
    return feat.possession_changes(feat.nearest_owner(_people(spark, sf), _balls(spark, sf)))


_SPRINTSTEPS = STEPS.replace("from points window", "from points where role in ('player', 'goalkeeper') window")


@REGISTRY.add("match_events", f"""with {BASE}, {_BALLSTEPS}, {_PEAK}, {_LONG}, {_CHANGE}, {_SPRINTSTEPS}
select match_id, frame, 'ball_speed_peak' as type, null::bigint as id, null::varchar as team, null::varchar as from_team from peaks
union all select match_id, frame, 'long_ball', null, null, null from longs
union all select match_id, frame, 'possession_change', id, team, from_team from changes
union all select s.match_id, s.end_frame, 'sprint', s.id, case when p.team in ('left', 'right') then p.team end, null from sprints s join points p on p.match_id = s.match_id and p.id = s.id and p.frame = s.end_frame""")
def match_events(spark, sf):
    return feat.match_events(_people(spark, sf), _balls(spark, sf)).select("match_id", "frame", "type", "id", "team", "from_team")


_ZONE = "case when v < 2 then 'walk' when v < 4 then 'jog' when v < 6 then 'run' when v < 7 then 'high' else 'sprint' end"


@REGISTRY.add("intensity_levels", f"""with {BASE}, {STEPS}, {COUNTED},
rows as (select match_id, c.team, id, (f0 - first_frame) // 1500 as minute, {_ZONE} as zone, floor(d * 1000 + 0.487)::bigint as mm from steps join counted_people c using (match_id, id) join firsts using (match_id) where counted)
select match_id, team, id, minute, zone, sum(mm)::bigint as distance from rows group by grouping sets ((match_id, team, id, minute, zone), (match_id, team, id, zone), (match_id, team, minute, zone), (match_id, team, zone))""")
def intensity_levels(spark, sf):
    return feat.intensity(_people(spark, sf), _firsts(spark, sf), q("d", 1000))


@REGISTRY.add("work_rate", f"""with {BASE}, {STEPS}, {COUNTED}, s as (select match_id, id, sum(d) as d from steps where counted group by match_id, id)
select match_id, c.team, id, {qs('coalesce(d, 0)', 10)} as distance_dm, {qs('coalesce(d, 0) / ((last_frame - first_frame + 1) / 25.0::double / 60)', 10)} as dm_per_minute from counted_people c left join s using (match_id, id) join firsts using (match_id)""")
def work_rate(spark, sf):
    w = feat.work_rate(_people(spark, sf), rec.catalog(_lines(spark, sf)))
    return w.select("match_id", "team", "id", q("distance", 10).alias("distance_dm"), q("metres_per_minute", 10).alias("dm_per_minute"))


@REGISTRY.add("top_distance", f"""with {BASE}, {STEPS}, {COUNTED}, s as (select match_id, id, sum(floor(d * 1000 + 0.487)::bigint) as mm from steps where counted group by match_id, id),
r as (select match_id, id, coalesce(mm, 0)::bigint as mm, row_number() over (partition by match_id order by coalesce(mm, 0) desc, id) as rank from counted_people left join s using (match_id, id)) select match_id, id, mm, rank from r where rank <= 10""")
def top_distance(spark, sf):
    from pyspark.sql import Window
    p = _people(spark, sf)
    s = rec.steps(rec.positioned(p)).where("counted").groupBy("match_id", "id").agg(F.sum(q("d", 1000)).alias("mm"))
    rows = feat.counted_people(p).join(s, ["match_id", "id"], "left").select("match_id", "id", F.coalesce("mm", F.lit(0)).alias("mm"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("match_id").orderBy(F.desc("mm"), "id")).cast("bigint")).where("rank <= 10")


@REGISTRY.add("territory", f"""with {BASE}, playing as (select * from points where role in ('player', 'goalkeeper') and team in ('left', 'right')),
near as (select match_id, frame, r.i as r, c.i as c, min(case when team = 'left' then (x - (5 * c.i - 50)) * (x - (5 * c.i - 50)) + (y - (r.i * (68.0::double / 14) + 68.0::double / 28 - 34)) * (y - (r.i * (68.0::double / 14) + 68.0::double / 28 - 34)) end) as l,
  min(case when team = 'right' then (x - (5 * c.i - 50)) * (x - (5 * c.i - 50)) + (y - (r.i * (68.0::double / 14) + 68.0::double / 28 - 34)) * (y - (r.i * (68.0::double / 14) + 68.0::double / 28 - 34)) end) as rr
  from playing, range(14) r(i), range(21) c(i) group by all),
size as (select match_id, (frame - first_frame) // 25 as second, count(*) as b from lines join firsts using (match_id) group by all),
per as (select match_id, (frame - first_frame) // 25 as second, r, c, count(*) filter (coalesce(l, 'inf') < coalesce(rr, 'inf')) as nl, count(*) filter (coalesce(rr, 'inf') < coalesce(l, 'inf')) as nr from near join firsts using (match_id) group by all)
select match_id, second, sum(case when 2 * nl > b then 1 else 0 end)::bigint as "left", sum(case when 2 * nr > b then 1 else 0 end)::bigint as "right", count(*) as cells from per join size using (match_id, second) group by match_id, second""")
def territory(spark, sf):
    lines = _lines(spark, sf)
    return feat.territory(_people(spark, sf), lines, _firsts(spark, sf))


@REGISTRY.add("shape_by_second", f"""with {BASE}, spot as (select match_id, team, (frame - first_frame) // 25 as second, id, sum(cast(round(x * 1000) as bigint)) / count(*)::double / 1000 as x, sum(cast(round(y * 1000) as bigint)) / count(*)::double / 1000 as y from points join firsts using (match_id) where role = 'player' and team in ('left', 'right') group by all),
r as (select *, row_number() over (partition by match_id, team, second order by case when team = 'left' then x else -x end) as k from spot)
select match_id, team, second, count(*) as players, max(y) - min(y) as width, max(x) - min(x) as length from r group by match_id, team, second having count(*) >= 4""")
def shape_by_second(spark, sf):
    p = _people(spark, sf)
    s = feat.shape_by_second(p, _firsts(spark, sf), exact=True)
    return s.select("match_id", "team", "second", "players", "width", "length")


@REGISTRY.add("shape_measures")
def shape_measures(spark, sf):
    return feat.shape_by_second(_people(spark, sf), _firsts(spark, sf))


_FORM = """seen as (select p.*, (frame - first_frame) // 1500 as "window" from points p join firsts using (match_id) where role = 'player' and team in ('left', 'right')),
mean as (select match_id, "window", team, id, case when team = 'left' then avg(x) + 52.5 else 52.5 - avg(x) end as d, avg(y) as y, count(*) as n from seen group by match_id, "window", team, id),
lined as (select *, sum(case when gap >= 10 then 1 else 0 end) over (partition by match_id, "window", team order by d, id) as line from (select *, d - lag(d) over (partition by match_id, "window", team order by d, id) as gap from mean))"""


@REGISTRY.add("formations", f"""with {BASE}, {_FORM}, sizes as (select match_id, "window", team, line, count(*) as size from lined group by all)
select match_id, "window", team, sum(size)::bigint as players, case when sum(size) >= 3 then string_agg(size::varchar, '-' order by line) end as formation from sizes group by match_id, "window", team""")
def formations(spark, sf):
    return feat.formations(_people(spark, sf), _lines(spark, sf), _firsts(spark, sf)).select("match_id", "window", "team", "players", "formation")


@REGISTRY.add("formation_confidence")
def formation_confidence(spark, sf):
    return feat.formations(_people(spark, sf), _lines(spark, sf), _firsts(spark, sf))


@REGISTRY.add("formation_seats", f"""with {BASE}, {_FORM} select match_id, "window", team, id, line::bigint as line, row_number() over (partition by match_id, "window", team, line order by case when team = 'left' then -y else y end, id) - 1 as seat, n from lined""")
def formation_seats(spark, sf):
    return feat.formation_seats(_people(spark, sf), _firsts(spark, sf)).withColumn("seat", F.col("seat").cast("bigint"))


@REGISTRY.add("empty_ranges", f"""with {BASE}, e as (select match_id, frame from lines anti join (select distinct match_id, frame from points) using (match_id, frame))
select match_id, min(frame) as start, max(frame) as "end", count(*) as frames from (select *, frame - row_number() over (partition by match_id order by frame) as i from e) group by match_id, i""")
def empty_ranges(spark, sf):
    return feat.empty_ranges(_people(spark, sf), _lines(spark, sf))


_FRAG = """tr as (select match_id, id, min(frame) as s, max(frame) as e, arg_min(x, frame) as sx, arg_min(y, frame) as sy, arg_max(x, frame) as ex, arg_max(y, frame) as ey from points group by match_id, id),
frag as (select match_id, id from tr a where exists (select 1 from tr b where b.match_id = a.match_id and b.id <> a.id and a.s between b.e and b.e + 37 and sqrt((a.sx - b.ex) * (a.sx - b.ex) + (a.sy - b.ey) * (a.sy - b.ey)) <= 3))"""


@REGISTRY.add("fragment_tracks", f"with {BASE}, {_FRAG} select match_id, id from frag")
def fragment_tracks(spark, sf):
    return feat.fragments(_people(spark, sf))


@REGISTRY.add("quality_report", f"""with {BASE}, {_FRAG},
per as (select match_id, frame, count(*) as n, count(*) filter (team in ('left', 'right')) as t, count(*) filter (length(trim(jersey)) > 0) as j from points group by match_id, frame),
pp as (select match_id, sum(n) as tracked, sum(t) as teamed, sum(j) as read, count(*) filter (n >= 8) as good from per group by match_id),
bb as (select match_id, count(*) as frames, count(*) filter (found) as found from balls group by match_id),
ff as (select match_id, count(*) as fragments from frag group by match_id)
select match_id, frames, coalesce(tracked, 0)::bigint as tracked, coalesce(teamed, 0)::bigint as teamed, coalesce(read, 0)::bigint as read, coalesce(good, 0) as good, found, coalesce(fragments, 0) as fragments from bb left join pp using (match_id) left join ff using (match_id)""")
def quality_report(spark, sf):
    lines = _lines(spark, sf)
    return feat.quality(_people(spark, sf), lines, _balls(spark, sf)).select("match_id", "frames", "tracked", "teamed", "read", "good", "found", "fragments")


@REGISTRY.add("quality_grades")
def quality_grades(spark, sf):
    return feat.quality(_people(spark, sf), _lines(spark, sf), _balls(spark, sf)).select("match_id", "good_pct", "team_pct", "jersey_pct", "ball_pct", "score", "grade", "warnings")


@REGISTRY.add("sprint_runs_slow", f"with {BASE}, {STEPS.replace('v >= 7', 'v >= 2').replace('>= 1.0 - 1e-9', '>= 0.4 - 1e-9')} select match_id, id, start_frame, end_frame, gap, {qs('mm / 1000.0::double', 10)} as distance_dm, v as max_speed from sprints")
def sprint_runs_slow(spark, sf):
    """Runs from 2 m/s and 0.4 s, of which these recordings hold some."""
    runs = rec.sprint_runs(rec.steps(_points(spark, sf)).withColumn("d", q("d", 1000)), speed=2.0, seconds=0.4)
    return runs.select("match_id", "id", "start_frame", "end_frame", "gap", q(F.col("distance_m") / F.lit(1000.0), 10).alias("distance_dm"), "max_speed")


@REGISTRY.add("long_balls_near", f"with {BASE}, {_LONG.replace('d > 25', 'd > 4')} select * from longs")
def long_balls_near(spark, sf):
    return feat.long_balls(_balls(spark, sf), 4.0)


@REGISTRY.add("fragment_tracks_wide", f"with {BASE}, {_FRAG.replace('+ 37', '+ 2000').replace('<= 3)', '<= 40)')} select match_id, id from frag")
def fragment_tracks_wide(spark, sf):
    return feat.fragments(_people(spark, sf), 2000, 40.0).distinct()


@REGISTRY.add("quality_percentages", f"""with {BASE},
per as (select match_id, frame, count(*) as n, count(*) filter (team in ('left', 'right')) as t, count(*) filter (length(trim(jersey)) > 0) as j from points group by match_id, frame),
pp as (select match_id, sum(n) as tracked, sum(t) as teamed, sum(j) as read, count(*) filter (n >= 8) as good from per group by match_id), bb as (select match_id, count(*) as frames, count(*) filter (found) as found from balls group by match_id)
select match_id, round(100.0::double * coalesce(good, 0) / frames, 1) as good_pct, coalesce(round(100.0::double * teamed / tracked, 1), 0) as team_pct, coalesce(round(100.0::double * read / tracked, 1), 0) as jersey_pct, round(100.0::double * found / frames, 1) as ball_pct,
  round(coalesce(tracked, 0) / frames::double, 1) as tracked_per_frame from bb left join pp using (match_id)""")
def quality_percentages(spark, sf):
    return feat.quality(_people(spark, sf), _lines(spark, sf), _balls(spark, sf)).select("match_id", "good_pct", "team_pct", "jersey_pct", "ball_pct", "tracked_per_frame")
