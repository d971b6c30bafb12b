"""Queries of the documents put together from a recording's features, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinefold.operators import features as feat
from kinefold.operators import recording as rec
from kinefold.operators import reports
from kinefold.plans.recording_queries import _balls, _BALLSTEPS, _firsts, _HEAT, _lines, _people, REGISTRY as RECORDING, q
from kinefold.plans.registry import Registry
from kinefold.plans.sqlbase import BASE, MODES, STEPS

REGISTRY = Registry()

# Player summaries with two decimals, and shapes of teams.
_SUMMARY = f"""{STEPS}, {MODES},
moved as (select match_id, id, sum(case when counted then d end) as d, max(case when counted then v end) as v from steps group by match_id, id),
runs as (select match_id, id, count(*) as s from sprints group by match_id, id),
who as (select match_id, id, count(*) as n from people group by match_id, id),
players as (select w.match_id, w.id, r.role, t.team, j.jersey, round(coalesce(d, 0), 2) as distance_m, round(coalesce(v, 0), 2) as max_speed_ms, coalesce(s, 0) as sprints
  from who w left join m_role r using (match_id, id) left join m_team t using (match_id, id) left join m_jersey j using (match_id, id) left join moved m using (match_id, id) left join runs s using (match_id, id)),
mine as (select * from players where role in ('player', 'goalkeeper') and team in ('left', 'right')),
{_BALLSTEPS},
ballpart as (select match_id, count(x) as ball_frames, count(*) as frame_count from balls group by match_id),
balldist as (select match_id, round(sum(d), 2) as ball_distance from bsteps where gap <= 5 and v <= 40 group by match_id),
perframe as (select match_id, team, frame, max(y) - min(y) as width, max(x) - min(x) as length from points where role = 'player' and team in ('left', 'right') group by match_id, team, frame having count(*) >= 3),
shapes as (select match_id, team, round(avg(width), 2) as width, round(avg(length), 2) as length from perframe group by match_id, team)"""


def _summaries(spark, sf):
    return reports.match_summary(_people(spark, sf), _lines(spark, sf), _balls(spark, sf))


@REGISTRY.add("match_summary", f"""with {BASE}, {_SUMMARY}
select match_id, b.frame_count, round(b.frame_count / 25.0::double, 2) as duration_s, coalesce(p.n, 0) as players, b.ball_frames, coalesce(d.ball_distance, 0) as ball_distance_m,
       l.width as left_width, r.length as right_length, coalesce(h.cells, 0) as heat_cells
from ballpart b left join (select match_id, count(*) as n from players group by match_id) p using (match_id) left join balldist d using (match_id)
left join (select * from shapes where team = 'left') l using (match_id) left join (select * from shapes where team = 'right') r using (match_id)
left join (select match_id, count(*) as cells from ({_HEAT}) group by match_id) h using (match_id)""")
def match_summary(spark, sf):
    s = _summaries(spark, sf)
    return s.select("match_id", "frame_count", "duration_s", F.coalesce(F.size("players"), F.lit(0)).cast("bigint").alias("players"), "ball_frames", "ball_distance_m",
                    F.col("teams")["left"]["width"].alias("left_width"), F.col("teams")["right"]["length"].alias("right_length"), F.coalesce(F.size("heat"), F.lit(0)).cast("bigint").alias("heat_cells"))


@REGISTRY.add("report_headline", f"""with {BASE}, {_SUMMARY}
select b.match_id, count(m.id) as players, round(coalesce(sum(case when team = 'left' then distance_m end), 0), 2) as left_distance, round(coalesce(sum(case when team = 'right' then distance_m end), 0), 2) as right_distance,
       coalesce(max(max_speed_ms), 0) as top_speed, coalesce(sum(sprints), 0)::bigint as sprints, coalesce(any_value(d.ball_distance), 0) as ball_distance, any_value(b.ball_frames) as ball_frames
from ballpart b left join mine m on m.match_id = b.match_id left join balldist d on d.match_id = b.match_id group by b.match_id""")
def report_headline(spark, sf):
    return reports.headline(_summaries(spark, sf))


@REGISTRY.add("report_top_players", f"""with {BASE}, {_SUMMARY}
select match_id, rank, id, jersey, distance_m from (select *, row_number() over (partition by match_id order by distance_m desc, id) as rank from mine) where rank <= 5""")
def report_top_players(spark, sf):
    return reports.top_players(rec.player_summary(_people(spark, sf))).select("match_id", "rank", "id", "jersey", F.round("distance_m", 2).alias("distance_m"))


@REGISTRY.add("report_opacities", f"with {BASE}, heat as ({_HEAT}) select match_id, which, row, col, n, round(n / greatest(1, max(n) over (partition by match_id, which))::double, 2) as opacity from heat")
def report_opacities(spark, sf):
    return reports.opacities(RECORDING.queries["heatmap"](spark, sf), ["match_id", "which"])


@REGISTRY.add("comparison", f"""with {BASE}, {_SUMMARY}, pick as (select match_id, case row_number() over (order by match_id) when 1 then 'a' else 'b' end as side from (select match_id from firsts order by match_id limit 2)),
v as (select side, 0 as position, 'duration_s' as name, round(frame_count / 25.0::double, 2) as value from ballpart join pick using (match_id)
 union all select side, 1, 'tracked_people', count(p.id)::double from pick left join players p using (match_id) group by side
 union all select side, case when team = 'left' then 2 else 3 end, 'team_width_' || team || '_m', width from shapes join pick using (match_id)
 union all select side, case when team = 'left' then 4 else 5 end, 'team_length_' || team || '_m', length from shapes join pick using (match_id)
 union all select side, 6, 'avg_distance_m', coalesce(round(sum(distance_m) / count(p.id), 2), 0) from pick left join players p using (match_id) group by side
 union all select side, 7, 'ball_found_pct', round(100.0::double * ball_frames / frame_count, 2) from ballpart join pick using (match_id))
select position, name, max(value) filter (side = 'a') as a, max(value) filter (side = 'b') as b, round(max(value) filter (side = 'a') - max(value) filter (side = 'b'), 2) as diff from v group by position, name""")
def comparison(spark, sf):
    """The first two recordings by name: all eight metrics."""
    two = _lines(spark, sf).select("match_id").distinct().orderBy("match_id").limit(2)
    sides = two.groupBy().agg(F.min("match_id").alias("a"), F.max("match_id").alias("b")).select(F.expr("stack(2, 'a', a, 'b', b) as (side, match_id)"))
    return reports.compared(_summaries(spark, sf), sides)


_OWNED = RECORDING.sql["territory"]


@REGISTRY.add("control_series", f"""with {BASE}, owned as ({_OWNED}), seconds as (select match_id, unnest(range((last_frame - first_frame) // 25 + 1)) as second from firsts)
select match_id, second, round(coalesce("left", 0) / 294.0::double, 3) as "left", round(coalesce("right", 0) / 294.0::double, 3) as "right", round((294 - coalesce("left", 0) - coalesce("right", 0)) / 294.0::double, 3) as neutral
from seconds left join owned using (match_id, second)""")
def control_series(spark, sf):
    lines = _lines(spark, sf)
    return reports.control_series(feat.territory(_people(spark, sf), lines, _firsts(spark, sf)), rec.catalog(lines))


@REGISTRY.add("control_share", f"""with {BASE}, owned as ({_OWNED}), sums as (select match_id, sum("left") as l, sum("right") as r from owned group by match_id)
select match_id, round(coalesce(l, 0) / (294.0::double * ((last_frame - first_frame) // 25 + 1)), 3) as "left", round(coalesce(r, 0) / (294.0::double * ((last_frame - first_frame) // 25 + 1)), 3) as "right" from firsts left join sums using (match_id)""")
def control_share(spark, sf):
    lines = _lines(spark, sf)
    return reports.control_share(feat.territory(_people(spark, sf), lines, _firsts(spark, sf)), rec.catalog(lines))


_CELLS = _OWNED.split("select match_id, second, sum(case")[0]


@REGISTRY.add("control_map", _CELLS + """, s as (select match_id, r, c, count(*) filter (2 * nl > b) as l, count(*) filter (2 * nr > b) as rr from per join size using (match_id, second) group by match_id, r, c)
select match_id, r::bigint as row, c::bigint as col, round(l / ((last_frame - first_frame) // 25 + 1)::double, 3) as "left", round(rr / ((last_frame - first_frame) // 25 + 1)::double, 3) as "right" from s join firsts using (match_id) where l > 0 or rr > 0""")
def control_map(spark, sf):
    lines = _lines(spark, sf)
    return reports.control_map(_people(spark, sf), lines, _firsts(spark, sf), rec.catalog(lines))


@REGISTRY.add("possession_percentages", f"""with {BASE}, owned as ({RECORDING.sql["possession_windows"]}), size as (select match_id, (frame - first_frame) // 7500 as "window", count(*) as frames from lines join firsts using (match_id) group by all),
sums as (select match_id, "window", sum(frames) as frames, sum(coalesce("left", 0)) as l, sum(coalesce("right", 0)) as r, sum(coalesce("none", 0)) as n from size left join owned using (match_id, "window") group by grouping sets ((match_id, "window"), (match_id)))
select match_id, "window", frames::bigint as frames, round(100.0::double * l / frames, 1) as "left", round(100.0::double * r / frames, 1) as "right", round(100.0::double * n / frames, 1) as "none" from sums""")
def possession_percentages(spark, sf):
    lines = _lines(spark, sf)
    timeline = feat.possession_timeline(feat.raw_owner(_people(spark, sf), _balls(spark, sf)))
    return reports.possession_percentages(timeline, lines, _firsts(spark, sf))


@REGISTRY.add("shape_average", f"""with {BASE}, spot as (select match_id, team, (frame - first_frame) // 25 as second, id, sum(cast(round(x * 1000) as bigint)) / count(*)::double / 1000 as x, sum(cast(round(y * 1000) as bigint)) / count(*)::double / 1000 as y, min(frame * 100000 + pos) as seen from points join firsts using (match_id) where role = 'player' and team in ('left', 'right') group by all),
r as (select *, row_number() over w as k, avg(x) over (partition by match_id, team, second) as cx, avg(y) over (partition by match_id, team, second) as cy from spot window w as (partition by match_id, team, second order by case when team = 'left' then x else -x end, seen)),
sec as (select match_id, team, second, max(y) - min(y) as width, max(x) - min(x) as length, abs(avg(x) filter (k <= 4) - case when team = 'left' then -52.5 else 52.5 end) as line, avg(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))) as compact from r group by match_id, team, second having count(*) >= 4)
select match_id, team, count(*) as seconds, floor(avg(width) * 10 + 0.487)::bigint as width_dm, floor(avg(length) * 10 + 0.487)::bigint as length_dm, floor(avg(line) * 10 + 0.487)::bigint as line_dm, floor(avg(compact) * 10 + 0.487)::bigint as compact_dm from sec group by match_id, team""")
def shape_average(spark, sf):
    a = reports.shape_average(feat.shape_by_second(_people(spark, sf), _firsts(spark, sf), exact=True))
    return a.select("match_id", "team", "seconds", q("width", 10).alias("width_dm"), q("length", 10).alias("length_dm"), q("defensive_line", 10).alias("line_dm"), q("compactness", 10).alias("compact_dm"))


@REGISTRY.add("no_people_warnings", f"""with {BASE}, e as (select match_id, frame from lines anti join (select distinct match_id, frame from points) using (match_id, frame)),
ranges as (select match_id, min(frame) as s, max(frame) as e, count(*) as n from (select *, frame - row_number() over (partition by match_id order by frame) as i from e) group by match_id, i)
select match_id, 'No tracked people in frames ' || s || '..' || e || ' (' || n || ' frames) - the camera may be uncalibrated.' as warning from ranges where n >= 1""")
def no_people_warnings(spark, sf):
    """Every range warns here, also one of a single frame, as recordings with 25 in a row are rare."""
    w = feat.quality(_people(spark, sf), _lines(spark, sf), _balls(spark, sf), 1).select("match_id", F.explode("warnings").alias("warning"))
    return w.where(F.col("warning").startswith("No tracked people"))
