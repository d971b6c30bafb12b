"""SQL pieces shared by the twins of the recording queries."""

#: Clean lines, people (first entry of an id, null position unless two finite numbers), balls, first frames.
BASE = """
lines as materialized (select * from (select *, row_number() over (partition by match_id, frame order by line_no desc) as rk from frames) where rk = 1),
entries as (select match_id, frame, unnest(people) as p, generate_subscripts(people, 1) - 1 as pos from lines),
people as materialized (select match_id, frame, pos, p.id as id, p.role as role, p.team as team, p.jersey as jersey,
                  case when len(p.xy) = 2 and isfinite(p.xy[1]) and isfinite(p.xy[2]) then p.xy[1] end as x,
                  case when len(p.xy) = 2 and isfinite(p.xy[1]) and isfinite(p.xy[2]) then p.xy[2] end as y
           from (select *, row_number() over (partition by match_id, frame, p.id order by pos) as nth from entries where p.id is not null) where nth = 1),
points as materialized (select * from people where x is not null),
balls as materialized (select match_id, frame, ball is not null as found, case when len(ball.xy) = 2 and isfinite(ball.xy[1]) and isfinite(ball.xy[2]) then ball.xy[1] end as x,
                 case when len(ball.xy) = 2 and isfinite(ball.xy[1]) and isfinite(ball.xy[2]) then ball.xy[2] end as y from lines),
firsts as (select match_id, min(frame) as first_frame, max(frame) as last_frame, count(*) as frames from lines group by match_id)
"""

#: Steps of tracks.
STEPS = """
steps as (select *, counted and v >= 7 as fast from (select *, gap <= 5 and v <= 12 as counted from (select *, d / t as v from (
  select match_id, id, frame as f1, lag(frame) over w as f0, frame - lag(frame) over w as gap, (frame - lag(frame) over w) / 25.0::double as t,
         sqrt((x - lag(x) over w) * (x - lag(x) over w) + (y - lag(y) over w) * (y - lag(y) over w)) as d
  from points window w as (partition by match_id, id order by frame)) where f0 is not null))),
sprints as (select match_id, id, run, min(f0) as start_frame, max(f1) as end_frame, sum(gap) as gap, sum(floor(d * 1000 + 0.487)::bigint) as mm, max(v) as v from (
  select *, sum(case when fast then 0 else 1 end) over (partition by match_id, id order by f1) as run from steps) where fast group by match_id, id, run having sum(gap) / 25.0 >= 1.0 - 1e-9)
"""


def mode_sql(column: str) -> str:
    """CTE with the most common non-null value of a track, ties to the smallest."""
    return (f"m_{column} as (select match_id, id, {column} from (select match_id, id, {column}, row_number() over (partition by match_id, id order by count(*) desc, {column}) as k "
            f"from people where {column} is not null group by match_id, id, {column}) where k = 1)")


MODES = ",\n".join(mode_sql(c) for c in ("role", "team", "jersey"))
COUNTED = MODES + """,
counted_people as (select match_id, id, t.team as team, j.jersey as jersey from m_role r join m_team t using (match_id, id) left join m_jersey j using (match_id, id)
                   where r.role in ('player', 'goalkeeper') and t.team in ('left', 'right'))
"""
