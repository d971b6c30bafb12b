"""Queries of problems 1, 4 and 5."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinefold.operators.regular_grid import MEASURED, regular_seconds
from kinefold.operators.spikes import implausible_values
from kinefold.operators.stops import stops_and_trips
from kinefold.plans.registry import Registry
from kinefold.session import table

REGISTRY = Registry()

#: Newest line of a frame, first entry of an id, exactly two finite numbers.
READINGS_SQL = """
lines as (select match_id, frame, people, row_number() over (partition by match_id, frame order by line_no desc) as rk from frames),
entries as (select match_id, frame, unnest(people) as p, generate_subscripts(people, 1) as pos from lines where rk = 1),
readings as (select match_id, p.id as id, frame, p.role as role, p.team as team, p.jersey as jersey, p.xy as xy,
                    row_number() over (partition by match_id, frame, p.id order by pos) as nth from entries where p.id is not null),
usable as (select match_id, id, frame, xy[1] as x, xy[2] as y from readings where nth = 1 and len(xy) = 2 and isfinite(xy[1]) and isfinite(xy[2]))
"""


@REGISTRY.add("p1_found")
def p1_found(spark, sf):
    found = implausible_values(table(spark, sf, "frames"), table(spark, sf, "analytics"))
    return found.select("field", "match_id", "id", "frame").distinct()


@REGISTRY.add("p4_found")
def p4_found(spark, sf):
    block = lambda c: F.floor(F.col(c) / 100)
    return (stops_and_trips(table(spark, sf, "frames"))
            .select("match_id", "id", "kind", block("start_frame").alias("start_block"), block("end_frame").alias("end_block")).distinct())


@REGISTRY.add("p5_found", f"""with {READINGS_SQL},
seconds as (select distinct match_id, id, frame // 25 as sec from usable),
pairs as (select match_id, id, sec, lead(sec) over (partition by match_id, id order by sec) as nxt from seconds)
select match_id, id, unnest(range(sec + 1, nxt)) as sec_no from pairs where nxt > sec + 1""")
def p5_found(spark, sf):
    return regular_seconds(table(spark, sf, "frames")).where(F.col("status") != MEASURED).select("match_id", "id", "sec_no")


@REGISTRY.add("p5_regular_grid", f"""with {READINGS_SQL},
pairs as (select match_id, id, frame, x, y, frame // 25 as s0, lead(frame) over w as nf, lead(x) over w as nx, lead(y) over w as ny,
                 lag(frame) over w is null as head from usable window w as (partition by match_id, id order by frame)),
grid as (select *, unnest(range(case when head then s0 else s0 + 1 end, coalesce(nf // 25, s0) + 1)) as sec_no from pairs)
select match_id, id, sec_no,
       cast(floor(100 * case when sec_no = s0 then x when nf - frame <= 75 then x + (nx - x) * ((sec_no * 25 - frame) / (nf - frame)) when sec_no = nf // 25 then nx end) as bigint) as x_cm,
       cast(floor(100 * case when sec_no = s0 then y when nf - frame <= 75 then y + (ny - y) * ((sec_no * 25 - frame) / (nf - frame)) when sec_no = nf // 25 then ny end) as bigint) as y_cm,
       case when sec_no = s0 or sec_no = nf // 25 then 'measured' when nf - frame <= 75 then 'filled' else 'missing' end as status
from grid""")
def p5_regular_grid(spark, sf):
    cm = lambda c: F.floor(F.lit(100) * F.col(c)).cast("bigint")
    return regular_seconds(table(spark, sf, "frames")).select("match_id", "id", "sec_no", cm("x").alias("x_cm"), cm("y").alias("y_cm"), "status")
