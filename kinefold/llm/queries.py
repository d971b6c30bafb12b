"""Queries of the operators for training data, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinefold.llm.leakage import leaked, leaks_by_item, phrase_matches, postings
from kinefold.llm.moderation import fit_table, flagged, rates_by_source, score_documents
from kinefold.llm.mixing import draw, goals, language, margins_reached, mixture, plan, shares_reached, sized
from kinefold.llm.percentiles import build_sketches, deduplicated, merge_sketches, percentiles_of, rank_check
from kinefold.llm.runs import label_runs
from kinefold.plans.registry import Registry
from kinefold.session import table

REGISTRY = Registry()

_RUNS_SQL = r"""with
lines as (select match_id, frame, people, row_number() over (partition by match_id, frame order by line_no desc) as rk from frames),
entries as (select match_id, frame, unnest(people) as p, generate_subscripts(people, 1) as pos from lines where rk = 1),
first_entries as (select match_id, p.id as id, frame, p.role as r0, p.team as t0, p.jersey as j0,
                         row_number() over (partition by match_id, frame, p.id order by pos) as nth from entries where p.id is not null),
bare as (select match_id, id, frame, regexp_replace(lower(r0), '[^\p{L}\p{N}]+', '', 'g') as r, regexp_replace(lower(t0), '[^\p{L}\p{N}]+', '', 'g') as t,
                regexp_replace(lower(translate(j0, '０１２３４５６７８９', '0123456789')), '[^\p{L}\p{N}]+', '', 'g') as j from first_entries where nth = 1),
said as (select match_id, id, frame, case when r not in ('', 'none', 'null', 'na', 'nan', 'unknown') then r end as role,
                case when t not in ('', 'none', 'null', 'na', 'nan', 'unknown') then t end as team,
                case when j not in ('', 'none', 'null', 'na', 'nan', 'unknown') then regexp_replace(regexp_replace(j, '^(no|nr|number)([0-9])', '\2'), '^0+([0-9])', '\1') end as jersey from bare),
marked as (select *, case when role is not distinct from lag(role) over w and team is not distinct from lag(team) over w and jersey is not distinct from lag(jersey) over w
                          and lag(frame) over w is not null then 0 else 1 end as fresh from said window w as (partition by match_id, id order by frame)),
numbered as (select *, sum(fresh) over (partition by match_id, id order by frame) as run from marked),
runs as (select match_id, id, role, team, jersey, min(frame) as start_frame, max(frame) as end_frame, count(*) as readings from numbered group by match_id, id, run, role, team, jersey)
"""


@REGISTRY.add("p2_found", _RUNS_SQL + "select match_id, id, start_frame, end_frame from runs where readings >= 2")
def p2_found(spark, sf):
    return label_runs(table(spark, sf, "frames")).where("readings >= 2").select("match_id", "id", "start_frame", "end_frame")


@REGISTRY.add("p2_label_runs", _RUNS_SQL + "select match_id, id, role, team, jersey, start_frame, end_frame, readings, (end_frame - start_frame) / 25.0::double as duration_s from runs")
def p2_label_runs(spark, sf):
    return label_runs(table(spark, sf, "frames"))


@REGISTRY.add("p6_found")
def p6_found(spark, sf):
    return leaked(table(spark, sf, "documents"), table(spark, sf, "eval_items")).select("doc_id", "item_id").distinct()


@REGISTRY.add("p6_leaks_by_item")
def p6_leaks_by_item(spark, sf):
    items = table(spark, sf, "eval_items")
    return leaks_by_item(leaked(table(spark, sf, "documents"), items), items)


@REGISTRY.add("p6_openings", r"""with
d as (select doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ' as t from documents where text is not null),
i as (select item_id, ' ' || array_to_string(regexp_extract_all(lower(passage), '[a-z0-9]+')[1:8], ' ') || ' ' as p from eval_items where passage is not null)
select doc_id, item_id from d, i where contains(t, p) and p <> '  '""")
def p6_openings(spark, sf):
    """Exact phrases: the first eight words of every passage, found by intersecting postings, in plain ASCII words."""
    plain = lambda c: F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))
    index = postings(table(spark, sf, "documents").select("doc_id", plain(F.col("text")).alias("words")))
    openings = table(spark, sf, "eval_items").select("item_id", F.slice(plain(F.col("passage")), 1, 8).alias("words"))
    return phrase_matches(index, openings).select("doc_id", "item_id").distinct()


@REGISTRY.add("p8_found")
def p8_found(spark, sf):
    documents = table(spark, sf, "documents")
    model = fit_table(table(spark, sf, "moderation_examples"), documents)
    return flagged(score_documents(documents, model), model).select("doc_id", "category").distinct()


@REGISTRY.add("p8_scores")
def p8_scores(spark, sf):
    documents = table(spark, sf, "documents")
    return score_documents(documents, fit_table(table(spark, sf, "moderation_examples"), documents))


@REGISTRY.add("p8_rates_by_source")
def p8_rates_by_source(spark, sf):
    documents = table(spark, sf, "documents")
    model = fit_table(table(spark, sf, "moderation_examples"), documents)
    return rates_by_source(documents, score_documents(documents, model), model)

SHARES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999]
GROUPS = ["team", "role"]


def _summaries(spark, sf):
    """Summaries once each, with the day on which they were first computed."""
    rows = deduplicated(table(spark, sf, "analytics"), ["match_id", "id", "team", "role", "seconds", "distance_m", "avg_speed_ms", "max_speed_ms"], "computed_at")
    return rows.withColumn("day", F.to_date("computed_at"))


def _speed_percentiles(rows):
    daily = merge_sketches(build_sketches(rows, ["day", *GROUPS], "avg_speed_ms"), ["day", *GROUPS])
    return percentiles_of(merge_sketches(daily, GROUPS, salts=8), GROUPS, SHARES)


_SHARES_SQL = ", ".join(f"({s}::double)" for s in SHARES)


# a group of up to 1,536 values is not compacted: its percentiles are the exact ones, with error 0
@REGISTRY.add("p3_speed_percentiles", f"""with
once as (select distinct match_id, id, team, role, seconds, distance_m, avg_speed_ms, max_speed_ms from analytics),
sizes as (select team, role, count(case when not isnan(avg_speed_ms) then 1 end) as n from once group by team, role),
ranked as (select team, role, avg_speed_ms as v, row_number() over (partition by team, role order by avg_speed_ms) as rn from once where avg_speed_ms is not null and not isnan(avg_speed_ms))
select z.team, z.role, z.n, s.share, r.v as value, case when z.n <= 1536 then 0.0::double end as rank_error
from sizes z cross join (values {_SHARES_SQL}) as s(share)
left join ranked r on r.team is not distinct from z.team and r.role is not distinct from z.role and r.rn = greatest(1, ceil(s.share * z.n - 1e-9))""")
def p3_speed_percentiles(spark, sf):
    return _speed_percentiles(_summaries(spark, sf))


@REGISTRY.add("p3_error_is_kept")
def p3_error_is_kept(spark, sf):
    """True ranks of the estimates against the stated error; the engine's own check, so it has no SQL."""
    rows = _summaries(spark, sf)
    return rank_check(rows, _speed_percentiles(rows), GROUPS, "avg_speed_ms")


@REGISTRY.add("p3_group_sizes", """select team, role, count(case when not isnan(avg_speed_ms) then 1 end) as n, min(case when not isnan(avg_speed_ms) then avg_speed_ms end) as least,
       max(case when not isnan(avg_speed_ms) then avg_speed_ms end) as most
from (select distinct match_id, id, team, role, seconds, distance_m, avg_speed_ms, max_speed_ms from analytics) group by team, role""")
def p3_group_sizes(spark, sf):
    merged = merge_sketches(build_sketches(_summaries(spark, sf), ["day", *GROUPS], "avg_speed_ms"), GROUPS, salts=8)
    return merged.where("not lower").groupBy(*GROUPS).agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))


@REGISTRY.add("p7_mixture")
def p7_mixture(spark, sf):
    return mixture(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


@REGISTRY.add("p7_shares_reached")
def p7_shares_reached(spark, sf):
    documents, targets = table(spark, sf, "documents"), table(spark, sf, "mix_targets")
    return shares_reached(documents, targets, mixture(documents, targets))


@REGISTRY.add("p7_margins_reached")
def p7_margins_reached(spark, sf):
    sizes = sized(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))
    return margins_reached(sizes, draw(sizes, plan(sizes, table(spark, sf, "mix_targets"))))


@REGISTRY.add("p7_goals_by_length", """with
held as (select source, sum(length(text)) as held from documents where length(text) > 0 group by source),
usable as (select t.source, t.target_share, t.max_repeats, h.held from mix_targets t join held h using (source) where t.target_share > 0 and t.max_repeats > 0),
whole as (select sum(target_share) as shares, min(max_repeats * held / (target_share / (select sum(target_share) from usable))) as total from usable)
select u.source, u.held::bigint as held, round(w.total * u.target_share / w.shares)::bigint as goal, true as met, true as within_cap from usable u, whole w""")
def p7_goals_by_length(spark, sf):
    """The mixture with characters for tokens, which SQL can count: goals by source, each met within 2 %, no cap passed."""
    documents, targets = table(spark, sf, "documents"), table(spark, sf, "mix_targets")
    sizes = (documents.where(F.length("text") > 0).join(targets.select("source").distinct(), "source", "left_semi")
             .select("doc_id", "source", language(F.coalesce("lang", F.lit(""))).alias("language"), F.lit("all").alias("topic"), F.length("text").cast("bigint").alias("tokens")))
    made = plan(sizes, targets)
    got = draw(sizes, made).groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("got"), F.max("copies").alias("highest"))
    held = sizes.groupBy("source").agg(F.sum("tokens").alias("held"))
    return (goals(sizes, made).join(held, "source").join(got, "source", "left").join(targets.select("source", "max_repeats"), "source")
            .select("source", "held", F.round("goal").cast("bigint").alias("goal"), (F.abs(F.coalesce("got", F.lit(0)) - F.col("goal")) <= F.greatest(F.lit(3000.0), 0.02 * F.col("goal"))).alias("met"),
                    (F.coalesce("highest", F.lit(0)) <= F.col("max_repeats")).alias("within_cap")))
