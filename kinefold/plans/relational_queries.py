"""Relational shapes on the star schema: joins of every kind, grouping sets, set operations, ranking, text and dates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinefold.plans.registry import Registry
from kinefold.session import table

REGISTRY = Registry()

#: Exact money.
MONEY = "decimal(18,2)"


def cents(c):
    return F.round(c * 100).cast("bigint")


def _sql(c: str) -> str:
    return f"cast(round(({c}) * 100) as bigint)"


@REGISTRY.add("pricing_summary", f"""select l_returnflag, l_linestatus, sum(cast(round(l_quantity) as bigint))::bigint as sum_qty, sum({_sql('l_extendedprice')})::bigint as sum_price, count(*) as count_order
from lineitem where l_shipdate <= date '1998-09-02' group by l_returnflag, l_linestatus""")
def pricing_summary(spark, sf):
    return (table(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.to_date(F.lit("1998-09-02"))).groupBy("l_returnflag", "l_linestatus")
            .agg(F.sum(F.round("l_quantity").cast("bigint")).alias("sum_qty"), F.sum(cents(F.col("l_extendedprice"))).alias("sum_price"), F.count("*").alias("count_order")))


@REGISTRY.add("revenue_by_nation", f"""select n_name, sum({_sql('o_totalprice')})::bigint as revenue, count(*) as orders from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name""")
def revenue_by_nation(spark, sf):
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    per = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum(cents(F.col("o_totalprice"))).alias("revenue"), F.count("*").alias("orders"))
    return per.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "revenue", "orders")


@REGISTRY.add("customers_without_orders", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def customers_without_orders(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@REGISTRY.add("customers_without_large_orders", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
def customers_without_large_orders(spark, sf):
    large = table(spark, sf, "orders").where("o_totalprice > 300000")
    return table(spark, sf, "customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@REGISTRY.add("customers_with_orders", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey)")
def customers_with_orders(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@REGISTRY.add("full_outer_counts", """select coalesce(a.k, b.k) as nationkey, coalesce(a.n, 0) as customers, coalesce(b.n, 0) as suppliers from (select c_nationkey as k, count(*) as n from customer group by 1) a full join (select s_nationkey as k, count(*) as n from supplier group by 1) b on a.k = b.k""")
def full_outer_counts(spark, sf):
    a = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("customers"))
    b = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "nationkey", "full").na.fill(0)


@REGISTRY.add("sets_of_nations", """select k, 'both' as kind from (select c_nationkey as k from customer intersect select s_nationkey from supplier) union all select k, 'only_customer' from (select c_nationkey as k from customer except select s_nationkey from supplier) union all select k, 'any' from (select c_nationkey as k from customer union select s_nationkey from supplier)""")
def sets_of_nations(spark, sf):
    a, b = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    kinds = {"both": a.intersect(b), "only_customer": a.subtract(b), "any": a.union(b).distinct()}
    one, two, three = (df.withColumn("kind", F.lit(k)) for k, df in kinds.items())
    return one.unionByName(two).unionByName(three)


_CUBE = "select l_returnflag, l_linestatus, count(*) as n, grouping(l_returnflag)::int as g1, grouping(l_linestatus)::int as g2 from lineitem group by {}"


@REGISTRY.add("cube_counts", _CUBE.format("cube (l_returnflag, l_linestatus)"))
def cube_counts(spark, sf):
    return table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping("l_returnflag").cast("int").alias("g1"), F.grouping("l_linestatus").cast("int").alias("g2"))


@REGISTRY.add("rollup_counts", _CUBE.format("rollup (l_returnflag, l_linestatus)"))
def rollup_counts(spark, sf):
    return table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping("l_returnflag").cast("int").alias("g1"), F.grouping("l_linestatus").cast("int").alias("g2"))


@REGISTRY.add("top_orders", f"select o_orderkey, {_sql('o_totalprice')} as cents from orders order by o_totalprice desc, o_orderkey limit 10")
def top_orders(spark, sf):
    return table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", cents(F.col("o_totalprice")).alias("cents"))


@REGISTRY.add("ranks_per_customer", "select o_orderkey, row_number() over w as rn, rank() over w as rk, dense_rank() over w as dr, ntile(4) over w as quarter from orders window w as (partition by o_custkey order by o_totalprice desc, o_orderkey)")
def ranks_per_customer(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    big = lambda c, n: c.over(w).cast("bigint").alias(n)
    return table(spark, sf, "orders").select("o_orderkey", big(F.row_number(), "rn"), big(F.rank(), "rk"), big(F.dense_rank(), "dr"), big(F.ntile(4), "quarter"))


@REGISTRY.add("session_windows", """with e as (select user_id, epoch_us(ts) as us, event_id, lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) as before from events),
s as (select *, sum(case when before is null or us - before > 21600000000 then 1 else 0 end) over (partition by user_id order by us, event_id) as session from e)
select user_id, min(us) as start_us, max(us) as end_us, count(*) as events from s group by user_id, session""")
def session_windows(spark, sf):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, sf, "events").select("user_id", us.alias("us"), "event_id")
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    gap = F.col("us") - F.lag("us").over(w)
    return (e.withColumn("_s", F.when(gap.isNull() | (gap > 21_600_000_000), 1).otherwise(0)).withColumn("session", F.sum("_s").over(w)).groupBy("user_id", "session")
            .agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count("*").alias("events")).drop("session"))


@REGISTRY.add("daily_windows", "select cast(date_trunc('day', ts) as date) as day, event_type, count(*) as n from events group by all")
def daily_windows(spark, sf):
    return table(spark, sf, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))


@REGISTRY.add("json_fields", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_fields(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@REGISTRY.add("month_revenue", f"select extract(year from o_orderdate)::int as y, extract(month from o_orderdate)::int as m, sum({_sql('o_totalprice')})::bigint as cents from orders group by all")
def month_revenue(spark, sf):
    return table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(F.sum(cents(F.col("o_totalprice"))).alias("cents"))


@REGISTRY.add("content_ids", "select id, substr(sha256(coalesce(name, '')), 1, 10) as short, lower(trim(name)) as plain, length(name) as chars from matches")
def content_ids(spark, sf):
    return table(spark, sf, "matches").select("id", F.substring(F.sha2(F.coalesce("name", F.lit("")), 256), 1, 10).alias("short"), F.lower(F.trim("name")).alias("plain"), F.length("name").cast("bigint").alias("chars"))


@REGISTRY.add("newest_matches", "select id, created_at from matches where regexp_matches(id, '^m_[0-9a-f]{10}$') order by created_at desc, id desc limit 20")
def newest_matches(spark, sf):
    return table(spark, sf, "matches").where(F.col("id").rlike(r"^m_[0-9a-f]{10}\z")).orderBy(F.desc("created_at"), F.desc("id")).limit(20).select("id", "created_at")


@REGISTRY.add("import_drift", """with l as (select match_id, count(distinct frame) as n from frames group by match_id) select id, frame_count, coalesce(n, 0) as recorded, frame_count - coalesce(n, 0) as drift from matches left join l on l.match_id = id""")
def import_drift(spark, sf):
    n = table(spark, sf, "frames").groupBy("match_id").agg(F.count_distinct("frame").alias("n"))
    return table(spark, sf, "matches").join(n, F.col("match_id") == F.col("id"), "left").select("id", "frame_count", F.coalesce("n", F.lit(0)).alias("recorded"), (F.col("frame_count") - F.coalesce("n", F.lit(0))).alias("drift"))


@REGISTRY.add("feature_distance")
def feature_distance(spark, sf):
    """Distance of every feature vector to the mean of its label."""
    e = table(spark, sf, "embeddings")
    vector = next(c for c, t in e.dtypes if t.startswith("array"))
    label = next(c for c, t in e.dtypes if c not in (vector,) and c.startswith("label"))
    long = e.select(F.col(label).alias("label"), F.posexplode(vector).alias("i", "v"))
    mean = long.groupBy("label", "i").agg(F.avg("v").alias("m")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))
    d = F.sqrt(F.aggregate(F.zip_with(vector, "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    return e.withColumn("label", F.col(label)).join(mean, "label").select("label", d.alias("distance"))


@REGISTRY.add("sampled_orders")
def sampled_orders(spark, sf):
    """A tenth of the orders by hash: the same rows at any partitioning."""
    return table(spark, sf, "orders").where(F.pmod(F.xxhash64("o_orderkey", F.lit(3)), F.lit(10)) == 0).select("o_orderkey")


@REGISTRY.add("approximate_distinct")
def approximate_distinct(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey").alias("orders"), F.percentile_approx("l_extendedprice", 0.5, 1000).alias("median"))


@REGISTRY.add("sql_text", "select o_orderpriority, count(*) as n from orders where o_orderdate >= date '1995-01-01' group by o_orderpriority")
def sql_text(spark, sf):
    return spark.sql("select o_orderpriority, count(*) as n from {orders} where o_orderdate >= date '1995-01-01' group by o_orderpriority", orders=table(spark, sf, "orders"))
