"""Queries over columns: ranges, sorting, grouping, joins, facets, values, places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo, values
from ..operators import facets, ranking
from .registry import Tables, query

# --- ranges and sets


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity between 10 and 12 and l_discount between 0.02 and 0.04")
def point_range(t: Tables) -> DataFrame:
    return t.lineitem.filter(geo.point_range([F.col("l_quantity"), F.col("l_discount")], [10, 0.02], [12, 0.04])).select("l_orderkey", "l_linenumber", "l_quantity")


@query("select o_orderkey, o_orderpriority from orders where o_custkey in (3, 17, 42, 99)")
def point_in_set(t: Tables) -> DataFrame:
    return t.orders.filter(F.col("o_custkey").isin(3, 17, 42, 99)).select("o_orderkey", "o_orderpriority")


@query("select o_orderkey from orders where o_orderpriority in ('1-URGENT', '2-HIGH') and o_totalprice > 490000")
def doc_values_terms(t: Tables) -> DataFrame:
    return t.orders.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_totalprice") > 490000)).select("o_orderkey")


def _ranges(t: Tables) -> DataFrame:
    """Each order's range of line quantities."""
    return t.lineitem.groupBy("l_orderkey").agg(F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"))


_RANGES = "with r as (select l_orderkey, min(l_quantity) as low, max(l_quantity) as high from lineitem group by l_orderkey) select l_orderkey from r where "
_RELATIONS = {"intersects": "low <= 20 and high >= 10", "within": "low >= 10 and high <= 20", "contains": "low <= 10 and high >= 20", "crosses": "low <= 20 and high >= 10 and not (low >= 10 and high <= 20)"}
for _name, _sql in _RELATIONS.items():

    def _relation(t: Tables, _name: str = _name) -> DataFrame:
        return _ranges(t).filter(geo.range_relation([(F.col("low"), F.col("high"))], [(10, 20)], _name)).select("l_orderkey")

    query(_RANGES + _sql, f"range_field_{_name}")(_relation)


@query("select count(*) as n from documents where lang is not null")
def exists_query(t: Tables) -> DataFrame:
    return t.documents.filter(values.exists(F.col("lang"))).agg(F.count("*").alias("n"))


@query("select o_orderkey from orders where o_orderdate >= timestamp '1996-03-01' and o_orderdate < timestamp '1996-05-01'")
def date_range_orders(t: Tables) -> DataFrame:
    return t.orders.filter(geo.date_relation(F.col("o_orderdate"), F.col("o_orderdate") + F.expr("interval 1 microsecond"), "[1996-03 TO 1996-04]")).select("o_orderkey")


@query("select strftime(ts, '%Y%m%d%H') as hour, count(*) as n from events group by all")
def date_strings(t: Tables) -> DataFrame:
    return t.events.groupBy(geo.date_string(F.col("ts"), "hour").alias("hour")).agg(F.count("*").alias("n"))


# --- sorting


@query("select o_orderkey, o_orderpriority, o_totalprice from orders order by o_orderpriority, o_totalprice desc, o_orderkey limit 25")
def sort_multi_key(t: Tables) -> DataFrame:
    return ranking.top(t.orders, 25, F.asc("o_orderpriority"), F.desc("o_totalprice"), F.asc("o_orderkey")).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("select o_orderkey, case when o_orderstatus = 'P' then null else o_totalprice end as price from orders order by price asc nulls last, o_orderkey limit 25")
def sort_missing_last(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("price"))
    return ranking.top(rows, 25, F.asc_nulls_last("price"), F.asc("o_orderkey"))


@query("select o_orderkey as doc_id, o_totalprice as score from orders where o_totalprice < 450000 or (o_totalprice = 450000 and o_orderkey > 7) order by score desc, doc_id limit 10")
def search_after_page(t: Tables) -> DataFrame:
    return ranking.after(t.orders.select(F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("score")), 10, 450000.0, 7)


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10 offset 20")
def topdocs_merge_offset(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_totalprice")
    order = [F.desc("o_totalprice"), F.asc("o_orderkey")]
    shards = [ranking.top(rows.filter(F.col("o_orderkey") % 3 == i), 30, *order) for i in range(3)]
    return ranking.merge_top(shards, 10, *order, offset=20)


@query("with f as (select o_orderkey as doc_id, o_totalprice as score from orders order by score desc, doc_id limit 50) select f.doc_id, round(f.score + 1000 * coalesce(n, 0), 4) as score from f left join (select l_orderkey, count(*) as n from lineitem where l_returnflag = 'R' group by all) s on f.doc_id = s.l_orderkey")
def rescore_query(t: Tables) -> DataFrame:
    hits = t.orders.select(F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("score"))
    second = t.lineitem.filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count("*").cast("double").alias("score"))
    return ranking.rescore(hits, second, 50, 1000.0).select("doc_id", F.round("score", 4).alias("score"))


@query("with f as (select o_orderkey as doc_id, o_totalprice as score, o_orderdate from orders order by score desc, doc_id limit 30) select doc_id from f order by o_orderdate, doc_id limit 10")
def rescore_sort(t: Tables) -> DataFrame:
    hits = t.orders.select(F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("score"), "o_orderdate")
    return ranking.rescore_by(hits, 30, [F.asc("o_orderdate"), F.asc("doc_id")]).select("doc_id").limit(10)


@query("with r as (select o_orderkey, o_custkey, o_totalprice, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as k from orders) select o_orderkey, o_custkey, o_totalprice from r where k <= 2 order by o_totalprice desc, o_orderkey limit 20")
def diversified_topk(t: Tables) -> DataFrame:
    return ranking.diversified(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey", [F.desc("o_totalprice"), F.asc("o_orderkey")], 20, 2)


@query("with a as (select l_orderkey, list_sort(list(l_quantity)) as q from lineitem group by l_orderkey) select l_orderkey, q[1] as low, q[len(q)] as high, q[(len(q) - 1) // 2 + 1] as middle_min, q[len(q) // 2 + 1] as middle_max from a")
def multi_value_selectors(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("q"))
    return rows.select("l_orderkey", *[ranking.select_value(F.col("q"), p).alias(a) for p, a in (("min", "low"), ("max", "high"), ("middle_min", "middle_min"), ("middle_max", "middle_max"))])


# --- grouping


@query("with g as (select o_custkey, max(o_totalprice) as m from orders group by all order by m desc, o_custkey limit 10), r as (select o_custkey, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders join g using (o_custkey)) select o_custkey, o_orderkey, o_totalprice, cast(rank as integer) as rank from r where rank <= 3")
def group_top_docs(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderkey", "o_totalprice")
    return ranking.top_groups(rows, "o_custkey", F.max("o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 10, 3).select("o_custkey", "o_orderkey", "o_totalprice", "rank")


@query("select o_custkey, o_orderkey from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as k from orders) where k = 1")
def group_heads(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("o_orderkey"))


@query("select count(distinct o_custkey) as n from orders")
def all_groups(t: Tables) -> DataFrame:
    return t.orders.agg(F.count_distinct("o_custkey").alias("n"))


@query("select o_orderpriority, count(distinct o_custkey) as n from orders group by all")
def distinct_values_per_group(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("n"))


@query("select o_orderpriority as label, count(distinct o_custkey) as value from orders where o_totalprice > 100000 group by all")
def grouped_facets(t: Tables) -> DataFrame:
    return facets.grouped_counts(t.orders.filter("o_totalprice > 100000"), "o_custkey", "o_orderpriority")


@query("select cast(floor(o_totalprice / 100000) as bigint) as g, count(*) as n from orders group by all")
def group_by_function(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.floor(F.col("o_totalprice") / 100000).alias("g")).agg(F.count("*").alias("n"))


# --- facets


@query("select p_brand as label, count(*) as value from part group by all order by value desc, label limit 10")
def facet_flat(t: Tables) -> DataFrame:
    return facets.counts(t.part, "p_brand", 10)


@query("with p as (select [p_type, p_brand, cast(p_size as varchar)] as p from part), e as (select array_to_string(p[1:d], '/') as path, d as depth from p, (select unnest([1, 2, 3]) as d)) select path, cast(depth as integer) as depth, count(*) as value from e group by all")
def facet_hierarchy(t: Tables) -> DataFrame:
    return facets.path_counts(t.part, F.array("p_type", "p_brand", F.col("p_size").cast("string"))).select("path", "depth", F.col("value").cast("long").alias("value"))


@query("select p_type || '/' || p_brand as path, count(*) as value from part where p_type = 'PROMO' group by all order by value desc, path limit 5")
def facet_children(t: Tables) -> DataFrame:
    tree = facets.path_counts(t.part, F.array("p_type", "p_brand"))
    return facets.children(tree, "PROMO", 5).select("path", F.col("value").cast("long").alias("value"))


@query("select p_brand as label, cast(sum(p_size) as bigint) as value from part group by all")
def facet_sum_int(t: Tables) -> DataFrame:
    return facets.counts(t.part, "p_brand", value=F.col("p_size"))


@query("select l_returnflag as label, round(sum(l_extendedprice * (1 - l_discount)), 2) as value from lineitem group by all")
def facet_sum_value(t: Tables) -> DataFrame:
    rows = facets.counts(t.lineitem, "l_returnflag", value=F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return rows.select("label", F.round("value", 2).alias("value"))


@query("select 'low' as label, cast(count_if(l_quantity >= 0 and l_quantity < 20) as bigint) as value from lineitem union all select 'mid', cast(count_if(l_quantity >= 15 and l_quantity <= 30) as bigint) from lineitem union all select 'high', cast(count_if(l_quantity > 30 and l_quantity <= 50) as bigint) from lineitem")
def facet_range_overlapping(t: Tables) -> DataFrame:
    ranges = [facets.Range("low", 0, 20), facets.Range("mid", 15, 30, with_high=True), facets.Range("high", 30, 50, False, True)]
    return facets.range_counts(t.lineitem, "l_quantity", ranges)


@query("select p_brand as label, count(*) as value from part where p_type in ('PROMO', 'SMALL') and p_size in (1, 2, 3, 4, 5) group by all")
def drill_down(t: Tables) -> DataFrame:
    return facets.counts(facets.drill_down(t.part, {"p_type": ["PROMO", "SMALL"], "p_size": [1, 2, 3, 4, 5]}), "p_brand")


@query("select 'p_type' as dim, p_type as label, count(*) as value from part where p_size in (1, 2, 3) group by all union all select 'p_size', cast(p_size as varchar), count(*) from part where p_type in ('PROMO', 'SMALL') group by all")
def drill_sideways(t: Tables) -> DataFrame:
    return facets.drill_sideways(t.part, {"p_type": ["PROMO", "SMALL"], "p_size": [1, 2, 3]})


@query("select count(l_quantity) as count, cast(count_if(l_quantity is null) as bigint) as missing, min(l_quantity) as min, max(l_quantity) as max, sum(l_quantity) as sum, round(avg(l_quantity), 6) as mean, round(var_pop(l_quantity), 4) as variance, round(stddev_pop(l_quantity), 6) as stdev from lineitem")
def docvalues_stats(t: Tables) -> DataFrame:
    s = facets.stats(t.lineitem, "l_quantity")
    return s.select("count", "missing", "min", "max", "sum", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"), F.round("stdev", 6).alias("stdev"))


@query("select url as host, count(*) as value from (select regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as url from pages) group by all order by value desc, host limit 10")
def facet_hosts(t: Tables) -> DataFrame:
    rows = facets.counts(t.pages.select(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host")), "host", 10)
    return rows.withColumnRenamed("label", "host")


# --- joins

_CHILD = "select l_orderkey, l_quantity as score from lineitem where l_returnflag = 'R' and l_discount >= 0.05"


def _children(t: Tables) -> DataFrame:
    return t.lineitem.filter("l_returnflag = 'R' and l_discount >= 0.05").select("l_orderkey", F.col("l_quantity").alias("score"))


for _name, _sql in {"none": "1e0", "avg": "avg(score)", "max": "max(score)", "min": "min(score)", "total": "sum(score)"}.items():

    def _parents(t: Tables, _name: str = _name) -> DataFrame:
        return ranking.to_parent(_children(t), "l_orderkey", _name).select("l_orderkey", F.round("score", 6).alias("score"))

    query(f"select l_orderkey, round({_sql}, 6) as score from ({_CHILD}) group by l_orderkey", f"parent_score_{_name}")(_parents)


@query("select l_orderkey, l_linenumber, o_totalprice as score from lineitem join orders on l_orderkey = o_orderkey where o_totalprice > 480000")
def to_child(t: Tables) -> DataFrame:
    parents = t.orders.filter("o_totalprice > 480000").select("o_orderkey", F.col("o_totalprice").alias("score"))
    return ranking.to_children(parents, t.lineitem.select("l_orderkey", "l_linenumber"), "o_orderkey", "l_orderkey")


@query("select o_orderkey, m as child_value from orders left join (select l_orderkey, min(l_quantity) as m from lineitem group by all) on l_orderkey = o_orderkey order by m asc nulls last, o_orderkey limit 20")
def parent_sort_min(t: Tables) -> DataFrame:
    rows = ranking.parents_by_child(t.orders.select("o_orderkey"), t.lineitem, "o_orderkey", "l_orderkey", "l_quantity")
    return ranking.top(rows, 20, F.asc_nulls_last("child_value"), F.asc("o_orderkey"))


@query("select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_totalprice > 490000)")
def join_query_semi(t: Tables) -> DataFrame:
    return ranking.key_join(t.customer.select("c_custkey", "c_name"), "c_custkey", t.orders.filter("o_totalprice > 490000"), "o_custkey")


for _name, _sql in {"avg": "avg", "max": "max", "min": "min", "total": "sum"}.items():

    def _joined(t: Tables, _name: str = _name) -> DataFrame:
        hits = t.orders.filter("o_orderstatus = 'F'").select("o_custkey", F.col("o_totalprice").alias("score"))
        return ranking.key_join(t.customer.select("c_custkey"), "c_custkey", hits, "o_custkey", _name).select("c_custkey", F.round("score", 4).alias("score"))

    query(f"select c_custkey, round({_sql}(o_totalprice), 4) as score from customer join orders on o_custkey = c_custkey where o_orderstatus = 'F' group by c_custkey", f"join_score_{_name}")(_joined)


@query("select c_custkey, 1e0 as score from customer join orders on o_custkey = c_custkey group by c_custkey having count(*) between 3 and 6")
def join_min_max_children(t: Tables) -> DataFrame:
    return ranking.key_join(t.customer.select("c_custkey"), "c_custkey", t.orders, "o_custkey", least=3, most=6)


@query("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem)")
def anti_join(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey").join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("select count(*) as orphans from lineitem where l_orderkey not in (select o_orderkey from orders)")
def check_join_index(t: Tables) -> DataFrame:
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(F.count("*").alias("orphans"))


# --- values and expressions


@query("select o_orderkey, round(o_totalprice * 2 + 1, 4) as linear, case when o_orderstatus = 'F' then 1 else 0 end as flag, greatest(o_totalprice, 200000.0) as most, round(pow(o_totalprice, 0.5), 6) as root, round(1000.0 / (0.01 * o_totalprice + 10), 6) as recip from orders")
def value_sources(t: Tables) -> DataFrame:
    x = F.col("o_totalprice")
    return t.orders.select("o_orderkey", F.round(values.linear(x, 2, 1), 4).alias("linear"), values.if_(F.col("o_orderstatus") == "F", F.lit(1), F.lit(0)).alias("flag"), values.largest(x, values.const(200000.0)).alias("most"), F.round(values.power(x, F.lit(0.5)), 6).alias("root"), F.round(values.reciprocal(x, 0.01, 1000, 10), 6).alias("recip"))


@query("select l_orderkey, l_linenumber, round(case when l_discount > 0.05 then l_extendedprice * (1 - l_discount) else sqrt(l_extendedprice) + ln(l_quantity) / ln(2) end, 4) as v from lineitem")
def expression_js(t: Tables) -> DataFrame:
    e = values.expression("disc > 0.05 ? price * (1 - disc) : sqrt(price) + logn(2, l_quantity)", {"disc": F.col("l_discount"), "price": F.col("l_extendedprice")})
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(e, 4).alias("v"))


@query("select o_orderkey from orders where (cast(o_orderkey as bigint) & 6) << 1 = 8 and o_totalprice % 2 < 1")
def expression_bits(t: Tables) -> DataFrame:
    return t.orders.filter(values.expression("(o_orderkey & 6) << 1 == 8 && o_totalprice % 2 < 1") != 0).select("o_orderkey")


@query("select o_orderkey, round((o_totalprice - a) / (b - a) * 9 + 1, 6) as scaled from orders, (select min(o_totalprice) as a, max(o_totalprice) as b from orders)")
def scale_function(t: Tables) -> DataFrame:
    return values.scaled(t.orders, "o_totalprice", 1, 10).select("o_orderkey", F.round("scaled", 6).alias("scaled"))


@query("with f as (select o_orderkey as doc_id, o_totalprice as score from orders order by score desc, doc_id limit 100) select doc_id from f order by sin(score), doc_id limit 10")
def expression_rescore(t: Tables) -> DataFrame:
    hits = t.orders.select(F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("score"))
    return ranking.rescore_by(hits, 100, [values.expression("sin(score)"), F.asc("doc_id")]).select("doc_id").limit(10)


# --- places: events placed on the globe by their numbers

_PLACES = "(select event_id, (event_id * 37 % 1800) / 10.0 - 90 as lat, (event_id * 91 % 3600) / 10.0 - 180 as lon from events)"
_KM = "2 * 6371.0087714 * asin(least(1.0, sqrt(pow(sin((radians(48.85) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(48.85)) * pow(sin((radians(2.35) - radians(lon)) / 2), 2))))"


def _places(t: Tables) -> DataFrame:
    return t.events.select("event_id", ((F.col("event_id") * 37 % 1800) / 10.0 - 90).alias("lat"), ((F.col("event_id") * 91 % 3600) / 10.0 - 180).alias("lon"))


@query(f"select event_id, round({_KM}, 3) as km from {_PLACES} order by {_KM}, event_id limit 10")
def haversine_topk(t: Tables) -> DataFrame:
    return geo.nearest(_places(t), "lat", "lon", 48.85, 2.35, 10, "event_id").select("event_id", F.round("km", 3).alias("km"))


@query(f"select event_id from {_PLACES} where {_KM} <= 800")
def distance_query(t: Tables) -> DataFrame:
    return _places(t).filter(geo.near(F.col("lat"), F.col("lon"), 48.85, 2.35, 800_000)).select("event_id")


@query(f"select event_id from {_PLACES} where lat between -20 and 20 and (lon >= 170 or lon <= -170)")
def box_dateline(t: Tables) -> DataFrame:
    return _places(t).filter(geo.box(F.col("lat"), F.col("lon"), -20, 20, 170, -170)).select("event_id")


@query(f"select event_id from {_PLACES} where lat > 0.05 and lon > 0.05 and lat + lon < 39.95 and not (lat > 5.05 and lat < 9.95 and lon > 5.05 and lon < 9.95)")
def polygon_query(t: Tables) -> DataFrame:
    ring, hole = ([0.05, 0.05, 39.9, 0.05], [0.05, 39.9, 0.05, 0.05]), ([5.05, 5.05, 9.95, 9.95, 5.05], [5.05, 9.95, 9.95, 5.05, 5.05])
    return _places(t).filter(geo.in_polygon(F.col("lat"), F.col("lon"), *ring, [hole])).select("event_id")


@query(f"select cast(7 - least(floor((lat + 90) / 180 * 8), 7) as integer) as row, cast(least(floor((lon + 180) / 360 * 8), 7) as integer) as col, count(*) as n from {_PLACES} group by all")
def heatmap_facet(t: Tables) -> DataFrame:
    return geo.heatmap(_places(t), "lat", "lon", 3)


@query("select event_id from (select event_id, user_id % 256 as b, event_id % 256 as c from events) where b between 16 and 31")
def ip_prefix(t: Tables) -> DataFrame:
    address = F.concat(F.lit("10."), (F.col("user_id") % 256).cast("string"), F.lit("."), (F.col("event_id") % 256).cast("string"), F.lit(".1"))
    return t.events.filter(geo.inet_in(geo.inet(address), "10.16.0.0/12")).select("event_id")


# --- events in windows


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by all")
def windowed_events(t: Tables) -> DataFrame:
    from ..streaming.search import windowed_counts

    return windowed_counts(t.events, "ts", "event_type")


@query("with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hour then 0 else 1 end as fresh from events), s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts) as k from g) select user_id, min(ts) as start, count(*) as n from s group by user_id, k")
def event_sessions(t: Tables) -> DataFrame:
    from ..streaming.search import sessions

    return sessions(t.events, "ts", "user_id", "6 hours")
