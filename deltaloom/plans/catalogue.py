"""Registered queries of the synchronisation engine, each with the same thing in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.functions import compare, criteria
from deltaloom.functions.types import DiffColumn
from deltaloom.operators import chunking, diff, merge, narrow, projection, signature
from deltaloom.plans import quality
from deltaloom.plans.fixtures import (
    EVENTS_DST,
    LINES_ALL_DST,
    LINES_DST,
    ORDERS_ALL_DST,
    ORDERS_DST,
    derived,
    duck,
    events,
    load,
    orders,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

EVENT = "event_id, ts, user_id, event_type, value, props"
ORDER = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
E_DST = f"with dst as ({duck(EVENTS_DST)}) "
O_DST = f"with dst as ({duck(ORDERS_DST)}) "


def query(sql: str):
    """Registers a function under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, *names: str, scale: int = 2) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), scale) for n in names})


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def unset(df: DataFrame) -> DataFrame:
    """A plan with -1 for counts and ids that a side lacks."""
    return df.na.fill(-1)


# --- signatures ---------------------------------------------------------------------------


@query("""select count(*) cnt, count(distinct o_orderkey) unique_cnt_o_orderkey, count(o_orderkey) non_null_cnt_o_orderkey,
max(o_orderkey) max_o_orderkey, min(o_orderkey) min_o_orderkey, sum(o_orderkey)::bigint sum_o_orderkey,
sum(o_custkey)::bigint sum_o_custkey, count(distinct o_orderstatus) cnt_o_orderstatus,
round(sum(o_totalprice::decimal(38,8))::double, 2) sum_o_totalprice, max(o_orderdate) max_o_orderdate,
count(distinct o_orderpriority) cnt_o_orderpriority from orders""")
def signature_table(spark, sf):
    df = load(spark, sf, "orders")
    out = signature.signature(df, signature.plan_columns(df, ["o_orderkey"]))
    return longs(rounded(out, "sum_o_totalprice"), "sum_o_orderkey", "sum_o_custkey")


@query("""select event_type, count(*) cnt, count(distinct event_id) unique_cnt_event_id, count(event_id) non_null_cnt_event_id,
max(event_id) max_event_id, min(event_id) min_event_id, sum(event_id)::bigint sum_event_id, max(ts) max_ts,
sum(user_id)::bigint sum_user_id, round(sum(value::decimal(38,8))::double, 2) sum_value, count(distinct props) cnt_props
from events group by event_type""")
def signature_by_partition(spark, sf):
    df = load(spark, sf, "events")
    cols = signature.plan_columns(df, ["event_id"], ["event_type"])
    return longs(rounded(signature.signature(df, cols, ["event_type"]), "sum_value"), "sum_event_id", "sum_user_id")


@query("""select cast(cast(ts as date) as varchar) d, count(*) cnt, min(event_id) min_id, max(event_id) max_id from events group by 1""")
def signature_by_pseudo_date(spark, sf):
    df = projection.with_pseudo(load(spark, sf, "events"), {"d": "string(to_date(t.ts))"})
    return signature.count_signature(df, ["event_id"], ["d"])


@query("""select count(*) cnt, count(distinct o_orderkey) unique_cnt_o_orderkey, count(o_orderkey) non_null_cnt_o_orderkey,
max(o_orderkey) max_o_orderkey, min(o_orderkey) min_o_orderkey from orders""")
def signature_count_only(spark, sf):
    df = load(spark, sf, "orders")
    return signature.signature(df, signature.plan_columns(df, ["o_orderkey"], count_only=True))


@query("""select event_type, count(*) cnt, max(ts) max_ts, round(sum(value::decimal(38,8))::double, 2) sum_value
from events group by 1""")
def signature_custom(spark, sf):
    df = load(spark, sf, "events")
    own = [DiffColumn("COUNT", "1", alias="cnt"), DiffColumn("MAX", "ts"), DiffColumn("SUM", "value", default=0)]
    out = signature.signature(df, signature.plan_columns(df, ["event_id"], ["event_type"], own), ["event_type"])
    return rounded(out, "sum_value")


@query("""select sum(n)::bigint cnt, min(lo) min_id, max(hi) max_id from
(select event_type, count(*) n, min(event_id) lo, max(event_id) hi from events group by 1)""")
def signature_fold(spark, sf):
    return signature.fold(signature.count_signature(load(spark, sf, "events"), ["event_id"], ["event_type"]))


@query("""select label, count(*) cnt, count(distinct embedding) cnt_embedding from embeddings group by 1""")
def signature_complex_column(spark, sf):
    df = load(spark, sf, "embeddings").select("label", "embedding")
    cols = [DiffColumn("COUNT", "1", alias="cnt"), DiffColumn("COUNT", "embedding")]
    return signature.signature(df, cols, ["label"])


@query("""select lang, count(*) cnt, count(distinct doc_id) unique_cnt_doc_id, count(doc_id) non_null_cnt_doc_id,
max(doc_id) max_doc_id, min(doc_id) min_doc_id, sum(doc_id)::bigint sum_doc_id, count(distinct text) cnt_text,
count(distinct source) cnt_source, sum(n_chars)::bigint sum_n_chars from documents group by 1""")
def signature_text_partition(spark, sf):
    df = load(spark, sf, "documents")
    return longs(signature.signature(df, signature.plan_columns(df, ["doc_id"], ["lang"]), ["lang"]), "sum_doc_id", "sum_n_chars")


# --- comparison ---------------------------------------------------------------------------

_SIG = """count(*) cnt, count(distinct event_id) u, max(event_id) hi, min(event_id) lo,
round(sum(value::decimal(38,8)), 5) v, max(ts) t, sum(user_id) s, count(distinct props) p, sum(event_id) e"""
PLAN_SQL = f"""with dst as ({duck(EVENTS_DST)}),
a as (select event_type, {_SIG} from events group by 1), b as (select event_type, {_SIG} from dst group by 1),
l as (select e.event_type, {_SIG.replace('event_id', 'e.event_id')} from events e join b on e.event_type = b.event_type
      where e.event_id <= b.hi group by 1),
plan as (select coalesce(a.event_type, b.event_type) event_type,
  case when a.cnt is null then 'removed'
       when (a.cnt,a.u,a.hi,a.lo,a.v,a.t,a.s,a.p,a.e) is not distinct from (b.cnt,b.u,b.hi,b.lo,b.v,b.t,b.s,b.p,b.e) then 'inSync'
       when b.cnt is null then 'insert'
       when b.hi > a.hi or b.cnt > a.cnt or b.lo < a.lo then 'deleteMerge'
       when (l.cnt,l.u,l.hi,l.lo,l.v,l.t,l.s,l.p,l.e) is not distinct from (b.cnt,b.u,b.hi,b.lo,b.v,b.t,b.s,b.p,b.e) then 'insert'
       else 'merge' end as method,
  a.cnt src_cnt, b.cnt dst_cnt, a.lo src_min, a.hi src_max, b.lo dst_min, b.hi dst_max
from a full join b on a.event_type = b.event_type left join l on l.event_type = b.event_type) """


def events_plan(spark, sf) -> DataFrame:
    src, dst = events(spark, sf)
    return diff.diff(src, dst, ["event_id"], ["event_type"])


@query(PLAN_SQL + """select event_type, method, coalesce(src_cnt, -1) src_cnt, coalesce(dst_cnt, -1) dst_cnt,
coalesce(src_min, -1) src_min, coalesce(src_max, -1) src_max, coalesce(dst_min, -1) dst_min, coalesce(dst_max, -1) dst_max,
coalesce(case when method = 'inSync' then src_max when method = 'insert' and dst_cnt > 0 then dst_max end, -1) in_sync_id from plan""")
def diff_partition_methods(spark, sf):
    return unset(events_plan(spark, sf))


@query(f"""{O_DST}, s as (select count(*) n, min(o_orderkey) lo, max(o_orderkey) hi from orders),
d as (select count(*) n, min(o_orderkey) lo, max(o_orderkey) hi from dst)
select 'merge' as method, s.n src_cnt, d.n dst_cnt, s.lo src_min, s.hi src_max, d.lo dst_min, d.hi dst_max,
cast(-1 as bigint) in_sync_id from s, d""")
def diff_whole_table(spark, sf):
    src, dst = orders(spark, sf)
    return unset(diff.diff(src, dst, ["o_orderkey"]))


@query("""select l_returnflag, count(*) cnt, count(distinct l_orderkey) unique_cnt_l_orderkey,
count(l_orderkey) non_null_cnt_l_orderkey, max(l_orderkey) max_l_orderkey, min(l_orderkey) min_l_orderkey,
case when count(*) = count(distinct l_orderkey) then null when count(*) <> count(l_orderkey) then 'null'
else 'duplicate' end problem from lineitem group by 1""")
def diff_id_consistency(spark, sf):
    return signature.id_consistency(load(spark, sf, "lineitem"), "l_orderkey", ["l_returnflag"])


@query(f"""{O_DST} select s.o_orderkey, s.o_orderstatus = d.o_orderstatus same_status,
round(s.o_totalprice, 1) = round(d.o_totalprice, 1) same_price from orders s join dst d using (o_orderkey)
where s.o_orderkey % 211 = 9""")
def diff_numeric_precision(spark, sf):
    src, dst = orders(spark, sf)
    keep = F.col("o_orderkey") % 211 == 9
    cols = ["o_orderkey", "o_orderstatus", "o_totalprice"]
    flags = compare.record_similarity(src.filter(keep).select(cols), dst.filter(keep).select(cols), ["o_orderkey"], precision=1)
    return flags.select("o_orderkey", F.col("o_orderstatus").alias("same_status"), F.col("o_totalprice").alias("same_price"))


@query(f"""{O_DST} select o_orderkey, s.o_orderstatus = d.o_orderstatus same_status,
round(s.o_totalprice, 1) = round(d.o_totalprice, 1) same_price from orders s join dst d using (o_orderkey)""")
def diff_numeric_precision_all(spark, sf):
    """``diff_numeric_precision`` over every order of both sides."""
    src, dst = orders(spark, sf)
    cols = ["o_orderkey", "o_orderstatus", "o_totalprice"]
    flags = compare.record_similarity(src.select(cols), dst.select(cols), ["o_orderkey"], precision=1)
    return flags.select("o_orderkey", F.col("o_orderstatus").alias("same_status"), F.col("o_totalprice").alias("same_price"))


@query("""select event_id, true as same_day from events where event_id % 50 = 0""")
def diff_date_format(spark, sf):
    src = load(spark, sf, "events").filter("event_id % 50 = 0").select("event_id", "ts")
    dst = src.withColumn("ts", F.to_date("ts").cast("timestamp_ntz"))
    flags = compare.record_similarity(src, dst, ["event_id"], date_format="yyyy-MM-dd")
    return flags.select("event_id", F.col("ts").alias("same_day"))


@query("""select event_id, strftime(ts, '%Y-%m-%d') = strftime(case when event_id % 7 = 3 then date_trunc('day', ts) + interval 1 day
else date_trunc('day', ts) end, '%Y-%m-%d') same_day from events""")
def diff_date_format_all(spark, sf):
    """``diff_date_format`` over every event, some of which are a day later in the destination."""
    src = load(spark, sf, "events").select("event_id", "ts")
    day = F.to_date("ts")
    day = F.when(F.col("event_id") % 7 == 3, F.date_add(day, 1)).otherwise(day)
    dst = src.withColumn("ts", day.cast("timestamp_ntz"))
    flags = compare.record_similarity(src, dst, ["event_id"], date_format="yyyy-MM-dd")
    return flags.select("event_id", F.col("ts").alias("same_day"))


@query(f"""{E_DST} select distinct event_type from dst where event_type not in (select event_type from events)""")
def removed_partitions(spark, sf):
    return diff.removed_partitions(*events(spark, sf), ["event_type"])


@query(PLAN_SQL + """select coalesce(sum(src_cnt),0)::bigint source, coalesce(sum(dst_cnt),0)::bigint dest,
coalesce(sum(case when method not in ('inSync','removed') then src_cnt end),0)::bigint transferred,
(100 * sum(case when method not in ('inSync','removed') then src_cnt end) // sum(src_cnt))::bigint pct from plan""")
def job_rollup(spark, sf):
    return diff.roll_up(events_plan(spark, sf))


@query(PLAN_SQL + "select method, count(*) slices from plan group by 1")
def method_histogram(spark, sf):
    return diff.method_histogram(events_plan(spark, sf))


# --- filters ------------------------------------------------------------------------------


@query(f"select {EVENT} from events where event_type in ('view', 'click') and user_id in (1, 2, 3, 5, 8)")
def in_list_filter(spark, sf):
    return load(spark, sf, "events").filter(criteria.conjunction({"event_type": ["view", "click"], "user_id": [1, "2", 3, 5, 8]}))


@query(f"select {ORDER} from orders where o_orderkey between 100 and 900 and o_custkey <= 700")
def between_filter(spark, sf):
    return load(spark, sf, "orders").filter(
        criteria.conjunction({"o_orderkey": criteria.Between(100, 900)}, {"o_custkey": criteria.LessOrEqual(700)})
    )


@query(f"select {ORDER} from orders where o_orderkey > 50 and o_custkey >= 10 and o_orderstatus is not null and o_totalprice < 90000.5")
def raw_criteria(spark, sf):
    return load(spark, sf, "orders").filter(
        criteria.conjunction(
            {"o_orderkey": criteria.GreaterThan(50), "o_custkey": criteria.GreaterOrEqual(10)},
            {"o_orderstatus": " is not null", "o_totalprice": "< 90000.5"},
        )
    )


@query(f"select {EVENT} from events where cast(ts as date) = (select min(cast(ts as date)) from events) and event_type = 'view'")
def pseudo_column_filter(spark, sf):
    df = load(spark, sf, "events")
    first = df.agg(F.min(F.to_date("ts"))).first()[0]
    return df.alias("t").filter(criteria.conjunction({"d": str(first), "event_type": "view"}, pseudo={"d": "string(to_date(t.ts))"}))


@query(f"""select {EVENT} from events where (event_type, user_id % 7) in (('view', 1), ('click', 3), ('error', 0))""")
def key_tuple_filter(spark, sf):
    keys = spark.createDataFrame([("view", 1), ("click", 3), ("error", 0)], "event_type string, m long")
    df = load(spark, sf, "events").withColumn("m", F.col("user_id") % 7)
    return df.join(F.broadcast(keys), ["event_type", "m"], "left_semi").select(*EVENT.split(", "))


# --- narrowing and chunks -----------------------------------------------------------------


@query(f"""{E_DST} select e.event_id, e.ts, e.user_id, e.event_type, e.value, e.props from events e left join
(select event_type, max(event_id) top from dst group by 1) d using (event_type) where d.top is null or e.event_id > d.top""")
def new_id_only(spark, sf):
    return narrow.new_ids(*events(spark, sf), "event_id", ["event_type"])


@query(f"""{O_DST}, c as (select unnest([0, 100, 1000, 1400, 100000]) c)
select c::bigint c, (select count(*) from orders where o_orderkey <= c) src_cnt, (select count(*) from dst where o_orderkey <= c) dst_cnt from c""")
def narrow_probe(spark, sf):
    return narrow.probe_all(*orders(spark, sf), "o_orderkey", [0, 100, 1000, 1400, 100000])


CHUNKS_SQL = """r as (select o_orderkey, (row_number() over (order by o_orderkey) - 1) // 1000 chunk from orders),
b as (select chunk, min(o_orderkey) lo, count(*) cnt from r group by 1),
c as (select chunk, lo, lead(lo) over (order by chunk) hi, cnt from b)"""


@query(f"with {CHUNKS_SQL} select chunk::bigint chunk, lo, coalesce(hi, -1) hi, cnt from c")
def chunk_boundaries(spark, sf):
    return unset(chunking.with_ranges(chunking.boundaries(load(spark, sf, "orders"), "o_orderkey", 1000)))


@query("select count(*) cnt, min(o_orderkey) min_id, max(o_orderkey) max_id from (select o_orderkey from orders where o_orderkey >= 37 order by 1 limit 256)")
def chunk_window_topk(spark, sf):
    return chunking.window(load(spark, sf, "orders"), "o_orderkey", 256, 37)


_OSIG = """count(*) n, max(o_orderkey) hi, min(o_orderkey) lo, sum(o_custkey) cu, count(distinct o_orderstatus) st,
round(sum(o_totalprice::decimal(38,8)), 5) pr, max(o_orderdate) dt, count(distinct o_orderpriority) op, sum(o_orderkey) ks"""


@query(f"""{O_DST}, {CHUNKS_SQL},
s as (select c.chunk, {_OSIG} from orders o join c on (o.o_orderkey >= c.lo or c.chunk = 0) and (o.o_orderkey < c.hi or c.hi is null) group by 1),
d as (select c.chunk, {_OSIG} from dst o join c on (o.o_orderkey >= c.lo or c.chunk = 0) and (o.o_orderkey < c.hi or c.hi is null) group by 1),
l as (select c.chunk, {_OSIG.replace('o_orderkey', 'o.o_orderkey')} from orders o join c on (o.o_orderkey >= c.lo or c.chunk = 0) and (o.o_orderkey < c.hi or c.hi is null)
      join d on d.chunk = c.chunk where o.o_orderkey <= d.hi group by 1)
select coalesce(s.chunk, d.chunk)::bigint chunk, case
 when (s.n,s.hi,s.lo,s.cu,s.st,s.pr,s.dt,s.op,s.ks) is not distinct from (d.n,d.hi,d.lo,d.cu,d.st,d.pr,d.dt,d.op,d.ks) then 'inSync'
 when d.n is null then 'insert' when d.hi > s.hi or d.n > s.n or d.lo < s.lo then 'deleteMerge'
 when (l.n,l.hi,l.lo,l.cu,l.st,l.pr,l.dt,l.op,l.ks) is not distinct from (d.n,d.hi,d.lo,d.cu,d.st,d.pr,d.dt,d.op,d.ks) then 'insert'
 else 'merge' end as method, s.n src_cnt, d.n dst_cnt
from s full join d on s.chunk = d.chunk left join l on l.chunk = d.chunk""")
def chunk_methods(spark, sf):
    src, dst = orders(spark, sf)
    bounds = chunking.boundaries(src, "o_orderkey", 1000)
    a, b = (chunking.assign(x, bounds, "o_orderkey") for x in (src, dst))
    return diff.diff(a, b, ["o_orderkey"], ["chunk"]).select("chunk", "method", "src_cnt", "dst_cnt")


# --- apply --------------------------------------------------------------------------------

LINE = "l_suppkey, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
LINE_MAX = ", ".join(f"max({c}) {c}" for c in LINE.split(", "))


@query(f"select l_orderkey, l_linenumber, {LINE_MAX} from lineitem group by 1, 2")
def dedupe_max(spark, sf):
    return merge.dedupe_max(load(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(f"{O_DST} select {ORDER} from dst union all select {ORDER} from orders s where not exists (select 1 from dst d where d.o_orderkey = s.o_orderkey)")
def insert_new_only(spark, sf):
    src, dst = orders(spark, sf)
    return merge.insert_new(dst, src, ["o_orderkey"])


@query(f"{O_DST} select {ORDER} from orders s where not exists (select 1 from dst d where d.o_orderkey = s.o_orderkey)")
def transient_delete(spark, sf):
    src, dst = orders(spark, sf)
    return merge.transient_delete(src, dst, ["o_orderkey"])


@query(f"{E_DST} select {EVENT} from dst d where event_type <> 'error' or exists (select 1 from events s where s.event_id = d.event_id)")
def delete_missing(spark, sf):
    src, dst = events(spark, sf)
    return merge.delete_missing(dst, src, ["event_id"], F.col("event_type") == "error")


@query(f"{O_DST} select {ORDER} from orders union all select {ORDER} from dst d where not exists (select 1 from orders s where s.o_orderkey = d.o_orderkey)")
def upsert_merge(spark, sf):
    src, dst = orders(spark, sf)
    return merge.upsert(dst, src, ["o_orderkey"])


@query(f"""{O_DST}, t as (select * from orders where o_orderkey % 3 = 1) select {ORDER} from t union all
select {ORDER} from dst d where not exists (select 1 from t where t.o_orderkey = d.o_orderkey)""")
def upsert_filtered(spark, sf):
    src, dst = orders(spark, sf)
    return merge.dml("mergeInto", dst, src.filter("o_orderkey % 3 = 1"), ["o_orderkey"])


@query(f"{E_DST} select {EVENT} from dst where event_type <> 'view' union all select {EVENT} from events where event_type = 'view'")
def delete_insert_partition(spark, sf):
    src, dst = events(spark, sf)
    return merge.apply(dst, src.filter("event_type = 'view'"), "deleteInsert", [], F.col("event_type") == "view")


@query(f"{E_DST} select {EVENT} from dst where event_type <> 'error' union all select {EVENT} from events where event_type = 'error'")
def delete_merge(spark, sf):
    src, dst = events(spark, sf)
    return merge.apply(dst, src.filter("event_type = 'error'"), "deleteMerge", ["event_id"], F.col("event_type") == "error")


@query(f"{E_DST} select {EVENT} from dst union all select {EVENT} from events s where not exists (select 1 from dst d where d.event_id = s.event_id)")
def append_only(spark, sf):
    src, dst = events(spark, sf)
    return merge.apply(dst, src, "merge", ["event_id"], append_only=True)


@query(f"{E_DST} select {EVENT} from events union all select {EVENT} from dst d where not exists (select 1 from events s where d.event_id = s.event_id)")
def append_update_only(spark, sf):
    src, dst = events(spark, sf)
    return merge.apply(dst, src, "deleteMerge", ["event_id"], append_update_only=True)


@query(f"{E_DST} select {EVENT} from dst where event_type <> 'legacy'")
def filtered_delete(spark, sf):
    return merge.dml("filteredDelete", events(spark, sf)[1], None, where=criteria.conjunction({"event_type": "legacy"}))


@query(f"""with dst as (select l_orderkey, l_linenumber, {LINE_MAX} from ({duck(LINES_DST)}) group by 1, 2),
t as (select l_orderkey, l_linenumber, {LINE_MAX} from lineitem where l_orderkey % 4 = 3 group by 1, 2)
select l_orderkey, l_linenumber, {LINE} from t union all select l_orderkey, l_linenumber, {LINE} from dst d
where not exists (select 1 from t where t.l_orderkey = d.l_orderkey and t.l_linenumber = d.l_linenumber)""")
def multi_id_merge(spark, sf):
    ids = ["l_orderkey", "l_linenumber"]
    dst = merge.dedupe_max(derived(spark, sf, LINES_DST, "lineitem"), ids)
    return merge.upsert(dst, load(spark, sf, "lineitem").filter("l_orderkey % 4 = 3"), ids)


@query(f"""{O_DST} select o_orderkey, case when s.o_orderkey is not null then s.o_orderstatus else d.o_orderstatus end o_orderstatus,
case when s.o_orderkey is not null then s.o_totalprice else d.o_totalprice end o_totalprice, d.o_orderpriority
from (select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderkey % 2 = 0) s full join
(select o_orderkey, o_orderstatus, o_totalprice, o_orderpriority from dst) d using (o_orderkey)""")
def upsert_explicit_columns(spark, sf):
    src, dst = orders(spark, sf)
    dst = dst.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    t = projection.sync_projection(src.filter("o_orderkey % 2 = 0"), ["o_orderkey"], ["O_ORDERSTATUS", "o_totalprice"])
    return merge.upsert_columns(dst, t, ["o_orderkey"])


@query(f"""with dst as (select l_orderkey, l_linenumber, {LINE_MAX} from ({duck(LINES_ALL_DST)}) group by 1, 2),
t as (select l_orderkey, l_linenumber, {LINE_MAX} from lineitem group by 1, 2)
select l_orderkey, l_linenumber, {LINE} from t union all select l_orderkey, l_linenumber, {LINE} from dst d
where not exists (select 1 from t where t.l_orderkey = d.l_orderkey and t.l_linenumber = d.l_linenumber)""")
def multi_id_merge_all(spark, sf):
    """``multi_id_merge`` with every line of the source."""
    ids = ["l_orderkey", "l_linenumber"]
    dst = merge.dedupe_max(derived(spark, sf, LINES_ALL_DST, "lineitem"), ids)
    return merge.upsert(dst, load(spark, sf, "lineitem"), ids)


@query(f"""with dst as ({duck(ORDERS_ALL_DST)}) select o_orderkey,
case when s.o_orderkey is not null then s.o_orderstatus else d.o_orderstatus end o_orderstatus,
case when s.o_orderkey is not null then s.o_totalprice else d.o_totalprice end o_totalprice, d.o_orderpriority
from (select o_orderkey, o_orderstatus, o_totalprice from orders) s full join
(select o_orderkey, o_orderstatus, o_totalprice, o_orderpriority from dst) d using (o_orderkey)""")
def upsert_explicit_columns_all(spark, sf):
    """``upsert_explicit_columns`` with every order of the source."""
    dst = derived(spark, sf, ORDERS_ALL_DST, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    t = projection.sync_projection(load(spark, sf, "orders"), ["o_orderkey"], ["O_ORDERSTATUS", "o_totalprice"])
    return merge.upsert_columns(dst, t, ["o_orderkey"])


# --- whole runs ---------------------------------------------------------------------------


@query(f"select {EVENT} from events")
def full_sync_result(spark, sf):
    from deltaloom.plans.engine import synchronise

    src, dst = events(spark, sf)
    return synchronise(src, dst, ["event_id"], ["event_type"]).result


@query(f"select {ORDER} from orders")
def chunked_sync_result(spark, sf):
    from deltaloom.plans.engine import synchronise

    src, dst = orders(spark, sf)
    return synchronise(src, dst, ["o_orderkey"], chunk_size=1000).result


@query("select o_custkey as id, count(*) n, round(sum(o_totalprice::decimal(38,8))::double, 2) total from orders group by 1")
def from_query_sync(spark, sf):
    from deltaloom.plans.engine import synchronise

    text = "select o_custkey as id, count(*) n, round(cast(sum(cast(o_totalprice as decimal(38,8))) as double), 2) total from {orders} group by 1"
    src = derived(spark, sf, text, "orders")
    dst = src.filter("id % 5 <> 2").withColumn("n", F.when(F.col("id") % 11 == 0, F.col("n") + 1).otherwise(F.col("n")))
    return synchronise(src, dst, ["id"]).result


@query("select o_orderkey, o_orderstatus, o_totalprice from orders")
def explicit_columns(spark, sf):
    from deltaloom.plans.engine import synchronise

    src, dst = orders(spark, sf)
    cols = ["o_orderkey", "o_orderstatus", "o_totalprice"]
    return synchronise(src.select(cols), dst.select(cols), ["o_orderkey"]).result


@query(f"""{E_DST}, s as (select cast(ts as date) d, count(*) n, round(sum(value::decimal(38,8))::double, 2) v from events group by 1),
t as (select cast(ts as date) d, count(*) n, round(sum(value::decimal(38,8))::double, 2) v from dst group by 1)
select cast(coalesce(s.d, t.d) as varchar) d, s.n src_cnt, t.n dst_cnt, s.v src_sum_value, t.v dst_sum_value,
coalesce(s.n = t.n and round(s.v, 1) = round(t.v, 1), false) equal from s full join t on s.d = t.d""")
def quality_compare_daily(spark, sf):
    return quality.compare_by_date(*events(spark, sf), "ts", ["value"], precision=1).withColumn("d", F.col("d").cast("string"))


@query("select event_id, json_extract_string(props, '$.k') k from events")
def nested_projection(spark, sf):
    return load(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("""select event_id, coalesce(nullif(user_id, 0)::varchar, 'none') user_id, coalesce(nullif(event_type, ''), 'none') event_type from events""")
def omit_empty(spark, sf):
    df = load(spark, sf, "events").select("event_id", "user_id", "event_type")
    out = projection.omit_empty(df, keep=["event_id"])
    return out.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("none")) for c in ("user_id", "event_type")})


@query("select EVENT_TYPE as event_type, count(*) n from events group by 1")
def adapt_case(spark, sf):
    df = projection.adapt_case(load(spark, sf, "events"), ["EVENT_ID", "EVENT_TYPE"])
    return df.groupBy(F.col("EVENT_TYPE").alias("event_type")).agg(F.count(F.lit(1)).alias("n"))


@query("""select 'n_comment' as name, 'missing in source' as problem, cast(null as varchar) src_type, 'string' as dst_type
union all select 'n_nationkey', 'types differ', 'int', 'bigint' union all select 'n_regionkey', 'missing in destination', 'int', null""")
def schema_check(spark, sf):
    src = load(spark, sf, "nation")
    dst = src.select(F.col("n_nationkey").cast("long"), "n_name", F.lit("").alias("n_comment"))
    return quality.compare_schemas(src, dst)
