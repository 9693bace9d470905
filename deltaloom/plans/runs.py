"""Registered queries of whole runs, requests and their parts, each with the same thing in SQL.

They join those of the catalogue in its ``QUERIES`` and ``ORACLE_SQL``.
"""

from __future__ import annotations

import json
import uuid
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.contract import Resource, parse_request
from deltaloom.functions import compare, criteria
from deltaloom.operators import chunking, diff, merge, narrow, projection, signature
from deltaloom.plans import quality
from deltaloom.plans.catalogue import (
    E_DST,
    EVENT,
    O_DST,
    ORACLE_SQL,
    ORDER,
    PLAN_SQL,
    QUERIES,
    events_plan,
    longs,
    query,
    rounded,
    unset,
)
from deltaloom.plans.engine import Engine, synchronise
from deltaloom.plans.fixtures import events, load, orders
from deltaloom.plans.schedule import At, Frequency, Schedule, schedule_id
from deltaloom.plans.transfer import Transfers
from deltaloom.sources import loaders
from deltaloom.sources.staging import stage, staging_root
from deltaloom.sources.store import SnapshotTable

__all__ = ["ORACLE_SQL", "QUERIES"]
EVENTS_OF = "select {cols} from events".format(cols=EVENT)


def folder(spark: SparkSession, name: str) -> str:
    return f"{staging_root(spark)}/deltaloom/{name}-{uuid.uuid4().hex}"


def run(spark: SparkSession, sf: str, table: str, dst: DataFrame, strategy: dict, **more):
    """A request of the driver's table into a snapshot of ``dst``: its response, and the table after it."""
    target = SnapshotTable(spark, folder(spark, "dest"))
    target.commit(dst)
    source = {"path": f"{sf}/{table}.parquet"} | more.pop("source", {})
    body = {"id": uuid.uuid4().hex, "source": source, "dest": {"path": target.path} | more.pop("dest", {}), "strategy": strategy}
    response = Engine(spark).sync(parse_request(json.dumps(body | more)))
    if response.status != "ok":
        raise RuntimeError(response.error)
    return response, target.read()


BY_TYPE = {"ids": ["event_id"], "partition": {"columns": ["event_type"]}}


@query(EVENTS_OF)
def engine_sync_result(spark, sf):
    return run(spark, sf, "events", events(spark, sf)[1], BY_TYPE, dmlTimeout=600)[1]


@query(PLAN_SQL + """select 'ok' status, coalesce(sum(case when method not in ('inSync','removed') then src_cnt end),0)::bigint source,
coalesce(sum(case when method not in ('inSync','removed') then dst_cnt end),0)::bigint dest, count(*) slices from plan""")
def engine_response(spark, sf):
    r, _ = run(spark, sf, "events", events(spark, sf)[1], BY_TYPE)
    return spark.createDataFrame([(r.status, r.source, r.dest, sum(r.methods.values()))], "status string, source long, dest long, slices long")


@query(f"{E_DST} select {EVENT} from events where event_type = 'view' union all select {EVENT} from dst where event_type <> 'view'")
def criteria_sync_result(spark, sf):
    return run(spark, sf, "events", events(spark, sf)[1], {"ids": ["event_id"]}, criteria={"event_type": "view"})[1]


@query(EVENTS_OF)
def pseudo_partition_sync(spark, sf):
    day = {"pseudo": {"day": "TO_CHAR(t.ts, 'YYYY-MM-DD')"}}
    strategy = {"ids": ["event_id"], "partition": {"columns": ["day"]}}
    return run(spark, sf, "events", events(spark, sf)[1], strategy, source=day, dest=day)[1]


@query(f"{E_DST} select {EVENT} from events where event_type in ('view', 'error') union all select {EVENT} from dst where event_type not in ('view', 'error')")
def provider_partitions_sync(spark, sf):
    asked = "select * from values ('view'), ('error') as v(event_type)"
    strategy = {"ids": ["event_id"], "partition": {"columns": ["event_type"], "providerSql": asked}}
    return run(spark, sf, "events", events(spark, sf)[1], strategy)[1]


@query(f"select {ORDER} from orders")
def force_sync_result(spark, sf):
    return run(spark, sf, "orders", orders(spark, sf)[1], {"ids": ["o_orderkey"], "force": True})[1]


@query(EVENTS_OF)
def individual_partitions(spark, sf):
    strategy = {"ids": ["event_id"], "partition": {"columns": ["event_type"], "syncMode": "individual"}}
    return run(spark, sf, "events", events(spark, sf)[1], strategy)[1]


@query(f"select {ORDER} from orders")
def individual_chunks(spark, sf):
    dst = orders(spark, sf)[0].withColumn("o_custkey", F.expr("case when o_orderkey in (7, 8) then 0L else o_custkey end"))
    strategy = {"ids": ["o_orderkey"], "chunk": {"size": 4096, "syncMode": "individual"}}
    return run(spark, sf, "orders", dst, strategy)[1]


@query(f"{E_DST} select {EVENT} from dst union all select {EVENT} from events s where event_id > (select max(event_id) from dst where event_id < 1000000000)")
def direct_append_result(spark, sf):
    dst = events(spark, sf)[0].filter(F.col("event_id") <= events(spark, sf)[1].filter("event_id < 1000000000").agg(F.max("event_id")).first()[0])
    kept = events(spark, sf)[1]
    out = run(spark, sf, "events", dst, {"ids": ["event_id"], "directAppend": True})[1]
    return kept.unionByName(out.join(dst.select("event_id"), "event_id", "left_anti").select(*kept.columns))


@query(f"{E_DST} select event_id, ts, user_id, event_type, value, props, case when in_dst then 'kept' end note from (select e.*, d.event_id is not null in_dst "
       "from events e left join dst d on d.event_id = e.event_id)")
def extra_column_sync(spark, sf):
    src, dst = events(spark, sf)
    return synchronise(src, dst.withColumn("note", F.lit("kept")), ["event_id"], ["event_type"]).result


@query(f"""{O_DST}, s as (select count(*) n, min(o_orderkey) lo, max(o_orderkey) hi from orders where o_orderkey <= (select max(o_orderkey) from dst)),
r as (select *, (row_number() over (order by o_orderkey) - 1) // 1000 c from orders), b as (select c, min(o_orderkey) lo from r group by 1),
x as (select c, lo, lead(lo) over (order by c) hi from b),
p as (select x.c, count(*) n, min(o_orderkey) lo, max(o_orderkey) hi from orders o join x on o.o_orderkey >= x.lo and (o.o_orderkey < x.hi or x.hi is null) group by 1),
q as (select x.c, count(*) n, min(o_orderkey) lo, max(o_orderkey) hi from dst o join x on o.o_orderkey >= x.lo and (o.o_orderkey < x.hi or x.hi is null) group by 1)
select count(*) slices, sum(case when p.n = q.n and p.lo = q.lo and p.hi = q.hi then 1 else 0 end)::bigint skipped from p left join q using (c)""")
def append_only_chunk_skip(spark, sf):
    src, dst = orders(spark, sf)
    bounds = chunking.boundaries(src, "o_orderkey", 1000)
    a, b = (chunking.assign(x, bounds, "o_orderkey") for x in (src, dst))
    plan = diff.diff(a, b, ["o_orderkey"], ["chunk"], count_only=True, probe=False)
    return plan.agg(F.count(F.lit(1)).alias("slices"), F.sum(diff.brief_equality().cast("int")).cast("long").alias("skipped"))


BAD = "(select max(o_orderkey) - max(o_orderkey) // 2000 from orders)"


@query(f"""with recursive e as (select min(o_orderkey) lo, max(o_orderkey) hi from orders),
p as (select 1 i, hi - (hi - lo) // 2 as v, (hi - lo) // 2 as step, null::bigint as good from e
  union all select i + 1, case when v < {BAD} then v + step // 2 else v - step // 2 end, step // 2, case when v < {BAD} then v else good end from p where i <= 5),
f as (select good from p where i = 6)
select 'merge' as method, good as in_sync_id, (select count(*) from orders where o_orderkey > good)::bigint moved from f""")
def narrow_bisection(spark, sf):
    """One changed order near the end: five probes of halved steps leave a few of a hundred rows."""
    src = load(spark, sf, "orders")
    top = src.agg(F.max("o_orderkey")).first()[0]
    dst = src.withColumn("o_totalprice", F.when(F.col("o_orderkey") == top - top // 2000, 0.0).otherwise(F.col("o_totalprice")))
    out = synchronise(src, dst, ["o_orderkey"], depth=5)
    return out.plan.select("method", "in_sync_id", F.lit(out.moved.count()).alias("moved"))


@query(PLAN_SQL + "select event_type, least(src_min, dst_min) low, greatest(src_max, dst_max) high from plan where src_cnt > 0 and dst_cnt > 0")
def status_range(spark, sf):
    return diff.span(events_plan(spark, sf)).filter("src_cnt > 0 and dst_cnt > 0").select("event_type", "low", "high")


@query(PLAN_SQL + "select event_type, src_cnt - (dst_cnt - (dst_max - src_min)) src_left, dst_cnt - (dst_cnt - (dst_max - src_min)) dst_left from plan where src_cnt > 0 and dst_cnt > 0")
def in_sync_adjust(spark, sf):
    plan = events_plan(spark, sf).filter("src_cnt > 0 and dst_cnt > 0")
    a, b = narrow.dense_remaining(F.col("src_cnt"), F.col("dst_cnt"), F.col("dst_max"), F.col("src_min"))
    return plan.select("event_type", a.alias("src_left"), b.alias("dst_left"))


@query(PLAN_SQL + "select event_type, case when method = 'insert' and coalesce(dst_cnt, 0) = 0 then 'direct' else method end kind, method in ('deleteMerge', 'deleteInsert') deletes from plan")
def kind_labels(spark, sf):
    plan = events_plan(spark, sf)
    direct = (F.col("method") == diff.INSERT) & (F.coalesce("dst_cnt", F.lit(0)) == 0)
    return plan.select("event_type", diff.label(F.col("method"), direct).alias("kind"), F.col("method").isin(*diff.DELETES).alias("deletes"))


@query(f"""{E_DST} select e.event_type, 'insert' as method, count(*) src_cnt from events e left join
(select event_type, max(event_id) top from dst group by 1) d using (event_type) where d.top is null or e.event_id > d.top group by 1""")
def status_from_new_ids(spark, sf):
    src, dst = events(spark, sf)
    return synchronise(src, dst, ["event_id"], ["event_type"], new_id_only=True).plan.select("event_type", "method", "src_cnt")


@query(PLAN_SQL + "select event_type, coalesce(src_cnt = dst_cnt and src_min = dst_min and src_max = dst_max, false) same from plan")
def brief_signature_equality(spark, sf):
    return events_plan(spark, sf).select("event_type", diff.brief_equality().alias("same"))


@query(f"select {ORDER} from orders where o_custkey = 7")
def int_equality_filter(spark, sf):
    return load(spark, sf, "orders").filter(criteria.conjunction({"o_custkey": " 7"}))


@query(PLAN_SQL + "select p.method, count(*) rows_, min(e.event_id) first_id from plan p join events e using (event_type) group by 1")
def batched_filters(spark, sf):
    """The filters of a plan's slices in lists by method, each list one predicate."""
    src = load(spark, sf, "events")
    plan = [(r["method"], {"event_type": r["event_type"]}) for r in events_plan(spark, sf).filter("src_cnt > 0").collect()]
    parts = [
        src.filter(criteria.conjunction(one)).agg(F.lit(method).alias("method"), F.count(F.lit(1)).alias("rows_"), F.min("event_id").alias("first_id"))
        for method, lists in criteria.batches_by(plan, 2).items()
        for one in lists
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.groupBy("method").agg(F.sum("rows_").cast("long").alias("rows_"), F.min("first_id").alias("first_id"))


@query(f"{O_DST} select {ORDER} from dst union all select {ORDER} from orders")
def append_rows(spark, sf):
    src, dst = orders(spark, sf)
    return merge.dml("append", dst, src, ["o_orderkey"])


@query(f"""{O_DST} select {ORDER} from orders union all
select {ORDER} from dst d where d.o_custkey > 700 or not exists (select 1 from orders s where s.o_orderkey = d.o_orderkey)""")
def merge_under_filter(spark, sf):
    src, dst = orders(spark, sf)
    return merge.dml("merge", dst, src, ["o_orderkey"], F.col("o_custkey") <= 700)


@query(f"""{O_DST}, t as (select * from orders where o_custkey <= 700) select {ORDER} from t union all
select {ORDER} from dst d where not exists (select 1 from t where t.o_orderkey = d.o_orderkey)""")
def insert_or_replace_filtered(spark, sf):
    src, dst = orders(spark, sf)
    return merge.dml("insertOrReplace", dst, src, ["o_orderkey"], F.col("o_custkey") <= 700)


@query("select event_type, sum(user_id)::bigint sum_user_id, max(event_id) max_event_id from events group by 1")
def record_folds(spark, sf):
    made = signature.fold_records(load(spark, sf, "events"), {"user_id": "sum", "event_id": "max", "absent": "min"}, ["event_type"])
    return longs(made, "sum_user_id")


@query("""select event_id, strftime(ts, '%Y-%m-%d') d, strftime(ts, '%Y%m') m, floor(epoch(ts))::bigint s, floor(epoch(ts))::bigint o, cast(cast(ts as date) as varchar) v,
strftime(ts, '%Y') y from events where ts < now()::timestamp - interval 3 day""")
def vendor_scalars(spark, sf):
    pseudo = {
        "d": "TO_CHAR(t.ts, 'YYYY-MM-DD')", "m": "TO_CHAR(t.ts, 'YYYYMM')", "s": "UNIX_SECONDS(CAST(COALESCE(t.ts, t.ts) AS timestamp))",
        "o": "ROUND((CAST(t.ts AS DATE) - to_date('1970-01-01','YYYY-MM-DD')) * 86400)", "v": "DATE(t.ts)::string", "y": "DATE_FORMAT(t.ts, 'yyyy')",
        "old": "t.ts < sysdate - 3",
    }
    return projection.with_pseudo(load(spark, sf, "events"), pseudo).filter("old").select("event_id", "d", "m", "s", "o", "v", "y")


@query("select strftime(ts, '%Y-%m') as \"month\", count(*) cnt from events group by 1")
def layout_discovery(spark, sf):
    """Partitions spelled by a date layout that is cut to the length of their text."""
    found = load(spark, sf, "events").agg(F.max("ts").cast("string").alias("t")).first()["t"][:7]
    layout = compare.layout_for("yyyy-MM-dd HH:mm:ss", found)
    return load(spark, sf, "events").groupBy(F.date_format("ts", layout).alias("month")).agg(F.count(F.lit(1)).alias("cnt"))


@query("select n_nationkey, n_regionkey src_n_regionkey, n_regionkey + 1 dst_n_regionkey from nation where n_nationkey % 5 = 2")
def partition_value_validation(spark, sf):
    src = load(spark, sf, "nation")
    dst = src.withColumn("n_regionkey", F.expr("cast(case when n_nationkey % 5 = 2 then n_regionkey + 1 else n_regionkey end as int)"))
    return quality.partition_values_agree(src, dst, ["n_nationkey", "n_regionkey"], ["n_nationkey"])


@query("select o_orderkey, true as truncated, o_totalprice = trunc(o_totalprice) as wide from orders")
def int_similarity(spark, sf):
    """An integer and a fraction: equal once truncated; in the wider type only if there is no fraction."""
    df = load(spark, sf, "orders").withColumn("whole", F.floor("o_totalprice"))
    a, b = F.col("whole"), F.col("o_totalprice")
    return df.select("o_orderkey", compare.similar(a, b, truncate=True).alias("truncated"), compare.similar(a.cast("double"), b).alias("wide"))


@query(f"{E_DST}, top as (select max(event_id) m from dst) select {EVENT} from dst union all select {EVENT} from events where event_id > (select m from top)")
def stream_new_ids(spark, sf):
    from deltaloom.streaming.incremental import sync_new_ids

    src, dst = events(spark, sf)
    table = SnapshotTable(spark, folder(spark, "stream"))
    table.commit(dst)
    feed = folder(spark, "feed")
    src.write.parquet(feed)
    sync_new_ids(spark, feed, src.schema, table, "event_id", folder(spark, "offsets")).awaitTermination(600)
    return table.read()


@query(f"{E_DST} select {EVENT} from events union all select {EVENT} from dst where event_id >= 1000000000")
def stream_upserts(spark, sf):
    from deltaloom.streaming.incremental import upsert_stream

    src, dst = events(spark, sf)
    table = SnapshotTable(spark, folder(spark, "stream"))
    table.commit(dst)
    feed = folder(spark, "feed")
    src.write.parquet(feed)
    stream = spark.readStream.schema(src.schema).parquet(feed)
    upsert_stream(stream, table, ["event_id"], folder(spark, "offsets")).awaitTermination(600)
    return table.read()


@query("""select 'n_nationkey' as name, 'int' as kind, 'default' as db union all select 'n_name', 'string', 'default' union all select 'n_regionkey', 'int', 'default'""")
def column_introspection(spark, sf):
    view = f"nation_{uuid.uuid4().hex[:8]}"
    load(spark, sf, "nation").createOrReplaceTempView(view)
    found = loaders.column_names(spark, view)
    spark.catalog.dropTempView(view)
    db = loaders.current_database(spark)
    return spark.createDataFrame([(n, k, db) for n, k in found], "name string, kind string, db string")


@query("select event_id, event_type, user_id from events")
def ndjson_source(spark, sf):
    made = Resource(path=folder(spark, "nd"), format="ndjson")
    loaders.save(load(spark, sf, "events").select("event_id", "event_type", "user_id"), made, writers=3)
    return loaders.load(spark, made).select("event_id", "event_type", "user_id")


@query("select event_id, nullif(user_id, 0) user_id, event_type from events")
def transfer_result(spark, sf):
    made = Resource(path=folder(spark, "copy"))
    source = Resource(path=folder(spark, "source"))
    loaders.save(load(spark, sf, "events").select("event_id", "user_id", "event_type"), source)
    task = Transfers(spark).run(source, made, writers=4, omit=True)
    if task.status != "done":
        raise RuntimeError(task.error)
    return loaders.load(spark, made).withColumn("event_id", F.coalesce("event_id", F.lit(0)))


@query("""select distinct 'db.events_ns_tmp_' || event_type || '_' || strftime(date_trunc('day', ts), '%Y%m%d%H%M%S') as name from events""")
def staging_names(spark, sf):
    found = load(spark, sf, "events").select("event_type", F.to_date("ts").alias("d")).distinct().collect()  # partitions
    at = lambda d: datetime(d.year, d.month, d.day)
    names = [(projection.staging_name("events", {"t": r["event_type"], "d": at(r["d"])}, "ns", "db"),) for r in found]
    return spark.createDataFrame(names, "name string")


@query("select count(*) n, 6 as columns from orders where false")
def empty_like_table(spark, sf):
    made = loaders.empty_like(load(spark, sf, "orders"))
    return made.agg(F.count(F.lit(1)).alias("n")).withColumn("columns", F.lit(len(made.columns)))


@query("select 'b' as id, 'insertOnDuplicateUpdate' as style, 512::bigint as batch, 2::bigint as retries, 'x' as criteria, true as async_")
def request_defaults(spark, sf):
    body = {"source": {"table": "a"}, "dest": {"table": "b", "driver": "mysql"}, "strategy": {"IDs": ["id"]}, "criteria": {"x": 1}, "async_": True}
    r = parse_request(json.dumps(body)).init()
    r.validate()
    row = (r.request_id(), r.strategy.merge_style, r.strategy.diff.batch_size, r.transfer.max_retries, ",".join(r.dest.criteria), r.async_)
    return spark.createDataFrame([row], "id string, style string, batch long, retries long, criteria string, async_ boolean")


@query("select 'b:c:d:e' as id, timestamp '2020-01-01 02:00:00' as at_next, timestamp '2020-01-01 01:41:00' as every_next, true as due")
def schedule_next(spark, sf):
    now = datetime(2020, 1, 1, 1, 31)
    at, every = Schedule(at=At(minute="0,30")), Schedule(Frequency(10, "minutes"))
    row = (schedule_id("file:///a/b/c/d/e.yaml"), at.following(now), every.following(now), every.is_due(now))
    return spark.createDataFrame([row], "id string, at_next timestamp_ntz, every_next timestamp_ntz, due boolean")


@query("select 'done' as job, 2::bigint as runs, 'ok' as status, count(*) transferred from orders where o_orderkey > 100")
def jobs_and_history(spark, sf):
    dst = load(spark, sf, "orders").filter("o_orderkey <= 100")
    target = SnapshotTable(spark, folder(spark, "dest"))
    target.commit(dst)
    body = {"id": "orders", "source": {"path": f"{sf}/orders.parquet"}, "dest": {"path": target.path}, "strategy": {"ids": ["o_orderkey"]}}
    engine = Engine(spark)
    for _ in range(2):
        engine.sync(parse_request(json.dumps(body)))
    status = engine.history.status(2)
    row = (engine.jobs.list(["orders"])[0].status, len(engine.history.show("orders")), status["status"], status["transferred"])
    return spark.createDataFrame([row], "job string, runs long, status string, transferred long")


@query("""with s as (select cast(min(ts) as date) a, cast(max(ts) as date) b from events), d as (select cast(ts as date) d from events)
select ((d.d - s.a) // 7)::bigint span, count(*) cnt from d, s group by 1""")
def spans_of_days(spark, sf):
    df = load(spark, sf, "events")
    first, last = df.agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first()
    spans = [(k, a, b) for k, (a, b) in enumerate(quality.days(first, last, 7))]  # a month of events has five
    held = spark.createDataFrame(spans or [(0, date.min, date.min)], "span long, a date, b date")
    return df.join(F.broadcast(held), F.to_date("ts").between(F.col("a"), F.col("b"))).groupBy("span").agg(F.count(F.lit(1)).alias("cnt"))


@query("select n_nationkey \"window\", upper(n_name) name from nation")
def reserved_and_upper_names(spark, sf):
    df = load(spark, sf, "nation").withColumnsRenamed({"n_nationkey": "window", "n_name": "NAME"}).select("window", "NAME")
    return projection.sync_projection(df, ["window"], ["name"], {"NAME": "upper(t.name)"}).withColumnRenamed("NAME", "name")


@query("""select count(*) cnt, count(o_orderkey) non_null_cnt_o_orderkey, max(o_orderkey) max_o_orderkey, min(o_orderkey) min_o_orderkey from orders""")
def signature_count_fast(spark, sf):
    """Counts and the range of ids from partial aggregates alone: no distinct count, no shuffle of ids."""
    df = load(spark, sf, "orders")
    return signature.signature(df, signature.plan_columns(df, ["o_orderkey"], count_only=True, exact=False))


@query("select event_type, count(*) cnt, round(sum(value::decimal(38,8))::double, 2) sum_value, true as hashed from events group by 1")
def signature_mergeable(spark, sf):
    df = load(spark, sf, "events")
    made = signature.signature(df, signature.plan_columns(df, ["event_id"], ["event_type"], exact=False), ["event_type"])
    return rounded(made, "sum_value").select("event_type", "cnt", "sum_value", F.col("hash_props").isNotNull().alias("hashed"))


@query(f"{O_DST} select count(*) cnt from (select {ORDER} from orders)")
def staged_slice_count(spark, sf):
    src, dst = orders(spark, sf)
    return unset(stage(synchronise(src, dst, ["o_orderkey"]).result, "whole").agg(F.count(F.lit(1)).alias("cnt")))
