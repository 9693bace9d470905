"""A whole synchronisation: compare, narrow, move what differs, apply, commit."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from datetime import date
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.contract import SyncRequest, SyncResponse
from deltaloom.functions.compare import fitted
from deltaloom.functions.criteria import Days, conjunction
from deltaloom.functions.types import DiffColumn
from deltaloom.operators import chunking, diff, merge, narrow
from deltaloom.operators.projection import explicit, sync_projection, with_pseudo
from deltaloom.operators.ranges import RANGE, refined
from deltaloom.operators.signature import id_consistency, single
from deltaloom.plans.control import History, Jobs
from deltaloom.plans.journal import Journal, key_of
from deltaloom.plans.quality import over_dates
from deltaloom.sources.jdbc import Pushed, check_staged
from deltaloom.sources.lease import leased
from deltaloom.sources.loaders import load, moving, partition_values, write_change
from deltaloom.sources.staging import stage
from deltaloom.sources.store import SnapshotTable

MOVING = (diff.INSERT, diff.MERGE, diff.DELETE_MERGE, diff.DELETE_INSERT)


@dataclass
class Change:
    """What a sync does to its destination: rows whose keys are in one of ``drops`` go, ``add`` comes.

    ``whole`` replaces the destination instead, where the rows that go cannot be named by its columns.
    """

    drops: list[DataFrame] = field(default_factory=list)
    add: DataFrame | None = None
    whole: DataFrame | None = None

    def result(self, dst: DataFrame) -> DataFrame:
        if self.whole is not None:
            return self.whole
        for keys in self.drops:
            dst = merge.without(dst, keys)
        return dst if self.add is None else merge.append(dst, self.add)


@dataclass
class SyncResult:
    """The new destination, the plan behind it, what it moves and what it changes; source and dest count
    the rows of each side in the slices that move."""

    result: DataFrame
    plan: DataFrame
    moved: DataFrame
    change: Change
    in_sync: bool
    source: int = 0
    dest: int = 0
    methods: dict[str, int] = field(default_factory=dict)


def check_ids(df: DataFrame, ids: Sequence[str], side: str) -> None:
    """Raises if the single id has nulls or duplicates."""
    if len(ids) == 1:
        problem = single(id_consistency(df, ids[0]))["problem"]
        if problem:
            raise ValueError(f"{side}: the id column {ids[0]} has {problem} values")


def _on(parts: Sequence[str], prefix: str) -> list[Column]:
    return [F.col(f"`{p}`").eqNullSafe(F.col(f"{prefix}{p}")) for p in parts]


def _plan_join(df: DataFrame, plan: DataFrame, parts: Sequence[str], small: bool, *cols: str) -> DataFrame:
    """``df`` with columns of its partition's plan row; the plan is broadcast if it is small."""
    p = plan.select(*[F.col(f"`{k}`").alias(f"_p_{k}") for k in parts], *cols)
    if not parts:
        p = p.withColumn("_p_all", F.lit(1))
        df = df.withColumn("_all", F.lit(1))
        return df.join(p, F.col("_all") == F.col("_p_all")).drop("_all", "_p_all")
    return df.join(F.broadcast(p) if small else p, _on(parts, "_p_")).drop(*[f"_p_{k}" for k in parts])


def synchronise(
    src: DataFrame,
    dst: DataFrame,
    ids: Sequence[str] = (),
    parts: Sequence[str] = (),
    *,
    columns: Sequence[DiffColumn] | None = None,
    count_only: bool = False,
    precision: int = 5,
    date_format: str | None = None,
    depth: int = 0,
    new_id_only: bool = False,
    chunk_size: int = 0,
    append_only: bool = False,
    append_update_only: bool = False,
    force: bool = False,
    check: bool = True,
    exact: bool = False,
    hashed: bool = False,
    ranges: int = 0,
    bounds: DataFrame | None = None,
    stored: Sequence[str] | None = None,
    writers: int = 0,
    pushed=None,
    spelling: bool = True,
) -> SyncResult:
    """The destination after a sync of ``src`` into it, as a plan to be written and as a change.

    Slices are partitions, or chunks within them, compared by signature in one pass over each
    side. Only slices out of sync are read again, and only their ids are checked; for an appended
    tail only the rows beyond the destination's greatest id, for slices to merge those beyond the
    id found by ``depth`` probes of all of them at once, or, with ``ranges``, those of the 2 ** ranges id
    ranges of each that differ. A slice that the source lacks goes, whether it is a partition, a chunk
    or the table. ``bounds`` are chunks that were planned before. ``pushed`` answers signatures and slices of the
    source in its own database. Destination columns that the source lacks
    are not compared and keep their values. ``stored`` names the destination's own columns, if
    ``dst`` has others (pseudo-columns). Partitions that the two sides spell differently (``2020-1-5`` and
    ``2020-01-05``) are an error unless ``spelling`` is off. All slices are applied in one change, so a commit is atomic.
    """
    parts, ids = list(parts), list(ids)
    own = [c for c in dst.columns if stored is None or c in stored]
    lower = {c.lower() for c in src.columns}
    shared = [c for c in dst.columns if c.lower() in lower or c in parts]
    a, b, slices = src, dst, parts
    if force:
        total = stage(
            src.agg(F.count(F.lit(1)).alias("src_cnt")).select(
                F.lit(diff.INSERT if append_only else diff.DELETE_MERGE if ids else diff.DELETE_INSERT).alias("method"),
                "src_cnt",
                F.lit(0).cast("long").alias("dst_cnt"),
                F.lit(None).cast("long").alias("in_sync_id"),
            ),
            "plan",
        )
        plan, slices = total, []
    elif new_id_only:
        if len(ids) != 1:
            raise ValueError("new ids need exactly one id column")
        fresh = stage(narrow.new_ids(src, dst, ids[0], parts), "fresh")
        sig = fresh.groupBy(*parts).agg(F.count(F.lit(1)).alias("src_cnt")) if parts else fresh.agg(
            F.count(F.lit(1)).alias("src_cnt")
        )
        plan = stage(
            sig.select(
                *parts, F.when(F.col("src_cnt") > 0, diff.INSERT).otherwise(diff.IN_SYNC).alias("method"), "src_cnt",
                F.lit(0).cast("long").alias("dst_cnt"), F.lit(None).cast("long").alias("in_sync_id"),
            ),
            "plan",
        )
        a = fresh
    else:
        if chunk_size:
            if len(ids) != 1:
                raise ValueError("chunks need exactly one id column")
            bounds = chunking.sketched(src, ids[0], chunk_size) if bounds is None else bounds
            a, b = (chunking.assign(x, bounds, ids[0], "_chunk_no") for x in (src, dst))
            slices = [*parts, "_chunk_no"]
        compared = b.select(*shared, *[c for c in slices if c not in shared])
        rule = (columns, count_only, precision, date_format)
        if chunk_size and append_only:
            plan = stage(diff.fast_diff(a, compared, ids, slices, *rule, exact=exact, hashed=hashed), "plan")
        else:
            plan = stage(diff.diff(a, compared, ids, slices, *rule, exact=exact, hashed=hashed, pushed=pushed), "plan")
        if pushed is not None:
            a = pushed.rows(plan.filter(F.col("method").isin(*MOVING)), slices, ids[0] if len(ids) == 1 else None)
        if ranges and len(ids) == 1 and not chunk_size:
            plan, a, b = refined(plan, a, b, ids[0], slices, rule, ranges, exact, hashed)
            slices = [*slices, RANGE]
        elif depth and len(ids) == 1:
            keep = diff.compared_columns(a, compared, ids, slices, *rule, exact)
            plan = _narrowed(plan, a, compared, ids[0], slices, keep, depth)
    by_method = plan.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.sum("src_cnt").alias("s"), F.sum("dst_cnt").alias("d")).collect()
    methods = {r["method"]: r["n"] for r in by_method}
    small = sum(methods.values()) <= diff.SMALL_PLAN
    if spelling and slices == parts and {diff.INSERT, diff.REMOVED} <= set(methods):
        if bad := diff.misspelt(plan, parts).limit(3).collect():
            raise ValueError(f"partition values that the sides spell differently: {'; '.join(map(str, bad))}")
    moving = plan.filter(F.col("method").isin(*MOVING))
    moved = _plan_join(a, moving, slices, small, "method", "in_sync_id")
    if len(ids) == 1:
        moved = moved.filter(F.col("in_sync_id").isNull() | (F.col(ids[0]) > F.col("in_sync_id")))
    names = {n.lower() for n in own}
    moved = moved.select(*[c for c in moved.columns if c.lower() in names], "method")
    staged = stage(_fitted(moved, dst.select(*own).schema), "moved", writers)
    if pushed is not None:
        check_staged(staged, moving, ids[0] if len(ids) == 1 else None)
    if check and not force and set(methods) - {diff.IN_SYNC, diff.REMOVED}:
        check_ids(staged, ids, "source")
        if not new_id_only:  # ids beyond the destination's greatest cannot repeat one of it
            check_ids(_plan_join(b, moving, slices, small, "method").select(*b.columns), ids, "destination")
    gone = plan.filter(F.col("method").isin(*diff.DELETES, diff.REMOVED))
    if append_update_only or (force and append_only) or not set(methods) & {*diff.DELETES, diff.REMOVED}:
        gone = None
    change = _change(staged, dst, b, gone, slices, ids, own, append_only, append_update_only, small)
    return SyncResult(
        change.result(dst.select(*own)), plan, staged, change, not (set(methods) - {diff.IN_SYNC}), methods=methods,
        source=sum(r["s"] or 0 for r in by_method if r["method"] in MOVING),
        dest=sum(r["d"] or 0 for r in by_method if r["method"] in MOVING),
    )


def _fitted(moved: DataFrame, schema) -> DataFrame:
    """``moved`` in the destination's types, and its method; a value that does not fit is an error."""
    have = {f.name.lower(): f for f in moved.schema}
    return moved.select(*[fitted(have[f.name.lower()], f).alias(f.name) for f in schema if f.name.lower() in have], "method")


def _narrowed(plan, a, b, id_, slices, columns, depth) -> DataFrame:
    """The plan with a later start for its slices to merge: one bisection of them all."""
    merges = plan.filter((F.col("method") == diff.MERGE) & F.col("src_min").isNotNull() & F.col("dst_max").isNotNull())
    spans = diff.span(merges).select(*[F.col(f"`{p}`") for p in slices], "low", "high")
    if not spans.take(1):
        return plan
    found = narrow.bisect(a, b, id_, columns, stage(spans, "spans"), slices, depth).filter(F.col("at").isNotNull())
    found = stage(found, "found").withColumnsRenamed({p: f"_n_{p}" for p in slices}).withColumnRenamed("at", "_at")
    keys = [f"_n_{p}" for p in slices]

    def beyond(df: DataFrame, name: str) -> DataFrame:
        on = _on(slices, "_n_") if slices else F.lit(True)
        rows = df.select(id_, *[c for c in slices if c != id_]).join(F.broadcast(found) if not slices else found, on)
        rows = rows.filter(F.col(id_) > F.col("_at"))
        made = F.count(F.lit(1)).alias(name)
        return rows.groupBy(*keys).agg(made) if slices else rows.agg(made)

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        if not slices:
            return left.withColumn("_one", F.lit(1)).join(right.withColumn("_one", F.lit(1)), "_one", "left").drop("_one")
        right = right.withColumnsRenamed({k: f"_r{k}" for k in keys})
        on = [F.col(f"`{p}`").eqNullSafe(F.col(f"_r_n_{p}")) for p in slices]
        return left.join(right, on, "left").drop(*[f"_r{k}" for k in keys])

    out = joined(joined(joined(plan, found), beyond(a, "_s")), beyond(b, "_d"))
    late = F.col("_at").isNotNull()
    return stage(
        out.withColumns(
            {
                "in_sync_id": F.coalesce("_at", "in_sync_id"),
                "src_cnt": F.when(late, F.coalesce("_s", F.lit(0))).otherwise(F.col("src_cnt")),
                "dst_cnt": F.when(late, F.coalesce("_d", F.lit(0))).otherwise(F.col("dst_cnt")),
            }
        ).select(*plan.columns),
        "plan",
    )


def _change(staged, dst, sliced, gone, slices, ids, own, append_only, append_update_only, small) -> Change:
    """The rows that go and those that come. Rows with an id go by it, others by their slice."""
    cols = [c for c in staged.columns if c != "method"]
    if not ids:
        add = staged.select(*cols)
        if gone is None or append_update_only:
            return Change(add=add)
        if slices and set(slices) <= set(own):
            return Change([stage(gone.select(*slices), "gone")], add)
        kept = merge.without(sliced, stage(gone.select(*slices), "gone")) if slices else sliced.limit(0)
        return Change(whole=merge.append(kept.select(*own), add))
    extra = [c for c in own if c not in cols]

    def complete(t: DataFrame) -> DataFrame:
        """With the destination's values of the columns that the source lacks."""
        return t.join(dst.select(*ids, *extra), ids, "left").select(*own) if extra else t

    if append_update_only:
        add = merge.dedupe_max(staged.select(*cols), ids)
        return Change([staged.select(*ids)], complete(add))
    drops, kept = [], dst
    if gone is not None:
        inside = _plan_join(sliced, gone, slices, small, "method") if slices else sliced
        old = inside.select(*ids)
        if append_only:  # rows whose ids are staged stay as they are
            old = merge.without(old, staged.select(*ids))
        drops.append(stage(old, "gone"))
        kept = merge.without(dst, drops[0])
    if append_only:
        return Change(drops, merge.transient_delete(merge.dedupe_max(staged.select(*cols), ids), kept, ids))
    new = staged.filter(F.col("method") == diff.INSERT).select(*cols)
    rest = staged.filter(F.col("method") != diff.INSERT).select(*cols)
    drops.append(rest.select(*ids))
    fresh = merge.transient_delete(merge.dedupe_max(new, ids), merge.without(kept, drops[-1]), ids)
    add = complete(merge.dedupe_max(rest, ids)).unionByName(fresh, allowMissingColumns=True)
    return Change(drops, add)


@contextmanager
def deadline(spark: SparkSession, seconds: float) -> Iterator[None]:
    """Cancels the jobs started inside after ``seconds`` (0: never)."""
    if not seconds:
        yield
        return
    tag = f"deltaloom-{uuid.uuid4().hex}"
    spark.addTag(tag)
    timer = threading.Timer(seconds, lambda: spark.interruptTag(tag))
    timer.start()
    try:
        yield
    finally:
        timer.cancel()
        spark.removeTag(tag)


class Engine:
    """Runs requests: one running job for each id, asynchronously if asked; keeps a history."""

    TRIES, PAUSE_S, LOCK_WAIT_S = 3, 1.0, 3600.0

    def __init__(self, spark: SparkSession, history: int = 10, threads: int = 4, leases: str | None = None, lease_s: float = 60.0):
        """``leases`` is a folder that several drivers share (``spark.checkpoint.dir`` if it is set): a job's id and a
        destination are then held by one of them at a time."""
        self.leases, self.lease_s = leases or spark.sparkContext.getConf().get("spark.checkpoint.dir"), lease_s
        self.spark, self.jobs, self.history = spark, Jobs(), History(history)
        self.pool = ThreadPoolExecutor(threads)
        self.locks = Locks()
        self.running: dict[str, Future] = {}

    def sync(self, request: SyncRequest) -> SyncResponse:
        request = request.init()
        request.validate()
        job = self.jobs.start(request.request_id())
        if request.async_:
            for k in [k for k, f in self.running.items() if f.done() and k != job.id]:
                del self.running[k]
            self.running[job.id] = self.pool.submit(self._run, request, job)
            return SyncResponse(job.id, "running")
        return self._run(request, job)

    def _run(self, request: SyncRequest, job) -> SyncResponse:
        response = SyncResponse(job.id, "ok")
        try:
            with leased(self.spark, self.leases, f"job {job.id}", ttl_s=self.lease_s):
                self._tried(lambda: self._once(request, response), request.transfer.max_retries + 1)
        except Exception as error:  # noqa: BLE001 - reported to the caller
            response.status, response.error = "error", str(error)
        finally:
            self.jobs.finish(job, response)
            self.history.add(job, response)
        return response

    def _tried(self, once, tries: int):
        """``once()``, again after a pause if it fails; requests that are wrong fail at once."""
        for k in range(max(1, tries)):
            try:
                return once()
            except ValueError:
                raise
            except Exception:
                if k + 1 >= tries:
                    raise
                time.sleep(self.PAUSE_S)

    def _once(self, request: SyncRequest, response: SyncResponse) -> None:
        if request.lock:
            name = request.dest.path or request.dest.table
            with self.locks.held(name), leased(self.spark, self.leases, f"table {name}", self.LOCK_WAIT_S, self.lease_s):
                self._locked(request, response)
        else:
            self._locked(request, response)

    def _locked(self, request: SyncRequest, response: SyncResponse) -> None:
        s = request.strategy
        sides = Sides(self.spark, request)
        parts = s.partition.columns
        if parts and not s.force and not sides.src.select(*parts).limit(1).count() and not sides.dst.select(*parts).limit(1).count():
            raise ValueError("no partition on either side")
        response.source = response.dest = response.transferred = 0
        response.methods = {}
        one_by_one = s.partition.sync_mode == "individual" and parts or s.chunk.sync_mode == "individual" and s.chunk.size
        if not one_by_one or s.force:
            self._slice(request, sides, response, None)
            return
        journal = Journal(self.spark, key_of(request))
        if not journal.exists():
            journal.write(self._slices(request, sides))
        for number, row in journal.remaining():
            where = self._where(request, row)
            self._tried(lambda where=where: self._slice(request, Sides(self.spark, request, pinned=sides.pinned), response, where), self.TRIES)
            journal.mark(number)
        journal.close()

    def _slices(self, request: SyncRequest, sides: Sides) -> DataFrame:
        """The slices out of sync, as they are now: partitions, or chunks (with their bounds) if asked for one by one."""
        s = request.strategy
        parts, a, b = list(s.partition.columns), sides.src, sides.dst
        bounds = None
        if s.chunk.size and s.chunk.sync_mode == "individual":
            bounds = chunking.sketched(a, s.ids[0], s.chunk.size)
            a, b = (chunking.assign(x, bounds, s.ids[0], "_chunk_no") for x in (a, b))
            parts = [*parts, "_chunk_no"]
        shared = [c for c in b.columns if c.lower() in {x.lower() for x in a.columns} or c in parts]
        rule = (custom(s.diff), s.diff.count_only, s.diff.precision, s.diff.date_format)
        plan = diff.diff(a, b.select(*shared), s.ids, parts, *rule, exact=s.diff.exact, hashed=s.diff.hash)
        out = plan.filter(F.col("method") != diff.IN_SYNC).select(*[F.col(f"`{p}`") for p in parts])
        if bounds is None:
            return out
        ranges = chunking.with_ranges(bounds).select(F.col("chunk").alias("_of"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
        return out.join(ranges, F.col("_chunk_no") == F.col("_of"), "left").drop("_of")

    @staticmethod
    def _where(request: SyncRequest, row) -> Column:
        """The predicate of a slice of the journal."""
        held = row.asDict()
        where = [F.col(f"`{p}`").eqNullSafe(F.lit(held[p])) for p in request.strategy.partition.columns]
        if "_chunk_no" in held:
            low, high = held["_lo"], held["_hi"]
            where.append(chunking.id_filter(request.strategy.ids[0], None if held["_chunk_no"] == 0 else low, None if high is None else high - 1))
        return reduce(and_, where, F.lit(True))

    def _slice(self, request: SyncRequest, sides: Sides, response: SyncResponse, where: Column | None) -> None:
        """Syncs all rows, or those under ``where``, and commits once."""
        s = request.strategy
        src, dst, only = sides.src, sides.dst, sides.where
        bounds = None
        if s.chunk.size and request.source.chunk_sql:
            low = src.agg(F.min(s.ids[0])).first()[0]
            bounds = chunking.by_query(self.spark, request.source.chunk_sql, s.ids[0], s.chunk.size, low)
        if where is not None:
            src, dst = src.filter(where), dst.filter(where)
            only = where if only is None else where & only
        made = synchronise(
            src, dst, s.ids, s.partition.columns,
            columns=custom(s.diff), count_only=s.diff.count_only, precision=s.diff.precision, date_format=s.diff.date_format,
            depth=s.diff.depth, new_id_only=s.diff.new_id_only, chunk_size=s.chunk.size, append_only=s.append_only,
            append_update_only=s.append_update_only, force=s.force, exact=s.diff.exact, hashed=s.diff.hash, ranges=s.diff.ranges, bounds=bounds,
            stored=sides.stored, writers=request.transfer.writers, pushed=sides.pushed if where is None else None,
            spelling=s.partition.check_values,
        )
        response.source += made.source
        response.dest += made.dest
        for k, n in made.methods.items():
            response.methods[k] = response.methods.get(k, 0) + n
        response.transferred += made.moved.count()
        if made.in_sync:
            return
        change = made.change
        if s.direct_append and set(made.methods) <= {diff.IN_SYNC, diff.INSERT}:
            change = Change(add=made.moved.drop("method"))  # no deduplication, no look at ids
        if change.whole is not None and (only is not None or sides.others is not None):
            rest = sides.whole if sides.others is None else sides.others
            if only is not None:  # rows outside the criteria are not the sync's to touch
                rest = sides.whole.filter(~F.coalesce(only, F.lit(False)))
            change = Change(whole=change.whole.unionByName(rest.select(*change.whole.columns)))
        elif only is not None and not s.ids and change.drops:
            # slices are dropped only as far as the criteria go
            inside = sides.whole.filter(F.coalesce(only, F.lit(False)))
            rest = sides.whole.filter(~F.coalesce(only, F.lit(False)))
            change = Change(whole=change.result(inside.select(*sides.stored)).unionByName(rest.select(*sides.stored)))
        with deadline(self.spark, request.dml_timeout):
            sides.write(change, request)

    def sync_days(self, request: SyncRequest, column: str, first: date, last: date, step: int = 1) -> list[SyncResponse]:
        """Syncs spans of ``step`` days of ``column`` one after another, each a job and a commit of its own, up to the
        first that fails. Rows of other days stay as they are; spans that were done before are in sync when it is run again.
        """
        request = replace(request.init(), async_=False)
        if column in request.source.criteria or column in request.dest.criteria:
            raise ValueError(f"{column} has a criterion of its own")

        def of(a: date, b: date) -> SyncRequest:
            sides = [replace(r, criteria=r.criteria | {column: Days(a, b)}) for r in (request.source, request.dest)]
            return clone(request, source=sides[0], dest=sides[1], id=f"{request.request_id()}:{a}:{b}")

        return over_dates(self.sync, of, first, last, step)

    def wait(self, job_id: str) -> SyncResponse:
        return self.running.pop(job_id).result()


def custom(settings) -> list[DiffColumn] | None:
    """The request's own signature columns."""
    return [
        DiffColumn(c["func"], c["name"], c.get("alias", ""), c.get("default"), settings.precision, settings.date_format)
        for c in settings.columns
    ] or None


class Locks:
    """A lock for each name, forgotten when nobody holds or awaits it."""

    def __init__(self):
        self._guard, self._held = threading.Lock(), {}

    @contextmanager
    def held(self, name: str) -> Iterator[None]:
        with self._guard:
            lock, users = self._held.get(name, (threading.Lock(), 0))
            self._held[name] = (lock, users + 1)
        try:
            with lock:
                yield
        finally:
            with self._guard:
                lock, users = self._held[name]
                if users > 1:
                    self._held[name] = (lock, users - 1)
                else:
                    del self._held[name]


class Sides:
    """Both sides of a request as they are now: filtered, with pseudo-columns, and how to write back.

    The database of a JDBC source computes signatures and sends only slices that move (``pushed``), or only
    ids beyond the destination's. Where a request needs more of it (pseudo-columns, chunks, narrowing, partitions
    by query, slices one by one), and for plug-ins, the source is read once, under the criteria and with the columns
    asked for, and pinned: signatures, checks and rows then agree. Files and their queries are listed when
    the frame is made.
    """

    def __init__(self, spark: SparkSession, request: SyncRequest, pinned: DataFrame | None = None):
        s, dest = request.strategy, request.dest
        self.table = SnapshotTable(spark, dest.path) if dest.path else None
        self.version = self.table.version() if self.table else None
        self.whole = self.table.read(self.version) if self.table and self.version is not None else load(spark, dest)
        self.stored = self.whole.columns
        whole = load(spark, request.source) if pinned is None else pinned
        self.src, _ = self._asked(whole, request.source)
        self.dst, self.where = self._asked(self.whole, dest)
        self.others = self.pushed = None
        if s.columns:
            names = explicit(self.dst, [*s.columns, *s.ids, *s.partition.columns])
            self.src = sync_projection(self.src, s.ids, [n for n in names if n.lower() in {c.lower() for c in self.src.columns}])
        if pinned is None and moving(request.source):
            if self._pushable(request):
                self.pushed = self._pushed(request, whole)
            if self.pushed is None and not (s.diff.new_id_only and not s.partition.columns):
                self.src = stage(self.src, "source")
        self.pinned = self.src if moving(request.source) else None
        if request.source.partition_sql:
            asked = stage(partition_values(spark, request.source, self.src, s.partition.columns), "asked")
            if dest.partition_sql:
                own = partition_values(spark, dest, self.dst, s.partition.columns)
                asked = stage(asked.union(own).distinct(), "asked")
            self.src = self.src.join(asked, s.partition.columns, "left_semi").select(*self.src.columns)
            self.others = self.dst.join(asked, s.partition.columns, "left_anti").select(*self.stored)
            self.dst = self.dst.join(asked, s.partition.columns, "left_semi").select(*self.dst.columns)

    @staticmethod
    def _asked(df: DataFrame, resource) -> tuple[DataFrame, Column | None]:
        """With its pseudo-columns, under its criteria; and those."""
        df = with_pseudo(df, {k: e for k, e in resource.pseudo.items() if k not in df.columns})
        where = conjunction(resource.criteria)
        return (df.filter(where) if where is not None else df), where

    def _pushed(self, request: SyncRequest, whole: DataFrame) -> Pushed | None:
        """None if the database cannot compute the signature."""
        s, source = request.strategy, request.source
        held = Pushed(self.table.spark if self.table else whole.sparkSession, source, whole.select(*self.src.columns), source.criteria, s.diff.batch_size)
        lower = {c.lower() for c in self.src.columns}
        compared = self.dst.select(*[c for c in self.dst.columns if c.lower() in lower])
        rule = (custom(s.diff), s.diff.count_only, s.diff.precision, s.diff.date_format)
        cols = diff.pushed_columns(self.src, compared, s.ids, s.partition.columns, *rule)
        return held if held.works(cols, s.partition.columns) else None

    @staticmethod
    def _pushable(request: SyncRequest) -> bool:
        s, source = request.strategy, request.source
        plain = source.format == "jdbc" and source.push_down and not (source.pseudo or source.partition_sql)
        return plain and not (
            s.force or s.diff.depth or s.diff.ranges or s.diff.hash or s.diff.new_id_only or s.chunk.size or s.partition.sync_mode == "individual"
        )

    def write(self, change: Change, request: SyncRequest) -> None:
        """Commits a change: a snapshot's files, a transaction of a JDBC table, or a catalog table."""
        if self.table:
            if self.version is None or change.whole is not None:
                self.table.commit(change.result(self.whole), expect=self.version, keys=request.strategy.ids)
            else:
                self.table.change(change.drops, change.add, self.version)
        else:
            write_change(self.whole, change, request.dest, request.transfer)


def clone(request: SyncRequest, **changes) -> SyncRequest:
    """A request with changes; every setting is carried over."""
    return replace(request, **changes)
