"""Sources in a database: signatures are computed there, and only slices that move leave it.

``Pushed`` answers two questions of a sync. *Signatures*: one query of counts, sums, extremes and distinct
counts, grouped by partition under the request's criteria, so that a row for each partition is all that is
transferred. *Slices*: the rows of partitions that move, by predicates of up to ``diff.batchSize`` keys,
each a partition of one JDBC read (``readers`` of them at a time), so that a database with an index or
partitions on those columns reads little more than it sends.

The queries are portable SQL; names and literals are quoted by Spark's dialect of the database.
Between the two the source may change. Rows are staged once, and the counts and extremes of what was staged are held
against the plan: a source that moved meanwhile is an error, and the sync is tried again.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltaloom.functions.criteria import Between, Days, GreaterOrEqual, GreaterThan, LessOrEqual, _RAW, _SAFE, _scalar, batches, in_values
from deltaloom.functions.types import FRACTION, LARGE, WHOLE, DiffColumn
from deltaloom.operators import diff
from deltaloom.sources.staging import stage

#: Queries of one page of a long list of slices.
PAGE = 64


class MovedError(RuntimeError):
    """The source changed while it was read."""


class Pushed:
    """A JDBC resource whose frame ``df`` (projected, not filtered) has the columns to compare and move."""

    def __init__(self, spark: SparkSession, resource, df: DataFrame, criteria: Mapping | None, batch: int = 512):
        self.spark, self.resource, self.criteria, self.batch = spark, resource, criteria or {}, max(1, batch)
        self.schema = df.schema
        self.types = {f.name.lower(): f.dataType for f in df.schema}
        self.names = {f.name.lower(): f.name for f in df.schema}
        self.dialect = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(resource.options["url"])
        inner = f"({resource.from_})" if resource.from_ else resource.table
        self.alone, self.refused = False, ""
        self.table = f"(SELECT {resource.hint} * FROM {inner} h)" if resource.hint else inner

    # --- text ---------------------------------------------------------------------------

    def quoted(self, name: str) -> str:
        return self.dialect.quoteIdentifier(self.names.get(name.lower(), name))

    def literal(self, value) -> str:
        if isinstance(value, bool):
            return "TRUE" if value else "FALSE"
        if isinstance(value, str):
            return str(self.dialect.compileValue(value))
        if isinstance(value, int | float):
            return repr(value)
        return f"CAST({self.dialect.compileValue(str(value))} AS {'TIMESTAMP' if hasattr(value, 'hour') else 'DATE' if hasattr(value, 'year') else 'DECIMAL(31,8)'})"

    def criterion(self, key: str, value) -> str:
        c = self.quoted(key)
        match value:
            case Between():
                return f"{c} BETWEEN {self.literal(value.low)} AND {self.literal(value.high)}"
            case Days():
                ends = [value.first, value.end]
                if not isinstance(self.types.get(key.lower()), T.DateType):
                    ends = [datetime(d.year, d.month, d.day) for d in ends]
                return f"{c} >= {self.literal(ends[0])} AND {c} < {self.literal(ends[1])}"
            case LessOrEqual():
                return f"{c} <= {self.literal(value.value)}"
            case GreaterThan():
                return f"{c} > {self.literal(value.value)}"
            case GreaterOrEqual():
                return f"{c} >= {self.literal(value.value)}"
            case None:
                return f"{c} IS NULL"
            case str() if _RAW.search(value):
                if not (m := _SAFE.match(value)):
                    raise ValueError(f"not a comparison with a literal: {value!r}")
                return f"{c} {m['op']} {m['value']}" if m["op"] else f"{c} IS {'NOT ' * bool(m['no'])}NULL"
            case list() | tuple() | set() | frozenset():
                some = [self.literal(v) for v in in_values(x for x in value if x is not None)]
                tests = ([f"{c} IN ({', '.join(some)})"] if some else []) + ([f"{c} IS NULL"] if None in value else [])
                return f"({' OR '.join(tests)})" if tests else "1 = 0"
            case _:
                return f"{c} = {self.literal(_scalar(value))}"

    def where(self, *more: str) -> str:
        parts = [*[self.criterion(k, self.criteria[k]) for k in sorted(self.criteria)], *more]
        return f" WHERE {' AND '.join(parts)}" if parts else ""

    def aggregate(self, c: DiffColumn) -> str:
        """The text of one aggregate, equal to what ``DiffColumn.column`` computes in Spark."""
        func, kind = c.func.upper(), self.types.get(c.name.lower())
        if c.name == "1":
            return "COUNT(*)"
        col = self.quoted(c.name)
        if c.label.startswith("non_null_cnt_"):
            return f"COUNT({col})"
        if isinstance(kind, FRACTION) and func == "SUM":
            return f"SUM(CASE WHEN ABS({col}) < {LARGE:.0f} THEN CAST({col} AS DECIMAL(31,8)) ELSE 0 END)"
        if func == "ODDS":
            return f"SUM(CASE WHEN {col} IS NULL OR ABS({col}) < {LARGE:.0f} THEN 0 ELSE 1 END)" if isinstance(kind, FRACTION) else "COUNT(*) - COUNT(*)"
        if c.default is not None and not isinstance(c.default, bytes):
            col = f"COALESCE({col}, {self.literal(c.default)})"
        if func == "COUNT":
            return f"COUNT(DISTINCT {col})"
        if func == "SUM" and isinstance(kind, WHOLE):
            return f"SUM(CAST({col} AS DECIMAL(31,0)))"
        return f"{func}({col})"

    def kind(self, c: DiffColumn) -> str | None:
        """The Spark type of an aggregate; None: as it comes."""
        func, kind = c.func.upper(), self.types.get(c.name.lower())
        if func in ("COUNT", "ODDS"):
            return "long"
        if func == "SUM":
            return "decimal(38,0)" if isinstance(kind, WHOLE) else "decimal(38,8)" if isinstance(kind, FRACTION) else None
        return kind.simpleString() if kind is not None else None

    # --- reads --------------------------------------------------------------------------

    def query(self, text: str) -> DataFrame:
        return self.spark.read.format("jdbc").options(**self.resource.options).option("query", text).load()

    def signature(self, columns: Sequence[DiffColumn], parts: Sequence[str], *more: str) -> DataFrame:
        """One row for each partition, aggregated by the database."""
        out = None
        for some in self.groups(columns):
            one = self._signature(some, parts, *more)
            if out is None:
                out = one
            elif not parts:
                out = out.withColumn("_one", F.lit(1)).join(one.withColumn("_one", F.lit(1)), "_one").drop("_one")
            else:
                one = one.withColumnsRenamed({p: f"_s_{p}" for p in parts})
                on = [F.col(f"`{p}`").eqNullSafe(F.col(f"_s_{p}")) for p in parts]
                out = out.join(one, on).drop(*[f"_s_{p}" for p in parts])
        return out.select(*[F.col(f"`{p}`") for p in parts], *[F.col(f"`{c.label}`") for c in columns])

    def _signature(self, columns: Sequence[DiffColumn], parts: Sequence[str], *more: str) -> DataFrame:
        keys = [self.quoted(p) for p in parts]
        made = [f"{self.aggregate(c)} AS {self.dialect.quoteIdentifier(c.label)}" for c in columns]
        text = f"SELECT {', '.join([*keys, *made])} FROM {self.table} t{self.where(*more)}"
        out = self.query(text + (f" GROUP BY {', '.join(keys)}" if keys else ""))
        kinds = {c.label: self.kind(c) for c in columns}
        return out.select(
            *[F.col(f"`{self.names.get(p.lower(), p)}`").alias(p) for p in parts],
            *[F.col(f"`{n}`").cast(k).alias(n) if k else F.col(f"`{n}`") for n, k in kinds.items()],
        )

    def groups(self, columns: Sequence[DiffColumn]) -> list[list[DiffColumn]]:
        """The columns of one query each: all, or with one distinct count to a query where the database takes no more."""
        if not self.alone:
            return [list(columns)]
        distinct = [c for c in columns if self.aggregate(c).startswith("COUNT(DISTINCT")]
        rest = [c for c in columns if c not in distinct]
        return [rest + distinct[:1], *[[c] for c in distinct[1:]]]

    def works(self, columns: Sequence[DiffColumn], parts: Sequence[str]) -> bool:
        """Whether the database takes these aggregates, in one query or several (asked without reading rows)."""
        for self.alone in (False, True):
            try:
                for some in self.groups(columns):
                    self._signature(some, parts, "1 = 0")  # the driver prepares the query for its columns
                return True
            except Exception as error:  # noqa: BLE001 - another vendor's limits
                self.refused = str(error)[:300]
        return False

    def predicates(self, slices: DataFrame, parts: Sequence[str], beyond: str, compare: str, id_: str | None) -> Iterator[str]:
        """Predicates of up to ``batch`` slices (parts, ``beyond``): by key lists; those with an id bound, and keys of several
        columns, one by one, joined by OR. Rows come page by page, so any number of slices will do."""
        held: list[str] = []
        plain: list[dict] = []
        for r in slices.select(*[F.col(f"`{p}`") for p in parts], F.col(beyond).alias("_beyond")).toLocalIterator(prefetchPartitions=True):
            if len(parts) == 1 and r["_beyond"] is None:
                plain.append({parts[0]: r[parts[0]]})
            else:
                tests = [self.criterion_exact(p, r[p]) for p in parts]
                tests += [f"{self.quoted(id_)} {compare} {self.literal(r['_beyond'])}"] if r["_beyond"] is not None else []
                held.append(f"({' AND '.join(tests)})" if tests else "1 = 1")
            if len(plain) == self.batch:
                yield from (self.criterion_list(k, v) for b in batches(plain, self.batch) for k, v in b.items())
                plain = []
            if len(held) == self.batch:
                yield f"({' OR '.join(held)})"
                held = []
        yield from (self.criterion_list(k, v) for b in batches(plain, self.batch) for k, v in b.items())
        if held:
            yield f"({' OR '.join(held)})"

    def criterion_exact(self, key: str, value) -> str:
        """Equality with a value that is no text to interpret."""
        return f"{self.quoted(key)} IS NULL" if value is None else f"{self.quoted(key)} = {self.literal(value)}"

    def criterion_list(self, key: str, values: list) -> str:
        some = [self.literal(v) for v in values if v is not None]
        tests = ([f"{self.quoted(key)} IN ({', '.join(some)})"] if some else []) + ([f"{self.quoted(key)} IS NULL"] if None in values else [])
        return f"({' OR '.join(tests)})"

    def below(self, tail: DataFrame, id_: str, columns: Sequence[DiffColumn], parts: Sequence[str]) -> DataFrame:
        """Signatures of the rows up to ``_top`` of each slice of ``tail`` (parts, _top), some queries a page."""
        pages, page = [], []
        for p in self.predicates(tail, parts, "_top", "<=", id_):
            page.append(self.signature(columns, parts, p))
            if len(page) == PAGE:
                pages, page = [*pages, stage(_union(page), "below")], []
        return _union([*pages, *page])

    def rows(self, moving: DataFrame, parts: Sequence[str], id_: str | None = None) -> DataFrame:
        """The rows of the plan's slices ``moving`` (parts, in_sync_id), or of some more."""
        found = list(self.predicates(moving, parts, "in_sync_id", ">", id_))
        cols = ", ".join(self.quoted(f.name) for f in self.schema)
        if not found:
            return self.spark.createDataFrame([], self.schema)
        what = f"(SELECT {cols} FROM {self.table} t{self.where()}) q"
        options = {k: v for k, v in self.resource.options.items() if k.lower() != "url"}
        df = self.spark.read.jdbc(self.resource.options["url"], what, predicates=found, properties=options)
        return df.coalesce(self.resource.readers) if self.resource.readers else df


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def check_staged(staged: DataFrame, plan: DataFrame, id_: str | None) -> None:
    """Raises if the slices that moved do not have the rows that the plan counted (and the extremes of a single id)."""
    expect = plan.filter(F.col("in_sync_id").isNull()).agg(F.sum("src_cnt").alias("n"), F.min("src_min").alias("a"), F.max("src_max").alias("b")).first()
    if plan.filter(F.col("in_sync_id").isNotNull()).take(1):
        return  # tails are counted with what lies below them
    made = [F.count(F.lit(1)).alias("n")] + ([F.min(id_).alias("a"), F.max(id_).alias("b")] if id_ else [])
    found = staged.agg(*made).first()
    if (expect["n"] or 0) != found["n"] or (id_ and (expect["a"], expect["b"]) != (found["a"], found["b"])):
        raise MovedError(f"the source changed while it was read: {expect['n']} rows planned, {found['n']} read")
