"""Requests: sources, destinations and strategies, with defaults and validation."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, is_dataclass, replace
from typing import Any, get_type_hints

from deltaloom.operators.merge import MERGE_STYLES, UPSERTS
from deltaloom.plans.schedule import Schedule


@dataclass(frozen=True)
class Resource:
    """One side: a file path, a catalog table, a JDBC table or a query."""

    table: str = ""
    path: str = ""
    format: str = "parquet"
    from_: str = ""
    hint: str = ""
    driver: str = ""
    options: dict[str, str] = field(default_factory=dict)
    readers: int = 0  # connections of a JDBC read, dealt by ranges of ``split``
    split: str = ""
    push_down: bool = True  # signatures and slices of a JDBC source by its database; else it is read once, under the criteria
    criteria: dict[str, Any] = field(default_factory=dict)
    pseudo: dict[str, str] = field(default_factory=dict)
    partition_sql: str = ""
    chunk_sql: str = ""

    def validate(self, side: str) -> None:
        if not (self.table or self.path or self.from_):
            raise ValueError(f"{side}: a table, path or query is needed")
        for name, expression in self.pseudo.items():
            if "t." not in expression:
                raise ValueError(f"{side}: pseudo-column {name} must refer to the alias t.")


@dataclass(frozen=True)
class Diff:
    columns: list[dict[str, Any]] = field(default_factory=list)
    count_only: bool = False
    new_id_only: bool = False
    depth: int = 0
    batch_size: int = 512
    precision: int = 5
    date_format: str = "yyyy-MM-dd HH:mm:ss"
    hash: bool = False  # a sum of hashes of whole rows as well: sees swapped values and a null for a zero
    ranges: int = 0  # slices to merge are cut into 2 ** ranges id ranges, and only those that differ move
    exact: bool = False  # distinct counts, each with a shuffle, instead of sums of hashes


@dataclass(frozen=True)
class Partition:
    columns: list[str] = field(default_factory=list)
    provider_sql: str = ""
    check_values: bool = True  # refuse partitions whose texts spell the same value differently on the two sides
    threads: int = 2
    sync_mode: str = "batch"  # all slices in one commit; "individual": one commit each, tried three times


@dataclass(frozen=True)
class Chunk:
    size: int = 0
    threads: int = 0
    sync_mode: str = "batch"


@dataclass(frozen=True)
class Transfer:
    suffix: str = ""
    temp_database: str = ""
    max_retries: int = 2
    batch_size: int = 2048
    writers: int = 0  # files of a staged slice, or connections of a JDBC write; 0: as many as the plan has


@dataclass(frozen=True)
class Strategy:
    ids: list[str] = field(default_factory=list)
    columns: list[str] = field(default_factory=list)
    diff: Diff = field(default_factory=Diff)
    partition: Partition = field(default_factory=Partition)
    chunk: Chunk = field(default_factory=Chunk)
    append_only: bool = False
    append_update_only: bool = False
    direct_append: bool = False
    force: bool = False
    merge_style: str = ""


@dataclass(frozen=True)
class SyncRequest:
    source: Resource
    dest: Resource
    strategy: Strategy = field(default_factory=Strategy)
    transfer: Transfer = field(default_factory=Transfer)
    criteria: dict[str, Any] = field(default_factory=dict)
    schedule: Schedule | None = None
    id: str = ""
    async_: bool = False
    lock: bool = True
    dml_timeout: float = 0.0

    def request_id(self) -> str:
        return self.id or (self.dest.table or self.dest.path).rstrip("/").rsplit("/", 1)[-1]

    def init(self) -> SyncRequest:
        """With defaults: shared criteria on both sides, merge style by driver, chunk threads."""
        s = self.strategy
        if s.partition.provider_sql and not self.source.partition_sql:
            source = replace(self.source, partition_sql=s.partition.provider_sql)
        else:
            source = self.source
        chunk = replace(s.chunk, threads=s.chunk.threads or (2 if s.chunk.size else 0))
        style = s.merge_style or MERGE_STYLES.get(self.dest.driver, "merge")
        return replace(
            self,
            source=replace(source, criteria=source.criteria or self.criteria),
            dest=replace(self.dest, criteria=self.dest.criteria or self.criteria),
            strategy=replace(s, chunk=chunk, merge_style=style),
        )

    def validate(self) -> None:
        self.source.validate("source")
        self.dest.validate("destination")
        s = self.strategy
        if self.source.partition_sql and not s.partition.columns:
            raise ValueError("a partition query needs partition columns")
        if s.diff.count_only and s.diff.columns:
            raise ValueError("count-only and custom columns exclude each other")
        if s.chunk.size and len(s.ids) != 1:
            raise ValueError("chunks need exactly one id column")
        if s.partition.sync_mode not in ("individual", "batch") or s.chunk.sync_mode not in ("individual", "batch"):
            raise ValueError("a sync mode is individual or batch")
        if s.merge_style and s.merge_style not in UPSERTS:
            raise ValueError(f"a merge style is one of {', '.join(UPSERTS)}")
        if not 0 <= s.diff.ranges <= 24 or (s.diff.ranges and (s.diff.depth or len(s.ids) != 1)):
            raise ValueError("ranges are 0 to 24 levels of exactly one id column, and exclude depth")
        if self.source.chunk_sql and not s.chunk.size:
            raise ValueError("a chunk query needs a chunk size")
        if self.dest.chunk_sql:
            raise ValueError("chunks are those of the source: a destination has no chunk query")
        if s.diff.batch_size < 1 or self.transfer.batch_size < 1 or self.transfer.writers < 0:
            raise ValueError("batch sizes are positive, and writers not negative")
        if self.dest.path and (self.transfer.temp_database or self.transfer.suffix):
            raise ValueError("a temporary database and suffix name staging tables: not for a path")
        if self.source.readers > 1 and not self.source.split:
            raise ValueError("several readers need a column to split by")
        if self.schedule:
            self.schedule.validate()


@dataclass
class SyncResponse:
    id: str
    status: str
    error: str = ""
    source: int = 0
    dest: int = 0
    transferred: int = 0
    methods: dict[str, int] = field(default_factory=dict)

    def to_dict(self) -> dict:
        return asdict(self)


def build(kind: type, data: Any):
    """A dataclass from plain data; names match whatever their case and underscores."""
    if not is_dataclass(kind) or not isinstance(data, dict):
        return data
    plain = lambda s: s.replace("_", "").lower()
    known = {plain(f.name): f.name for f in fields(kind)}
    hints = get_type_hints(kind)
    out = {}
    for key, value in data.items():
        name = known.get(plain(key))
        if name is None:
            raise ValueError(f"{kind.__name__} has no setting {key!r}")
        hint = hints[name]
        inner = next((a for a in getattr(hint, "__args__", ()) if is_dataclass(a)), hint)
        out[name] = build(inner, value)
    return kind(**out)


def parse_request(text: str, kind: str = "json") -> SyncRequest:
    """A request from JSON or YAML text."""
    if kind in ("yaml", "yml"):
        try:
            import yaml
        except ImportError as missing:
            raise ValueError("YAML requests need the yaml package") from missing
        return build(SyncRequest, yaml.safe_load(text))
    return build(SyncRequest, json.loads(text))
