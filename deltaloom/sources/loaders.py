"""Readers and writers for each kind of side."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.operators.projection import staging_name
from deltaloom.sources.staging import stage

FILES = ("parquet", "orc", "json", "ndjson", "csv", "text", "xml")
#: Loaders of further kinds (their connectors are the user's to supply), by format.
PLUGINS: dict[str, Callable] = {}


def register(kind: str, loader: Callable) -> None:
    PLUGINS[kind] = loader


def moving(resource) -> bool:
    """Whether two reads of the resource may give different rows."""
    return resource.format in PLUGINS or resource.format == "jdbc"


def load(spark: SparkSession, resource) -> DataFrame:
    """The rows of a resource: a plugin's, a query's, JDBC's, a file's or a catalog table's.

    A JDBC read uses ``readers`` connections, by ranges of the column ``split``; a hint is put into
    its query's text, elsewhere on the frame.
    """
    if resource.format in PLUGINS:
        df = PLUGINS[resource.format](spark, resource)
    elif resource.format == "jdbc":
        return _load_jdbc(spark, resource)
    elif resource.from_:
        df = spark.sql(resource.from_)
    elif resource.path:
        kind = "json" if resource.format == "ndjson" else resource.format
        if kind not in FILES:
            raise ValueError(f"no loader for {resource.format!r}")
        df = spark.read.format(kind).options(**resource.options).load(resource.path)
    else:
        df = spark.table(resource.table)
    if resource.hint:
        df = df.hint(resource.hint)
    return df


def _load_jdbc(spark: SparkSession, resource) -> DataFrame:
    reader = spark.read.format("jdbc").options(**resource.options)
    inner = f"({resource.from_})" if resource.from_ else resource.table
    what = f"(SELECT {resource.hint} * FROM {inner} h) q" if resource.hint else f"{inner} q" if resource.from_ else inner
    if resource.readers > 1 and "partitionColumn" not in resource.options:
        name = _dialect(spark, resource).quoteIdentifier(resource.split)
        query = f"SELECT MIN({name}) AS a, MAX({name}) AS b FROM {inner} m"
        low, high = reader.option("query", query).load().first()
        if low is not None:
            reader = spark.read.format("jdbc").options(**resource.options).options(
                partitionColumn=resource.split, lowerBound=str(low), upperBound=str(high), numPartitions=str(resource.readers)
            )
    return reader.option("dbtable", what).load()


def partition_values(spark: SparkSession, resource, df: DataFrame, columns: list[str]) -> DataFrame:
    """The partitions to sync: those of the resource's own query, else the distinct ones."""
    if resource.partition_sql:
        found = spark.sql(resource.partition_sql)
        if missing := [c for c in columns if c.lower() not in {x.lower() for x in found.columns}]:
            raise ValueError(f"the partition query lacks {missing}")
        return found.select(*columns).distinct()
    return df.select(*columns).distinct()


def save(df: DataFrame, resource, mode: str = "overwrite", writers: int = 0, batch: int = 2048) -> None:
    """Writes to a resource other than what ``df`` reads."""
    if writers:
        df = df.repartition(writers)
    if resource.format == "jdbc":
        options = resource.options | {"dbtable": resource.table, "batchsize": str(batch)}
        df.write.format("jdbc").options(**options).mode(mode).save()
    elif resource.path:
        df.write.format("json" if resource.format == "ndjson" else resource.format).options(**resource.options).mode(mode).save(resource.path)
    else:
        df.write.mode(mode).saveAsTable(resource.table)


def write_change(whole: DataFrame, change, resource, transfer) -> None:
    """Applies a change to a table that Spark cannot write as files: a JDBC table or one of the catalog."""
    if resource.format == "jdbc":
        _change_jdbc(whole, change, resource, transfer)
    else:
        _change_table(whole, change, resource)


def _change_table(whole: DataFrame, change, resource) -> None:
    """A catalog table. Rows to add are appended. Else, of a partitioned table just the partitions are written that rows
    leave or enter; any other managed table is built beside and takes the old one's name, and an external one is
    overwritten from a stage. A write that fails leaves the rows as they were (an external table: the stage)."""
    spark, table = whole.sparkSession, resource.table
    if change.whole is None and not change.drops:
        if change.add is not None:
            stage(change.add, "add").select(*whole.columns).write.insertInto(table)
        return
    parts = [c.name for c in spark.catalog.listColumns(table) if c.isPartition]
    if parts and change.whole is None:
        _overwrite_partitions(whole, change, table, parts)
        return
    result = stage(change.result(whole), "result").select(*whole.columns)
    if spark.catalog.getTable(table).tableType == "MANAGED":
        _swap(result, table)
    else:
        result.write.insertInto(table, overwrite=True)


def _overwrite_partitions(whole: DataFrame, change, table: str, parts: list[str]) -> None:
    spark = whole.sparkSession
    names = [F.col(f"`{p}`") for p in parts]
    touched = [] if change.add is None else [change.add.select(*names)]
    for keys in change.drops:
        on = [F.col(f"o.`{c}`").eqNullSafe(F.col(f"k.`{c}`")) for c in keys.columns]
        touched.append(whole.alias("o").join(keys.alias("k"), on, "left_semi").select(*names))
    held = touched[0]
    for t in touched[1:]:
        held = held.union(t)
    held = stage(held.distinct(), "touched")
    on = [F.col(f"o.`{p}`").eqNullSafe(F.col(f"t.`{p}`")) for p in parts]
    inside = whole.alias("o").join(held.alias("t"), on, "left_semi")
    result = stage(change.result(inside), "result").select(*whole.columns)
    mode = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")
    try:
        result.write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set(mode, before)
    # partitions without a row left are not written, and go
    empty = held.alias("o").join(result.select(*names).distinct().alias("t"), on, "left_anti")
    for r in empty.toLocalIterator():
        spec = ", ".join(f"`{p}` = {_sql_literal(r[p])}" for p in parts)
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({spec})")


def _sql_literal(value) -> str:
    if value is None:
        return "null"
    return str(value) if isinstance(value, int | float) and not isinstance(value, bool) else "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _swap(result: DataFrame, table: str) -> None:
    """Writes a table beside and gives it the name; until then readers see the old one."""
    spark, run = result.sparkSession, uuid.uuid4().hex[:8]
    new, old = f"{table}__new_{run}", f"{table}__old_{run}"
    spark.sql(f"CREATE TABLE {new} LIKE {table}")
    try:
        result.write.insertInto(new)
        spark.sql(f"ALTER TABLE {table} RENAME TO {old}")
        try:
            spark.sql(f"ALTER TABLE {new} RENAME TO {table}")
        except Exception:
            spark.sql(f"ALTER TABLE {old} RENAME TO {table}")
            raise
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {new}")
        raise
    spark.sql(f"DROP TABLE IF EXISTS {old}")


def _dialect(spark: SparkSession, resource):
    return spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(resource.options["url"])


def connection(spark: SparkSession, resource):
    """A ``java.sql.Connection`` of the driver process."""
    jvm = spark._jvm
    options = {k.lower(): v for k, v in resource.options.items()}
    if driver := options.get("driver"):
        jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(driver)
    info = jvm.java.util.Properties()
    for name in ("user", "password"):
        if name in options:
            info.setProperty(name, options[name])
    return jvm.java.sql.DriverManager.getConnection(options["url"], info)


def _change_jdbc(whole: DataFrame, change, resource, transfer) -> None:
    """Rows to add and keys of rows to drop go to tables of their own, by ``transfer.writers`` connections in
    batches; one transaction then deletes and inserts, so the destination changes whole or not at all."""
    spark = whole.sparkSession
    quote = _dialect(spark, resource).quoteIdentifier
    table, run = resource.table, uuid.uuid4().hex[:8]

    def name(kind: str) -> str:
        return staging_name(table, {"kind": kind, "run": run}, transfer.suffix, transfer.temp_database)

    steps, made = [], []
    con = connection(spark, resource)
    try:

        def put(df: DataFrame, kind: str) -> str:
            made.append(name(kind))
            create_like(con, made[-1], table, [quote(c) for c in df.columns])
            options = resource.options | {"dbtable": made[-1], "batchsize": str(transfer.batch_size)}
            df = df.repartition(transfer.writers) if transfer.writers else df
            df.write.format("jdbc").options(**options).mode("append").save()
            return made[-1]

        if change.whole is not None:
            steps.append(f"DELETE FROM {table}")
        add = change.whole if change.whole is not None else change.add
        for k, keys in enumerate(change.drops if change.whole is None else []):
            held = put(keys.distinct(), f"d{k}")
            same = " AND ".join(
                f"(s.{quote(c)} = {table}.{quote(c)} OR (s.{quote(c)} IS NULL AND {table}.{quote(c)} IS NULL))" for c in keys.columns
            )
            steps.append(f"DELETE FROM {table} WHERE EXISTS (SELECT 1 FROM {held} s WHERE {same})")
        if add is not None:
            cols = ", ".join(map(quote, add.columns))
            steps.append(f"INSERT INTO {table} ({cols}) SELECT {cols} FROM {put(add, 'a')}")
        con.setAutoCommit(False)
        statement = con.createStatement()
        try:
            for sql in steps:
                statement.executeUpdate(sql)
            con.commit()
        except Exception:
            con.rollback()
            raise
        finally:
            statement.close()
            con.setAutoCommit(True)
            for held in made:
                drop(con, held)
    finally:
        con.close()


def create_like(con, name: str, table: str, columns: list[str]) -> None:
    """An empty table with some columns of another, dropped first if there: by a query without rows."""
    drop(con, name)
    query = f"SELECT {', '.join(columns)} FROM {table}"
    failed = None
    for text in (f"CREATE TABLE {name} AS {query} WHERE 1 = 0", f"CREATE TABLE {name} AS {query} WITH NO DATA"):
        statement = con.createStatement()
        try:
            statement.executeUpdate(text)
            return
        except Exception as error:  # noqa: BLE001 - another vendor's spelling
            failed = error
        finally:
            statement.close()
    raise failed


def drop(con, name: str) -> None:
    statement = con.createStatement()
    try:
        statement.executeUpdate(f"DROP TABLE {name}")
    except Exception:  # noqa: BLE001, S110 - it may not be there
        pass
    finally:
        statement.close()


def column_names(spark: SparkSession, table: str) -> list[tuple[str, str]]:
    return [(c.name, c.dataType) for c in spark.catalog.listColumns(table)]


def current_database(spark: SparkSession) -> str:
    return spark.catalog.currentDatabase()


def show_create(spark: SparkSession, table: str) -> str:
    return spark.sql(f"SHOW CREATE TABLE {table}").first()[0]


def empty_like(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], df.schema)
