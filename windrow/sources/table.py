"""Partitioned tables: rows are stored by time window, and a manifest says which files count.

Layout: ``manifest/v<n>.json`` and ``data/_v=<version>/_p=<window>/*.parquet``, with companions' own files beside.
Appends add a segment (a ``_v`` folder); updates and deletes write the windows they touch anew (copy on write), and a
commit is one new manifest. Every change reads and builds on one manifest; if another writer commits meanwhile, the
change is put on top of that one where the windows it rewrites are untouched, and else ends in CommitConflict. Folders
that no longer count stay for RETAIN seconds, so that DataFrames made before a change can still be read.
"""

from __future__ import annotations

import contextlib
import threading
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ColumnTypeMismatch, CommitConflict, MatchRequiresCompanion, PartitionColumnError, TableError, WhereClauseError
from ..functions.timeparse import partition_column, to_datetime, to_epoch, to_timestamp
from ..operators.companions import Companion, make_companion
from ..plans.bounds import Bounds, Span
from ..plans.predicates import Predicate, wrap
from .manifest import Files, Manifest, commit, load
from .spec import IndexDecl, TableSpec, parse_spec

WINDOW, SEGMENT = "_p", "_v"
#: Seconds that folders stay after they are struck from the manifest; times that a change is put on a newer manifest.
RETAIN, ATTEMPTS = 3600, 20
#: Windows, and rows of a window, up to which an ordered scan sorts window by window; larger ones are sorted by a shuffle.
ORDERED_WINDOWS, ORDERED_ROWS = 512, 4_000_000
#: Bytes, as shuffled, that a task of a write sorts and writes. They are several times that in memory, and a task that
#: gets more than it can hold writes its rows out once more (Spark's own bound is 64 MB).
TASK_BYTES = 16 << 20

_ADVISED = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
#: For each session with writes under way: how many, and the setting that it had before them (None: none of its own).
_writing: dict[int, tuple[int, str | None]] = {}
_WRITING = threading.Lock()


@contextlib.contextmanager
def bounded_tasks(spark: SparkSession) -> Iterator[None]:
    """Until the end of the block, tasks after a rebalancing get about TASK_BYTES each; a smaller setting of the session stays.

    The setting is the whole session's: threads that write at once share the change, and the last one takes it back.
    """
    key = spark._jsparkSession.hashCode()
    with _WRITING:
        writers, before = _writing.get(key, (0, None))
        if not writers:
            before = spark.conf.get(_ADVISED, None)
            if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_ADVISED)) > TASK_BYTES:
                spark.conf.set(_ADVISED, str(TASK_BYTES))
        _writing[key] = writers + 1, before
    try:
        yield
    finally:
        with _WRITING:
            writers, before = _writing.pop(key)
            if writers > 1:
                _writing[key] = writers - 1, before
            elif before is None:
                spark.conf.unset(_ADVISED)
            else:
                spark.conf.set(_ADVISED, before)


def checked(value, field: T.StructField):
    """A value as its column holds it; ColumnTypeMismatch for one that a column of numbers, truth values or text can't hold."""
    if value is None:
        return None
    kind, good = field.dataType, True
    if isinstance(kind, T.BooleanType):
        good = isinstance(value, bool)
    elif isinstance(kind, T.IntegralType):
        bits = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32}.get(type(kind), 64)
        good = isinstance(value, int) and not isinstance(value, bool) and -(1 << bits - 1) <= value < 1 << bits - 1
    elif isinstance(kind, T.FractionalType):
        good = isinstance(value, int | float) and not isinstance(value, bool)
    elif isinstance(kind, T.StringType):
        good = isinstance(value, str)
    if not good:
        raise ColumnTypeMismatch(f"column {field.name} is {kind.simpleString()} and can't hold {value!r}")
    return float(value) if isinstance(kind, T.DoubleType | T.FloatType) else value


class PartitionedTable:
    """A table of time windows under a path."""

    def __init__(self, spark: SparkSession, path: str, manifest: Manifest):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)
        self._manifest, self._staged = manifest, None
        self._begun, self._made = manifest, []
        self._pending: list[tuple] = []
        self._listed: dict[tuple[str, Bounds], DataFrame] = {}
        self._listed_for: Manifest | None = None
        self.companions: dict[str, Companion] = {d.name: make_companion(d, self.spec) for d in self.spec.companions}

    # Lifecycle

    @classmethod
    def create(cls, spark: SparkSession, path: str, spec: TableSpec | str) -> PartitionedTable:
        """A new, empty table from a declaration."""
        spec = parse_spec(spec) if isinstance(spec, str) else spec
        files = Files(spark, path)
        if files.exists("manifest"):
            raise TableError(f"there is a table at {path}")
        for declared in spec.companions:
            make_companion(declared, spec)
        commit(files, manifest := Manifest(spec))
        return cls(spark, path, manifest)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PartitionedTable:
        return cls(spark, path, load(Files(spark, path)))

    @property
    def spec(self) -> TableSpec:
        return self._manifest.spec

    @property
    def manifest(self) -> Manifest:
        """The manifest that reads and writes go by: the staged one in a transaction, else the newest committed."""
        if self._staged is not None:
            return self._staged
        self._manifest = load(self.files, self._manifest)
        return self._manifest

    def close(self) -> None:
        """Write the rows still buffered."""
        self.flush()

    def drop(self) -> None:
        """Delete the table with all it holds."""
        self._pending.clear()
        self.files.delete("")

    def alter_layout(self, **options) -> None:
        """Change ``sort_within``, ``bloom`` or ``batch_size``; files already written stay as they are."""
        if unknown := set(options) - {"sort_within", "bloom", "batch_size"}:
            raise TableError(f"not an option of the layout: {', '.join(sorted(unknown))}")
        self._change(self.manifest, lambda m: replace(m, spec=replace(m.spec, **options)))

    def create_index(self, name: str, *columns: str) -> None:
        """A named index on columns, for the files of all windows written from now on."""
        if any(i.name == name for i in self.spec.indexes):
            raise TableError(f"there is an index {name}")
        self._change(self.manifest, lambda m: replace(m, spec=replace(m.spec, indexes=(*m.spec.indexes, IndexDecl(name, columns)))))

    def drop_index(self, name: str) -> None:
        if all(i.name != name for i in self.manifest.spec.indexes):
            raise TableError(f"no index {name}")
        self._change(self.manifest, lambda m: replace(m, spec=replace(m.spec, indexes=tuple(i for i in m.spec.indexes if i.name != name))))

    def indexes(self) -> DataFrame:
        """name, columns of the indexes."""
        return self.spark.createDataFrame([(i.name, ", ".join(i.columns)) for i in self.manifest.spec.indexes], "name string, columns string")

    # Writing

    def _change(self, base: Manifest, change: Callable[[Manifest], Manifest], rewritten: Iterable[int] = (), segment: int | None = None, sweep: bool = True) -> None:
        """Commit ``change``, which was made from ``base`` and rewrites some windows; ``segment`` holds its new rows.

        Where another writer has committed since, the change is made to that manifest, if the rewritten windows are as
        they were; otherwise the segment is deleted and CommitConflict raised.
        """
        made = [] if segment is None else [segment]
        if self._staged is not None:
            self._staged = change(self._staged)
            self._made += made
            return
        try:
            for _ in range(ATTEMPTS):
                newest = self.manifest
                if changed := [p for p in rewritten if newest.windows.get(p) != base.windows.get(p)]:
                    raise CommitConflict(f"another writer has changed windows {changed[:5]} of {self.path}")
                manifest = replace(change(newest).marked(time.time()), version=newest.version + 1)
                with contextlib.suppress(CommitConflict):
                    commit(self.files, manifest)
                    self._manifest = manifest
                    break
                time.sleep(0.05)
            else:
                raise CommitConflict(f"other writers kept committing to {self.path}")
        except BaseException:
            self._forget(made)
            raise
        if sweep and any(at < time.time() - RETAIN for at in manifest.struck.values()):
            with contextlib.suppress(CommitConflict):
                self.vacuum()

    def _tops(self) -> list[str]:
        return ["data", *(f"companions/{name}" for name in self.companions)]

    def _forget(self, segments: Iterable[int]) -> None:
        """Delete segments that were never committed."""
        for segment in segments:
            for top in self._tops():
                self.files.delete(f"{top}/{SEGMENT}={segment}")

    def vacuum(self, retain: float = RETAIN) -> int:
        """Delete the windows' folders that were struck more than ``retain`` seconds ago; how many. Changes call it, too."""
        manifest = self._manifest = load(self.files, self._manifest)
        old = {key for key, at in manifest.struck.items() if at <= time.time() - retain}
        if not old:
            return 0
        left = manifest.swept(old).written
        for segment in {s for s, _ in old}:
            names = [f"/{WINDOW}={p}" for s, p in old if s == segment] if segment in left else [""]
            for top in self._tops():
                for name in names:
                    self.files.delete(f"{top}/{SEGMENT}={segment}{name}")
        # Only now are they forgotten: a vacuum that fails on the way is taken up by the next one.
        self._change(manifest, lambda m: m.swept(old), sweep=False)
        return len(old)

    def _routed(self, df: DataFrame) -> DataFrame:
        """Rows in the table's schema with their window; a row without a point in time fails the job."""
        name = self.spec.partition_column
        if name not in df.columns:
            raise PartitionColumnError(f"rows need a value in {name}")
        if unknown := set(df.columns) - {c.name for c in self.spec.columns} - {WINDOW}:
            raise TableError(f"no such columns: {', '.join(sorted(unknown))}")
        kind = df.schema[name].dataType
        ts = to_timestamp(F.col(name), kind)
        columns = []
        for field in self.spec.schema():
            value = F.col(field.name) if field.name in df.columns else F.lit(None)
            if field.name == name and not self.spec.text_compat:
                value = ts
            columns.append(value.cast(field.dataType).alias(field.name))
        start = partition_column(ts, self.spec.interval)
        failed = F.raise_error(F.concat(F.lit(f"no point in time in {name}: "), F.coalesce(F.col(name).cast("string"), F.lit("null")))).cast("long")
        return df.select(*columns, F.coalesce(start, failed).alias(WINDOW))

    def _write(self, rows: DataFrame) -> tuple[int, dict[int, int]]:
        """Write routed rows as a new segment; its number and the rows of each window."""
        segment = time.time_ns()
        spec = self.spec
        # Rebalancing by window keeps a window's rows together, and splits a window that is too large for one task.
        laid = rows.hint("rebalance", WINDOW).sortWithinPartitions(WINDOW, spec.partition_column, *spec.sorted_by)
        writer = laid.write.partitionBy(WINDOW)
        for column in spec.bloomed:
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        folder = f"{self.path}/data/{SEGMENT}={segment}"
        try:
            with bounded_tasks(rows.sparkSession):
                writer.parquet(folder)
            written = self._read([folder], folder)
            # No column is read for this: the windows are folders, and the files' footers have their numbers of rows.
            counts = {r[WINDOW]: r["n"] for r in written.groupBy(WINDOW).agg(F.count(F.lit(1)).alias("n")).collect()}
            for companion in self.companions.values():
                companion.on_rows_written(written, f"{self.path}/companions/{companion.name}/{SEGMENT}={segment}")
        except BaseException:
            self._forget([segment])
            raise
        return segment, counts

    def append(self, df: DataFrame, batch: tuple[str, int] | str | None = None) -> int:
        """Add rows; durable on return. The number of rows added.

        A ``batch`` is a stream's name and a number (or a name alone); a batch whose number is not beyond the highest
        that was added under its name is skipped.
        """
        self.flush()
        manifest = self.manifest
        name, number = batch if isinstance(batch, tuple) else (batch, 0)
        if name is not None and manifest.batches.get(name, -1) >= number:
            return 0
        segment, counts = self._write(self._routed(df))

        def change(m: Manifest) -> Manifest:
            if name is not None:
                if m.batches.get(name, -1) >= number:
                    raise CommitConflict(f"batch {batch} was added by another writer")
                m = replace(m, batches=m.batches | {name: number})
            return m.extended(segment, counts) if counts else m

        self._change(manifest, change, segment=segment)
        if not counts:
            self._forget([segment])
        return sum(counts.values())

    def insert(self, rows: Iterable[dict]) -> None:
        """Buffer rows; every ``batch_size`` of them are written, and all before anything is read."""
        names = {c.name for c in self.spec.columns}
        name = self.spec.partition_column
        for row in rows:
            if row.get(name) is None:
                raise PartitionColumnError(f"rows need a value in {name}")
            at = to_datetime(row[name])
            if unknown := set(row) - names:
                raise TableError(f"no such columns: {', '.join(sorted(unknown))}")
            own = str(row[name]) if self.spec.text_compat else at.isoformat(" ")
            self._pending.append(tuple(own if f.name == name else checked(row.get(f.name), f) for f in self.spec.schema()))
            if len(self._pending) >= self.spec.batch_size:
                self.flush()

    def flush(self) -> None:
        """Write the buffered rows."""
        if not self._pending:
            return
        rows, self._pending = self._pending, []
        name = self.spec.partition_column
        schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == name else f.dataType) for f in self.spec.schema()])
        manifest = self.manifest
        segment, counts = self._write(self._routed(self.spark.createDataFrame(rows, schema)))
        self._change(manifest, lambda m: m.extended(segment, counts), segment=segment)

    def rollback(self) -> None:
        """Forget the buffered rows, and what a transaction has staged."""
        self._pending.clear()
        if self._staged is not None:
            self._staged = self._begun
            self._forget(self._made)
            self._made = []

    @contextlib.contextmanager
    def transaction(self) -> Iterator[PartitionedTable]:
        """All changes inside become one commit at the end, or none if the block raises."""
        self.begin()
        try:
            yield self
        except BaseException:
            self.abandon()
            raise
        self.commit()

    def begin(self) -> None:
        """Stage all changes from now on."""
        if self._staged is not None:
            raise TableError("transactions don't nest")
        self.flush()
        self._begun = self._staged = self.manifest
        self._made = []

    def outrun(self) -> bool:
        """Whether another writer has committed since a transaction began."""
        return load(self.files, self._begun).version != self._begun.version

    def abandon(self) -> None:
        """Forget what is staged."""
        self._pending.clear()
        self._staged = None
        self._forget(self._made)
        self._made = []

    def commit(self) -> None:
        """Commit what is staged, if no other writer has changed the table since; CommitConflict, with all forgotten, if one has."""
        try:
            self.flush()
        except BaseException:
            self.abandon()
            raise
        begun, staged, made = self._begun, self._staged, self._made
        self._staged, self._made = None, []
        if staged is begun:
            return

        def change(m: Manifest) -> Manifest:
            if m.version != begun.version:
                raise CommitConflict(f"another writer has changed {self.path}")
            return staged

        try:
            self._change(begun, change)
        except BaseException:
            self._forget(made)
            raise

    # Reading

    def _read(self, paths: list[str], base: str, schema: T.StructType | None = None) -> DataFrame:
        full = T.StructType([*(schema or self.spec.schema()).fields, T.StructField(WINDOW, T.LongType())])
        return self.spark.read.schema(full).option("basePath", base).parquet(*paths)

    def _segments(self, top: str, schema: T.StructType | None, bounds: Bounds, manifest: Manifest | None = None) -> DataFrame:
        """The live rows of the windows within bounds.

        The manifest knows the windows, so only the folders of those within bounds are named and listed; without
        bounds, segments of which every window counts are listed by their folder. Lists are kept for one manifest.
        """
        manifest = manifest or self.manifest
        if self._listed_for is not manifest:
            self._listed_for, self._listed = manifest, {}
        if (known := self._listed.get((top, bounds))) is not None:
            return known
        paths = []
        for segment, starts in manifest.live().items():
            folder = f"{self.path}/{top}/{SEGMENT}={segment}"
            wanted = starts if bounds.everything else [p for p in starts if bounds.holds(p)]
            if len(wanted) == len(manifest.written.get(segment, ())):
                paths.append(folder)
            else:
                paths += [f"{folder}/{WINDOW}={p}" for p in wanted]
        schema = schema or self.spec.schema()
        full = T.StructType([*schema.fields, T.StructField(SEGMENT, T.LongType()), T.StructField(WINDOW, T.LongType())])
        if paths:
            out = self.spark.read.schema(full).option("basePath", f"{self.path}/{top}").parquet(*paths).drop(SEGMENT)
        else:
            out = self.spark.createDataFrame([], full).drop(SEGMENT)
        if len(self._listed) < 64:
            self._listed[top, bounds] = out
        return out

    def _bounds(self, where: Predicate | None) -> Bounds:
        return Bounds() if where is None else where.bounds(self.spec.partition_column, self.spec.interval)

    def _condition(self, where: Predicate) -> Column:
        return where.column(None if self.spec.text_compat else self.spec.partition_column)

    def scan(self, where: Predicate | Column | str | None = None, order: str | None = None, window: bool = False) -> DataFrame:
        """The rows that satisfy ``where``, from the windows it can reach; ``order`` is asc or desc by the partition column.

        Windows follow each other, so ordered rows come window by window, each sorted on its own, without a shuffle;
        a limit then reads no more windows than it needs.
        """
        self.flush()
        if order not in (None, "asc", "desc"):
            raise WhereClauseError("order is asc or desc")
        predicate = None if where is None else wrap(where)
        bounds, manifest = self._bounds(predicate), self.manifest
        matching = lambda rows: rows if predicate is None else rows.filter(self._condition(predicate))
        if order is None:
            out = matching(self._segments("data", None, bounds, manifest))
            return out if window else out.drop(WINDOW)
        key = F.asc(self.spec.partition_column) if order == "asc" else F.desc(self.spec.partition_column)
        held = [(p, w) for p, w in sorted(manifest.windows.items(), reverse=order == "desc") if w.rows and bounds.holds(p)]
        if self.spec.text_compat or not held or len(held) > ORDERED_WINDOWS:
            out = matching(self._segments("data", None, bounds, manifest)).orderBy(key)
            return out if window else out.drop(WINDOW)
        out = None
        for p, w in held:
            rows = matching(self._segments("data", None, Bounds.of(Span(p, p)), manifest))
            rows = rows.coalesce(1).sortWithinPartitions(key) if w.rows <= ORDERED_ROWS else rows.orderBy(key)
            out = rows if out is None else out.unionAll(rows)
        return out if window else out.drop(WINDOW)

    def latest(self, n: int, *ties: str) -> DataFrame:
        """The n newest rows, newest first, from as many of the newest windows as hold n rows."""
        self.flush()
        held, low = 0, None
        for p, w in sorted(self.manifest.windows.items(), reverse=True):
            low, held = p, held + w.rows
            if held >= n:
                break
        bounds = Bounds.of(Span(low, None)) if low is not None else Bounds.of()
        return self._segments("data", None, bounds).drop(WINDOW).orderBy(F.desc(self.spec.partition_column), *ties).limit(n)

    def partition(self, start: int) -> DataFrame:
        """The rows of one window."""
        self.flush()
        if start not in self.manifest.windows:
            raise TableError(f"no window {start}")
        return self._segments("data", None, Bounds.of(Span(start, start))).drop(WINDOW)

    def partitions(self, low: int | None = None, high: int | None = None) -> list[int]:
        """Starts of the windows from low to high, both included."""
        return [p for p in sorted(self.manifest.windows) if Span(low, high).holds(p)]

    def companion(self, name: str) -> DataFrame:
        """A companion's rows with their window as ``_p``."""
        self.flush()
        found = self.companions.get(name)
        if found is None or (schema := found.schema(self.spec.schema())) is None:
            raise TableError(f"no companion {name} with rows of its own")
        return self._segments(f"companions/{name}", schema, Bounds())

    def create_view(self, name: str) -> None:
        """Temporary views of the rows and of the metadata: name, name_lookup, name_stats, name_root."""
        self.scan().createOrReplaceTempView(name)
        for what in ("lookup", "stats", "root"):
            getattr(self, what)().createOrReplaceTempView(f"{name}_{what}")

    # Metadata

    def _name(self, start: int) -> str:
        return f"{self.path.rsplit('/', 1)[-1]}_{start}"

    def lookup(self) -> DataFrame:
        rows = [(self._name(p), p, w.expires_at) for p, w in sorted(self.manifest.windows.items())]
        return self.spark.createDataFrame(rows, "partition_table string, partition_value long, expires_at long")

    def stats(self) -> DataFrame:
        rows = [(self._name(p), p, w.rows) for p, w in sorted(self.manifest.windows.items())]
        return self.spark.createDataFrame(rows, "partition_table string, p long, row_count long")

    def root(self) -> DataFrame:
        row = (self.spec.partition_column, self.spec.interval, self.spec.lifetime)
        return self.spark.createDataFrame([row], "partition_column string, partition_value long, lifetime long")

    def template(self) -> DataFrame:
        """No rows, in the table's schema."""
        return self.spark.createDataFrame([], self.spec.schema())

    def companion_declarations(self) -> DataFrame:
        rows = [(d.name, d.module, ", ".join(d.args)) for d in self.spec.companions]
        return self.spark.createDataFrame(rows, "name string, module string, args string")

    def total_rows(self) -> int:
        self.flush()
        return sum(w.rows for w in self.manifest.windows.values())

    def partition_count(self) -> int:
        self.flush()
        return len(self.manifest.windows)

    def count_between(self, start, end) -> int:
        """Rows from start to before end, from the manifest alone; both must be starts of windows, and start before end."""
        self.flush()
        low, high = to_epoch(start), to_epoch(end)
        if low % self.spec.interval or high % self.spec.interval:
            raise WhereClauseError(f"both ends must be multiples of {self.spec.interval} seconds")
        if high <= low:
            raise WhereClauseError("the end must come after the start")
        return sum(w.rows for p, w in self.manifest.windows.items() if low <= p < high)

    def estimate(self, where: Predicate | None = None, low: int | None = None, high: int | None = None) -> tuple[int, int]:
        """(windows, rows) that a predicate, or window starts from low to high, can reach."""
        self.flush()
        bounds = self._bounds(where).meet(Bounds.of(Span(low, high)))
        held = [w for p, w in self.manifest.windows.items() if bounds.holds(p)]
        return len(held), sum(w.rows for w in held)

    # Changing rows

    def _touched(self, condition: Column, bounds: Bounds, manifest: Manifest) -> dict[int, int]:
        """How many rows satisfy a condition in each window that has any."""
        rows = self._segments("data", None, bounds, manifest).filter(condition)
        return {r[WINDOW]: r["n"] for r in rows.groupBy(WINDOW).agg(F.count(F.lit(1)).alias("n")).collect()}

    def update(self, where: Predicate | Column | str, values: dict[str, Column | object]) -> int:
        """Set columns of the rows that satisfy ``where``; rows whose window changes move. The number of rows changed.

        A window that all rows leave stays, with no rows."""
        self.flush()
        predicate = wrap(where)
        names = {c.name for c in self.spec.columns}
        if unknown := set(values) - names:
            raise TableError(f"no such columns: {', '.join(sorted(unknown))}")
        manifest, condition = self.manifest, self._condition(predicate)
        touched = self._touched(condition, self._bounds(predicate), manifest)
        if not touched:
            return 0
        matched = F.coalesce(condition, F.lit(False))
        name = self.spec.partition_column
        rows = self._segments("data", None, Bounds.of(*(Span(p, p) for p in touched)), manifest).drop(WINDOW)
        new = {}
        for field in self.spec.schema():
            if field.name not in values:
                continue
            value = values[field.name]
            value = value if isinstance(value, Column) else F.lit(value)
            if field.name == name:
                kind = rows.select(value.alias("x")).schema["x"].dataType
                value = F.coalesce(to_timestamp(value, kind), F.raise_error(F.lit(f"no point in time for {name}")).cast("timestamp_ntz")) if not self.spec.text_compat else value
            new[field.name] = F.when(matched, value.cast(field.dataType)).otherwise(F.col(field.name))
        changed = rows.select(*(new.get(f.name, F.col(f.name)).alias(f.name) for f in self.spec.schema()))
        segment, counts = self._write(self._routed(changed))
        self._change(manifest, lambda m: m.emptied(touched).extended(segment, counts), touched, segment)
        return sum(touched.values())

    def delete(self, where: Predicate | Column | str) -> int:
        """Delete the rows that satisfy ``where``; the number of rows deleted. Emptied windows stay, with no rows.

        Windows that lose all rows are only struck from the manifest."""
        self.flush()
        predicate = wrap(where)
        manifest, condition = self.manifest, self._condition(predicate)
        touched = self._touched(condition, self._bounds(predicate), manifest)
        if not touched:
            return 0
        some = [p for p, n in touched.items() if n < manifest.windows[p].rows]
        segment, counts = None, {}
        if some:
            rows = self._segments("data", None, Bounds.of(*(Span(p, p) for p in some)), manifest)
            segment, counts = self._write(self._routed(rows.filter(~F.coalesce(condition, F.lit(False))).drop(WINDOW)))
        self._change(manifest, lambda m: m.emptied(touched).extended(segment, counts) if counts else m.emptied(touched), touched, segment)
        return sum(touched.values())

    def compact(self) -> None:
        """Write windows that lie in several segments anew, as one."""
        self.flush()
        manifest = self.manifest
        several = [p for p, w in manifest.windows.items() if len(w.segments) > 1]
        if several:
            rows = self._segments("data", None, Bounds.of(*(Span(p, p) for p in several)), manifest).drop(WINDOW)
            segment, counts = self._write(self._routed(rows))
            self._change(manifest, lambda m: m.emptied(several).extended(segment, counts), several, segment)

    # Retention

    def expired(self, now: int | None = None) -> list[int]:
        """Starts of the windows that have expired by now (epoch seconds; the clock's if not given)."""
        now = int(time.time()) if now is None else now
        return [p for p, w in sorted(self.manifest.windows.items()) if w.expires_at is not None and w.expires_at <= now]

    def cleanup(self, now: int | None = None) -> int:
        """Drop all expired windows with their companions' rows; how many they were."""
        self.flush()
        if gone := self.expired(now):
            self._drop(gone)
        return len(gone)

    def _drop(self, starts: list[int]) -> None:
        manifest = self.manifest
        self._change(manifest, lambda m: m.without(starts), starts)
        for companion in self.companions.values():
            companion.on_windows_dropped(starts)

    def drop_partition(self, start: int) -> None:
        self.flush()
        if start not in self.manifest.windows:
            raise TableError(f"no window {start}")
        self._drop([start])

    def set_expiry(self, start: int, expires_at: int | None) -> None:
        """Change when a window expires."""
        self.flush()
        manifest = self.manifest
        if start not in manifest.windows:
            raise TableError(f"no window {start}")
        self._change(manifest, lambda m: replace(m, windows=m.windows | {start: replace(m.windows[start], expires_at=expires_at)}), [start])

    # Vector search

    def knn(self, column: str, vector: Iterable[float], k: int | None, where: Predicate | Column | str | None = None, mode: str = "post", metric: str = "l2", ties: tuple[str, ...] = ()) -> DataFrame:
        """The k rows nearest to a vector, with ``distance`` and the hidden ``k`` (null), nearest first.

        In mode ``post`` the windows that ``where`` can reach are searched and the k nearest rows are then filtered,
        so fewer may remain; in mode ``pre`` the k nearest of the rows that satisfy ``where`` are found.
        """
        self.flush()
        return self.searched(column, vector, k, None if where is None else wrap(where), mode=mode, metric=metric, ties=ties)

    def searched(self, column: str, wanted, k: int | None, where: Predicate | None = None, bounds: Bounds | None = None, **options) -> DataFrame:
        """What the companion that drives scans of a column finds; MatchRequiresCompanion if there is none."""
        driver = next((c for c in self.companions.values() if c.drives_scan(column)), None)
        if driver is None:
            raise MatchRequiresCompanion(f"no vector companion searches {column!r}")
        if bounds is None:
            bounds = self._bounds(where)
        rows = self._segments("data", None, bounds)
        condition = None if where is None else self._condition(where)
        return driver.scan(rows, column, wanted, k, condition, order=(WINDOW, self.spec.partition_column), **options).drop(WINDOW)
