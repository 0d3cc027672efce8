"""More of the query catalogue: declarations, metadata, errors, streams and the surfaces that other code plugs into."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .errors import TableError
from .functions.interval import parse_interval, parse_lifetime
from .functions.timeparse import epoch_seconds, partition_column, to_epoch, to_timestamp
from .functions.types import parse_type
from .operators.companions import Companion, register_companion
from .plans.bounds import Bounds, Span
from .plans.predicates import field
from .queries import _NOW, DAY, HOUR, TS, _vectors, kept, one, query, read, session, stored
from .sources.datasource import WindrowDataSource
from .sources.scratch import scratch
from .sources.spec import CompanionDecl, parse_spec
from .sources.table import PartitionedTable
from .streaming import session_counts, sliding_counts, stream_into, windowed_counts


def values(columns: str, *rows: tuple) -> str:
    """SQL of a small table."""
    spell = lambda v: "null" if v is None else "true" if v is True else "false" if v is False else f"'{v}'" if isinstance(v, str) else f"{v}::bigint"
    return f"select * from (values {', '.join('(' + ', '.join(map(spell, r)) + ')' for r in rows)}) t({columns})"


def failure(run) -> str:
    """The name of the error that a call ends in; empty if it doesn't."""
    try:
        run()
    except TableError as error:
        return type(error).__name__
    return ""


NARROW = "1 hour, col1 timestamp partition_column, col2 text"


def narrow(spark: SparkSession, *rows: tuple, spec: str = NARROW) -> PartitionedTable:
    table = PartitionedTable.create(spark, scratch(spark, "narrow"), spec)
    if rows:
        table.append(spark.createDataFrame(rows, "col1 string, col2 string"))
    return table


# Declarations

_LIFETIMES = (("lifetime 1 day", 86400), ("LIFETIME 3 hour", 10800), ("col1 text", None))
_INTERVALS = (("1 hour", 3600), ("30 day", 2592000))


@query(values("text, seconds", *_LIFETIMES, *_INTERVALS))
def declared_lengths(spark, sf_dir):
    return spark.createDataFrame([(t, parse_lifetime(t)) for t, _ in _LIFETIMES] + [(t, parse_interval(t)) for t, _ in _INTERVALS], "text string, seconds long")


@query(values("name, type, partition", ("ts", "timestamp_ntz", True), ("n", "bigint", False), ("x", "double", False), ("t", "string", False), ("b", "boolean", False)))
def declared_columns(spark, sf_dir):
    spec = parse_spec("1 day, ts timestamp partition_column, n int, x float, t text, b boolean")
    rows = [(c.name, f.dataType.simpleString(), c.partition) for c, f in zip(spec.columns, spec.schema(), strict=True)]
    return spark.createDataFrame(rows, "name string, type string, partition boolean")


@query("select column_name as name from (describe select * from events)")
def template_schema(spark, sf_dir):
    template = kept(spark, sf_dir).template()
    return spark.createDataFrame([(f.name,) for f in template.schema] if template.isEmpty() else [], "name string")


@query(values("name, module, args", ("copy", "mirror", "event_type, event_id")))
def companion_store(spark, sf_dir):
    return stored(spark, sf_dir, companions=(CompanionDecl("copy", "mirror", ("event_type", "event_id")),)).companion_declarations()


@query("select 'TableError' as error")
def drop_table(spark, sf_dir):
    table = narrow(spark, ("2024-01-01", "a"))
    table.drop()
    return spark.createDataFrame([(failure(lambda: PartitionedTable.load(spark, table.path)),)], "error string")


@query("select 3::bigint as n")
def close_flushes(spark, sf_dir):
    table = narrow(spark)
    table.insert({"col1": f"2024-01-01 12:0{i}", "col2": "x"} for i in range(3))
    table.close()
    return one(spark, n=PartitionedTable.load(spark, table.path).total_rows())


@query("select 1::bigint as n")
def rollback_forgets(spark, sf_dir):
    table = narrow(spark, ("2024-01-01", "a"))
    table.insert([{"col1": "2024-01-01 12:00", "col2": "x"}])
    table.rollback()
    return one(spark, n=table.total_rows())


@query("select 'events_' || p as partition_table from (select distinct epoch_us(ts) // 1000000 - (epoch_us(ts) // 1000000) % 86400 as p from events)")
def partition_names(spark, sf_dir):
    return kept(spark, sf_dir).lookup().select("partition_table")


@query("select col2 from (values ('b')) t(col2)")
def text_compat(spark, sf_dir):
    table = PartitionedTable.create(spark, scratch(spark, "text"), parse_spec(NARROW, text_compat=True))
    table.append(spark.createDataFrame([("2024-01-01 12:00:00", "a"), ("2024-01-01 12:30", "b")], "col1 string, col2 string"))
    # Compared as text, the first row is beyond "12:00" but not equal to it.
    return table.scan((field("col1") == "2024-01-01 12:00") | (field("col1") > "2024-01-01 12:15")).select("col2")


@query("select event_id, ts from events where user_id = 11 and event_type = 'view'")
def index_by_sql(spark, sf_dir):
    db = session(spark, sf_dir)
    db.sql("create index by_user on ev (user_id, event_type)")
    db.sql("update ev set value = value + 0")  # writes all windows anew, with the index
    return db.sql("select event_id, ts from ev where user_id = 11 and event_type = 'view'")


@query(values("name, columns", ("by_user", "user_id, event_type")))
def index_names(spark, sf_dir):
    db = session(spark, sf_dir)
    db.sql("create index gone on ev (props)")
    db.sql("create index by_user on ev (user_id, event_type)")
    db.sql("drop index gone on ev")
    return db.sql("select name, columns from ev_indexes")


# Errors

ERRORS = (
    ("no partition column", "PartitionColumnError"), ("no interval", "ParseIntervalError"), ("unknown unit", "ParseIntervalError"), ("two lifetimes", "ParseIntervalError"),
    ("bad column", "ColumnDeclarationError"), ("unknown type", "ParseValueTypeError"), ("repeated column", "ColumnDeclarationError"), ("unknown module", "CompanionError"),
    ("bad companion", "CompanionError"), ("bad literal", "TimestampParseError"), ("time without a date", "TimestampParseError"), ("insert without a time", "PartitionColumnError"),
    ("insert of an unknown column", "TableError"), ("insert of a wrong type", "ColumnTypeMismatch"), ("unaligned count", "WhereClauseError"), ("unknown window", "TableError"),
    ("search without a companion", "MatchRequiresCompanion"), ("search without k", "CompanionError"), ("search with k 0", "CompanionError"), ("bad vector", "WhereClauseError"),
    ("update of an unknown column", "TableError"), ("table that exists", "TableError"), ("other writer", "CommitConflict"), ("no error", ""),
)


@query(values("what, error", *ERRORS))
def errors(spark, sf_dir):
    table = narrow(spark, ("2024-01-01 12:15", "a"))
    vectors = PartitionedTable.create(spark, scratch(spark, "vec"), "1 hour, ts timestamp partition_column, emb text, t text, companion vec USING vec0(emb float[2])")

    def outrun():
        with table.transaction():
            table.delete(field("col2") == "a")
            PartitionedTable.load(spark, table.path).set_expiry(1704110400, 5)

    calls = {
        "no partition column": lambda: parse_spec("1 hour, a text"),
        "no interval": lambda: parse_spec("a timestamp partition_column"),
        "unknown unit": lambda: parse_spec("1 week, a timestamp partition_column"),
        "two lifetimes": lambda: parse_spec("1 day, lifetime 1 day, lifetime 2 day, a timestamp partition_column"),
        "bad column": lambda: parse_spec("1 day, a timestamp partition_column, b"),
        "unknown type": lambda: parse_type("colour"),
        "repeated column": lambda: parse_spec("1 day, a timestamp partition_column, a text"),
        "unknown module": lambda: narrow(spark, spec=f"{NARROW}, companion x USING nothing(col2)"),
        "bad companion": lambda: parse_spec(f"{NARROW}, companion x"),
        "bad literal": lambda: table.scan(field("col1") > "not-a-timestamp"),
        "time without a date": lambda: table.scan(field("col1") > "12:30 PM"),
        "insert without a time": lambda: table.insert([{"col2": "x"}]),
        "insert of an unknown column": lambda: table.insert([{"col1": "2024-01-01", "col3": "x"}]),
        "insert of a wrong type": lambda: table.insert([{"col1": "2024-01-01", "col2": 7}]),
        "unaligned count": lambda: table.count_between("2024-01-01 12:15", "2024-01-01 14:00"),
        "unknown window": lambda: table.partition(0),
        "search without a companion": lambda: vectors.knn("t", [1.0, 2.0], 1),
        "search without k": lambda: vectors.knn("emb", [1.0, 2.0], None),
        "search with k 0": lambda: vectors.knn("emb", [1.0, 2.0], 0),
        "bad vector": lambda: vectors.knn("emb", "[1,", 1),
        "update of an unknown column": lambda: table.update(field("col2") == "a", {"col3": "x"}),
        "table that exists": lambda: PartitionedTable.create(spark, table.path, NARROW),
        "other writer": outrun,
        "no error": lambda: table.scan().count(),
    }
    return spark.createDataFrame([(what, failure(call)) for what, call in calls.items()], "what string, error string")


@query("select event_id, 'x' as kind from events where ts < '2024-01-02' union all select 9000000, 'late'")
def second_writer(spark, sf_dir):
    """Another writer's rows stay when a change to the same window is refused and made again."""
    table = stored(spark, sf_dir)
    other = PartitionedTable.load(spark, table.path)
    late = read(spark, sf_dir, "events").filter("event_id = 0").withColumns({"event_id": F.lit(9000000).cast("long"), "event_type": F.lit("late")})
    with contextlib.suppress(TableError), table.transaction():
        table.update(TS < "2024-01-02", {"event_type": "lost"})
        other.append(late)
    table.update((TS < "2024-01-02") & (field("event_type") != "late"), {"event_type": "x"})
    return table.scan(TS < "2024-01-02").select("event_id", F.col("event_type").alias("kind"))


# Points in time and bounds

_SECONDS = (0, 1706790645, -1, -86400, -86401)


@query(values("n, hour, day", *((n, n - n % HOUR, n - n % DAY) for n in _SECONDS)))
def floors(spark, sf_dir):
    df = spark.createDataFrame([(to_epoch(n),) for n in _SECONDS], "n long")
    ts = to_timestamp(F.col("n"), df.schema["n"].dataType)
    return df.select(epoch_seconds(ts).alias("n"), partition_column(ts, HOUR).alias("hour"), partition_column(ts, DAY).alias("day"))


_SHAPES = (("ts = 0", True, True, True), ("ts > 0", False, True, False), ("ts < 0", False, False, True), ("0 < ts < 9", False, True, True), ("true", False, False, False))


@query(values("what, single, low, high", *_SHAPES))
def bounds_shapes(spark, sf_dir):
    found = (Bounds.of(Span(0, 0)), Bounds.of(Span(0, None)), Bounds.of(Span(None, 0)), Bounds.of(Span(0, 7200)), Bounds())
    return spark.createDataFrame([(s[0], *b.shape()) for s, b in zip(_SHAPES, found, strict=True)], "what string, single boolean, low boolean, high boolean")


# Searches in SQL

_EMB = "select vec_id, list_distance(embedding::double[], (select embedding from embeddings where vec_id = 7)::double[]) as distance from embeddings"


def _searched(spark, sf_dir, text: str) -> DataFrame:
    from .sql import Session

    table, vector = _vectors(spark, sf_dir)
    top, name = table.path.rsplit("/", 1)
    return Session(spark, top).sql(text.format(t=name, q=[float(x) for x in vector]))


@query(f"select vec_id, round(distance, 6) as distance, null::bigint as k from ({_EMB}) order by distance, vec_id limit 5")
def sql_match(spark, sf_dir):
    return _searched(spark, sf_dir, "select vec_id, round(distance, 6) as distance, k from {t} where embedding match '{q}' and k = 5")


@query(f"select vec_id, row_number() over (order by distance) as place from (select * from ({_EMB}) order by distance limit 8)")
def sql_match_order(spark, sf_dir):
    found = _searched(spark, sf_dir, "select vec_id, distance from {t} where embedding match '{q}' and k = 8 order by distance limit 8")
    return found.select("vec_id", F.row_number().over(Window.orderBy("distance")).alias("place"))  # eight rows, one task


@query("select count(*) as n from embeddings where vec_id < 144 and vec_id % 7 = 0")
def hidden_columns(spark, sf_dir):
    """Hidden columns are there in searches and empty, and not in the table."""
    table, vector = _vectors(spark, sf_dir)
    found = table.knn("embedding", vector, 5000, (TS < "2024-01-02") & (F.col("vec_id") % 7 == 0))
    assert {"k", "distance"} <= set(found.columns) and not {"k", "distance"} & set(table.scan().columns)
    return found.filter("k is null and distance >= 0").agg(F.count(F.lit(1)).alias("n"))


# What other code plugs into


class Latest(Companion):
    """Drives scans of a column by the newest rows that hold a value."""

    def drives_scan(self, column: str) -> bool:
        return column in self.synced

    def scan(self, rows, column, wanted, k, condition, order=(), **options):
        rows = rows.filter(F.col(column) == wanted)
        rows = rows if condition is None else rows.filter(condition)
        return rows.orderBy(*(F.desc(c) for c in order), "event_id").limit(k)


@query("select event_id from events where event_type = 'click' and ts < '2024-01-20' order by ts desc, event_id limit 12")
def companion_scan(spark, sf_dir):
    register_companion("latest", Latest)
    table = stored(spark, sf_dir, companions=(CompanionDecl("newest", "latest", ("event_type",)),))
    return table.knn("event_type", "click", 12, TS < "2024-01-20").select("event_id")


@query("select event_id, event_type from events where ts >= '2024-01-05' and ts < '2024-01-06'")
def companion_window(spark, sf_dir):
    from .sql import Session

    table = stored(spark, sf_dir, companions=(CompanionDecl("copy", "mirror", ("event_type", "event_id")),))
    return Session(spark, table.path.rsplit("/", 1)[0]).sql("select event_id, event_type from events_1704412800_copy")


@query("select upper(event_type) || '!' as kind, count(*) as n from events where ts < '2024-01-08' group by 1")
def user_function(spark, sf_dir):
    db = session(spark, sf_dir)
    db.register_function("windrow_shout", lambda kinds: kinds.str.upper() + "!")
    return db.sql("select windrow_shout(event_type) as kind, count(*) as n from ev where ts < '2024-01-08' group by 1")


@query(f"select count(distinct ts::date) as dropped from events where epoch_us(ts) // 1000000 - (epoch_us(ts) // 1000000) % 86400 + 86400 + 604800 <= {_NOW} + 100000000")
def sql_cleanup(spark, sf_dir):
    return session(spark, sf_dir).sql("select windrow_cleanup('ev') as dropped")


@query("select event_id, user_id from events where ts >= '2024-01-05 06:00' and ts < '2024-01-06' and event_type <> 'view'")
def source_by_sql(spark, sf_dir):
    spark.dataSource.register(WindrowDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    name = f"by_source_{uuid.uuid4().hex}"
    spark.read.format("windrow").load(kept(spark, sf_dir).path).createOrReplaceTempView(name)
    return spark.sql(f"select event_id, user_id from {name} where ts >= timestamp_ntz'2024-01-05 06:00:00' and ts < timestamp_ntz'2024-01-06' and event_type <> 'view'")


# Streams


def _stream(spark, sf_dir) -> DataFrame:
    schema = read(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/events.parq*")


def _counted(counts: DataFrame) -> DataFrame:
    """The counts of a stream that has ended."""
    name = f"counted_{uuid.uuid4().hex}"
    counts.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return counts.sparkSession.table(name)


@query("select epoch_us(time_bucket(interval '1 hour', ts)) // 1000000 as p, count(*) as row_count from events group by 1")
def tumbling_window_count(spark, sf_dir):
    return _counted(windowed_counts(_stream(spark, sf_dir), "ts", HOUR))


@query("select epoch_us(start) // 1000000 as p, count(*) as row_count from (select unnest([time_bucket(interval '1 hour', ts), time_bucket(interval '1 hour', ts) - interval '1 hour']) as start from events) group by 1")
def sliding_window_count(spark, sf_dir):
    return _counted(sliding_counts(_stream(spark, sf_dir), "ts", 2 * HOUR, HOUR))


@query("""
    with g as (select user_id, ts, case when ts - lag(ts) over w < interval 6 hour then 0 else 1 end as new from events window w as (partition by user_id order by ts)),
    s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from g)
    select user_id, min(ts) as began, count(*) as row_count from s group by user_id, s""")
def session_window_count(spark, sf_dir):
    return session_counts(read(spark, sf_dir, "events"), "ts", 6 * HOUR, "user_id").select("user_id", F.col("began").cast("timestamp_ntz").alias("began"), "row_count")


@query(f"select event_id from events where epoch_us(ts) // 1000000 - (epoch_us(ts) // 1000000) % 86400 + 86400 + 604800 > {_NOW}")
def stream_drops_late_rows(spark, sf_dir):
    df = read(spark, sf_dir, "events")
    table = stored(spark, sf_dir, lifetime=7 * DAY)
    table.delete(F.lit(True))
    stream_into(table, _stream(spark, sf_dir).select(df.columns), scratch(spark, "progress"), drop_late_before=_NOW).awaitTermination()
    return table.scan().select("event_id")
