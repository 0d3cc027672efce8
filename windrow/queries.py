"""The query catalogue: what partitioned tables do, with the same in SQL for DuckDB."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.timeparse import epoch_seconds, to_timestamp
from .operators.knn import nearest
from .plans.bounds import Bounds, Span
from .plans.predicates import field
from .sources.overlay import Overlay
from .sources.scratch import scratch
from .sources.spec import TableSpec
from .sources.table import PartitionedTable
from .sql import Session, blanked
from .streaming import stream_into

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

HOUR, DAY = 3600, 86400
TS = field("ts")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, interval: str = "1 hour") -> Overlay:
    return Overlay(read(spark, sf_dir, "events"), "ts", interval)


def stored(spark: SparkSession, sf_dir: str, interval: str = "1 day", companions=(), **options) -> PartitionedTable:
    """The events as a stored table."""
    df = read(spark, sf_dir, "events")
    spec = TableSpec.from_schema(df.schema, "ts", interval, companions=tuple(companions), **options)
    table = PartitionedTable.create(spark, scratch(spark, "events"), spec)
    table.append(df)
    return table


_kept: dict[tuple, PartitionedTable] = {}


def kept(spark: SparkSession, sf_dir: str) -> PartitionedTable:
    """The events as a stored table that queries only read: written once for each application and folder."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _kept:
        _kept[key] = stored(spark, sf_dir)
    return _kept[key]


# Scans and pruning

SIMPLE = {
    "scan_all": (None, "true"),
    "prune_ge_lt_aligned": ((TS >= "2024-01-05 00:00") & (TS < "2024-01-06 00:00"), "ts >= '2024-01-05' and ts < '2024-01-06'"),
    "prune_gt_mid": (TS > "2024-01-10 12:30", "ts > '2024-01-10 12:30'"),
    "prune_ge_boundary": (TS >= "2024-01-28 12:00", "ts >= '2024-01-28 12:00'"),
    "prune_lt_boundary": (TS < "2024-01-02 13:00", "ts < '2024-01-02 13:00'"),
    "prune_le_mid": (TS <= "2024-01-02 13:31:07", "ts <= '2024-01-02 13:31:07'"),
    "prune_eq": (TS == dt.datetime(2024, 1, 1, 0, 0, 7, 179575), "ts = '2024-01-01 00:00:07.179575'"),
    "prune_between": (TS.between("2024-01-05 10:00", "2024-01-05 12:15"), "ts between '2024-01-05 10:00' and '2024-01-05 12:15'"),
    "prune_in": (
        TS.isin(dt.datetime(2024, 1, 1, 0, 0, 7, 179575), "2024-01-30 23:57:12.194062"),
        "ts in ('2024-01-01 00:00:07.179575', '2024-01-30 23:57:12.194062')",
    ),
    "prune_or": ((TS > "2024-01-29") | (TS < "2024-01-02"), "ts > '2024-01-29' or ts < '2024-01-02'"),
    "prune_contradiction": ((TS >= "2024-01-06") & (TS < "2024-01-05"), "ts >= '2024-01-06' and ts < '2024-01-05'"),
    "range_unindexed_filter": (
        (TS >= "2024-01-10 10:00") & (TS < "2024-01-10 18:00") & (field("event_type") == "click"),
        "ts >= '2024-01-10 10:00' and ts < '2024-01-10 18:00' and event_type = 'click'",
    ),
    "filter_eq": (field("event_type") == "click", "event_type = 'click'"),
    "filter_ne": (field("event_type") != "click", "event_type <> 'click'"),
    "filter_like_ci": (field("event_type").like("%IGN%"), "event_type ilike '%IGN%'"),
    "filter_glob": (field("event_type").glob("[cs]*i*"), "event_type glob '[cs]*i*'"),
    "filter_regexp": (field("props").regexp(r'": 1\d\}$'), r"""regexp_matches(props, '": 1\d\}$')"""),
    "filter_isnull": (field("value").is_null(), "value is null"),
    "filter_notnull": (field("value").is_not_null(), "value is not null"),
    "filter_is": (field("user_id").is_(7), "user_id is not distinct from 7"),
    "filter_isnot": (field("user_id").is_not(7), "user_id is distinct from 7"),
    "filter_in": (field("event_type").isin("view", "error"), "event_type in ('view', 'error')"),
}
_ALL = "event_id, ts, user_id, event_type, value, props"
for _name, (_where, _sql) in SIMPLE.items():
    QUERIES[_name] = lambda spark, sf_dir, where=_where: kept(spark, sf_dir).scan(where)
    ORACLE[_name] = f"select {_ALL} from events where {_sql}"

# The same over files that aren't stored by window.
OVERLAID = ("prune_ge_lt_aligned", "prune_contradiction", "filter_like_ci")
for _name in OVERLAID:
    QUERIES[f"overlay_{_name}"] = lambda spark, sf_dir, where=SIMPLE[_name][0]: events(spark, sf_dir).scan(where)
    ORACLE[f"overlay_{_name}"] = f"select {_ALL} from events where {SIMPLE[_name][1]}"

STORED = {f"stored_{n}": SIMPLE[n] for n in ("scan_all", "prune_ge_lt_aligned", "prune_gt_mid", "prune_lt_boundary", "prune_or", "prune_in", "range_unindexed_filter")}
for _name, (_where, _sql) in STORED.items():
    QUERIES[_name] = lambda spark, sf_dir, where=_where: stored(spark, sf_dir).scan(where)
    ORACLE[_name] = f"select {_ALL} from events where {_sql}"


@query("select event_id, event_type from events")
def scan_project(spark, sf_dir):
    return events(spark, sf_dir).scan().select("event_id", "event_type")


@query("select p, count(*) as row_count from (select epoch_us(ts) // 1000000 - (epoch_us(ts) // 1000000) % 3600 as p from events) group by p")
def route_hourly(spark, sf_dir):
    return events(spark, sf_dir).stats()


@query("select p, count(*) as row_count from (select epoch_us(ts) // 1000000 - (epoch_us(ts) // 1000000) % 86400 as p from events) group by p")
def route_daily(spark, sf_dir):
    return stored(spark, sf_dir).stats().select("p", "row_count")


@query("select o_orderkey, o_orderdate from orders where o_orderdate >= '1996-02-01' and o_orderdate < '1996-03-01'")
def prune_dates_daily(spark, sf_dir):
    d = field("o_orderdate")
    return Overlay(read(spark, sf_dir, "orders"), "o_orderdate", "1 day").scan((d >= "1996-02-01") & (d < "1996-03-01")).select("o_orderkey", "o_orderdate")


@query("select l_orderkey, l_linenumber, l_shipdate from lineitem where l_shipdate between '1997-05-01' and '1997-05-31'")
def prune_dates_lineitem(spark, sf_dir):
    d = field("l_shipdate")
    return Overlay(read(spark, sf_dir, "lineitem"), "l_shipdate", "30 day").scan(d.between("05/01/1997", "31-05-1997")).select("l_orderkey", "l_linenumber", "l_shipdate")


# Orders, limits, newest rows


@query("select event_id, row_number() over (order by ts, event_id) as place from events")
def order_asc(spark, sf_dir):
    """Windows are ranked on their own; what comes before a window is known from its statistics."""
    table = kept(spark, sf_dir)
    rows, before = table.manifest.windows, 0
    offsets = []
    for p in sorted(rows):
        offsets.append((p, before))
        before += rows[p].rows
    ranked = table.scan(window=True).withColumn("n", F.row_number().over(Window.partitionBy("_p").orderBy("ts", "event_id")))
    return ranked.join(spark.createDataFrame(offsets, "_p long, before long"), "_p").select("event_id", (F.col("n") + F.col("before")).alias("place"))


@query("select ts from events order by ts desc limit 300")
def ordered_scan(spark, sf_dir):
    return kept(spark, sf_dir).scan(order="desc").select("ts").limit(300)


@query("select ts from events where ts >= '2024-01-05 12:30' and ts < '2024-01-08'")
def ordered_range_scan(spark, sf_dir):
    return kept(spark, sf_dir).scan((TS >= "2024-01-05 12:30") & (TS < "2024-01-08"), order="asc").select("ts")


@query("select event_id, ts from events order by ts desc, event_id limit 20")
def order_desc_limit(spark, sf_dir):
    return events(spark, sf_dir).scan().orderBy(F.desc("ts"), "event_id").limit(20).select("event_id", "ts")


@query("select event_id, ts from events where ts >= '2024-01-05 12:30' and ts < '2024-01-06' order by ts, event_id limit 50")
def order_range(spark, sf_dir):
    return kept(spark, sf_dir).scan((TS >= "2024-01-05 12:30") & (TS < "2024-01-06")).orderBy("ts", "event_id").limit(50).select("event_id", "ts")


@query("select event_id, value from events order by value desc, event_id limit 30")
def order_nonpartition(spark, sf_dir):
    return events(spark, sf_dir).scan().orderBy(F.desc("value"), "event_id").limit(30).select("event_id", "value")


@query("select event_id, ts from events order by ts, event_id limit 10 offset 25")
def limit_offset(spark, sf_dir):
    return events(spark, sf_dir).scan().orderBy("ts", "event_id").offset(25).limit(10).select("event_id", "ts")


@query("select event_id, ts from events order by ts desc, event_id limit 1000")
def latest_1000(spark, sf_dir):
    return stored(spark, sf_dir).latest(1000, "event_id").select("event_id", "ts")


# Counts and metadata


def one(spark: SparkSession, **values: int) -> DataFrame:
    return spark.range(1).select(*(F.lit(v).cast("long").alias(k) for k, v in values.items()))


@query("select count(*) as n from events where ts >= '2024-01-15 10:00' and ts < '2024-01-15 12:00'")
def count_between_2h(spark, sf_dir):
    return one(spark, n=stored(spark, sf_dir, "1 hour").count_between("2024-01-15 10:00", "2024-01-15 12:00"))


@query("select count(*) as n from events where ts >= '2024-01-15' and ts < '2024-01-16'")
def count_between_day(spark, sf_dir):
    return one(spark, n=stored(spark, sf_dir).count_between("2024-01-15", "2024-01-16"))


@query("select count(*) as total_rows, count(distinct ts::date) as partition_count from events")
def total_rows_and_partitions(spark, sf_dir):
    table = stored(spark, sf_dir)
    return one(spark, total_rows=table.total_rows(), partition_count=table.partition_count())


@query("select count(distinct ts::date) as windows, count(*) as n from events where ts >= '2024-01-10' and ts < '2024-01-13'")
def estimate_range(spark, sf_dir):
    windows, n = stored(spark, sf_dir).estimate((TS > "2024-01-10 05:00") & (TS < "2024-01-13"))
    return one(spark, windows=windows, n=n)


@query("select p, count(*) as row_count, p + 86400 + 7 * 86400 as expires_at from (select epoch_us(ts) // 1000000 - (epoch_us(ts) // 1000000) % 86400 as p from events) group by p")
def lookup_expiry(spark, sf_dir):
    table = stored(spark, sf_dir, lifetime=7 * DAY)
    return table.stats().join(table.lookup().withColumnRenamed("partition_value", "p"), "p").select("p", "row_count", "expires_at")


@query("select 'ts' as partition_column, 86400::bigint as partition_value, 604800::bigint as lifetime")
def root_table(spark, sf_dir):
    return stored(spark, sf_dir, lifetime=7 * DAY).root()


@query(f"select {_ALL} from events where ts >= '2024-01-05' and ts < '2024-01-06'")
def one_partition(spark, sf_dir):
    return stored(spark, sf_dir).partition(1704412800)


@query("select event_id, ts, user_id from events where user_id = 11 and event_type = 'signup'")
def wide_device(spark, sf_dir):
    return stored(spark, sf_dir, sort_within=("user_id",), bloom=("user_id",)).scan((field("user_id") == 11) & (field("event_type") == "signup")).select("event_id", "ts", "user_id")


@query("select l_orderkey, l_linenumber from lineitem where l_returnflag = 'R' and l_linestatus = 'F' and l_shipdate >= '1996-01-01' and l_shipdate < '1996-02-01'")
def wide_status_region(spark, sf_dir):
    d = field("l_shipdate")
    where = (d >= "1996-01-01") & (d < "1996-02-01") & (field("l_returnflag") == "R") & (field("l_linestatus") == "F")
    return Overlay(read(spark, sf_dir, "lineitem"), "l_shipdate", "30 day").scan(where).select("l_orderkey", "l_linenumber")


@query("select event_type, round(avg(value), 6) as mean, count(*) as n from events where ts >= '2024-01-03' and ts < '2024-01-20' group by event_type")
def avg_by_category(spark, sf_dir):
    rows = stored(spark, sf_dir).scan((TS >= "2024-01-03") & (TS < "2024-01-20"))
    return rows.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


# Changing rows


@query("select event_id, ts, case when ts > '2024-01-20 13:00' and event_type = 'click' then 'tap' else event_type end as event_type from events")
def update_inplace(spark, sf_dir):
    table = stored(spark, sf_dir)
    table.update((TS > "2024-01-20 13:00") & (field("event_type") == "click"), {"event_type": "tap"})
    return table.scan().select("event_id", "ts", "event_type")


_MOVED = "case when event_id % 10 = 3 and ts < '2024-01-04' then ts + interval 1 day else ts end"


def _moved(spark, sf_dir) -> PartitionedTable:
    table = stored(spark, sf_dir)
    table.update((TS < "2024-01-04") & (F.col("event_id") % 10 == 3), {"ts": F.col("ts") + F.expr("interval 1 day")})
    return table


@query(f"select event_id, {_MOVED} as ts from events")
def update_move(spark, sf_dir):
    return _moved(spark, sf_dir).scan().select("event_id", "ts")


@query(f"select p, count(*) as row_count from (select epoch_us(ts) // 1000000 - (epoch_us(ts) // 1000000) % 86400 as p from (select {_MOVED} as ts from events)) group by p")
def update_stats_after(spark, sf_dir):
    return _moved(spark, sf_dir).stats().select("p", "row_count")


@query("select event_id from events where not (event_type = 'error' and ts >= '2024-01-10' and ts < '2024-01-12')")
def delete_rows(spark, sf_dir):
    table = stored(spark, sf_dir)
    table.delete((TS >= "2024-01-10") & (TS < "2024-01-12") & (field("event_type") == "error"))
    return table.scan().select("event_id")


@query("select p, count(*) filter (where not (event_type = 'error' or (ts >= '2024-01-10' and ts < '2024-01-11'))) as row_count from (select *, epoch_us(ts) // 1000000 - (epoch_us(ts) // 1000000) % 86400 as p from events) group by p")
def delete_stats_after(spark, sf_dir):
    table = stored(spark, sf_dir)
    table.delete((field("event_type") == "error") | ((TS >= "2024-01-10") & (TS < "2024-01-11")))
    return table.stats().select("p", "row_count")


@query("select event_id from events where not (ts >= '2024-01-10' and ts < '2024-01-11')")
def delete_partition(spark, sf_dir):
    table = stored(spark, sf_dir)
    table.drop_partition(1704844800)
    return table.scan().select("event_id")


@query("select event_id, event_type from (select event_id, event_type from events where event_type <> 'error' union all select event_id + 1000000, 'copy' from events where event_type = 'error')")
def transaction_swap(spark, sf_dir):
    table = stored(spark, sf_dir)
    wrong = field("event_type") == "error"
    copies = read(spark, sf_dir, "events").filter("event_type = 'error'").withColumns({"event_id": F.col("event_id") + 1000000, "event_type": F.lit("copy")})
    with table.transaction():
        table.delete(wrong)
        table.append(copies)
    return table.scan().select("event_id", "event_type")


@query("select event_id, case when event_id % 7 = 0 then null else value end as value from events where event_id % 7 = 0")
def filter_isnull_rows(spark, sf_dir):
    table = stored(spark, sf_dir)
    table.update(F.col("event_id") % 7 == 0, {"value": F.lit(None)})
    return table.scan(field("value").is_null()).select("event_id", "value")


@query("select event_id, user_id from events union all select 5000000 + i, 77 from range(1500) t(i)")
def insert_buffered(spark, sf_dir):
    table = stored(spark, sf_dir, batch_size=600)
    table.insert({"event_id": 5000000 + i, "ts": f"2024-02-01 {i % 24:02d}:00", "user_id": 77} for i in range(1500))
    return table.scan().select("event_id", "user_id")


@query("select event_id from events union all select event_id from events where event_type = 'view'")
def compacted(spark, sf_dir):
    table = stored(spark, sf_dir)
    table.append(read(spark, sf_dir, "events").filter("event_type = 'view'"))
    table.compact()
    return table.scan().select("event_id")


# Retention

_NOW = 1705708800  # 2024-01-20


@query(f"select event_id from events where epoch_us(ts) // 1000000 - (epoch_us(ts) // 1000000) % 86400 + 86400 + 604800 > {_NOW}")
def cleanup_remaining(spark, sf_dir):
    table = stored(spark, sf_dir, lifetime=7 * DAY)
    table.cleanup(now=_NOW)
    return table.scan().select("event_id")


@query(f"select count(distinct ts::date) as dropped from events where epoch_us(ts) // 1000000 - (epoch_us(ts) // 1000000) % 86400 + 86400 + 604800 <= {_NOW}")
def cleanup_count(spark, sf_dir):
    return one(spark, dropped=stored(spark, sf_dir, lifetime=7 * DAY).cleanup(now=_NOW))


@query("select 1704067200::bigint as p, count(*) as row_count, 1704067200 + 86400 + 604800 as expires_at from events where ts < '2024-01-02'")
def late_row_recreate(spark, sf_dir):
    table = stored(spark, sf_dir, lifetime=7 * DAY)
    table.cleanup(now=_NOW)
    table.append(read(spark, sf_dir, "events").filter("ts < timestamp_ntz'2024-01-02'"))
    late = table.stats().join(table.lookup().withColumnRenamed("partition_value", "p"), "p")
    return late.filter("p = 1704067200").select("p", "row_count", "expires_at")


# Vectors

_EMB = "select vec_id, embedding, label, timestamp '2024-01-01' + vec_id * interval 10 minute as ts from embeddings"
_Q = "(select embedding from embeddings where vec_id = 7)"
_DIST = f"list_distance(embedding::double[], {_Q}::double[])"


def _vectors(spark, sf_dir) -> tuple[PartitionedTable, list[float]]:
    df = read(spark, sf_dir, "embeddings").withColumn("ts", F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("vec_id") * 10))
    table = PartitionedTable.create(spark, scratch(spark, "vectors"), "1 day, ts timestamp partition_column, vec_id int, embedding vector, label int, companion vec USING vec0(embedding float[64])")
    table.append(df.select("ts", "vec_id", "embedding", "label"))
    return table, list(df.filter("vec_id = 7").first()["embedding"])


def _found(df: DataFrame) -> DataFrame:
    return df.select("vec_id", F.round("distance", 6).alias("distance"))


def _knn(name: str, k: int, where, sql_prune: str, sql_rest: str, mode: str = "post") -> None:
    def run(spark, sf_dir):
        table, vector = _vectors(spark, sf_dir)
        return _found(table.knn("embedding", vector, k, where, mode, ties=("vec_id",)))

    QUERIES[name] = run
    ORACLE[name] = (
        f"with d as (select vec_id, ts, label, {_DIST} as distance from ({_EMB}) where {sql_prune} order by distance, vec_id limit {k}) "
        f"select vec_id, round(distance, 6) as distance from d where {sql_rest}"
    )


_MID = (TS >= "2024-01-01 10:15") & (TS < "2024-01-02 08:00")
_knn("knn_global", 10, None, "true", "true")
_knn("knn_k1", 1, None, "true", "true")
_knn("knn_local", 5, (TS >= "2024-01-02") & (TS < "2024-01-03"), "ts >= '2024-01-02' and ts < '2024-01-03'", "true")
_knn("knn_window_aligned", 20, (TS >= "2024-01-02") & (TS < "2024-01-05"), "ts >= '2024-01-02' and ts < '2024-01-05'", "true")
_knn("knn_window_mid_post", 20, _MID, "ts < '2024-01-03'", "ts >= '2024-01-01 10:15' and ts < '2024-01-02 08:00'")
_knn("knn_window_mid_pre", 20, _MID, "ts >= '2024-01-01 10:15' and ts < '2024-01-02 08:00'", "true", "pre")
_knn("knn_row_filter_post", 20, field("label") == 3, "true", "label = 3")
_knn("knn_row_filter_pre", 20, field("label") == 3, "label = 3", "true", "pre")


@query(f"select vec_id, round(distance, 6) as distance, row_number() over (order by distance desc, vec_id) as place from (select vec_id, {_DIST} as distance from embeddings order by distance, vec_id limit 10)")
def knn_desc(spark, sf_dir):
    table, vector = _vectors(spark, sf_dir)
    found = table.knn("embedding", vector, 10, ties=("vec_id",))
    # Ten rows, so one task ranks them.
    return found.select("vec_id", F.round("distance", 6).alias("distance"), F.row_number().over(Window.orderBy(F.desc("distance"), "vec_id")).alias("place"))


@query(f"select vec_id, round({_DIST}, 6) as distance from embeddings order by {_DIST}, vec_id limit 10")
def knn_plain(spark, sf_dir):
    df = read(spark, sf_dir, "embeddings")
    return _found(nearest(df, "embedding", list(df.filter("vec_id = 7").first()["embedding"]), 10, ties=("vec_id",)))


@query(f"select vec_id, round(distance, 6) as distance from (select vec_id, {_DIST} as distance from embeddings order by distance, vec_id limit 3 offset 2)")
def knn_after_delete(spark, sf_dir):
    table, vector = _vectors(spark, sf_dir)
    table.delete(F.col("vec_id").isin([r["vec_id"] for r in table.knn("embedding", vector, 2, ties=("vec_id",)).collect()]))
    return _found(table.knn("embedding", vector, 3, ties=("vec_id",)))


# Companions


def _mirrored(spark, sf_dir) -> PartitionedTable:
    from .sources.spec import CompanionDecl

    return stored(spark, sf_dir, companions=(CompanionDecl("copy", "mirror", ("event_type", "event_id")),))


_P = "epoch_us(ts) // 1000000 - (epoch_us(ts) // 1000000) % 86400"


@query(f"select event_id, event_type, {_P} as p from events")
def mirror_sync(spark, sf_dir):
    return _mirrored(spark, sf_dir).companion("copy").select("event_id", "event_type", F.col("_p").alias("p"))


@query(f"select event_id, case when event_type = 'view' then 'seen' else event_type end as event_type, {_P} as p from events")
def mirror_after_update(spark, sf_dir):
    table = _mirrored(spark, sf_dir)
    table.update(field("event_type") == "view", {"event_type": "seen"})
    return table.companion("copy").select("event_id", "event_type", F.col("_p").alias("p"))


@query(f"select event_id, event_type, {_P} as p from events where event_type <> 'view' and ts >= '2024-01-03'")
def mirror_after_delete(spark, sf_dir):
    table = _mirrored(spark, sf_dir)
    table.delete((field("event_type") == "view") | (TS < "2024-01-03"))
    return table.companion("copy").select("event_id", "event_type", F.col("_p").alias("p"))


# Points in time

_TEXTS = (
    ("2024-02-01 12:30:45", 1706790645), ("2024-02-01 12:30", 1706790600), ("2024-02-01", 1706745600), ("01-02-2024 12:30:45", 1706790645),
    ("01-02-2024 12:30", 1706790600), ("01-02-2024", 1706745600), ("02/01/2024 12:30:45", 1706790645), ("02/01/2024 12:30", 1706790600),
    ("02/01/2024", 1706745600), ("20240201123045", 1706790645), ("20240201", 1706745600), ("2024-02-01T12:30:45Z", 1706790645),
    ("2024-02-01T12:30:45+0200", 1706783445), ("February 01, 2024 12:30:45", 1706790645), ("Feb 01, 2024 12:30:45", 1706790645),
    ("1969-12-31 23:59:58", -2), ("2024-1-1 9:5:7", 1704099907), ("12:30 PM", None), ("not-a-timestamp", None), ("2024-13-45", None),
)


@query("select * from (values " + ", ".join(f"('{t}', {'null' if e is None else e}::bigint)" for t, e in _TEXTS) + ") t(text, epoch)")
def parse_formats(spark, sf_dir):
    df = spark.createDataFrame([(t,) for t, _ in _TEXTS], "text string")
    return df.select("text", epoch_seconds(to_timestamp(F.col("text"), df.schema["text"].dataType)).alias("epoch"))


# The SQL that tables take part in unchanged: events, orders and lineitem are stored tables, the others are views

_DATED = (("events", "ts", "1 day"), ("orders", "o_orderdate", "30 day"), ("lineitem", "l_shipdate", "30 day"))
_databases: dict[tuple, Session] = {}
#: Bytes, as shuffled, that a task of these queries gets: a window query sorts them once for each order, all in memory.
_ADVISED, _ADVISED_BYTES = "spark.sql.adaptive.advisoryPartitionSizeInBytes", 8 << 20


def database(spark: SparkSession, sf_dir: str, text: str) -> Session:
    """A session over stored tables that queries only read, and views of the tables without dates.

    A table is stored when a query first names it: a query pays for the tables that it reads, and for no others. A
    session that doesn't set what a task gets from a shuffle gets a size that the tasks' sorts can hold.
    """
    if spark.conf.get(_ADVISED, None) is None:
        spark.conf.set(_ADVISED, str(_ADVISED_BYTES))
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _databases:
        _databases[key] = Session(spark, scratch(spark, "database"))
    db, words = _databases[key], set(re.findall(r"\w+", blanked(text).lower()))
    for name, column, interval in _DATED:
        if name in words and name not in db.tables:
            df = read(spark, sf_dir, name)
            table = PartitionedTable.create(spark, f"{db.root}/{name}", TableSpec.from_schema(df.schema, column, interval))
            table.append(df)
            db.tables[name] = table
    for name in ("customer", "nation", "supplier", "part"):
        read(spark, sf_dir, name).createOrReplaceTempView(name)
    return db


def sql(name: str, text: str, oracle: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: database(spark, sf_dir, text).sql(text)
    ORACLE[name] = oracle or text


sql("join_inner", "select o_orderkey, c_name, c_mktsegment from orders join customer on o_custkey = c_custkey where o_totalprice > 200000")
sql("join_left", "select c_custkey, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey group by c_custkey")
sql("join_full", "select s_suppkey, n_nationkey from (select * from supplier where s_acctbal > 5000) s full outer join (select * from nation where n_nationkey < 10) n on s_nationkey = n_nationkey")
sql("join_semi", "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 300000)")
sql("join_anti", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)")
sql("join_theta", "select a.n_nationkey as a, b.n_nationkey as b from nation a join nation b on a.n_nationkey < b.n_nationkey and a.n_regionkey = b.n_regionkey")
sql("agg_group", "select l_returnflag, l_linestatus, cast(round(sum(l_quantity), 2) as double) as qty, round(avg(l_discount), 6) as disc, count(*) as n from lineitem group by l_returnflag, l_linestatus")
sql("agg_having", "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 12")
sql("agg_distinct", "select event_type, count(distinct user_id) as users from events group by event_type")
sql("agg_filter", "select event_type, count(*) filter (where value > 250) as high, min(value) as low, max(value) as top from events group by event_type")
sql("agg_rollup", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by rollup (l_returnflag, l_linestatus)")
sql("agg_cube", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by cube (l_returnflag, l_linestatus)")
sql("agg_subquery", "select count(*) as n from (select user_id from events group by user_id having count(*) > 50) t")
sql("win_rank", "select o_orderkey, rank() over (partition by o_custkey order by o_totalprice desc) as r, dense_rank() over (partition by o_custkey order by o_orderdate) as d from orders")
sql("win_lag", "select event_id, lag(event_id) over (partition by user_id order by ts, event_id) as before, lead(event_id) over (partition by user_id order by ts, event_id) as after from events")
sql("win_running", "select event_id, count(*) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as n from events")
sql("win_ntile", "select o_orderkey, ntile(4) over (partition by o_orderstatus order by o_orderkey) as q from orders")
sql("set_union", "select user_id from events where event_type = 'view' union select user_id from events where event_type = 'click'")
sql("set_intersect", "select user_id from events where value > 400 intersect select user_id from events where value < 20")
sql("set_except", "select c_custkey from customer except select o_custkey from orders where o_totalprice > 400000")
sql("join_right", "select n_nationkey, s_suppkey from (select * from supplier where s_acctbal > 8000) s right join nation on s_nationkey = n_nationkey")
sql("join_cross", "select a.n_nationkey as a, b.event_type as b from nation a cross join (select distinct event_type from events where ts < '2024-01-03') b")
sql("join_interval", "select a.event_id as a, b.event_id as b from events a join events b on a.user_id = b.user_id and b.ts > a.ts and b.ts <= a.ts + interval 30 minutes where a.ts >= '2024-01-05' and a.ts < '2024-01-08'", "select a.event_id as a, b.event_id as b from events a join events b on a.user_id = b.user_id and b.ts > a.ts and b.ts <= a.ts + interval 30 minute where a.ts >= '2024-01-05' and a.ts < '2024-01-08'")
sql("agg_grouping_sets", "select l_returnflag, l_linestatus, count(*) as n, cast(grouping(l_returnflag) as int) as g from lineitem group by grouping sets ((l_returnflag), (l_linestatus), ())")
sql("agg_total", "select coalesce(sum(value), 0.0) as total, round(max(value), 6) as top from events where event_type = 'no such type'", "select coalesce(sum(value), 0.0::double) as total, round(max(value), 6) as top from events where event_type = 'no such type'")
sql(
    "agg_approximate", "select event_type, abs(approx_count_distinct(user_id, 0.02) - count(distinct user_id)) <= 0.1 * count(distinct user_id) as near, abs(approx_percentile(value, 0.5, 10000) - median(value)) < 5 as middle from events group by event_type",
    "select event_type, true as near, true as middle from events group by event_type",
)
sql("set_union_all", "select user_id from events where event_type = 'view' union all select user_id from events where event_type = 'click'")
sql("set_intersect_all", "select user_id from events where value > 250 intersect all select user_id from events where value < 250")
sql("set_except_all", "select user_id from events except all select user_id from events where event_type = 'view'")
sql("win_values", "select event_id, first_value(event_id) over w as first, last_value(event_id) over w as last, nth_value(event_id, 2) over w as second from events window w as (partition by user_id order by ts, event_id rows between 2 preceding and 2 following)")
sql("win_range", "select o_orderkey, count(*) over (partition by o_custkey order by o_totalprice range between 50000 preceding and 50000 following) as n, round(percent_rank() over (partition by o_custkey order by o_orderkey), 6) as pr, round(cume_dist() over (partition by o_custkey order by o_orderkey), 6) as cd from orders")
sql(
    "scalar_dates_json", "select event_id, date_trunc('hour', ts) as h, cast(date_add(cast(ts as date), 3) as timestamp_ntz) as d, cast(get_json_object(props, '$.k') as int) as k, size(split(props, ' ')) as parts, date_format(ts, 'yyyy-MM') as month from events",
    "select event_id, date_trunc('hour', ts) as h, (ts::date + 3)::timestamp as d, (props->>'$.k')::int as k, len(string_split(props, ' ')) as parts, strftime(ts, '%Y-%m') as month from events",
)
sql(
    "scalar_collections", "select event_id, element_at(array(event_type, 'x'), 1) as a, array_contains(array('view', 'click'), event_type) as b, map('t', event_type)['t'] as m, greatest(value, 250.0) as g, if(value > 250, 'high', 'low') as i from events",
    "select event_id, [event_type, 'x'][1] as a, list_contains(['view', 'click'], event_type) as b, map(['t'], [event_type])['t'] as m, greatest(value, 250.0) as g, case when value > 250 then 'high' else 'low' end as i from events",
)
sql("cte_topk", "with t as (select user_id, count(*) as n from events group by user_id) select user_id, n from t order by n desc, user_id limit 10")
sql("scalar_functions", "select event_id, upper(event_type) as up, length(props) as len, substr(event_type, 1, 3) as head, abs(value - 250) as off, coalesce(nullif(event_type, 'view'), 'none') as kind from events")
sql(
    "group_concat", "select n_regionkey, array_join(array_sort(collect_list(n_name)), ',') as names from nation group by n_regionkey",
    "select n_regionkey, string_agg(n_name, ',' order by n_name) as names from nation group by n_regionkey",
)


@query("select count(*) as n, round(sum(o_totalprice), 2) as total from orders join lineitem on o_orderkey = l_orderkey where o_orderdate >= '1996-02-01' and o_orderdate < '1996-03-01'")
def join_pruned(spark, sf_dir):
    d = field("o_orderdate")
    orders = Overlay(read(spark, sf_dir, "orders"), "o_orderdate", "1 day").scan((d >= "1996-02-01") & (d < "1996-03-01"))
    joined = orders.join(read(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select count(*) as n from events where ts::date in (select ts::date from events where value > 489.9)")
def join_dpp(spark, sf_dir):
    table = stored(spark, sf_dir)
    days = events(spark, sf_dir, "1 day").scan(field("value") > 489.9, window=True).select("_p").distinct()
    return table.scan(window=True).join(days, "_p", "left_semi").agg(F.count(F.lit(1)).alias("n"))


@query("select event_id, ts from events")
def stream_append(spark, sf_dir):
    df = read(spark, sf_dir, "events")
    table = PartitionedTable.create(spark, scratch(spark, "streamed"), TableSpec.from_schema(df.schema, "ts", "1 day"))
    stream = spark.readStream.schema(df.schema).parquet(f"{sf_dir.rstrip('/')}/events.parq*")
    stream_into(table, stream, scratch(spark, "progress")).awaitTermination()
    return table.scan().select("event_id", "ts")


@query("select count(*) as n from events where ts >= '2024-01-02' and ts < '2024-01-04'")
def partitions_listed(spark, sf_dir):
    table = stored(spark, sf_dir)
    within = Bounds.of(*(Span(p, p) for p in table.partitions(1704153600, 1704240000)))
    return one(spark, n=table._segments("data", None, within).count())


def session(spark, sf_dir) -> Session:
    db = Session(spark, scratch(spark, "db"))
    df = read(spark, sf_dir, "events")
    PartitionedTable.create(spark, f"{db.root}/ev", TableSpec.from_schema(df.schema, "ts", "1 day", lifetime=7 * DAY)).append(df)
    return db


@query("select event_type, count(*) as n from events where ts >= '2024-01-05' and ts < '2024-01-07 06:00' group by event_type")
def sql_range(spark, sf_dir):
    return session(spark, sf_dir).sql("select event_type, count(*) as n from ev where ts >= '2024-01-05' and ts < '2024-01-07 06:00' group by event_type")


@query("select a.event_id, b.user_id from events a join events b on a.ts = b.ts where a.ts >= '2024-01-05' and a.ts < '2024-01-06'")
def sql_join_bounds_inferred(spark, sf_dir):
    return session(spark, sf_dir).sql("select a.event_id, b.user_id from ev a join ev b on a.ts = b.ts where a.ts >= '2024-01-05' and a.ts < '2024-01-06'")


@query("select event_id, case when ts < '2024-01-03' then 'old' else event_type end as event_type from events where not (event_type = 'view' and ts >= '2024-01-10')")
def sql_changes(spark, sf_dir):
    db = session(spark, sf_dir)
    db.sql("delete from ev where event_type = 'view' and ts >= '2024-01-10'")
    db.sql("update ev set event_type = 'old' where ts < '2024-01-03'")
    return db.sql("select event_id, event_type from ev")


@query("select count(*) as n from events where ts >= '2024-01-05' and ts < '2024-01-08'")
def sql_count_between(spark, sf_dir):
    return session(spark, sf_dir).sql("select windrow_count_between('ev', '2024-01-05', '2024-01-08') as n")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks per hour of one day."""
    where = (TS >= "2024-01-05") & (TS < "2024-01-06") & (field("event_type") == "click")
    return events(spark, sf_dir).stats(where).orderBy("p")


QUERIES["flagship"] = flagship
ORACLE["flagship"] = (
    "select epoch_us(ts) // 1000000 - (epoch_us(ts) // 1000000) % 3600 as p, count(*) as row_count from events "
    "where ts >= '2024-01-05' and ts < '2024-01-06' and event_type = 'click' group by 1"
)
