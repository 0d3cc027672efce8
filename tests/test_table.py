import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from windrow.errors import ColumnTypeMismatch, CommitConflict, CompanionError, MatchRequiresCompanion, PartitionColumnError, TableError, TimestampParseError, WhereClauseError
from windrow.operators.companions import Companion, register_companion
from windrow.plans.predicates import field
from windrow.sources import table as storage
from windrow.sources.manifest import Files, commit, load
from windrow.sources.scratch import scratch
from windrow.sources.table import PartitionedTable

HOURLY = "1 hour, col1 timestamp partition_column, col2 text"
C1, C2 = field("col1"), field("col2")
NOON = 1704110400  # 2024-01-01 12:00


def make(spark, spec=HOURLY, rows=()):
    table = PartitionedTable.create(spark, scratch(spark, "test"), spec)
    if rows:
        table.append(spark.createDataFrame([r if isinstance(r, tuple) else (r, "x") for r in rows], "col1 string, col2 string"))
    return table


def at(*times, day="2024-01-01"):
    return [f"{day} {t}" for t in times]


def counts(table):
    return {r["p"]: r["row_count"] for r in table.stats().collect()}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def times(df):
    return [r["col1"].strftime("%H:%M") for r in df.collect()]


def test_create_and_metadata(spark):
    table = make(spark, "1 hour, lifetime 1 day, col1 timestamp partition_column, col2 text")
    assert table.root().first().asDict() == {"partition_column": "col1", "partition_value": 3600, "lifetime": 86400}
    assert table.lookup().columns == ["partition_table", "partition_value", "expires_at"]
    assert table.stats().columns == ["partition_table", "p", "row_count"]
    assert table.template().count() == 0 and table.scan().count() == 0 and table.partition_count() == 0
    with pytest.raises(TableError):
        PartitionedTable.create(spark, table.path, HOURLY)


def test_count_between(spark):
    table = make(spark, rows=at("12:15", "12:30", "13:15"))
    assert table.count_between("2024-01-01 12:00", "2024-01-01 14:00") == 3
    assert table.count_between(NOON, NOON + 3600) == 2
    for bad in (("2024-01-01 12:15", "2024-01-01 14:00"), ("2024-01-01 14:00", "2024-01-01 12:00"), ("2024-01-01 12:00",) * 2):
        with pytest.raises(WhereClauseError):
            table.count_between(*bad)


def test_inserts(spark):
    table = make(spark)
    table.insert([{"col1": "2024-01-01", "col2": "a"}, {"col1": "2024-01-01 12:15"}, {"col1": NOON}])
    assert table.scan().count() == 3
    for bad in ({"col2": "x"}, {"col1": None}):
        with pytest.raises(PartitionColumnError):
            table.insert([bad])
    with pytest.raises(TimestampParseError):
        table.insert([{"col1": "not-a-timestamp"}])
    with pytest.raises(TableError):
        table.insert([{"col1": NOON, "col9": 1}])
    with pytest.raises(Exception, match="no point in time in col1"):
        table.append(spark.createDataFrame([("nope", "x")], "col1 string, col2 string"))
    with pytest.raises(PartitionColumnError):
        table.append(spark.createDataFrame([("x",)], "col2 string"))
    assert table.scan().count() == 3


def test_routing(spark):
    rows = ["2024-02-01", *at("11:00", "12:00", "13:00", "14:00", "15:00", "15:30", "16:00", "17:00", "18:00", day="2024-02-02")]
    assert make(spark, rows=rows).partition_count() == 9
    assert make(spark, HOURLY.replace("hour", "day"), rows).partition_count() == 2
    assert counts(make(spark, rows=at("12:15", "12:45", "13:15"))) == {NOON: 2, NOON + 3600: 1}


def test_before_1970_and_far_ahead(spark):
    table = make(spark, rows=["1969-12-31 23:59:58", "2999-01-01 11:00"])
    assert table.partitions() == [-3600, 32472183600]
    assert table.scan(C1 < "1970-01-01").count() == 1 and table.scan(C1 > "2500-01-01").count() == 1


@pytest.mark.parametrize(
    ("rows", "where", "n"),
    [
        (("12:15", "12:45", "13:15"), C1 > "2024-01-01 12:30", 2),
        (("12:00", "12:30", "13:00"), C1 >= "2024-01-01 12:00", 3),
        (("12:15", "13:15"), C1 < "2024-01-01 13:00", 1),
        (("12:15", "13:15"), (C1 >= "2024-01-02") & (C1 < "2024-01-01"), 0),
        (("12:15", "13:15", "14:00"), C1.isin("2024-01-01 12:15", "2024-01-01 14:00", "2024-01-05"), 2),
        (("12:15", "13:15", "14:00"), C1.between("2024-01-01 13:00", "2024-01-01 14:00"), 2),
        (("12:15", "13:15", "14:00"), (C1 > "2024-01-01 13:30") | (C1 < "2024-01-01 13:00"), 2),
        (("12:15", "13:15"), C1.is_("2024-01-01 12:15") | C2.is_null(), 1),
        (("12:15",), C1.like("%12:15%") & C1.is_not_null(), 1),
    ],
)
def test_selects(spark, rows, where, n):
    assert make(spark, rows=at(*rows)).scan(where).count() == n


def test_pruning_reads_only_the_windows_it_needs(spark):
    table = make(spark, rows=at("12:15", "13:15", "14:15"))
    files = table.scan(C1 < "2024-01-01 13:00", window=True).select(F.input_file_name().alias("f"), "_p").distinct().collect()
    assert [r["_p"] for r in files] == [NOON]
    found = table.scan(C1 < "2024-01-01 13:00")
    assert "PushedFilters: [IsNotNull(col1)" in plan(found)
    # The list of files itself holds that window's alone.
    assert {f"_p={NOON}" in f for f in found.inputFiles()} == {True} and len(table.scan().inputFiles()) >= 3
    table.files.delete(f"data/_v={table.manifest.windows[NOON + 3600].segments[0]}/_p={NOON + 3600}")
    assert table.scan(C1 < "2024-01-01 13:00").count() == 1


def test_invalid_literal(spark):
    with pytest.raises(TimestampParseError):
        make(spark, rows=at("12:15")).scan(C1 > "not-a-timestamp")


def test_drop(spark):
    table = make(spark, HOURLY.replace("hour", "day"), [f"2024-02-{d:02d}" for d in range(1, 11)])
    assert [r["partition_table"] for r in table.lookup().collect()] == [f"test_{1706745600 + 86400 * i}" for i in range(10)]
    assert [r["col1"].day for r in table.scan(C1 > "2024-02-09").collect()] == [10]
    table.drop()
    with pytest.raises(TableError):
        PartitionedTable.load(spark, table.path)


def test_update_in_place(spark):
    table = make(spark, rows=at("12:00", "14:00"))
    assert table.update(C1 > "2024-01-01 13:00", {"col2": "new"}) == 1
    assert {r["col1"].hour: r["col2"] for r in table.scan().collect()} == {12: "x", 14: "new"}
    assert table.update(C2 == "none", {"col2": "y"}) == 0


def test_update_that_moves(spark):
    table = make(spark, rows=at("12:15"))
    table.update(C1 == "2024-01-01 12:15", {"col1": "2024-01-01 13:15"})
    assert counts(table) == {NOON: 0, NOON + 3600: 1}
    assert table.partition(NOON).count() == 0 and times(table.scan()) == ["13:15"]
    with pytest.raises(Exception, match="no point in time"):
        table.update(C2 == "x", {"col1": None})
    assert counts(table) == {NOON: 0, NOON + 3600: 1}


def test_delete(spark):
    table = make(spark, rows=at("12:15", "12:45", "13:15"))
    assert table.delete(C1 == "2024-01-01 12:15") == 1
    assert counts(table) == {NOON: 1, NOON + 3600: 1}
    assert table.delete(C1 >= "2024-01-01 13:00") == 1
    assert counts(table) == {NOON: 1, NOON + 3600: 0} and table.scan().count() == 1


def test_cleanup(spark):
    table = make(spark, "1 hour, lifetime 1 day, col1 timestamp partition_column, col2 text", [*at("12:15"), "2999-01-01 11:00"])
    assert {r["partition_value"]: r["expires_at"] for r in table.lookup().collect()}[NOON] == NOON + 3600 + 86400
    assert table.cleanup(now=NOON + 3600 + 86400 - 1) == 0 and table.cleanup(now=NOON + 3600 + 86400) == 1
    assert table.partitions() == [32472183600] and table.scan().count() == 1
    table.set_expiry(32472183600, 0)
    assert table.expired(1) == [32472183600] and table.cleanup() == 1 and table.total_rows() == 0
    assert make(spark, rows=at("12:15")).cleanup() == 0


def test_late_rows_make_a_window_that_has_expired(spark):
    table = make(spark, "1 hour, lifetime 1 hour, col1 timestamp partition_column, col2 text", at("12:15"))
    assert table.cleanup() == 1
    table.insert([{"col1": "2024-01-01 12:20"}])
    assert table.scan().count() == 1 and table.cleanup() == 1


def test_orders(spark):
    rows = list(zip(at("13:30", "12:45", "14:10", "12:15", "13:05", "14:05", day="2024-02-01"), "ebjadi"))
    table = make(spark, rows=rows)
    assert table.partition_count() == 3
    assert times(table.scan(order="asc")) == ["12:15", "12:45", "13:05", "13:30", "14:05", "14:10"]
    assert times(table.scan(order="desc"))[0] == "14:10" and times(table.latest(2)) == ["14:10", "14:05"]
    assert times(table.latest(3)) == ["14:10", "14:05", "13:30"] and len(times(table.latest(99))) == 6
    assert times(table.scan((C1 >= "2024-02-01 12:30") & (C1 < "2024-02-01 14:00"), "asc")) == ["12:45", "13:05", "13:30"]
    assert [r["col2"] for r in table.scan().orderBy(F.desc("col2")).collect()] == list("jiedba")
    assert {f"_p={table.partitions()[-1]}/" in f for f in table.latest(2).inputFiles()} == {True} and "TakeOrderedAndProject" in plan(table.latest(2))


def test_estimate(spark):
    table = make(spark, rows=at("12:15", "12:45", "13:15"))
    assert table.estimate(low=NOON, high=NOON + 3600) == (2, 3)
    assert table.estimate(C1 == "2024-01-01 12:20") == (1, 2)


def test_transactions(spark):
    table = make(spark, rows=at("12:15"))
    with pytest.raises(RuntimeError), table.transaction():
        table.delete(C2 == "x")
        table.insert([{"col1": NOON}])
        raise RuntimeError
    assert table.scan().count() == 1
    version = table.manifest.version
    with table.transaction():
        table.delete(C2 == "x")
        table.insert([{"col1": NOON, "col2": "y"}])
        assert [r["col2"] for r in table.scan().collect()] == ["y"]
    assert table.manifest.version == version + 1 and [r["col2"] for r in table.scan().collect()] == ["y"]
    table.insert([{"col1": NOON}])
    table.rollback()
    assert table.scan().count() == 1


def test_reload_and_conflict(spark):
    table = make(spark, rows=at("12:15"))
    other = PartitionedTable.load(spark, table.path)
    table.append(spark.createDataFrame([("2024-01-01 12:20", "y")], "col1 string, col2 string"))
    assert other.scan().count() == 2
    manifest = load(Files(spark, table.path))
    with pytest.raises(CommitConflict):
        commit(Files(spark, table.path), manifest)


def second_writer(monkeypatch, table, rows):
    """A second writer appends rows while the next change of the table is being written."""
    other, write, df = PartitionedTable.load(table.spark, table.path), table._write, table.spark.createDataFrame([(r, "late") for r in rows], "col1 string, col2 string")

    def interrupted(*args):
        monkeypatch.setattr(table, "_write", write)
        out = write(*args)
        other.append(df)
        return out

    monkeypatch.setattr(table, "_write", interrupted)


CHANGES = {"update": lambda t: t.update(C2 == "x", {"col2": "new"}), "delete": lambda t: t.delete((C2 == "x") & (C1 < "2024-01-01 12:20")), "compact": lambda t: t.compact()}


@pytest.mark.parametrize("change", sorted(CHANGES))
def test_rows_of_a_second_writer_are_kept(spark, monkeypatch, change):
    def table():
        out = make(spark, rows=at("12:15", "12:30"))
        out.append(spark.createDataFrame([("2024-01-01 12:45", "x")], "col1 string, col2 string"))
        return out

    elsewhere = table()
    second_writer(monkeypatch, elsewhere, at("14:15"))
    CHANGES[change](elsewhere)  # another window: both changes stand
    assert sorted(times(elsewhere.scan())) == [t for t in ("12:15", "12:30", "12:45", "14:15") if change != "delete" or t != "12:15"]
    assert counts(elsewhere) == {NOON: 3 - (change == "delete"), NOON + 7200: 1}
    here = table()
    second_writer(monkeypatch, here, at("12:50"))
    folders = here.files.names("data")
    with pytest.raises(CommitConflict):
        CHANGES[change](here)
    assert sorted(times(here.scan())) == ["12:15", "12:30", "12:45", "12:50"] and {r["col2"] for r in here.scan().collect()} == {"x", "late"}
    assert len(here.files.names("data")) == len(folders) + 1  # the other writer's; the failed change left nothing
    CHANGES[change](here)
    assert sum(counts(here).values()) == here.scan().count()


def test_appends_and_transactions_beside_a_second_writer(spark, monkeypatch):
    table = make(spark, rows=at("12:15"))
    second_writer(monkeypatch, table, at("12:20"))
    table.append(spark.createDataFrame([("2024-01-01 12:45", "x")], "col1 string, col2 string"))
    assert sorted(times(table.scan())) == ["12:15", "12:20", "12:45"]
    folders = table.files.names("data")
    with pytest.raises(CommitConflict), table.transaction():
        table.delete(C2 == "late")
        table.append(spark.createDataFrame([("2024-01-01 12:46", "x")], "col1 string, col2 string"))
        PartitionedTable.load(spark, table.path).set_expiry(NOON, 5)
    assert sorted(times(table.scan())) == ["12:15", "12:20", "12:45"] and sorted(table.files.names("data")) == sorted(folders)


def test_old_frames_still_read_until_vacuum(spark):
    table = make(spark, rows=at("12:15", "13:15"))
    before = table.scan()
    table.update(C1 < "2024-01-01 13:00", {"col2": "new"})
    table.drop_partition(NOON + 3600)
    assert sorted(r["col2"] for r in before.collect()) == ["x", "x"] and [r["col2"] for r in table.scan().collect()] == ["new"]
    assert table.vacuum() == 0 and table.vacuum(retain=0) == 2 and table.vacuum(retain=0) == 0
    assert [r["col2"] for r in table.scan().collect()] == ["new"] and len(table.files.names("data")) == 1
    assert PartitionedTable.load(spark, table.path).manifest.struck == {}


def test_ordered_scans_need_no_shuffle(spark):
    table = make(spark, rows=at("14:15", "12:45", "13:15", "12:15", "13:05"))
    table.append(spark.createDataFrame([("2024-01-01 12:30", "y")], "col1 string, col2 string"))
    ordered = ["12:15", "12:30", "12:45", "13:05", "13:15", "14:15"]
    assert times(table.scan(order="asc")) == ordered and times(table.scan(order="desc")) == ordered[::-1]
    assert times(table.scan(C1 < "2024-01-01 13:10", order="desc")) == ["13:05", "12:45", "12:30", "12:15"]
    assert "Exchange" not in plan(table.scan(order="desc")) and "_p" in table.scan(order="asc", window=True).columns
    assert times(table.scan(order="desc").limit(2)) == ["14:15", "13:15"]
    assert make(spark).scan(order="asc").count() == 0


def test_values_that_do_not_suit_their_column(spark):
    table = PartitionedTable.create(spark, scratch(spark, "typed"), "1 hour, ts timestamp partition_column, n int, x float, t text")
    table.insert([{"ts": NOON, "n": 7, "x": 1, "t": "a"}, {"ts": NOON, "n": None, "x": 2.5}])
    for bad in ({"n": "7"}, {"n": 1 << 63}, {"n": True}, {"x": "a"}, {"t": 5}):
        with pytest.raises(ColumnTypeMismatch):
            table.insert([{"ts": NOON} | bad])
    assert table.scan().count() == 2


def test_bloom_filters_and_sorting_let_files_be_skipped(spark):
    import pyarrow.parquet as pq

    df = spark.range(4000).selectExpr("timestamp_ntz'2024-01-01 12:00' as col1", "cast(id * 7919 % 4001 as string) as col2")
    table = make(spark)
    table.alter_layout(sort_within=("col2",), bloom=("col2",))
    table.append(df)
    file = pq.ParquetFile(table.scan().inputFiles()[0].removeprefix("file:").replace("//", "/"))
    column = file.metadata.row_group(0).column(1)
    assert column.path_in_schema == "col2" and file.read(["col2"])["col2"].to_pylist() == sorted(file.read(["col2"])["col2"].to_pylist())
    plain = make(spark)
    plain.append(df)
    size = lambda t: sum(len(open(f.removeprefix("file:"), "rb").read()) for f in t.scan().inputFiles())
    assert size(table) > size(plain)  # the filter is in the file
    assert table.scan(C2 == "17").count() == 1 and table.scan(C2 == "nothing").count() == 0


def rows_read(df):
    """Rows that the scan of a query gave, after files' statistics and filters had their say."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value()


def test_indexes_go_to_every_window_and_skip(spark):
    rows = spark.range(3000).selectExpr("timestamp_ntz'2024-01-01 12:00' + make_dt_interval(0, id % 3) as col1", "cast(id * 7919 % 9001 as string) as col2")
    plain, indexed = make(spark), make(spark)
    indexed.create_index("by_text", "col2")
    for table in (plain, indexed):
        table.append(rows)
    held = {r["col2"] for r in rows.collect()}
    absent = next(str(n) for n in range(1000, 9000) if str(n) not in held)  # between the least and the greatest, so only the filters tell
    assert rows_read(plain.scan(C2 == absent)) > 0 and rows_read(indexed.scan(C2 == absent)) < rows_read(plain.scan(C2 == absent)) / 2
    assert indexed.scan(C2 == "7919").count() == plain.scan(C2 == "7919").count() == 1
    late = spark.createDataFrame([("2024-02-01 10:00", t) for t in ("a", "c", "e")], "col1 string, col2 string")
    indexed.append(late)  # a window made after the index has it, too
    assert rows_read(indexed.scan(C2 == "b")) == 0
    plain.create_index("later", "col2", "col1")
    assert rows_read(plain.scan(C2 == absent)) > 0  # files already written stay as they are
    assert [tuple(r) for r in PartitionedTable.load(spark, plain.path).indexes().collect()] == [("later", "col2, col1")]
    for bad in (lambda: plain.create_index("later", "col2"), lambda: plain.create_index("x", "none"), lambda: plain.drop_index("none")):
        with pytest.raises(TableError):
            bad()
    plain.drop_index("later")
    assert plain.indexes().count() == 0


def test_a_companion_drives_its_own_scans(spark):
    class Longest(Companion):
        def drives_scan(self, column):
            return column in self.synced

        def scan(self, rows, column, wanted, k, condition, order=(), **options):
            rows = rows if condition is None else rows.filter(condition)
            return rows.orderBy(F.desc(F.length(column)), *order).limit(k)

    register_companion("longest", Longest)
    table = PartitionedTable.create(spark, scratch(spark, "driven"), HOURLY + ", companion x USING longest(col2)")
    table.append(spark.createDataFrame([(NOON_TEXT, "a" * n) for n in (1, 5, 3)], "col1 string, col2 string"))
    assert [len(r["col2"]) for r in table.knn("col2", None, 2).collect()] == [5, 3]


NOON_TEXT = "2024-01-01 12:00"


def test_a_reader_far_behind_catches_up(spark):
    table = make(spark, rows=at("12:15"))
    other = PartitionedTable.load(spark, table.path)
    for i in range(14):
        table.set_expiry(NOON, i)
    assert other.manifest.version == table.manifest.version and other.expired(13) == [NOON]


def test_batches_are_added_once(spark):
    table = make(spark)
    rows = spark.createDataFrame([("2024-01-01 12:20", "y")], "col1 string, col2 string")
    assert table.append(rows, batch="a") == 1 and table.append(rows, batch="a") == 0 and table.append(rows, batch="b") == 1
    numbered = [table.append(rows, batch=("s", n)) for n in (0, 1, 1, 0)]
    assert numbered == [1, 1, 0, 0] and PartitionedTable.load(spark, table.path).manifest.batches["s"] == 1
    table.delete(C2 == "y")
    table.append(rows), table.append(rows)
    assert counts(table) == {NOON: 2}
    table.compact()
    assert len(table.manifest.windows[NOON].segments) == 1 and counts(table) == {NOON: 2} and table.scan().count() == 2


def test_layout_options_affect_new_files(spark):
    table = make(spark, rows=at("12:15"))
    table.alter_layout(sort_within=("col2",), bloom=("col2",))
    table.append(spark.createDataFrame([(f"2024-01-01 12:{i:02d}", f"k{i}") for i in range(50)], "col1 string, col2 string"))
    assert PartitionedTable.load(spark, table.path).spec.bloom == ("col2",) and table.scan(C2 == "k7").count() == 1
    with pytest.raises(TableError):
        table.alter_layout(interval=5)


def test_text_compat(spark):
    from windrow.sources.spec import parse_spec

    table = PartitionedTable.create(spark, scratch(spark, "text"), parse_spec(HOURLY, text_compat=True))
    table.insert([{"col1": "2024-01-01 12:00:00", "col2": "a"}, {"col1": "2024-01-01 12:30", "col2": "b"}])
    assert table.scan(C1 == "2024-01-01 12:00").count() == 0 and table.scan(C1 > "2024-01-01 12:15").count() == 1


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["append", "delete", "move", "set"]), st.integers(0, 5)), min_size=1, max_size=4))
def test_random_changes_keep_the_counts(spark, steps):
    table = make(spark, rows=at("12:15", "13:15", "14:15", "14:45"))
    model = [(12 * 60 + 15, "x"), (13 * 60 + 15, "x"), (14 * 60 + 15, "x"), (14 * 60 + 45, "x")]
    clock = lambda m: f"2024-01-01 {m // 60:02d}:{m % 60:02d}"
    for what, n in steps:
        cut = 12 * 60 + 30 * n
        if what == "append":
            table.append(spark.createDataFrame([(clock(cut), "n")], "col1 string, col2 string"))
            model.append((cut, "n"))
        elif what == "delete":
            table.delete(C1 < clock(cut))
            model = [r for r in model if r[0] >= cut]
        elif what == "move":
            table.update(C1 >= clock(cut), {"col1": F.col("col1") + F.expr("interval 1 hour")})
            model = [(m + 60 if m >= cut else m, c) for m, c in model]
        else:
            table.update(C1 >= clock(cut), {"col2": "s"})
            model = [(m, "s" if m >= cut else c) for m, c in model]
    rows = table.scan().collect()
    assert sorted((r["col1"].hour * 60 + r["col1"].minute + 1440 * (r["col1"].day - 1), r["col2"]) for r in rows) == sorted(model)
    real = {r["_p"]: r["n"] for r in table.scan(window=True).groupBy("_p").agg(F.count("*").alias("n")).collect()}
    assert {p: n for p, n in counts(table).items() if n} == real


MIRROR = HOURLY + ", companion mirror USING mirror(col2)"


def mirrored(table):
    return sorted((r["col2"], r["_p"]) for r in table.companion("mirror").collect())


def test_mirror(spark):
    table = make(spark, MIRROR, list(zip(at("10:00", "10:30", "11:00"), "abc")))
    ten, eleven, noon = 1704103200, 1704106800, NOON
    assert mirrored(table) == [("a", ten), ("b", ten), ("c", eleven)]
    table.update(C2 == "b", {"col2": "b2"})
    assert mirrored(table) == [("a", ten), ("b2", ten), ("c", eleven)]
    table.delete(C2 == "b2")
    assert mirrored(table) == [("a", ten), ("c", eleven)]
    table.update(C2 == "a", {"col1": "2024-01-01 12:00"})
    assert mirrored(table) == [("a", noon), ("c", eleven)]
    assert table.companion_declarations().first()["module"] == "mirror"


def test_mirror_is_purged(spark):
    table = make(spark, MIRROR.replace("1 hour,", "1 hour, lifetime 1 day,"), [("2024-01-01", "old"), ("2999-01-01", "live")])
    assert table.cleanup() == 1 and [r["col2"] for r in table.companion("mirror").collect()] == ["live"]


def test_companion_errors(spark):
    with pytest.raises(CompanionError):
        make(spark, HOURLY + ", companion x USING nothing(col2)")
    with pytest.raises(CompanionError):
        make(spark, HOURLY + ", companion x USING mirror(other)")

    class Counting(Companion):
        rows = 0

        def on_rows_written(self, rows, path):
            Counting.rows += rows.count()

    register_companion("counting", Counting)
    make(spark, HOURLY + ", companion x USING counting(col2)", at("12:15", "12:30"))
    assert Counting.rows == 2


def vectors(spark, spec="1 hour", more=()):
    table = PartitionedTable.create(spark, scratch(spark, "vec"), f"{spec}, col1 timestamp partition_column, emb text, col2 text, companion vec USING vec0(emb float[4])")
    rows = [("2024-01-01 10:00", "[1,0,0,0]", "a"), ("2024-01-01 10:30", "[0.9,0.1,0,0]", "b"), ("2024-01-01 11:00", "[0,0,1,0]", "c"), *more]
    table.append(spark.createDataFrame(rows, "col1 string, emb string, col2 string"))
    return table


def test_knn(spark):
    table = vectors(spark)
    found = table.knn("emb", "[1,0,0,0]", 3).collect()
    assert [r["col2"] for r in found] == ["a", "b", "c"] and found[0]["distance"] == 0.0 and found[0]["k"] is None
    assert [r["distance"] for r in found] == sorted(r["distance"] for r in found)
    assert [r["col2"] for r in table.knn("emb", [1, 0, 0, 0], 1).collect()] == ["a"]
    window = (C1 >= "2024-01-01 10:15") & (C1 < "2024-01-01 11:00")
    assert [r["col2"] for r in table.knn("emb", [1, 0, 0, 0], 3, window).collect()] == ["b"]
    assert [r["col2"] for r in table.knn("emb", [1, 0, 0, 0], 1, window).collect()] == []
    assert [r["col2"] for r in table.knn("emb", [1, 0, 0, 0], 1, window, mode="pre").collect()] == ["b"]
    assert [r["col2"] for r in table.knn("emb", [0, 0, 1, 0], 3, C1 < "2024-01-01 11:00").collect()] == ["b", "a"]
    assert [r["col2"] for r in table.knn("emb", [0, 0, 1, 0], 1, metric="cosine").collect()] == ["c"]
    assert [r["col2"] for r in table.knn("emb", [0, 0, 1, 0], 1, metric="l1").collect()] == ["c"]


@pytest.mark.parametrize("size", [3, 200])
def test_distances(spark, size):
    import math

    from windrow.operators.knn import METRICS, distance

    a, b = [float(i % 7) for i in range(size)], [float((i * i) % 5) - 1 for i in range(size)]
    row = spark.createDataFrame([(a, None)], "v array<float>, n array<float>").select(*(distance(F.col("v"), b, m).alias(m) for m in METRICS), distance(F.col("n"), b).alias("null")).first()
    zero = spark.sql("select array(0.0, 0.0) as v").select(distance(F.col("v"), [1.0, 2.0], "cosine").alias("d")).first()
    assert row["null"] is None and zero["d"] is None
    assert math.isclose(row["l2"], math.dist(a, b)) and math.isclose(row["l1"], sum(abs(x - y) for x, y in zip(a, b)))
    assert math.isclose(row["cosine"], 1 - sum(x * y for x, y in zip(a, b)) / math.hypot(*a) / math.hypot(*b))


def test_knn_after_changes(spark):
    table = vectors(spark)
    table.update(C2 == "c", {"emb": "[0.8,0,0,0]"})
    table.delete(C2 == "a")
    assert [r["col2"] for r in table.knn("emb", [1, 0, 0, 0], 3).collect()] == ["b", "c"]


def test_knn_errors(spark):
    table = vectors(spark)
    for k in (None, 0, -1, "3"):
        with pytest.raises(CompanionError):
            table.knn("emb", [1, 0, 0, 0], k)
    with pytest.raises(MatchRequiresCompanion):
        table.knn("col2", [1.0], 1)
    for bad in ({"mode": "x"}, {"metric": "x"}):
        with pytest.raises(WhereClauseError):
            table.knn("emb", [1, 0, 0, 0], 1, **bad)
    with pytest.raises(WhereClauseError):
        table.knn("emb", "[1,", 1)


def test_knn_skips_null_and_odd_vectors(spark):
    table = vectors(spark, more=[("2024-01-01 10:05", None, "n"), ("2024-01-01 10:06", "[1]", "short"), ("2024-01-01 10:07", "junk", "junk")])
    assert [r["col2"] for r in table.knn("emb", [1, 0, 0, 0], 9).collect()] == ["a", "b", "c"]


def test_vectors_go_with_their_window(spark):
    table = vectors(spark, "1 hour, lifetime 1 day", [("2999-01-01 11:00", "[1,1,0,0]", "live")])
    assert table.cleanup() == 2 and [r["col2"] for r in table.knn("emb", [1, 0, 0, 0], 3).collect()] == ["live"]
    table.drop_partition(32472183600)
    assert table.knn("emb", [1, 0, 0, 0], 3).count() == 0


def test_views(spark):
    table = make(spark, rows=at("12:15", "13:15"))
    table.create_view("seen")
    assert spark.sql("select count(*) as n from seen where col1 > '2024-01-01 13:00'").first()["n"] == 1
    assert spark.sql("select sum(row_count) as n from seen_stats").first()["n"] == 2
    assert spark.sql("select partition_value from seen_root").first()[0] == 3600


def test_streams(spark, sf):
    from windrow.streaming import stream_into, windowed_counts

    df = spark.read.parquet(f"{sf}/events.parquet")
    table = PartitionedTable.create(spark, scratch(spark, "streamed"), "1 day, event_id int, ts timestamp partition_column, user_id int, event_type text, value float, props text")
    progress = scratch(spark, "progress")
    for _ in range(2):  # the second run finds nothing new
        stream_into(table, spark.readStream.schema(df.schema).parquet(f"{sf}/events.parq*"), progress).awaitTermination()
    assert table.scan().count() == df.count()
    late = PartitionedTable.create(spark, scratch(spark, "late"), "1 day, lifetime 1 day, event_id int, ts timestamp partition_column, user_id int, event_type text, value float, props text")
    stream_into(late, spark.readStream.schema(df.schema).parquet(f"{sf}/events.parq*"), scratch(spark, "progress"), drop_late_before=1705708800).awaitTermination()
    assert late.partitions()[0] + 2 * 86400 > 1705708800
    counted = windowed_counts(df, "ts", 86400).collect()
    assert {r["p"]: r["row_count"] for r in counted} == counts(table)
    assert dt.datetime.fromtimestamp(min(counts(table)), dt.UTC).date() == dt.date(2024, 1, 1)


def test_data_source_prunes_by_plain_sql(spark):
    from windrow.sources.datasource import WindrowDataSource

    spark.dataSource.register(WindrowDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    table = make(spark, rows=list(zip(at("12:15", "12:45", "13:15", "14:15"), "abcd")))
    spark.read.format("windrow").load(table.path).createOrReplaceTempView("by_source")
    assert sorted(r["col2"] for r in spark.sql("select col2 from by_source").collect()) == list("abcd")
    table.files.delete(f"data/_v={table.manifest.windows[NOON + 7200].segments[0]}/_p={NOON + 7200}")
    early = spark.sql("select col2 from by_source where col1 < timestamp_ntz'2024-01-01 14:00:00' and col2 <> 'b'")
    assert sorted(r["col2"] for r in early.collect()) == ["a", "c"]
    table.drop_partition(NOON)
    assert spark.read.format("windrow").load(table.path).filter("col1 < timestamp_ntz'2024-01-01 13:00:00'").count() == 0


def test_a_large_window_is_written_by_several_tasks(spark, monkeypatch):
    """What a task of a write sorts is bounded, whatever a window holds; the session's own setting stays."""
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    monkeypatch.setattr(storage, "TASK_BYTES", 100_000, raising=False)
    rows = spark.range(40_000, numPartitions=4).select(F.lit("2024-01-01 12:15").alias("col1"), F.sha2(F.col("id").cast("string"), 256).alias("col2"))
    for own in (None, "32m"):
        if own:
            spark.conf.set(name, own)
        try:
            table = PartitionedTable.create(spark, scratch(spark, "large"), HOURLY)
            table.append(rows)
            assert spark.conf.get(name, None) == own
        finally:
            spark.conf.unset(name)
        files = [r["count"] for r in table.scan().groupBy(F.input_file_name()).count().collect()]
        assert sum(files) == 40_000 and len(files) > 1 and max(files) < 40_000
        assert table.scan().distinct().count() == 40_000
