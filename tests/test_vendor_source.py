"""The vendor's data source: slices, pages, streams with late rows, pulls into a store; and ids of events."""

import json
import re
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from larkspur.schema import to_table_rows
from larkspur.sources import connector, vendor, vendor_source
from larkspur.streaming import incremental

START, END = "2026-01-01T00:00:00+00:00", "2026-01-06T00:00:00+00:00"


def endpoint(path):
    """A query interface over the rows in a file, which also notes who asked."""

    def post(where, body):
        sql = body["query"]["query"]
        if sql == "SELECT 1":
            return 200, {}
        after, last, before = re.search(r"toString\(uuid\) > '(.*?)'", sql), None, None
        low = re.search(r"timestamp > toDateTime64\('(.*?)'", sql)[1]
        last = after[1]
        before = re.search(r"timestamp < toDateTime64\('(.*?)'", sql)[1]
        with open(path) as file:
            rows = json.load(file)
        with open(path + ".asked", "a") as log:
            import os

            log.write(f"{os.getpid()} {low}\n")
        at = lambda t: datetime.fromisoformat(t)
        found = sorted((r for r in rows if (at(r[3]), r[0]) > (at(low), last) and at(r[3]) < at(before)), key=lambda r: (at(r[3]), r[0]))
        return 200, {"results": found[: int(re.search(r"LIMIT (\d+)", sql)[1])]}

    return post


def rows_of(n, start=0, step=3600):
    first = datetime(2026, 1, 1, tzinfo=timezone.utc)
    return [[f"id{i:04d}", "x", f"u{i % 7}", (first + timedelta(seconds=step * i)).isoformat(), {"k": i}] for i in range(start, start + n)]


@pytest.fixture
def served(tmp_path):
    path = str(tmp_path / "rows.json")

    def put(rows):
        with open(path, "w") as file:
            json.dump(rows, file)

    put(rows_of(110) + [["same1", "y", "u", START, None], ["same2", "y", "u", START, "{bad"], ["same3", "y", "u", START, {}]])
    return path, put, vendor_source.QueryFeed(endpoint(path), "1", batch=2, pause=0.01)


def test_slices_tile_the_time():
    cut = vendor_source.slices(vendor_source.utc("2026-01-01T05:00:00"), vendor_source.utc("2026-01-03T01:00:00"), 86_400)
    assert [(s.start[:13], s.end[:13]) for s in cut] == [("2026-01-01T05", "2026-01-02T00"), ("2026-01-02T00", "2026-01-03T00"), ("2026-01-03T00", "2026-01-03T01")]
    assert vendor_source.slices(vendor_source.utc(START), vendor_source.utc(START), 60) == []
    with pytest.raises(ValueError):
        vendor_source.slices(vendor_source.utc(START), vendor_source.utc(END), 0)


def test_a_batch_is_the_page_loop_in_several_tasks(spark, served):
    path, _, feed = served
    raw = spark.read.format(vendor_source.register_vendor_source(spark, feed)).options(start=START, end=END, slice_seconds=86_400).load()
    assert raw.rdd.getNumPartitions() == 5
    got = sorted(tuple(r) for r in raw.collect())
    want = sorted(tuple(json.dumps(v) if isinstance(v, dict) else v for v in r) for page in feed.rows(vendor_source.utc(START), vendor_source.utc(END)) for r in page)
    assert got == want and len(got) == 113
    asked = [line.split() for line in open(path + ".asked")]
    assert len({a for _, a in asked if a.endswith("T00:00:00+00:00")}) == 5
    empty = spark.read.format(vendor_source.FORMAT).options(start=END, end=END).load()
    assert empty.count() == 0


def run(spark, feed, folder, end):
    events = vendor_source.pull_stream(spark, feed, "t", START, end, slice_seconds=6 * 3600, overlap_seconds=4 * 3600)
    q = events.select("source_event_id", "timestamp").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").start()
    q.processAllAvailable()
    q.stop()
    return sorted(r["source_event_id"] for r in spark.read.parquet(f"{folder}/out").collect())


def test_a_stream_reads_late_rows_and_repeats_nothing_when_started_again(spark, served, tmp_path):
    _, put, feed = served
    put(rows_of(20))
    assert run(spark, feed, tmp_path, "2026-01-01T20:00:00+00:00") == [f"id{i:04d}" for i in range(20)]
    # A row that comes in late, behind the offset but within the overlap, and new ones.
    late = [["late", "x", "u", "2026-01-01T17:30:00+00:00", {}]]
    put(rows_of(30) + late)
    assert run(spark, feed, tmp_path, "2026-01-02T06:00:00+00:00") == [f"id{i:04d}" for i in range(30)] + ["late"]
    # Nothing new: nothing read twice.
    assert run(spark, feed, tmp_path, "2026-01-02T06:00:00+00:00") == [f"id{i:04d}" for i in range(30)] + ["late"]


def test_pulls_into_a_store_with_a_state(spark, served, tmp_path):
    path, put, feed = served
    c = connector.VendorConnector(feed.post, "1", tmp_path / "s.json", batch=3, lookback_days=5)
    store, now = str(tmp_path / "store"), vendor_source.utc(END)
    put(rows_of(119))

    def pull(at):
        since = c.since(at)
        return c.sync(spark, "t", lambda events: connector.append_new(events, store, since), at)

    state = pull(now)
    assert c.validate() and state.rows == 119 and connector.SyncState.load(tmp_path / "s.json") == state
    put(rows_of(140) + [["late", "x", "u", "2026-01-05T23:30:00+00:00", {}]])
    assert pull(now + timedelta(hours=18)).errors == []
    ids = [r["source_event_id"] for r in spark.read.parquet(store).collect()]
    assert sorted(ids) == [*[f"id{i:04d}" for i in range(138)], "late"]
    (tmp_path / "s.json").write_text("{broken")
    assert connector.SyncState.load(tmp_path / "s.json") == connector.SyncState()


def test_a_failed_pull_is_noted_and_read_again(spark, tmp_path):
    def refuse(where, body):
        return 401, {}

    c = connector.VendorConnector(refuse, "1", tmp_path / "s.json", lookback_days=1)
    assert not c.validate()
    with pytest.raises(Exception, match="status 401"):
        c.sync(spark, "t", lambda events: events.collect(), vendor_source.utc(END))
    state = connector.SyncState.load(tmp_path / "s.json")
    assert state.last_timestamp is None and len(state.errors) == 1 and c.since(vendor_source.utc(END)) == vendor_source.utc(END) - timedelta(days=1)


def test_pages_are_asked_for_again():
    calls = []

    def shaky(where, body):
        calls.append(1)
        if len(calls) == 1:
            raise ConnectionError("down")
        return (503, {}) if len(calls) == 2 else (200, {"results": []})

    assert list(vendor_source.QueryFeed(shaky, "1", pause=0.0).rows(vendor_source.utc(START), vendor_source.utc(END))) == [] and len(calls) == 3
    with pytest.raises(ValueError):
        vendor_source.QueryFeed(shaky, "1", batch=0)


def test_no_event_is_lost_by_its_id(spark):
    rows = [("t", i, "u", "x", datetime(2026, 1, 1), {"k": k}) for i, k in ((None, "1"), (None, "2"), ("", "3"), ("a", "4"), ("a", "4"), (None, "1"))]
    events = spark.createDataFrame(rows, "tenant_id string, event_id string, user_id string, event_name string, timestamp timestamp, properties map<string,string>")
    flat = to_table_rows(events)
    ids = {r["event_id"] for r in flat.collect()}
    assert len(ids) == 4 and "" not in ids and "a" in ids
    assert sorted(r["properties"]["k"] for r in vendor.drop_repeats(events).collect()) == ["1", "1", "2", "3", "4"]
    other = events.withColumn("properties", F.map_from_arrays(F.array(F.lit("b"), F.lit("a")), F.array(F.lit("1"), F.lit("2"))))
    turned = events.withColumn("properties", F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("2"), F.lit("1"))))
    assert {r["event_id"] for r in to_table_rows(other).collect()} == {r["event_id"] for r in to_table_rows(turned).collect()}


def test_a_stream_keeps_events_without_an_id(spark, tmp_path):
    rows = [("t", i, datetime(2026, 1, 1, 0, n)) for n, i in enumerate([None, None, "", "a", "a", "b"])]
    schema = "tenant_id string, event_id string, timestamp timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = incremental.distinct_events(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("kept").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(str(r["event_id"]) for r in spark.table("kept").collect()) == ["", "None", "None", "a", "b"]
