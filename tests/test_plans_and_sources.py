"""Vendor mapping, connector, findings, cards, digests, streams, API and command line."""

import json
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from larkspur import cli
from larkspur.api import Service
from larkspur.plans import cards, digest, findings
from larkspur.sources import vendor, vendor_source
from larkspur.streaming import incremental

CARD = {"title": "T", "severity": "high", "finding": "f", "evidence": "e", "action": "a", "confidence": 0.8, "category": "retention"}


def mapped(spark, event="x", props=None, who="u", when="2026-01-02T03:04:05Z"):
    rows = spark.createDataFrame([("id1", event, who, when, props if props is None or isinstance(props, str) else json.dumps(props))], "uuid string, event string, distinct_id string, timestamp string, properties string")
    return vendor.map_vendor_events(rows, "t").first()


def test_vendor_mapping(spark):
    r = mapped(spark, "$pageview", {"$current_url": "http://x/y", "$pathname": "/y", "$device_type": "Mobile", "$geoip_country_code": "de", "plan": "pro", "n": {"a": [1]}, "flag": True, "none": None, "$os": "x", "$group_type": "company", "$group_key": "k"})
    assert (r["event_type"], r["device_type"], r["country"], r["page_path"], r["user_id"]) == ("pageview", "mobile", "DE", "/y", "u")
    assert r["properties"] == {"$geoip_country_code": "de", "plan": "pro", "n": '{"a":[1]}', "flag": "true", "none": ""} and (r["group_type"], r["group_id"]) == ("company", "k")
    assert r["timestamp"] == datetime(2026, 1, 2, 3, 4, 5)
    r = mapped(spark, "$identify", {"$anon_distinct_id": "anon", "$set": {"p": 1}, "$set_once": {"q": "z"}})
    assert (r["event_type"], r["user_id"], r["anonymous_id"], r["user_properties_set"], r["user_properties_set_once"]) == ("identify", "u", "anon", {"p": "1"}, {"q": "z"})
    r = mapped(spark, "x", {"$process_person_profile": "false", "$group_2": "g"})
    assert (r["user_id"], r["anonymous_id"], r["group_type"], r["group_id"]) == ("", "u", "group_2", "g")
    r = mapped(spark, "$groupidentify", {"$group_set": {"s": "1"}}, when="1767322800000")
    assert r["group_properties"] == {"s": "1"} and r["event_type"] == "group_identify" and r["timestamp"] == datetime(2026, 1, 2, 3, 0)
    r = mapped(spark, None, "{bad", who=None)
    assert (r["event_name"], r["user_id"], r["properties"], r["device_type"]) == ("unknown", "", {}, "unknown")


RETENTION = {"metric": "retention", "date_range": {"start": "2026-02-01", "end": "2026-03-15"}, "total_users": 500, "overall_retention": {"D1": 0.4, "D30": 0.2, "D7": 0.04}, "best_cohort": {"key": "a", "dimension": "w"}, "worst_cohort": {"key": "b", "dimension": "w"}}
ANOMALY = {"date_range": {"start": "2026-01-01", "end": "2026-03-31"}, "total_data_points": 30, "anomalies": [{"metric": "dau", "date": "2026-02-02", "value": 5.0, "expected": 9.0, "sigma_distance": 4.0, "direction": "down", "severity": "critical", "pct_change": -0.44}, {"sigma_distance": 1.0}]}
FEATURES = {"date_range": {}, "total_users": 300, "top_features": [{"name": "g", "users": 60, "events": 9, "impact": {"D7": 0.1}, "net_score": 0.1}, {"name": "tiny", "users": 60, "impact": {}, "net_score": 0.01}], "negative_features": [{"name": "bad", "users": 25, "impact": {"D7": -0.1}, "net_score": -0.05}]}


def test_findings_rank_and_freshness():
    f = findings.build_findings(RETENTION, ANOMALY, FEATURES)
    d = f.to_dict()
    assert d["freshness"]["date_range"] == {"start": "2026-01-01", "end": "2026-03-31"} and d["freshness"]["user_count"] == 500 and d["freshness"]["event_count"] == 30
    scores = [x["rank_score"] for x in d["findings"]]
    assert scores == sorted(scores, reverse=True) and len(scores) == 6
    assert next(x for x in f.findings if x["title"] == "Overall retention")["severity"] == "critical"  # the greatest key as text is D7
    assert findings.retention_severity({"D1": 0.4, "D30": 0.2, "D7": 0.04}, numeric=True) == "medium"
    assert [findings.rank_score(s, c, i) for s, c, i in (("critical", 1, 1), ("high", 0.8, 0.5), ("critical", 1, 0))] == pytest.approx([1.0, 0.32, 0.1])
    assert "dau fell by 44%" in f.prompt_context() and findings.build_findings().freshness["modules_missing"] == list(findings.MODULES)
    assert findings.build_findings(anomalies={"anomalies": [{"sigma_distance": "inf", "pct_change": "inf", "metric": "m"}]}).findings[0]["confidence"] == 1.0


def test_cards_cache_and_errors(tmp_path):
    fenced = "```json\n" + json.dumps([CARD, {"title": "x"}, CARD | {"confidence": 0.1}, CARD | {"severity": "odd"}]) + "\n```"
    assert len(cards.parse_cards(fenced)) == 2 and cards.parse_cards("no json") == [] and len(cards.parse_cards(json.dumps({"cards": [CARD]}))) == 1
    calls = []
    w = cards.CardWriter(lambda system, user: calls.append(user) or fenced, "m", cache=cards.AnswerCache(tmp_path))
    a, b = w.write({"x": 1, "generated_at": "1"}, "ctx"), w.write({"x": 1, "generated_at": "2"}, "ctx")
    assert len(a["cards"]) == 1 and not a["cached"] and b["cached"] and len(calls) == 1 and w.cache.size == 1 and w.cache.clear() == 1
    dry = w.write({}, "ctx", dry_run=True)
    assert dry["cards"] == [] and dry["token_usage"] == {"input": len(w.prompt.system) + len(w.prompt.user.format(context="ctx")), "output": 0} and a["token_usage"] is None
    short = cards.AnswerCache(tmp_path / "short", ttl=1)
    short.put("k", "v")
    assert short.get("k") == "v" and cards.AnswerCache(tmp_path / "short").get("k") == "v" and cards.AnswerCache(tmp_path / "ever", ttl=0).get("none") is None
    short._run("update answers set ends = 1")
    assert short.get("k") is None and short.size == 0
    told = cards.CardWriter(lambda system, user: (fenced, {"input": 3, "output": 4})).write({}, "")
    assert told["token_usage"] == {"input": 3, "output": 4} and len(told["cards"]) == 1
    with pytest.raises(RuntimeError):
        cards.CardWriter().write({}, "")
    with pytest.raises(ValueError):
        cards.prompt("v9")


def test_digest_rendering_and_delivery(tmp_path, capsys):
    many = [cards.Card.of(CARD | {"title": s, "severity": s}) for s in ("info", "critical", "<b>high" and "high", "low")]
    d = digest.compose(many, {"freshness": {"date_range": {"start": "a", "end": "b"}}}, digest.DigestOptions(tenant_name="Acme", feedback_url="http://f", evidence_url="http://e"))
    assert [x["card"]["title"] for x in d["insights"]] == ["critical", "high", "low"] and d["period"] == "a — b" and d["insights"][0]["feedback_url"] == "http://f?insight=1"
    assert "## 1. 🔴 critical" in digest.to_markdown(d) and "Acme" in digest.to_html(d) and digest.to_slack(d)["blocks"][0]["type"] == "header"
    with pytest.raises(ValueError):
        digest.DigestOptions(frequency="hourly")
    assert digest.compose([], None, digest.DigestOptions(frequency="monthly"))["period"] == "Monthly"
    assert digest.NOTHING in digest.to_markdown(digest.compose([])) and digest.NOTHING in digest.to_html(digest.compose([]))
    assert "&lt;i&gt;" in digest.to_html(digest.compose([cards.Card.of(CARD | {"title": "<i>"})]))

    def post(address, payload):
        if address == "http://boom":
            raise OSError("down")
        return 500 if address == "http://bad" else 200

    r = digest.deliver(d, [digest.Channel("slack", "http://ok"), digest.Channel("slack", "http://bad"), digest.Channel("slack", "http://boom"), digest.Channel("email", "http://ok", ("a@x", "b@x")), digest.Channel("markdown", str(tmp_path / "d.md")), digest.Channel("odd"), digest.Channel("markdown", "stdout")], post)
    assert [x["success"] for x in r] == [True, False, False, True, True, True, False, True] and "## 1." in capsys.readouterr().out and r[2]["error"] == "down" and (tmp_path / "d.md").exists()


def test_events_without_a_source_id_are_kept_and_a_page_read_twice_is_not(spark):
    rows = [(None, "a", "u", "2026-01-02T00:00:00Z", "{}"), (None, "b", "u", "2026-01-02T00:00:00Z", "{}"), ("", "b", "v", "2026-01-02T00:00:00Z", '{"k":1}'), ("", "b", "v", "2026-01-02T00:00:00Z", '{"k":2}'), ("id1", "c", "u", "2026-01-02T00:00:00Z", "{}")]
    raw = spark.createDataFrame(rows, vendor_source.RAW)
    once = vendor.map_vendor_events(raw, "t")
    twice = vendor.map_vendor_events(raw.union(raw).repartition(3), "t")
    ids = {r["event_id"] for r in once.collect()}
    assert len(ids) == 5 and {r["event_id"] for r in vendor.drop_repeats(twice).collect()} == ids and vendor.drop_repeats(twice).count() == 5
    assert not ids & {r["event_id"] for r in vendor.map_vendor_events(raw, "other").collect()}


def stream_rows(spark, n, start=0):
    t = datetime(2026, 1, 1)
    rows = [("t", str(i % 7), f"u{i % 3}", "track", t + timedelta(minutes=i), (t + timedelta(minutes=i)).date(), "s", "", 0.0, 0.0) for i in range(start, start + n)]
    return spark.createDataFrame(rows, "tenant_id string, event_id string, user_id string, event_type string, timestamp timestamp, event_date date, session_id string, ai_model string, ai_quality_score double, ai_cost_usd double")


def test_streams(spark, tmp_path):
    from larkspur.operators.metrics import merge_daily

    stream_rows(spark, 20).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = incremental.read_stream(spark, str(tmp_path / "in"), stream_rows(spark, 1).schema)
    q = incremental.write_partials(incremental.distinct_events(source), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    got = merge_daily(spark.read.parquet(str(tmp_path / "out")), ["event_date"]).first()
    assert (got["events"], got["users"]) == (7, 3)
    q = incremental.windowed_activity(source, "10 minutes").writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["events"] for r in spark.table("w").collect()) == [10, 10]
    assert incremental.recent(stream_rows(spark, 20), 7, "2026-01-08 00:10:00").count() == 10


def test_expiry_drops_old_months(spark, tmp_path):
    rows = spark.createDataFrame([("t", "202501", 1), ("t", "202601", 2)], "tenant_id string, event_month string, x int")
    rows.write.partitionBy("tenant_id", "event_month").parquet(str(tmp_path / "e"))
    assert incremental.expire(spark, str(tmp_path / "e"), "202601") == ["event_month=202501"] and spark.read.parquet(str(tmp_path / "e")).count() == 1


@pytest.fixture(scope="module")
def events_file(tmp_path_factory):
    path = tmp_path_factory.mktemp("api") / "e.jsonl"
    lines = [{"user_id": f"u{i}", "event_date": str(date(2026, 1, 1) + timedelta(days=d)), "event_name": "a" if i % 2 else "b"} for i in range(30) for d in range(0, 40, 1 + i % 5)]
    path.write_text("\n".join(map(json.dumps, lines)))
    return str(path)


def test_api(spark, events_file, tmp_path):
    s = Service(spark, events_file, feedback=str(tmp_path / "f.jsonl"))
    assert s.health()["users"] == 30
    o = s.get("overview")
    assert o["total_users"] == 30 and len(o["dau_series"]) == 40 and s.get("overview") is o
    assert s.get("retention")["metric"] == "retention" and s.get("churn")["total_users"] == 30 and s.get("activation")["metric"] == "activation_discovery"
    assert s.get("retention", periods="2,5")["periods"] == [2, 5] and s.get("retention")["periods"] == [1, 7, 30] and s.get("features", periods="3")["periods"] == ["D3"]
    asked = s.get("activation", window="3", retention_period="10")
    assert (asked["activation_window_days"], asked["retention_period_days"]) == (3, 10)
    assert s.get("churn", end="2026-01-20")["analysis_date"] == "2026-01-20" and s.get("churn")["metric"] == "churn_prediction" and s.get("anomalies")["metric"] == "anomaly_detection"
    with pytest.raises(ValueError):
        s.get("overview", "soon")
    small = Service(spark, events_file, keep=2)
    for end in ("2026-01-03", "2026-01-04", "2026-01-05"):
        small.get("anomalies", end=end)
    assert len(small._results) == 2
    early = Service(spark, events_file)
    early.preload()
    assert early._events is not None and len(early._results) == 1
    nothing = Service(spark, str(tmp_path / "none.jsonl"))
    nothing.preload()  # its failure is the first request's
    assert nothing.get("anomalies")["total_data_points"] == 1 and nothing.get("overview")["dau_series"] == []
    assert s.get("insights")["cards"] == [] and "stats_summary" in s.get("insights")
    assert s.get("overview", "2026-01-01", "2026-01-02")["date_range"]["end"] <= "2026-01-02"
    assert json.dumps(s.get("anomalies")) and s.get("features")["periods"] == ["D7", "D30"]
    said = s.feedback({"insight_rank": "1", "vote": "useful", "tenant_id": "acme"})
    assert said == {"status": "ok", "recorded": {"tenant_id": "acme", "insight_rank": 1, "vote": "useful", "timestamp": date.today().isoformat()}}
    with pytest.raises(KeyError):
        s.get("nothing")


def test_command_line(spark, events_file, tmp_path, capsys):
    assert cli.main(["run", "--events", events_file, "--dry-run"]) == 0
    assert json.loads(capsys.readouterr().out)["schema_version"] == "1.0.0"
    assert cli.main(["run", "--events", events_file, "--output", str(tmp_path / "d.md")]) == 0 and (tmp_path / "d.md").read_text().startswith("# Product insights")
    assert cli.main(["run", "--events", str(tmp_path / "none.jsonl")]) == 1
    assert timezone.utc


def test_http_server_and_clients(spark, events_file, tmp_path):
    import threading
    from urllib.error import HTTPError
    from urllib.request import urlopen

    from larkspur.api import serve
    from larkspur.sources.http import json_post, message_model, status_post

    server = serve(Service(spark, events_file, feedback=str(tmp_path / "f.jsonl")), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"
    try:
        with urlopen(f"{base}/api/health") as answer:
            assert json.loads(answer.read())["users"] == 30
        post = json_post(base)
        assert post("/api/feedback", {"insight_rank": 1, "vote": "useful"})[0] == 200 and post("/api/feedback?insight_rank=2&vote=not_useful&tenant_id=t", {})[1]["recorded"]["tenant_id"] == "t"
        assert post("/api/feedback", {"insight_rank": 1, "vote": "meh"})[0] == 400 and post("/api/feedback", {"vote": "useful"})[0] == 400 and status_post()(f"{base}/nothing", {}) == 404
        for path, status in (("/api/overview?start_date=soon", 400), ("/api/retention?periods=x", 400), ("/api/nothing", 404)):
            with pytest.raises(HTTPError) as told:
                urlopen(base + path)
            assert told.value.code == status
    finally:
        server.shutdown()
        server.server_close()
    with pytest.raises(ConnectionError):
        post("/api/feedback", {})
    tool = message_model(lambda p, b: (200, {"content": [{"type": "tool_use", "input": {"cards": [CARD]}}]}), "/m", "x", cards.CARD_SCHEMA)
    assert len(cards.parse_cards(tool("s", "u")[0])) == 1
    assert message_model(lambda p, b: (200, {"content": [{"type": "text", "text": "hi"}], "usage": {"input_tokens": 1, "output_tokens": 2}}), "/m", "x")("s", "u") == ("hi", {"input": 1, "output": 2})
    with pytest.raises(ConnectionError):
        message_model(lambda p, b: (500, {}), "/m", "x")("s", "u")
    assert cli.main(["version"]) == 0 and cli.main(["run"]) == 1
