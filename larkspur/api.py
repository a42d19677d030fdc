"""The analyses as JSON, with a result cache; and a small HTTP server over it."""

from __future__ import annotations

import json
import logging
import os
import threading
import time
from collections.abc import Callable
from datetime import date
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.activation import activation_summary
from larkspur.operators.anomaly import anomaly_summary
from larkspur.operators.churn import churn_summary
from larkspur.operators.features import feature_summary
from larkspur.operators.metrics import dau_points, dau_series
from larkspur.operators.retention import retention_summary
from larkspur.plans.cards import CardWriter
from larkspur.plans.findings import build_findings
from larkspur.schema import normalize_events
from larkspur.sources.readers import append_feedback, load_events


def _day(text: str) -> str:
    return str(date.fromisoformat(text))


def _periods(text: str) -> list[int]:
    return [int(p) for p in text.split(",")]


class Service:
    """Endpoints over one event file or table; up to ``keep`` results are kept ``ttl`` seconds, the table cached in Spark.

    max_users: users that are sampled from a CSV file; None: all.
    """

    #: Parameters of each endpoint beside start_date, end_date and tenant_id, with how they are read and their defaults.
    PARAMETERS: dict[str, dict[str, tuple[Callable, object]]] = {
        "overview": {}, "retention": {"periods": (_periods, [1, 7, 30]), "cohort_column": (str, None)}, "features": {"periods": (_periods, [7, 30])}, "insights": {}, "churn": {}, "anomalies": {}, "health": {},
        "activation": {"window": (int, 7), "retention_period": (int, 30)},
    }

    def __init__(self, spark: SparkSession, path: str, ttl: float = 300, writer: CardWriter | None = None, feedback: str = "feedback.jsonl", max_users: int | None = None, keep: int = 256):
        self.spark, self.path, self.ttl, self.writer, self.feedback_path, self.max_users, self.keep = spark, path, ttl, writer, feedback, max_users, keep
        self._results: dict[str, tuple[float, dict]] = {}
        self._events: DataFrame | None = None
        self._lock, self._kept = threading.Lock(), threading.Lock()

    @classmethod
    def from_environment(cls, spark: SparkSession, **options: Any) -> Service:
        """EVENTS_FILE (empty if unset), MAX_USERS (all if unset) and FEEDBACK_DIR (this folder)."""
        most = os.environ.get("MAX_USERS")
        folder = os.environ.get("FEEDBACK_DIR", ".")
        return cls(spark, os.environ.get("EVENTS_FILE", ""), feedback=os.path.join(folder, "feedback.jsonl"), max_users=int(most) if most else None, **options)

    def events(self) -> DataFrame:
        with self._lock:
            if self._events is None:
                self._events = normalize_events(load_events(self.spark, self.path, self.max_users)).persist()
            return self._events

    def _rows(self, start: str | None, end: str | None, tenant: str | None) -> DataFrame:
        rows = self.events()
        if tenant and "tenant_id" in rows.columns:
            rows = rows.filter(F.col("tenant_id") == tenant)
        if start:
            rows = rows.filter(F.col("event_date") >= F.to_date(F.lit(start)))
        return rows.filter(F.col("event_date") <= F.to_date(F.lit(end))) if end else rows

    def _anomalies(self, rows: DataFrame) -> dict:
        return anomaly_summary(dau_points(rows).withColumn("metric", F.lit("dau")))

    def overview(self, rows: DataFrame) -> dict:
        n = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("u"), F.min("event_date").alias("a"), F.max("event_date").alias("b")).first()
        days = dau_series(rows).orderBy("date").collect()  # one row a day
        anomalies = self._anomalies(rows)["anomaly_count"] if len(days) >= 4 else 0
        values = [r["value"] for r in days]
        return {"total_events": n["n"], "total_users": n["u"], "date_range": {"start": str(n["a"]), "end": str(n["b"])}, "dau_series": [{"date": str(r["date"]), "dau": int(r["value"])} for r in days], "anomaly_count": anomalies, "avg_dau": round(sum(values) / len(values), 1) if values else 0.0}

    def findings(self, rows: DataFrame):  # noqa: ANN201
        return build_findings(retention_summary(rows, [1, 7, 30]), self._anomalies(rows), feature_summary(rows))

    def insights(self, rows: DataFrame) -> dict:
        found = self.findings(rows)
        if self.writer is None or self.writer.model is None:
            return {"cards": [], "note": "no language model is configured", "stats_summary": found.to_dict()}
        out = self.writer.write(found.to_dict(), found.prompt_context())
        return out | {"cards": [c.to_dict() for c in out["cards"]]}

    def health(self) -> dict:
        n = self.events().agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("u")).first()
        return {"status": "ok", "events_loaded": n["n"], "users": n["u"]}

    def _compute(self, name: str, rows: DataFrame, end: str | None, p: dict) -> dict:
        calls: dict[str, Callable[[], dict]] = {
            "overview": lambda: self.overview(rows), "retention": lambda: retention_summary(rows, p["periods"], p["cohort_column"]), "features": lambda: feature_summary(rows, p["periods"], min_feature_users=5), "insights": lambda: self.insights(rows),
            "churn": lambda: churn_summary(rows, end), "activation": lambda: activation_summary(rows, p["window"], p["retention_period"], min_adopters=5), "anomalies": lambda: self._anomalies(rows), "health": self.health,
        }
        return calls[name]()

    def get(self, name: str, start: str | None = None, end: str | None = None, tenant: str | None = None, **asked: str) -> dict:
        """The answer of an endpoint of PARAMETERS; KeyError for another name, ValueError for a parameter that cannot be read.

        Unknown parameters are ignored. Churn is analysed as of ``end``, or of the last event.
        """
        known = self.PARAMETERS[name]
        start, end = (_day(x) if x else None for x in (start, end))
        values = {key: read(asked[key]) if key in asked else default for key, (read, default) in known.items()}
        key, now = json.dumps([name, start, end, tenant, values]), time.monotonic()
        with self._kept:
            at, result = self._results.get(key, (0.0, None))
        if result is None or now - at > self.ttl:
            result = self._compute(name, self._rows(start, end, tenant), end, values)
            with self._kept:
                self._results[key] = (time.monotonic(), result)
                for old in sorted(self._results, key=lambda k: self._results[k][0])[: max(0, len(self._results) - self.keep)]:
                    del self._results[old]
        return result

    def preload(self) -> None:
        """Load the events and answer "health" ahead of the first request; what fails here fails again there, with its answer."""
        try:
            self.get("health")
        except Exception as problem:  # noqa: BLE001  a server without its events still answers
            logging.getLogger(__name__).warning("preloading failed: %s", problem)

    def feedback(self, asked: dict) -> dict:
        """Record a vote: insight_rank, vote, tenant_id (default) and comment."""
        return {"status": "ok", "recorded": append_feedback(self.feedback_path, int(asked["insight_rank"]), asked.get("vote", ""), asked.get("tenant_id", "default"), asked.get("comment", ""))}


def serve(service: Service, host: str = "127.0.0.1", port: int = 8000, preload: bool = False) -> ThreadingHTTPServer:
    """A server for /api/<name> (GET) and /api/feedback (POST, parameters in the address or as a JSON body); call
    serve_forever() on what it returns. 404: unknown name; 400: parameters that cannot be read; 500: anything else.
    preload: the events are loaded in the background from now on."""
    if preload:
        threading.Thread(target=service.preload, daemon=True).start()

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, status: int, body: dict) -> None:
            data = json.dumps(body, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Access-Control-Allow-Origin", "*")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _try(self, act: Callable[[dict], dict | None]) -> None:
            asked = {k: v[0] for k, v in parse_qs(urlsplit(self.path).query).items()}
            try:
                found = act(asked)
            except (KeyError, TypeError, ValueError) as problem:
                return self._answer(400, {"error": str(problem)})
            except Exception as problem:  # noqa: BLE001  a request must get an answer
                return self._answer(500, {"error": f"{type(problem).__name__}: {str(problem)[:500]}"})
            self._answer(404, {"error": "not found"}) if found is None else self._answer(200, found)

        def do_GET(self) -> None:
            name = urlsplit(self.path).path.removeprefix("/api/")

            def act(asked: dict) -> dict | None:
                if name not in service.PARAMETERS:
                    return None
                return service.get(name, asked.pop("start_date", None), asked.pop("end_date", None), asked.pop("tenant_id", None), **asked)

            self._try(act)

        def do_POST(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            self._try(lambda asked: service.feedback((json.loads(body) if body.strip() else {}) | asked) if urlsplit(self.path).path == "/api/feedback" else None)

        def log_message(self, *args: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
