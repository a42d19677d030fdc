"""Ranked findings from the analyses' summaries, and the text that a language model gets.

A finding is a dict of the keys in KEYS. RULES say which rows of a summary become findings and how
they are worded and weighed; one loop applies them all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import date, datetime, timezone
from typing import Any, NamedTuple

SCHEMA_VERSION = "1.0.0"
# The weight of a severity, the keys of a finding, and the rates below which retention is severe.
SEVERITY_WEIGHTS = {"critical": 1.0, "high": 0.8, "medium": 0.5, "low": 0.3, "info": 0.1}
KEYS = ("category", "severity", "title", "description", "data", "confidence", "impact_score", "rank_score")
RETENTION_LIMITS = ((0.05, "critical"), (0.15, "high"), (0.30, "medium"))
#: Modules that a complete set of findings draws on.
MODULES = ("retention", "anomaly", "feature_correlation")
TOP_FEATURES = 5


@dataclass(frozen=True)
class Limits:
    """What is too small to tell, and whether retention periods compare as numbers."""

    min_impact: float = 0.02
    min_sigma: float = 2.0
    numeric_periods: bool = False


class Rule(NamedTuple):
    """rows: the rows of a summary that count; the others are functions of one of them, or constants."""

    module: str
    rows: Callable[[dict, Limits], Iterable[dict]]
    severity: Callable[[dict], str] | str
    confidence: Callable[[dict], float] | float
    impact: Callable[[dict], float] | float
    title: str
    description: str


def _number(x: Any) -> float:
    return float(x) if x is not None else 0.0


def rank_score(severity: str, confidence: float, impact: float) -> float:
    return SEVERITY_WEIGHTS[severity] * confidence * max(impact, 0.1)


def retention_severity(overall: dict[str, float], numeric: bool = False) -> str:
    """By the rate of the greatest key; keys compare as text unless ``numeric``."""
    if not overall:
        return "info"
    order = (lambda key: int(key[1:])) if numeric else str
    rate = sorted(overall.items(), key=lambda item: order(item[0]))[-1][1]
    return ([name for limit, name in RETENTION_LIMITS if rate < limit] or ["low"])[0]


def _overall(summary: dict, limits: Limits) -> Iterable[dict]:
    rates = summary.get("overall_retention")
    if rates:
        text = ", ".join(f"{k}: {v:.1%}" for k, v in rates.items())
        yield {"rates": text, "users": summary.get("total_users", 0), "severity": retention_severity(rates, limits.numeric_periods), "_data": rates}


def _cohort(name: str, unlike: str | None = None) -> Callable[[dict, Limits], Iterable[dict]]:
    """The cohort under ``name``, if it is not also the one under ``unlike``."""

    def rows(summary: dict, limits: Limits) -> Iterable[dict]:
        row = summary.get(name)
        if row and not (unlike and (summary.get(unlike) or {}).get("key") == row.get("key")):
            yield {"key": "?", "dimension": "?"} | row | {"_data": row}

    return rows


def _points(summary: dict, limits: Limits) -> Iterable[dict]:
    for row in summary.get("anomalies") or ():
        sigma = _number(row.get("sigma_distance"))
        if sigma >= limits.min_sigma:
            yield {
                "metric": row.get("metric", "?"), "date": row.get("date", "?"), "moved": {"up": "rose"}.get(row.get("direction"), "fell"), "change": abs(_number(row.get("pct_change"))), "sigma": sigma,
                "value": _number(row.get("value")), "expected": _number(row.get("expected")), "severity": row.get("severity"), "_data": row,
            }


def _features(name: str, first: int | None = None) -> Callable[[dict, Limits], Iterable[dict]]:
    def rows(summary: dict, limits: Limits) -> Iterable[dict]:
        for row in (summary.get(name) or [])[:first]:
            net = abs(_number(row.get("net_score")))
            if net >= limits.min_impact:
                effects = ", ".join(f"{k}: {v:+.1%}" for k, v in (row.get("impact") or {}).items())
                yield {"name": row.get("name", "?"), "users": row.get("users", 0), "net": net, "effects": effects, "_data": row}

    return rows


def _share_of(n: float, key: str = "users") -> Callable[[dict], float]:
    return lambda row: min(1.0, row[key] / n)


RULES = (
    Rule("retention", _overall, lambda r: r["severity"], _share_of(100), 0.7, "Overall retention", "Retained users by period: {rates}"),
    Rule("retention", _cohort("best_cohort"), "medium", 0.8, 0.5, "Best cohort: {key}", "{dimension} {key} stays longest"),
    Rule("retention", _cohort("worst_cohort", "best_cohort"), "high", 0.8, 0.6, "Weakest cohort: {key}", "{dimension} {key} leaves soonest; look for the cause"),
    Rule("anomaly", _points, lambda r: "critical" if r["severity"] == "critical" else "high", _share_of(5, "sigma"), _share_of(1, "change"), "{metric} {moved} by {change:.0%} on {date}", "{value:.1f} where {expected:.1f} was expected ({sigma:.1f} deviations)"),
    Rule("feature_correlation", _features("top_features", TOP_FEATURES), "medium", _share_of(50), _share_of(0.2, "net"), "Goes with staying: {name}", "{users} users; effect on retention: {effects}"),
    Rule("feature_correlation", _features("negative_features"), "high", _share_of(50), _share_of(0.2, "net"), "Goes with leaving: {name}", "Its users stay less: {effects}. Check its experience."),
)


def apply_rules(summaries: dict[str, dict], limits: Limits | None = None, rules: tuple[Rule, ...] = RULES) -> list[dict]:
    """The findings by rank_score, best first; equal scores stay in the order of the rules."""
    found = []
    for rule in rules:
        for row in rule.rows(summaries.get(rule.module) or {}, limits or Limits()):
            severity, confidence, impact = (x(row) if callable(x) else x for x in (rule.severity, rule.confidence, rule.impact))
            values = (rule.module, severity, rule.title.format(**row), rule.description.format(**row), row["_data"], confidence, impact, rank_score(severity, confidence, impact))
            found.append(dict(zip(KEYS, values, strict=True)))
    return sorted(found, key=lambda f: f["rank_score"], reverse=True)


@dataclass
class Findings:
    """All findings, best first, with what they rest on."""

    findings: list[dict]
    freshness: dict
    raw: dict[str, dict] = field(default_factory=dict)

    def to_dict(self) -> dict:
        digits = {"confidence": 3, "impact_score": 3, "rank_score": 4}
        return {
            "schema_version": SCHEMA_VERSION, "generated_at": datetime.now(timezone.utc).isoformat(), "freshness": self.freshness,
            "summary": {"finding_count": len(self.findings), "critical_count": sum(f["severity"] == "critical" for f in self.findings), "categories": sorted({f["category"] for f in self.findings})},
            "findings": [f | {k: round(f[k], n) for k, n in digits.items()} for f in self.findings],
        }

    def prompt_context(self, max_findings: int = 15) -> str:
        span = self.freshness["date_range"]
        lines = [f"Period: {span['start']} to {span['end']}", f"Users: {self.freshness['user_count']}", f"Missing analyses: {', '.join(self.freshness['modules_missing']) or 'none'}", ""]
        for i, f in enumerate(self.findings[:max_findings], 1):
            lines += [f"{i}. ({f['severity']}, {f['category']}) {f['title']}", f"   {f['description']}", f"   confidence {f['confidence']:.0%}, impact {f['impact_score']:.2f}"]
        return "\n".join(lines)


def _bound(summaries: Iterable[dict], key: str, pick: Callable) -> str | None:
    """The least or greatest date of the summaries' ranges; what is no date is left out."""
    dates = []
    for s in summaries:
        try:
            dates.append(date.fromisoformat((s.get("date_range") or {}).get(key)))
        except (TypeError, ValueError):
            pass
    return str(pick(dates)) if dates else None


def build_findings(retention: dict | None = None, anomalies: dict | None = None, features: dict | None = None, min_impact: float = 0.02, min_sigma: float = 2.0, numeric_periods: bool = False) -> Findings:
    """Findings of the given summaries.

    Freshness: the widest date range, the greatest user count, and the number of series points as
    event_count.
    """
    raw = {module: s for module, s in zip(MODULES, (retention, anomalies, features), strict=True) if s}
    freshness = {
        "date_range": {"start": _bound(raw.values(), "start", min), "end": _bound(raw.values(), "end", max)}, "event_count": (anomalies or {}).get("total_data_points", 0),
        "user_count": max((s.get("total_users", 0) for m, s in raw.items() if m != "anomaly"), default=0), "modules_available": list(raw), "modules_missing": [m for m in MODULES if m not in raw],
    }
    return Findings(apply_rules(raw, Limits(min_impact, min_sigma, numeric_periods)), freshness, raw)
