"""Digests of the most important cards: composing, rendering, delivery."""

from __future__ import annotations

import html
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path

from larkspur.plans.cards import Card
from larkspur.plans.findings import SEVERITY_WEIGHTS

FREQUENCIES = ("daily", "weekly", "monthly")
MARKS = {"critical": "🔴", "high": "🟠", "medium": "🟡", "low": "🔵", "info": "⚪"}
NOTHING = "Nothing needs your attention in this period."


@dataclass
class DigestOptions:
    max_insights: int = 3
    frequency: str = "weekly"
    tenant_name: str | None = None
    feedback_url: str | None = None
    evidence_url: str | None = None

    def __post_init__(self) -> None:
        if self.frequency not in FREQUENCIES:
            raise ValueError(f"frequency must be one of {FREQUENCIES}")


def compose(cards: list[Card], findings: dict | None = None, options: DigestOptions | None = None, prompt_version: str | None = None, model: str | None = None) -> dict:
    """The top cards by severity weight times confidence, with links and the period."""
    o = options or DigestOptions()
    ranked = sorted(cards, key=lambda c: -SEVERITY_WEIGHTS.get(c.severity, 0.1) * c.confidence)[: o.max_insights]
    span = ((findings or {}).get("freshness") or {}).get("date_range") or {}
    period = f"{span['start']} — {span['end']}" if span.get("start") and span.get("end") else o.frequency.capitalize()
    return {
        "generated_at": datetime.now(timezone.utc).isoformat(), "period": period, "date_range": {"start": span.get("start"), "end": span.get("end")}, "tenant_name": o.tenant_name, "frequency": o.frequency,
        "total_findings": len(cards), "insights_shown": len(ranked), "prompt_version": prompt_version, "model": model,
        "insights": [
            {
                "rank": i, "rank_score": round(SEVERITY_WEIGHTS.get(c.severity, 0.1) * c.confidence, 4), "card": c.to_dict(),
                "feedback_url": f"{o.feedback_url}?insight={i}" if o.feedback_url else None, "evidence_url": f"{o.evidence_url}?category={c.category}" if o.evidence_url else None,
            }
            for i, c in enumerate(ranked, 1)
        ],
    }


def _heading(d: dict) -> str:
    return f"Product insights{' for ' + d['tenant_name'] if d['tenant_name'] else ''}: {d['period']}"


def to_markdown(d: dict) -> str:
    out = [f"# {_heading(d)}", ""]
    if not d["insights"]:
        return "\n".join([*out, NOTHING, ""])
    for x in d["insights"]:
        c = x["card"]
        out += [f"## {x['rank']}. {MARKS[c['severity']]} {c['title']}", "", c["finding"], "", f"**Evidence:** {c['evidence']}", "", f"**Do:** {c['action']}", "", f"Confidence {c['confidence']:.0%}, {c['category']}"]
        if c["estimated_impact"]:
            out.append(f"Estimated impact: {c['estimated_impact']}")
        links = [f"[{name}]({x[key]})" for name, key in (("All evidence", "evidence_url"), ("Was this useful?", "feedback_url")) if x[key]]
        out += ([" | ".join(links)] if links else []) + [""]
    return "\n".join([*out, f"{d['insights_shown']} of {d['total_findings']} findings", ""])


def to_html(d: dict) -> str:
    e = html.escape
    body = f"<p>{NOTHING}</p>" if not d["insights"] else ""
    for x in d["insights"]:
        c = x["card"]
        links = " ".join(f'<a href="{e(x[key])}">{name}</a>' for name, key in (("All evidence", "evidence_url"), ("Was this useful?", "feedback_url")) if x[key])
        impact = f"<p>Estimated impact: {e(c['estimated_impact'])}</p>" if c["estimated_impact"] else ""
        body += f'<div style="margin:16px 0;padding:12px;border-left:4px solid #888"><h2>{x["rank"]}. {MARKS[c["severity"]]} {e(c["title"])}</h2><p>{e(c["finding"])}</p><p><b>Evidence:</b> {e(c["evidence"])}</p><p><b>Do:</b> {e(c["action"])}</p>{impact}<p>Confidence {c["confidence"]:.0%}</p>{links}</div>'
    return f'<html><body style="font-family:sans-serif;max-width:640px;margin:auto"><h1>{e(_heading(d))}</h1>{body}</body></html>'


def to_slack(d: dict) -> dict:
    def section(text: str) -> dict:
        return {"type": "section", "text": {"type": "mrkdwn", "text": text}}

    blocks: list[dict] = [{"type": "header", "text": {"type": "plain_text", "text": _heading(d)[:150]}}]
    if not d["insights"]:
        blocks.append(section(NOTHING))
    for x in d["insights"]:
        c = x["card"]
        blocks += [section(f"{MARKS[c['severity']]} *{x['rank']}. {c['title']}*\n{c['finding']}\n*Evidence:* {c['evidence']}\n*Do:* {c['action']}"), {"type": "divider"}]
    return {"text": _heading(d), "blocks": blocks}


@dataclass
class Channel:
    """kind: slack (target: webhook address), email (webhook address, recipients) or markdown (a path; none, - or stdout prints it)."""

    kind: str
    target: str | None = None
    recipients: tuple[str, ...] = ()


def deliver(d: dict, channels: list[Channel], http_post: Callable[[str, dict], int] | None = None) -> list[dict]:
    """One result for each channel and recipient; a status of 400 or more, or an exception, is a failure with its reason."""
    results = []

    def attempt(channel: Channel, to: str | None, act: Callable[[], str | None]) -> None:
        try:
            error = act()
        except Exception as problem:  # noqa: BLE001  a failed channel must not stop the others
            error = str(problem)
        results.append({"channel": channel.kind, "recipient": to, "success": error is None, "error": error})

    def post(address: str | None, payload: dict) -> str | None:
        if not address or http_post is None:
            return "no address or no http_post was given"
        status = http_post(address, payload)
        return f"status {status}" if status >= 400 else None

    for channel in channels:
        if channel.kind == "slack":
            attempt(channel, channel.target, lambda c=channel: post(c.target, to_slack(d)))
        elif channel.kind == "email":
            for to in channel.recipients or (None,):
                attempt(channel, to, lambda c=channel, to=to: post(c.target, {"to": to, "subject": _heading(d), "html": to_html(d), "text": to_markdown(d)}) if to else "no recipient")
        elif channel.kind == "markdown":

            def write(c: Channel = channel) -> None:
                if c.target in (None, "-", "stdout"):
                    print(to_markdown(d))
                else:
                    Path(c.target).write_text(to_markdown(d), encoding="utf-8")

            attempt(channel, channel.target, write)
        else:
            attempt(channel, channel.target, lambda c=channel: f"unknown channel {c.kind}")
    return results
