"""Command line: events from a file or a vendor to summaries, findings and a digest."""

from __future__ import annotations

import argparse
import json
import os
import sys
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from larkspur import __version__
from larkspur.api import Service, serve
from larkspur.plans.cards import CARD_SCHEMA, DEFAULT_PROMPT, PROMPTS, AnswerCache, Card, CardWriter
from larkspur.plans.digest import FREQUENCIES, Channel, DigestOptions, compose, deliver, to_markdown
from larkspur.session import get_spark
from larkspur.sources.connector import VendorConnector, append_new
from larkspur.sources.http import json_post, message_model, status_post


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="larkspur", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="analyse events; print a digest, or the findings with --dry-run")
    run.add_argument("--tenant", default="default")
    run.add_argument("--tenant-name")
    run.add_argument("--events", help="JSON lines, CSV or Parquet")
    run.add_argument("--vendor-host")
    run.add_argument("--vendor-project", default="")
    run.add_argument("--vendor-key", default=os.environ.get("LARKSPUR_VENDOR_KEY", ""))
    run.add_argument("--lookback-days", type=int, default=90)
    run.add_argument("--sync-state", default="sync_state.json")
    run.add_argument("--store", default="larkspur_events", help="where pulled events are kept")
    run.add_argument("--model-host")
    run.add_argument("--model-key", default=os.environ.get("LARKSPUR_MODEL_KEY", ""))
    run.add_argument("--model", default="")
    run.add_argument("--prompt-version", default=DEFAULT_PROMPT, choices=sorted(PROMPTS))
    run.add_argument("--cache", help="folder of remembered answers")
    run.add_argument("--dry-run", action="store_true")
    run.add_argument("--output", default="-", help="a Markdown file, or - to print")
    run.add_argument("--slack-webhook")
    run.add_argument("--max-insights", type=int, default=3)
    run.add_argument("--frequency", choices=FREQUENCIES, default="weekly")
    web = commands.add_parser("serve", help="answer /api requests about an events file")
    web.add_argument("--events", default=os.environ.get("EVENTS_FILE", ""))
    web.add_argument("--max-users", type=int, default=int(os.environ.get("MAX_USERS") or 0), help="sample so many users of a CSV file; 0: all")
    web.add_argument("--port", type=int, default=8000)
    commands.add_parser("version")
    return parser


def pull(spark: SparkSession, args: argparse.Namespace) -> str:
    """Append what is new at the vendor to the store; return its path."""
    post = json_post(args.vendor_host, {"Authorization": f"Bearer {args.vendor_key}"})
    source, now = VendorConnector(post, args.vendor_project, args.sync_state, lookback_days=args.lookback_days), datetime.now(timezone.utc)
    since = source.since(now)
    source.sync(spark, args.tenant, lambda events: append_new(events, args.store, since), now)
    return args.store


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.command == "version":
        print(__version__)
        return 0
    spark = get_spark()
    if args.command == "serve":
        serve(Service(spark, args.events, max_users=args.max_users or None), port=args.port, preload=True).serve_forever()
        return 0
    if not args.events and not args.vendor_host:
        print("give --events or --vendor-host", file=sys.stderr)
        return 1
    service = Service(spark, args.events or pull(spark, args))
    events = service.events()
    if not events.filter(F.col("user_id") != "").take(1):
        print("no events were found", file=sys.stderr)
        return 1
    found = service.findings(events)
    if args.dry_run:
        print(json.dumps(found.to_dict(), indent=2, default=str))
        return 0
    cards: list[Card] = []
    if args.model_host:
        ask = message_model(json_post(args.model_host, {"x-api-key": args.model_key}), "/v1/messages", args.model, CARD_SCHEMA)
        writer = CardWriter(ask, args.model, args.prompt_version, AnswerCache(args.cache) if args.cache else None)
        cards = writer.write(found.to_dict(), found.prompt_context())["cards"]
    digest = compose(cards, found.to_dict(), DigestOptions(args.max_insights, args.frequency, args.tenant_name), args.prompt_version, args.model)
    text = to_markdown(digest)
    if args.output == "-":
        print(text)
    else:
        Path(args.output).write_text(text, encoding="utf-8")
    if args.slack_webhook:
        (sent,) = deliver(digest, [Channel("slack", args.slack_webhook)], status_post())
        if not sent["success"]:
            print(f"slack: {sent['error']}", file=sys.stderr)
            return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
