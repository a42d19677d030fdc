"""JSON over HTTP for the command line; everything else takes the function as an argument."""

from __future__ import annotations

import json
from collections.abc import Callable
from urllib.error import HTTPError, URLError
from urllib.request import Request, urlopen


def json_post(base: str = "", headers: dict[str, str] | None = None, timeout: float = 30) -> Callable[[str, dict], tuple[int, dict]]:
    """(path, body) -> (status, answer); an answer that is no JSON object is {}. No connection: ConnectionError."""

    def post(path: str, body: dict) -> tuple[int, dict]:
        request = Request(base + path, json.dumps(body).encode(), {"Content-Type": "application/json"} | (headers or {}), method="POST")
        try:
            with urlopen(request, timeout=timeout) as answer:  # noqa: S310  the address is the user's own setting
                status, data = answer.status, answer.read()
        except HTTPError as problem:
            status, data = problem.code, problem.read()
        except URLError as problem:
            raise ConnectionError(str(problem.reason)) from problem
        try:
            found = json.loads(data)
        except ValueError:
            found = {}
        return status, found if isinstance(found, dict) else {}

    return post


def status_post(timeout: float = 10) -> Callable[[str, dict], int]:
    """(address, payload) -> status, for webhooks."""
    post = json_post(timeout=timeout)
    return lambda address, payload: post(address, payload)[0]


def message_model(post: Callable[[str, dict], tuple[int, dict]], path: str, model: str, schema: dict | None = None, max_tokens: int = 4096) -> Callable[[str, str], tuple[str, dict]]:
    """A language model behind a messages interface, as CardWriter takes it: (system, user) -> (answer text, token usage).

    schema: asked for as a tool's input; the tool call's input is then the answer.
    """

    def ask(system: str, user: str) -> tuple[str, dict]:
        body: dict = {"model": model, "max_tokens": max_tokens, "system": system, "messages": [{"role": "user", "content": user}]}
        if schema:
            body |= {"tools": [{"name": "report", "description": "Report the cards", "input_schema": schema}], "tool_choice": {"type": "tool", "name": "report"}}
        status, found = post(path, body)
        if status >= 400:
            raise ConnectionError(f"status {status}")
        parts = found.get("content") or []
        called = next((p["input"] for p in parts if p.get("type") == "tool_use"), None)
        usage = found.get("usage") or {}
        answer = json.dumps(called) if called is not None else "".join(p.get("text", "") for p in parts)
        return answer, {"input": usage.get("input_tokens", 0), "output": usage.get("output_tokens", 0)}

    return ask
