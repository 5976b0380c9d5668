"""The measures as JSON over HTTP, on the standard library's server; every list has a limit."""

from __future__ import annotations

import json
import re
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from queryvitals.operators import review as V
from queryvitals.plans.planner import preview
from queryvitals.service import Service


#: Rows of a reporting table that one answer may hold; larger tables are refused, not cut.
BI_ROWS = 100_000


class HttpError(Exception):
    def __init__(self, status: int, detail: str):
        super().__init__(detail)
        self.status = status


def _rows(df, limit: int = 500) -> list[dict]:
    return [json.loads(r) for r in df.limit(limit).toJSON().collect()]


def _int(given: dict, name: str, default: int, low: int, high: int) -> int:
    try:
        n = int(given.get(name, default))
    except ValueError:
        raise HttpError(422, f"{name} must be a whole number") from None
    if not low <= n <= high:
        raise HttpError(422, f"{name} must lie between {low} and {high}")
    return n


def handle(service: Service, method: str, target: str, body: dict | None = None):
    """The answer of one route; HttpError for everything that is not an answer."""
    parts = urlsplit(target)
    path, given = unquote(parts.path).rstrip("/"), {k: v[-1] for k, v in parse_qs(parts.query).items()}
    if path == "/api/status":
        return service.status()
    if not service.store.exists():
        raise HttpError(503, "the store is not loaded")
    period = {k: given.get(k) for k in ("since", "until")}
    if "days" in given and path in ("/api/overview", "/api/queries"):
        period = dict(zip(period, service.period(_int(given, "days", 28, 1, 3650)), strict=True))
    if method == "GET":
        if path == "/api/overview":
            return _rows(service.overview(**period))[0]
        if path == "/api/queries":
            return _rows(service.queries(**period, problems_only=given.get("problems_only") == "true", limit=_int(given, "limit", 100, 1, 500)))
        if m := re.fullmatch(r"/api/queries/(.+)", path):
            try:
                return service.query(m[1])
            except KeyError:
                raise HttpError(404, "this query was never searched") from None
        if path == "/api/terms":
            return _rows(service.terms(_int(given, "limit", 25, 1, 100)))
        if m := re.fullmatch(r"/api/catalogue/(.+)", path):
            return service.coverage(m[1])
        if path == "/api/suggestions":
            return _rows(V.listed(service.queue(), given.get("status"), given.get("kind"), _int(given, "limit", 100, 1, 500)))
        if path == "/api/suggestions/summary":
            return _rows(V.status_counts(service.queue()))
        if path == "/api/suggestions/export":
            return service.export()
        if path == "/api/agent/tools":
            return service.planner().described()
        if path == "/api/digest":
            if given.get("format", "json") not in ("json", "markdown"):
                raise HttpError(422, "format must be json or markdown")
            d = service.digest(_int(given, "days", 7, 1, 90), given.get("end"))
            return d["body_md"] if given.get("format") == "markdown" else d
        if path == "/api/bi/tables":
            return ["fact_search", "dim_query", "dim_term", "fact_daily", "fact_suggestion", "dim_overview"]
        if m := re.fullmatch(r"/api/bi/(\w+)", path):
            found = service.tables(_int(given, "days", 90, 1, 730))
            if m[1] not in found:
                raise HttpError(404, f"no such table; there are {', '.join(found)}")
            if found[m[1]].limit(BI_ROWS + 1).count() > BI_ROWS:
                raise HttpError(413, f"more than {BI_ROWS} rows: use the export of reporting tables")
            return _rows(found[m[1]], BI_ROWS)
    if method == "POST":
        if path == "/api/suggestions/refresh":
            return service.discover()
        if m := re.fullmatch(r"/api/suggestions/(\d+)/(\w+)", path):
            try:
                service.decide(int(m[1]), m[2], **{k: v for k, v in (body or {}).items() if k in ("reviewer", "note")})
            except ValueError as e:
                raise HttpError(400, str(e)) from None
            except KeyError:
                raise HttpError(404, "no such suggestion") from None
            return {"id": int(m[1]), "decision": m[2]}
        if path == "/api/ask":
            question = (body or {}).get("question", "")
            if not question.strip():
                raise HttpError(400, "a question is needed")
            tool, answer = service.planner().ask(question)
            return {"tool": tool, "answer": json.loads(answer), "preview": preview(answer)}
    raise HttpError(404, "no such route")


def serve(service: Service, host: str = "127.0.0.1", port: int = 8000) -> None:
    class Handler(BaseHTTPRequestHandler):
        def _answer(self, method: str) -> None:
            try:
                size = int(self.headers.get("Content-Length") or 0)
                status, value = 200, handle(service, method, self.path, json.loads(self.rfile.read(size) or b"{}") if size else None)
            except HttpError as e:
                status, value = e.status, {"detail": str(e)}
            data = json.dumps(value, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self._answer("GET")

        def do_POST(self) -> None:
            self._answer("POST")

    ThreadingHTTPServer((host, port), Handler).serve_forever()
