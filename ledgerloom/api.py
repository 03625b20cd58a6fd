"""A small JSON API over a Service, with the standard library's server. Meant for one machine and few readers."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, unquote, urlsplit

from ledgerloom.service import Service


def _rows(df) -> list[dict]:
    return [json.loads(x) for x in df.toJSON().collect()]


def routes(service: Service) -> dict:
    """path -> (function, names and kinds of its arguments)."""
    return {
        "/health": (service.health, {}),
        "/signals": (service.list_signals, {"limit": int, "least": float, "ticker": str, "cik": str, "name": str, "direction": str}),
        "/alerts": (service.list_alerts, {"severity": str, "limit": int}),
        "/search": (service.search, {"query": str, "mode": str, "k": int, "cik": str, "accession": str, "slug": str}),
        "/metrics/cost": (service.costs, {"days": int}),
        "/metrics/runs": (service.eval_runs, {"task": str, "limit": int}),
        "/review": (service.review, {"status": str, "task": str, "limit": int}),
    }


_KINDS = {int: "integer", float: "number", str: "string"}


def openapi(service: Service) -> dict:
    """The paths and their arguments in OpenAPI's form."""
    described = {
        path: {"get": {"parameters": [{"name": n, "in": "query", "schema": {"type": _KINDS[k]}} for n, k in kinds.items()], "responses": {"200": {"description": "rows"}, "422": {"description": "bad arguments"}}}}
        for path, (_, kinds) in routes(service).items()
    }
    described["/companies/{ticker}/composite"] = {"get": {"parameters": [{"name": "ticker", "in": "path", "required": True, "schema": {"type": "string"}}], "responses": {"200": {"description": "row"}, "404": {"description": "no signals"}}}}
    return {"openapi": "3.0.3", "info": {"title": "Ledgerloom", "version": "1"}, "paths": described}


#: A page that shows signals, alerts and costs by the paths above.
DASHBOARD = """<!doctype html><meta charset="utf-8"><title>Ledgerloom</title><h1>Ledgerloom</h1><div id="all"></div><script>
for (const path of ["/health", "/alerts?limit=20", "/signals?limit=20", "/metrics/cost", "/review?limit=20"])
  fetch(path).then(r => r.json()).then(rows => {
    const box = document.createElement("section"), head = document.createElement("h2"), table = document.createElement("table");
    head.textContent = path; box.append(head, table); document.getElementById("all").append(box);
    const line = cells => { const tr = table.insertRow(); for (const c of cells) tr.insertCell().textContent = c ?? ""; };
    if (Array.isArray(rows) && rows.length) { line(Object.keys(rows[0])); for (const r of rows) line(Object.values(r)); }
  });
</script>"""


def answer(service: Service, target: str) -> tuple[int, object]:
    """(status, value) of a GET."""
    parts = urlsplit(target)
    known = routes(service)
    try:
        if parts.path == "/paths":
            return 200, {"paths": sorted([*known, "/config", "/openapi.json", "/companies/{ticker}/composite"])}
        if parts.path == "/config":
            return 200, service.config()
        if parts.path == "/openapi.json":
            return 200, openapi(service)
        if parts.path.startswith("/companies/") and parts.path.endswith("/composite"):
            found = _rows(service.company_composite(unquote(parts.path.split("/")[2])))
            return (200, found[0]) if found else (404, {"error": "no signals"})
        if parts.path not in known:
            return 404, {"error": "no such path"}
        f, kinds = known[parts.path]
        given = dict(parse_qsl(parts.query))
        unknown = set(given) - set(kinds)
        if unknown:
            return 422, {"error": f"unknown arguments {sorted(unknown)}"}
        return 200, _rows(f(**{k: kinds[k](v) for k, v in given.items()}))
    except (ValueError, TypeError) as e:
        return 422, {"error": str(e)}


def serve(service: Service, port: int = 8000, model=None) -> ThreadingHTTPServer:
    """A server that is ready to serve_forever(); POST /agent asks the given model, within the loop's bounds."""

    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, value: object, kind: str = "application/json") -> None:
            body = value.encode() if kind != "application/json" else json.dumps(value, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self) -> None:  # noqa: N802
            if self.path == "/":
                return self._send(200, DASHBOARD, "text/html; charset=utf-8")
            self._send(*answer(service, self.path))

        def do_POST(self) -> None:  # noqa: N802
            if self.path != "/agent" or model is None:
                return self._send(404, {"error": "no such path"})
            try:
                asked = json.loads(self.rfile.read(min(int(self.headers.get("Content-Length", 0)), 20_000)))
                steps = int(asked.get("max_steps", 8))
                if not asked.get("question") or not 1 <= steps <= 8:
                    raise ValueError("a question, and 1 to 8 steps")
            except (ValueError, AttributeError) as e:
                return self._send(422, {"error": str(e)})
            r = service.ask(asked["question"], model, max_steps=steps)
            self._send(200, {"answer": r.answer, "stopped": r.stopped, "steps": [s.tool for s in r.steps]})

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
