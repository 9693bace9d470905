"""The engine over HTTP: sync, jobs, schedules, history, status and transfers as JSON."""

from __future__ import annotations

import json
from dataclasses import asdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from deltaloom.contract import Resource, build, parse_request


def routes(engine, scheduler=None, transfers=None):
    """A function from (method, path, body) to (status, data)."""

    def answer(method: str, path: str, body: str, kind: str = "json"):
        parts = [p for p in path.split("?")[0].split("/") if p]
        if parts[:2] == ["v1", "api"]:
            parts = parts[2:]
        match method, parts:
            case "POST", ["sync"]:
                done = engine.sync(parse_request(body, kind))
                return (500 if done.status == "error" else 200), done.to_dict()
            case "GET", ["jobs"]:
                return 200, [asdict(j) for j in engine.jobs.list()]
            case "GET", ["job", ids]:
                return 200, [asdict(j) for j in engine.jobs.list(ids.split(","))]
            case "GET", ["schedules"]:
                return 200, scheduler.list() if scheduler else []
            case "GET", ["history", id_]:
                return 200, engine.history.show(id_)
            case "GET", ["status"] | ["status", _]:
                return 200, engine.history.status(int(parts[1]) if len(parts) > 1 else 1)
            case "POST", ["transfer"] if transfers:
                data = json.loads(body)
                source, dest = (build(Resource, data.pop(k)) for k in ("source", "dest"))
                return 200, asdict(transfers.run(source, dest, **data))
            case "GET", ["tasks"] if transfers:
                return 200, [asdict(t) for t in transfers.list()]
            case "GET", ["task", id_] if transfers:
                return 200, asdict(transfers.get(id_))
        return 404, {"error": f"no such resource: {method} {path}"}

    return answer


def server(answer, port: int = 8080, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server to be started with ``serve_forever``."""

    class Handler(BaseHTTPRequestHandler):
        def _reply(self, method: str) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode()
            kind = "yaml" if "yaml" in (self.headers.get("Content-Type") or "") else "json"
            try:
                status, data = answer(method, self.path, body, kind)
            except (ValueError, KeyError, TypeError) as error:
                status, data = 400, {"error": str(error)}
            except RuntimeError as error:
                status, data = 409, {"error": str(error)}
            raw = json.dumps(data, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self):  # noqa: N802 - the base class's name
            self._reply("GET")

        def do_POST(self):  # noqa: N802
            self._reply("POST")

        def log_message(self, *_):
            pass

    return ThreadingHTTPServer((host, port), Handler)
