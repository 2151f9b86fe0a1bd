"""A read-only HTTP interface: /api/search /api/why-not /api/doc /api/stats /healthz."""

from __future__ import annotations

from dataclasses import asdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from .engine import Engine, to_json
from .plans.syntax import QuerySyntaxError

SECURITY = {
    "X-Content-Type-Options": "nosniff",
    "X-Frame-Options": "DENY",
    "Referrer-Policy": "no-referrer",
    "Content-Security-Policy": "default-src 'none'",
    "Cache-Control": "no-store",
}


def answer(engine: Engine, target: str) -> tuple[int, object]:
    """Status and JSON value for a GET of ``target``."""
    url = urlsplit(target)
    args = {k: v[0].strip() for k, v in parse_qs(url.query).items()}
    try:
        match url.path:
            case "/healthz":
                return 200, {"status": "ok"}
            case "/api/stats":
                return 200, engine.stats()
            case "/api/search":
                if not args.get("q"):
                    return 400, {"error": "missing q"}
                n = args.get("n", "10")
                if not (n.isascii() and n.isdigit() and 1 <= int(n) <= 100):
                    return 400, {"error": "n must be from 1 to 100"}
                return 200, engine.results(args["q"], int(n), explain=args.get("explain") in ("1", "true"), utf16=True)
            case "/api/why-not":
                if not args.get("q") or not args.get("path"):
                    return 400, {"error": "missing q or path"}
                return 200, asdict(engine.why_not(args["q"], args["path"]))
            case "/api/doc":
                if not args.get("path"):
                    return 400, {"error": "missing path"}
                doc = engine.document(args["path"])
                return (200, doc) if doc else (404, {"error": "not in index"})
    except QuerySyntaxError as e:
        return 400, {"error": str(e), "column": e.column}
    return 404, {"error": "no such page"}


def handler(engine: Engine) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, value: object, body: bool = True, **headers: str) -> None:
            raw = to_json(value).encode()
            self.send_response(status)
            for k, v in {"Content-Type": "application/json; charset=utf-8", "Content-Length": str(len(raw)), **SECURITY, **headers}.items():
                self.send_header(k, v)
            self.end_headers()
            if body:
                self.wfile.write(raw)

        def _answer(self, body: bool) -> None:
            try:
                status, value = answer(engine, self.path)
            except Exception as e:
                status, value = 500, {"error": str(e)}
            self._send(status, value, body)

        def do_GET(self) -> None:
            self._answer(True)

        def do_HEAD(self) -> None:
            self._answer(False)

        def _refuse(self) -> None:
            self._send(405, {"error": "GET or HEAD only"}, Allow="GET, HEAD")

        do_POST = do_PUT = do_DELETE = do_PATCH = do_OPTIONS = _refuse

        def log_message(self, *_: object) -> None:
            pass

    return Handler


def serve(engine: Engine, host: str = "127.0.0.1", port: int = 8080) -> None:
    with ThreadingHTTPServer((host, port), handler(engine)) as server:
        try:
            server.serve_forever()
        except KeyboardInterrupt:
            pass
