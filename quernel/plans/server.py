"""The engine over HTTP: queries, data sets, functions and logs, as JSON.

It listens on this machine only unless told otherwise; there is no access
control.  Data streams through the driver a row at a time.
"""

from __future__ import annotations

import json
import re
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from ..model import PlanError
from .program import Engine

RELATION = r"/dataset/user-(\w+)/program-(\w+)/relation-(\w+)"
FORMATS = {"csv": "text/csv", "tsv": "text/tab-separated-values", "json": "application/json"}


def shown(entry: dict) -> dict:
    """What a query's status says."""
    return {k: v for k, v in entry.items() if k in ("id", "rawQuery", "status", "message", "start", "finish", "globals")}


def described(about: dict) -> dict:
    schema = about["schema"]
    return {k: v for k, v in about.items() if k != "schema"} | {"schema": {"columnTypes": schema.types, "columnNames": schema.names}}


def rows(df):
    """A JSON array, a row at a time."""
    def lines():
        yield "["
        for i, r in enumerate(df.toJSON().toLocalIterator()):
            yield ("," if i else "") + r
        yield "]"

    return "application/json", lines()


class Service:
    """The routes: method, pattern, and what answers with the parts of the path, the query and the body."""

    def __init__(self, engine: Engine):
        e = self.engine = engine
        key = lambda *p: ":".join(p)
        self.routes = [
            ("POST", r"/query/validate", lambda q, b: (200, e.validate(b) or b)),
            ("POST", r"/query", lambda q, b: (202, shown(e.status(e.submit(b))))),
            ("GET", r"/query", lambda q, b: (200, [shown(x) for x in e.queries(q.get("q", ""), int(q.get("limit", 50)), int(q["max"]) if "max" in q else None)])),
            ("GET", r"/query/query-(\d+)", lambda q, b, n: (200, shown(e.status(int(n))))),
            ("DELETE", r"/query/query-(\d+)", lambda q, b, n: (200, e.cancel(int(n)))),
            ("GET", r"/query/query-(\d+)/subquery-(\d+)", lambda q, b, n, k: (200, e.plan_text(int(n), int(k)))),
            ("GET", r"/dataset", lambda q, b: (200, e.list())),
            ("GET", r"/dataset/search", lambda q, b: (200, e.list(q.get("q", "")))),
            ("GET", r"/dataset/user-(\w+)", lambda q, b, u: (200, e.list(user=u))),
            ("GET", r"/dataset/user-(\w+)/program-(\w+)", lambda q, b, u, p: (200, e.list(user=u, program=p))),
            ("GET", RELATION, lambda q, b, *p: (200, described(e.describe(key(*p))))),
            ("DELETE", RELATION, lambda q, b, *p: (200, e.drop(key(*p)))),
            ("GET", RELATION + "/data", lambda q, b, *p: (200, (FORMATS[q.get("format", "csv")], e.export(key(*p), q.get("format", "csv"))))),
            ("PUT", RELATION + "/data", lambda q, b, *p: (200, {"count": e.ingest(key(*p), b["reader"], b["source"], True)})),
            ("POST", RELATION + "/persist", lambda q, b, *p: (200, self.persist(key(*p), b["path"]))),
            ("POST", r"/dataset", lambda q, b: (201, {"count": e.ingest(b["relationKey"], b["reader"], b["source"], bool(b.get("overwrite")), b.get("distributeFunction"))})),
            ("POST", r"/dataset/addDatasetToCatalog", lambda q, b: (201, e.register_existing(b["relationKey"]))),
            ("POST", r"/dataset/createIndex", lambda q, b: (201, e.create_index(b["relationKey"], b["indexes"]))),
            ("POST", r"/dataset/createView", lambda q, b: (201, e.create_view(b["viewName"], b["viewDefinition"], bool(b.get("materialized"))))),
            ("POST", r"/dataset/parallelIngest", lambda q, b: (201, {"count": e.ingest(b["relationKey"], b["reader"] if "reader" in b else {"readerType": "CSV", "schema": b["schema"], **{k: b[k] for k in ("delimiter", "quote", "escape") if k in b}, "skip": b.get("numberOfSkippedLines") or 0}, b.get("source") or b["s3Source"], bool(b.get("overwrite")), b.get("distributeFunction"))})),
            ("POST", r"/dataset/tipsy", lambda q, b: (201, {"count": self.tipsy(b)})),
            ("GET", r"/function/(\w+)", lambda q, b, n: (200, {"name": n, "registered": True} if n in e.functions else self.absent(n))),
            ("GET", r"/function", lambda q, b: (200, sorted(e.functions))),
            ("POST", r"/function", lambda q, b: (201, self.function(b))),
            ("GET", r"/logs/profiling", lambda q, b: (200, rows(e.profile(int(q["queryId"]))))),
            ("GET", r"/logs/histogram", lambda q, b: (200, rows(e.histogram(int(q["queryId"]), int(q.get("step", 10**9)))))),
            ("GET", r"/logs/range", lambda q, b: (200, rows(e.span(int(q["queryId"]))))),
            ("GET", r"/logs/contribution", lambda q, b: (200, rows(e.contribution(int(q["queryId"]))))),
            ("GET", r"/logs/operators", lambda q, b: (200, rows(e.operator_log(int(q["queryId"]), int(q.get("start", 0)), int(q.get("end", (1 << 63) - 1)), int(q.get("minLength", 0)))))),
            ("GET", r"/workers", lambda q, b: (200, self.workers())),
            ("GET", r"/server", lambda q, b: (200, {"spark": e.spark.version, "master": e.spark.sparkContext.master})),
        ]

    def function(self, body: dict) -> None:
        """SQL functions only: code that comes over the network is not unpickled or run."""
        if "sql" not in body or not re.match(r"^[a-zA-Z_]\w*$", body["name"]):
            raise PlanError("a name and the SQL text of a function are needed")
        self.engine.register_function(body["name"], body["sql"], body.get("outputType", ""))

    def absent(self, name: str):
        raise KeyError(name)

    def persist(self, key: str, path: str) -> None:
        """Only into the folder that the session names in quernel.persistFolder, so that no caller overwrites what it likes."""
        base = (self.engine.spark.conf.get("quernel.persistFolder", None) or "").rstrip("/")
        if not base or not path.startswith(base + "/") or ".." in path.split("/"):
            raise PlanError("relations are persisted below quernel.persistFolder only")
        self.engine.persist(key, path)

    def tipsy(self, body: dict) -> int:
        from ..sources import formats

        e = self.engine
        e.write(body["relationKey"], formats.tipsy(e.spark, body["tipsyFilename"], body["iorderFilename"], body["grpFilename"]), bool(body.get("overwrite")))
        return e.describe(body["relationKey"])["count"]

    def workers(self) -> dict:
        """The executors, by place, and how many tasks each can run at once."""
        sc = self.engine.spark.sparkContext
        return {str(i): x.host() for i, x in enumerate(sc._jsc.sc().statusTracker().getExecutorInfos())}

    def answer(self, method: str, url: str, body):
        at = urlsplit(url)
        query = {k: v[-1] for k, v in parse_qs(at.query).items()}
        for m, pattern, f in self.routes:
            if m == method and (found := re.fullmatch(pattern, at.path.rstrip("/"))):
                try:
                    return f(query, body, *found.groups())
                except KeyError as x:
                    return 404 if "query-" in at.path else 400, {"error": f"{x} is not there"}
                except (PlanError, TypeError, ValueError) as x:
                    return 400, {"error": str(x)}
        return 404, {"error": f"no {method} {at.path}"}


def serve(engine: Engine, port: int = 8753, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """The server, bound; call ``serve_forever`` on it."""
    service = Service(engine)

    class Handler(BaseHTTPRequestHandler):
        def handle_any(self) -> None:
            try:
                raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
                status, out = service.answer(self.command, self.path, json.loads(raw) if raw else {})
            except json.JSONDecodeError as x:
                status, out = 400, {"error": str(x)}
            except Exception as x:  # noqa: BLE001
                status, out = 500, {"error": str(x)[:2000]}
            lines = None
            kind = "application/json"
            if isinstance(out, tuple):
                kind, lines = out
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.end_headers()
            for line in [json.dumps(out, default=str)] if lines is None else lines:
                self.wfile.write(line.encode() + b"\n")

        do_GET = do_POST = do_PUT = do_DELETE = handle_any

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
