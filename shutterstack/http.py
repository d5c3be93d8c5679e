"""A small JSON service over a catalog."""

from __future__ import annotations

import json
import mimetypes
import os
import shutil
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import parse_qsl, urlsplit

from shutterstack.app import Catalog
from shutterstack.errors import CatalogError, NotFoundError
from shutterstack.operators import dedup
from shutterstack.operators.search import result_columns


class Service:
    """What each route does; returns (status, value). Scans and ingests run in the background, one at a time."""

    def __init__(self, catalog: Catalog):
        self.catalog, self.state, self._busy = catalog, {"running": None, "message": ""}, threading.Lock()

    def _rows(self, df) -> list[dict]:
        return [r.asDict(recursive=True) for r in df.collect()]

    def _start(self, name: str, work) -> tuple[int, dict]:
        if not self._busy.acquire(blocking=False):
            return 409, {"error": f"{self.state['running']} is running"}
        self.state = {"running": name, "message": ""}

        def go() -> None:
            message = ""
            try:
                message = json.dumps(work())
            except Exception as e:  # noqa: BLE001 - shown as progress
                message = f"error: {e}"
            finally:
                self.state = {"running": None, "message": message}
                self._busy.release()

        threading.Thread(target=go, daemon=True).start()
        return 202, {"started": name}

    def handle(self, method: str, target: str, body: dict) -> tuple[int, object]:
        url = urlsplit(target)
        args, path = dict(parse_qsl(url.query)), url.path.rstrip("/")
        page = {k: int(v) if k in ("page", "per_page") else v for k, v in args.items() if k in ("kind", "sort", "page", "per_page")}
        try:
            if (method, path) == ("POST", "/api/search"):
                return 200, self._rows(result_columns(self.catalog.search(body.get("query", ""), int(body.get("limit", 20)))))
            if (method, path) == ("POST", "/api/scan"):
                return self._start("scan", lambda: self.catalog.scan(body["path"]))
            if (method, path) == ("POST", "/api/ingest"):
                return self._start("ingest", self.catalog.ingest)
            if method != "GET":
                return 404, {"error": "no such route"}
            if path.startswith("/api/media/") and path.endswith("/file"):
                file = self.catalog.media(path.split("/")[3])["file_path"]
                if not os.path.isfile(file):
                    raise NotFoundError(file)
                return 200, Path(file)
            if path.startswith(("/api/media/", "/api/thumb/")):
                return 200, {k: v for k, v in self.catalog.media(path.rsplit("/", 1)[1]).asDict().items() if k != "embedding"}
            if path == "/api/stats":
                return 200, {"total": self.catalog.stats()["catalog"]}
            if path == "/api/stats/full":
                return 200, self.catalog.stats() | {"last_scan_time": self.catalog.get("last_scan_time")}
            if path == "/api/dedup":
                found = self.catalog.dedup(args.get("tier", "all"), float(args.get("threshold", 0.92)))
                # a page of each tier, in the order of its report
                number, size = max(1, page.get("page", 1)), min(1000, max(1, page.get("per_page", 100)))
                return 200, {tier: self._rows(rows.orderBy(*dedup.REPORT[tier][0]).offset((number - 1) * size).limit(size)) for tier, rows in found.items()}
            if path == "/api/browse":
                return 200, self._rows(self.catalog.browse(**page))
            if path == "/api/files":
                return 200, self._rows(self.catalog.browse_files(**page))
            if path == "/api/progress":
                return 200, self.catalog.progress() | self.state
            if path == "/api/setup/status":
                return 200, {"catalog": self.catalog.tables["media"].version() is not None, "model": self.catalog.model_id}
            return 404, {"error": "no such route"}
        except NotFoundError as e:
            return 404, {"error": str(e)}
        except (CatalogError, ValueError, KeyError) as e:
            return 400, {"error": str(e)}


def server(catalog: Catalog, host: str, port: int) -> ThreadingHTTPServer:
    service = Service(catalog)

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, method: str) -> None:
            length = int(self.headers.get("Content-Length") or 0)
            try:
                body = json.loads(self.rfile.read(length) or b"{}")
            except ValueError:
                body = {}
            status, value = service.handle(method, self.path, body)
            if isinstance(value, Path):
                return self._file(value)
            data = json.dumps(value, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _file(self, path: Path) -> None:
            """The bytes of a media file, a piece at a time."""
            with path.open("rb") as file:
                self.send_response(200)
                self.send_header("Content-Type", mimetypes.guess_type(path.name)[0] or "application/octet-stream")
                self.send_header("Content-Length", str(os.fstat(file.fileno()).st_size))
                self.end_headers()
                shutil.copyfileobj(file, self.wfile)

        def _stream(self) -> None:
            """Progress as server-sent events, every two seconds until nothing runs."""
            self.send_response(200)
            self.send_header("Content-Type", "text/event-stream")
            self.end_headers()
            while True:
                value = service.handle("GET", "/api/progress", {})[1]
                self.wfile.write(f"data: {json.dumps(value)}\n\n".encode())
                self.wfile.flush()
                if value["running"] is None:
                    return
                time.sleep(2)

        def do_GET(self) -> None:  # noqa: N802
            if self.path == "/api/progress" and "text/event-stream" in (self.headers.get("Accept") or ""):
                self._stream()
            else:
                self._answer("GET")

        def do_POST(self) -> None:  # noqa: N802
            self._answer("POST")

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def serve(catalog: Catalog, host: str, port: int) -> None:
    server(catalog, host, port).serve_forever()
