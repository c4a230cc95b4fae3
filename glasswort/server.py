"""Verdicts over HTTP: /health, /info and /detect, one request at a time.

Each request's files become rows of a DataFrame and go through the same
operators as files in a folder.
"""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Sequence
from email.parser import BytesParser
from email.policy import HTTP
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import SparkSession

from .operators.align import check_uploads
from .operators.calibrate import FusionModel
from .operators.scoring import DETECTORS, predictions

MOST_FILES, MOST_BYTES, VERSION = 16, 32 << 20, "1.0"


class Service:
    """What the handlers ask; methods return (status, body).  Without a model it is unavailable."""

    def __init__(self, spark: SparkSession, model: FusionModel | None, scorers: Sequence[str], point: str = "fpr5", error: str | None = None):
        self.spark, self.model, self.scorers, self.point, self.error = spark, model, list(scorers), point, error
        self.lock = threading.Lock()

    def _unavailable(self) -> tuple[int, dict]:
        return 503, {"detail": self.error or "models are still loading"}

    def health(self) -> tuple[int, dict]:
        ready = self.model is not None
        return 200 if ready else 503, {"status": "ok" if ready else "unavailable", "version": VERSION, "models_loaded": ready, "error": self.error}

    def info(self) -> tuple[int, dict]:
        if self.model is None:
            return self._unavailable()
        points = self.model.thresholds
        return 200, {
            "version": VERSION,
            "ensemble": sorted(self.scorers),
            "licences": {s: DETECTORS[s].license for s in self.scorers if s in DETECTORS},
            "operating_point": self.point,
            "threshold": points.get(self.point, points.get("fpr5", 0.5)),
            "abstain_below": points.get("abstain_low"),
            "available_operating_points": sorted(points),
            "calibrated_for_dtype": self.model.dtype,
            "limits": {"max_bytes_per_file": MOST_BYTES, "max_files_per_request": MOST_FILES},
        }

    def detect(self, uploads: list[tuple[str, bytes]] | None, point: str | None = None, metadata: bool = True) -> tuple[int, dict]:
        """uploads is None where the request has no files field at all.  Another point moves the threshold, not the band's lower edge."""
        if self.model is None:
            return self._unavailable()
        if uploads is None:
            return 422, {"detail": "send files in the 'files' field"}
        rows = [("r", i, name, bytearray(data)) for i, (name, data) in enumerate(uploads)] or [("r", 0, None, None)]
        files = self.spark.createDataFrame(rows, "request string, ordinal long, name string, content binary")
        checked = check_uploads(files, most=MOST_FILES, largest=MOST_BYTES).first()
        if checked["status"] != 200:
            return checked["status"], {"detail": checked["problem"]}
        if point and point not in self.model.thresholds:
            return 400, {"detail": f"unknown operating point {point!r}"}
        start = time.time()
        with self.lock:
            found = predictions(files.withColumnRenamed("name", "path"), self.scorers, self.model, point or self.point, metadata).collect()
        results = []
        for r in sorted(found, key=lambda r: r["ordinal"]):
            why = f"{r['path']}: {r['error']}" if r["error"] else None
            results.append(
                {
                    "filename": r["path"],
                    "verdict": r["verdict"],
                    "p_ai": r["p_ai"],
                    "threshold": r["threshold"],
                    "low_threshold": r["low_threshold"],
                    "basis": why or r["basis"],
                    "per_model": {} if why else dict(r["per_model"]),
                    "metadata_says_ai": r["metadata_says_ai"],
                    "metadata_generator": r["metadata_generator"],
                    "truncated": r["truncated"],
                    "error": why,
                }
            )
        return 200, {"results": results, "elapsed_ms": int(1000 * (time.time() - start)), "operating_point": point or self.point}


def uploaded(kind: str, body: bytes) -> list[tuple[str, bytes]] | None:
    """The parts of a form's `files` field, in order; None if there is no such field."""
    message = BytesParser(policy=HTTP).parsebytes(b"Content-Type: " + kind.encode() + b"\r\n\r\n" + body)
    if not message.is_multipart():
        return None
    parts = [p for p in message.iter_parts() if p.get_param("name", header="content-disposition") == "files"]
    return [(p.get_filename() or "upload", p.get_payload(decode=True) or b"") for p in parts] or None


def handler(service: Service) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def reply(self, status: int, body: dict) -> None:
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:  # noqa: N802 - the base class asks for this name
            known = {"/health": service.health, "/info": service.info}
            ask = known.get(urlsplit(self.path).path)
            self.reply(*(ask() if ask else (404, {"detail": "not found"})))

        def do_POST(self) -> None:  # noqa: N802
            url = urlsplit(self.path)
            size = int(self.headers.get("Content-Length") or 0)
            if url.path != "/detect":
                return self.reply(404, {"detail": "not found"})
            if size > MOST_FILES * (MOST_BYTES + 4096):
                return self.reply(413, {"detail": "request too large"})
            asked = {k: v[-1] for k, v in parse_qs(url.query).items()}
            files = uploaded(self.headers.get("Content-Type", ""), self.rfile.read(size))
            self.reply(*service.detect(files, asked.get("operating_point"), asked.get("metadata", "true").lower() not in ("false", "0", "no")))

        def log_message(self, *args) -> None:
            pass

    return Handler


def serve(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that is bound; serve_forever() runs it."""
    return ThreadingHTTPServer((host, port), handler(service))
