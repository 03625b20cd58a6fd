"""Recording spans on the driver and writing them in one go."""

from __future__ import annotations

import contextvars
import json
import uuid
from contextlib import contextmanager
from datetime import UTC, datetime
from time import monotonic

from pyspark.sql import SparkSession

from ledgerloom import schemas

_ACTIVE: contextvars.ContextVar = contextvars.ContextVar("span", default=None)


class Tracer:
    def __init__(self) -> None:
        self.rows: list[dict] = []

    @contextmanager
    def span(self, name: str, kind: str = "pipeline", **attrs):
        """A span round a block; spans inside it are its children. A failure is recorded and passed on."""
        parent = _ACTIVE.get()
        own = {"span_id": uuid.uuid4().hex[:16], "trace_id": parent["trace_id"] if parent else uuid.uuid4().hex, "parent_id": parent["span_id"] if parent else None}
        own |= {"name": name, "kind": kind, "status": "ok", "started_at": datetime.now(UTC), "attrs": attrs, "error": None}
        began, token = monotonic(), _ACTIVE.set(own)
        try:
            yield own
        except BaseException as e:
            own |= {"status": "error", "error": str(e)[:2000]}
            raise
        finally:
            _ACTIVE.reset(token)
            own["duration_ms"] = (monotonic() - began) * 1000
            self.rows.append(own)

    def to_json(self) -> str:
        return json.dumps(self.rows, default=str)

    def flush(self, spark: SparkSession, write) -> int:
        """Hands the recorded spans to write(DataFrame) and forgets them; a failure to write never stops the caller."""
        if not self.rows:
            return 0
        schema = schemas.TABLES["traces"]
        rows = [tuple(json.dumps(r["attrs"], default=str) if f.name == "attrs" else r.get(f.name, r["attrs"].get(f.name)) for f in schema) for r in self.rows]
        try:
            write(spark.createDataFrame(rows, schema))
        except Exception:
            return 0
        n, self.rows = len(self.rows), []
        return n
