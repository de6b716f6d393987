"""Health and progress of running streams and scans, as rows of the store's `progress` table.

A listener gets what Spark reports of each query with a name: batches done, rows taken in, the source's offset, observed
metrics, and why it ended. Only the last state of each name is held; put() writes it, one row a name, so a stream that
fails leaves its reason and one that runs its counts. Scans report through counted() (operators.tree) in the same way.
"""

from __future__ import annotations

import json
import threading
import time

from pyspark.sql.streaming.listener import StreamingQueryListener

from accretion.operators.store import SCHEMAS, Store

RUNNING, DONE, FAILED = "running", "done", "failed"


class Watch(StreamingQueryListener):
    def __init__(self):
        self._lock, self._names, self._rows = threading.Lock(), {}, {}

    def _set(self, name: str | None, **change) -> None:
        if name:
            with self._lock:
                blank = {"name": name, "state": RUNNING, "batches": 0, "rows": 0, "position": None, "metrics": None, "reason": None, "updated_at": 0.0}
                self._rows[name] = self._rows.get(name, blank) | change | {"updated_at": time.time()}

    def onQueryStarted(self, event):
        self._names[str(event.id)] = event.name
        self._set(event.name, state=RUNNING, reason=None)

    def onQueryProgress(self, event):
        p = event.progress
        with self._lock:
            before = self._rows.get(p.name, {"rows": 0})["rows"] if p.name else 0
        metrics = {k: v.asDict() for k, v in (p.observedMetrics or {}).items()}
        position = ",".join(str(s.endOffset) for s in p.sources)
        self._set(p.name, state=RUNNING, batches=p.batchId + 1, rows=before + p.numInputRows, position=position, metrics=json.dumps(metrics, default=str, sort_keys=True) if metrics else None)

    def onQueryIdle(self, event):
        self._set(self._names.get(str(event.id)))

    def onQueryTerminated(self, event):
        failed = event.exception is not None
        lines = [x.strip() for x in (event.exception or "").splitlines() if x.strip() and not x.strip().startswith(("at ", "..."))]
        causes = [x for x in lines if x.startswith("Caused by:")]
        reason = " / ".join(dict.fromkeys([*lines[:1], *causes[-1:], *([event.errorClassOnException] if event.errorClassOnException else [])])) or None
        self._set(self._names.get(str(event.id)), state=FAILED if failed else DONE, reason=reason)

    def scanned(self, name: str, seen) -> None:
        """A scan whose entries have been read, by its observation."""
        self._set(name, state=DONE, batches=1, rows=int(seen.get["entries"]), metrics=json.dumps(dict(seen.get), sort_keys=True), reason=None)

    def rows(self) -> list[dict]:
        with self._lock:
            return [dict(r) for r in self._rows.values()]

    def put(self, store: Store) -> None:
        """Write the last states, in place of what the store has of these names."""
        rows = self.rows()
        if rows:
            new = store.spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMAS["progress"])
            store.tables.swap(small={"progress": lambda held: held.join(new, "name", "left_anti").select(*new.columns).unionByName(new)})
