"""Metrics and logs of the driver: series with labels, their text form, a listener for streams, a bounded log buffer."""

from __future__ import annotations

import re
import threading
import time
from collections import deque
from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener

from coinstrata.operators.metrics import SERIES_MOST

_NAME = re.compile(r"[a-zA-Z_:][a-zA-Z0-9_:]*")
_LABEL = re.compile(r"[a-zA-Z_][a-zA-Z0-9_]*")
_SECRET = re.compile(r"(?i)(password|passwd|token|secret|api[_-]?key|authorization)")


class Metric:
    """A counter, gauge or histogram with fixed label names."""

    def __init__(self, kind: str, name: str, text: str, labels: tuple[str, ...] = (), buckets: tuple[float, ...] = ()):
        if not _NAME.fullmatch(name) or not all(_LABEL.fullmatch(x) for x in labels):
            raise ValueError(f"not a metric name or label: {name} {labels}")
        self.kind, self.name, self.text, self.labels, self.buckets = kind, name, text, labels, tuple(sorted(buckets))
        self.series: dict[tuple, list[float]] = {}
        self.dropped = 0
        self.lock = threading.Lock()

    def _values(self, labels: dict) -> list[float] | None:
        if set(labels) != set(self.labels):
            raise ValueError(f"{self.name} has labels {self.labels}")
        key = tuple(str(labels[x]) for x in self.labels)
        if key not in self.series:
            if len(self.series) >= SERIES_MOST:
                self.dropped += 1
                return None
            self.series[key] = [0.0] * (len(self.buckets) + 2 if self.kind == "histogram" else 1)
        return self.series[key]

    def add(self, value: float = 1, **labels) -> None:
        if self.kind == "counter" and value < 0:
            raise ValueError("counters only grow")
        with self.lock:
            if (v := self._values(labels)) is not None:
                v[0] += value

    def put(self, value: float, **labels) -> None:
        """Sets a gauge, or a counter to a larger value."""
        with self.lock:
            if (v := self._values(labels)) is not None:
                v[0] = max(v[0], value) if self.kind == "counter" else value

    def observe(self, value: float, **labels) -> None:
        with self.lock:
            if (v := self._values(labels)) is not None:
                for i, b in enumerate(self.buckets):
                    v[i] += value <= b
                v[-2] += value
                v[-1] += 1


def escaped(text: str, quotes: bool = True) -> str:
    text = text.replace("\\", "\\\\").replace("\n", "\\n")
    return text.replace('"', '\\"') if quotes else text


def number(v: float) -> str:
    return "NaN" if v != v else "+Inf" if v == float("inf") else "-Inf" if v == -float("inf") else f"{v:g}" if v != int(v) else str(int(v))


class Registry:
    """Metrics by name; rendering runs the collectors first."""

    def __init__(self):
        self.metrics: dict[str, Metric] = {}
        self.collectors: list[Callable[[], None]] = []

    def make(self, kind: str, name: str, text: str, labels: tuple[str, ...] = (), buckets: tuple[float, ...] = ()) -> Metric:
        if name in self.metrics:
            raise ValueError(f"{name} is there already")
        self.metrics[name] = m = Metric(kind, name, text, labels, buckets)
        return m

    def render(self) -> str:
        for c in self.collectors:
            c()
        lines = []
        for m in self.metrics.values():
            lines += [f"# HELP {m.name} {escaped(m.text, False)}", f"# TYPE {m.name} {m.kind}"]
            for key, v in m.series.items():
                pairs = [f'{n}="{escaped(x)}"' for n, x in zip(m.labels, key)]
                line = lambda suffix, value, more=(): f"{m.name}{suffix}{'{' + ','.join([*pairs, *more]) + '}' if pairs or more else ''} {number(value)}"  # noqa: B023, E731
                if m.kind == "histogram":
                    lines += [line("_bucket", v[i], (f'le="{number(b)}"',)) for i, b in enumerate(m.buckets)]
                    lines += [line("_bucket", v[-1], ('le="+Inf"',)), line("_sum", v[-2]), line("_count", v[-1])]
                else:
                    lines.append(line("", v[0]))
        return "\n".join(lines) + "\n"


class StreamMetrics(StreamingQueryListener):
    """Rows, duration and time of the last commit of every stream, as metrics."""

    def __init__(self, registry: Registry):
        self.rows = registry.make("counter", "stream_rows_total", "Rows read", ("query",))
        self.seconds = registry.make("histogram", "stream_batch_seconds", "Duration of batches", ("query",), (0.1, 0.5, 1, 5, 30, 120))
        self.last = registry.make("gauge", "stream_last_commit_seconds", "Time of the last commit", ("query",))
        self.active = registry.make("gauge", "stream_active", "1 while a stream runs", ("query",))

    def onQueryStarted(self, event):  # noqa: N802
        self.active.put(1, query=str(event.name))

    def onQueryProgress(self, event):  # noqa: N802
        p = event.progress
        self.rows.add(max(0, p.numInputRows), query=str(p.name))
        self.seconds.observe(p.batchDuration / 1000, query=str(p.name))
        self.last.put(time.time(), query=str(p.name))

    def onQueryIdle(self, event):  # noqa: N802
        pass

    def onQueryTerminated(self, event):  # noqa: N802
        self.active.put(0, query=str(event.id))


def redacted(value):
    """A copy in which values under names of secrets are masked, at any depth."""
    if isinstance(value, dict):
        return {k: "[redacted]" if _SECRET.search(str(k)) else redacted(v) for k, v in value.items()}
    return [redacted(v) for v in value] if isinstance(value, list) else value


class LogBuffer:
    """Log records on their way out: the oldest go when it is full; sent in batches, kept if sending fails."""

    def __init__(self, send: Callable[[list[dict]], None], most: int = 5000, batch: int = 100):
        self.send, self.batch, self.dropped = send, batch, 0
        self.records: deque[dict] = deque()
        self.most = most

    def log(self, level: str, message: str, **fields) -> None:
        if len(self.records) >= self.most:
            self.records.popleft()
            self.dropped += 1
        self.records.append({"level": level, "message": message, "fields": redacted(fields)})

    def flush(self) -> int:
        sent = 0
        while self.records:
            part = [self.records[i] for i in range(min(self.batch, len(self.records)))]
            try:
                self.send(part)
            except Exception:  # noqa: BLE001  the next flush tries again
                break
            for _ in part:
                self.records.popleft()
            sent += len(part)
        return sent
