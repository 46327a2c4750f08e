"""Count-sliding windows over a stream (INC-10): means of the last 50 and 100 resolved predictions of a model, as ring buffers in state.

The order is that of the stream: within a batch by day and number. A model's predictions are one sequence, so a model is one key; there are as many as
bouts, not rows of statistics. Sessions need the RocksDB state store (``state.PROVIDER``).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SIZES = (50, 100)
RING = "n long, at int, values array<array<double>>"


class _Rings(StatefulProcessor):
    """A ring of the largest size a measure, and the number of rows so far."""

    def __init__(self, names: tuple[str, ...], sizes: tuple[int, ...]) -> None:
        self.names, self.sizes, self.most = names, sizes, max(sizes)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getValueState("ring", RING)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        n, at, values = self.ring.get() if self.ring.exists() else (0, 0, [[] for _ in self.names])
        values = [list(v) for v in values]
        for r in sorted(rows, key=lambda r: (r["day"], r["number"])):
            for ring, name in zip(values, self.names, strict=True):
                if len(ring) < self.most:
                    ring.append(float(r[name]))
                else:
                    ring[at] = float(r[name])
            at, n = (at + 1) % self.most, n + 1
            out = {}
            for size in self.sizes:
                # the last ``size`` places of the ring, the newest before ``at``
                places = [(at - k) % self.most for k in range(size, 0, -1)] if n >= size else []
                out |= {f"{name}_{size}": sum(ring[p] for p in places) / size if places else None for ring, name in zip(values, self.names, strict=True)}
                out[f"status_{size}"] = "ok" if places else "insufficient_sample"
            yield Row(model=key[0], day=r["day"], number=r["number"], index=n, **out)
        self.ring.update((n, at, values))

    def close(self) -> None:
        pass


def rolling(predictions: DataFrame, measures: dict[str, Column], sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """model, day, number and index of every row of the stream ``predictions`` (model, day, number), and per size the measures' means; as ``history.trailing`` gives them."""
    rows = predictions.select("model", "day", "number", *[c.cast("double").alias(n) for n, c in measures.items()])
    columns = ", ".join(", ".join([*(f"{n}_{s} double" for n in measures), f"status_{s} string"]) for s in sizes)
    return rows.groupBy("model").transformWithState(_Rings(tuple(measures), sizes), f"model string, day date, number long, index long, {columns}", "Append", "None")
