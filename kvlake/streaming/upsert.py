"""Mutation streams folded into keyed state.

Three forms: `fold` is a plain streaming aggregation (state: the newest row
of each key); `StatefulFold` keeps it in ValueState by transformWithStateInPandas, with
optional expiry; `upsert_batches` merges each micro-batch into a table, which commits it once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.state import winners


def fold(stream: DataFrame, columns: tuple[str, ...], recent: tuple[str, ...] = ("version", "seq"), watermark: tuple[str, str] | None = None) -> DataFrame:
    """key and `columns` of the newest row; for update or complete mode."""
    if watermark:
        stream = stream.withWatermark(*watermark)
    return stream.groupBy("key").agg(F.max_by(F.struct(*recent, *[c for c in columns if c not in recent]), F.struct(*recent)).alias("s")).select("key", "s.*")


class StatefulFold(StatefulProcessor):
    """Emits a key's newest (version, seq, op, value) whenever it changes; late and repeated rows change nothing."""

    def __init__(self, ttl_ms: int | None = None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = "version long, seq long, op string, value string"
        self.state = handle.getValueState("newest", schema, self.ttl_ms) if self.ttl_ms else handle.getValueState("newest", schema)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:
        best = self.state.get() if self.state.exists() else None
        best, changed = tuple(best) if best else None, False
        for batch in rows:
            top = batch.sort_values(["version", "seq"]).iloc[-1]
            row = (int(top.version), int(top.seq), str(top.op), None if pd.isna(top.value) else str(top.value))
            if best is None or row[:2] > tuple(best[:2]):
                best, changed = row, True
        if changed:
            self.state.update(best)
            yield pd.DataFrame([(*key, *best)], columns=["key", "version", "seq", "op", "value"])

    def close(self) -> None:
        pass


def stateful_fold(stream: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """`StatefulFold` over a stream of key, version, seq, op, value (strings); needs the RocksDB state store."""
    return stream.groupBy("key").transformWithStateInPandas(StatefulFold(ttl_ms), "key string, version long, seq long, op string, value string", "Update", "ProcessingTime" if ttl_ms else "None")


def upsert_batches(read: Callable[[int], DataFrame | None], write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: the table's rows and the batch's, newest of each key.

    read gives the table as it was before a batch (None at first), write replaces it. Each batch is first cut to its newest row a key.
    A batch that comes again after a failure changes nothing, as it holds no newer rows.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        held = read(batch_id)
        write(winners(batch if held is None else held.unionByName(winners(batch))), batch_id)

    return merge
