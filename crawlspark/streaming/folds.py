"""Streams folded batch by batch into versioned tables, with any state store and any session.

Rows wait in a held table until the watermark, the largest event time seen less the delay, has passed them; then they
are final and a batch operator folds them, in event-time order, into the tables' state. Rows below the watermark of the
batches before are late: they are kept as rows of the table ``late`` and take no part. All that a batch writes is
published in one manifest under its batch number, so a batch that is run again starts from the same state, and one that was
published already is left alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.versions import Versions, added

COMPACT_AT = 16


class Batch:
    """What a fold works with: the rows that wait, those that are final, and the tables as they were before the batch."""

    def __init__(self, versions: Versions, manifest: dict, rows: DataFrame, mark: int, time: str):
        self.versions, self.manifest, self.rows, self.mark = versions, manifest, rows, mark
        self._us, self.folders, self.replaced = F.unix_micros(time), {}, {}

    def final(self, rows: DataFrame) -> DataFrame:
        return rows.filter(self._us < self.mark)

    def waiting(self, rows: DataFrame) -> DataFrame:
        return rows.filter(self._us >= self.mark)

    def latest(self, table: str, schema: str, keys: list[str]) -> DataFrame:
        return self.versions.latest(table, schema, keys, self.manifest)

    def add(self, table: str, rows: DataFrame, schema: str) -> DataFrame:
        """Writes a delta of the table and reads it back, so that it is computed once."""
        self.folders[table] = self.versions.write(rows)
        return self.versions.folder(self.folders[table], schema)

    def hold(self, rows: DataFrame) -> None:
        self.replaced["held"] = self.versions.write(rows)


def run_folds(stream: DataFrame, location: str, checkpoint: str, fold: Callable[[Batch], None], delay: str,
              time: str = "ts", compact: dict[str, tuple[str, list[str]]] | None = None) -> None:
    """Drains the stream; ``fold`` is called for each micro-batch. ``compact``: schema and keys of tables with latest rows."""
    spark = stream.sparkSession
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    micros = spark.sql(f"SELECT unix_micros(timestamp'1970-01-01 00:00:00Z' + INTERVAL {delay}) AS n").first().n
    us = F.unix_micros(time)

    def run(df: DataFrame, batch_id: int) -> None:
        versions = Versions(df.sparkSession, location)
        manifest = versions.current()
        if manifest["marks"].get("batch", -1) >= batch_id:
            return
        old = manifest["marks"].get("mark")
        is_late = F.lit(False) if old is None else F.coalesce(us < old, F.lit(True))
        found = df.agg(F.max(us).alias("top"), F.count_if(is_late).alias("late")).first()
        mark = max([x for x in (old, None if found.top is None else found.top - micros) if x is not None], default=None)
        if mark is None:
            return
        held = versions.rows("held", schema, manifest).drop("_seq")
        batch = Batch(versions, manifest, held.unionByName(df.filter(~is_late)), mark, time)
        if found.late:
            batch.folders["late"] = versions.write(df.filter(is_late))
        fold(batch)
        add = added(batch.folders, {"batch": batch_id, "mark": mark})

        def change(m):
            if m["marks"].get("batch", -1) >= batch_id:
                return None
            m = add(m)
            m["tables"].update({table: [folder] for table, folder in batch.replaced.items()})
            return m

        now = versions.publish(change)
        for table, (table_schema, keys) in (compact or {}).items():
            if len(now["tables"].get(table, [])) >= COMPACT_AT:
                versions.compact(table, table_schema, keys)

    (stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True)
     .start().awaitTermination())


def late_rows(stream: DataFrame, location: str) -> DataFrame:
    """The rows that came after the watermark had passed them."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    return Versions(stream.sparkSession, location).rows("late", schema).drop("_seq")
