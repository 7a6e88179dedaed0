"""What the operators share: typed batches of whole texts, in pieces of bounded size."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

SLAB_BYTES = 4 << 20


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def slabs(column: pa.Array, limit: int = SLAB_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text gets a range of its own."""
    sizes = [x or 0 for x in pa.compute.binary_length(column).to_pylist()]
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def kept_in_worker(key, make: Callable):
    """An object that a Python worker keeps between its tasks; a lost worker makes it anew, with the same content.

    A worker keeps one at a time: the tables of an earlier operator or model go when another one starts.
    """
    store = sys.modules.setdefault("crawlspark_worker_store", types.ModuleType("crawlspark_worker_store")).__dict__
    if store.get("key") != key:
        store.clear()
        store.update(key=key, value=make())
    return store["value"]


class Remembered(dict):
    """A table of two halves: when the young one is full it becomes the old one; what is found there again is young again.

    So what is used often stays, and what is not goes. A key must be added before it is looked up.
    """

    def __init__(self, most: int):
        super().__init__()
        self.half, self.old = max(1, most // 2), {}

    def __missing__(self, key):
        value = self[key] = self.old[key]
        return value

    def unknown(self, keys) -> list:
        old = self.old
        return [k for k in keys if k not in self and k not in old]

    def rest(self) -> None:
        """To be called between uses: the young half grows old if it is full."""
        if len(self) > self.half:
            self.old = dict(self)
            self.clear()


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``values`` that start and are as long as told, in the order of ``places``; where each begins and all end."""
    each = sizes[places]
    until = np.concatenate(([0], np.cumsum(each)))
    kind = np.int32 if max(len(values), until[-1]) < 1 << 31 else np.int64
    at = np.repeat((starts[places] - until[:-1]).astype(kind), each)
    at += np.arange(until[-1], dtype=kind)
    return values[at], until


def struct_of(ddl: str) -> StructType:
    return _parse_datatype_string(ddl)


def per_text(docs: DataFrame, fields: str, start: Callable, keep: tuple[str, ...] = ("doc_id",), text: str = "text",
             limit: int = SLAB_BYTES) -> DataFrame:
    """The kept columns and, for each row, ``fields`` computed from its whole text.

    ``start()`` runs once in each task and returns a function of a list of texts that yields one list or array for
    each field. Other columns are not read, so their names can't clash.
    """
    chosen = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = StructType([*chosen.schema.fields[:-1], *struct_of(fields).fields])
    arrow = to_arrow_schema(schema)
    n_keep = len(keep)

    def run(batches):
        fn = start()
        for batch in batches:
            column = batch.column(n_keep)
            for lo, hi in slabs(column, limit):
                made = fn(texts_of(column.slice(lo, hi - lo)))
                arrays = [batch.column(i).slice(lo, hi - lo).cast(arrow.field(i).type) for i in range(n_keep)]
                arrays += [pa.array(x, type=arrow.field(n_keep + i).type) for i, x in enumerate(made)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return chosen.mapInArrow(run, schema)


def keep_texts(docs: DataFrame, start: Callable, text: str = "text") -> DataFrame:
    """The rows for which the function made by ``start()`` returns true; no shuffle, all columns as they are."""
    at = docs.columns.index(text)

    def run(batches):
        fn = start()
        for batch in batches:
            column, mask = batch.column(at), []
            for lo, hi in slabs(column):
                mask.extend(fn(texts_of(column.slice(lo, hi - lo))))
            yield batch.filter(pa.array(np.asarray(mask, dtype=bool)))

    return docs.mapInArrow(run, docs.schema)


def replace_texts(docs: DataFrame, start: Callable, text: str = "text", length: str = "n_chars") -> DataFrame:
    """Every row with the text that the function made by ``start()`` gives (None: as it was).

    ``length``, where there is such a column, becomes the new length of the changed texts.
    """
    at = docs.columns.index(text)
    size_at = docs.columns.index(length) if length in docs.columns else None

    def run(batches):
        fn = start()
        for batch in batches:
            column, new = batch.column(at), []
            for lo, hi in slabs(column):
                new.extend(fn(texts_of(column.slice(lo, hi - lo))))
            if any(x is not None for x in new):
                arrays = list(batch.columns)
                old = column.to_pylist()
                arrays[at] = pa.array([o if n is None else n.decode() for o, n in zip(old, new)], type=column.type)
                if size_at is not None:
                    sizes = [o if n is None else len(n.decode()) for o, n in zip(batch.column(size_at).to_pylist(), new)]
                    arrays[size_at] = pa.array(sizes, type=batch.column(size_at).type)
                batch = pa.RecordBatch.from_arrays(arrays, schema=batch.schema)
            yield batch

    return docs.mapInArrow(run, docs.schema)


def documents(spark, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
