"""Tables kept as a base and deltas (SNK2).

A manifest names the folders that make up each table of a location, in order. A writer puts its rows into folders of its
own and then publishes a manifest with the next number, by a rename that fails if that number is taken; it then starts
again from the manifest of the other writer. So two writers lose nothing, a write that was cut off was never named, and
everything that one manifest names, in any number of tables, appears at once. A delta may hold a row for a key that
earlier folders hold too: the latest counts, and one with ``removed`` true takes the key away. Compaction puts the latest
rows into one folder and leaves deltas that were published meanwhile behind it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEPT_MANIFESTS = 100
FOLDER = r"data-([0-9a-f]{32})"


class Versions:
    def __init__(self, spark: SparkSession, location: str):
        self.spark, self.location = spark, location.rstrip("/")
        self._fs_api = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        root = self._fs_api.Path(self.location)
        self._fs = root.getFileSystem(self._conf)
        self._root = self._fs.makeQualified(root)

    def _manifest(self, name: str):
        return self._fs_api.Path(f"{self._root}/_manifest/{name}")

    def current(self) -> dict:
        """The newest manifest: ``number``, ``tables`` (folders of each) and ``marks`` (what the writers noted)."""
        folder = self._fs_api.Path(f"{self._root}/_manifest")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        numbers = [int(n) for n in names if n.isdigit()]
        if not numbers:
            return {"number": -1, "tables": {}, "marks": {}}
        stream = self._fs.open(self._manifest(str(max(numbers))))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, change: Callable[[dict], dict | None]) -> dict:
        """Publishes what ``change`` makes of the current manifest; None leaves it as it is."""
        while True:
            now = self.current()
            new = change(json.loads(json.dumps(now)))
            if new is None:
                return now
            new["number"] = now["number"] + 1
            draft = self._manifest(f".draft-{uuid.uuid4().hex}")
            out = self._fs.create(draft)
            out.write(bytearray(json.dumps(new).encode()))
            out.close()
            jvm = self.spark.sparkContext._jvm
            context = self._fs_api.FileContext.getFileContext(self._root.toUri(), self._conf)
            none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            try:
                context.rename(draft, self._manifest(str(new["number"])), none)
            except Py4JJavaError as e:
                self._fs.delete(draft, False)
                if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
                    raise
                continue
            self._fs.delete(self._manifest(str(new["number"] - KEPT_MANIFESTS)), False)
            return new

    def write(self, df: DataFrame) -> str:
        """Rows in a folder of their own, which belongs to no table yet."""
        folder = f"data-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.location}/{folder}")
        return folder

    def folder(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.location}/{name}")

    def append(self, table: str, df: DataFrame, **marks) -> dict:
        """Adds the rows to the table, as its last folder."""
        return self.publish(added({table: self.write(df)}, marks))

    def rows(self, table: str, schema: str, manifest: dict | None = None) -> DataFrame:
        """All rows of the table's folders, with ``_seq``, the folder's place in their order."""
        folders = (manifest or self.current())["tables"].get(table, [])
        if not folders:
            return self.spark.createDataFrame([], schema).withColumn("_seq", F.lit(0))
        order = F.create_map(*[x for k, f in enumerate(folders) for x in (F.lit(f.removeprefix("data-")), F.lit(k))])
        name = F.regexp_extract("_metadata.file_path", FOLDER, 1)
        read = self.spark.read.schema(schema).parquet(*[f"{self.location}/{f}" for f in folders])
        return read.withColumn("_seq", order[name])

    def latest(self, table: str, schema: str, keys: list[str], manifest: dict | None = None) -> DataFrame:
        """The latest row of every key, without the removed ones (``removed boolean`` is added to the schema)."""
        rows = self.rows(table, f"{schema}, removed boolean", manifest)
        rest = [c for c in rows.columns if c not in (*keys, "_seq")]
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_seq").alias("_last")).select(*keys, "_last.*")
        return last.filter("removed IS NOT TRUE").drop("removed")

    def compact(self, table: str, schema: str, keys: list[str]) -> dict:
        """One folder in place of all that the table has now; of two compactions at once the second changes nothing."""
        seen = self.current()
        old = seen["tables"].get(table, [])
        if len(old) < 2:
            return seen
        base = self.write(self.latest(table, schema, keys, seen))

        def change(m):
            now = m["tables"].get(table, [])
            if now[: len(old)] != old:
                return None
            m["tables"][table] = [base, *now[len(old):]]
            return m

        return self.publish(change)


def added(folders: dict[str, str], marks: dict) -> Callable[[dict], dict]:
    """The change that adds a folder to each of the named tables and notes the marks."""
    def change(m):
        for table, folder in folders.items():
            m["tables"].setdefault(table, []).append(folder)
        m["marks"].update(marks)
        return m

    return change
