"""The store: one Parquet folder for each version of a table, and a manifest that names the current ones.

A writer writes only the tables that change, then a new manifest (table, folder) under the next number. A manifest is
written elsewhere and renamed into its place, which fails if another writer has taken the number: that writer's changes
are then read and the manifest made anew, so none is lost. Readers open the manifest with the highest number and see the
old tables or the new ones, never a mixture. ``collect`` removes what the last manifests no longer name.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queryvitals.schemas import DAILY, KEPT, TABLES


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        root = path(self.root)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _manifests(self) -> list[int]:
        fs, path = self._fs()
        folder = path(f"{self.root}/manifests")
        if not fs.exists(folder):
            return []
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(folder) if f.getPath().getName().isdigit())

    def _manifest(self, number: int) -> dict[str, str]:
        fs, path = self._fs()
        stream = fs.open(path(f"{self.root}/manifests/{number:012d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def version(self) -> int:
        """The number of the current manifest; 0 for an empty store."""
        return max(self._manifests(), default=0)

    def exists(self) -> bool:
        return self.version() > 0

    def read(self, table: str) -> DataFrame:
        """The current version of a table; empty with its schema where it was never written."""
        number = self.version()
        folder = self._manifest(number).get(table) if number else None
        if folder is None:
            return self.spark.createDataFrame([], TABLES[table])
        reader = self.spark.read
        if table in DAILY:
            # Without rows there is no day, and so no file that would have the schema.
            kinds = TABLES[table] if "day date" in TABLES[table] else TABLES[table] + ", day date"
            reader = reader.schema(kinds)
        return reader.parquet(f"{self.root}/{folder}")

    def versions(self, *tables: str) -> tuple:
        """The folders of the current versions of some tables: equal as long as none of them has changed."""
        number = self.version()
        named = self._manifest(number) if number else {}
        return tuple(named.get(t) for t in tables)

    def write(self, tables: dict[str, DataFrame]) -> int:
        """New versions of ``tables``; all others stay what and where they are. The number of the new manifest."""
        made = {}
        for table, df in tables.items():
            made[table] = f"{table}/{uuid.uuid4().hex}"
            writer = df.write
            if table in DAILY:
                dated = df if "day" in df.columns else df.withColumn("day", F.to_date("occurred_at"))
                # One task writes a day's files, or a few for a large day.
                writer = dated.hint("rebalance", "day").write.partitionBy("day")
            writer.parquet(f"{self.root}/{made[table]}")
        return self._publish(made)

    def _publish(self, made: dict[str, str]) -> int:
        fs, path = self._fs()
        fs.mkdirs(path(f"{self.root}/manifests"))
        while True:
            number = self.version()
            named = (self._manifest(number) if number else {}) | made
            draft = path(f"{self.root}/manifests/.draft-{uuid.uuid4().hex}")
            stream = fs.create(draft, False)
            stream.write(bytearray(json.dumps(named).encode()))
            stream.close()
            target = path(f"{self.root}/manifests/{number + 1:012d}")
            if not fs.exists(target) and fs.rename(draft, target):
                return number + 1
            fs.delete(draft, False)

    def collect(self, keep: int = 2) -> list[str]:
        """Remove table versions that none of the last ``keep`` manifests names, and older manifests."""
        fs, path = self._fs()
        numbers = self._manifests()
        named = {f for n in numbers[-keep:] for f in self._manifest(n).values()}
        gone = []
        for table in TABLES:
            folder = path(f"{self.root}/{table}")
            for version in fs.listStatus(folder) if fs.exists(folder) else []:
                name = f"{table}/{version.getPath().getName()}"
                if name not in named:
                    fs.delete(version.getPath(), True)
                    gone.append(name)
        for n in numbers[:-keep]:
            fs.delete(path(f"{self.root}/manifests/{n:012d}"), False)
        return gone

    def reload(self, tables: dict[str, DataFrame]) -> int:
        """Replace everything but the queue and the digests."""
        return self.write({k: v for k, v in tables.items() if k not in KEPT})

    def meta(self) -> dict[str, str]:
        return {r["key"]: r["value"] for r in self.read("meta").collect()}

    def write_meta(self, values: dict[str, str]) -> None:
        merged = self.meta() | values
        self.write({"meta": self.spark.createDataFrame(sorted(merged.items()), TABLES["meta"])})
