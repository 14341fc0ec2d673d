"""A stored panel in versions: readers see one whole version, and a refresh writes only the buckets it touches.

Rows lie in ``data/<write>/bucket=<k>``, dealt out by a hash of the code. A version is a small file in ``versions``
that names, for each bucket, the write that holds it. It gets its name by one rename, which fails if another
writer was first. What fails before it leaves the version before in force.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.sources.bars import stale_codes
from panelwright.sources.scratch import file_system


class StaleVersionError(RuntimeError):
    """Another writer has published a version in the meantime."""


class PanelStore:
    """The panel under ``path``, in ``buckets`` buckets (fixed by the first version)."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _versions(self) -> list[int]:
        files, folder = file_system(self.spark, f"{self.path}/versions")
        return sorted(int(s.getPath().getName()) for s in (files.listStatus(folder) if files.exists(folder) else ()) if s.getPath().getName().isdigit())

    def version(self) -> int:
        """The newest version, 0 if there is none."""
        return max(self._versions(), default=0)

    def _manifest(self, version: int) -> dict:
        files, path = file_system(self.spark, f"{self.path}/versions/{version:09d}")
        stream = files.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, manifest: dict, after: int) -> int:
        files, draft = file_system(self.spark, f"{self.path}/versions/_{uuid.uuid4().hex}")
        stream = files.create(draft)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        _, target = file_system(self.spark, f"{self.path}/versions/{after + 1:09d}")
        if files.exists(target) or not files.rename(draft, target):
            files.delete(draft, False)
            raise StaleVersionError(f"version {after + 1} is there already")
        return after + 1

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """The rows as a new write: its name by bucket."""
        name = uuid.uuid4().hex
        bucketed = rows.withColumn("bucket", F.pmod(F.xxhash64("code"), F.lit(self.buckets)).cast("int")).repartition("bucket").sortWithinPartitions("bucket", "code", "date")
        bucketed.write.partitionBy("bucket").parquet(f"{self.path}/data/{name}")
        files, folder = file_system(self.spark, f"{self.path}/data/{name}")
        found = (s.getPath().getName() for s in files.listStatus(folder))
        return {x.removeprefix("bucket="): name for x in found if x.startswith("bucket=")}

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the newest."""
        version = self.version() if version is None else version
        if not version:
            raise FileNotFoundError(f"no panel in {self.path}")
        manifest = self._manifest(version)
        folders = [f"{self.path}/data/{write}/bucket={k}" for k, write in sorted(manifest["buckets"].items())]
        schema = manifest["schema"]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _schema(self, rows: DataFrame) -> str:
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def replace_all(self, panel: DataFrame) -> int:
        """A version that holds ``panel`` alone; returns its number."""
        after = self.version()
        return self._publish({"n": self.buckets, "schema": self._schema(panel), "buckets": self._write(panel)}, after)

    def replace(self, codes: DataFrame, rows: DataFrame) -> int:
        """A version in which ``rows`` stand for all rows of ``codes`` (code); buckets without such a code are left as they are."""
        after = self.version()
        manifest = self._manifest(after)
        self.buckets = manifest["n"]
        touched = codes.unionByName(rows.select("code")).select(F.pmod(F.xxhash64("code"), F.lit(self.buckets)).cast("int").alias("bucket")).distinct()
        touched = {str(r.bucket) for r in touched.collect()}  # at most ``buckets`` numbers
        if not touched:
            return after
        kept = {k: w for k, w in manifest["buckets"].items() if k not in touched}
        old = [f"{self.path}/data/{w}/bucket={k}" for k, w in manifest["buckets"].items() if k in touched]
        if old:
            before = self.spark.read.schema(manifest["schema"]).parquet(*old)
            rows = before.join(codes.select("code").distinct(), "code", "left_anti").select(*before.columns).unionByName(rows)
        return self._publish(manifest | {"buckets": kept | self._write(rows)}, after)

    def refresh(self, universe: DataFrame, bars: DataFrame, target: DataFrame, build: Callable[[DataFrame], DataFrame]) -> int:
        """Build anew, from ``bars``, the codes of the universe whose stored rows end before the date in ``target`` (date), or that have none.

        ``build`` makes panel rows of the bars of some codes; it must not look at other codes.
        """
        stale = stale_codes(universe, self.read(), target)
        return self.replace(stale, build(bars.join(stale, "code", "left_semi")))

    def vacuum(self) -> int:
        """Delete all versions but the newest and the writes that only they name; returns the number of writes that went.

        Only when nobody reads an older version or writes.
        """
        *old, last = self._versions() or [0]
        if not last:
            return 0
        files, folder = file_system(self.spark, f"{self.path}/data")
        used = set(self._manifest(last)["buckets"].values())
        gone = [s.getPath() for s in files.listStatus(folder) if s.getPath().getName() not in used]
        for version in old:
            files.delete(file_system(self.spark, f"{self.path}/versions/{version:09d}")[1], False)
        return sum(files.delete(path, True) for path in gone)
