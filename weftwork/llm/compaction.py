"""Size-tiered compaction of immutable shards under a versioned manifest.

Arrivals are appended as small Parquet shards. A version of the table is one manifest, a JSON file with the list of
shards; a version appears by a rename that fails if another writer has taken its number, so readers see whole
versions and writers retry on what they find. Runs (shards that were written together) fall into tiers by size;
as soon as a tier holds FAN_IN runs these merge into one run of files of the target size, without a shuffle, and
merged shards go once no manifest that is kept lists them.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession

from weftwork.llm.files import Store

#: Runs of a tier that merge, bytes of a file that merging aims at, bytes of the smallest tier, versions kept.
FAN_IN, TARGET_BYTES, SMALLEST, KEPT = 4, 128 << 20, 1 << 20, 1


class ShardedTable:
    """A table of shards under ``root``; ``spark`` writes and reads the rows, the driver only lists of files."""

    def __init__(self, spark: SparkSession, root: str, fan_in: int = FAN_IN, target_bytes: int = TARGET_BYTES, smallest: int = SMALLEST):
        self.spark, self.root, self.store = spark, root.rstrip("/"), Store(spark, root)
        self.fan_in, self.target, self.smallest = fan_in, target_bytes, smallest

    def version(self) -> int:
        """The newest version; 0 for a table without any."""
        return max((int(n[1:-5]) for n, _ in self.store.names("_manifests") if n.startswith("v") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        return json.loads(self.store.read(f"_manifests/v{version:012d}.json")) if version else {"version": 0, "schema": None, "runs": []}

    def _write(self, df: DataFrame) -> dict:
        """A new run: its folder, and its files with their sizes."""
        name = f"run-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}")
        files = [[n, size] for n, size in self.store.names(name) if n.endswith(".parquet")]
        return {"run": name, "files": files, "bytes": sum(size for _, size in files)}

    def _commit(self, change) -> dict:
        """The manifest that ``change`` makes of the newest one; anew if another writer was first. None: no change."""
        while True:
            now = self.manifest()
            new = change(now)
            if new is None:
                return now
            new = new | {"version": now["version"] + 1}
            if self.store.publish(f"_manifests/v{new['version']:012d}.json", json.dumps(new)):
                return new

    def append(self, df: DataFrame) -> dict:
        """One run of ``df`` joins the table; a table's first run sets its columns."""
        run, schema = self._write(df), df.schema.json()

        def change(now):
            if now["schema"] not in (None, schema):
                raise ValueError("the columns differ from the table's")
            return {"schema": schema, "runs": now["runs"] + [run]}

        return self._commit(change)

    def tier(self, size: int) -> int:
        return max(0, math.ceil(math.log(max(size, 1) / self.smallest, self.fan_in)))

    def due(self, manifest: dict) -> list[dict] | None:
        """The runs of the lowest tier that has enough of them, the oldest first."""
        tiers: dict[int, list[dict]] = {}
        for run in manifest["runs"]:
            tiers.setdefault(self.tier(run["bytes"]), []).append(run)
        return next((runs[: self.fan_in] for _, runs in sorted(tiers.items()) if len(runs) >= self.fan_in), None)

    def compact(self) -> int:
        """Merges until no tier is due; how many merges were committed."""
        merges = 0
        while runs := self.due(self.manifest()):
            names = {r["run"] for r in runs}
            rows = self._read(self.manifest(), runs)
            merged = self._write(rows.coalesce(max(1, round(sum(r["bytes"] for r in runs) / self.target))))

            def change(now, names=names, merged=merged):
                left = [r for r in now["runs"] if r["run"] not in names]
                if len(left) + len(names) != len(now["runs"]):
                    return None  # another writer has merged some of them
                return {"schema": now["schema"], "runs": left + [merged]}

            new = self._commit(change)
            if merged not in new["runs"]:
                self.store.delete(merged["run"])
                continue
            merges += 1
            self.vacuum()
        return merges

    def vacuum(self, kept: int = KEPT) -> None:
        """Old manifests go, then the shards that were listed in them and in none that stays."""
        versions = sorted(n for n, _ in self.store.names("_manifests") if n.startswith("v") and n.endswith(".json"))
        runs = lambda names: {r["run"] for n in names for r in json.loads(self.store.read(f"_manifests/{n}"))["runs"]}
        old, stay = versions[:-kept], versions[-kept:]
        gone = runs(old) - runs(stay)
        for n in old:
            self.store.delete(f"_manifests/{n}")
        for run in gone:
            self.store.delete(run)

    def _read(self, manifest: dict, runs: list[dict]) -> DataFrame:
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(json.loads(manifest["schema"]))
        paths = [f"{self.root}/{r['run']}/{n}" for r in runs for n, _ in r["files"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (default: the newest)."""
        manifest = self.manifest(version)
        return self._read(manifest, manifest["runs"])
