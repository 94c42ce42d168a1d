"""A vector store that merges on read: bucketed base files, small layers of changes, and a manifest.

Points are dealt to a fixed number of buckets by the hash of their id. A change writes one layer with its own rows
alone (upserted points, and tombstones of deleted ones), and then a manifest that lists it; so a change of 1 % writes
about 1 % of the bytes. A reader takes the newest row of each point in the layers, and of the base files what no layer
names. Buckets whose layers have grown to SHARE of their base rows are compacted alone; beyond LAYERS, layers are merged
with each other.

A manifest has a number, and the one with the next number is put in place only if nobody else has put one there: by a
hard link in a local folder, by a rename that does not replace elsewhere. Whoever comes second reads the new manifest
and puts its change on top of it, so two writers at once lose nothing; the later one wins a point that both change.
A compaction goes in only where the base files it has read are still in place, and gives up otherwise. Files become
part of the store by the manifest alone: what a failed or lost task leaves behind is never read.

The version before the current one stays readable; files that only older ones name are deleted.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.misc import point_id
from tessera.operators import pivots
from tessera.operators.nearest import nearest
from tessera.runtime import BROADCAST_ROWS
from tessera.sources.schemas import VECTORS

BUCKETS, SHARE, LAYERS, KEPT, ATTEMPTS = 16, 0.25, 8, 2, 50
COLUMNS = [c.split()[0] for c in VECTORS.split(", ")]
LAYER = VECTORS + ", bucket int, deleted boolean"


class VectorStore:
    """Points (point_id, kind, source_id, text, vector, metadata) under a path; a closed store refuses all calls."""

    def __init__(self, spark: SparkSession, path: str, dim: int, buckets: int = BUCKETS):
        if dim < 1 or buckets < 1:
            raise ValueError("dim and buckets must be at least 1")
        self.spark, self.path, self.dim, self.open = spark, path.rstrip("/"), dim, True
        self._indexes: dict[tuple, pivots.PivotIndex] = {}
        if not self.versions():
            self._put({"dim": dim, "buckets": buckets, "version": 0, "next": 0, "base": {}, "layers": []})
        held = self.manifest()
        if held["dim"] != dim:
            raise ValueError(f"the collection has vectors of {held['dim']} components, not {dim}")
        self.buckets = held["buckets"]

    def __enter__(self) -> VectorStore:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        self.open = False

    # --- manifests ------------------------------------------------------------------------------------

    def _fs(self):
        if not self.open:
            raise ValueError("the store is closed")
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        """Versions that can be read, the current one last."""
        fs, path = self._fs()
        return sorted(int(f.getPath().getName()[9:-5]) for f in fs.globStatus(path(f"{self.path}/manifest-*.json")) or [])

    def manifest(self, version: int | None = None) -> dict:
        fs, path = self._fs()
        held = fs.open(path(f"{self.path}/manifest-{self.versions()[-1] if version is None else version:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(held, "UTF-8"))
        finally:
            held.close()

    def _put(self, manifest: dict) -> bool:
        """Put a manifest in place under its version; whether nobody else was there before."""
        fs, path = self._fs()
        draft, final = path(f"{self.path}/.draft-{uuid4().hex}"), path(f"{self.path}/manifest-{manifest['version']:012d}.json")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        try:
            if fs.getUri().getScheme() == "file":
                try:
                    os.link(draft.toUri().getPath(), final.toUri().getPath())
                    return True
                except FileExistsError:
                    return False
            return not fs.exists(final) and fs.rename(draft, final)
        finally:
            fs.delete(draft, False)

    def _commit(self, change: Callable[[dict], dict | None]) -> bool:
        """Put change(manifest) in place, on top of whatever others have put there meanwhile; False if change gives up."""
        for _ in range(ATTEMPTS):
            held = self.manifest()
            new = change(json.loads(json.dumps(held)))
            if new is None:
                return False
            if self._put(new | {"version": held["version"] + 1}):
                self._expire()
                return True
        raise OSError(f"{ATTEMPTS} attempts to change {self.path} met other writers")

    @staticmethod
    def _files(manifest: dict) -> set[str]:
        return {f"{x['path']}/bucket={b}" for b, x in manifest["base"].items()} | {x["path"] for x in manifest["layers"]}

    def _expire(self) -> None:
        """Delete what only versions before the last KEPT name."""
        fs, path = self._fs()
        versions = self.versions()
        kept = set().union(*(self._files(self.manifest(v)) for v in versions[-KEPT:]))
        folders = {f.split("/")[0] for f in kept}
        for v in versions[:-KEPT]:
            try:
                gone = self._files(self.manifest(v)) - kept
            except Exception:  # another writer has deleted it meanwhile  # noqa: BLE001
                continue
            for f in gone:
                top = f.split("/")[0]
                fs.delete(path(f"{self.path}/{f if top in folders else top}"), True)
            fs.delete(path(f"{self.path}/manifest-{v:012d}.json"), False)

    def _drop(self, folder: str) -> None:
        fs, path = self._fs()
        fs.delete(path(f"{self.path}/{folder}"), True)

    # --- reading --------------------------------------------------------------------------------------

    def _base(self, manifest: dict, buckets: set[str]) -> DataFrame | None:
        found = [f"{self.path}/{x['path']}/bucket={b}" for b, x in manifest["base"].items() if b in buckets]
        return self.spark.read.schema(VECTORS).parquet(*found) if found else None

    def _changes(self, layers: list[dict], buckets: set[str]) -> DataFrame | None:
        """The newest row of each point that the layers name, tombstones included."""
        out = None
        for x in layers:
            if own := [int(b) for b in x["rows"] if b in buckets]:
                part = self.spark.read.schema(LAYER).parquet(f"{self.path}/{x['path']}").where(F.col("bucket").isin(own)).withColumn("__layer", F.lit(x["number"]).cast("bigint"))
                out = part if out is None else out.unionByName(part)
        if out is None or len(layers) == 1:
            return None if out is None else out.drop("__layer")
        newest = F.row_number().over(Window.partitionBy("point_id").orderBy(F.desc("__layer")))
        return out.withColumn("__rn", newest).where("__rn = 1").drop("__rn", "__layer")

    def frame(self, version: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """All points of a version (the current one), or those of some buckets.

        Base rows are read once and not shuffled while the layers' rows, by the manifest's count, are few enough to
        be broadcast.
        """
        m = self.manifest(version)
        wanted = {str(b) for b in (range(self.buckets) if buckets is None else buckets)}
        base, changes = self._base(m, wanted), self._changes(m["layers"], wanted)
        if changes is None:
            return base.select(*COLUMNS) if base is not None else self.spark.createDataFrame([], VECTORS)
        new = changes.where("NOT deleted").select(*COLUMNS)
        if base is None:
            return new
        named = changes.select("point_id")
        few = sum(n for x in m["layers"] for n in x["rows"].values()) <= BROADCAST_ROWS
        return base.join(F.broadcast(named) if few else named, "point_id", "left_anti").select(*COLUMNS).unionByName(new)

    def get(self, keys: DataFrame) -> DataFrame:
        """The points of the given (kind, source_id), from their buckets alone."""
        asked = self._keyed(keys).select("point_id", "bucket").distinct()
        buckets = {r["bucket"] for r in asked.select("bucket").distinct().collect()}  # the number of buckets at most
        return self.frame(buckets=buckets).join(asked.select("point_id"), "point_id", "left_semi").select(*COLUMNS)

    def counts(self) -> DataFrame:
        """(kind, n): the points of each kind."""
        return self.frame().groupBy("kind").agg(F.count("*").alias("n"))

    def count(self, kind: str | None = None) -> int:
        f = self.frame()
        return (f.where(F.col("kind") == kind) if kind else f).count()

    def query(self, queries: DataFrame, limit: int = 8, kind: str | None = None, pruned: bool = False) -> DataFrame:
        """(query_id, rank, source_id, score) of the nearest points; pruned: by an index of pivots, which serves until the store changes."""
        wrong = queries.where(F.size("vector") != self.dim).select(F.size("vector")).first()
        if wrong is not None:
            raise ValueError(f"a query has {wrong[0]} components, the collection {self.dim}")
        if not pruned:
            return nearest(self.frame(), queries, limit, kind)
        key = (self.versions()[-1], kind)
        if key not in self._indexes:
            self._indexes = {k: x for k, x in self._indexes.items() if k[0] == key[0]} | {key: pivots.build(self.frame(key[0]), self.dim, kind)}
        return pivots.search(self._indexes[key], queries, limit).hits

    # --- changes --------------------------------------------------------------------------------------

    def _keyed(self, rows: DataFrame) -> DataFrame:
        keyed = rows.withColumn("point_id", point_id(F.col("kind"), F.col("source_id")))
        return keyed.withColumn("bucket", F.pmod(F.xxhash64("point_id"), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame, name: str, by_bucket: bool) -> tuple[str, dict[str, int]]:
        """Write rows (with bucket); the folder, and the rows of each bucket."""
        folder = f"{name}-{uuid4().hex}"
        out = rows.repartition("bucket").sortWithinPartitions("bucket", "kind", "point_id").write
        (out.partitionBy("bucket") if by_bucket else out).parquet(f"{self.path}/{folder}")
        held = self.spark.read.schema(LAYER).parquet(f"{self.path}/{folder}").groupBy("bucket").count().collect()
        return folder, {str(r["bucket"]): r["count"] for r in held}

    def _add(self, rows: DataFrame) -> None:
        m = self.manifest()
        first = not m["base"] and not m["layers"]
        folder, counts = self._write(rows, "base" if first else "layer", first)
        if not counts:
            return self._drop(folder)

        def change(held: dict) -> dict:
            if first and not held["base"] and not held["layers"] and held["version"] == m["version"]:
                return held | {"base": {b: {"path": folder, "rows": n} for b, n in counts.items()}}
            return held | {"layers": [*held["layers"], {"number": held["next"], "path": folder, "rows": counts}], "next": held["next"] + 1}

        self._commit(change)
        self._tidy()

    def upsert(self, records: DataFrame) -> None:
        """Rows (kind, source_id, text, vector, metadata[, seq]) replace those of their point; the last of several wins."""
        wrong = records.where(F.col("vector").isNull() | (F.size("vector") != self.dim)).select(F.size("vector")).first()
        if wrong is not None:
            raise ValueError(f"a vector has {wrong[0]} components, the collection {self.dim}")
        last = F.row_number().over(Window.partitionBy("point_id").orderBy(F.desc(F.col("seq") if "seq" in records.columns else F.lit(0))))
        new = self._keyed(records).withColumn("__rn", last).where("__rn = 1").withColumn("vector", F.col("vector").cast("array<float>"))
        self._add(new.select(*COLUMNS, "bucket", F.lit(False).alias("deleted")))

    def delete(self, keys: DataFrame) -> None:
        """Remove the points of the given (kind, source_id); those that are not there change nothing."""
        if not self.manifest()["base"] and not self.manifest()["layers"]:
            return
        gone = self._keyed(keys.select("kind", "source_id").distinct())
        empty = {"text": F.lit(None).cast("string"), "vector": F.lit(None).cast("array<float>"), "metadata": F.lit(None).cast("string")}
        self._add(gone.withColumns(empty).select(*COLUMNS, "bucket", F.lit(True).alias("deleted")))

    def _tidy(self) -> None:
        try:
            self._compact_full()
        except Exception:
            # the change itself is in place; the files that this read may be gone since others went on
            if self._began in self.versions():
                raise

    def _compact_full(self) -> None:
        m = self.manifest()
        self._began = m["version"]
        rows = {b: sum(x["rows"].get(b, 0) for x in m["layers"]) for b in {b for x in m["layers"] for b in x["rows"]}}
        full = {int(b) for b, n in rows.items() if n > SHARE * m["base"].get(b, {"rows": 0})["rows"]}
        if full:
            self.compact(full)
        if len(self.manifest()["layers"]) > LAYERS:
            self.merge()

    def compact(self, buckets: set[int] | None = None) -> bool:
        """Write the base files of these buckets (all) anew, with their layers' rows; False if others were there before."""
        m = self.manifest()
        chosen = {str(b) for b in (range(self.buckets) if buckets is None else buckets)}
        points = self._keyed(self.frame(m["version"], {int(b) for b in chosen})).withColumn("deleted", F.lit(False))
        folder, counts = self._write(points.select(*COLUMNS, "bucket", "deleted"), "base", True)
        merged = {x["path"] for x in m["layers"]}

        def change(held: dict) -> dict | None:
            if any(held["base"].get(b) != m["base"].get(b) for b in chosen) or not merged <= {x["path"] for x in held["layers"]}:
                return None
            base = {b: x for b, x in held["base"].items() if b not in chosen} | {b: {"path": folder, "rows": n} for b, n in counts.items()}
            layers = [x | {"rows": {b: n for b, n in x["rows"].items() if b not in chosen}} if x["path"] in merged else x for x in held["layers"]]
            return held | {"base": base, "layers": [x for x in layers if x["rows"]]}

        done = self._commit(change)
        if not done or not counts:
            self._drop(folder)
        return done

    def merge(self) -> bool:
        """Merge all layers into one; False if others were there before."""
        m = self.manifest()
        changes = self._changes(m["layers"], {str(b) for b in range(self.buckets)})
        if changes is None:
            return False
        folder, counts = self._write(changes.select(*COLUMNS, "bucket", "deleted"), "layer", False)

        def change(held: dict) -> dict | None:
            if held["layers"][: len(m["layers"])] != m["layers"]:
                return None
            one = {"number": m["layers"][-1]["number"], "path": folder, "rows": counts}
            return held | {"layers": [one, *held["layers"][len(m["layers"]) :]]}

        done = self._commit(change)
        if not done:
            self._drop(folder)
        return done
