"""Keyed snapshots as immutable parts under a manifest: upserts, atomic switches, compaction.

A commit writes one new part (a Parquet folder) and then one manifest that lists
the live parts; creating the manifest file is the switch, so readers see a commit whole or not
at all. Parts of one level are merged into one of the next when there are FANOUT
of them, keeping the newest row of each key: a read opens at most FANOUT - 1 parts a
level, and the rows that newer ones replace are at most a share of the live
ones. All files live in the store's folder, which driver and executors share.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FANOUT = 4
KEPT_MANIFESTS = 2  # the current one, and one for readers that have just opened the one before
DELETED = "_deleted"


@dataclass(frozen=True)
class Part:
    """``seq`` orders parts: of two rows of one key, the one in the part with the larger ``seq`` counts."""

    path: str
    level: int
    seq: int


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    batch: int = -1
    parts: tuple[Part, ...] = field(default=())
    schema: str | None = None


class SnapshotStore:
    """Rows by key under ``path``; ``keys`` are never null in a row that is written."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], fanout: int = FANOUT):
        self.spark, self.root, self.keys, self.fanout = spark, path.rstrip("/"), list(keys), fanout

    def _folder(self, name: str):
        """Hadoop path and its file system."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        path, fs = self._folder("manifest")
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        """The given version, or the current one; an empty store has version 0."""
        versions = self.versions() if version is None else [version]
        if not versions:
            return Manifest()
        path, _ = self._folder(f"manifest/{versions[-1]:020d}.json")
        told = json.loads("".join(r["value"] for r in self.spark.read.option("wholetext", True).text(path.toString()).collect()))  # one small file
        return Manifest(told["version"], told["batch"], tuple(Part(**p) for p in told["parts"]), told["schema"])

    def _switch(self, manifest: Manifest) -> None:
        """Put the manifest in place: written beside, then renamed to a name that must not exist yet."""
        told = {"version": manifest.version, "batch": manifest.batch, "parts": [vars(p) for p in manifest.parts], "schema": manifest.schema}
        beside, fs = self._folder(f"staged/{uuid.uuid4().hex}.json")
        out = fs.create(beside, True)
        out.write(bytearray(json.dumps(told).encode()))
        out.close()
        path, _ = self._folder(f"manifest/{manifest.version:020d}.json")
        fs.mkdirs(path.getParent())
        if fs.exists(path) or not fs.rename(beside, path):
            raise RuntimeError(f"version {manifest.version} of {self.root} was written by another commit")

    def _read(self, part: Part, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{part.path}").withColumn("_seq", F.lit(part.seq))

    def _newest(self, parts: Sequence[Part], schema: T.StructType) -> DataFrame:
        """The newest row of each key; a single part is its own, and needs no shuffle."""
        if len(parts) == 1:
            return self._read(parts[0], schema).drop("_seq")
        rows = self._read(parts[0], schema)
        for p in parts[1:]:
            rows = rows.unionByName(self._read(p, schema))
        rest = [c for c in schema.names if c not in self.keys]
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "_seq").alias("_row"))
        return newest.select(*self.keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*schema.names)

    def _write(self, rows: DataFrame, level: int, seq: int) -> Part:
        part = Part(f"parts/{uuid.uuid4().hex}", level, seq)
        rows.write.parquet(f"{self.root}/{part.path}")
        return part

    def upsert(self, rows: DataFrame, batch: int | None = None) -> int:
        """Replace or add the rows of ``rows`` (one per key; where ``_deleted`` is true the key goes) and return the version.

        ``batch`` numbers the commits of a stream: one that is already in is skipped,
        so a micro-batch that is run again changes nothing.
        """
        now = self.manifest()
        if batch is not None and batch <= now.batch:
            return now.version
        if DELETED not in rows.columns:
            rows = rows.withColumn(DELETED, F.lit(False))
        schema = T.StructType.fromJson(json.loads(now.schema)) if now.schema else T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema.fields])
        rows = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])
        version = now.version + 1
        parts = [*now.parts, self._write(rows, 0, version)]
        parts = self._compacted(parts, schema)
        self._switch(Manifest(version, now.batch if batch is None else batch, tuple(parts), schema.json()))
        self._clean()
        return version

    def _compacted(self, parts: list[Part], schema: T.StructType) -> list[Part]:
        """Merge each level that is full into one part of the next; what is deleted goes when nothing older is left."""
        level = 0
        while len(full := [p for p in parts if p.level == level]) >= self.fanout:
            rest = [p for p in parts if p.level != level]
            merged = self._newest(full, schema)
            if not any(p.seq < full[0].seq for p in rest):
                merged = merged.where(~F.col(DELETED))
            parts = sorted([*rest, self._write(merged, level + 1, max(p.seq for p in full))], key=lambda p: p.seq)
            level += 1
        return parts

    def read(self, version: int | None = None) -> DataFrame:
        """The live rows of the current or a kept version."""
        manifest = self.manifest(version)
        if not manifest.parts:
            raise ValueError(f"nothing was ever written to {self.root}")
        schema = T.StructType.fromJson(json.loads(manifest.schema))
        return self._newest(manifest.parts, schema).where(~F.col(DELETED)).drop(DELETED)

    def _clean(self) -> None:
        """Remove manifests that are no longer kept, and parts that no kept one lists (of a crashed commit, too)."""
        versions = self.versions()
        kept = versions[-KEPT_MANIFESTS:]
        live = {p.path.rsplit("/", 1)[1] for v in kept for p in self.manifest(v).parts}
        for v in versions[:-KEPT_MANIFESTS]:
            path, fs = self._folder(f"manifest/{v:020d}.json")
            fs.delete(path, False)
        for folder, names in (("parts", live), ("staged", set())):
            path, fs = self._folder(folder)
            for s in fs.listStatus(path) if fs.exists(path) else []:
                if s.getPath().getName() not in names:
                    fs.delete(s.getPath(), True)
