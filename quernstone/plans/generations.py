"""Immutable snapshots: build, validate, publish, select, remove, and what a new build may reuse."""

import hashlib
import json
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GENERATION = re.compile(r"^\d{8}T\d{6}Z-[0-9a-f]{8}$")


def fingerprint(value: object) -> str:
    """The SHA-256 of a value as sorted compact JSON."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


class Store:
    """Snapshots under a folder of any file system that Spark reaches; a one-line pointer names the current one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _write(self, name: str, text: str) -> None:
        """Replaces a small file as a whole: written beside it, then renamed over it."""
        target, temporary = self._path(f"{self.root}/{name}"), self._path(f"{self.root}/.{name}.{uuid.uuid4().hex}")
        out = self.fs.create(temporary, True)
        out.write(bytearray(text, "utf-8"))
        out.close()
        if not self.fs.rename(temporary, target):
            self.fs.delete(target, False)
            self.fs.rename(temporary, target)

    def _read(self, name: str) -> str | None:
        p = self._path(f"{self.root}/{name}")
        if not self.fs.exists(p):
            return None
        return "\n".join(r[0] for r in self.spark.read.option("wholetext", True).text(f"{self.root}/{name}").collect())

    def build(self, tables: dict[str, DataFrame], settings: dict, partial: bool = False) -> str:
        """Writes tables to a staging folder, validates the counts read back, renames it, and selects it unless partial."""
        name = time.strftime("%Y%m%dT%H%M%SZ", time.gmtime()) + "-" + uuid.uuid4().hex[:8]
        staging, final = f"{self.root}/staging-{name}", f"{self.root}/{name}"
        counts = {}
        for table, rows in tables.items():
            rows.write.parquet(f"{staging}/{table}")
            counts[table] = self.spark.read.parquet(f"{staging}/{table}").count()
        manifest = {"generation": name, "settings": settings, "fingerprint": fingerprint(settings), "counts": counts, "partial": partial}
        self.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{staging}/manifest")
        if not self.fs.rename(self._path(staging), self._path(final)):
            raise RuntimeError(f"{name} could not be published")
        if not partial:
            self.use(name)
        return name

    def names(self) -> list[str]:
        """Published generations, the newest first."""
        if not self.fs.exists(self._path(self.root)):
            return []
        return sorted((s.getPath().getName() for s in self.fs.listStatus(self._path(self.root)) if GENERATION.match(s.getPath().getName())), reverse=True)

    def manifest(self, name: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.root}/{name}/manifest").first()[0])

    def current(self) -> str | None:
        text = self._read("current.json")
        return json.loads(text)["generation"] if text else None

    def table(self, table: str, name: str | None = None) -> DataFrame:
        """A table of a generation, resolved once, so that a read stays on the snapshot it began with."""
        name = name or self.current()
        if name is None:
            raise LookupError("no generation is selected")
        return self.spark.read.parquet(f"{self.root}/{name}/{table}")

    def use(self, name: str) -> bool:
        """Selects a generation after checking its counts; False if it is the current one already."""
        if self.current() == name:
            return False
        m = self.manifest(name)
        for table, n in m["counts"].items():
            if self.spark.read.parquet(f"{self.root}/{name}/{table}").count() != n:
                raise ValueError(f"{name}: {table} does not have its {n} rows")
        self._write("current.json", json.dumps({"generation": name}))
        return True

    def remove(self, name: str, confirmed: str) -> None:
        """Deletes a generation that is not current; the id must be given twice."""
        if name != confirmed or name not in self.names():
            raise ValueError("the id must be repeated and known")
        if name == self.current():
            raise ValueError("the current generation cannot be removed")
        self.fs.delete(self._path(f"{self.root}/{name}"), True)


def violations(documents: DataFrame, units: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(rule, n)``: rows that break integrity; every n of a sound snapshot is 0."""
    ids = [("documents", documents, "document_id"), ("units", units, "unit_id"), ("chunks", chunks, "chunk_id")]
    links = [("units of no document", units, documents, "document_id"), ("chunks of no unit", chunks, units, "unit_id"), ("chunks of no document", chunks, documents, "document_id"), ("vectors of no chunk", vectors, chunks, "chunk_id")]
    parts = [d.where(F.col(k).isNotNull()).groupBy(k).count().where("count > 1").agg(F.count(F.lit(1)).alias("n")).withColumn("rule", F.lit(f"repeated ids in {name}")) for name, d, k in ids]
    parts += [a.where(F.col(k).isNotNull()).join(b.select(k).distinct(), k, "left_anti").agg(F.count(F.lit(1)).alias("n")).withColumn("rule", F.lit(name)) for name, a, b, k in links]
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    parts.append(vectors.where(F.col("vector").isNull() | bad).agg(F.count(F.lit(1)).alias("n")).withColumn("rule", F.lit("vectors not finite")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("rule", "n")


def reusable_vectors(chunks: DataFrame, snapshot: DataFrame, model: str) -> DataFrame:
    """``(chunk_id, vector, reused)``: each chunk with the stored vector of its exact text and model, null where it must be embedded.

    The snapshot is ``(content_sha256, embedding_model, vec_id, vector)``; of several the smallest vec_id counts.
    """
    usable = snapshot.where((F.col("embedding_model") == model) & F.col("content_sha256").isNotNull() & F.col("vector").isNotNull())
    first = usable.groupBy("content_sha256").agg(F.min_by("vector", "vec_id").alias("vector"))
    keyed = chunks.select("chunk_id", F.sha2("contents", 256).alias("content_sha256"))
    return keyed.join(first, "content_sha256", "left").select("chunk_id", "vector", F.col("vector").isNotNull().alias("reused"))


def reuse_axes(before: dict, now: dict) -> dict[str, bool]:
    """What a build may take over: units by extraction and loss budget, chunks by chunking too, vectors by the model alone."""
    same = lambda *keys: all(before.get(k) == now.get(k) for k in keys)
    units = same("extraction", "cleaning", "loss_budget")
    return {"units": units, "chunks": units and same("chunking"), "vectors": same("embedding_model") and not before.get("headers", False)}


def no_change(before: DataFrame, now: DataFrame, key: str, digest: str) -> bool:
    """Whether two source tables hold the same keys and digests."""
    a, b = before.select(key, digest), now.select(key, digest)
    return not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()


def run_stages(store_root: str, spark: SparkSession, identity: str, stages: list) -> list[str]:
    """Runs named stages ``(name, make)`` in order, each written once per identity; those already written are skipped."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    done = []
    for name, make in stages:
        path = f"{store_root.rstrip('/')}/work-{identity}/{name}"
        marker = fs_path(f"{path}/_SUCCESS")
        if not marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
            make().write.mode("overwrite").parquet(path)
            done.append(name)
    return done
