"""Sinks that publish data before the manifest that makes it valid, fingerprints, and a cache keyed by them."""

from __future__ import annotations

import hashlib
import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "_manifest.json"


def fingerprint(value: object) -> str:
    """SHA-256 of a value's JSON with sorted keys."""
    text = json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False)
    return hashlib.sha256(text.encode()).hexdigest()


def content_fingerprint(df: DataFrame) -> dict:
    """Row count and two order-free sums of row digests: equal for equal rows in any order and partitioning."""
    digest = F.md5(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))
    parts = [F.sum(F.conv(F.substring(digest, at, 8), 16, 10).cast("decimal(30,0)")) for at in (1, 9)]
    row = df.agg(F.count("*").alias("rows"), parts[0].alias("a"), parts[1].alias("b")).first()
    return {"rows": row.rows, "digest": f"{int(row.a or 0)}-{int(row.b or 0)}", "schema": df.schema.simpleString()}


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """Writes an object beside ``path`` and renames it over the old one in one operation, so a reader finds the old or the new one."""
    fs, target = _fs(spark, path)
    hadoop = spark._jvm.org.apache.hadoop
    temporary = hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(temporary, True)
    out.write(bytearray(json.dumps(value, ensure_ascii=False, indent=1, allow_nan=False).encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(hadoop.fs.Options.Rename, 1)
    options[0] = hadoop.fs.Options.Rename.OVERWRITE
    hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(temporary), fs.makeQualified(target), options)


def read_json(spark: SparkSession, path: str) -> dict | None:
    """The object at ``path``, None if there is no file."""
    fs, target = _fs(spark, path)
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(text)


def file_identity(spark: SparkSession, path: str | None) -> list | None:
    """Names, lengths and times of the files at a path (a file, or a folder's files); None for no path."""
    if not path:
        return None
    fs, target = _fs(spark, path)
    if not fs.exists(target):
        return [path]
    return [path, *sorted([str(f.getPath().getName()), f.getLen(), f.getModificationTime()] for f in fs.listStatus(target))]


def identity_of(spark: SparkSession, folder: str) -> str | None:
    """The identity that a folder was published with."""
    return (read_json(spark, os.path.join(folder, MANIFEST)) or {}).get("identity")


def publish(tables: dict[str, DataFrame], folder: str, identity: dict) -> None:
    """Writes tables to ``folder`` and, after all of them, the manifest that names them; an old manifest goes first."""
    spark = next(iter(tables.values())).sparkSession
    fs, manifest = _fs(spark, os.path.join(folder, MANIFEST))
    if fs.exists(manifest):
        fs.delete(manifest, False)
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(os.path.join(folder, name))
    write_json(spark, os.path.join(folder, MANIFEST), {"status": "ready", "identity": fingerprint(identity), "tables": sorted(tables)})


def load(spark: SparkSession, folder: str, identity: dict | None = None) -> dict[str, DataFrame]:
    """The published tables; an error without a manifest, or with one of another identity."""
    manifest = read_json(spark, os.path.join(folder, MANIFEST))
    if not manifest or manifest.get("status") != "ready":
        raise ValueError(f"{folder} is not ready")
    if identity is not None and manifest["identity"] != fingerprint(identity):
        raise ValueError(f"{folder} was made from something else")
    return {name: spark.read.parquet(os.path.join(folder, name)) for name in manifest["tables"]}


class Cache:
    """Tables by the fingerprint of what they were made from. A stored entry is never overwritten."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, identity: dict) -> str:
        return os.path.join(self.folder, fingerprint(identity))

    def get(self, identity: dict) -> dict[str, DataFrame] | None:
        manifest = read_json(self.spark, os.path.join(self._path(identity), MANIFEST))
        return load(self.spark, self._path(identity)) if manifest else None

    def get_or_make(self, identity: dict, make) -> dict[str, DataFrame]:
        """The stored tables, else those of ``make()``, stored first."""
        if (found := self.get(identity)) is None:
            publish(make(), self._path(identity), identity)
            found = self.get(identity)
        return found


def upsert(stored: DataFrame | None, rows: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """Replaces the rows of the keys in ``rows``, keeps the others, and writes all to a new ``folder``; keys must be unique."""
    duplicated = rows.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if duplicated:
        raise ValueError(f"key given twice: {duplicated[0]}")
    merged = rows if stored is None else stored.join(rows.select(*keys), keys, "left_anti").unionByName(rows, allowMissingColumns=True)
    merged.write.mode("error").parquet(folder)
    return rows.sparkSession.read.parquet(folder)
