"""A table of rows by key whose changes are atomic: new files first, then one small commit.

The folder holds ``data/<id>/bucket=<b>/*.parquet`` and ``commits/<version>.json``. A commit names the
folder of every bucket that has rows, so readers see one version or the next, never half of a
write. A change writes the buckets of its keys anew and leaves the others where they are.

* Two writers: a commit's file takes its name only if that is free; the one who comes second
  looks at the new head, keeps its files if the other change lies in other buckets, and works them out
  again if not.
* Replays: a change may carry (writer, batch); a batch that the table has seen does nothing.
* The number of buckets belongs to the table. It doubles with the next change when the mean bucket is
  over ``BUCKET_ROWS``; every bucket then falls into two.

Files of superseded versions stay for readers that are still on them; :func:`vacuum` removes them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..session import stash

BUCKET_ROWS = 1_000_000
ATTEMPTS = 20


class CommitConflict(RuntimeError):
    """The table changed again and again while a change was being written."""


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target, jvm


def _read_text(spark: SparkSession, path: str) -> str:
    files, target, jvm = _files(spark, path)
    stream = files.open(target)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """A new file, whole or not at all; False if there is one already."""
    folder, _, name = path.rpartition("/")
    files, fresh, jvm = _files(spark, f"{folder}/.{name}-{uuid.uuid4().hex}")
    stream = files.create(fresh, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    target = jvm.org.apache.hadoop.fs.Path(path)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(files.makeQualified(fresh), files.makeQualified(target), options)  # refuses to replace a file
        return True
    except Exception:  # the file system's own exception, through the gateway
        if not files.exists(target):
            raise
        files.delete(fresh, False)
        return False


def head(spark: SparkSession, path: str) -> dict:
    """The newest commit."""
    files, target, _ = _files(spark, f"{path}/commits")
    names = sorted((s.getPath().getName() for s in files.listStatus(target)), reverse=True)
    for name in (n for n in names if n.endswith(".json") and not n.startswith(".")):
        return json.loads(_read_text(spark, f"{path}/commits/{name}")) | {"version": int(name.split(".")[0])}
    raise FileNotFoundError(f"no commit in {path}")


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, key: str, buckets: int, path: str) -> dict[str, list]:
    """{bucket: [folder, rows]} of freshly written buckets."""
    spark, folder = rows.sparkSession, f"{path}/data/{uuid.uuid4().hex}"
    placed = stash(rows.withColumn("bucket", _bucket(key, buckets)))
    sizes = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per bucket
    if sizes:
        placed.repartition("bucket").sortWithinPartitions("bucket", key).write.partitionBy("bucket").parquet(folder)
    return {str(r["bucket"]): [folder.removeprefix(f"{path}/"), r["n"]] for r in sizes}


def create(rows: DataFrame, path: str, key: str, buckets: int = 8) -> None:
    """A new table with these rows; raises if there is one."""
    files, target, _ = _files(rows.sparkSession, f"{path}/commits")
    if files.exists(target):
        raise FileExistsError(path)
    first = {"key": key, "schema": rows.schema.json(), "buckets": buckets, "places": _write(rows, key, buckets, path), "batches": {}}
    if not _create(rows.sparkSession, f"{path}/commits/{1:020d}.json", json.dumps(first)):
        raise FileExistsError(path)


def _scan(spark: SparkSession, path: str, at: dict, buckets: list[str] | None = None) -> DataFrame:
    places = {b: p for b, p in at["places"].items() if buckets is None or b in buckets}
    schema = T.StructType.fromJson(json.loads(at["schema"]))
    folders = [f"{path}/{folder}/bucket={b}" for b, (folder, _) in places.items()]
    # A bucket's own folder is read, so its number is not a column.
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, key: str | int | None = None) -> DataFrame:
    """The newest version; with ``key`` only that key's bucket is opened."""
    at = head(spark, path)
    if key is None:
        return _scan(spark, path, at)
    own = spark.range(1).select(F.lit(key).cast(T.StructType.fromJson(json.loads(at["schema"]))[at["key"]].dataType).alias(at["key"]))
    bucket = own.select(_bucket(at["key"], at["buckets"])).first()[0]
    return _scan(spark, path, at, [str(bucket)]).filter(F.col(at["key"]) == key)


def change(path: str, keys: DataFrame, rows: Callable[[DataFrame], DataFrame], batch: tuple[str, int] | None = None) -> bool:
    """Replaces all rows of ``keys`` by ``rows(their rows until now)``; False if the batch was applied before.

    ``rows`` must give rows of these keys only. ``keys`` has the key column and may repeat.
    """
    spark = keys.sparkSession
    keys, done, base = stash(keys.distinct()), None, None
    for _ in range(ATTEMPTS):
        at = head(spark, path)
        key, buckets = at["key"], at["buckets"]
        if batch is not None and at["batches"].get(batch[0], -1) >= batch[1]:
            return False
        grown = sum(n for _, n in at["places"].values()) > BUCKET_ROWS * buckets
        same = base is not None and not grown and base["buckets"] == buckets and all(
            at["places"].get(b) == base["places"].get(b) for b in done[0])
        if not same:
            new_buckets = 2 * buckets if grown else buckets
            own = stash(keys.withColumn("bucket", _bucket(key, buckets)))
            touched = [str(r[0]) for r in own.select("bucket").distinct().collect()]  # at most one per bucket
            touched = sorted(at["places"]) if grown else touched
            old = _scan(spark, path, at, touched)
            kept = old.join(own.select(key), key, "left_anti")
            fresh = rows(old.join(own.select(key), key, "left_semi")).select(*old.columns)
            done, base = (touched, _write(kept.unionByName(fresh), key, new_buckets, path), new_buckets), at
        places = {} if done[2] != buckets else {b: p for b, p in at["places"].items() if b not in done[0]}
        batches = at["batches"] | ({batch[0]: batch[1]} if batch else {})
        text = json.dumps({k: at[k] for k in ("key", "schema")} | {"buckets": done[2], "places": places | done[1], "batches": batches})
        if _create(spark, f"{path}/commits/{at['version'] + 1:020d}.json", text):
            return True
    raise CommitConflict(path)


def upsert(changes: DataFrame, path: str, batch: tuple[str, int] | None = None) -> bool:
    """The rows of ``changes`` take the place of all earlier rows of their keys."""
    key = head(changes.sparkSession, path)["key"]
    changes = stash(changes)
    return change(path, changes.select(key), lambda _: changes, batch)


def insert(changes: DataFrame, path: str, batch: tuple[str, int] | None = None) -> bool:
    """Adds the rows of keys that the table does not have; rows of known keys are left out."""
    key = head(changes.sparkSession, path)["key"]
    changes = stash(changes)
    return change(path, changes.select(key), lambda old: old.unionByName(changes.join(old.select(key), key, "left_anti")), batch)


def delete(keys: DataFrame, path: str, batch: tuple[str, int] | None = None) -> bool:
    """Removes all rows of ``keys``."""
    key = head(keys.sparkSession, path)["key"]
    return change(path, keys.select(key), lambda old: old.limit(0), batch)


def vacuum(spark: SparkSession, path: str) -> None:
    """Removes data folders that the newest version does not name; no reader may be on an older one."""
    files, target, _ = _files(spark, f"{path}/data")
    named = {folder.split("/")[-1] for folder, _ in head(spark, path)["places"].values()}
    for status in files.listStatus(target):
        if status.getPath().getName() not in named:
            files.delete(status.getPath(), True)
