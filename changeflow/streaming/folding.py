"""Batches of a stream folded into a snapshot now and then, so that reading costs what is current.

A manifest names the snapshot and the batches that came after it. Each change is a new manifest, written
aside and put in place by one rename; a reader takes the newest and so sees a batch or a snapshot whole
or not at all. One stream writes to a path at a time.
"""

import json
import uuid

from changeflow.session import remove_folder
from changeflow.sinks import batch_path, landed, write_batch

#: Batches after which they are folded.
FOLD_EVERY = 16
_EMPTY = {"number": 0, "snapshot": None, "batches": [], "old": []}


def _files(spark, path):
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(context._jsc.hadoopConfiguration()), context._jvm.org.apache.hadoop.fs.Path


def _names(spark, path):
    system, at = _files(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(at(path))) if system.exists(at(path)) else []


def manifest(spark, path):
    """The newest manifest. Batches of a path without one, written before there were any, all count."""
    numbers = [n for n in _names(spark, f"{path}/_manifests") if n.endswith(".json") and not n.startswith(".")]
    if not numbers:
        found = [
            f"{run}/{batch}"
            for run in _names(spark, path) if run.startswith("run=")
            for batch in _names(spark, f"{path}/{run}") if batch.startswith("batch_id=")
        ]
        return {**_EMPTY, "batches": found}
    system, at = _files(spark, path)
    source = system.open(at(f"{path}/_manifests/{numbers[-1]}"))
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
    finally:
        source.close()


def _swap(spark, path, last, **changed):
    """Put the next manifest in place, and drop those that no reader can still be about to open."""
    content = {**last, **changed, "number": last["number"] + 1}
    system, at = _files(spark, path)
    folder = f"{path}/_manifests"
    system.mkdirs(at(folder))
    aside, target = at(f"{folder}/.{uuid.uuid4().hex}"), at(f"{folder}/{content['number']:012d}.json")
    out = system.create(aside, True)
    try:
        out.write(bytearray(json.dumps(content).encode()))
    finally:
        out.close()
    if system.exists(target) or not system.rename(aside, target):
        raise RuntimeError(f"another stream writes to {path}")
    system.delete(at(f"{folder}/{content['number'] - FOLD_EVERY:012d}.json"), False)


def add_batch(df, path, batch_id, run, schema, fold, fold_every=FOLD_EVERY):
    """Write a batch and name it in the manifest; a retried batch replaces itself.

    Once ``fold_every`` batches have come, those before this one and the snapshot become one snapshot,
    ``fold`` of all their rows. What it replaces is removed one fold later, when no reader that
    started from an older manifest should still need it.
    """
    spark = df.sparkSession
    name = batch_path("", batch_id, run).lstrip("/")
    last = manifest(spark, path)
    others = [b for b in last["batches"] if b != name]
    if len(others) >= fold_every:
        snapshot = f"_snapshots/{last['number'] + 1:012d}-{uuid.uuid4().hex}"
        fold(_rows(spark, path, {**last, "batches": others}, schema)).write.parquet(f"{path}/{snapshot}")
        replaced = [*others, *([last["snapshot"]] if last["snapshot"] else [])]
        kept = [b for b in last["batches"] if b == name]
        _swap(spark, path, last, snapshot=snapshot, batches=kept, old=replaced)
        for folder in last["old"]:
            remove_folder(spark, f"{path}/{folder}")
        last, others = manifest(spark, path), []
    if name in last["batches"]:
        # Not named while it is written anew.
        _swap(spark, path, last, batches=others)
        last = manifest(spark, path)
    write_batch(df, path, batch_id, run=run)
    _swap(spark, path, last, batches=[*others, name])


def _rows(spark, path, named, schema):
    folders = [*([named["snapshot"]] if named["snapshot"] else []), *named["batches"]]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in folders])


def folded_rows(spark, path, schema):
    """The snapshot and the batches after it, as the newest manifest names them."""
    named = manifest(spark, path)
    return _rows(spark, path, named, schema) if named["number"] else landed(spark, path, schema)
