"""A stream's sink with a commit of its own: a batch shows whole or not at all, and each row once.

Tasks write their rows to files of their own under ``path/data``. When all tasks of a batch are done, the
driver writes one manifest that lists their files, put in place by one rename. A reader takes listed files
only, so what a killed task or a second attempt has left is never seen. The first manifest of a batch
stands: a batch that is run again after it was committed drops its new files. Files are reached
through pyarrow, so ``path`` is on a file system pyarrow knows; executors need pyarrow only.
"""

import contextlib
import json
import sys
import time
import uuid

from pyarrow import fs, parquet
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage

from changeflow.sinks.tables import landed

# The writer travels to tasks with the plan; executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "changeflow_committed"
MANIFEST = "run string, batch_id long, file string, n_rows long"


def file_system(path):
    """The file system of a path or URI, and the path on it."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def _exists(system, path):
    return system.get_file_info(path).type != fs.FileType.NotFound


class Written(WriterCommitMessage):
    """What a task has written: the names of its files with their rows."""

    def __init__(self, files):
        self.files = files


class CommittedWriter(DataSourceStreamArrowWriter):
    """Writes a batch: tasks write files, ``commit`` lists them, ``abort`` removes them.

    ``progress`` is the stream's checkpoint location, whose id tells its batches from those of
    another stream that writes to the same path.
    """

    def __init__(self, path, progress):
        self.path, self.progress = path, progress

    def write(self, batches):
        system, root = file_system(self.path)
        name, writer, n_rows = f"{uuid.uuid4().hex}.parquet", None, 0
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if writer is None:
                    system.create_dir(f"{root}/data", recursive=True)
                    writer = parquet.ParquetWriter(f"{root}/data/{name}", batch.schema, filesystem=system)
                writer.write_batch(batch)
                n_rows += batch.num_rows
        finally:
            if writer is not None:
                writer.close()
        return Written([(name, n_rows)] if n_rows else [])

    def _run(self):
        system, progress = file_system(self.progress)
        with system.open_input_stream(f"{progress}/metadata") as source:
            return json.loads(source.read())["id"]

    def _drop(self, messages):
        system, root = file_system(self.path)
        for message in messages:
            for name, _ in message.files if message is not None else []:
                # A file that is gone already is what an abort wants.
                with contextlib.suppress(FileNotFoundError):
                    system.delete_file(f"{root}/data/{name}")

    def commit(self, messages, batch_id):
        system, root = file_system(self.path)
        run, folder = self._run(), f"{root}/manifests"
        target = f"{folder}/{run}-{batch_id:012d}.json"
        if _exists(system, target):
            self._drop(messages)
            return
        listed = [
            {"run": run, "batch_id": batch_id, "file": name, "n_rows": n_rows}
            for message in messages for name, n_rows in message.files
        ]
        system.create_dir(folder, recursive=True)
        aside = f"{folder}/.{uuid.uuid4().hex}"
        with system.open_output_stream(aside) as out:
            out.write("".join(json.dumps(line) + "\n" for line in listed).encode())
        system.move(aside, target)

    def abort(self, messages, batch_id):
        self._drop(messages)


class CommittedSource(DataSource):
    """The format under which Spark finds the writer."""

    @classmethod
    def name(cls):
        return FORMAT

    def streamWriter(self, schema, overwrite):
        return CommittedWriter(self.options["path"], self.options["progress"])


def start_committed(rows, path, checkpoint_location, interval=None):
    """Write a stream of rows to ``path``, each row once; returns the streaming query.

    ``interval`` is the flush interval, such as ``"1 second"``; without one the stream handles all there
    is and stops. Streams with checkpoint locations of their own may share a path.
    """
    rows.sparkSession.dataSource.register(CommittedSource)
    writer = (
        rows.writeStream.format(FORMAT)
        .option("path", path)
        .option("progress", checkpoint_location)
        .option("checkpointLocation", checkpoint_location)
    )
    if interval is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=interval).start()


def committed_batches(spark, path):
    """The files of all committed batches with their rows; none before the first batch."""
    try:
        return spark.read.schema(MANIFEST).json(f"{path}/manifests")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def committed_log(spark, path, schema):
    """The rows of all committed batches.

    Manifests are found before files are, so a batch that is committed meanwhile is left out whole. The list of
    files meets the rows by file name and is small beside them; filters and columns reach the scan.
    """
    listed = committed_batches(spark, path).select(F.col("file").alias("_file"))
    rows = landed(spark, f"{path}/data", schema)
    if not rows.inputFiles():
        return rows
    named = rows.withColumn("_file", F.col("_metadata.file_name"))
    return named.join(listed, "_file", "left_semi").select(*rows.columns)


def remove_unlisted(spark, path, older_than_s):
    """Remove files that no manifest lists and that are older than any task now running; returns their number.

    Killed tasks leave such files. The driver holds the names of all files, as it does when Spark reads them.
    """
    system, root = file_system(path)
    files = [
        f for f in system.get_file_info(fs.FileSelector(f"{root}/data", allow_not_found=True))
        if f.mtime_ns < (time.time() - older_than_s) * 1e9
    ]
    listed = {r.file for r in committed_batches(spark, path).select("file").toLocalIterator()}
    removed = [f for f in files if f.base_name not in listed]
    for f in removed:
        system.delete_file(f.path)
    return len(removed)
