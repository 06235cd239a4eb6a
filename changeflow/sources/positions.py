"""The landed log as a stream whose offsets are log positions: a file and a place in it.

The log is laid out as ``write_change_log`` does, a folder per log file. A batch is the changes after one position
up to another. The driver plans it from folder names and file footers alone: whole log files before the start
are not opened, and of others only the row groups that reach into the range are read. Rows of one position
are landed together, and a log file gets no more rows once a later one is there.

Files are reached through pyarrow, so ``path`` is on a file system pyarrow knows.
"""

import json
import sys
import urllib.parse

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs, parquet
from pyspark import cloudpickle
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from changeflow.schemas import CHANGE_SCHEMA
from changeflow.sinks.committed import file_system

# The reader travels to tasks with the plan; executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "changeflow_positions"
FILE, POS = "binlog_file", "binlog_pos"
#: Bytes of row groups, as they are before compression, that one task reads.
SPLIT_BYTES = 256 << 20


def file_order(name):
    """Log file names order by length, then as text: a name may outgrow its padding."""
    return len(name), name


class Piece(InputPartition):
    """What a task reads: row groups of files, each with the range of positions that counts."""

    def __init__(self, parts):
        self.parts = parts


class PositionReader(DataSourceStreamReader):
    """Reads changes between positions; offsets hold the last position read."""

    def __init__(self, path, schema, start, max_files=None, progress=None):
        self.path, self.schema, self.start = path, schema, start
        self.max_files, self.progress = max_files, progress
        self.at = None

    def initialOffset(self):
        return self.start

    def _saved(self):
        """The end of the last batch that the stream has planned, from its checkpoint; None before the first."""
        if self.progress is None:
            return None
        system, root = file_system(self.progress)
        found = system.get_file_info(fs.FileSelector(f"{root}/offsets", allow_not_found=True))
        planned = [f for f in found if f.base_name.isdigit()]
        if not planned:
            return None
        with system.open_input_stream(max(planned, key=lambda f: int(f.base_name)).path) as source:
            return json.loads(source.read().decode().splitlines()[-1])

    def _folders(self, first, last=None):
        """Log files from ``first`` to ``last`` in order, with their folders."""
        system, root = file_system(self.path)
        folders = {}
        for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if info.type == fs.FileType.Directory and info.base_name.startswith(f"{FILE}="):
                folders[urllib.parse.unquote(info.base_name[len(FILE) + 1 :])] = info.path
        wanted = [n for n in folders if file_order(n) >= file_order(first)]
        if last is not None:
            wanted = [n for n in wanted if file_order(n) <= file_order(last)]
        return [(n, folders[n]) for n in sorted(wanted, key=file_order)]

    def _groups(self, folder):
        """Row groups of a log file: (file, group, bytes, least position, greatest position)."""
        system, _ = file_system(self.path)
        for info in system.get_file_info(fs.FileSelector(folder)):
            if info.type != fs.FileType.File or info.base_name[0] in "._":
                continue
            footer = parquet.read_metadata(info.path, filesystem=system)
            for k in range(footer.num_row_groups):
                group = footer.row_group(k)
                if not group.num_rows:
                    continue
                at = next(i for i in range(group.num_columns) if group.column(i).path_in_schema == POS)
                known = group.column(at).statistics
                if known is not None and known.has_min_max:
                    low, high = known.min, known.max
                else:
                    with system.open_input_file(info.path) as source:
                        values = parquet.ParquetFile(source).read_row_group(k, columns=[POS])[POS]
                    low, high = pc.min(values).as_py(), pc.max(values).as_py()
                if high is not None:
                    yield info.path, k, group.total_byte_size, low, high

    def latestOffset(self):
        """The last position of the log, or of the next ``max_files`` log files that hold anything new."""
        at = self.at or self._saved() or self.start
        end, taken = at, 0
        folders = self._folders(at["file"])
        # Without a limit only the last log file that holds rows matters.
        for name, folder in folders if self.max_files else reversed(folders):
            last = max((high for *_, high in self._groups(folder)), default=None)
            if last is None or (name == at["file"] and last <= at["pos"]):
                continue
            end, taken = {"file": name, "pos": last}, taken + 1
            if taken == (self.max_files or 1):
                break
        return end

    def partitions(self, start, end):
        self.at = end
        pieces, parts, held = [], [], 0
        for name, folder in self._folders(start["file"], end["file"]):
            above = start["pos"] if name == start["file"] else None
            upto = end["pos"] if name == end["file"] else None
            for path, group, size, low, high in self._groups(folder):
                if (above is not None and high <= above) or (upto is not None and low > upto):
                    continue
                if parts and held + size > SPLIT_BYTES:
                    pieces.append(Piece(parts))
                    parts, held = [], 0
                parts.append((name, path, group, above, upto))
                held += size
        return [*pieces, Piece(parts)] if parts else pieces

    def read(self, partition):
        system, _ = file_system(self.path)
        target = to_arrow_schema(self.schema)
        for name, path, group, above, upto in partition.parts:
            with system.open_input_file(path) as source:
                file = parquet.ParquetFile(source)
                there = set(file.schema_arrow.names)
                columns = [c for c in {*target.names, POS} if c in there]
                for batch in file.iter_batches(row_groups=[group], columns=columns):
                    pos = batch.column(POS)
                    keep = pc.is_valid(pos)
                    if above is not None:
                        keep = pc.and_(keep, pc.greater(pos, above))
                    if upto is not None:
                        keep = pc.and_(keep, pc.less_equal(pos, upto))
                    batch = batch.filter(keep)
                    if batch.num_rows:
                        yield self._shaped(batch, name, target)

    def _shaped(self, batch, name, target):
        """The batch with the columns asked for; those that a file lacks are null."""
        arrays = []
        for field in target:
            if field.name == FILE:
                arrays.append(pa.array([name], pa.string()).take(pa.array([0] * batch.num_rows)))
            elif field.name in batch.schema.names:
                arrays.append(batch.column(field.name).cast(field.type))
            else:
                arrays.append(pa.nulls(batch.num_rows, field.type))
        return pa.RecordBatch.from_arrays(arrays, names=target.names)

    def commit(self, end):
        self.at = end


class PositionSource(DataSource):
    """The format under which Spark finds the reader."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return T.StructType.fromJson(json.loads(self.options["columns"]))

    def streamReader(self, schema):
        options = self.options
        start = {"file": options.get("startfile", ""), "pos": int(options.get("startpos", "0")) - 1}
        limit = options.get("maxfiles")
        return PositionReader(
            options["path"], schema, start, int(limit) if limit else None, options.get("progress")
        )


def stream_from_position(
    spark, path, binlog_file="", binlog_pos=0, schema=CHANGE_SCHEMA, max_files=None, checkpoint_location=None
):
    """The landed log as a stream from a position on; its first position where none is given.

    ``schema`` names the columns to read; others stay on disk. Rows without a position have no place in the stream.

    ``max_files`` log files are read in a batch at most; then ``checkpoint_location``, that of the stream, is
    needed, which tells a restarted stream where it stands. Each start with the trigger ``availableNow`` reads one such
    batch; an interval reads on until the end.
    """
    if max_files is not None and checkpoint_location is None:
        raise ValueError("max_files needs the stream's checkpoint_location")
    spark.dataSource.register(PositionSource)
    reader = (
        spark.readStream.format(FORMAT)
        .option("path", path)
        .option("columns", schema.json())
        .option("startFile", binlog_file)
        .option("startPos", binlog_pos)
    )
    if max_files is not None:
        reader = reader.option("maxFiles", max_files).option("progress", checkpoint_location)
    return reader.load()
