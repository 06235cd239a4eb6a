"""Names for the output of a stream, so that no other stream's batch replaces it."""

import hashlib

from changeflow.session import remove_folder
from changeflow.sinks import batch_path, landed, write_batch


def run_of(batch, checkpoint_location):
    """The streaming query's own id, which its checkpoint location keeps across restarts.

    Batch numbers start again with every new checkpoint location; with the run in their names,
    the folders of an older run stay.
    """
    query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    return query or hashlib.md5(checkpoint_location.encode()).hexdigest()


class RunState:
    """Tables a streaming run carries from batch to batch, under ``path/state``.

    A batch reads what the one before it left and writes its own; a retried batch replaces its own. Older
    batches are removed, so the number of folders does not grow with the run.
    """

    def __init__(self, spark, path, run, batch_id):
        self.spark, self.path, self.run, self.batch_id = spark, f"{path}/state", run, batch_id

    def before(self, name, schema):
        """The table as the batch before left it; no rows before the first batch."""
        if not self.batch_id:
            return self.spark.createDataFrame([], schema)
        return landed(self.spark, batch_path(f"{self.path}/{name}", self.batch_id - 1, self.run), schema)

    def leave(self, name, table):
        write_batch(table, f"{self.path}/{name}", self.batch_id, run=self.run)

    def forget(self, names):
        """Remove what no batch will read again: all older than the batch before this one."""
        old = self.batch_id - 2
        if old < 0:
            return
        for name in names:
            remove_folder(self.spark, batch_path(f"{self.path}/{name}", old, self.run))
