"""Blocks: files of some megabytes of rows in the shared folder, from which later steps are computed.

A step that reads blocks gives the same rows whenever a task is run again, so a
lost executor changes nothing.  Files carry names of their own, and a table
names those of the attempts that succeeded.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from quarry.llm.common import open_fs, releasing, slices, stored

#: Bytes of text in a block, if it is not one long text.
BLOCK_BYTES = 8 << 20


def park(spark: SparkSession, docs: DataFrame, folder: str, key: str, text: str) -> DataFrame:
    """Writes a table as blocks, each in ascending order of the key (nulls first): block, a number."""
    open_fs(folder)[0].create_dir(open_fs(folder)[1], recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            table = table.take(pc.sort_indices(table.column(key), null_placement="at_start"))
            name = uuid.uuid4().int >> 66
            with fs.open_output_stream(f"{base}/block-{name:016x}") as f, pa.ipc.new_file(f, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([name], type=pa.int64())], names=["block"])

        for batch, texts in slices(batches, text):
            held.append(batch)
            size += sum(len(t or b"") + 16 for t in texts)
            if size >= BLOCK_BYTES:
                yield flush()
                size = 0
        if held:
            yield flush()

    return stored(spark, docs.mapInArrow(releasing(run), "block long"), f"{folder}/blocks-{uuid.uuid4().hex}")


def read_block(folder: str, name: int) -> pa.Table:
    fs, base = open_fs(folder)
    with fs.open_input_file(f"{base}/block-{name:016x}") as f:
        return pa.ipc.open_file(f).read_all().combine_chunks()
