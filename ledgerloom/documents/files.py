"""Documents as files: written by the tasks that hold them, found again by a manifest."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame

_BATCH = 200  # documents that are read back into one Arrow batch


def write_documents(documents: DataFrame, folder: str, key: str = "rcept_no") -> DataFrame:
    """Write ``(key, file_name, html)`` as UTF-8 files; returns the stored manifest ``(key, file_name, path, n_bytes)``.

    A file has a name of its task's attempt, so a repeated or lost task neither overwrites nor counts twice: only files of
    the manifest count. A document without text is an empty file. ``folder`` is one that all executors reach.
    """
    schema = f"{key} {documents.schema[key].dataType.simpleString()}, file_name string, path string, n_bytes long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get(), 0
        target, root = fs.FileSystem.from_uri(folder)
        target.create_dir(f"{root}/files", recursive=True)
        for batch in batches:
            paths, sizes = [], []
            for html in batch.column(2):
                content = (html.as_py() or "").encode()
                name = f"files/{task.partitionId():06d}-{number:06d}-{task.taskAttemptId()}.html"
                with target.open_output_stream(f"{root}/{name}") as out:
                    out.write(content)
                paths.append(f"{folder}/{name}")
                sizes.append(len(content))
                number += 1
            columns = [batch.column(0), batch.column(1), pa.array(paths, pa.string()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "file_name", "path", "n_bytes"])

    documents.select(key, "file_name", "html").mapInArrow(run, schema).write.parquet(f"{folder}/manifest")
    return documents.sparkSession.read.schema(schema).parquet(f"{folder}/manifest")


def read_documents(manifest: DataFrame, key: str = "rcept_no") -> DataFrame:
    """``(key, file_name, html)`` of the files that a manifest names."""
    schema = f"{key} {manifest.schema[key].dataType.simpleString()}, file_name string, html string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, _BATCH):
                some = batch.slice(first, _BATCH)
                texts = []
                for path in some.column(2).to_pylist():
                    source, name = fs.FileSystem.from_uri(path)
                    with source.open_input_file(name) as file:
                        texts.append(file.read())
                html = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), html], names=[key, "file_name", "html"])

    return manifest.select(key, "file_name", "path").mapInArrow(run, schema)
