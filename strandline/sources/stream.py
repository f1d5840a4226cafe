"""Rows to a client while they come: Arrow batches pulled one after the other, and one JSON document on a text stream."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import TextIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.terms import json_text


def arrow_batches(df: DataFrame) -> Iterator[pa.RecordBatch]:
    """The rows of ``df`` in the order of its partitions, as Arrow batches.

    Executors turn rows into Arrow bytes. The driver fetches a partition when the one before it is being read, and waits with
    the next until then: it holds two partitions at most, whatever the size of the whole. Ranges of ``pages`` are such partitions."""
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema) as out:
                out.write_batch(b)
            yield pa.record_batch({"batch": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    for row in df.mapInArrow(packed, "batch binary").toLocalIterator(prefetchPartitions=True):
        with pa.ipc.open_stream(pa.py_buffer(row["batch"])) as stream:
            yield from stream


def write_document(out: TextIO, rows: DataFrame, document: Column, about: dict, properties: DataFrame | None = None) -> int:
    """Write {..., "paths": [...], ...} to ``out`` row by row; returns the number of paths. ``about`` has the other fields;
    ``path_count`` is added behind the paths, when it is known. ``properties`` (resource, properties) becomes an object.

    Nothing is held but the batch that is being written."""
    out.write("{\n" + "".join(f"{json.dumps(k)}: {json.dumps(about[k])},\n" for k in sorted(about) if k < "paths"))
    out.write('"paths": [')
    count = _listed(out, rows.select(document.alias("text")))
    out.write(f'],\n"path_count": {count}')
    out.write("".join(f",\n{json.dumps(k)}: {json.dumps(about[k])}" for k in sorted(about) if k >= "paths"))
    if properties is not None:
        pair = lambda x: F.concat(F.lit('{"predicate":'), json_text(x["predicate"]), F.lit(',"value":'), json_text(x["value"]), F.lit("}"))
        out.write(',\n"properties": {')
        _listed(out, properties.select(F.concat(json_text("resource"), F.lit(":["), F.array_join(F.transform("properties", pair), ","), F.lit("]")).alias("text")))
        out.write("}")
    out.write("\n}\n")
    return count


def _listed(out: TextIO, lines: DataFrame) -> int:
    n = 0
    for batch in arrow_batches(lines):
        for text in batch.column(0).to_pylist():
            out.write((",\n" if n else "\n") + text)
            n += 1
    return n
