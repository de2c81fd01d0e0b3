"""Texts by small slices, so a Python worker holds little whatever a batch brings."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one slice at most, and bytes of its texts at about most.
ROWS, BYTES = 500, 2 << 20
KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    upto, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)), 0
    while at < len(batch):
        to = min(at + ROWS, max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BYTES, "right"))))
        yield batch.slice(at, to - at)
        at = to


def each_text(df: DataFrame, key: str, text: str, schema: str, start: Callable[[], Callable[[str], list[tuple]]], kind: str = "long") -> DataFrame:
    """(key, schema): the rows that a function gives for each text (null: ''). start makes that function, once a task."""
    names, kinds = zip(*(f.split() for f in schema.split(", ")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = start()
        for batch in batches:
            for part in slices(batch, text):
                of, out = [], []
                for i, t in enumerate(part.column(text).to_pylist()):
                    own = rows(t or "")
                    of += [i] * len(own)
                    out += own
                columns = [pa.array([r[k] for r in out], KINDS[c]) for k, c in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(of, pa.int32())), *columns], [key, *names])

    return df.select(F.col(key).cast(kind), text).mapInArrow(run, f"{key} {kind}, {schema}")
