"""Row-wise application of numpy kernels to text columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyq.llm import kernels as K

#: Most bytes of a batch of texts on its way to Python.
BATCH_BYTES = 4 << 20
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_small_batches(texts: DataFrame) -> DataFrame:
    """The same rows, sent to Python in batches of at most ``BATCH_BYTES`` besides single longer ones: texts are long, and both sides hold a batch whole.

    Sets the session's ``spark.sql.execution.arrow.maxBytesPerBatch``, unless it is smaller already.
    """
    conf = texts.sparkSession.conf
    if int("".join(c for c in conf.get(_SETTING) if c.isdigit())) > BATCH_BYTES:
        conf.set(_SETTING, str(BATCH_BYTES))
    return texts


#: Bytes and row offsets of a chunk's texts, and the other inputs' arrays for its rows -> one array for each result.
Kernel = Callable[..., list[pa.Array]]


def annotated(docs: DataFrame, keep: tuple[str, ...], text: str, others: list[Column], make: Callable[[], Kernel], results: dict[str, str], where: str | None = None) -> DataFrame:
    """The columns ``keep`` of each row and the results of a kernel on its column ``text``.

    ``make`` runs once a task and returns the kernel. Inside, columns go by place, so names of the input never clash with
    those of results; with ``where``, a condition on the results, rows are filtered by it and the results dropped. A text that is kept is sent once.
    """
    types = [docs.schema[c].dataType.simpleString() for c in keep]
    schema = ", ".join([f"k{i} {t}" for i, t in enumerate(types)] + [f"{name} {t}" for name, t in results.items()])
    n, m = len(keep), len(others)
    kept = next((i for i, c in enumerate(keep) if c == text and types[i] == "string"), None)
    place, more_at = (n, n + 1) if kept is None else (kept, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for batch in K.lean(batches):
            data, offsets = K.string_parts(batch.column(place))
            more = [batch.column(more_at + i) for i in range(m)]
            for a, b, part, at in K.chunks(data, offsets):
                found = kernel(part, at, *(c.slice(a, b - a) for c in more))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(n)), *found], [*(f"k{i}" for i in range(n)), *results])

    quoted = [docs[f"`{c}`"] for c in keep]
    sent = [docs[f"`{text}`"].cast("string").alias("t")] if kept is None else []
    inputs = [c.alias(f"k{i}") for i, c in enumerate(quoted)] + sent + [c.alias(f"o{i}") for i, c in enumerate(others)]
    out = in_small_batches(docs.select(*inputs)).mapInArrow(K.given_back(run), schema)
    named = [F.col(f"k{i}").alias(c) for i, c in enumerate(keep)]
    return out.where(where).select(*named) if where else out.select(*named, *results)


def lists(values: np.ndarray) -> pa.ListArray:
    """Rows of a matrix as lists."""
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * width, pa.int32()), pa.array(values.ravel()))
