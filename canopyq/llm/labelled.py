"""Labelled texts for training, bounded first ones of them, and the fold that is held out."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from canopyq.llm import kernels as K
from canopyq.llm.rows import in_small_batches

#: Most labelled texts that a model's first fit sees, and most bytes of text that they hold together; the fit over all of them goes on from there, in blocks of as many texts.
SAMPLE_DOCUMENTS = 5000
SAMPLE_BYTES = 24 << 20
#: Bytes of features after which a block of texts is fitted.
BLOCK_BYTES = 32 << 20


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text is divisible by 5; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _found(docs: DataFrame, labels: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """The documents with a hash of their text; and, for each different text with each of its labels outside the held-out fold, its bytes and smallest id."""
    ids = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label].cast("int").alias("label")).where("doc_id is not null and label is not null")
    ids = ids.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    content = F.coalesce(docs["text"], F.lit(""))
    known = docs.withColumns({"doc_id": docs["doc_id"].cast("long"), "text_hash": F.md5(content.cast("binary"))})
    found = known.select("doc_id", "text_hash", F.octet_length(content).cast("long").alias("bytes")).join(ids, "doc_id")
    return known, found.groupBy("text_hash", "label").agg(F.min("doc_id").alias("doc_id"), F.max("bytes").alias("bytes"))


def _zlib(texts: pa.Array) -> pa.Array:
    return pa.array([zlib.compress(t, 1) for t in texts.cast(pa.binary()).to_pylist()], pa.binary())


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, squeeze: Callable[[pa.Array], pa.Array] = _zlib) -> DataFrame:
    """All texts of ``docs`` outside the held-out fold with their ``label``, as ``labelled_sample`` finds them but every one.

    What ``squeeze`` makes of a text stands in its place and is shuffled once, by ids: zlib streams, which ``opened`` reads, or else any bytes.
    """
    known, each = _found(docs, labels, label)
    moved = known.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).withColumn("text", F.coalesce("text", F.lit("")))
    place = moved.columns.index("text")
    schema = ", ".join(f"`{c}` {'binary' if c == 'text' else t}" for c, t in moved.dtypes)

    def squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.lean(batches):
            yield batch.set_column(place, "text", squeeze(batch.column(place)))

    sent = in_small_batches(moved).mapInArrow(squeezed, schema)
    return sent.join(each.select("doc_id", "text_hash", "label"), ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash", "label"])


def opened(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with the texts of its first column as they were."""
    texts = pa.array([zlib.decompress(t) for t in batch.column(0).to_pylist()], pa.binary())
    return batch.set_column(0, "text", texts.view(pa.string()))


def labelled_count(docs: DataFrame, labels: DataFrame, label: str) -> int:
    """The number of rows of ``labelled_texts``, from hashes alone."""
    return _found(docs, labels, label)[1].count()


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int = SAMPLE_DOCUMENTS, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """Texts of ``docs`` outside the held-out fold with their ``label``: at most ``limit`` that are found, in order of a hash of the text, and at most ``most_bytes`` of them.

    Repeated labels of an id count once, as the largest; null labels and ids are left out. Equal texts with one label count once. Texts are chosen by hash and size alone,
    so only chosen ones move, and the broadcast ids are never more than ``limit``.
    """
    known, each = _found(docs, labels, label)
    chosen = each.orderBy("text_hash", "label").limit(limit)
    running = Window.orderBy("text_hash", "label").rowsBetween(Window.unboundedPreceding, 0)  # over ``limit`` rows of hashes at most
    chosen = chosen.withColumn("so_far", F.sum("bytes").over(running)).where(F.col("so_far") <= most_bytes).select("doc_id", "text_hash", "label")
    return known.join(F.broadcast(chosen), ["doc_id", "text_hash"]).dropDuplicates(["text_hash", "label"])


#: From one block's rows to what its fit found: places in the model, the number of texts behind each, and a row of values for each.
BlockFit = Callable[[list], tuple[np.ndarray, np.ndarray, np.ndarray]]


def mean_of_blocks(texts: DataFrame, rows: Callable[[pa.RecordBatch], Iterator[tuple[int, tuple]]], fit: BlockFit, width: int, having: str, most: int = SAMPLE_DOCUMENTS, most_bytes: int = BLOCK_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Fits every block of ``texts`` in its task and returns the places that any block fitted and their mean values ``v0``, ..., weighted by the texts behind them.

    ``having`` is a condition on these and on ``n``, the number of texts behind a place in all blocks.

    ``rows`` gives each text of a batch as the bytes of its features and what a fit sees of it. A block is closed at ``most`` texts or ``most_bytes`` of features, or with its task, so memory doesn't grow
    with a task's split. A task sends one row for each place, and the means are grouped in Spark, so the driver gets as many rows as the model has places.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = [], 0
        used, weights, sums = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros((0, width))

        def close() -> None:
            nonlocal used, weights, sums
            place, n, values = fit(block)
            both = np.union1d(used, place)
            more, total = np.zeros(len(both), np.int32), np.zeros((len(both), width))
            for at, count, value in ((used, weights, sums), (place, n, n[:, None] * values)):
                at = np.searchsorted(both, at)
                more[at] += count
                total[at] += value
            used, weights, sums = both, more, total

        for batch in K.lean(batches):
            for size, row in rows(batch):
                block.append(row)
                held += size
                if len(block) >= most or held >= most_bytes:
                    close()
                    block, held = [], 0
        if block:
            close()
        block = []
        for begin in range(0, len(used), 1 << 16):
            some = slice(begin, begin + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(used[some].astype(np.int32)), pa.array(weights[some]), *(pa.array(sums[some, i].astype(np.float32)) for i in range(width))], names)

    names = ["place", "n", *(f"v{i}" for i in range(width))]
    sent = in_small_batches(texts).mapInArrow(K.given_back(run), ", ".join(["place int", "n int", *(f"v{i} float" for i in range(width))]))
    total = F.sum("n")
    found = sent.groupBy("place").agg(total.alias("n"), *((F.sum(f"v{i}") / total).alias(f"v{i}") for i in range(width))).where(having).toArrow().combine_chunks()
    return found.column("place").to_numpy(), np.stack([found.column(f"v{i}").to_numpy() for i in range(width)], 1)
