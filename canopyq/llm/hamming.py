"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes are cut into segments, and a table for each segment maps its value to the codes that have it. Searching every segment within radius r
finds all codes within m * (r + 1) - 1 bits of the query, by the pigeonhole principle; with j further segments searched at radius r + 1 the bound grows by j.
Radii grow one segment at a time until the k-th verified distance is within the bound, so the answer is proved exact.

A table's distinct values are taken radius by radius: by the patterns of that many bits while these are fewer than the values, else by the values' own distances to the query's. So
no radius costs more than the values that there are, and no size of the index turns the search into a scan.

Equal codes are one entry of the index. Codes are dealt into shards of 100,000 or more, and each query goes to every shard; a task builds a shard's tables,
plain arrays sorted by segment value, and sends k + 1 ids a query at most. Few shards are copied to several blocks of queries, so that all cores have work; else only queries beyond a
block's rows make a further copy: rows shuffled are shards x queries + blocks x codes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from canopyq.plans.storage import stored


@dataclass(frozen=True)
class SearchRules:
    """Neighbours wanted, bits of a segment (8 or 16), least and most codes of a shard, and most and least queries of a block."""

    k: int = 10
    segment_bits: int = 16
    least_shard: int = 100_000
    most_shard: int = 1_000_000
    block_rows: int = 1_000_000
    least_block: int = 64


def sign_codes(vectors: DataFrame, vector: str, bits: int, key: str = "vec_id") -> DataFrame:
    """Binary codes of vectors, (key, code): bit i of the code is set where component i is above 0, 64 bits to a long.

    Null vectors have no code and are left out; missing or null components count as not above 0. Other columns are not taken over.
    """

    def word(at: int):
        parts = [F.when(F.get(F.col(vector), F.lit(i)) > 0, F.lit(1 << (i - at) if i - at < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(at, min(at + 64, bits))]
        while len(parts) > 1:
            parts = [a.bitwiseOR(b) for a, b in zip(parts[::2], parts[1::2], strict=False)] + ([parts[-1]] if len(parts) % 2 else [])
        return parts[0]

    return vectors.where(F.col(vector).isNotNull()).select(key, F.array(*(word(at) for at in range(0, bits, 64))).alias("code"))


class SegmentTables:
    """The segment tables of one shard's codes."""

    def __init__(self, codes: np.ndarray, segment_bits: int) -> None:
        self.codes, self.bits = codes, segment_bits
        self.segments = codes.view("<u2" if segment_bits == 16 else "u1")
        self.order = [np.argsort(s, kind="stable") for s in self.segments.T]
        found = [np.unique(s[o], return_index=True) for s, o in zip(self.segments.T, self.order, strict=True)]
        self.values, self.begin = [v for v, _ in found], [np.append(b, len(codes)) for _, b in found]
        self.verified = 0
        self.masks: list[np.ndarray] = []

    def mask(self, radius: int) -> np.ndarray:
        """All patterns of ``radius`` bits of a segment."""
        while len(self.masks) <= radius:
            r = len(self.masks)
            self.masks.append(np.array([sum(1 << b for b in c) for c in combinations(range(self.bits), r)], self.segments.dtype))
        return self.masks[radius]

    def search(self, query: np.ndarray, k: int, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances of all codes no farther than the one with which ``k`` ids are reached (``weight``: ids of a code)."""
        own = query.view(self.segments.dtype)
        m, n = len(own), len(self.codes)
        seen = np.zeros(n, bool)
        places, distances = np.zeros(0, np.int64), np.zeros(0, np.int64)
        far: dict[int, np.ndarray] = {}
        for step in range(m * (self.bits + 1)):
            radius, segment = divmod(step, m)
            values, begin = self.values[segment], self.begin[segment]
            if math.comb(self.bits, radius) <= len(values):
                probe = own[segment] ^ self.mask(radius)
                at = np.minimum(np.searchsorted(values, probe), len(values) - 1)
                at = at[values[at] == probe]
            else:  # fewer values than patterns
                if segment not in far:
                    far[segment] = np.bitwise_count(values ^ own[segment])
                at = np.flatnonzero(far[segment] == radius)
            size = begin[at + 1] - begin[at]
            fresh = self.order[segment][np.repeat(begin[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            fresh = fresh[~seen[fresh]]
            seen[fresh] = True
            places = np.append(places, fresh)
            distances = np.append(distances, np.bitwise_count(self.codes[fresh] ^ query).sum(1).astype(np.int64))
            bound = step  # segments 0..segment at this radius, the others at one less: m * radius + segment
            if len(places) == n or weight[places[distances <= bound]].sum() >= k:
                break
        self.verified += len(places)
        order = np.argsort(distances, kind="stable")
        enough = np.searchsorted(np.cumsum(weight[places[order]]), k)
        last = distances[order[min(enough, len(order) - 1)]] if len(order) else 0
        kept = order[distances[order] <= last]
        return places[kept], distances[kept]


def nearest_ids(flat: np.ndarray, begin: np.ndarray, weight: np.ndarray, places: np.ndarray, distances: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` ids of the codes at ``places``, by distance and then id, and their distances; code p has ``weight[p]`` ids of ``flat`` from ``begin[p]`` on."""
    size = weight[places]
    at = np.repeat(begin[places] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    ids, far = flat[at], np.repeat(distances, size)
    order = np.lexsort((ids, far))[:k]
    return ids[order], far[order]


def _words(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype("<i8").view("<u8").reshape(len(flat), -1)


def top_k(codes: DataFrame, queries: DataFrame, rules: SearchRules = SearchRules(), key: str = "vec_id") -> DataFrame:
    """The ``k`` nearest rows of ``codes`` for each row of ``queries`` by Hamming distance: (query_id, rank, neighbour_id, distance).

    Ties go to the smaller id. A row doesn't find itself: its own id is left out. Null ids are left out on either side, repeated ids count once with each
    of their codes. Fewer than ``k`` other rows give as many as there are; an empty index or query set gives no row.
    """
    valid = codes.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), "code").distinct()
    by_code = Window.partitionBy("code").orderBy("id")
    near = valid.withColumn("at", F.row_number().over(by_code)).where(F.col("at") <= rules.k + 1)  # the k + 1 smallest ids of a code answer any query
    index = stored(near.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "codes")
    asked = queries.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), "code").distinct()
    wanted = stored(asked.select("code").distinct(), "queries")
    size = index.count()
    even = size // (2 * codes.sparkSession.sparkContext.defaultParallelism)
    shards = max(1, -(-size // min(max(even, rules.least_shard), rules.most_shard)))
    n_wanted, cores = wanted.count(), codes.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n_wanted // rules.block_rows), min(-(-2 * cores // shards), n_wanted // rules.least_block))
    dealt_index = index.select(F.pmod(F.xxhash64("code"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "code", "ids")
    dealt_query = wanted.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("code"), F.lit(blocks)).cast("int").alias("block"), "code")

    def run(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        if not left.num_rows or not right.num_rows:
            return
        tables, lists = SegmentTables(_words(left.column("code")), rules.segment_bits), left.column("ids").combine_chunks()
        weight, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
        begin = np.cumsum(weight) - weight
        for at in range(0, right.num_rows, 1024):
            part = right.slice(at, 1024)
            ids, distances, sizes = [], [], []
            for q in _words(part.column("code")):
                places, distance = tables.search(q, rules.k + 1, weight)
                near, far = nearest_ids(flat, begin, weight, places, distance, rules.k + 1)
                ids.append(near)
                distances.append(far)
                sizes.append(len(near))
            code = part.column("code").combine_chunks().take(pa.array(np.repeat(np.arange(part.num_rows), sizes)))
            yield pa.RecordBatch.from_arrays([code, pa.array(np.concatenate(distances), pa.int32()), pa.array(np.concatenate(ids), pa.int64())], ["code", "distance", "neighbour_id"])

    tasks = 4 * shards * blocks  # little data but much work in each: a fixed count, with room for equal hashes, keeps them apart
    dealt_index, dealt_query = (d.repartition(tasks, "shard", "block") for d in (dealt_index, dealt_query))

    def table(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("code", pa.list_(pa.int64())), ("distance", pa.int32()), ("neighbour_id", pa.int64())])
        return pa.Table.from_batches([b.cast(schema) for b in run(left, right)], schema)

    each = dealt_index.groupBy("shard", "block").cogroup(dealt_query.groupBy("shard", "block")).applyInArrow(table, "code array<long>, distance int, neighbour_id long")
    best = Window.partitionBy("code").orderBy("distance", "neighbour_id")
    answer = each.withColumn("at", F.row_number().over(best)).where(F.col("at") <= rules.k + 1).drop("at")
    paired = asked.withColumnRenamed("id", "query_id").join(answer, "code").where("query_id <> neighbour_id")
    ranked = paired.groupBy("query_id", "neighbour_id").agg(F.min("distance").alias("distance"))
    order = Window.partitionBy("query_id").orderBy("distance", "neighbour_id")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rules.k).select("query_id", "rank", "neighbour_id", "distance")
