"""Best-fit packing of tokenized documents into sequences, with certified partitions.

1. Tokenize: each document becomes its length and the checksums of its pieces. Only documents longer than a
   sequence are cut; every piece but the first is full, so at most one piece of a document, its rest, has to
   share a sequence.
2. Each partition packs its rests by best-fit decreasing, and a lower bound from dual feasible functions says
   how few sequences its rests could take. A partition whose count equals the bound is done: certified.
3. Partitions with a gap keep their well-filled sequences, and exchange the rests of the others: those are dealt
   into new partitions and packed again, until the count equals the bound over all rests, or an exchange
   saves no sequence.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import tokens
from barloom.llm.common import settled

#: Rests packed by one task, about; the number of partitions grows with the input.
PARTITION_ROWS = 10_000


def tokenize(docs: DataFrame, path: str, capacity: int, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, length, crcs, full_base): ids in the document, end included, and the crc32 of each piece's ids.

    `full_base` plus 1, 2, ... are numbers for its pieces behind the first that no other document has. A null text counts as empty: one id, the end. Ids are hashed as little-endian unsigned 32-bit numbers. Narrow.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("length", pa.int64()), ("crcs", pa.list_(pa.int64())), ("full_base", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lengths, crcs, bases = [], [], []
                for text in part.column(1):
                    ids = np.array([*tokens.encode([text.as_py() or ""], path)[0], end_id], "<u4")
                    first = (len(ids) - 1) % capacity + 1
                    cuts = [0, *range(first, len(ids) + 1, capacity)]
                    lengths.append(len(ids))
                    bases.append(base)
                    base += len(cuts) - 2
                    crcs.append([zlib.crc32(ids[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)])
                yield pa.record_batch([part.column(0), pa.array(lengths, pa.int64()), pa.array(crcs, schema.field(2).type), pa.array(bases, pa.int64())], schema=schema)

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, "doc_id long, length long, crcs array<bigint>, full_base long")


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset, bins): longest first, each into the fullest bin that still takes it."""
    n = len(lengths)
    where, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room left
    rooms = 0  # bit r: some bin has room r
    bins = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, bins
            bins += 1
        where[i], offset[i] = b, capacity - room
        room -= size
        if room:
            open_bins[room].append(b)
            rooms |= 1 << room
    return where, offset, bins


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """The fewest bins that any packing needs, by dual feasible functions; counts[x]: rests of length x.

    The largest over three families of the sum of f(length), f mapping every fitting set of lengths to at
    most 1: the identity; those that give a whole bin to lengths above capacity - t, drop those below t
    and keep the rest (Martello and Toth's L2); and floor-rounding by k (Fekete and Schepers' u).
    """
    counts = counts.astype(np.int64)
    size = np.arange(capacity + 1)
    n_from = np.cumsum(counts[::-1])[::-1]  # lengths of at least x
    sum_to = np.cumsum(counts * size)
    best = -(-int(sum_to[-1]) // capacity)
    for t in range(1, capacity // 2 + 1):
        whole = int(n_from[capacity - t + 1])
        middle = int(sum_to[capacity - t] - sum_to[t - 1])
        best = max(best, whole + -(-middle // capacity))
    for k in range(2, 101):
        scaled = size * (k + 1)
        value = np.where(scaled % capacity == 0, size * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((counts * value).sum()) // (capacity * k)))
    return best


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): where each piece stands.

    `capacity` is the most tokens of a sequence, `path` the tokenizer's file. Every row is packed: repeated ones and
    those with null ids as often as they come. Equal lengths may stand in either order. No rows, no pieces.
    Columns of `docs` but the two are not read. Sequence numbers are arbitrary and have gaps.

    Plan: one narrow pass tokenizes and is settled; after that only lengths move, in partitions of about
    PARTITION_ROWS rests, however long or alike the documents are.
    """
    rows = settled(tokenize(docs, path, capacity, end_id, doc_id, text).withColumn("row", F.monotonically_increasing_id()))
    rest = (F.col("length") - 1) % capacity + 1
    placed = place(rows.select("row", rest.cast("int").alias("rest")), capacity)
    first = F.col("piece") == 0
    return (
        rows.join(placed, "row")
        .select("doc_id", rest.alias("rest"), "sequence_id", "offset", "full_base", F.posexplode("crcs").alias("piece", "ids_crc32"))
        .select(
            "doc_id",
            "piece",
            F.when(first, F.lit(0)).otherwise(F.col("rest") + (F.col("piece") - 1) * capacity).cast("long").alias("start"),
            F.when(first, F.col("rest")).otherwise(F.lit(capacity)).cast("long").alias("length"),
            "ids_crc32",
            F.when(first, F.col("sequence_id")).otherwise(-(F.col("full_base") + F.col("piece"))).alias("sequence_id"),
            F.when(first, F.col("offset")).otherwise(F.lit(0)).cast("long").alias("offset"),
        )
    )


def place(rests: DataFrame, capacity: int) -> DataFrame:
    """(row, sequence_id, offset) of each (row, rest), packed in certified partitions.

    Only the counts of the `capacity` lengths come to the driver, for the bound over all rests.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in rests.groupBy("rest").count().collect():
        counts[length] = n
    bound, n_rows = lower_bound(counts, capacity), int(counts.sum())

    def packed(round_no: int):
        def run(group: pd.DataFrame) -> pd.DataFrame:
            lengths = group["rest"].to_numpy(np.int64)
            bins, offset, n_bins = best_fit_decreasing(lengths, capacity)
            room = capacity - np.bincount(bins, weights=lengths, minlength=n_bins).astype(np.int64)
            least = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
            # A certified partition gives only its slack sequences away, one with a gap all that have room.
            given = room >= (1 if n_bins > least else max(1, capacity // 64))
            part = int(group["part"].iloc[0])
            return pd.DataFrame(
                {
                    "row": group["row"].to_numpy(),
                    "rest": lengths.astype(np.int32),
                    "sequence_id": (round_no << 44 | part << 20) + bins,
                    "offset": offset,
                    "given": given[bins],
                }
            )

        return run

    schema = "row long, rest int, sequence_id long, offset long, given boolean"
    kept: list[DataFrame] = []
    pool, n_pool, n_kept, before = rests, n_rows, 0, None
    held = None  # the last packing of the pool, which stands if an exchange brings nothing
    for round_no in itertools.count():
        parts = -(-n_pool // PARTITION_ROWS) or 1
        part = F.pmod(F.xxhash64("row", F.lit(round_no)), F.lit(parts))
        now = settled(pool.withColumn("part", part).groupBy("part").applyInPandas(packed(round_no), schema))
        per = now.groupBy("sequence_id").agg(F.first("given").alias("given"), F.count("*").alias("n"))
        sums = {r["given"]: r for r in per.groupBy("given").agg(F.count("*").alias("bins"), F.sum("n").alias("rows")).collect()}
        given, closed = (sums[k] if k in sums else {"bins": 0, "rows": 0} for k in (True, False))
        bins = given["bins"] + closed["bins"]
        if before is not None and bins >= before:
            break
        if held is not None:
            kept.append(held.where("NOT given"))
        held, before = now, given["bins"]
        n_kept += closed["bins"]
        if n_kept + given["bins"] <= bound or not given["rows"]:
            break
        pool, n_pool = now.where("given").select("row", "rest"), given["rows"]
    kept.append(held)
    found = kept[0]
    for df in kept[1:]:
        found = found.union(df)
    return found.select("row", "sequence_id", "offset")
