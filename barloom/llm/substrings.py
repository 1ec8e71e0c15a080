"""Exact substring deduplication with a log-structured fingerprint index.

A window is `window` consecutive words. Of the hashes of the GRAM-word sequences in it the leftmost least one is its
fingerprint (winnowing: Schleimer et al., 2003), so equal windows have equal fingerprints, and about one word in eight
begins one. The index holds, in immutable runs sorted by fingerprint, each fingerprint with the hashes of the whole windows
it was taken from. Documents come in batches; for each batch

1. its fingerprints are written as a new sorted run;
2. shard by shard the run is merge-joined with the runs of history: where fingerprint and whole-window hash are the same, the
   window stood in history, which verifies it without the earlier texts; they are never read again;
3. fingerprints that repeat in the batch, or whose window stood in history, go into a Bloom filter of bounded size; the batch's
   windows on those are packed by slots of the whole-window hash, compared slot by slot in numpy by fingerprint (64 bits) and
   whole-window hash (48), and every one that isn't the first of its kind is covered;
4. once a shard has FAN_IN runs of one tier, they are merged into one of the next, so a hash is rewritten once a tier. Shards
   are merged one after the other, so that only one is there twice.

A Bloom filter too full only lets more windows through to step 3; results are exact at any size. Equal windows of a group
of texts, and of a run up to ROW_HASHES of them, are written once, so a passage that stands everywhere is a few rows of a run.

The index stays in its folder. Its manifest names the runs and is replaced by a rename; a run that it doesn't name, left by a
driver that was lost, is deleted at the next opening, and the batch comes again.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import wordhash
from barloom.llm.bloom import bits_for, build_blooms, maybe_in
from barloom.llm.common import dropping_shuffles, prepare_checkpoints, settled

GRAM = 6
FAN_IN = 2
SHARDS = 4
#: A run's rows: a fingerprint, its places in the run's documents, and the low 48 bits of the hashes of its windows.
RUN = "g long, n long, hashes binary"
LOW = (1 << 48) - 1
ROW_HASHES = 1 << 16
#: A window to be compared: low 48 bits of its hash, fingerprint, place; 0: of history, 1: to be compared, 2: covered.
WINDOW = np.dtype([("h", "<i8"), ("check", "<i8"), ("doc", "<i8"), ("start", "<i4"), ("state", "i1")])
#: A window that is covered.
START = np.dtype([("doc", "<i8"), ("start", "<i4")])
#: So many windows are packed, and about half as many compared, at a time; in at least so many slots of their hashes.
HELD = 1 << 19
SLOTS = 1 << 10
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
#: Stands for a null doc_id: after all others; and for the documents of history, before them.
LAST = (1 << 63) - 1
PAST = -(1 << 63)


def fingerprints(words: wordhash.Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, place, hash) of each window: its first word, its fingerprint's first word, and the fingerprint."""
    grams, at = words.windows(GRAM)
    span = window - GRAM + 1
    whole = np.zeros(len(words.hashes), np.uint64)
    whole[at] = grams
    begin = words.windows(window)[1]
    if not len(begin):
        return begin, begin, grams[:0]
    place = begin + np.lib.stride_tricks.sliding_window_view(whole, span)[begin].argmin(1)
    return begin, place, whole[place]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[bytes], wordhash.Words]]:
    """(doc keys, texts, words) of (doc, text) batches, in groups of bounded size."""
    for batch in batches:
        rows = ((d.as_py(), wordhash.encoded(t.as_py())) for d, t in zip(*batch.columns, strict=True))
        for group in wordhash.grouped(rows):
            texts = [t for _, t in group]
            yield np.array([d for d, _ in group], np.int64), texts, wordhash.split_words(texts)


def _owners(words: wordhash.Words) -> np.ndarray:
    return np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))


def _listed(owner: np.ndarray, hashes: np.ndarray, n: int) -> pa.Array:
    """A binary array of n rows from their hashes one after the other, six bytes each."""
    offsets = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32) * 6
    data = np.ascontiguousarray(np.ascontiguousarray(hashes).astype("<i8").view(np.uint8).reshape(-1, 8)[:, :6])
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every hash of a binary column."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    whole = np.zeros((len(data) // 6, 8), np.uint8)
    whole[:, :6] = data.reshape(-1, 6)
    return np.repeat(np.arange(len(column)), np.diff(offsets) // 6), whole.view("<i8").ravel()


def _run_rows(place: np.ndarray, g: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
    """Rows of a run, in the order of g, from the windows (place, g, h) of a group of texts, whose places ascend."""
    first = np.flatnonzero(np.diff(place, prepend=-1))
    size = np.diff(np.append(first, len(place)))
    order = np.argsort(g[first], kind="stable")
    key, size = g[first][order], size[order]
    windows = np.repeat(first[order] - np.cumsum(size) + size, size) + np.arange(len(place))
    owner = np.repeat(np.arange(len(key)), size)
    rows = pa.record_batch([pa.array(key), pa.array(np.ones(len(key), np.int64)), _listed(owner, h[windows], len(key))], names=["g", "n", "hashes"])
    return _joined(rows)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g, n, hashes) in the order of shard and g with those of one g made one, or a few with many hashes each."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        g = batch.column(0).to_numpy()
        last = len(g) - 1
        while last and g[last - 1] == g[-1]:
            last -= 1
        if len(_hashes(batch.column(2).slice(last))[1]) > ROW_HASHES:
            last = len(g)  # not held any longer, however many follow
        held = batch.slice(last) if last < len(g) else None
        yield _joined(batch.slice(0, last))
    if held is not None:
        yield _joined(held)


def _joined(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Neighbouring rows of one g made one, without the hashes that stand twice."""
    g = batch.column(0).to_numpy()
    new = np.concatenate([[True], g[1:] != g[:-1]])[: len(g)]
    first = np.flatnonzero(new)
    if len(first) == len(g):
        return batch
    row, h = _hashes(batch.column(2))
    owner = (np.cumsum(new) - 1)[row]
    # Only rows that are joined may hold a hash twice; they are put in order.
    some = np.flatnonzero(np.diff(np.append(first, len(g)))[owner] > 1)
    order = some[np.lexsort((h[some], owner[some]))]
    h[some] = h[order]
    keep = np.ones(len(h), bool)
    keep[some[1:]] = (owner[some[1:]] != owner[some[:-1]]) | (h[some[1:]] != h[some[:-1]])
    columns = [pa.array(g[first]), pa.array(np.add.reduceat(batch.column(1).to_numpy(), first)), _listed(owner[keep], h[keep], len(first))]
    return pa.record_batch([c.cast(f.type) for c, f in zip(columns, batch.schema, strict=True)], schema=batch.schema)


@contextmanager
def _unsorted_writes(spark: SparkSession):
    """A task in this block keeps a file open for each shard: its rows come in the order of shards, which Spark can't tell."""
    before = spark.conf.get(WRITERS)
    spark.conf.set(WRITERS, str(SHARDS))
    try:
        yield
    finally:
        spark.conf.set(WRITERS, before)


def _leads(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows in the order of h and check; and which of them are not the first, by doc and start, of their h and check."""
    order = np.argsort(rows["h"])
    h, check = rows["h"][order], rows["check"][order]
    if ((h[1:] == h[:-1]) & (check[1:] != check[:-1])).any():
        order = np.lexsort((rows["check"], rows["h"]))
        h, check = rows["h"][order], rows["check"][order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (check[1:] != check[:-1])
    first, group = np.flatnonzero(new), np.cumsum(new) - 1
    doc, start = rows["doc"][order], rows["start"][order]
    late = doc != np.minimum.reduceat(doc, first)[group]
    late |= start != np.minimum.reduceat(np.where(late, np.iinfo(np.int32).max, start), first)[group]
    return order, late


def _dealt(rows: np.ndarray, slots: int) -> pa.RecordBatch:
    """Windows packed by slots of h. Of equal ones all but the first are covered: those go anywhere, the first is compared."""
    order, late = _leads(rows)
    sure = order[late]
    rows["state"][sure] = 2
    rows["h"][sure] = (wordhash.mix(rows["doc"][sure].view(np.uint64) + rows["start"][sure].astype(np.uint64)) & np.uint64(LOW)).view(np.int64)
    return _packed(rows, rows["h"] >> 48 - (slots.bit_length() - 1))


def _packed(rows: np.ndarray, slot: np.ndarray) -> pa.RecordBatch:
    """A row for each slot, with its rows byte by byte: ids that differ little pack well."""
    order = np.argsort(slot.astype(np.uint16) if len(slot) and slot.max() < 1 << 16 else slot, kind="stable")
    slot = slot[order]
    first = np.flatnonzero(np.diff(slot, prepend=-1))
    data = np.take(rows.view(np.uint8).reshape(len(rows), -1), order, axis=0)
    packed = [data[lo:hi].T.tobytes() for lo, hi in zip(first, [*first[1:], len(rows)], strict=True)]
    return pa.record_batch([pa.array(slot[first].astype(np.int32)), pa.array(packed, pa.binary())], names=["slot", "packed"])


def _unpacked(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[np.ndarray]:
    """The rows of whole slots, about HELD / 2 or one slot at a time, from packed rows in the order of slots."""
    held, size, last = [], 0, None
    for batch in batches:
        for slot, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if slot != last and size >= HELD // 2:
                yield np.concatenate(held)
                held, size = [], 0
            last = slot
            data = np.frombuffer(packed.as_buffer(), np.uint8).reshape(kind.itemsize, -1)
            held.append(np.ascontiguousarray(data.T).view(kind).ravel())
            size += data.shape[1]
    if held:
        yield np.concatenate(held)


def _later(batches: Iterator[pa.RecordBatch], slots: int) -> Iterator[pa.RecordBatch]:
    """The windows that are not the first of their h and check, history left out, packed by slots of doc."""
    out, size = [], 0

    def dealt() -> pa.RecordBatch:
        found = np.concatenate(out)
        return _packed(found, (wordhash.mix(found["doc"].view(np.uint64)) & np.uint64(slots - 1)).view(np.int64))

    for rows in _unpacked(batches, WINDOW):
        plain = rows[rows["state"] < 2]
        hits = [rows[rows["state"] == 2]]
        if len(plain):
            order, late = _leads(plain)
            late = plain[order[late]]
            hits.append(late[late["state"] == 1])
        for hit in hits:
            start = np.empty(len(hit), START)
            start["doc"], start["start"] = hit["doc"], hit["start"]
            out.append(start)
            size += len(hit)
        if size >= HELD:
            yield dealt()
            out, size = [], 0
    if size:
        yield dealt()


def _by_doc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each doc, with its starts, four bytes each, from packed rows in the order of slots."""
    for found in _unpacked(batches, START):
        order = np.argsort(found["doc"])
        doc, start = found["doc"][order], found["start"][order]
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        starts = [start[lo:hi].tobytes() for lo, hi in zip(first, [*first[1:], len(doc)], strict=True)]
        yield pa.record_batch([pa.array(doc[first]), pa.array(starts, pa.binary())], names=["doc", "starts"])


class FingerprintIndex:
    """A corpus's runs, in a folder that all executors share; opened again where that folder holds an index already.

    Documents added by an earlier call are earlier, whatever their ids.
    """

    def __init__(self, spark: SparkSession, folder: str, window: int = 20):
        if window <= GRAM:
            raise ValueError(f"a window has more than {GRAM} words")
        self.spark, self.window, self.folder = spark, window, folder
        self.runs: list[tuple[int, int, str]] = []  # (shard, tier, name)
        self.written = 0
        self.compacted = 0
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        if self._fs.exists(self._path("manifest.json")):
            stream = self._fs.open(self._path("manifest.json"))
            try:
                known = json.loads(bytes(stream.readAllBytes()))
            finally:
                stream.close()
            if known["window"] != window:
                raise ValueError(f"this index has windows of {known['window']} words")
            self.runs, self.written = [tuple(r) for r in known["runs"]], known["written"]
            for status in self._fs.listStatus(self._path("")):
                name = status.getPath().getName()
                if name.startswith("run-") and name not in {r for *_, r in self.runs}:
                    self._fs.delete(status.getPath(), True)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _commit(self) -> None:
        """Put a manifest that names the runs as they are now in the place of the one before."""
        options = self.spark._jvm.org.apache.hadoop.fs
        stream = self._fs.create(self._path("manifest.next"), True)
        try:
            stream.write(json.dumps({"window": self.window, "runs": self.runs, "written": self.written}).encode())
        finally:
            stream.close()
        over = self.spark._sc._gateway.new_array(options.Options.Rename, 1)
        over[0] = options.Options.Rename.OVERWRITE
        options.FileContext.getFileContext(self._path("").toUri(), self.spark._jsc.hadoopConfiguration()).rename(self._path("manifest.next"), self._path("manifest.json"), over)

    def _write(self, rows: DataFrame) -> str:
        name = f"run-{self.written}"
        self.written += 1
        shard = F.pmod("g", F.lit(SHARDS)).cast("int")
        with dropping_shuffles(self.spark), _unsorted_writes(self.spark):
            merged = rows.repartition("g").sortWithinPartitions(shard, "g").mapInArrow(_merged, RUN)
            merged.withColumn("shard", shard).write.mode("overwrite").partitionBy("shard").parquet(f"{self.folder}/{name}")
        return name

    def _read(self, runs: list[tuple[int, int, str]]) -> DataFrame:
        paths = [f"{self.folder}/{name}/shard={shard}" for shard, _, name in runs]
        return self.spark.read.schema(RUN).parquet(*[p for p in paths if self._fs.exists(self._path(p[len(self.folder) + 1 :]))])

    def drop(self) -> None:
        """Delete the index."""
        self._fs.delete(self._path(""), True)
        self.runs = []

    def compact(self) -> None:
        """In each shard, merge FAN_IN or more runs of one tier into one of the next, as long as there are that many."""
        for shard in range(SHARDS):
            tier = 0
            while any(s == shard and t >= tier for s, t, _ in self.runs):
                old = [r for r in self.runs if r[:2] == (shard, tier)]
                if len(old) >= FAN_IN:
                    new = self._write(self._read(old))
                    self.runs = [r for r in self.runs if r not in old] + [(shard, tier + 1, new)]
                    self.compacted += 1
                    self._commit()
                    for *_, name in old:
                        self._fs.delete(self._path(f"{name}/shard={shard}"), True)
                tier += 1

    def covered(self, batch: DataFrame) -> tuple[DataFrame, Callable]:
        """(doc, starts) of the batch's windows that occur earlier, one row a document; and the test for texts that may hold any.

        `batch` has (doc, text), doc being an order key without nulls. The batch's run joins the index.
        """
        window = self.window

        def prints(batches):
            for _, _, words in _groups(batches):
                _, place, g = fingerprints(words, window)
                yield _run_rows(place, g.view(np.int64), words.windows(window)[0].view(np.int64) & LOW)

        def common(batches):
            """(g, h) that both sides of a joined row hold."""
            for batch in batches:
                sides = [_hashes(batch.column(k)) for k in (1, 2)]
                # Row and 48 bits of hash don't fit in one number: the row takes the place of the lowest bits, compared afterwards.
                keys = [h << 16 & ~np.int64(0xFFFFF) | row & 0xFFFFF for row, h in sides]
                order = np.argsort(keys[1], kind="stable")
                old = keys[1][order]
                lo, hi = (np.searchsorted(old, keys[0], side) for side in ("left", "right"))
                at = np.repeat(np.arange(len(lo)), hi - lo)
                other = order[np.repeat(lo - np.cumsum(hi - lo) + (hi - lo), hi - lo) + np.arange(len(at))]
                same = (sides[0][1][at] == sides[1][1][other]) & (sides[0][0][at] == sides[1][0][other])
                at = np.unique(at[same])
                yield pa.record_batch([pa.array(batch.column(0).to_numpy()[sides[0][0][at]]), pa.array(sides[0][1][at])], names=["g", "h"])

        name = self._write(batch.mapInArrow(prints, RUN))
        runs = [(shard, 0, name) for shard in range(SHARDS) if self._fs.exists(self._path(f"{name}/shard={shard}"))]
        new = self._read(runs) if runs else self.spark.createDataFrame([], RUN)
        keys = new.where("n > 1").select(F.lit(0).alias("which"), F.col("g").alias("key"))
        met = None
        if self.runs:
            for shard in range(SHARDS):  # one after the other, so that the shuffle of one is there at a time
                sides = [[r for r in side if r[0] == shard] for side in (runs, self.runs)]
                if all(sides):
                    own, past = (self._read(side).select("g", F.col("hashes").alias(c)) for side, c in zip(sides, ("own", "past"), strict=True))
                    found = settled(own.hint("merge").join(past, "g").select("g", "own", "past").mapInArrow(common, "g long, h long").distinct())
                    met = found if met is None else met.union(found)
        if met is not None:
            keys = keys.union(met.select(F.lit(0), "g"))
        blooms = self.spark.sparkContext.broadcast(build_blooms(keys, bits_for(new.count() // 4), 1))
        # A place is the fingerprint of at most window - GRAM + 1 windows.
        places = new.agg(F.sum("n")).first()[0] or 0
        slots = max(SLOTS, 1 << (places * (window - GRAM + 1) // HELD).bit_length())
        self.runs += runs
        self._commit()

        def hot_windows(words: wordhash.Words) -> tuple[np.ndarray, np.ndarray]:
            begin, place, g = fingerprints(words, window)
            hot = maybe_in(g, blooms.value[0]) if len(g) else np.zeros(0, bool)
            return begin[hot], g[hot]

        def hashed(batches):
            held, size = [], 0
            for docs, _, words in _groups(batches):
                hot, g = hot_windows(words)
                if not len(hot):
                    continue
                whole, at = words.windows(window)
                owner = _owners(words)[hot]
                rows = np.empty(len(hot), WINDOW)
                rows["h"], rows["check"] = whole[np.searchsorted(at, hot)].view(np.int64) & LOW, g.view(np.int64)
                rows["doc"], rows["start"], rows["state"] = docs[owner], hot - words.first[owner], 1
                held.append(rows)
                size += len(rows)
                if size >= HELD:
                    yield _dealt(np.concatenate(held), slots)
                    held, size = [], 0
            if held:
                yield _dealt(np.concatenate(held), slots)

        def earlier(batches):
            for batch in batches:
                rows = np.empty(batch.num_rows, WINDOW)
                rows["h"], rows["check"] = batch.column(1).to_numpy(), batch.column(0).to_numpy()
                rows["doc"], rows["start"], rows["state"] = PAST, -1, 0
                if len(rows):
                    yield _dealt(rows, slots)

        schema = "slot int, packed binary"
        rows = batch.mapInArrow(hashed, schema)
        if met is not None:
            rows = rows.union(met.mapInArrow(earlier, schema))
        found = rows.repartition("slot").sortWithinPartitions("slot").mapInArrow(lambda batches: _later(batches, slots), schema)
        found = found.repartition("slot").sortWithinPartitions("slot").mapInArrow(_by_doc, "doc long, starts binary")
        return found, lambda words: hot_windows(words)[0]

    def append(self, docs: DataFrame, batch_docs: int = 1_000_000, min_batches: int = 1, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
        """What `deduplicate` gives for these documents, windows of the documents added before being earlier than all of theirs."""
        rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("doc"), F.col(text).alias("text"))
        n, low, high = rows.agg(F.count("*"), F.min("doc"), F.max("doc")).first()
        n_batches = max(min_batches, -(-n // batch_docs))
        cuts = sorted(set(rows.approxQuantile("doc", [i / n_batches for i in range(1, n_batches)], 0.01))) if n and n_batches > 1 else []
        bounds = [None, *[int(c) for c in cuts if low < c <= high], None]
        parts = []
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            batch = rows if lo is None else rows.where(F.col("doc") >= lo)
            found, hot = self.covered(batch if hi is None else batch.where(F.col("doc") < hi))
            parts.append(_sorted_out(batch if hi is None else batch.where(F.col("doc") < hi), found, hot, keep_text))
            self.compact()
        return _finished(parts, self.window, keep_text)


def kept_words(text: bytes, starts: list[int] | np.ndarray, window: int) -> tuple[int, int, bytes]:
    """(words, words removed, the kept ones joined by a blank)."""
    words = text.split()
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.unique(np.array(starts, np.int64))
    starts = starts[starts + window <= len(words)]
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    removed = np.cumsum(edge[:-1]) > 0
    return len(words), int(removed.sum()), b" ".join([w for w, r in zip(words, removed, strict=True) if not r])


def deduplicate(
    docs: DataFrame, window: int = 20, batch_docs: int = 1_000_000, min_batches: int = FAN_IN + 1, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): each text less the words of windows that also start earlier.

    Earlier is a smaller doc_id, or an earlier word of the same document; windows are judged on the input. One row
    for each row of `docs`. With `keep_text` a column kept_text follows, the kept words joined by a blank. A null
    text has no words, one with fewer words than a window loses none. Rows that share a doc_id are one
    document: a window that starts at the same word in several of them is not earlier in any, and what is removed at a
    word of one is removed at that word of all. A null doc_id comes after all others. Other columns are not read; an
    empty table gives none.

    Batches are ranges of doc_id with about `batch_docs` rows; the index takes them in order, at least FAN_IN + 1 of them, so that
    it compacts. For documents that come later keep a FingerprintIndex and `append` to it.
    """
    spark = docs.sparkSession
    prepare_checkpoints(spark)
    index = FingerprintIndex(spark, f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/runs-{uuid.uuid4().hex}", window)
    out = index.append(docs, batch_docs, min_batches, doc_id, text, keep_text)
    index.drop()
    return out


def _sorted_out(batch: DataFrame, found: DataFrame, hot: Callable, keep_text: bool) -> DataFrame:
    """Settled: digests of the texts without a window in question, the others packed, with the covered windows' starts."""

    def sort_out(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for keys, texts, words in _groups(batches):
            asked = np.unique(_owners(words)[hot(words)])
            open_text = np.zeros(len(texts), bool)
            open_text[asked] = True
            whole = [None if o else b" ".join(t.split()) for t, o in zip(texts, open_text, strict=True)]
            columns = [
                pa.array(keys),
                pa.array(np.diff(words.first).astype(np.int64)),
                pa.array([None if w is None else hashlib.sha256(w).hexdigest() for w in whole], pa.string()),
                pa.array([pack.compress(t) if o else None for t, o in zip(texts, open_text, strict=True)], pa.binary()),
            ]
            names = ["doc", "n_words", "kept_sha256", "packed"]
            if keep_text:
                columns.append(pa.array([None if w is None else w.decode("utf-8", "surrogatepass") for w in whole], pa.string()))
                names.append("kept_text")
            yield pa.record_batch(columns, names=names)

    schema = "doc long, n_words long, kept_sha256 string, packed binary" + (", kept_text string" if keep_text else "")
    starts = settled(found)
    return settled(batch.mapInArrow(sort_out, schema)).join(starts, "doc", "left")


def _finished(parts: list[DataFrame], window: int, keep_text: bool) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)

    def finish(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in (b.slice(at, 200) for b in batches for at in range(0, b.num_rows, 200)):
            made = []
            column = {name: batch.column(name) for name in batch.schema.names}
            for i in range(batch.num_rows):
                doc, n_words, whole, packed = (column[c][i].as_py() for c in ("doc", "n_words", "kept_sha256", "packed"))
                if packed is None:
                    made.append((doc, n_words, 0, whole, column["kept_text"][i].as_py() if keep_text else None))
                else:
                    starts = np.frombuffer(column["starts"][i].as_py() or b"", "<i4")
                    n_words, removed, kept = kept_words(unpack.decompress(packed), starts, window)
                    made.append((doc, n_words, removed, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass") if keep_text else None))
            columns = list(zip(*made, strict=True)) if made else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]
            n_out = 5 if keep_text else 4
            ids = pa.array([None if d == LAST else d for d in columns[0]], pa.int64())
            yield pa.record_batch([ids, *[pa.array(c, k) for c, k in list(zip(columns, kinds, strict=True))[1:n_out]]], names=names[:n_out])

    return out.mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if keep_text else ""))
