"""Near-duplicate texts by HyperMinHash.

A text's set of word shingles gives REGISTERS registers: PERMUTATIONS times over, the hashes are mixed anew and fall
into BUCKETS buckets, and of the least hash in each a register keeps the number of leading zeros and the next
MANTISSA bits (Yu and Weber, 2017). Bands of BAND registers nominate candidates, the registers of both estimate their Jaccard
similarity less the share of registers that agree by chance, and those that may reach the threshold are compared
on their full sets. Few buckets in many permutations, since short texts would leave most of many buckets empty.

Equal sets are one class and need no comparing. In a band's bucket every class first meets the bucket's hub
only, which settles a group of near copies in as many comparisons as it has classes; buckets that then still hold
several components have all pairs between components counted, in blocks, so no link is lost: a pair at similarity
0.8 shares no bucket with a probability of (1 - 0.8**5)**48 = 5e-9.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm import wordhash
from barloom.llm.bloom import bits_for, build_blooms, maybe_in
from barloom.llm.common import connected_components, settled

PERMUTATIONS = 16
INDEX_BITS = 4
BUCKETS = 1 << INDEX_BITS
REGISTERS = PERMUTATIONS * BUCKETS
MANTISSA = 10
BAND = 5
#: A pair is dropped on its estimate only if one that reaches the threshold gives so low a one with this chance.
MISS = 1e-12
#: Classes of a bucket compared side by side.
BLOCK = 512
#: A bucket with more blocks than this is split first; up to it, a class is compared in at most so many groups.
LARGE = 8


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes: `words` words in a row, or all if there are fewer; A-Z lowered."""
    split = wordhash.split_words([t.lower() for t in texts])
    hashes, at = split.windows(words)
    cut = np.searchsorted(at, split.first)
    sets = []
    for d in range(len(texts)):
        n = int(split.first[d + 1] - split.first[d])
        if n >= words:
            s = np.sort(hashes[cut[d] : cut[d + 1]])
            sets.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        else:
            sets.append(np.array([split.sequence(d)] if n else [], np.uint64))
    return sets


#: Odd multipliers, one for each permutation.
_ODD = wordhash.mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64)) | np.uint64(1)


def registers_of(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, REGISTERS) uint16: 1 + (leading zeros << MANTISSA | mantissa) of the least hash in a bucket; 0: empty."""
    least = np.zeros((len(sets), REGISTERS), np.uint64)
    there = np.zeros((len(sets), REGISTERS), bool)
    for i, s in enumerate(sets):
        if len(s):
            x = s[None, :] * _ODD[:, None]
            x ^= x >> np.uint64(32)
            x *= np.uint64(0x9FB21C651E98DF25)
            x.sort(axis=1)
            bucket = x >> np.uint64(64 - INDEX_BITS)
            first = np.ones(x.shape, bool)
            first[:, 1:] = bucket[:, 1:] != bucket[:, :-1]
            row, column = np.nonzero(first)
            at = row * BUCKETS + bucket[row, column].astype(np.int64)
            there[i, at] = True
            least[i, at] = x[row, column]
    rest = least << np.uint64(INDEX_BITS)
    # The exponent of a double is the place of the first bit; halves are taken so that rounding cannot carry.
    high = (rest >> np.uint64(32)).astype(np.float64)
    low = (rest & np.uint64(0xFFFFFFFF)).astype(np.float64)
    zeros = np.where(high > 0, 32 - np.frexp(high)[1], np.where(low > 0, 64 - np.frexp(low)[1], 62))
    zeros = np.minimum(zeros, 62).astype(np.uint64)
    mantissa = (rest << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    return np.where(there, (zeros << np.uint64(MANTISSA) | mantissa) + np.uint64(1), 0).astype(np.uint16)


def band_keys(registers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for each band of each row that has a register in it."""
    per = BUCKETS // BAND
    n_bands = PERMUTATIONS * per
    r = registers.reshape(len(registers), PERMUTATIONS, BUCKETS)[:, :, : per * BAND]
    r = r.reshape(len(registers), n_bands, BAND).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, n_bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), r.shape[:2])
    for k in range(BAND):
        keys = wordhash.mix(keys + r[..., k])
    row, band = np.nonzero(r.any(-1))
    return row, keys[row, band].view(np.int64)


def chance(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Chance that registers of two unrelated sets of these sizes agree: one exponent and one mantissa."""
    zeros = np.arange(0, 40)
    at_least = lambda n: 1 - (1 - 2.0 ** -zeros) ** (np.asarray(n, float)[..., None] / BUCKETS)
    exactly = lambda n: (lambda p: p - np.append(p[..., 1:], np.zeros((*p.shape[:-1], 1)), -1))(at_least(n))
    return (exactly(n_a) * exactly(n_b)).sum(-1) / (1 << MANTISSA)


def may_reach(reg_a: np.ndarray, reg_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether similarity `threshold` is possible, by sizes and by the collision-corrected estimate."""
    small, large = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    used = np.maximum(1, ((reg_a | reg_b) > 0).sum(-1))
    equal = ((reg_a == reg_b) & (reg_a > 0)).sum(-1)
    estimate = (equal / used - (c := chance(n_a, n_b))) / (1 - c)
    margin = np.sqrt(np.log(1 / MISS) / (2 * used))  # Hoeffding
    return (100 * small >= 100 * threshold * large - 1e-6) & (estimate >= threshold - margin)


def signatures(docs: DataFrame, words: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, sig): k1 and k2 name the set (null: empty), sig holds the registers. Narrow."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("sig", pa.binary())])

    def run(batches):
        for batch in batches:
            rows = ((i.as_py(), wordhash.encoded(t.as_py())) for i, t in zip(*batch.columns, strict=True))
            for group in wordhash.grouped(rows):
                sets = shingle_sets([t for _, t in group], words)
                registers = registers_of(sets)
                names = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.record_batch(
                    [
                        pa.array([i for i, _ in group], pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        *(pa.array([None if k is None else int.from_bytes(k[a : a + 8], "little", signed=True) for k in names], pa.int64()) for a in (0, 8)),
                        pa.array([r.tobytes() for r in registers], pa.binary()),
                    ],
                    schema=schema,
                )

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, sig binary")


def _bands(classes: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                registers = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS)
                row, key = band_keys(registers)
                yield pa.record_batch([pa.array(key), batch.column(0).take(pa.array(row))], names=["key", "rep"])

    return classes.select("rep", "sig").mapInArrow(run, "key long, rep long")


def _sets(docs: DataFrame, named: DataFrame, words: int, doc_id: str, text: str, kind=np.uint64) -> DataFrame:
    """(rep, set): the full sets of all documents named in any column, and of few others; as `kind`, whole or halved hashes.

    The names go out as a Bloom filter of bounded size, so the texts are only scanned, not shuffled.
    """
    names = named.select(F.explode(F.array(*named.columns)).alias("rep")).distinct()
    keys = names.select(F.lit(0).alias("which"), F.col("rep").alias("key"))
    bloom = docs.sparkSession.sparkContext.broadcast(build_blooms(keys, bits_for(names.count()))[0])
    cut = (lambda s: s) if kind is np.uint64 else (lambda s: np.unique((s >> np.uint64(32)).astype(kind)))

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            some = maybe_in(ids.fill_null(0).to_numpy(), bloom.value) & ids.is_valid().to_numpy(zero_copy_only=False)
            part = batch.filter(pa.array(some))
            rows = ((i.as_py(), wordhash.encoded(t.as_py())) for i, t in zip(*part.columns, strict=True))
            for group in wordhash.grouped(rows):
                sets = shingle_sets([t for _, t in group], words)
                yield pa.record_batch([pa.array([i for i, _ in group], pa.int64()), pa.array([cut(s).tobytes() for s in sets], pa.binary())], names=["rep", "set"])

    texts = docs.select(F.col(doc_id).cast("long").alias("rep"), F.col(text).alias("text"))
    return settled(texts.mapInArrow(run, "rep long, set binary"))


def _hub_pairs(shared: DataFrame) -> DataFrame:
    """(a, b), a < b: in each bucket, its hub with every other class.

    The hub is the class that meets most others over all its buckets (then the smallest), as the text that a group's
    copies were made from does: they may be near it and not near each other.
    """
    meetings = shared.groupBy("rep").agg(F.sum("m").alias("met"))
    ranked = shared.select("key", "rep").join(meetings, "rep")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("met", (-F.col("rep")).alias("less"))).alias("top"))
    hubs = hubs.select("key", (-F.col("top.less")).alias("hub"))
    return (
        shared.join(hubs, "key").where("rep <> hub").select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b")).distinct()
    )


def _estimated(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that may reach the threshold."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                reg = [np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in (3, 5)]
                keep = may_reach(*reg, batch.column(2).to_numpy(), batch.column(4).to_numpy(), threshold)
                yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    side = lambda c: classes.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "sig_a", "n_b", "sig_b")
    return both.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold. AQE splits the joins at a class that many pairs name."""

    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(s.as_py(), np.uint64) for s in (a, b))
                at = np.searchsorted(y, x)
                inter = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
                keep.append(inter > 0 and 100 * inter >= percent * (len(x) + len(y) - inter))
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda c: sets.select(F.col("rep").alias(c), F.col("set").alias(f"set_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def _across(docs: DataFrame, shared: DataFrame, labels: DataFrame, words: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """(a, b): pairs in one bucket but not yet in one component that reach the threshold, by sets of 32-bit hashes.

    Buckets of one component, or of two classes (their pair was compared), are done. Of the others those with more than
    LARGE blocks are first split by rare shingles (`_split`), so that texts that share little beyond the bucket do not meet.
    What is left is cut into blocks of about BLOCK classes, and every two blocks of a bucket meet in a group of their own,
    which counts all intersections as a product of matrices and gives only the pairs that reach the threshold.
    """
    named = shared.join(labels, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "rep").alias("comp"))
    open_keys = (
        named.groupBy("key").agg(F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("m > 2 AND lo <> hi")
    ).select("key", "m")
    rows = settled(named.join(open_keys, "key"))
    sets = _sets(docs, rows.select("rep"), words, doc_id, text, np.uint32)
    large = rows.where(F.col("m") > LARGE * BLOCK)
    if not large.isEmpty():
        rows = rows.where(F.col("m") <= LARGE * BLOCK).select("key", "rep", "comp", "m").union(_split(large, sets, percent))
    rows = rows.withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    dealt = (
        rows.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", "rep", "comp", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        .join(sets, "rep")
    )

    def meet(table: pa.Table) -> pa.Table:
        own, i, j = table["own"].to_numpy(), table["i"][0].as_py(), table["j"][0].as_py()
        rep, comp = table["rep"].to_numpy(), table["comp"].to_numpy()
        found = [np.zeros(0, np.int64)] * 2
        if len(np.unique(comp)) > 1:
            sets = [np.frombuffer(s, np.uint32) for s in table["set"].to_pylist()]
            left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
            inter = _intersections(sets, left, right)
            n = np.array([len(s) for s in sets])
            # Two hashes may have met in 32 bits within a set: the slack keeps the test on the safe side.
            near = 100 * (inter + 2) >= percent * (n[left][:, None] + n[right][None, :] - inter)
            near &= comp[left][:, None] != comp[right][None, :]
            if i == j:
                near = np.triu(near, 1)
            x, y = np.nonzero(near)
            found = [np.minimum(rep[left[x]], rep[right[y]]), np.maximum(rep[left[x]], rep[right[y]])]
        return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})

    return dealt.groupBy("key", "i", "j").applyInArrow(meet, "a long, b long").distinct()


def _split(large: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(key, rep, comp, m): smaller buckets for the classes of large ones, which may overlap; no pair that reaches the threshold is parted.

    Such a pair has at least the threshold's share of either set in common. So if both sets are put in one order, they share
    a shingle among the first n - share * n + 1 of each: that shingle is a bucket. The order is by the number of these
    classes that hold the shingle, so shingles of a template, which all have, come last. A class gives its set once, however
    many large buckets it is in: rows grow with the sets' sizes, not with pairs.
    """

    def spread(batches):
        for batch in batches:
            own = [np.frombuffer(s, np.uint32) for s in batch.column(2).to_pylist()]
            n = np.array([len(s) for s in own], np.int64)
            at = pa.array(np.repeat(np.arange(len(own)), n))
            hashes = np.concatenate(own) if own else np.zeros(0, np.uint32)
            columns = [batch.column(k).take(at) for k in range(2)]
            yield pa.record_batch([*columns, pa.array(np.repeat(n, n)), pa.array(hashes.astype(np.int64))], names=["rep", "comp", "n", "s"])

    held = large.select("rep", "comp").distinct().join(sets, "rep").select("rep", "comp", "set").mapInArrow(spread, "rep long, comp long, n long, s long")
    often = held.groupBy("s").agg(F.count("*").alias("often")).where("often > 1")
    own = Window.partitionBy("rep")
    # Two hashes may have met in 32 bits within a set: the slack keeps the prefix on the safe side.
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 3
    ranked = held.join(often, "s").withColumn("alone", F.col("n") - F.count("*").over(own))
    ranked = ranked.withColumn("place", F.row_number().over(own.orderBy("often", "s")) + F.col("alone")).where(F.col("place") <= length)
    cut = settled(ranked.select(F.xxhash64("s").alias("key"), "rep", "comp"))
    sizes = cut.groupBy("key").agg(F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    return cut.join(sizes.select("key", "m"), "key").select("key", "rep", "comp", "m")


def _intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of every left with every right set, some columns of the hashes at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = count > 1
    owner, column = owner[often[column]], (np.cumsum(often) - 1)[column[often[column]]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    place = np.full((2, len(sets)), -1)
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    total = np.zeros((len(left), len(right)), np.float32)
    cuts = np.searchsorted(column, np.arange(0, int(often.sum()) + 4096, 4096))
    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
        sides = []
        for side, size in ((0, len(left)), (1, len(right))):
            dense = np.zeros((size, 4096), np.float32)
            row = place[side, owner[lo:hi]]
            dense[row[row >= 0], column[lo:hi][row >= 0] - 4096 * k] = 1
            sides.append(dense)
        total += sides[0] @ sides[1].T
    return total.astype(np.int64)


def near_duplicates(docs: DataFrame, words: int = 5, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of `docs`.

    Texts link if their sets of `words`-word shingles have a Jaccard similarity of `threshold` (hundredths) or more; a
    text with fewer words is one shingle. component_id is the smallest doc_id reachable, kept says it is its own.
    Null and empty texts, and those of blanks only, have no shingle and link with nothing. Repeated rows are
    copies; rows that share a doc_id but not the text are one node of the graph. A row with a null doc_id takes part
    only as a copy: it gets its class's component, null if there is none, and counts as kept if null. Other columns are
    not read; an empty table gives none.
    """
    percent = round(100 * threshold)
    signed = settled(signatures(docs, words, doc_id, text))
    classes = settled(
        signed.where("n_shingles > 0")
        .groupBy("k1", "k2")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    )
    known = classes.where("rep IS NOT NULL")
    # Sets of up to three shingles reach 0.8 only with equal ones, which are one class already.
    bands = _bands(known.where(f"n >= {-(-percent // (100 - percent)) if percent < 100 else 1 << 62}"))
    buckets = bands.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    shared = settled(bands.join(buckets, "key").select("key", "rep", "m"))
    pairs = _hub_pairs(shared)
    likely = settled(_estimated(pairs, known, percent / 100))
    links = settled(_verified(likely, _sets(docs, likely, words, doc_id, text), percent))
    labels = settled(connected_components(links))
    more = settled(_across(docs, shared.select("key", "rep"), labels, words, percent, doc_id, text))
    if not more.isEmpty():
        added = settled(_verified(more, _sets(docs, more, words, doc_id, text), percent))
        if not added.isEmpty():
            labels = connected_components(links.union(added))
    by_class = classes.join(labels, F.col("rep") == F.col("node"), "left").select("k1", "k2", F.coalesce("component", "rep").alias("component_id"))
    component = F.coalesce("component_id", "doc_id")
    return signed.join(by_class, ["k1", "k2"], "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )
