"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

Words are runs of letters and digits, lower-cased. A word's input joins a word part (an embedding of its hash) and a
character part (the mean embedding of the hashes of its 3- to 5-byte pieces, ends marked); both are learned with the
network and nothing else is told about a word. Overlapping windows of WINDOW words run through a gated recurrent network
in both directions; attention weighs the states, and a logistic layer scores the window. A text scores as its highest
window does; every word of every text lies in a window.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import wordhash
from barloom.llm.common import held_out, train_rows
from barloom.llm.sampling import drawn, fitted

WINDOW, STRIDE = 64, 48
BUCKETS = 1 << 16
EMBEDDING, HIDDEN, ATTENTION = 16, 8, 8
PIECES = (3, 4, 5)
#: Labelled texts of each label fitted on, at most about.
SAMPLE = 1500
#: Passes over the sampled texts, and the fewest steps for a small sample.
EPOCHS, BATCH, RATE = 4, 32, 0.01
LEAST_STEPS = 300
#: After this many steps the rate is half of RATE.
SLOWER = 100
#: Words and pieces in fewer sampled texts than this have no embedding of their own, so that few texts aren't learned by heart.
MIN_TEXTS = 3
#: The embeddings shrink by this at every step; and the share of words that a step hides.
SHRINK, HIDE = 0.001, 0.1
THRESHOLD = 0.7
_BLANKED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def plain(text: str | None) -> bytes:
    """Lower-cased UTF-8 with blanks for all ASCII but letters and digits."""
    return wordhash.encoded((text or "").lower()).translate(_BLANKED)


@dataclass
class Vocabulary:
    """The distinct words of a group of texts: their buckets, and those of their pieces."""

    word_of: np.ndarray  # distinct word of each word
    word: np.ndarray  # bucket of each distinct word
    piece: np.ndarray  # buckets of the pieces, distinct word by distinct word
    first: np.ndarray  # where each distinct word's pieces begin

    def only(self, some: np.ndarray) -> Vocabulary:
        """The distinct words `some`, without a text."""
        n = np.diff(np.append(self.first, len(self.piece)))[some]
        first = np.cumsum(n) - n
        return Vocabulary(self.word_of[:0], self.word[some], self.piece[np.repeat(self.first[some] - first, n) + np.arange(n.sum())], first)

    def steps(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct words, index into them (steps, windows), mask) of the windows."""
        at = begin[None, :] + np.arange(int((end - begin).max(initial=1)))[:, None]
        used, index = np.unique(self.word_of[np.minimum(at, len(self.word_of) - 1)], return_inverse=True)
        return used, index.reshape(at.shape), (at < end[None, :]).astype(np.float32)


def vocabulary(words: wordhash.Words) -> Vocabulary:
    hashes, at, word_of = np.unique(words.hashes, return_index=True, return_inverse=True)
    n = words.end[at] - words.begin[at]
    # The words one after the other, each between two marks.
    size = n + 2
    end = np.cumsum(size)
    begin = end - size
    data = np.full(int(end[-1]) if len(end) else 0, ord(" "), np.uint8)
    inside = np.repeat(np.arange(len(n)), n)
    offset = np.arange(len(inside)) - np.repeat(np.cumsum(n) - n, n)
    data[begin[inside] + 1 + offset] = np.frombuffer(words.data, np.uint8)[words.begin[at][inside] + offset]
    owner, piece = [], []
    whole = np.repeat(np.arange(len(size)), size)
    for k in PIECES:
        start = np.arange(max(0, len(data) - k + 1))
        start = start[whole[start] == whole[start + k - 1]] if len(start) else start
        owner.append(whole[start])
        h = wordhash.mix(wordhash._window_sums(wordhash._BYTE[data], start, start + k, wordhash._BASE) + np.uint64(k))
        piece.append((h & np.uint64(BUCKETS - 1)).astype(np.uint16))
    owner, piece = np.concatenate(owner), np.concatenate(piece)
    order = np.argsort(owner, kind="stable")
    return Vocabulary(word_of, (hashes & np.uint64(BUCKETS - 1)).astype(np.uint16), piece[order], np.searchsorted(owner[order], np.arange(len(at))))


def cut_windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, text) of the overlapping windows over all words of each text; none for a text without words."""
    n = np.diff(first)
    count = np.where(n == 0, 0, 1 + -(-np.maximum(0, n - WINDOW) // STRIDE))
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    begin = first[text] + k * STRIDE
    return begin, np.minimum(begin + WINDOW, first[text + 1]), text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _summed(row: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """(n, columns): the values added up by their row."""
    total = np.zeros((n, values.shape[1]), values.dtype)
    if len(row):
        order = np.argsort(row, kind="stable")
        first = np.flatnonzero(np.diff(row[order], prepend=-1))
        total[row[order[first]]] = np.add.reduceat(values[order], first, 0)
    return total


@dataclass
class Network:
    word_row: np.ndarray  # row of "words" for each bucket, 0 for rare ones
    piece_row: np.ndarray
    params: dict[str, np.ndarray]

    def inputs(self, v: Vocabulary) -> np.ndarray:
        """(distinct words, 2 * EMBEDDING): the word's embedding, then the mean of its pieces'."""
        n = np.diff(np.append(v.first, len(v.piece)))
        chars = np.add.reduceat(self.params["chars"][self.piece_row[v.piece]], v.first, 0) / n[:, None]
        return np.concatenate([self.params["words"][self.word_row[v.word]], chars], 1).astype(self.params["words"].dtype)

    def _run(self, xw: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """States (2, steps, windows, HIDDEN) of both directions, each in its own order of steps; xw are the inputs already multiplied."""
        u, uc = (np.stack([self.params[k + way] for way in "fb"]) for k in ("u", "uc"))
        _, steps, n = mask.shape
        h = np.zeros((2, n, HIDDEN), xw.dtype)
        out = np.empty((2, steps, n, HIDDEN), xw.dtype)
        mask = mask[..., None]
        for t in range(steps):
            gates = _sigmoid(xw[:, t, :, : 2 * HIDDEN] + h @ u)
            z, r = gates[..., :HIDDEN] * mask[:, t], gates[..., HIDDEN:]
            c = np.tanh(xw[:, t, :, 2 * HIDDEN :] + (r * h) @ uc)
            if keep is not None:
                keep.append((h, z, r, c))
            h = h + z * (c - h)
            out[:, t] = h
        return out

    def forward(self, x: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """The logit of each window; x are the inputs of distinct words, index (steps, windows) says which, mask which are there."""
        p = self.params
        f, b = (x @ p[f"w{way}"] + p[f"b{way}"] for way in "fb")
        tape = None if keep is None else []
        states = self._run(np.stack([f[index], b[index[::-1]]]), np.stack([mask, mask[::-1]]).astype(x.dtype), tape)
        h = np.concatenate([states[0], states[1, ::-1]], 2)
        energy = np.tanh(h @ p["att"] + p["att_b"])
        score = energy @ p["att_v"]
        score = np.where(mask > 0, score, -1e9)
        a = np.exp(score - score.max(0))
        a /= a.sum(0)
        context = (a[:, :, None] * h).sum(0)
        if keep is not None:
            keep.update(h=h, energy=energy, a=a, context=context, tape=tape, index=index, mask=mask, x=x)
        return context @ p["out"] + p["out_b"][0]

    def logits(self, v: Vocabulary, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The logit of each of many windows, some at a time."""
        x, found = self.inputs(v), []
        for k in range(0, len(begin), 256):
            lo, hi = begin[k : k + 256], end[k : k + 256]
            at = lo[None, :] + np.arange(int((hi - lo).max()))[:, None]
            found.append(self.forward(x, v.word_of[np.minimum(at, len(v.word_of) - 1)], (at < hi[None, :]).astype(np.float32)))
        return np.concatenate(found)

    def score_texts(self, texts: list[bytes]) -> np.ndarray:
        """The highest window's probability of each text, 0 for one without words."""
        words = wordhash.split_words(texts)
        scores = np.zeros(len(texts))
        if len(words.hashes):
            begin, end, text = cut_windows(words.first)
            np.maximum.at(scores, text, _sigmoid(self.logits(vocabulary(words), begin, end).astype(np.float64)))
        return scores

    def gradients(self, keep: dict, d_logit: np.ndarray) -> tuple[dict, np.ndarray]:
        """(of the parameters, of the inputs gathered by distinct word)."""
        p, g = self.params, {}
        h, energy, a, index, x = keep["h"], keep["energy"], keep["a"], keep["index"], keep["x"]
        g["out"], g["out_b"] = keep["context"].T @ d_logit, np.array([d_logit.sum()])
        d_context = d_logit[:, None] * p["out"]
        d_h = a[:, :, None] * d_context[None]
        d_a = (h * d_context[None]).sum(2)
        d_score = a * (d_a - (a * d_a).sum(0))
        g["att_v"] = np.einsum("tnk,tn->k", energy, d_score)
        d_energy = d_score[:, :, None] * p["att_v"] * (1 - energy**2)
        g["att_b"] = d_energy.sum((0, 1))
        g["att"] = np.einsum("tnh,tnk->hk", h, d_energy)
        d_h += d_energy @ p["att"].T
        d_h = np.stack([d_h[:, :, :HIDDEN], d_h[::-1, :, HIDDEN:]])
        mask = np.stack([keep["mask"], keep["mask"][::-1]])[..., None].astype(x.dtype)
        u, uc = (np.stack([p[k + way] for way in "fb"]) for k in ("u", "uc"))
        d_u, d_uc = np.zeros_like(u), np.zeros_like(uc)
        u_t, uc_t = u.transpose(0, 2, 1), uc.transpose(0, 2, 1)
        d_xw = np.zeros((2, *index.shape, 3 * HIDDEN), x.dtype)
        later = np.zeros((2, index.shape[1], HIDDEN), x.dtype)
        for t in range(len(index) - 1, -1, -1):
            before, z, r, c = keep["tape"][t]
            d = later + d_h[:, t]
            d_c = d * z * (1 - c**2)
            d_z = d * (c - before) * z * (1 - z) * mask[:, t]
            d_rh = d_c @ uc_t
            d_r = d_rh * before * r * (1 - r)
            gates = np.concatenate([d_z, d_r], 2)
            d_u += before.transpose(0, 2, 1) @ gates
            d_uc += (r * before).transpose(0, 2, 1) @ d_c
            later = d * (1 - z) + d_rh * r + gates @ u_t
            d_xw[:, t] = np.concatenate([gates, d_c], 2)
        d_x = np.zeros_like(x)
        for k, way in enumerate("fb"):
            g[f"u{way}"], g[f"uc{way}"] = d_u[k], d_uc[k]
            flat = _summed((index if k == 0 else index[::-1]).ravel(), d_xw[k].reshape(-1, 3 * HIDDEN), len(x))
            g[f"b{way}"], g[f"w{way}"] = flat.sum(0), x.T @ flat
            d_x += flat @ p[f"w{way}"].T
        return g, d_x


def _gathered(texts: list[bytes]) -> tuple[Vocabulary, np.ndarray, np.ndarray]:
    """One vocabulary of all the texts, where each one's words begin, and in how many texts each word and piece bucket is.

    A group of texts at a time, in bounded memory.
    """
    seen = np.zeros((2, BUCKETS), np.int64)
    word_of, hashes, word, piece, n_pieces, sizes, rows = [], [], [], [], [], [], 0
    for group in wordhash.grouped(enumerate(texts)):
        words = wordhash.split_words([t for _, t in group])
        sizes.append(np.diff(words.first))
        if len(words.hashes):
            v = vocabulary(words)
            owner = np.repeat(np.arange(len(group)), sizes[-1])
            pairs = np.unique(owner << 32 | v.word_of)  # each distinct word of each text once
            own = v.only(pairs & ((1 << 32) - 1))
            n = np.diff(np.append(own.first, len(own.piece)))
            for k, (text, bucket) in enumerate(((pairs >> 32, own.word), (np.repeat(pairs >> 32, n), own.piece))):
                seen[k] += np.bincount(np.unique(text << 16 | bucket.astype(np.int64)) & (BUCKETS - 1), minlength=BUCKETS)
            word_of.append(v.word_of + rows)
            hashes.append(np.unique(words.hashes))
            word.append(v.word)
            piece.append(v.piece)
            n_pieces.append(np.diff(np.append(v.first, len(v.piece))))
            rows += len(v.word)
    first = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1, np.int64)
    if not rows:
        return Vocabulary(*(np.zeros(0, np.int64) for _ in range(4))), first, seen
    _, at, same = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    n = np.concatenate(n_pieces)
    whole = Vocabulary(same[np.concatenate(word_of)], np.concatenate(word), np.concatenate(piece), np.cumsum(n) - n)
    return replace(whole.only(at), word_of=whole.word_of), first, seen


def train(sample: list[tuple[str, int]], seed: int = 3) -> Network:
    """Fit by Adam on (text, 0 or 1) pairs. Without both labels, a network that scores every window near 0.

    Only texts are labelled, not windows. In the first pass every window of a toxic text teaches, together as much as one of
    a clean text; before each later pass all windows of all texts are scored, and a toxic text teaches by its highest window,
    a clean one by its highest and by a random one. The network sees nothing of the labels but through its gradients.
    """
    rng = np.random.default_rng(seed)
    label = np.array([y for _, y in sample], np.int64)
    v, first, seen = _gathered([plain(t) for t, _ in sample])
    begin, end, text = cut_windows(first)
    net = _fresh(seen, rng)
    if not len(text) or not (label == 1).any() or not (label == 0).any():
        net.params["out_b"][:] = -8
        return net
    params = net.params
    m = {k: np.zeros_like(p) for k, p in params.items()}
    s = {k: np.zeros_like(p) for k, p in params.items()}
    step = 0
    n_windows = np.bincount(text, minlength=len(sample))
    toxic = label[text] == 1
    turn = -1
    while turn + 1 < EPOCHS or step < LEAST_STEPS:
        turn += 1
        weight = np.zeros(len(text))
        order = rng.permutation(len(text))
        weight[order[np.unique(text[order], return_index=True)[1]]] = 1  # a random window of each text
        if turn == 0:
            weight[toxic] = 1 / n_windows[text[toxic]]
        else:
            logits = net.logits(v, begin, end)
            order = np.lexsort((logits, text))
            highest = order[np.append(text[order][1:] != text[order][:-1], True)]
            weight[toxic] = 0
            weight[highest] += 1
        some = rng.permutation(np.flatnonzero(weight))
        for at in range(0, len(some), BATCH):
            part = some[at : at + BATCH]
            used, index, mask = v.steps(begin[part], end[part])
            own = v.only(used)
            x = net.inputs(own)
            hidden = rng.random(len(used)) < HIDE
            x[hidden] = 0
            keep: dict = {}
            logits = net.forward(x, index, mask, keep)
            grads, d_x = net.gradients(keep, ((_sigmoid(logits) - label[text[part]]) * weight[part] / BATCH).astype(np.float32))
            d_x[hidden] = 0
            n = np.diff(np.append(own.first, len(own.piece)))
            grads["words"] = _summed(net.word_row[own.word], d_x[:, :EMBEDDING], len(params["words"]))
            grads["chars"] = _summed(net.piece_row[own.piece], np.repeat(d_x[:, EMBEDDING:] / n[:, None], n, 0), len(params["chars"]))
            step += 1
            rate = RATE / (1 + step / SLOWER)
            for k, p in params.items():
                m[k] += 0.1 * (grads[k] - m[k])
                s[k] += 0.001 * (grads[k] ** 2 - s[k])
                p -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(p.dtype)
            for k in ("words", "chars"):
                params[k] *= 1 - SHRINK
                params[k][0] = 0  # the row of the rare ones
    return net


def _fresh(seen: np.ndarray, rng: np.random.Generator) -> Network:
    """A network before training; a bucket in fewer than MIN_TEXTS of the texts shares the row of the rare ones, zero."""
    word_row, piece_row = np.where(seen >= MIN_TEXTS, np.cumsum(seen >= MIN_TEXTS, 1), 0).astype(np.int32)
    normal = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
    table = lambda row: np.concatenate([np.zeros((1, EMBEDDING)), rng.normal(0, 0.05, (int(row.max()), EMBEDDING))]).astype(np.float32)
    params = {
        "words": table(word_row),
        "chars": table(piece_row),
        **{f"w{w}": normal(2 * EMBEDDING, 3 * HIDDEN) for w in "fb"},
        **{f"b{w}": np.zeros(3 * HIDDEN, np.float32) for w in "fb"},
        **{f"u{w}": normal(HIDDEN, 2 * HIDDEN) for w in "fb"},
        **{f"uc{w}": normal(HIDDEN, HIDDEN) for w in "fb"},
        "att": normal(2 * HIDDEN, ATTENTION),
        "att_b": np.zeros(ATTENTION, np.float32),
        "att_v": normal(ATTENTION),
        "out": normal(2 * HIDDEN),
        "out_b": np.array([-2.0], np.float32),
    }
    return Network(word_row, piece_row, params)


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", sample: int = SAMPLE) -> Network:
    """A network fitted on a bounded sample of the labelled rows that may be learned from.

    About `sample` documents of each label are drawn by a hash of doc_id; these few ids, so bounded, are broadcast to
    fetch the texts. Of several labels of a document the largest counts, null ones don't; of several texts the smallest.
    """
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(toxic).alias("y")).where("y IS NOT NULL AND doc_id IS NOT NULL").where(train_rows("doc_id"))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    known = drawn(known.withColumnRenamed("y", "label"), sample, ["doc_id"], 23)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text <> ''")
    found = texts.join(F.broadcast(known), "doc_id").groupBy("doc_id", "place", "label").agg(F.min("text").alias("text"))
    return fitted(found.withColumn("label", (F.col("label") == 1).cast("int")), train)


def score(docs: DataFrame, net: Network, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text, with the `carry` columns behind.

    The score is the highest window's probability; null and empty texts, and those without letter or digit, score 0.
    predicted is 1 from THRESHOLD. One row for each row of `docs`, repeated ones and null ids too. Narrow.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(net)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), held_out(doc_id).alias("held_out"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    kinds = dict(rows.dtypes)

    def run(batches):
        for batch in batches:
            texts = ((i, plain(t.as_py())) for i, t in enumerate(batch.column(1)))
            scores = [shared.value.score_texts([t for _, t in group]) for group in wordhash.grouped(texts)]
            scores = np.concatenate(scores) if scores else np.zeros(0)
            columns = [batch.column(0), batch.column(2), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))]
            yield pa.record_batch([*columns, *batch.columns[3:]], names=["doc_id", "held_out", "score", "predicted", *batch.schema.names[3:]])

    schema = "doc_id long, held_out boolean, score double, predicted int" + "".join(f", c{i} {kinds[f'c{i}']}" for i in range(len(carry)))
    found = rows.mapInArrow(run, schema)
    return found.select("doc_id", "held_out", "score", "predicted", *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)])
