"""Language identification by a byte convolutional network, in numpy.

A text is cut into windows of WINDOW bytes, the last one filled with zeros. Every byte has an embedding; filters of
several widths slide over the window, the largest value of each filter is kept, and a softmax layer gives the
languages' log-probabilities. The windows' mean log-probabilities, by bytes, decide for the text.

For scoring, each filter's product with each byte's embedding is tabulated, so a convolution of width w is w table rows
added up.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import held_out
from barloom.llm.sampling import fitted, labelled_sample
from barloom.llm.wordhash import encoded, grouped

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBEDDING = 8
#: Labelled texts of each language fitted on, at most about; and windows of a batch and passes over them.
SAMPLE = 1500
BATCH = 64
EPOCHS = 3


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, text of each, bytes of each): whole texts in rows of WINDOW bytes, filled with zeros."""
    sizes = np.array([len(t) for t in texts], np.int64)
    n = -(-sizes // WINDOW)
    joined = b"".join(t.ljust(int(k) * WINDOW, b"\0") for t, k in zip(texts, n, strict=True))
    owner = np.repeat(np.arange(len(texts)), n)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    return np.frombuffer(joined, np.uint8).reshape(-1, WINDOW), owner, np.minimum(WINDOW, sizes[owner] - at * WINDOW)


@dataclass
class Network:
    labels: list[str]
    embed: np.ndarray  # (256, EMBEDDING)
    kernels: list[np.ndarray]  # (width, EMBEDDING, FILTERS) each
    bias: np.ndarray  # (filters,)
    out: np.ndarray  # (filters, labels)
    out_bias: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        return [[np.ascontiguousarray(self.embed @ k[j]) for j in range(len(k))] for k in self.kernels]

    def log_probabilities(self, windows: np.ndarray, tables: list | None = None) -> np.ndarray:
        """(windows, labels)."""
        tables = tables or self.tables()
        pooled = np.empty((len(windows), len(self.bias)), np.float32)
        for at in range(0, len(windows), 32):  # a few windows at a time stay in the cache
            part = windows[at : at + 32]
            n = len(part)
            flat = part.ravel()
            for k, rows in enumerate(tables):
                total = np.take(rows[0], flat, 0)
                for j, row in enumerate(rows[1:], 1):
                    total[: len(flat) - j] += np.take(row, flat[j:], 0)
                best = total.reshape(n, WINDOW, FILTERS)[:, : WINDOW - len(rows) + 1].max(1)
                pooled[at : at + n, k * FILTERS : (k + 1) * FILTERS] = best
        scores = np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias
        scores -= scores.max(1, keepdims=True)
        return scores - np.log(np.exp(scores).sum(1, keepdims=True))


def train(sample: list[tuple[str, str]], seed: int = 5) -> Network:
    """Fit by Adam on all windows of (text, language) pairs; with no pairs, a network without labels."""
    labels = sorted({lab for _, lab in sample})
    rng = np.random.default_rng(seed)
    n_filters = len(WIDTHS) * FILTERS
    net = Network(
        labels,
        rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32),
        [rng.normal(0, 1 / np.sqrt(w * EMBEDDING), (w, EMBEDDING, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(n_filters, np.float32),
        rng.normal(0, 1 / np.sqrt(n_filters), (n_filters, len(labels))).astype(np.float32),
        np.zeros(len(labels), np.float32),
    )
    if len(labels) < 2:
        return net
    windows, owner, _ = windows_of([encoded(t) for t, _ in sample])
    target = np.array([labels.index(lab) for _, lab in sample])[owner]
    params = [net.embed, *net.kernels, net.bias, net.out, net.out_bias]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            step += 1
            for p, g, a, b in zip(params, _gradients(net, windows[part], target[part]), m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= 0.01 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return net


def _gradients(net: Network, windows: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
    n = len(windows)
    x = net.embed[windows]
    pooled, places = [], []
    for kernel in net.kernels:
        w = len(kernel)
        total = sum(x[:, j : WINDOW - w + 1 + j] @ kernel[j] for j in range(w))
        at = total.argmax(1)
        places.append(at)
        pooled.append(np.take_along_axis(total, at[:, None], 1)[:, 0])
    before = np.concatenate(pooled, 1) + net.bias
    hidden = np.maximum(before, 0)
    scores = hidden @ net.out + net.out_bias
    p = np.exp(scores - scores.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    p[np.arange(n), target] -= 1
    p /= n
    d_hidden = (p @ net.out.T) * (before > 0)
    d_embed, d_kernels = np.zeros_like(net.embed), []
    for k, (kernel, at) in enumerate(zip(net.kernels, places, strict=True)):
        d = d_hidden[:, k * FILTERS : (k + 1) * FILTERS]
        d_kernel = np.zeros_like(kernel)
        for j in range(len(kernel)):
            byte = np.take_along_axis(windows, at + j, 1)
            d_kernel[j] = np.einsum("nfe,nf->ef", net.embed[byte], d)
            np.add.at(d_embed, byte.ravel(), (d[:, :, None] * kernel[j].T[None]).reshape(-1, EMBEDDING))
        d_kernels.append(d_kernel)
    return [d_embed, *d_kernels, d_hidden.sum(0), hidden.T @ p, p.sum(0)]


def identify(docs: DataFrame, net: Network, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score): the most likely language of every whole text.

    `und`, with score 0, for a null text, one without a letter, and where nothing was learned. The score is the
    softmax of the text's mean log-probabilities. One row for each row of `docs`, repeated ones and null ids too. Narrow.
    """
    tables = net.tables()

    def run(batches):
        for batch in batches:
            rows = ((i.as_py(), encoded(t.as_py()), h.as_py(), any(map(str.isalpha, t.as_py() or ""))) for i, t, h in zip(*batch.columns, strict=True))
            for group in grouped(rows):
                asked = [k for k, r in enumerate(group) if r[3] and net.labels]
                names, scores = ["und"] * len(group), [0.0] * len(group)
                if asked:
                    windows, owner, size = windows_of([group[k][1] for k in asked])
                    logs = net.log_probabilities(windows, tables) * size[:, None]
                    total = np.add.reduceat(logs, np.searchsorted(owner, np.arange(len(asked))), 0)
                    mean = total / np.bincount(owner, size)[:, None]
                    p = np.exp(mean - mean.max(1, keepdims=True))
                    p /= p.sum(1, keepdims=True)
                    for k, best, row in zip(asked, p.argmax(1), p, strict=True):
                        names[k], scores[k] = net.labels[best], float(row[best])
                yield pa.record_batch(
                    [pa.array([r[0] for r in group], pa.int64()), pa.array([r[2] for r in group], pa.bool_()), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), held_out(doc_id).alias("held"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def learn(docs: DataFrame, lang: str = "lang", sample: int = SAMPLE) -> Network:
    """A network fitted on a bounded sample of the rows with a language that may be learned from."""
    return fitted(labelled_sample(docs, F.col(lang), sample), train)
