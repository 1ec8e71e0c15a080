"""The operators against plain versions of themselves, and on odd tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barloom.llm import grid_join, langid, line_dedup, media, minhash, mixing, packing, queries, substrings, toxicity, url_filters, webp, wordhash
from barloom.llm.common import connected_components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "so many words stand here that no window holds them " * 3000
ODD = [
    (1, None, "en", "s1", 7),
    (2, "", None, None, 7),
    (3, " \t\n", "en", "s1", None),
    (4, LONG, "de", "s2", 7),
    (None, "one two three four five six", "en", "s3", 7),
    (5, "one two three four five six", "en", "s1", 7),
    (5, "one two three four five six", "en", "s1", 7),
    (6, "é ñ 漢字 <|endoftext|> \U0001f600 one", None, "s1", 7),
]
#: Columns beyond the documents' own, with names that operators use inside.
FIELDS = "doc_id long, text string, lang string, source string, n long"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, FIELDS).withColumns({c: F.lit(1) for c in ("doc", "key", "rep", "row", "h1", "gone", "kept", "c0", "at", "label", "place", "size")})


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def components(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_connected_components(spark):
    rng = np.random.default_rng(4)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(200 + i, 201 + i) for i in range(20)]
    got = dict(connected_components(spark.createDataFrame([*links, (None, 3), (7, 7)], "a long, b long")).collect())
    plain = components({x for p in links for x in p}, links)
    assert all(plain[n] == c for n, c in got.items()) and set(got) == {x for p in links if p[0] != p[1] for x in p}


# 1


def test_mixing_fills_siblings_first(spark):
    rows = [(i, "w " * n, lang, src, 0) for i, (n, lang, src) in enumerate([(10, "a", "x")] + [(10, "a", "y")] * 10 + [(10, "b", "z")] * 30)]
    docs = spark.createDataFrame(rows, FIELDS)
    got = mixing.mix(docs, ["lang", "source"], {"lang": {"a": 1, "b": 1}}, (40, 100)).collect()
    taken = collections.Counter()
    for r in got:
        taken[r["lang"], r["source"]] += r["take_tokens"]
        assert r["epoch"] == 0 and 0 < r["take_tokens"] <= r["n_tokens"]
    assert taken == {("a", "x"): 10, ("a", "y"): 72, ("b", "z"): 82}
    got = mixing.mix(docs, ["source"], {"source": {"x": 50}}, (1, 2), max_epochs=3).collect()
    assert sum(r["take_tokens"] for r in got if r["source"] == "x") == 30
    assert sum(r["take_tokens"] for r in got) == 205


def test_mixing_odd(odd, none):
    assert mixing.mix(none, ["lang", "source"], {}, (1, 2)).count() == 0
    whole = mixing.mix(odd, ["lang", "source"], {}, (1, 1)).collect()
    assert sum(r["take_tokens"] for r in whole) == sum(len(WORD.findall(t or "")) for _, t, *_ in ODD)


# 2


def test_line_dedup(spark, odd, none):
    line = "this boilerplate stands on many sites"
    docs = spark.createDataFrame([(i, f"{line}\nown line number {i} of this one\n{line} ", "en", f"s{i % 6}", 0) for i in range(12)], FIELDS)
    got = {r["doc_id"]: r for r in line_dedup.drop_boilerplate(docs, min_sites=6, counts=True).collect()}
    assert got[0]["text"] == f"{line}\nown line number 0 of this one" and got[0]["n_removed"] == 1
    assert all(got[i]["text"] == f"own line number {i} of this one" and got[i]["n_removed"] == 2 for i in range(1, 12))
    assert line_dedup.drop_boilerplate(docs, min_sites=7).exceptAll(docs).count() == 0
    out = line_dedup.drop_boilerplate(odd, min_sites=1, min_chars=1)
    assert out.columns == odd.columns and out.count() == len(ODD) and line_dedup.drop_boilerplate(none).count() == 0
    assert [r["text"] for r in out.where("doc_id = 1").collect()] == [None]


@pytest.mark.parametrize("hot", [1, 3, 2000])
def test_line_dedup_beyond_its_list_of_hot_lines(spark, monkeypatch, hot):
    """Whatever lines the list of hot ones holds, the result is that of a plain count of sites."""
    monkeypatch.setattr(line_dedup, "HOT", hot)
    rng = np.random.default_rng(hot)
    pool = [f"a line of many documents, number {i}" for i in range(12)]
    rows = []
    for i in range(150):
        # Line k stands on about k + 1 sites; line 0 is the most frequent and stands on one.
        lines = [pool[k] for k in range(12) if i % 20 <= k and rng.random() < 0.6] + [f"the own line of document {i}"]
        rows.append((i, "\n".join([pool[0]] * (i % 20 == 0) * 3 + lines), "en", f"s{i % 20}", 0))
    sites, first = {}, {}
    for i, text, _, site, _ in rows:
        for at, line in enumerate(text.split("\n")):
            sites.setdefault(line, set()).add(site)
            first[line] = min(first.get(line, (i, at)), (i, at))
    for least in (5, 9):
        want = {
            i: "\n".join(x for at, x in enumerate(text.split("\n")) if len(sites[x]) < least or first[x] == (i, at)) for i, text, *_ in rows
        }
        got = line_dedup.drop_boilerplate(spark.createDataFrame(rows, FIELDS), min_sites=least).collect()
        assert {r["doc_id"]: r["text"] for r in got} == want and len(got) == len(rows)
        assert want != {i: text for i, text, *_ in rows}


# 3


def test_toxicity_learns_and_scores_every_window(spark, odd, none):
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(200)]
    sample = []
    for i in range(240):
        text = list(rng.choice(words, int(rng.integers(20, 200))))
        if i % 2:
            text[int(rng.integers(len(text)))] = ["zorgnax", "zorgnix"][i // 2 % 2]
        sample.append((" ".join(text), i % 2))
    net = toxicity.train(sample[:180])
    scores = net.score_texts([toxicity.plain(t) for t, _ in sample[180:]])
    assert np.mean((scores >= 0.7) == np.array([y for _, y in sample[180:]])) > 0.9
    late = " ".join([*rng.choice(words, 3000), "zorgnax", *rng.choice(words, 30)])
    assert net.score_texts([toxicity.plain(late)])[0] >= 0.7
    rows = toxicity.score(odd, net).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert toxicity.score(none, net).count() == 0
    assert toxicity.train([]).score_texts([b"word", b""]).max() < 0.1
    begin, end, text = toxicity.cut_windows(np.array([0, 0, 5, 405]))
    assert set(np.concatenate([np.arange(b, e) for b, e in zip(begin, end, strict=True)])) == set(range(405)) and text[0] == 1


def windows_and_network():
    net = toxicity.train([("alpha beta gamma", 1), ("delta beta", 0), ("alpha delta", 1), ("gamma alpha beta", 0), ("delta gamma alpha", 1), ("beta", 0)])
    assert net.word_row.max() == 4 and net.piece_row.max() > 4
    words = wordhash.split_words([b"alpha beta gamma delta", b"beta " * 70, b"delta"])
    v = toxicity.vocabulary(words)
    begin, end, _ = toxicity.cut_windows(words.first)
    net.params = {k: p.astype(np.float64) for k, p in net.params.items()}
    return net, v, begin, end


def test_forward_is_the_plain_recurrence():
    """Word by word and window by window, in loops."""
    net, v, begin, end = windows_and_network()
    p, n = net.params, toxicity.HIDDEN
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    rows = []
    for k in range(len(v.word)):
        pieces = v.piece[v.first[k] : (list(v.first) + [len(v.piece)])[k + 1]]
        rows.append(np.concatenate([p["words"][net.word_row[v.word[k]]], np.mean([p["chars"][net.piece_row[x]] for x in pieces], 0)]))
    want = []
    for lo, hi in zip(begin, end, strict=True):
        states = []
        for way, order in (("f", range(lo, hi)), ("b", range(hi - 1, lo - 1, -1))):
            h, own = np.zeros(n), {}
            for at in order:
                x = rows[v.word_of[at]] @ p[f"w{way}"] + p[f"b{way}"]
                z, r = sigmoid(x[:n] + h @ p[f"u{way}"][:, :n]), sigmoid(x[n : 2 * n] + h @ p[f"u{way}"][:, n:])
                h = (1 - z) * h + z * np.tanh(x[2 * n :] + (r * h) @ p[f"uc{way}"])
                own[at] = h
            states.append(own)
        both = [np.concatenate([s[at] for s in states]) for at in range(lo, hi)]
        a = np.exp([np.tanh(h @ p["att"] + p["att_b"]) @ p["att_v"] for h in both])
        want.append(sum(w * h for w, h in zip(a / a.sum(), both, strict=True)) @ p["out"] + p["out_b"][0])
    assert len(want) == 4 and np.allclose(net.logits(v, begin, end), want, atol=1e-9)


def test_gradients_are_those_of_the_loss():
    net, v, begin, end = windows_and_network()
    used, index, mask = v.steps(begin, end)
    x = net.inputs(v.only(used))
    keep = {}
    net.forward(x, index, mask, keep)
    grads, _ = net.gradients(keep, np.ones(len(begin)))
    for k in ("wf", "ub", "ucf", "att", "out"):
        p, at = net.params[k], (0,) * net.params[k].ndim
        old, e, sums = p[at], 1e-3, []
        for d in (e, -e):
            p[at] = old + d
            sums.append(float(net.forward(x, index, mask).sum()))
        p[at] = old
        assert math.isclose(grads[k][at], (sums[0] - sums[1]) / (2 * e), rel_tol=0.02, abs_tol=1e-4), k


def test_toxicity_learns_the_same_from_any_order(spark):
    """Of a document with several texts the smallest is learned from, of several labels the largest."""
    rows = [(i, f"some words and {'zorgnax' if i % 2 else 'others'} of text {k}", "en", "s", 0) for i in range(40) for k in range(3)]
    labels = [(i, y) for i in range(40) for y in (0, i % 2, None)]
    nets = []
    for turn in (1, -1):
        docs = spark.createDataFrame(rows[::turn], FIELDS).repartition(3 + turn)
        nets.append(toxicity.learn(docs, spark.createDataFrame(labels[::turn], "doc_id long, toxic int")).params)
    assert all((nets[0][k] == nets[1][k]).all() for k in nets[0])


# 4


def test_grid_join(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 6))
    v = np.concatenate([base, base[:20] + rng.normal(0, 0.15, (20, 6)), base[:5] * 3, base[:3]])
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    rows += [(900, None), (901, [0.0] * 6), (902, [1.0, None, 0, 0, 0, 0]), (903, [float("nan")] * 6), (904, [1.0, 2.0]), (905, []), (None, [1.0] * 6), (906, [float("inf")] + [0.0] * 5)]
    rows = [(i, None if r is None else [None if x is None else float(x) for x in r], 1) for i, r in rows]
    got = grid_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, node int"), 0.9).collect()
    near = np.array([grid_join.unit(v) @ w for w in grid_join.unit(v)]) >= 0.9
    plain = components(range(len(v)), zip(*np.nonzero(near), strict=True))
    assert len(got) == len(rows)
    for r in got:
        if r["vec_id"] is not None and r["vec_id"] < 900:
            assert (r["n_links"], r["component_id"]) == (near[r["vec_id"]].sum() - 1, plain[r["vec_id"]])
        else:
            assert r["n_links"] == 0 and r["component_id"] == r["vec_id"] and r["kept"]
    assert grid_join.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_grid_join_links_through_null_ids(spark):
    """Rows with a null id take part like any other, -1 is an id like any other, and rows that share an id are one node."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=(50, 6))
    v = np.concatenate([base] + [base + rng.normal(0, 0.12, base.shape) for _ in range(5)] + [base[:9]])
    ids = [None if rng.random() < 0.5 else int(i) - 1 for i in rng.permutation(len(v))]
    ids[3] = ids[60] = ids[117] = 10_000  # unlike vectors, one id
    rows = [(i, [float(x) for x in r]) for i, r in zip(ids, v, strict=True)]
    got = grid_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.95).collect()
    near = grid_join.unit(v) @ grid_join.unit(v).T >= 0.95
    same = [(a, b) for a in range(len(v)) for b in range(a) if ids[a] is not None and ids[a] == ids[b]]
    plain = components(range(len(v)), [*zip(*np.nonzero(near), strict=True), *same])
    least = collections.defaultdict(list)
    for at, root in plain.items():
        least[root] += [ids[at]] if ids[at] is not None else []
    want = collections.Counter()
    for at, root in plain.items():
        low = min(least[root], default=None)
        want[ids[at], int(near[at].sum()) - 1, low, ids[at] is None or ids[at] == low] += 1
    assert -1 in ids and collections.Counter(map(tuple, got)) == want


def test_grid_join_skips_only_distant_blocks():
    rng = np.random.default_rng(5)
    v = grid_join.unit(np.repeat(rng.normal(size=(60, 5)), 20, 0) + rng.normal(0, 0.02, (1200, 5)))
    p = v[:, :3]
    order = np.lexsort(p.T[::-1])
    side, tally = grid_join.side_of(p[order], v[order], np.ones(len(v), np.int64)), {}
    links, _, edges = grid_join.join_intervals(side, None, 0.95, math.sqrt(0.1) + 1e-9, tally)
    assert tally["boxes"] > 0 and tally["points"] > 0 and tally["boxes"] + tally["points"] > 0.7 * tally["pairs"]
    near = v[order] @ v[order].T >= 0.95
    assert (links == near.sum(1) - 1).all()
    roots = components(range(len(v)), zip(*np.nonzero(near), strict=True))
    assert [roots[i] for i in range(len(v))] == grid_join._roots(len(v), edges).tolist()


def test_grid_join_of_many_blocks_is_brute_force(spark, monkeypatch):
    """Planted links within and between blocks, in 64 dimensions, and the share of pairs that the projections spare."""
    monkeypatch.setattr(grid_join, "BLOCK_VALUES", 64 * 64)
    rng = np.random.default_rng(17)
    base = rng.normal(size=(700, 64))
    v = np.concatenate([base] + [base[:200] + rng.normal(0, s, (200, 64)) for s in (0.1, 0.2, 0.3)] + [base[:30]])
    rows = [(int(i), [float(x) for x in r]) for i, r in zip(rng.permutation(len(v)), v, strict=True)]
    got = grid_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 0.95).collect()
    w = grid_join.unit(np.array([r for _, r in rows], np.float32))
    near, ids = w @ w.T >= 0.95, [i for i, _ in rows]
    plain = components(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True)])
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {i: (int(near[k].sum()) - 1, plain[i]) for k, i in enumerate(ids)}
    assert near.sum() > 2 * len(v) and len({plain[i] for i in ids}) < 800
    centred = w - w.mean(0)
    p = centred @ np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, : grid_join.LEADING]
    order, tally = np.lexsort(np.floor(p[:, : grid_join.GRID] / 0.08).T[::-1]), {}
    grid_join.join_intervals(grid_join.side_of(p[order], w[order], np.ones(len(w), np.int64)), None, 0.95, math.sqrt(0.1) + 1e-9, tally)
    assert tally["boxes"] + tally["points"] > 0.9 * tally["pairs"]


# 5


def bits_of(write):
    data = write.value.to_bytes(write.n // 8 + 1, "little")
    return webp.struct.pack("<4sI4s4sI", b"RIFF", len(data) + len(data) % 2 + 12, b"WEBP", b"VP8L", len(data)) + data + b"\0" * (len(data) % 2)


def flat_image(write, argb, main, cache_bits=0):
    """Literals in codes of eight bits for each of the four samples."""
    write(1 if cache_bits else 0, 1)
    if cache_bits:
        write(cache_bits, 4)
    if main:
        write(0, 1)
    eight = np.full(256, 8, np.int64)
    green = np.concatenate([eight, np.zeros(24 + ((1 << cache_bits) if cache_bits else 0), np.int64)])
    for lengths in (green, eight, eight, eight, np.eye(1, 40, 0, dtype=np.int64)[0]):
        webp.write_code(write, lengths)
    code = webp.canonical(eight)
    for p in argb.ravel().tolist():
        for s in (8, 16, 0, 24):
            write(int(code[p >> s & 255]), 8)


def head(write, width, height):
    for value, n in ((webp.SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        write(value, n)


def samples_of(argb):
    return np.stack([argb >> s & 255 for s in (24, 16, 8, 0)], -1).astype(np.int64)


def test_payloads_come_back():
    rng = np.random.default_rng(1)
    payloads = [b" " * 192, bytes(range(256)) * 3, rng.integers(0, 256, 192 * 70, dtype=np.uint8).tobytes(), b"ab\n" * 64 * 3, ("text é and more " * 4000).encode()]
    payloads = [p.ljust(-(-len(p) // 192) * 192) for p in payloads]
    files = webp.encode_many(payloads)
    assert [webp.samples(i) for i in webp.decode_many(files)] == payloads
    assert [webp.samples(webp.decode_many([f])[0]) for f in files] == payloads
    assert len(files[4]) < len(payloads[4]) and files[4][12:16] == b"VP8X"
    with pytest.raises(ValueError):
        webp.decode_many([b"RIFF\0\0\0\0WEBP"])


def test_predictor_modes():
    rng = np.random.default_rng(2)
    image = rng.integers(0, 1 << 32, (9, 11), dtype=np.uint64).astype(np.uint32)
    for mode in range(14):
        modes = np.full((3, 3), mode)
        # The residual is found by inverting pixel by pixel: what the decoder adds to nothing.
        residual, want = np.zeros_like(image), samples_of(image)
        for y in range(9):
            for x in range(11):
                got = samples_of(webp.undo_predictors([residual], [modes], 2)[0])[y, x]
                residual[y, x] = webp._join((want[y, x] - got) & 255)
        write = webp.BitWriter()
        head(write, 11, 9)
        write(1, 1), write(0, 2), write(0, 3)
        flat_image(write, (np.full((3, 3), mode, np.uint32) << 8) | 0xFF000000, False)
        write(0, 1)
        flat_image(write, residual, True)
        assert (webp.decode_many([bits_of(write)])[0] == image).all(), mode


def test_colour_transforms_and_palette():
    rng = np.random.default_rng(3)
    image = rng.integers(0, 1 << 32, (5, 6), dtype=np.uint64).astype(np.uint32)
    c = samples_of(image)
    signed = lambda v: (v ^ 0x80) - 0x80
    g2r, g2b, r2b = 35, 200, 90
    coded = c.copy()
    coded[..., 3] = (c[..., 3] - ((signed(g2b) * signed(c[..., 2])) >> 5) - ((signed(r2b) * signed(c[..., 1])) >> 5)) & 255
    coded[..., 1] = (c[..., 1] - ((signed(g2r) * signed(c[..., 2])) >> 5)) & 255
    coded[..., 1], coded[..., 3] = (coded[..., 1] - c[..., 2]) & 255, (coded[..., 3] - c[..., 2]) & 255
    write = webp.BitWriter()
    head(write, 6, 5)
    write(1, 1), write(1, 2), write(1, 3)
    flat_image(write, np.full((1, 1), 0xFF000000 | r2b << 16 | g2b << 8 | g2r, np.uint32), False)
    write(1, 1), write(2, 2), write(0, 1)
    flat_image(write, webp._join(coded), True, cache_bits=3)
    assert (webp.decode_many([bits_of(write)])[0] == image).all()
    for colours, bundle in ((2, 3), (4, 2), (13, 1), (40, 0)):
        table = rng.integers(0, 1 << 32, colours, dtype=np.uint64).astype(np.uint32)
        index = rng.integers(0, colours, (4, 7))
        width = (7 + (1 << bundle) - 1) >> bundle
        packed = np.zeros((4, width), np.uint32)
        for x in range(7):
            packed[:, x >> bundle] |= (index[:, x] << ((x & ((1 << bundle) - 1)) * (8 >> bundle)) << 8).astype(np.uint32)
        write = webp.BitWriter()
        head(write, 7, 4)
        write(1, 1), write(3, 2), write(colours - 1, 8)
        steps = samples_of(table)
        steps[1:] = (steps[1:] - steps[:-1]) & 255
        flat_image(write, webp._join(steps)[None], False)
        write(0, 1)
        flat_image(write, packed, True)
        assert (webp.decode_many([bits_of(write)])[0] == table[index]).all(), colours


class PlainDecoder:
    """A VP8L stream decoded bit by bit and pixel by pixel, in whole numbers and lists; notes which transforms it met."""

    def __init__(self, data):
        self.bits, self.at, self.met = int.from_bytes(data, "little"), 0, []

    def read(self, n):
        self.at += n
        return self.bits >> (self.at - n) & ((1 << n) - 1)

    def code(self, size):
        lengths = [0] * size
        if self.read(1):
            two, wide = self.read(1), self.read(1)
            symbols = [self.read(8 if wide else 1)] + ([self.read(8)] if two else [])
            for x in symbols:
                lengths[x] = 1
        else:
            own = [0] * 19
            for k in range(4 + self.read(4)):
                own[webp.CODE_LENGTH_ORDER[k]] = self.read(3)
            tree, left, found, last = self.tree(own), size, [], 8
            if self.read(1):
                left = 2 + self.read(2 + 2 * self.read(3))
            while len(found) < size and left:
                left -= 1
                x = self.symbol(tree)
                if x < 16:
                    found.append(x)
                    last = x or last
                else:
                    found += [last if x == 16 else 0] * {16: lambda: 3 + self.read(2), 17: lambda: 3 + self.read(3), 18: lambda: 11 + self.read(7)}[x]()
            lengths = found + [0] * (size - len(found))
        return self.tree(lengths)

    def tree(self, lengths):
        used = [x for x, n in enumerate(lengths) if n]
        if len(used) < 2:
            return used[0] if used else 0
        tree, value = {}, 0
        for n in range(1, 16):
            value <<= 1
            for x in used:
                if lengths[x] == n:
                    tree[n, value] = x
                    value += 1
        return tree

    def symbol(self, tree):
        if not isinstance(tree, dict):
            return tree
        n = value = 0
        while (n, value) not in tree:
            n, value = n + 1, value << 1 | self.read(1)
        return tree[n, value]

    def amount(self, prefix):
        if prefix < 4:
            return prefix + 1
        extra = (prefix - 2) >> 1
        return ((2 + (prefix & 1)) << extra) + self.read(extra) + 1

    def image(self, width, height, main):
        cache_bits = self.read(4) if self.read(1) else 0
        cache, meta = [0] * (1 << cache_bits), None
        if main and self.read(1):
            raise NotImplementedError
        sizes = [280 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40]
        green, red, blue, alpha, far = [self.code(n) for n in sizes]
        out = []
        while len(out) < width * height:
            x = self.symbol(green)
            if x < 256:
                r, b = self.symbol(red), self.symbol(blue)
                new = [self.symbol(alpha) << 24 | r << 16 | x << 8 | b]
            elif x < 280:
                n, d = self.amount(x - 256), self.amount(self.symbol(far))
                if d > 120:
                    d -= 120
                else:
                    d = max(1, webp.NEAR[d - 1][0] + webp.NEAR[d - 1][1] * width)
                new = [out[len(out) - d + k % d] for k in range(n)]
            else:
                new = [cache[x - 280]]
            for v in new:
                out.append(v)
                if cache_bits:
                    cache[(v * 0x1E35A7BD & 0xFFFFFFFF) >> (32 - cache_bits)] = v
        assert len(out) == width * height
        return out

    def decode(self):
        assert self.read(8) == 0x2F
        width, height = self.read(14) + 1, self.read(14) + 1
        self.read(4)
        todo, inner = [], width
        while self.read(1):
            kind = self.read(2)
            self.met.append(kind)
            if kind == 3:
                n = self.read(8) + 1
                table = samples_of(np.array(self.image(n, 1, False), np.int64)).cumsum(0) & 255
                per = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
                todo.append((kind, per, table.tolist(), inner))
                inner = -(-inner // (1 << per))
            elif kind != 2:
                bits = self.read(3) + 2
                across = -(-inner // (1 << bits))
                todo.append((kind, bits, self.image(across, -(-height // (1 << bits)), False), across))
        px = samples_of(np.array(self.image(inner, height, True), np.int64)).reshape(height, inner, 4).tolist()
        for kind, bits, table, across in reversed(todo):
            if kind == 3:
                step = 8 >> bits
                px = [[table[row[x >> bits][2] >> (x % (1 << bits)) * step & ((1 << step) - 1)] for x in range(across)] for row in px]
                continue
            self.modes = [m >> 8 & 15 for m in table] if kind == 0 else getattr(self, "modes", [])
            self.elements = [m & 0xFFFFFF for m in table] if kind == 1 else getattr(self, "elements", [])
            for y in range(height):
                for x in range(width):
                    own, e = px[y][x], table[(y >> bits) * across + (x >> bits)]
                    if kind == 1:
                        signed = lambda v: v - 256 if v > 127 else v
                        g2r, g2b, r2b = signed(e & 255), signed(e >> 8 & 255), signed(e >> 16 & 255)
                        own[1] = own[1] + (g2r * signed(own[2]) >> 5) & 255
                        own[3] = own[3] + (g2b * signed(own[2]) >> 5) + (r2b * signed(own[1]) >> 5) & 255
                        continue
                    mode = e >> 8 & 15
                    left, top = (px[y][x - 1] if x else None), (px[y - 1][x] if y else None)
                    if x == 0 or y == 0:
                        guess = left or top or [255, 0, 0, 0]
                    else:
                        corner = px[y - 1][x - 1]
                        guess = {
                            0: lambda: [255, 0, 0, 0],
                            1: lambda: left,
                            2: lambda: top,
                            11: lambda: left if sum(abs(t - c) for t, c in zip(top, corner)) < sum(abs(a - c) for a, c in zip(left, corner)) else top,  # noqa: B023, B905
                            12: lambda: [min(255, max(0, a + t - c)) for a, t, c in zip(left, top, corner)],  # noqa: B023, B905
                        }[mode]()
                    px[y][x] = [(a + b) & 255 for a, b in zip(own, guess, strict=True)]
        return np.array(px)


def test_texts_take_every_transform_and_a_plain_decoder_reads_them(spark):
    """Over the documents of the small table some tiles need each inversion; a sample of each is read pixel by pixel."""
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    payloads = [media.payload_of(t)[0] for t in texts]
    rng = np.random.default_rng(5)
    ramp = np.arange(32)[:, None, None] * 3 + np.arange(64)[None, :, None] * np.array([2, 1, 3])
    for kind in (np.int64(1), rng.integers(0, 3, (32, 64, 1)), np.where(rng.random((32, 1, 1)) < 0.5, 40, 0) + np.where(rng.random((1, 64, 1)) < 0.3, 90, 0)):
        payloads.append(((ramp if np.ndim(kind) < 3 or kind.max() < 9 else 0) + kind + np.zeros((32, 64, 3), np.int64)).astype(np.uint8).tobytes())
    payloads += [b"no! NO!! ".ljust(12) * 16 * 7, bytes(range(192)) * 2, rng.integers(0, 256, 192, dtype=np.uint8).tobytes() * 9]
    fields = (np.arange(40)[:, None] * 5 // 7 + np.arange(64)[None, :]) // 3
    payloads.append(((fields[..., None] * np.array([77, 131, 201]) + rng.integers(0, 2, (40, 64, 3)) * (fields[..., None] % 3 == 0)) & 255).astype(np.uint8).tobytes())
    payloads.append(np.repeat(rng.integers(0, 256, (24, 8, 3), dtype=np.uint8), 8, 1).tobytes())
    assert all(len(p) % 192 == 0 for p in payloads)
    met, of_texts, read = collections.Counter(), collections.Counter(), collections.Counter()
    for i, (payload, file) in enumerate(zip(payloads, webp.encode_many(payloads), strict=True)):
        for k, (_, y, begin) in enumerate(webp.streams(file)[2]):
            fast = webp.decode_streams(file[begin:] + bytes(16), [0])[0]
            part = payload[k * 64 * 192 : (k + 1) * 64 * 192]
            assert webp.samples(fast) == part
            stream = webp.Stream(file[begin:], 0)
            job, kinds = stream.next_job(), []
            while stream.wanted:
                pixels, end = webp.decode_lanes(webp.words_at(file[begin:]), [job])
                kind = stream.wanted[0]
                if kind != webp.PALETTE:
                    kinds += [(kind, x) for x in np.unique(pixels[0] >> 8 & 15 if kind == webp.PREDICTOR else pixels[0] & 0xFFFFFF).tolist()]
                else:
                    kinds.append((kind, stream.wanted[1] <= 16))
                stream.at = int(end[0])
                job = stream.next_job(pixels[0])
            met.update(set(kinds))
            of_texts.update({(kind, x > 0) for kind, x in kinds} if i < len(texts) else ())
            if any(read[x] < 2 for x in kinds):
                plain = PlainDecoder(file[begin:])
                assert (plain.decode() == samples_of(fast.astype(np.int64))).all()
                read.update(kinds)
    assert all(of_texts[kind, True] > 0 for kind in (webp.PREDICTOR, webp.CROSS_COLOUR, webp.PALETTE)), of_texts
    assert {(webp.PREDICTOR, m) for m in webp.MODES} | {(webp.PALETTE, True), (webp.PALETTE, False)} <= set(met), met
    assert len([x for x in met if x[0] == webp.CROSS_COLOUR]) == len(webp.ELEMENTS)


def test_media_digests(odd, none):
    rows = media.read_media(media.store_media(odd), payload=False).collect()
    texts = collections.Counter((i, hashlib.sha256(media.payload_of(t)[0]).hexdigest(), len((t or "").encode())) for i, t, *_ in ODD)
    assert collections.Counter((r["doc_id"], r["payload_sha256"], r["n_bytes"]) for r in rows) == texts
    assert all(r["tail_crc32"] == zlib.crc32(b" " * 16) for r in rows if r["n_bytes"] == 0)
    assert media.read_media(media.store_media(none)).count() == 0


# 6


def test_bound_never_exceeds_a_packing():
    rng = np.random.default_rng(6)
    for _ in range(60):
        lengths = rng.integers(1, 33, rng.integers(1, 60))
        where, offset, bins = packing.best_fit_decreasing(lengths, 32)
        assert packing.lower_bound(np.bincount(lengths, minlength=33), 32) <= bins
        for b in range(bins):
            mine = sorted(zip(offset[where == b], lengths[where == b], strict=True))
            assert [o for o, _ in mine] == list(np.cumsum([0] + [n for _, n in mine[:-1]])) and sum(n for _, n in mine) <= 32
    assert packing.lower_bound(np.bincount([17] * 5, minlength=33), 32) == 5


def test_packing(odd, none):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    slow = Tokenizer.from_file(path)
    rows = packing.pack(odd, path, 256).collect()
    want = collections.Counter()
    for i, t, *_ in ODD:
        ids = np.array(slow.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        cuts = [0, *range((len(ids) - 1) % 256 + 1, len(ids) + 1, 256)]
        want.update((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    places = collections.defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in places.values():
        s.sort()
        assert [o for o, _ in s] == list(np.cumsum([0] + [n for _, n in s[:-1]])) and sum(n for _, n in s) <= 256
    assert packing.pack(none, path).count() == 0


def test_packing_exchanges_until_nothing_is_saved(spark, monkeypatch):
    packings = []
    monkeypatch.setattr(packing, "PARTITION_ROWS", 40)
    monkeypatch.setattr(packing, "settled", lambda df: packings.append(df.cache()) or packings[-1])
    rng = np.random.default_rng(12)
    lengths = rng.integers(150, 700, 1500)
    rests = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "row long, rest int")
    placed = packing.place(rests, 1024).collect()
    counts = [[df.where(w).select("sequence_id").distinct().count() for w in ("given", "NOT given")] for df in packings]
    assert sorted(r["row"] for r in placed) == list(range(1500))
    bound = packing.lower_bound(np.bincount(lengths, minlength=1025), 1024)
    n = len({r["sequence_id"] for r in placed})
    saved = [a[0] - sum(b) for a, b in zip(counts, counts[1:], strict=False)]
    assert len(packings) > 4 and all(x > 0 for x in saved[:-1]) and (saved[-1] <= 0 or n == bound)


# 7


def test_url_filters(spark):
    urls = ["http://a.net/x", "HTTP://EXAMPLE.NET/en/?q", "http://example.net/enx", "http://b.example.com/de/y#z", "x.org/fr/", "http://net", None, "", "http://notnet/", "s://u.org/fr/", "s://.net/", "http://a.net/x"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rules = spark.createDataFrame([*queries.URL_RULES, (None, "/", "block")], "host string, path string, verdict string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filters.judge_urls(pages, rules).collect()}
    a, n = "allow", (None, "allow")
    assert [got[i] for i in range(12)] == [("net/", "block"), ("example.net/en/", a), ("net/", "block"), ("example.com/de/", "block"), n, n, n, n, n, ("org/fr/", a), ("net/", "block"), ("net/", "block")]
    assert url_filters.judge_urls(pages, rules.limit(0)).where("verdict = 'allow'").count() == 12
    assert url_filters.judge_urls(pages.limit(0), rules).count() == 0


# 8


def plain_near(docs, words, percent):
    sets = {}
    for i, text in docs:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, components(sets, links)


def test_hyperminhash(spark, documents, odd, none):
    rng = np.random.default_rng(8)
    base = [f"w{k}" for k in rng.integers(0, 900, 120)]
    texts = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    for k in range(60):
        copy = list(base)
        for at in rng.integers(0, 120, int(rng.integers(0, 5))):
            copy[at] = f"x{k}"
        texts.append((1000 + k, " ".join(copy)))
    texts += [(2000, "a b c d e f g h"), (2001, "A b c d e f g h"), (2002, "a b c d e f g"), (2003, "a b")]
    got = minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), words=4).collect()
    sets, plain = plain_near(texts, 4, 80)
    assert [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["n_shingles"] != len(sets[r["doc_id"]]) or r["component_id"] != plain[r["doc_id"]]] == []
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD) and all(r["component_id"] == 5 for r in rows if r["doc_id"] in (5, None))
    assert all(r["n_shingles"] == 0 and r["kept"] for r in rows if r["doc_id"] in (1, 2, 3))
    assert minhash.near_duplicates(none).count() == 0


def test_hyperminhash_splits_large_buckets(spark, monkeypatch):
    """Texts of one template fill a band's bucket: it is split by rare shingles, nothing is lost, and what moves grows with the texts."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "LARGE", 1)
    monkeypatch.setattr(minhash, "_estimated", lambda pairs, classes, threshold: pairs.where("a % 5 = 3"))  # hubs settle none of the copies
    moved = []
    split = minhash._split
    monkeypatch.setattr(minhash, "_split", lambda *a: moved.append(minhash.settled(split(*a))) or moved[-1])
    rng = np.random.default_rng(21)
    template = " ".join(f"t{k}" for k in range(60))
    texts = [(i, f"{template} " + " ".join(f"o{i}x{k}" for k in range(34))) for i in range(150)]
    near = []
    for i in range(0, 150, 10):
        words = texts[i][1].split()
        for at in rng.integers(60, len(words), 2):
            words[int(at)] = "changed"
        near.append((1000 + i, " ".join(words)))
    texts += near
    got = minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), words=4).collect()
    _, plain = plain_near(texts, 4, 80)
    assert {r["doc_id"]: r["component_id"] for r in got} == plain and len(set(plain.values())) == 150
    assert moved and moved[0].agg(F.max("m")).first()[0] <= 16
    assert moved[0].select("rep").distinct().count() <= 60


def test_estimate_is_close_and_never_drops_a_pair():
    rng = np.random.default_rng(9)
    for n, share in ((300, 0.9), (2000, 0.6)):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.concatenate([a[: int(n * share)], rng.integers(0, 1 << 63, n - int(n * share)).astype(np.uint64)])
        reg = minhash.registers_of([np.unique(a), np.unique(b)])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        equal = (reg[0] == reg[1]).mean()
        assert abs(equal - true) < 0.12
        assert minhash.may_reach(reg[0], reg[1], np.array(n), np.array(n), true)


# 9


def test_byte_cnn_is_the_plain_convolution():
    net = langid.train([("the one text of it", "en"), ("der eine Text davon", "de"), ("ein anderer Text", "de")])
    windows, _, _ = langid.windows_of(["ein Text of schön".encode(), b"x" * 700])
    for row, got in zip(windows, net.log_probabilities(windows), strict=True):
        hidden = []
        for k, kernel in enumerate(net.kernels):
            for f in range(langid.FILTERS):
                sums = [sum(float(net.embed[row[at + j]] @ kernel[j][:, f]) for j in range(len(kernel))) for at in range(langid.WINDOW - len(kernel) + 1)]
                hidden.append(max(0.0, max(sums) + float(net.bias[k * langid.FILTERS + f])))
        scores = np.array(hidden) @ net.out + net.out_bias
        assert np.allclose(got, scores - np.log(np.exp(scores).sum()), atol=1e-4)


def test_language_of_texts_without_letters(spark, documents):
    texts = ["² ½ ①", "123 _ !", "", None, "\u00aa", "ein Text"]
    got = langid.identify(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), langid.learn(documents, sample=50)).collect()
    assert [r["lang_pred"] == "und" for r in sorted(got)] == [True, True, True, True, False, False]


def test_byte_cnn(spark, documents, odd, none):
    net = langid.learn(documents, sample=200)
    rows = langid.identify(documents, net).join(documents.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.85
    got = langid.identify(odd, net).collect()
    assert len(got) == len(ODD) and all(r["lang_pred"] == "und" for r in got if r["doc_id"] in (1, 2, 3))
    assert langid.identify(none, langid.learn(none)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, langid.learn(none)).collect()} == {"und"}


# 10


def plain_dedup(docs, window):
    seen, out = {}, {}
    for i, text in sorted(docs):
        w = WORD.findall(text or "")
        for k in range(len(w) - window + 1):
            seen.setdefault(tuple(w[k : k + window]), (i, k))
    for i, text in docs:
        w = WORD.findall(text or "")
        gone = {p for k in range(len(w) - window + 1) if seen[tuple(w[k : k + window])] < (i, k) for p in range(k, k + window)}
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest())
    return out


@pytest.mark.parametrize("batches", [1, 2, 7])
def test_fingerprint_index(spark, documents, odd, none, batches):
    texts = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    passage = " ".join(f"p{k}" for k in range(21))
    texts += [(5000 + k, f"a{k} b {passage} c{k} " + " ".join(f"p{j}" for j in range(19))) for k in range(5)] + [(6000, "z " * 60)]
    got = substrings.deduplicate(spark.createDataFrame(texts, "doc_id long, text string"), min_batches=batches).collect()
    plain = plain_dedup(texts, 20)
    assert [r for r in got if (r["n_words"], r["n_removed"], r["kept_sha256"]) != plain[r["doc_id"]]] == [] and len(got) == len(texts)
    if batches == 2:
        rows = substrings.deduplicate(odd, keep_text=True).collect()
        assert len(rows) == len(ODD) and sum(r["n_words"] for r in rows) == sum(len(WORD.findall(t or "")) for _, t, *_ in ODD)
        assert all(r["kept_text"] == "" and r["n_removed"] == 0 for r in rows if r["doc_id"] in (1, 2, 3))
        assert substrings.deduplicate(none).count() == 0


def test_index_stays_and_takes_more(spark, documents, tmp_path):
    """Documents in two calls, the index opened again between them; runs are compacted by tiers, leftovers deleted."""
    texts = sorted((r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect())
    passage = " ".join(f"p{k}" for k in range(30))
    texts = [(i, f"{t} {passage}" if i % 3 == 0 else t) for i, t in texts] + [(9000, texts[0][1])]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    folder, half = f"file://{tmp_path}/index", len(texts) // 2
    first = substrings.FingerprintIndex(spark, folder)
    got = first.append(frame(texts[:half]), min_batches=3).collect()
    assert first.compacted == substrings.SHARDS and sorted(t for _, t, _ in first.runs) == [0] * substrings.SHARDS + [1] * substrings.SHARDS
    (tmp_path / "index" / "run-99").mkdir()
    later = substrings.FingerprintIndex(spark, folder)
    assert later.runs == first.runs and not (tmp_path / "index" / "run-99").exists()
    got += later.append(frame(texts[half:])).collect()
    assert later.compacted == 2 * substrings.SHARDS and [t for _, t, _ in later.runs] == [2] * substrings.SHARDS
    plain = plain_dedup(texts, 20)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == plain and len(got) == len(texts)
    with pytest.raises(ValueError):
        substrings.FingerprintIndex(spark, folder, window=30)
    later.drop()
    assert not (tmp_path / "index").exists()


def test_index_keeps_a_passage_that_stands_everywhere_in_few_rows(spark, tmp_path):
    passage = " ".join(f"p{k}" for k in range(40))
    docs = spark.createDataFrame([(i, passage) for i in range(3000)], "doc_id long, text string").repartition(6)
    index = substrings.FingerprintIndex(spark, f"file://{tmp_path}/index")
    got = index.append(docs, min_batches=2)
    assert got.where("n_removed = 40").count() == 2999
    rows = index._read(index.runs)
    assert rows.count() < 40 and rows.agg(F.max(F.length("hashes"))).first()[0] <= 6 * 21


def test_windows_are_packed_by_slots(monkeypatch):
    """Few rows for many windows; the same ones covered as one by one, where hashes meet in 48 bits, in history and by halves."""
    rng = np.random.default_rng(4)
    n = 40_000
    kept = np.zeros(n, substrings.WINDOW)
    kept["h"] = rng.integers(0, 6_000, n) * ((1 << 48) // 6_000)
    kept["check"], kept["doc"], kept["start"], kept["state"] = rng.integers(-2, 2, n), rng.integers(-50, 50, n), rng.integers(0, 500, n), 1
    kept["doc"][:5] = substrings.PAST
    past = kept[:300].copy()
    past["doc"], past["start"], past["state"] = substrings.PAST, -1, 0
    first = {}
    for h, check, doc, start, _ in np.concatenate([past, kept]).tolist():
        first[h, check] = min(first.get((h, check), (doc, start)), (doc, start))
    want = sorted((doc, start) for h, check, doc, start, _ in kept.tolist() if (doc, start) != first[h, check])
    sorted_by_slot = lambda batches: iter(pa.Table.from_batches(batches).sort_by("slot").to_batches(max_chunksize=50))
    for held in (substrings.HELD, 900):
        monkeypatch.setattr(substrings, "HELD", held)
        dealt = [substrings._dealt(part.copy(), 64) for part in (past, *np.array_split(kept, 7))]
        assert sum(b.num_rows for b in dealt) <= 8 * 64
        later = list(substrings._later(sorted_by_slot(dealt), 16))
        rows = [r for b in substrings._by_doc(sorted_by_slot(later)) for r in b.to_pylist()]
        assert len(rows) == len({r["doc"] for r in rows})
        got = [(r["doc"], s) for r in rows for s in np.frombuffer(r["starts"], "<i4").tolist()]
        assert sorted(got) == want


def test_index_finds_covered_windows_in_few_rows(spark, tmp_path):
    text = " ".join(f"p{k}" for k in range(2000))
    docs = spark.createDataFrame([(i, f"{text} {i}") for i in range(8)], "doc long, text string")
    found, _ = substrings.FingerprintIndex(spark, f"file://{tmp_path}/index").covered(docs)
    rows = found.collect()
    starts = {(r["doc"], s) for r in rows for s in np.frombuffer(r["starts"], "<i4").tolist()}
    assert starts == {(i, s) for i in range(1, 8) for s in range(1981)} and len(rows) == 7


# The pipeline, stage by stage


def test_pipeline_stages(spark, documents):
    import corpus_pipeline as pipeline

    names = [n for n, _ in pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "near-duplicates", "mixing", "packing"]
    stages = dict(pipeline.STAGES)
    docs = documents.limit(150).union(documents.limit(5).withColumn("doc_id", F.col("doc_id") + 100_000))
    near = stages["near-duplicates"](spark, docs, SF)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    plain = plain_near(rows, 5, 80)[1]
    assert sorted(r["doc_id"] for r in near.collect()) == sorted(i for i in plain if plain[i] == i)
    assert near.columns == docs.columns and stages["line dedup"](spark, docs, SF).columns == docs.columns
    drawn = stages["mixing"](spark, docs, SF)
    assert drawn.columns == docs.columns and drawn.exceptAll(docs).count() == 0
    clean = stages["toxicity"](spark, docs, SF)
    assert clean.columns == docs.columns and clean.exceptAll(docs).count() == 0 and clean.count() > 0.7 * docs.count()


def plain_lines(rows, least=5):
    """Texts of rows (doc_id, text, source) without the non-empty lines on `least` sites, but for the first place of each."""
    cut = lambda x: x.replace("\r", " ").replace("\t", " ").strip(" ")
    sites, first = {}, {}
    for i, text, site in rows:
        for at, line in enumerate(text.split("\n")):
            sites.setdefault(cut(line), set()).add(site)
            first[cut(line)] = min(first.get(cut(line), (i, at)), (i, at))
    stays = lambda i, at, x: not x or len(sites[x] - {None}) < least or first[x] == (i, at)
    return {i: "\n".join(x for at, x in enumerate(text.split("\n")) if stays(i, at, cut(x))) for i, text, _ in rows}


def test_pipeline_drops_short_boilerplate(spark):
    import corpus_pipeline as pipeline

    rows = [(i, f"Les.\n\nown line number {i}\n x\nthis boilerplate stands on many sites", "en", f"s{i % 6}", 0) for i in range(12)]
    docs = spark.createDataFrame(rows, FIELDS).withColumn("n_chars", F.length("text").cast("long"))
    got = pipeline.drop_boilerplate(spark, docs, SF).collect()
    assert {r["doc_id"]: r["text"] for r in got} == plain_lines([(i, t, s) for i, t, _, s, _ in rows])
    assert all(r["text"] == f"\nown line number {r['doc_id']}" and r["n_chars"] == len(r["text"]) for r in got if r["doc_id"])


def test_pipeline_keeps_one_row_of_a_group(spark, documents):
    """Repeated rows, null ids and shared ids included."""
    import corpus_pipeline as pipeline

    rows = [(r["doc_id"], r["text"]) for r in documents.limit(60).collect()]
    words = " ".join(f"w{k}" for k in range(80))
    rows += rows[:5] + [(None, words)] * 4 + [(None, f"{words} {k}") for k in range(3)] + [(None, rows[7][1]), (7000, f"other {words} x"), (rows[9][0], "a b c d e f g")]
    rows += [(None, None)] * 2
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], FIELDS)
    got = pipeline.drop_near_duplicates(spark, docs, SF)
    plain = plain_near(enumerate(t for _, t in rows), 5, 80)[1]
    best = {}
    for at, group in plain.items():
        i = rows[at][0]
        best[group] = min(best.get(group, (True, 0)), (i is None, i or 0))
    want = collections.Counter(None if unnamed else i for unnamed, i in best.values())
    assert collections.Counter(r["doc_id"] for r in got.collect()) == want and want[7000] == 1 and want[None] == 2
    assert got.columns == docs.columns and got.exceptAll(docs).count() == 0
