"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

Inputs of a word are an embedding of the word and the sum of embeddings of its 4-byte pieces (with a mark before its first
byte, so that beginnings differ from middles), both hashed. Texts are cut into windows of 64 words, each 16 words into the
next, over the whole text; a text's score is that of its highest window.

Training takes a bounded sample of labelled rows (POSITIVES and NEGATIVES, the first by hash of the id) on the driver, with
all windows of their texts, in STEPS minibatches, however many rows there are. With few labels a network would learn its texts
by heart, so embeddings start at what the sample vouches for: the first number of each is the evidence that a word or piece
stands for label 1 (see _evidence), the others are 0, so what training never met says nothing. From there they move at the
slow rate, and half of the word embeddings are left out at each step, so that pieces count too. A label is of a whole text, and
a minibatch takes one window of each text: in the first third of the steps the one with the most evidence, so that the
network sees the windows that bear the label before it can find them itself; after that the text's highest window.

Defined results: null and empty texts have one window without words, so they get the score of the bias; rows with a null id
are in the fold of the empty text and teach nothing; a label that is null teaches nothing; without labels of both kinds the
network stays as it was drawn, with a bias of the share of label 1; repeated rows are scored alike; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.llm import kernels as kn
from loomstead.llm.common import in_fold

WINDOW, STRIDE = 64, 48
H, D = 8, 8
WORD_ROWS, PIECE_ROWS = 1 << 17, 1 << 16
#: The bounded sample of labelled rows that the network is fitted on.
POSITIVES, NEGATIVES = 1200, 2400
STEPS, BATCH, RATE, SLOW = 300, 48, 0.01, 0.001
#: Standard deviations of the interval by which words and pieces are vouched for.
SURE = 2.58
CHUNK = 2048


class Types:
    """The distinct words of some texts, and the texts as places in them."""

    def __init__(self, body: np.ndarray, at: np.ndarray):
        starts, ends, self.rows = kn.word_bounds(body, at)
        starts, ends = kn.stripped(body, starts, ends) if len(starts) else (starts, ends)
        h = kn.span_hashes(body, starts, ends)
        u, first, self.tokens = np.unique(h, return_index=True, return_inverse=True)
        self.hash, self.word = u, (u % np.uint64(WORD_ROWS)).astype(np.int64)
        s, e = starts[first], ends[first]
        n = np.maximum(1, e - s - 2)
        self.begin = np.concatenate([[0], np.cumsum(n)])
        owner = np.repeat(np.arange(len(u)), n)
        at0 = s[owner] + np.arange(self.begin[-1]) - self.begin[owner] - 1
        code = np.zeros(len(owner), np.uint64)
        for k in range(4):
            i = at0 + k
            byte = np.where(i < s[owner], ord("^"), np.where(i < e[owner], kn.LOWER[body[np.clip(i, 0, max(0, len(body) - 1))]] if len(body) else 0, 0))
            code = (code << np.uint64(8)) | byte.astype(np.uint64)
        self.piece = (kn.mix(code, 40) % np.uint64(PIECE_ROWS)).astype(np.int64)

    @classmethod
    def of(cls, texts: list[str]) -> Types:
        """Of many texts, taken in slices, so that what is needed for each byte is never held for all."""
        parts, rows = [], []
        for lo, _, body, at in kn.slices(pa.array(texts, pa.string())):
            parts.append(cls(body, at))
            rows.append(parts[-1].rows + lo)
        if len(parts) < 2:
            return parts[0] if parts else cls(np.zeros(0, np.uint8), np.zeros(1, np.int64))
        out = cls.__new__(cls)
        out.rows = np.concatenate(rows)
        out.hash, first, at = np.unique(np.concatenate([p.hash for p in parts]), return_index=True, return_inverse=True)
        edge = np.cumsum([0, *(len(p.hash) for p in parts)])
        out.tokens = np.concatenate([at[edge[i] + p.tokens] for i, p in enumerate(parts)])
        out.word = (out.hash % np.uint64(WORD_ROWS)).astype(np.int64)
        begin, n = np.concatenate([p.begin[:-1] + sum(len(q.piece) for q in parts[:i]) for i, p in enumerate(parts)]), np.concatenate([np.diff(p.begin) for p in parts])
        piece, n = np.concatenate([p.piece for p in parts]), n[first]
        out.begin = np.concatenate([[0], np.cumsum(n)])
        out.piece = piece[np.repeat(begin[first] - out.begin[:-1], n) + np.arange(out.begin[-1])]
        return out

    def pieces(self, types: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in types, piece) of the pieces of some types."""
        n = self.begin[types + 1] - self.begin[types]
        owner = np.repeat(np.arange(len(types)), n)
        offset = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n) if len(types) else np.zeros(0, np.int64)
        return owner, self.piece[self.begin[types][owner] + offset]


def windows(rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first token and length of every window; a row without words has none."""
    counts = np.bincount(rows, minlength=n_rows)
    k = np.where(counts > 0, np.maximum(1, -(-(counts - (WINDOW - STRIDE)) // STRIDE)), 0)
    row = np.repeat(np.arange(n_rows), k)
    number = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
    first = (np.cumsum(counts) - counts)[row] + number * STRIDE
    return row, first, np.minimum(WINDOW, counts[row] - number * STRIDE)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    def __init__(self, seed: int = 0, bias: float = 0.0):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {"word": np.zeros((WORD_ROWS, D), np.float32), "piece": np.zeros((PIECE_ROWS, D), np.float32), "att": draw(2 * H, scale=0.3), "out": draw(2 * H, scale=0.5), "bias": np.array([bias], np.float32)}
        for way in ("f", "b"):
            self.p |= {f"x{way}": draw(2 * D, 3 * H, scale=0.4), f"u{way}": draw(H, 3 * H, scale=0.3), f"c{way}": np.zeros(3 * H, np.float32)}

    def inputs(self, t: Types, types: np.ndarray, shown: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        owner, piece = t.pieces(types)
        e = self.p["piece"][piece]
        sums = np.stack([np.bincount(owner, e[:, d], len(types)) for d in range(D)], 1) if len(types) else np.zeros((0, D))
        words = self.p["word"][t.word[types]]
        return np.concatenate([words if shown is None else words * shown, sums.astype(np.float32)], 1), owner, piece

    def run(self, gates: dict[str, np.ndarray], tok: np.ndarray, length: np.ndarray, keep: bool = False):
        """States (time, window, 2H) of windows of tokens (time, window); with keep also what backward() needs."""
        T, n = tok.shape
        states, kept = np.zeros((T, n, 2 * H), np.float32), {}
        full = int(length.min(initial=T))
        for way, order, at in (("f", range(T), slice(0, H)), ("b", range(T - 1, -1, -1), slice(H, 2 * H))):
            u, pre, h = self.p[f"u{way}"], gates[way], np.zeros((n, H), np.float32)
            uzr, ug = np.ascontiguousarray(u[:, : 2 * H]), np.ascontiguousarray(u[:, 2 * H :])
            steps = []
            for t in order:
                a = pre[tok[t]]
                zr = _sigmoid(a[:, : 2 * H] + h @ uzr)
                z, r = zr[:, :H], zr[:, H:]
                g = np.tanh(a[:, 2 * H :] + (r * h) @ ug)
                new = h + z * (g - h)
                if t >= full:
                    new = np.where((t < length)[:, None], new, h)
                if keep:
                    steps.append((t, h, z, r, g))
                h = new
                states[t, :, at] = h
            kept[way] = steps
        return states, kept

    def pool(self, states: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Attention shares, pooled states and logits of each window."""
        s = states @ self.p["att"]
        s = np.where(np.arange(len(states))[:, None] < length, s, np.float32(-1e9))
        a = np.exp(s - s.max(0))
        a /= a.sum(0)
        c = np.einsum("tn,tnh->nh", a, states)
        return a, c, c @ self.p["out"] + self.p["bias"][0]

    def gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {way: x @ self.p[f"x{way}"] + self.p[f"c{way}"] for way in ("f", "b")}

    def logits(self, t: Types, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The logit of each window."""
        out = np.zeros(len(first), np.float32)
        types, inverse = np.arange(len(t.word)), t.tokens
        gates = self.gates(self.inputs(t, types)[0])
        order = np.argsort(-length, kind="stable")
        for i in range(0, len(order), CHUNK):
            w = order[i : i + CHUNK]
            at = first[w] + np.minimum(np.arange(int(length[w].max()))[:, None], length[w] - 1)
            out[w] = self.pool(self.run(gates, inverse[at], length[w])[0], length[w])[2]
        return out

    def learn(self, t: Types, first: np.ndarray, length: np.ndarray, y: np.ndarray, weight: np.ndarray, adam: Adam, rng: np.random.Generator) -> None:
        """One step on windows with labels y."""
        T = int(length.max())
        at = first + np.minimum(np.arange(T)[:, None], length - 1)
        types, tok = np.unique(t.tokens[at], return_inverse=True)
        tok = tok.reshape(at.shape)
        shown = (rng.random((len(types), 1)) < 0.5).astype(np.float32)
        x, owner, piece = self.inputs(t, types, shown)
        states, kept = self.run(self.gates(x), tok, length, keep=True)
        a, c, logit = self.pool(states, length)
        d = ((_sigmoid(logit) - y) * weight / len(y)).astype(np.float32)
        grad = {"out": c.T @ d, "bias": np.array([d.sum()], np.float32)}
        dc = d[:, None] * self.p["out"]
        da = np.einsum("tnh,nh->tn", states, dc)
        ds = a * (da - (a * da).sum(0))
        grad["att"] = np.einsum("tn,tnh->h", ds, states)
        dstates = a[:, :, None] * dc + ds[:, :, None] * self.p["att"]
        dx = np.zeros_like(x)
        for way, part in (("f", slice(0, H)), ("b", slice(H, 2 * H))):
            u, dh = self.p[f"u{way}"], np.zeros((len(y), H), np.float32)
            du, dpre = np.zeros_like(u), np.zeros((len(types), 3 * H), np.float32)
            for step, h, z, r, g in reversed(kept[way]):
                dh = dh + dstates[step, :, part]
                m = (step < length)[:, None]
                live = np.where(m, dh, 0)
                dg = live * z * (1 - g * g)
                drh = dg @ u[:, 2 * H :].T
                dz, dr = live * (g - h) * z * (1 - z), drh * h * r * (1 - r)
                dzr = np.concatenate([dz, dr], 1)
                du[:, 2 * H :] += (r * h).T @ dg
                du[:, : 2 * H] += h.T @ dzr
                np.add.at(dpre, tok[step], np.concatenate([dzr, dg], 1))
                dh = np.where(m, live * (1 - z) + drh * r + dzr @ u[:, : 2 * H].T, dh)
            grad[f"u{way}"], grad[f"c{way}"], grad[f"x{way}"] = du, dpre.sum(0), x.T @ dpre
            dx += dpre @ self.p[f"x{way}"].T
        adam.step(self.p, grad, {"word": _by_row(t.word[types], dx[:, :D] * shown), "piece": _by_row(piece, dx[owner, D:])})


def _by_row(at: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a table and the sum of what goes to each."""
    rows, place = np.unique(at, return_inverse=True)
    return rows, np.stack([np.bincount(place, d[:, k], len(rows)) for k in range(d.shape[1])], 1)


class Adam:
    def __init__(self, rate: float = RATE, slow: float = SLOW):
        self.rate, self.slow, self.n, self.m, self.v = rate, slow, 0, {}, {}

    def step(self, p: dict[str, np.ndarray], grad: dict[str, np.ndarray], tables: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        """grad: of whole parameters; tables: of some rows of the embeddings, which move at the slow rate."""
        self.n += 1
        whole = {k: (slice(None), g, self.rate) for k, g in grad.items()}
        for k, (at, g, rate) in (whole | {k: (rows, g, self.slow) for k, (rows, g) in tables.items()}).items():
            if k not in self.m:
                self.m[k], self.v[k] = np.zeros(p[k].shape, np.float32), np.zeros(p[k].shape, np.float32)
            g = np.asarray(g, np.float32)
            m, v = 0.9 * self.m[k][at] + 0.1 * g, 0.99 * self.v[k][at] + 0.01 * g * g
            self.m[k][at], self.v[k][at] = m, v
            p[k][at] -= rate * (m / (1 - 0.9**self.n)) / (np.sqrt(v / (1 - 0.99**self.n)) + 1e-6)


def _evidence(n: np.ndarray, k: np.ndarray, share: float) -> np.ndarray:
    """Of things that n texts have, k of them with label 1: the log-odds of label 1 above those of all texts, as far as the
    counts vouch for it: by the lower end of Wilson's interval, and never below 0, so what few texts have says little or
    nothing."""
    n, z2 = np.maximum(1, n).astype(float), SURE * SURE
    low = (k + z2 / 2 - SURE * np.sqrt(k * (n - k) / n + z2 / 4)) / (n + z2)
    low = np.clip(low, 1e-6, 1 - 1e-6)
    return np.maximum(0.0, np.log(low / (1 - low)) - np.log(share / (1 - share)))


def evidence(t: Types, y: np.ndarray, docs: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Evidence of each distinct word, and of each piece, of labelled texts; texts are counted some at a time."""
    n = [np.zeros(len(t.word)), np.zeros(PIECE_ROWS)]
    k = [np.zeros(len(t.word)), np.zeros(PIECE_ROWS)]
    edge = np.searchsorted(t.rows, np.arange(0, len(y) + docs, docs))
    for lo, hi in zip(edge[:-1], edge[1:], strict=True):
        pair = np.unique(t.rows[lo:hi].astype(np.int64) * len(t.word) + t.tokens[lo:hi])
        row, word = pair // max(1, len(t.word)), pair % max(1, len(t.word))
        at, piece = t.pieces(word)
        pair = np.unique(row[at] * PIECE_ROWS + piece)
        for i, (r, thing) in enumerate(((row, word), (pair // PIECE_ROWS, pair % PIECE_ROWS))):
            n[i] += np.bincount(thing, minlength=len(n[i]))
            k[i] += np.bincount(thing, y[r], len(n[i]))
    share = float(y.mean())
    return _evidence(n[0], k[0], share), _evidence(n[1], k[1], share)


def fit(texts: list[str], labels: list[int], seed: int = 0) -> Network:
    """A network fitted on texts with labels 0 and 1."""
    y = np.array(labels, np.float32)
    share = float(np.clip(y.mean() if len(y) else 0.0, 0.01, 0.99))
    net, adam, rng = Network(seed, float(np.log(share / (1 - share)))), Adam(), np.random.default_rng(seed)
    if not 0 < y.sum() < len(y):
        return net
    t = Types.of(texts)
    row, first, length = windows(t.rows, len(texts))
    begin = np.searchsorted(row, np.arange(len(texts) + 1))
    full = np.flatnonzero(np.diff(begin) > 0)
    if not len(full):
        return net
    words, pieces = evidence(t, y)
    np.maximum.at(net.p["word"][:, 0], t.word, words.astype(np.float32))
    net.p["piece"][:, 0] = pieces
    owner, piece = t.pieces(np.arange(len(t.word)))
    sign = (words + np.bincount(owner, pieces[piece], len(t.word)))[t.tokens]
    sign = np.array([sign[f : f + n].max() for f, n in zip(first.tolist(), length.tolist(), strict=True)])
    order = np.zeros(0, np.int64)
    for step in range(STEPS):
        if len(order) < min(BATCH, len(full)):
            order = np.concatenate([order, rng.permutation(full)])
        docs, order = order[:BATCH], order[BATCH:]
        w = np.concatenate([np.arange(begin[d], begin[d + 1]) for d in docs])
        value = sign[w] if step < STEPS // 3 else _highest(net, t, first[w], length[w])
        ends = np.cumsum(np.diff(begin)[docs])
        best = np.array([w[j:k][np.argmax(value[j:k])] for j, k in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)])
        net.learn(t, first[best], length[best], y[docs], np.where(y[docs] > 0, 1.5, 1.0).astype(np.float32), adam, rng)
    return net


def _highest(net: Network, t: Types, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Logits of some windows, by the words that they have."""
    types, inverse = np.unique(np.concatenate([t.tokens[f : f + n] for f, n in zip(first.tolist(), length.tolist(), strict=True)]), return_inverse=True)
    gates, out = net.gates(net.inputs(t, types)[0]), np.zeros(len(first), np.float32)
    start = np.cumsum(length) - length
    for i in range(0, len(first), CHUNK):
        s = slice(i, i + CHUNK)
        at = start[s] + np.minimum(np.arange(int(length[s].max()))[:, None], length[s] - 1)
        out[s] = net.pool(net.run(gates, inverse[at], length[s])[0], length[s])[2]
    return out


def _score(net):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = net.value
        for b in batches:
            for lo, hi, body, at in kn.slices(b.column("text")):
                t = Types(body, at)
                row, first, length = windows(t.rows, hi - lo)
                best = np.full(hi - lo, -np.inf)
                np.maximum.at(best, row, model.logits(t, first, length))
                best = np.where(np.isfinite(best), best, float(model.p["bias"][0]))
                score = _sigmoid(np.clip(best.astype(np.float64), -40, 40))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo), b.column("held_out").slice(lo, hi - lo), pa.array(score), pa.array(np.bincount(row, minlength=hi - lo))], ["doc_id", "held_out", "score", "n_windows"]
                )

    return run


def sample(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0) -> tuple[list[str], list[int]]:
    """Texts and labels of the bounded sample: rows outside the held-out fold, first by hash of the id."""
    known = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.filter(~in_fold(F.col("doc_id"), modulus, remainder)).withColumn("h", F.xxhash64("doc_id"))
    picked = [known.filter(F.col("toxic") == v).orderBy("h", "doc_id").limit(n) for v, n in ((1, POSITIVES), (0, NEGATIVES))]
    ids = F.broadcast(picked[0].unionByName(picked[1]))  # POSITIVES + NEGATIVES rows at most
    rows = docs.select("doc_id", "text").join(ids, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).orderBy("doc_id")
    found = rows.collect()
    return [r.text or "" for r in found], [r.toxic for r in found]


def score(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted and n_windows of every row."""
    net = docs.sparkSession.sparkContext.broadcast(fit(*sample(docs, labels, modulus, remainder)))
    rows = docs.select("doc_id", in_fold(F.col("doc_id"), modulus, remainder).alias("held_out"), "text")
    found = rows.mapInArrow(_score(net), "doc_id long, held_out boolean, score double, n_windows long")
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
