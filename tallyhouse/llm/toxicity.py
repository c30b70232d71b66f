"""Toxicity of whole texts: a bidirectional gated recurrent network with attention pooling.

A word enters the network as a vector of its own (words seen in training) beside the mean of
the vectors of its character runs of length 3 to 5, so that unseen words of a known build
count as well; both carry their smoothed log odds from the training rows. Texts are read in
overlapping windows, the whole text is covered, and a text's score is that of its highest
window. The network is written and trained in numpy on a bounded sample of labelled rows and
sent to the tasks; its size does not grow with the corpus.

Null and empty texts have no word: they get the score of an empty window. Every row is scored
by itself, repeated rows alike. A label may be null: such a row teaches nothing. Without both
kinds of labels every text scores 0.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.llm.common import append_array, give_back, row_slices, text_slices, with_field

# Bounds of the training sample: rows of each label, and characters of one row. Rows with
# longer texts are not drawn.
SAMPLE_ROWS = 2_000
SAMPLE_CHARS = 20_000
# Words in a window, and words from one window's start to the next one's.
WINDOW, STRIDE = 32, 26
RUNS = (3, 4, 5)
WORD_DIMS = RUN_DIMS = 8
HIDDEN, ATTENTION = 8, 8
# Passes over the sample: so many at least, and on small samples as many as make up the steps.
EPOCHS, MOST_EPOCHS, STEPS = 6, 15, 280
# A word or run needs so many training rows to get a vector.
WORD_ROWS, RUN_ROWS = 3, 5
BLOCK_CHARS = 1_000_000
# Windows scored at a time, so that a step's arrays stay in the cache.
CHUNK = 2_048
SLOTS = 20

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    if kind not in _powers or len(_powers[kind]) < n:
        out = np.full(n, base, dtype=np.uint64)
        out[0] = 1
        _powers[kind] = np.cumprod(out, dtype=np.uint64)
    return _powers[kind][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def _letters() -> np.ndarray:
    if "letters" not in _powers:
        _powers["letters"] = np.array([chr(i).isalnum() for i in range(1 << 16)])
    return _powers["letters"]


class Block:
    """Words of some texts: for each text the range of its words, for each word its place
    among the distinct ones, for each distinct word a hash and the hashes of its runs."""

    def __init__(self, texts: list[str]) -> None:
        low = [t.lower() for t in texts]
        codes = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        n = len(codes)
        word = _letters()[np.minimum(codes, 0xFFFF)] | (codes > 0xFFFF)
        edge = np.flatnonzero(np.diff(word.astype(np.int8), prepend=0, append=0))
        start, end = edge[::2], edge[1::2]
        up, down = _power("up", _P, n + 8), _power("down", _P_INV, n + 8)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        raw = _mixed((total[end] - total[start]) * down[start])
        self.words, first, self.at = np.unique(raw, return_index=True, return_inverse=True)
        ends = np.cumsum([len(t) + 1 for t in low])
        self.bounds = np.searchsorted(start, np.concatenate([[0], ends]))
        # Runs of the distinct words, word after word and length after length.
        s, size = start[first], (end - start)[first]
        hashes, owners = [], []
        for k in RUNS:
            count = np.maximum(size - k + 1, 0)
            own = np.repeat(np.arange(len(s)), count)
            place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(s, count)
            hashes.append(_mixed((total[place + k] - total[place]) * down[place] + np.uint64(k)))
            owners.append(own)
        self.runs, self.run_word = np.concatenate(hashes), np.concatenate(owners)


def joined(texts: list[str], limit: int) -> Block:
    """A block of many texts, read a slice at a time, so that only words are held for all of them."""
    parts = [Block(texts[a:b]) for a, b in row_slices([len(t) for t in texts], limit)] or [Block([])]
    out = Block.__new__(Block)
    offset = np.cumsum([0, *[len(p.words) for p in parts]])
    out.words, first, place = np.unique(np.concatenate([p.words for p in parts]), return_index=True, return_inverse=True)
    new = np.zeros(offset[-1], dtype=bool)
    new[first] = True
    out.at = np.concatenate([place[o + p.at] for o, p in zip(offset, parts, strict=False)])
    ends = np.concatenate([np.diff(p.bounds) for p in parts])
    out.bounds = np.concatenate([[0], np.cumsum(ends)])
    # Runs of a word come from the slice that has it first.
    keep = [new[o + p.run_word] for o, p in zip(offset, parts, strict=False)]
    out.runs = np.concatenate([p.runs[k] for p, k in zip(parts, keep, strict=True)])
    out.run_word = np.concatenate([place[o + p.run_word[k]] for o, p, k in zip(offset, parts, keep, strict=False)])
    return out


class Lookup:
    """Places of known hashes, by slot; of hashes that share a slot the first one stays."""

    def __init__(self, hashes: np.ndarray) -> None:
        slot = hashes >> np.uint64(64 - SLOTS)
        _, first = np.unique(slot, return_index=True)
        self.known = np.sort(first)
        self.hashes = hashes[self.known]
        self.table = np.zeros(1 << SLOTS, dtype=np.int32)
        self.table[self.hashes >> np.uint64(64 - SLOTS)] = np.arange(len(self.hashes))

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 if unknown."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, dtype=np.int32)
        at = self.table[hashes >> np.uint64(64 - SLOTS)]
        return np.where(self.hashes[at] == hashes, at, -1)


def _log_odds(owner: np.ndarray, row: np.ndarray, labels: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(log odds shrunk towards 0, rows) of each feature, from its distinct (feature, row) pairs."""
    pairs = np.unique(owner.astype(np.int64) * len(labels) + row)
    feature, label = pairs // len(labels), labels[pairs % len(labels)]
    bad = np.bincount(feature, weights=label, minlength=size)
    rows = np.bincount(feature, minlength=size)
    return _odds(bad, rows, labels), rows


def _odds(bad: np.ndarray, rows: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Log odds from the rows of label 1 and all rows that hold a feature, less for few rows."""
    odds = np.log((bad + 0.5) / (labels.sum() + 1)) - np.log((rows - bad + 0.5) / (len(labels) - labels.sum() + 1))
    return np.clip(odds * rows / (rows + 5) / 2, -2, 2).astype(np.float32)


def _sums(owner: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sum of the rows of each owner."""
    return np.stack([np.bincount(owner, rows[:, k], minlength=size) for k in range(rows.shape[1])], axis=1)


def _windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, end of the text's words) of every window; a text without words has one."""
    n = np.diff(bounds)
    count = np.maximum(1, -(-(n - (WINDOW - STRIDE)) // STRIDE))
    text = np.repeat(np.arange(len(n)), count)
    step = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return text, bounds[:-1][text] + step * STRIDE, bounds[1:][text]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Weights, forward and backward pass. ``x`` has the input of every distinct word, and a
    last row of zeros for places beyond a text's end."""

    def __init__(self, dims: int, seed: int) -> None:
        rng = np.random.default_rng(seed)

        def init(*shape):
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        h = HIDDEN
        self.w = {"att": init(2 * h, ATTENTION), "att_v": init(ATTENTION), "out": init(2 * h), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.w |= {f"{d}_in": init(dims, 3 * h), f"{d}_rec": init(h, 3 * h), f"{d}_bias": np.zeros(3 * h, np.float32)}

    def project(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {d: x @ self.w[f"{d}_in"] + self.w[f"{d}_bias"] for d in "fb"}

    def _run(self, d: str, proj: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        h, (n, steps) = HIDDEN, at.shape
        state = np.zeros((n, h), np.float32)
        out = np.empty((n, steps, h), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            x, r = proj[at[:, t]], state @ self.w[f"{d}_rec"]
            gates = _sigmoid(x[:, : 2 * h] + r[:, : 2 * h])
            z, reset = gates[:, :h], gates[:, h:]
            new = np.tanh(x[:, 2 * h :] + reset * r[:, 2 * h :])
            m = mask[:, t : t + 1]
            if keep is not None:
                keep.append((t, state, z, reset, new, r[:, 2 * h :]))
            state = state + m * (1 - z) * (new - state)
            out[:, t] = state
        return out

    def _scan(self, d: str, proj: np.ndarray, at: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """``_run`` without a log: gates apart and in place, which numpy does several times faster."""
        h, (n, steps) = HIDDEN, at.shape
        rec = self.w[f"{d}_rec"]
        parts = [(np.ascontiguousarray(proj[:, k * h : k * h + h]), np.ascontiguousarray(rec[:, k * h : k * h + h])) for k in range(3)]
        (zx, zr), (rx, rr), (nx, nr) = parts
        places, masks = np.ascontiguousarray(at.T), np.ascontiguousarray(mask.T)
        state = np.zeros((n, h), np.float32)
        out = np.empty((steps, n, h), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            idx = places[t]
            z, reset = zx.take(idx, axis=0), rx.take(idx, axis=0)
            z += state @ zr
            reset += state @ rr
            for gate in (z, reset):
                np.negative(gate, out=gate)
                np.exp(gate, out=gate)
                gate += 1
                np.reciprocal(gate, out=gate)
            reset *= state @ nr
            reset += nx.take(idx, axis=0)
            np.tanh(reset, out=reset)
            np.subtract(1, z, out=z)
            z *= masks[t][:, None]
            reset -= state
            reset *= z
            state = np.add(state, reset, out=out[t])
        return out

    def logits(self, proj: dict, at: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """``forward`` for scoring."""
        hidden = np.concatenate([self._scan(d, proj[d], at, mask) for d in "fb"], axis=2)
        e = np.exp(np.tanh(hidden @ self.w["att"]) @ self.w["att_v"]) * mask.T
        share = e / np.maximum(e.sum(axis=0), 1e-9)
        return np.einsum("tn,tn->n", share, hidden @ self.w["out"]) + self.w["bias"][0]

    def forward(self, proj: dict, at: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logit of each window."""
        logs = {d: [] if keep is not None else None for d in "fb"}
        hidden = np.concatenate([self._run(d, proj[d], at, mask, logs[d]) for d in "fb"], axis=2)
        deep = np.tanh(hidden @ self.w["att"])
        e = np.exp(deep @ self.w["att_v"]) * mask
        share = e / np.maximum(e.sum(axis=1, keepdims=True), 1e-9)
        pooled = (share[:, None, :] @ hidden)[:, 0]
        if keep is not None:
            keep.update(logs=logs, hidden=hidden, deep=deep, share=share, pooled=pooled)
        return pooled @ self.w["out"] + self.w["bias"][0]

    def backward(self, x: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: dict, dlogit: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the weights, and of the input at every place."""
        w, h = self.w, HIDDEN
        g = {"out": keep["pooled"].T @ dlogit, "bias": np.array([dlogit.sum()], np.float32)}
        dpool = dlogit[:, None] * w["out"]
        dshare = (keep["hidden"] @ dpool[:, :, None])[:, :, 0]
        share = keep["share"]
        dscore = share * (dshare - (share * dshare).sum(axis=1, keepdims=True))
        g["att_v"] = np.einsum("nt,nta->a", dscore, keep["deep"])
        ddeep = dscore[:, :, None] * w["att_v"] * (1 - keep["deep"] ** 2)
        flat = keep["hidden"].reshape(-1, 2 * h)
        g["att"] = flat.T @ ddeep.reshape(-1, ATTENTION)
        dhidden = share[:, :, None] * dpool[:, None, :] + ddeep @ w["att"].T
        dx = np.zeros((*at.shape, x.shape[1]), np.float32)
        for d, part in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            dproj_all = np.zeros((*at.shape, 3 * h), np.float32)
            grec = np.zeros_like(w[f"{d}_rec"])
            back = np.zeros((len(at), h), np.float32)
            for t, state, z, reset, new, rn in reversed(keep["logs"][d]):
                m = mask[:, t : t + 1]
                dh = back + dhidden[:, t, part]
                dnew = dh * m * (1 - z) * (1 - new**2)
                dz = -dh * m * (new - state) * z * (1 - z)
                dreset = dnew * rn * reset * (1 - reset)
                dproj_all[:, t] = np.concatenate([dz, dreset, dnew], axis=1)
                drec = np.concatenate([dz, dreset, dnew * reset], axis=1)
                grec += state.T @ drec
                back = dh * (1 - m * (1 - z)) + drec @ w[f"{d}_rec"].T
            flat = dproj_all.reshape(-1, 3 * h)
            g[f"{d}_rec"], g[f"{d}_bias"] = grec, flat.sum(axis=0)
            g[f"{d}_in"] = x[at].reshape(-1, x.shape[1]).T @ flat
            dx += (flat @ w[f"{d}_in"].T).reshape(dx.shape)
        return g, dx


class Model:
    """Vocabulary, input vectors, network and calibration."""

    words: Lookup
    runs: Lookup

    def inputs(self, block: Block) -> np.ndarray:
        """Input of every distinct word of a block, and a row of zeros."""
        at = self.words(block.words)
        run = self.runs(block.runs)
        seen = run >= 0
        owner, run, n = block.run_word[seen], run[seen], len(block.words)
        count = np.maximum(np.bincount(owner, minlength=n), 1)[:, None]
        own = self.word_vectors.take(at, axis=0, mode="wrap") * (at >= 0)[:, None] if len(self.word_vectors) else np.zeros((n, 1 + WORD_DIMS))
        mean = _sums(owner, self.run_vectors.take(run, axis=0), n)
        x = np.zeros((n + 1, own.shape[1] + mean.shape[1]), np.float32)
        x[:n, : own.shape[1]], x[:n, own.shape[1] :] = own, mean / count
        return x

    def logits(self, texts: list[str]) -> np.ndarray:
        """Highest window of each text."""
        block = Block(texts)
        proj = self.net.project(self.inputs(block))
        text, first, end = _windows(block.bounds)
        best = np.full(len(texts), -np.inf)
        for a in range(0, len(text), CHUNK):
            place = first[a : a + CHUNK, None] + np.arange(WINDOW)
            mask = place < end[a : a + CHUNK, None]
            at = np.where(mask, block.at[np.minimum(place, len(block.at) - 1)] if len(block.at) else 0, len(block.words))
            np.maximum.at(best, text[a : a + CHUNK], self.net.logits(proj, at, mask.astype(np.float32)))
        return best

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.net is None:
            return np.zeros(len(texts))
        return _sigmoid(self.scale * (self.logits(texts) - self.shift))


def train(texts: list[str], labels: list[int], seed: int = 11) -> Model:
    """Fit on a bounded sample. Each epoch looks for every text's highest window and learns from
    that one (and a random one of the texts without the label)."""
    model, y = Model(), np.array(labels, dtype=np.int64)
    model.net = None
    if not len(y) or y.min() == y.max():
        return model
    rng = np.random.default_rng(seed)
    block = joined(texts, BLOCK_CHARS)
    row_of = np.repeat(np.arange(len(texts)), np.diff(block.bounds))
    odds, rows = _log_odds(block.at, row_of, y, len(block.words))
    chosen = np.flatnonzero(rows >= WORD_ROWS)
    chosen = chosen[np.argsort(-np.abs(odds[chosen]), kind="stable")]
    model.words = Lookup(block.words[chosen])
    model.word_vectors = _vectors(odds[chosen][model.words.known], WORD_DIMS, rng)
    # Runs count once per row in which a word holds them; rows are worked on a few at a time.
    order = np.argsort(block.run_word, kind="stable")
    run_hash, run_at = np.unique(block.runs, return_inverse=True)
    run_count = np.bincount(block.run_word, minlength=len(block.words))
    run_start = np.cumsum(run_count) - run_count
    bad, rows = np.zeros(len(run_hash)), np.zeros(len(run_hash))
    for i in range(len(texts)):
        own = np.unique(block.at[block.bounds[i] : block.bounds[i + 1]])
        held = np.unique(run_at[order[_ranges(run_start[own], run_count[own])[1]]])
        rows[held] += 1
        bad[held] += y[i]
    odds = _odds(bad, rows, y)
    chosen = np.flatnonzero(rows >= RUN_ROWS)
    chosen = chosen[np.argsort(-np.abs(odds[chosen]), kind="stable")]
    model.runs = Lookup(run_hash[chosen])
    model.run_vectors = _vectors(odds[chosen][model.runs.known], RUN_DIMS, rng)

    net = Network(WORD_DIMS + RUN_DIMS + 2, seed)
    text, first, end = _windows(block.bounds)
    place = first[:, None] + np.arange(WINDOW)
    mask = (place < end[:, None]).astype(np.float32)
    at = np.where(mask > 0, block.at[np.minimum(place, len(block.at) - 1)], len(block.words)) if len(block.at) else np.zeros(place.shape, np.int64)
    word_at, run_seen = model.words(block.words), model.runs(block.runs)
    count = np.maximum(np.bincount(block.run_word[run_seen >= 0], minlength=len(block.words)), 1)
    by_word = np.argsort(block.run_word, kind="stable")
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.w.items()}
    sums = {"word": np.full(len(model.word_vectors), 0.1, np.float32), "run": np.full(len(model.run_vectors), 0.1, np.float32)}
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    step = 0
    epochs = min(MOST_EPOCHS, max(EPOCHS, STEPS * 128 // (2 * len(y))))
    for epoch in range(epochs):
        x = model.inputs(block)
        if epoch == 0:  # no model yet: the window of the highest log odds
            score = (x[at, 0] + x[at, WORD_DIMS + 1]).max(axis=1)
        else:
            proj = net.project(x)
            score = np.concatenate([net.logits(proj, at[a : a + CHUNK], mask[a : a + CHUNK]) for a in range(0, len(at), CHUNK)])
        order = np.lexsort((score, text))
        top = order[np.append(np.flatnonzero(np.diff(text[order])), len(order) - 1)]
        starts = np.searchsorted(text, np.arange(len(y)))
        ends = np.append(starts[1:], len(text))
        other = starts + (rng.random(len(y)) * (ends - starts)).astype(np.int64)
        picks = np.concatenate([top, other[y == 0]])
        rng.shuffle(picks)
        rate = 0.01 * 0.5 ** (2 * epoch / epochs)
        for a in range(0, len(picks), 128):
            some = picks[a : a + 128]
            step += 1
            used, local = np.unique(at[some], return_inverse=True)
            xs = model.inputs(block)[used] if len(block.words) < 2000 else _some_inputs(model, block, used, word_at, run_seen, by_word, run_start, run_count, count)
            local = local.reshape(at[some].shape)
            keep: dict = {}
            logit = net.forward(net.project(xs), local, mask[some], keep)
            label = y[text[some]]
            dlogit = ((_sigmoid(logit) - label) * weight[text[some]] / len(some)).astype(np.float32)
            grads, dx = net.backward(xs, local, mask[some], keep, dlogit)
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                net.w[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
            _learn_vectors(model, used, local, dx, word_at, run_seen, block, by_word, run_start, run_count, count, sums)
    model.net = net
    spans = row_slices([len(t) for t in texts], BLOCK_CHARS)
    logit = np.concatenate([model.logits(texts[a:b]) for a, b in spans])
    model.shift, model.scale = _cut(logit, y, weight)
    return model


def _vectors(odds: np.ndarray, dims: int, rng) -> np.ndarray:
    """Log odds first, then small random numbers."""
    return np.concatenate([odds[:, None], 0.1 * rng.standard_normal((len(odds), dims)).astype(np.float32)], axis=1)


def _ranges(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place) of consecutive places from each start."""
    own = np.repeat(np.arange(len(start)), count)
    return own, np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)


def _used_runs(block, used, run_seen, by_word, run_start, run_count):
    own, place = _ranges(run_start[used], run_count[used])
    run = run_seen[by_word[place]]
    return own[run >= 0], run[run >= 0]


def _some_inputs(model, block, used, word_at, run_seen, by_word, run_start, run_count, count) -> np.ndarray:
    """``Model.inputs`` for some distinct words only."""
    real = used[used < len(block.words)]
    own_at = word_at[real]
    x = np.zeros((len(used), model.word_vectors.shape[1] + model.run_vectors.shape[1]), np.float32)
    w = model.word_vectors.shape[1]
    x[: len(real), :w] = np.where(own_at[:, None] >= 0, model.word_vectors[own_at], 0)
    own, run = _used_runs(block, real, run_seen, by_word, run_start, run_count)
    for k in range(model.run_vectors.shape[1]):
        x[: len(real), w + k] = np.bincount(own, model.run_vectors[run, k], minlength=len(real)) / count[real]
    return x


def _learn_vectors(model, used, local, dx, word_at, run_seen, block, by_word, run_start, run_count, count, sums) -> None:
    """One step with shrinking rates for the vectors that took part; log odds stay fixed."""
    flat, at = dx.reshape(-1, dx.shape[2]), local.ravel()
    g = np.stack([np.bincount(at, flat[:, k], minlength=len(used)) for k in range(flat.shape[1])], axis=1)
    real = used[used < len(block.words)]
    g, w = g[: len(real)], model.word_vectors.shape[1]
    own_at = word_at[real]
    known = own_at >= 0
    _step(model.word_vectors, own_at[known], g[known, 1:w], sums["word"])
    own, run = _used_runs(block, real, run_seen, by_word, run_start, run_count)
    uniq, inv = np.unique(run, return_inverse=True)
    part = (g[:, w + 1 :] / count[real][:, None])[own]
    if len(uniq):
        gr = np.stack([np.bincount(inv, part[:, k], minlength=len(uniq)) for k in range(part.shape[1])], axis=1)
        _step(model.run_vectors, uniq, gr, sums["run"])


def _step(vectors: np.ndarray, at: np.ndarray, g: np.ndarray, sums: np.ndarray) -> None:
    sums[at] += (g * g).mean(axis=1)
    vectors[at, 1:] -= (0.05 * g / np.sqrt(sums[at])[:, None]).astype(np.float32)


def _cut(logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Midpoint of the best cut on the training rows, and a slope of one unit."""
    order = np.argsort(logit, kind="stable")
    label = y[order]
    wrong = np.concatenate([[0], np.cumsum(label)]) + np.concatenate([[0], np.cumsum(1 - label[::-1])])[::-1]
    best = np.flatnonzero(wrong == wrong.min())
    # All cuts between the two sides are alike; take the middle of their span.
    low = logit[order[max(best[0] - 1, 0)]]
    high = logit[order[min(best[-1], len(y) - 1)]]
    return float((low + high) / 2), 1.0


def held_out(id_col: str) -> F.Column:
    """True for the rows that are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """At most ``rows`` labelled rows of each label with texts up to ``chars``, chosen by hash of the
    id; held-out rows are left out. Ids of contradicting labels count as labelled 1."""
    known = labels.filter(F.col("toxic").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    mark = F.xxhash64("doc_id", "text").alias("h")
    short = docs.filter(F.length("text").between(1, chars)).select("doc_id", mark)
    joined = short.join(known, "doc_id")
    drawn = [joined.filter(F.col("toxic") == label).orderBy("h", "doc_id").limit(rows) for label in (0, 1)]
    # Ids and hashes of at most 2 * rows rows; only their texts are fetched.
    ids = F.broadcast(drawn[0].unionByName(drawn[1]).distinct())
    return docs.select("doc_id", "text", mark).join(ids, ["doc_id", "h"]).select("text", "toxic", "h")


def fit(rows: DataFrame) -> Model:
    """Train on a bounded sample, in one task; the model comes back pickled."""

    def run(batches):
        drawn = sorted((h, t, y) for b in batches for h, t, y in zip(b["h"].to_pylist(), b["text"].to_pylist(), b["toxic"].to_pylist(), strict=True))
        model = train([t for _, t, _ in drawn], [int(y == 1) for _, _, y in drawn])
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(model)]})
        del drawn, model
        give_back()

    made = rows.select("h", "text", "toxic").repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(made.model) if made else train([], [])


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with the toxicity of ``text_col``, in map tasks."""
    docs = docs.drop(out_col) if out_col in docs.columns else docs
    schema = with_field(docs, out_col, T.DoubleType())
    keep = schema.names[:-1]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for a, b, texts in text_slices(batch.column(batch.schema.get_field_index(text_col)), BLOCK_CHARS):
                got = shared.value.scores(texts)
                yield append_array(batch.slice(a, b - a), keep, out_col, pa.array(got, pa.float64()))
        give_back()

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score and verdict of every document, by a network trained on the labelled ones."""
    model = fit(sample(docs, labels))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
