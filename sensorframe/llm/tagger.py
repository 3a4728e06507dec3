"""A character tagger: bidirectional LSTM under a linear-chain CRF, trained and run in numpy.

Characters enter as one of a few classes. Both directions run as one batched recurrence. Tags are O and, per kind,
B (first character) and I (further characters).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)
N_CLASSES, HIDDEN, WINDOW = 17, 20, 96


def char_classes(text: str) -> np.ndarray:
    """Class of each code point; 0 is left for padding."""
    table = np.full(129, 15, np.int8)
    table[48:58], table[97:123], table[65:91] = 1, 2, 3
    for c, k in zip("@.-+() ", range(4, 11)):
        table[ord(c)] = k
    table[9:14] = 11
    table[[ord(c) for c in "_%"]] = 12
    table[[ord(c) for c in "=\"':/;"]] = 13
    table[ord(",")] = 14
    table[128] = 16
    return table[np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), 128)]


@dataclass
class Tagger:
    """Weights: gate inputs per class and direction, recurrent weights, output layer, CRF scores."""

    gate: np.ndarray  # 2, classes, 4 * hidden
    recur: np.ndarray  # 2, hidden, 4 * hidden
    out: np.ndarray  # 2 * hidden + 1, tags
    move: np.ndarray  # tags, tags
    first: np.ndarray  # tags

    def parts(self) -> list[np.ndarray]:
        return [self.gate, self.recur, self.out, self.move, self.first]


def _forbidden() -> np.ndarray:
    """Moves that no tag sequence makes: I of a kind follows only B or I of that kind."""
    bad = np.zeros((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        bad[:, 2 + 2 * k] = True
        bad[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = False
    return bad


FORBIDDEN = _forbidden()


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _run(model: Tagger, x: np.ndarray, keep: bool = False):
    """Tag scores (batch, time, tags) of class sequences; with ``keep`` also what the gradient needs."""
    n, t_max = x.shape
    both = np.stack([x, x[:, ::-1]])
    fed = np.stack([model.gate[d][both[d]] for d in (0, 1)])  # 2, n, t, 4h
    h = np.zeros((2, n, HIDDEN), np.float32)
    c = np.zeros_like(h)
    hs = np.empty((2, n, t_max, HIDDEN), np.float32)
    saved = []
    for t in range(t_max):
        g = fed[:, :, t] + h @ model.recur
        s = _sigmoid(g[..., : 3 * HIDDEN])
        i, f, o = s[..., :HIDDEN], s[..., HIDDEN : 2 * HIDDEN], s[..., 2 * HIDDEN :]
        u = np.tanh(g[..., 3 * HIDDEN :])
        before, h_before = c, h
        c = f * c + i * u
        tc = np.tanh(c)
        h = o * tc
        hs[:, :, t] = h
        if keep:
            saved.append((i, f, o, u, before, tc, h_before))
    joined = np.concatenate([hs[0], hs[1][:, ::-1], np.ones((n, t_max, 1), np.float32)], axis=2)
    return joined @ model.out, (joined, saved, both)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _gradients(model: Tagger, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean negative log-likelihood per character and its gradient."""
    scores, (joined, saved, both) = _run(model, x, keep=True)
    n, t_max, _ = scores.shape
    move = np.where(FORBIDDEN, -1e4, model.move)
    alpha = np.empty_like(scores)
    beta = np.zeros_like(scores)
    alpha[:, 0] = scores[:, 0] + model.first
    for t in range(1, t_max):
        alpha[:, t] = scores[:, t] + _log_sum(alpha[:, t - 1, :, None] + move, 1)
    for t in range(t_max - 2, -1, -1):
        beta[:, t] = _log_sum(move + (scores[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
    total = _log_sum(alpha[:, -1], 1)
    rows = np.arange(n)[:, None]
    gold = scores[rows, np.arange(t_max), y].sum(1) + model.first[y[:, 0]] + move[y[:, :-1], y[:, 1:]].sum(1)
    scale = 1.0 / (n * t_max)
    d_scores = np.exp(alpha + beta - total[:, None, None])
    pair = np.exp(alpha[:, :-1, :, None] + move + (scores[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None])
    d_move = pair.sum((0, 1))
    np.subtract.at(d_move, (y[:, :-1], y[:, 1:]), 1)
    d_first = d_scores[:, 0].sum(0) - np.bincount(y[:, 0], minlength=TAGS)
    d_scores[rows, np.arange(t_max), y] -= 1
    d_scores *= scale
    d_out = np.tensordot(joined, d_scores, ((0, 1), (0, 1)))
    d_joined = d_scores @ model.out.T
    d_h = np.stack([d_joined[..., :HIDDEN], d_joined[:, ::-1, HIDDEN : 2 * HIDDEN]])
    d_gate, d_recur = np.zeros_like(model.gate), np.zeros_like(model.recur)
    dh, dc = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
    d_fed = np.empty((2, n, t_max, 4 * HIDDEN), np.float32)
    for t in range(t_max - 1, -1, -1):
        i, f, o, u, before, tc, h_before = saved[t]
        dh = dh + d_h[:, :, t]
        dc = dc + dh * o * (1 - tc * tc)
        d_g = np.concatenate([dc * u * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u * u)], axis=2)
        d_fed[:, :, t] = d_g
        d_recur += h_before.transpose(0, 2, 1) @ d_g
        dh = d_g @ model.recur.transpose(0, 2, 1)
        dc = dc * f
    for d in (0, 1):
        np.add.at(d_gate[d], both[d].reshape(-1), d_fed[d].reshape(-1, 4 * HIDDEN))
    return float((total - gold).sum() * scale), [d_gate, d_recur, d_out, np.where(FORBIDDEN, 0, d_move) * scale, d_first * scale]


def decode(model: Tagger, x: np.ndarray) -> np.ndarray:
    """Most likely tags (Viterbi) of class sequences."""
    scores, _ = _run(model, x)
    n, t_max, _ = scores.shape
    move = np.where(FORBIDDEN, -1e4, model.move).astype(np.float32)
    best, back = scores[:, 0] + model.first, np.empty((t_max, n, TAGS), np.int8)
    for t in range(1, t_max):
        step = best[:, :, None] + move
        back[t] = step.argmax(1)
        best = scores[:, t] + step.max(1)
    tags = np.empty((n, t_max), np.int8)
    tags[:, -1] = best.argmax(1)
    for t in range(t_max - 1, 0, -1):
        tags[:, t - 1] = back[t][np.arange(n), tags[:, t]]
    return tags


def labelled_text(rng: np.random.Generator, length: int) -> tuple[str, np.ndarray]:
    """A made-up text of ``length`` characters and its tags: words, entities alone or side by side, and look-alikes."""
    letters = "abcdefghijklmnopqrstuvwxyz"

    def digits(n):
        return "".join(map(str, rng.integers(0, 10, n)))

    def word():
        w = "".join(letters[k] for k in rng.integers(0, 26, rng.integers(1, 10)))
        if rng.random() < 0.12:
            w = "".join(c if rng.random() < 0.7 else "éüñçß"[rng.integers(5)] for c in w)
        style = rng.random()
        w = w.capitalize() if style < 0.12 else w.upper() if style < 0.17 else w
        tail = rng.random()
        return w + ("." if tail < 0.08 else "," if tail < 0.13 else ("!!", "%%%", "###", "&&&", " |", "$$$", "***")[rng.integers(7)] if tail < 0.2 else "")

    def entity(kind):
        if kind == 0:
            local = "".join(letters[k] for k in rng.integers(0, 26, rng.integers(2, 10)))
            local += rng.choice([".", "_", "-", "+", ""]) + (digits(rng.integers(1, 4)) if rng.random() < 0.7 else "x")
            host = "".join(letters[k] for k in rng.integers(0, 26, rng.integers(2, 8))) + (digits(1) if rng.random() < 0.5 else "")
            return f"{local}@{host}" + (".example" if rng.random() < 0.6 else "") + "." + str(rng.choice(["com", "org", "net", "de", "io"]))
        if kind == 1:
            return ".".join(str(k) for k in rng.integers(0, 256, 4))
        if kind == 2:
            form = rng.random()
            four = [digits(4) for _ in range(4)]
            return "".join(four) if form < 0.75 else (" " if form < 0.88 else "-").join(four)
        form = rng.random()
        if form < 0.7:
            return f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}"
        if form < 0.8:
            return f"+{digits(2)} {digits(2)} {digits(4)} {digits(4)}"
        return f"+{digits(1)}-{digits(3)}-{digits(3)}-{digits(4)}" if form < 0.9 else f"+{digits(rng.integers(10, 13))}"

    def other():
        form = rng.integers(8)
        if form == 0:
            return 'token = "' + "".join("0123456789abcdef"[k] for k in rng.integers(0, 16, 40)) + '"'
        if form == 1:
            return "password=" + "".join("0123456789abcdef"[k] for k in rng.integers(0, 16, 18))
        if form == 2:
            return "AKIA" + "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"[k] for k in rng.integers(0, 32, 16))
        if form == 3:
            return f"{rng.integers(1, 13)}.{rng.integers(0, 20)}" + ("." if rng.random() < 0.5 else "")
        if form == 4:
            return f"{rng.integers(1900, 2030)}-{digits(2)}-{digits(2)}"
        if form == 5:
            return f"{digits(2)}:{digits(2)}:{digits(2)}"
        return digits(rng.integers(1, 8)) + ("." if form == 6 else "")

    text, tags = [], []

    def put(s, kind=None):
        text.append(s)
        tags.extend([0] * len(s) if kind is None else [1 + 2 * kind] + [2 + 2 * kind] * (len(s) - 1))

    while len(tags) < length + 60:
        draw = rng.random()
        if draw < 0.30:
            for k in range(rng.choice([1, 2, 3], p=[0.5, 0.35, 0.15])):
                if k:
                    put(" ")
                kind = int(rng.integers(0, 4))
                put(entity(kind), kind)
            put(str(rng.choice([" ", ". ", ", ", "\n", "!! ", "### "], p=[0.6, 0.12, 0.1, 0.08, 0.05, 0.05])))
        elif draw < 0.42:
            put(other())
            put(" " if rng.random() < 0.9 else "\n")
        else:
            put(word())
            put(" " if rng.random() < 0.93 else "\n")
    cut = int(rng.integers(0, len(tags) - length + 1))
    return "".join(text)[cut : cut + length], np.array(tags[cut : cut + length])


@lru_cache(maxsize=4)
def trained_tagger(seed: int = 5, steps: int = 320, batch: int = 48, rate: float = 0.02) -> Tagger:
    """A tagger fitted on ``steps * batch`` labelled windows made by rule; equal arguments give equal weights."""
    rng = np.random.default_rng(seed)
    model = Tagger(
        *(
            (rng.normal(0, s, shape)).astype(np.float32)
            for s, shape in ((0.3, (2, N_CLASSES, 4 * HIDDEN)), (0.2, (2, HIDDEN, 4 * HIDDEN)), (0.2, (2 * HIDDEN + 1, TAGS)), (0.1, (TAGS, TAGS)), (0.1, (TAGS,)))
        )
    )
    model.gate[:, :, HIDDEN : 2 * HIDDEN] += 1.0
    means, squares = [np.zeros_like(p) for p in model.parts()], [np.zeros_like(p) for p in model.parts()]
    for t in range(1, steps + 1):
        made = [labelled_text(rng, WINDOW) for _ in range(batch)]
        x, y = np.stack([char_classes(s) for s, _ in made]), np.stack([g for _, g in made])
        _, grads = _gradients(model, x, y)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        now = rate * min(1.0, 2.0 * (1 - t / (steps + 1)))
        for p, g, m, s in zip(model.parts(), grads, means, squares):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p -= (now * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
    return model
