"""A character-level bidirectional LSTM with CRF transitions in numpy."""

from __future__ import annotations

import numpy as np

HIDDEN = 16
WINDOW = 96
STRIDE = 48
MARGIN = (WINDOW - STRIDE) // 2
#: Empty strides between texts, so that no window sees two, and windows of a region that are scored at once.
APART = 2
COLUMN = 64
#: Characters with a class of their own.
CHARS = "atdo@.+-_%()[] \n:;,/#=\"'|*$&!?<>"
DIGIT, LOW, UP, WIDE, OTHER = range(1 + len(CHARS), 6 + len(CHARS))
CLASSES = OTHER + 1


def _table() -> np.ndarray:
    out = np.full(128, OTHER, dtype=np.int64)
    for lo, hi, c in (("0", "9", DIGIT), ("a", "z", LOW), ("A", "Z", UP)):
        out[ord(lo) : ord(hi) + 1] = c
    for i, c in enumerate(CHARS):
        out[ord(c)] = 1 + i
    return out


TABLE = _table()


def classes_of(text: str) -> np.ndarray:
    """Class of each code point; 0 is kept for padding."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(points < 128, TABLE[np.minimum(points, 127)], WIDE)


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _lse(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Tagger:
    def __init__(self, tags: int, seed: int = 5):
        rng, h = np.random.default_rng(seed), HIDDEN
        draw = lambda *s: (rng.standard_normal(s) * 0.15).astype(np.float32)
        self.p = {"e0": draw(CLASSES, 4 * h), "e1": draw(CLASSES, 4 * h), "u0": draw(h, 4 * h), "u1": draw(h, 4 * h), "w": draw(2 * h, tags), "b": np.zeros(tags, np.float32), "a": draw(tags, tags)}

    def _lstm(self, x, k):
        """States of direction k over x (time, row), and what the backward pass needs."""
        e, u, h = self.p[f"e{k}"], self.p[f"u{k}"], HIDDEN
        steps, n = x.shape
        out, cells, gates = np.zeros((steps + 1, n, h), np.float32), np.zeros((steps + 1, n, h), np.float32), np.empty((steps, n, 4 * h), np.float32)
        for t in range(steps):
            z = e[x[t]] + out[t] @ u
            z[:, : 3 * h] = _sigmoid(z[:, : 3 * h])
            z[:, 3 * h :] = np.tanh(z[:, 3 * h :])
            cells[t + 1] = z[:, h : 2 * h] * cells[t] + z[:, :h] * z[:, 3 * h :]
            out[t + 1] = z[:, 2 * h : 3 * h] * np.tanh(cells[t + 1])
            gates[t] = z
        return out, cells, gates

    def _lstm_grad(self, x, state, d_out, grads, k):
        out, cells, gates = state
        u, h = self.p[f"u{k}"], HIDDEN
        dh, dc = np.zeros_like(out[0]), np.zeros_like(out[0])
        dz_all = np.empty_like(gates)
        for t in reversed(range(len(x))):
            z, tc = gates[t], np.tanh(cells[t + 1])
            i, f, o, g = z[:, :h], z[:, h : 2 * h], z[:, 2 * h : 3 * h], z[:, 3 * h :]
            dh = dh + d_out[t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.hstack([dc * g * i * (1 - i), dc * cells[t] * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)])
            dz_all[t] = dz
            dh, dc = dz @ u.T, dc * f
        flat = dz_all.reshape(-1, 4 * h)
        grads[f"u{k}"] = out[:-1].reshape(-1, h).T @ flat
        grads[f"e{k}"] = np.eye(CLASSES, dtype=np.float32)[x.reshape(-1)].T @ flat

    def _scores(self, x):
        """Emission scores (time, row, tag) of windows x (row, time)."""
        ahead, back = self._lstm(x.T, 0), self._lstm(x.T[::-1], 1)
        both = np.concatenate([ahead[0][1:], back[0][1:][::-1]], axis=2)
        return both @ self.p["w"] + self.p["b"], both, ahead, back

    def step(self, x, y) -> tuple[float, dict]:
        """Mean negative log-likelihood of tags y for windows x, and its gradients."""
        scores, both, ahead, back = self._scores(x)
        a, (steps, n, k) = self.p["a"], scores.shape
        alpha, beta = np.empty_like(scores), np.zeros_like(scores)
        alpha[0] = scores[0]
        for t in range(1, steps):
            alpha[t] = scores[t] + _lse(alpha[t - 1][:, :, None] + a, 1)
        for t in range(steps - 2, -1, -1):
            beta[t] = _lse(a[None] + (scores[t + 1] + beta[t + 1])[:, None, :], 2)
        whole = _lse(alpha[-1], 1)
        d_scores = np.exp(alpha + beta - whole[None, :, None])
        pairs = np.zeros((k, k), np.float32)
        for t in range(1, steps):
            pairs += np.exp(alpha[t - 1][:, :, None] + a + (scores[t] + beta[t])[:, None, :] - whole[:, None, None]).sum(axis=0)
        gold = y.T
        picked = np.take_along_axis(scores, gold[:, :, None], 2).sum() + a[gold[:-1], gold[1:]].sum()
        np.put_along_axis(d_scores, gold[:, :, None], np.take_along_axis(d_scores, gold[:, :, None], 2) - 1, 2)
        np.subtract.at(pairs, (gold[:-1].ravel(), gold[1:].ravel()), 1)
        d_scores = d_scores.astype(np.float32) / n
        grads = {"a": pairs / n, "b": d_scores.sum((0, 1)), "w": both.reshape(-1, both.shape[2]).T @ d_scores.reshape(-1, k)}
        d_both = d_scores @ self.p["w"].T
        self._lstm_grad(x.T, ahead, d_both[:, :, :HIDDEN], grads, 0)
        self._lstm_grad(x.T[::-1], back, d_both[::-1, :, HIDDEN:], grads, 1)
        return float((whole.sum() - picked) / n), grads

    def fit(self, x, y, steps: int, batch: int = 64, rate: float = 0.02, seed: int = 6) -> list[float]:
        """Adam over random batches; the loss after each step."""
        rng, losses = np.random.default_rng(seed), []
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(p) for k, p in self.p.items()}
        for t in range(1, steps + 1):
            rows = rng.integers(0, len(x), batch)
            loss, grads = self.step(x[rows], y[rows])
            losses.append(loss)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 20.0 / max(norm, 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] = (self.p[k] - rate * (1 - t / (steps + 1)) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
        return losses

    def emissions(self, x: np.ndarray, batch: int = 256) -> np.ndarray:
        """Emission scores of the middles of windows x (row, time), as (row, STRIDE, tag)."""
        parts = [self._scores(part)[0][MARGIN : MARGIN + STRIDE].transpose(1, 0, 2) for part in np.array_split(x, max(1, -(-len(x) // batch)))]
        return np.concatenate(parts)

    def decode(self, padded: np.ndarray, first: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
        """The best tag sequence of each region as a whole: ``count`` windows from ``first`` on, whose middles are laid
        end to end. All regions advance together, the longest first; emissions stand for ``COLUMN`` windows of each at
        a time, so a long region costs the memory of its back pointers alone, a byte for each tag and character."""
        order = np.argsort(-count, kind="stable")
        first, count = first[order], count[order]
        best, back = np.zeros((len(first), self.p["b"].size), np.float32), []
        for column in range(0, int(count.max(initial=0)), COLUMN):
            live = int(np.searchsorted(-count, -column, side="left"))
            width = np.minimum(count[:live] - column, COLUMN)
            base = np.concatenate([[0], np.cumsum(width)])[:-1]
            windows = np.repeat(first[:live] + column - base, width) + np.arange(int(width.sum()))
            scores = self.emissions(padded[windows[:, None] * STRIDE + np.arange(WINDOW)])
            for k in range(int(width.max(initial=0))):
                n = int(np.searchsorted(-width, -k, side="left"))
                for t in range(STRIDE):
                    if column or k or t:
                        step = best[:n, :, None] + self.p["a"]
                        back.append(step.argmax(axis=1).astype(np.int8))
                        best[:n] = step.max(axis=1)
                    best[:n] += scores[base[:n] + k, t]
        out = np.zeros((len(first),), dtype=object)
        tags = best.argmax(axis=1)
        lengths = count * STRIDE
        path = [np.zeros(n, np.int8) for n in lengths.tolist()]
        flat, at = np.concatenate(path) if path else np.zeros(0, np.int8), np.concatenate([[0], np.cumsum(lengths)])
        for t in range(int(lengths.max(initial=0)) - 1, -1, -1):
            n = int(np.searchsorted(-lengths, -t, side="left"))
            flat[at[:n] + t] = tags[:n]
            if t:
                tags[:n] = back[t - 1][np.arange(n), tags[:n]]
        for i, k in enumerate(order.tolist()):
            out[k] = flat[at[i] : at[i + 1]]
        return list(out)

    def tags(self, texts: list[np.ndarray], marks: list[np.ndarray]) -> list[np.ndarray]:
        """Tags of whole texts, given as classes; 0 far from ``marks``, the sorted places without which no span can be.

        Emissions come from overlapping windows, each character's from the one in which it stands farthest from an edge;
        one Viterbi search then goes over each run of windows near marks, so tags across seams are one legal path. Where
        a span reaches the edge of a run, the run is made longer until none does. Texts stand apart at whole strides, so
        what a text gets doesn't depend on those beside it.
        """
        sizes = np.array([-(-len(x) // STRIDE) for x in texts], dtype=np.int64)
        start = np.concatenate([[0], np.cumsum(sizes + APART)])
        padded = np.zeros((start[-1] + APART) * STRIDE + WINDOW, np.int64)
        for x, at in zip(texts, start.tolist(), strict=False):
            padded[MARGIN + at * STRIDE : MARGIN + at * STRIDE + len(x)] = x
        out = [np.zeros(len(x), np.int64) for x in texts]
        near = [np.concatenate([m // STRIDE + d for d in (-1, 0, 1)]) for m in marks]
        todo = [(i, w) for i, x in enumerate(near) for w in _runs(np.unique(np.clip(x, 0, sizes[i] - 1)))] if len(texts) else []
        reach = 1
        while todo:
            found = self.decode(padded, np.array([start[i] + a for i, (a, _) in todo]), np.array([z - a for _, (a, z) in todo]))
            beyond: dict[int, list[tuple[int, int]]] = {}
            for (i, (a, z)), got in zip(todo, found, strict=True):
                own = out[i][a * STRIDE : z * STRIDE]
                own[:] = got[: len(own)]
                longer = (max(0, a - reach) if got[0] > 0 else a, min(int(sizes[i]), z + reach) if got[-1] > 0 else z)
                if longer != (a, z):
                    beyond.setdefault(i, []).append(longer)
            todo = [(i, run) for i, runs in beyond.items() for run in _joined_runs(runs)]
            reach *= 2
        return out


def _runs(windows: np.ndarray) -> list[tuple[int, int]]:
    """Runs of consecutive windows as (first, one past the last)."""
    if not len(windows):
        return []
    cuts = np.flatnonzero(np.diff(windows) > 1) + 1
    return [(int(p[0]), int(p[-1]) + 1) for p in np.split(windows, cuts)]


def _joined_runs(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out
