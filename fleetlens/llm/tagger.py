"""A character-level bidirectional LSTM with a CRF on top, in numpy."""

from __future__ import annotations

import numpy as np

WIDTH = 64  # code points in a window
CODES = 131  # ASCII, other letters, other characters, padding
PAD = CODES - 1


def codes(text: str) -> np.ndarray:
    """Input classes of the characters of a text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) and points.max() > 127:
        letter = np.fromiter((c.isalpha() for c in text), bool, len(text))
        return np.where(points < 128, points, np.where(letter, 128, 129)).astype(np.int64)
    return points.astype(np.int64)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _logsumexp(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Tagger:
    """Embedding, one LSTM each way, linear scores of ``tags``, CRF transitions."""

    def __init__(self, tags: int, hidden: int = 20, embed: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.h, self.tags = hidden, tags
        self.p = {"embed": draw(CODES, embed) * 3, "out": draw(2 * hidden, tags), "bias": np.zeros(tags, np.float32), "trans": np.zeros((tags, tags), np.float32)}
        for way in "fb":
            self.p[f"x{way}"], self.p[f"h{way}"] = draw(embed, 4 * hidden), draw(hidden, 4 * hidden)
            self.p[f"c{way}"] = np.zeros(4 * hidden, np.float32)
            self.p[f"c{way}"][hidden : 2 * hidden] = 1.0  # remember at first

    def _run(self, x: np.ndarray, way: str):
        """Hidden states (T, B, H) of one direction and what its gradient needs."""
        n, h = x.shape[1], self.h
        gates = self.p["embed"] @ self.p[f"x{way}"] + self.p[f"c{way}"]
        pre = gates[x]
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out, kept = np.empty((len(x), n, h), np.float32), []
        for t in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
            z = pre[t] + state @ self.p[f"h{way}"]
            g = _sigmoid(z[:, : 3 * h])
            new = np.tanh(z[:, 3 * h :])
            before, last = cell, state
            cell = g[:, h : 2 * h] * before + g[:, :h] * new
            squashed = np.tanh(cell)
            state = g[:, 2 * h :] * squashed
            out[t] = state
            kept.append((t, g, new, before, squashed, last))
        return out, kept

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Tag scores (T, B, tags) of windows ``x`` (B, T)."""
        x = x.T
        both = np.concatenate([self._run(x, "f")[0], self._run(x, "b")[0]], axis=2)
        return both @ self.p["out"] + self.p["bias"]

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tag path (B, T) of every window, by Viterbi."""
        s = self.scores(x)
        best, back = s[0], []
        for t in range(1, len(s)):
            total = best[:, :, None] + self.p["trans"]
            back.append(total.argmax(axis=1))
            best = total.max(axis=1) + s[t]
        path = [best.argmax(axis=1)]
        for b in reversed(back):
            path.append(np.take_along_axis(b, path[-1][:, None], 1)[:, 0])
        return np.stack(path[::-1], axis=1)

    def step(self, x: np.ndarray, y: np.ndarray):
        """Loss (mean negative log likelihood) and gradients on windows x, tags y (B, T)."""
        x, y = x.T, y.T
        steps, n = x.shape
        (of, kf), (ob, kb) = self._run(x, "f"), self._run(x, "b")
        both = np.concatenate([of, ob], axis=2)
        s, trans, rows = both @ self.p["out"] + self.p["bias"], self.p["trans"], np.arange(n)
        a, b = [s[0]], [np.zeros_like(s[0])]
        for t in range(1, steps):
            a.append(_logsumexp(a[-1][:, :, None] + trans, 1) + s[t])
        for t in range(steps - 1, 0, -1):
            b.append(_logsumexp(trans + (s[t] + b[-1])[:, None, :], 2))
        b = b[::-1]
        z = _logsumexp(a[-1], 1)
        gold = sum(s[t][rows, y[t]] for t in range(steps)) + sum(trans[y[t - 1], y[t]] for t in range(1, steps))
        ds, dtrans = np.empty_like(s), np.zeros_like(trans)
        for t in range(steps):
            ds[t] = np.exp(a[t] + b[t] - z[:, None])
            ds[t][rows, y[t]] -= 1
            if t:
                joint = a[t - 1][:, :, None] + trans + (s[t] + b[t])[:, None, :] - z[:, None, None]
                dtrans += np.exp(joint).sum(axis=0)
                np.subtract.at(dtrans, (y[t - 1], y[t]), 1)
        ds /= n
        grads = {"trans": dtrans / n, "bias": ds.sum(axis=(0, 1)), "out": np.einsum("tbh,tbk->hk", both, ds), "embed": np.zeros_like(self.p["embed"])}
        every = np.arange(CODES)[:, None]
        dboth, h = ds @ self.p["out"].T, self.h
        for way, kept, part in (("f", kf, dboth[:, :, :h]), ("b", kb, dboth[:, :, h:])):
            wh, dh, dc = self.p[f"h{way}"], np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            gx, gh = np.zeros((CODES, 4 * h), np.float32), np.zeros_like(wh)
            for t, g, new, before, squashed, last in reversed(kept):
                dh = dh + part[t]
                dc = dc + dh * g[:, 2 * h :] * (1 - squashed**2)
                dg = np.concatenate([dc * new, dc * before, dh * squashed], axis=1) * g * (1 - g)
                dz = np.concatenate([dg, dc * g[:, :h] * (1 - new**2)], axis=1)
                gx += (every == x[t]).astype(np.float32) @ dz
                gh += last.T @ dz
                dh, dc = dz @ wh.T, dc * g[:, h : 2 * h]
            grads[f"h{way}"], grads[f"c{way}"] = gh, gx.sum(axis=0)
            grads[f"x{way}"] = self.p["embed"].T @ gx
            grads["embed"] += gx @ self.p[f"x{way}"].T
        return float((z - gold).mean()), grads

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 240, batch: int = 40, rate: float = 0.02, seed: int = 11) -> Tagger:
        """Adam on random batches; the same rows and seed give the same tagger."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        for i in range(1, steps + 1 if len(x) else 1):
            some = rng.integers(0, len(x), min(batch, len(x)))
            self.loss, grads = self.step(x[some], y[some])
            scale = min(1.0, 5.0 / (1e-9 + np.sqrt(sum(float((g**2).sum()) for g in grads.values()))))
            for k, g in grads.items():
                g = g * scale
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] -= (rate * (1 - i / (steps + 1)) * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
        return self
