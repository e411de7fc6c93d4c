"""A character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

import numpy as np

#: Characters with a number of their own; a capital has its small letter's, all digits and all non-ASCII letters share one each.
ALPHABET = "abcdefghijklmnopqrstuvwxyz @.+-()[]:/_%=,;'\"\n#*{}<>|&"
DIGIT, LETTER, OTHER = (len(ALPHABET) + i for i in range(3))
N_CHARS = len(ALPHABET) + 4  # the last is padding
PADDING = N_CHARS - 1
_ASCII = np.full(128, OTHER, np.int8)
for _i, _c in enumerate(ALPHABET):
    _ASCII[ord(_c)] = _i
_ASCII[48:58] = DIGIT
_ASCII[65:91] = _ASCII[97:123]


def encode(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.where(points < 128, _ASCII[np.minimum(points, 127)], np.int8(LETTER)).astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Tagger:
    """Tags sequences of character numbers (batch, time), padded at the end with PADDING."""

    def __init__(self, n_tags: int, hidden: int = 24, embed: int = 12, seed: int = 7):
        r = np.random.default_rng(seed)
        init = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.h, self.k = hidden, n_tags
        self.p = {"e": r.standard_normal((N_CHARS, embed)).astype(np.float32) * 0.5, "w": init(2 * hidden, n_tags), "c": np.zeros(n_tags, np.float32), "a": np.zeros((n_tags, n_tags), np.float32), "s": np.zeros(n_tags, np.float32)}
        for d in "fb":
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden : 2 * hidden] = 1  # forget gate
            self.p |= {f"x{d}": init(embed, 4 * hidden), f"h{d}": init(hidden, 4 * hidden), f"b{d}": bias}

    def _run(self, emb: np.ndarray, real: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """One direction over (time, batch, embed); padded steps keep state at zero."""
        t, n, _ = emb.shape
        h = c = np.zeros((n, self.h), np.float32)
        out, tape = np.zeros((t, n, self.h), np.float32), [None] * t
        pre = emb @ self.p[f"x{d}"] + self.p[f"b{d}"]
        for s in range(t) if d == "f" else range(t - 1, -1, -1):
            z = pre[s] + h @ self.p[f"h{d}"]
            i, f, o = (_sigmoid(z[:, j * self.h : (j + 1) * self.h]) for j in range(3))
            g = np.tanh(z[:, 3 * self.h :])
            m = real[s][:, None]
            new = (f * c + i * g) * m
            tc = np.tanh(new)
            tape[s] = (h, c, i, f, o, g, tc, m)
            h, c = o * tc * m, new
            out[s] = h
        return out, tape

    def _back(self, grad: np.ndarray, emb: np.ndarray, tape: list, d: str, to: dict) -> np.ndarray:
        t, n, _ = emb.shape
        dh = dc = np.zeros((n, self.h), np.float32)
        dz_all = np.zeros((t, n, 4 * self.h), np.float32)
        for s in range(t - 1, -1, -1) if d == "f" else range(t):
            h, c, i, f, o, g, tc, m = tape[s]
            dh = (dh + grad[s]) * m
            dct = (dc + dh * o * (1 - tc * tc)) * m
            dz = np.concatenate([dct * g * i * (1 - i), dct * c * f * (1 - f), dh * tc * o * (1 - o), dct * i * (1 - g * g)], 1)
            to[f"h{d}"] += h.T @ dz
            dh, dc = dz @ self.p[f"h{d}"].T, dct * f
            dz_all[s] = dz
        flat = dz_all.reshape(t * n, -1)
        to[f"x{d}"] += emb.reshape(t * n, -1).T @ flat
        to[f"b{d}"] += flat.sum(0)
        return dz_all @ self.p[f"x{d}"].T

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """(batch, time, tags)"""
        return self._forward(x)[0].transpose(1, 0, 2)

    def _forward(self, x: np.ndarray):
        real = (x != PADDING).T.astype(np.float32)
        emb = self.p["e"][x.T]
        f, tf = self._run(emb, real, "f")
        b, tb = self._run(emb, real, "b")
        both = np.concatenate([f, b], 2)
        return both @ self.p["w"] + self.p["c"], both, emb, tf, tb, real

    def _both_ways(self, u: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward probabilities of emissions (time, batch, tags), scaled to sum to one; what a step brings from behind; log Z."""
        t, n, _ = u.shape
        top = u.max(2, keepdims=True)
        e, move = np.exp(u - top), np.exp(self.p["a"])
        alpha, beta, later, scale = np.empty_like(u), np.ones_like(u), np.zeros_like(u), np.ones((t, n, 1), u.dtype)
        for s in range(t):
            step = (alpha[s - 1] @ move if s else np.exp(self.p["s"])) * e[s]
            on = real[s][:, None] > 0
            total = step.sum(1, keepdims=True)
            scale[s] = np.where(on, total, 1) if s else total
            alpha[s] = np.where(on, step / total, alpha[s - 1]) if s else step / total
        for s in range(t - 1, 0, -1):
            later[s] = e[s] * beta[s] / scale[s]
            beta[s - 1] = np.where(real[s][:, None] > 0, later[s] @ move.T, beta[s])
        z = (np.log(scale) + top * real[:, :, None]).sum((0, 2))
        return alpha, beta, later, z

    def marginals(self, x: np.ndarray) -> np.ndarray:
        """(batch, time, tags) posterior of each tag."""
        u, *_, real = self._forward(x)
        a, b, *_ = self._both_ways(u, real)
        return (a * b).transpose(1, 0, 2)

    def _states(self, x: np.ndarray, real: np.ndarray, d: str) -> np.ndarray:
        """What _run gives, as (time, hidden, batch), without its tape: inputs come from a table by character, and one tanh does for all gates."""
        h = self.h
        half = np.r_[np.full(3 * h, 0.5, np.float32), np.ones(h, np.float32)]
        table = np.ascontiguousarray(((self.p["e"] @ self.p[f"x{d}"] + self.p[f"b{d}"]) * half).T.astype(np.float32))
        recur = np.ascontiguousarray((self.p[f"h{d}"] * half).T.astype(np.float32))
        t, n = x.shape
        out, state, cell = np.empty((t, h, n), np.float32), np.zeros((h, n), np.float32), np.zeros((h, n), np.float32)
        z, gate, part = np.empty((4 * h, n), np.float32), np.empty((4 * h, n), np.float32), np.empty((h, n), np.float32)
        whole = real.all(1)
        for s in range(t) if d == "f" else range(t - 1, -1, -1):
            np.take(table, x[s], 1, gate, "clip")
            np.matmul(recur, state, z)
            z += gate
            np.tanh(z, z)
            np.multiply(z[: 3 * h], 0.5, gate[: 3 * h])
            gate[: 3 * h] += 0.5
            cell *= gate[h : 2 * h]
            np.multiply(gate[:h], z[3 * h :], part)
            cell += part
            if not whole[s]:
                cell *= real[s]
            np.tanh(cell, part)
            state = np.multiply(part, gate[2 * h : 3 * h], out[s])
        return out

    def tags(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows whose best tags aren't all 0, and these (window, time).

        Tags are odd where a span begins, even inside. A Viterbi pass over three states (0, begin,
        inside), with the best emission and transition of any kind for each, bounds every path: where it
        gains nothing over zeros, zeros are best. The other windows take the whole pass.
        """
        real = (x != PADDING).T
        wide = real.astype(np.float32)
        codes, w = np.ascontiguousarray(x.T), np.ascontiguousarray(self.p["w"].T)
        u = w[:, : self.h] @ self._states(codes, wide, "f") + w[:, self.h :] @ self._states(codes, wide, "b") + self.p["c"][:, None]
        groups = slice(0, 1), slice(1, None, 2), slice(2, None, 2)
        move = [[float(self.p["a"][i, j].max() - self.p["a"][0, 0]) for j in groups] for i in groups]
        gain = [u[:, g].max(1) - u[:, 0] for g in groups[1:]]
        whole = real.all(1)
        zero, begin, inside = np.zeros(len(x), np.float32), *(float((self.p["s"][g] - self.p["s"][0]).max()) + v[0] for g, v in zip(groups[1:], gain))
        for s in range(1, len(u)):
            after = [np.maximum(np.maximum(zero + move[0][j], begin + move[1][j]), inside + move[2][j]) for j in range(3)]
            after[1] += gain[0][s]
            after[2] += gain[1][s]
            zero, begin, inside = after if whole[s] else (np.where(real[s], new, old) for new, old in zip(after, (zero, begin, inside)))
        some = np.flatnonzero(np.maximum(np.maximum(zero, begin), inside) > 0)
        best = self._viterbi(u[:, :, some].transpose(0, 2, 1), wide[:, some]) if len(some) else np.zeros((0, x.shape[1]), np.int64)
        known = best.any(1)
        return some[known], best[known]

    def decode(self, x: np.ndarray) -> np.ndarray:
        """(batch, time) best tags by Viterbi."""
        u, *_, real = self._forward(x)
        return self._viterbi(u, real)

    def _viterbi(self, u: np.ndarray, real: np.ndarray) -> np.ndarray:
        best, back = u[0] + self.p["s"], []
        for s in range(1, len(u)):
            step = best[:, :, None] + self.p["a"]
            on = real[s][:, None] > 0
            back.append(np.where(on, step.argmax(1), np.arange(self.k)))
            best = np.where(on, step.max(1) + u[s], best)
        tag = best.argmax(1)
        out = [tag]
        for b in reversed(back):
            tag = b[np.arange(len(tag)), tag]
            out.append(tag)
        return np.stack(out[::-1], 1)

    def loss_and_gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of tags y, and its gradient."""
        u, both, emb, tf, tb, real = self._forward(x)
        t, n, k = u.shape
        a, b, later, z = self._both_ways(u, real)
        gold = y.T
        onehot = np.eye(k, dtype=np.float32)[gold] * real[:, :, None]
        to = {name: np.zeros_like(v) for name, v in self.p.items()}
        score = (u * onehot).sum((0, 2)) + self.p["s"][gold[0]]
        on = real[1:] > 0
        score += np.where(on, self.p["a"][gold[:-1], gold[1:]], 0).sum(0)
        pair = np.einsum("tni,tnj->ij", a[:-1], later[1:] * on[:, :, None], optimize=True) * np.exp(self.p["a"])
        to["a"] += pair
        np.subtract.at(to["a"], (gold[:-1][on], gold[1:][on]), 1)
        post = a * b * real[:, :, None]
        to["s"] += (post[0] - onehot[0]).sum(0)
        du = (post - onehot).astype(np.float32) / n
        to["a"] /= n
        to["s"] /= n
        to["w"] += both.reshape(t * n, -1).T @ du.reshape(t * n, -1)
        to["c"] += du.sum((0, 1))
        dboth = du @ self.p["w"].T
        demb = self._back(dboth[:, :, : self.h], emb, tf, "f", to) + self._back(dboth[:, :, self.h :], emb, tb, "b", to)
        np.add.at(to["e"], x.T, demb)
        return float((z - score).mean()), to

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int, batch: int = 64, rate: float = 0.015, seed: int = 1) -> list[float]:
        """Adam with a falling rate and clipped gradients."""
        r, m, v, losses = np.random.default_rng(seed), {}, {}, []
        for step in range(1, steps + 1):
            pick = r.integers(0, len(x), batch)
            loss, grad = self.loss_and_gradient(x[pick], y[pick])
            losses.append(loss)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            scale, lr = min(1.0, 5.0 / (norm + 1e-9)), rate * (1 - 0.9 * step / steps)
            for name, g in grad.items():
                g = g * scale
                m[name] = 0.9 * m.get(name, 0) + 0.1 * g
                v[name] = 0.99 * v.get(name, 0) + 0.01 * g * g
                self.p[name] = (self.p[name] - lr * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return losses
