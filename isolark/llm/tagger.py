"""Character-level bidirectional LSTM with CRF transitions, in numpy: training and inference."""

from __future__ import annotations

import numpy as np

#: Character numbers: 0 is padding, 1 to 95 printable ASCII, then letters, digits and blanks beyond it, and the rest.
CHARACTERS = 100


def char_numbers(points: np.ndarray) -> np.ndarray:
    out = np.full(len(points), 98, np.int32)
    ascii_ = (points >= 32) & (points < 127)
    out[ascii_] = points[ascii_] - 31
    out[points < 32] = 96
    out[(points >= 0xC0) & (points < 0x250)] = 97
    return out


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _logsumexp(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


class Tagger:
    def __init__(self, labels: int, hidden: int = 16, embedding: int = 12, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.hidden, self.labels = hidden, labels
        small = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"emb": small(CHARACTERS, embedding), "out": small(2 * hidden, labels), "bias": np.zeros(labels, np.float32), "step": np.zeros((labels, labels), np.float32), "first": np.zeros(labels, np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": small(embedding, 4 * hidden), f"h{d}": small(hidden, 4 * hidden), f"b{d}": np.repeat(np.float32([0, 1, 0, 0]), hidden)}

    def _run(self, x: np.ndarray, d: str, keep: bool):
        """Hidden states of one direction over (windows, places, embedding); gates in the order in, forget, out, new."""
        n, t, _ = x.shape
        k = self.hidden
        pre = x @ self.p[f"x{d}"] + self.p[f"b{d}"]
        h, c = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
        out, saved = np.empty((n, t, k), np.float32), []
        for s in range(t) if d == "f" else range(t - 1, -1, -1):
            z = pre[:, s] + h @ self.p[f"h{d}"]
            gates, new = _sigmoid(z[:, : 3 * k]), np.tanh(z[:, 3 * k :])
            before, held = c, h
            c = gates[:, k : 2 * k] * c + gates[:, :k] * new
            squashed = np.tanh(c)
            h = gates[:, 2 * k :] * squashed
            out[:, s] = h
            if keep:
                saved.append((s, gates, new, before, held, squashed))
        return out, saved

    def emissions(self, numbers: np.ndarray) -> np.ndarray:
        x = self.p["emb"][numbers]
        return np.concatenate([self._run(x, "f", False)[0], self._run(x, "b", False)[0]], axis=2) @ self.p["out"] + self.p["bias"]

    def _back(self, x, d, saved, grad_out, grads):
        k = self.hidden
        grad_x = np.zeros_like(x)
        gh, gc = np.zeros_like(grad_out[:, 0]), np.zeros_like(grad_out[:, 0])
        for s, gates, new, before, held, squashed in reversed(saved):
            i, f, o = gates[:, :k], gates[:, k : 2 * k], gates[:, 2 * k :]
            gh = gh + grad_out[:, s]
            gc = gc + gh * o * (1 - squashed**2)
            z = np.concatenate([gc * new * i * (1 - i), gc * before * f * (1 - f), gh * squashed * o * (1 - o), gc * i * (1 - new**2)], axis=1)
            grads[f"x{d}"] += x[:, s].T @ z
            grads[f"h{d}"] += held.T @ z
            grads[f"b{d}"] += z.sum(axis=0)
            grad_x[:, s] = z @ self.p[f"x{d}"].T
            gh, gc = z @ self.p[f"h{d}"].T, gc * f
        return grad_x

    def gradients(self, numbers: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the label sequences and its gradients."""
        n, t = numbers.shape
        x = self.p["emb"][numbers]
        (hf, sf), (hb, sb) = self._run(x, "f", True), self._run(x, "b", True)
        h = np.concatenate([hf, hb], axis=2)
        em = h @ self.p["out"] + self.p["bias"]
        step = self.p["step"]
        alpha, beta = np.empty_like(em), np.zeros_like(em)
        alpha[:, 0] = em[:, 0] + self.p["first"]
        for s in range(1, t):
            alpha[:, s] = em[:, s] + _logsumexp(alpha[:, s - 1, :, None] + step, 1)
        for s in range(t - 2, -1, -1):
            beta[:, s] = _logsumexp(step + (em[:, s + 1] + beta[:, s + 1])[:, None, :], 2)
        total = _logsumexp(alpha[:, -1], 1)
        marginal = np.exp(alpha + beta - total[:, None, None])
        rows, places = np.arange(n)[:, None], np.arange(t)[None, :]
        path = self.p["first"][gold[:, 0]] + em[rows, places, gold].sum(axis=1) + step[gold[:, :-1], gold[:, 1:]].sum(axis=1)
        grads = {key: np.zeros_like(v) for key, v in self.p.items()}
        ge = marginal.copy()
        ge[rows, places, gold] -= 1
        ge /= n
        pair = np.exp(alpha[:, :-1, :, None] + step + (em[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]).sum(axis=(0, 1))
        np.subtract.at(pair, (gold[:, :-1], gold[:, 1:]), 1)
        grads["step"] += pair / n
        grads["first"] += ge[:, 0].sum(axis=0)
        grads["out"] += np.einsum("nth,ntk->hk", h, ge)
        grads["bias"] += ge.sum(axis=(0, 1))
        gh = ge @ self.p["out"].T
        k = self.hidden
        gx = self._back(x, "f", sf, gh[:, :, :k], grads) + self._back(x, "b", sb, gh[:, :, k:], grads)
        np.add.at(grads["emb"], numbers, gx)
        return float((total - path).mean()), grads

    def train(self, numbers: np.ndarray, gold: np.ndarray, steps: int, batch: int = 64, rate: float = 0.02, seed: int = 11) -> float:
        """Adam over shuffled batches; the mean loss of the last tenth of the steps."""
        rng = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        order, losses = np.zeros(0, np.int64), []
        for i in range(1, steps + 1):
            if len(order) < batch:
                order = np.concatenate([order, rng.permutation(len(numbers))])
            own, order = order[:batch], order[batch:]
            loss, grads = self.gradients(numbers[own], gold[own])
            losses.append(loss)
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
            pace = rate * min(1.0, 2 * (1 - i / (steps + 1)))
            for k, g in grads.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g**2
                self.p[k] = (self.p[k] - pace * (first[k] / (1 - 0.9**i)) / (np.sqrt(second[k] / (1 - 0.99**i)) + 1e-6)).astype(np.float32)
        return float(np.mean(losses[-max(1, steps // 10) :]))

    def decode(self, em: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best label sequences of padded rows; places at and beyond a row's length get label 0."""
        n, t, k = em.shape
        step = self.p["step"]
        best = em[:, 0] + self.p["first"]
        back = np.zeros((n, t, k), np.int8)
        for s in range(1, t):
            through = best[:, :, None] + step
            came = through.argmax(axis=1)
            inside = (s < lengths)[:, None]
            back[:, s] = np.where(inside, came, np.arange(k))
            best = np.where(inside, np.take_along_axis(through, came[:, None, :], 1)[:, 0] + em[:, s], best)
        out = np.zeros((n, t), np.int8)
        now = best.argmax(axis=1)
        for s in range(t - 1, -1, -1):
            out[:, s] = np.where(s < lengths, now, 0)
            now = back[np.arange(n), s, now].astype(np.int64)
        return out
