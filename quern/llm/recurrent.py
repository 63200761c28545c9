"""A bidirectional LSTM over sequences, in numpy: one logit per step."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (1 + np.tanh(np.float32(0.5) * x))


class BiLstm:
    """Weights by name: for each direction d, w{d} from the input, u{d} from the state, b{d}; v and c to the logit."""

    def __init__(self, inputs: int, hidden: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.weights = {"v": rng.normal(0, hidden**-0.5, 2 * hidden), "c": np.zeros(1)}
        for d in "fb":
            self.weights[f"w{d}"] = rng.normal(0, 0.15, (inputs, 4 * hidden))
            self.weights[f"u{d}"] = rng.normal(0, hidden**-0.5, (hidden, 4 * hidden))
            self.weights[f"b{d}"] = np.repeat([0.0, 1.0, 0.0, 0.0], hidden)  # input, forget, output gate, candidate

    def lighter(self) -> BiLstm:
        """The same weights in single precision, for inference."""
        found = BiLstm.__new__(BiLstm)
        found.hidden, found.weights = self.hidden, {k: w.astype(np.float32) for k, w in self.weights.items()}
        return found

    def _run(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """States (steps, rows, hidden) of one direction; x is already turned for the backward one."""
        steps, rows, _ = x.shape
        n, u = self.hidden, self.weights[f"u{d}"]
        fed = x @ self.weights[f"w{d}"] + self.weights[f"b{d}"]
        h, c = np.zeros((rows, n), u.dtype), np.zeros((rows, n), u.dtype)
        out, held = np.empty((steps, rows, n), u.dtype), []
        for t in range(steps):
            z = fed[t] + h @ u
            gates, new = _sigmoid(z[:, : 3 * n]), np.tanh(z[:, 3 * n :])
            before, was = h, c
            c = gates[:, n : 2 * n] * c + gates[:, :n] * new
            squashed = np.tanh(c)
            h = gates[:, 2 * n :] * squashed
            out[t] = h
            if keep:
                held.append((before, was, gates, new, squashed))
        return out, held

    def _back(self, x: np.ndarray, held: list, upstream: np.ndarray, d: str, grads: dict) -> None:
        n, u = self.hidden, self.weights[f"u{d}"]
        dh, dc = np.zeros(upstream.shape[1:]), np.zeros(upstream.shape[1:])
        dz_all = np.empty((*upstream.shape[:2], 4 * n))
        for t in range(len(held) - 1, -1, -1):
            before, was, gates, new, squashed = held[t]
            dh = dh + upstream[t]
            i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
            dc = dc + dh * o * (1 - squashed**2)
            dz = dz_all[t]
            dz[:, :n] = dc * new * i * (1 - i)
            dz[:, n : 2 * n] = dc * was * f * (1 - f)
            dz[:, 2 * n : 3 * n] = dh * squashed * o * (1 - o)
            dz[:, 3 * n :] = dc * i * (1 - new**2)
            grads[f"u{d}"] += before.T @ dz
            dh, dc = dz @ u.T, dc * f
        flat = dz_all.reshape(-1, 4 * n)
        grads[f"w{d}"] += x.reshape(-1, x.shape[-1]).T @ flat
        grads[f"b{d}"] += flat.sum(0)

    @staticmethod
    def _turned(lengths: np.ndarray, steps: int) -> np.ndarray:
        """For each step and row the step that comes there when the row is read from its end; what pads it stays."""
        t = np.arange(steps)[:, None]
        return np.where(t < lengths, lengths - 1 - t, t)

    def logits(self, sequences: Sequence[np.ndarray], cells: int = 1 << 13) -> list[np.ndarray]:
        """A logit for each step of each sequence; sequences of like length go together, at most `cells` steps with what pads them."""
        found: list = [None] * len(sequences)
        for group in _groups([len(s) for s in sequences], cells):
            x, lengths = _padded([sequences[i] for i in group], self.weights["v"].dtype)
            score, _ = self._score(x, lengths, False)
            for k, i in enumerate(group):
                found[i] = score[: lengths[k], k]
        return found

    def _score(self, x: np.ndarray, lengths: np.ndarray, keep: bool):
        turned, rows = self._turned(lengths, len(x)), np.arange(x.shape[1])
        back_x = x[turned, rows]
        forward, held_f = self._run(x, "f", keep)
        backward, held_b = self._run(back_x, "b", keep)
        both = np.concatenate([forward, backward[turned, rows]], -1)
        return both @ self.weights["v"] + self.weights["c"], (both, turned, rows, back_x, held_f, held_b)

    def gradients(self, x: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the steps that are not padding, and its gradient."""
        score, (both, turned, rows, back_x, held_f, held_b) = self._score(x, lengths, True)
        real = np.arange(len(x))[:, None] < lengths
        n = real.sum()
        loss = float((np.logaddexp(0, score) - labels * score)[real].sum() / n)
        dscore = np.where(real, _sigmoid(score) - labels, 0) / n
        grads = {k: np.zeros_like(w) for k, w in self.weights.items()}
        grads["v"] = np.tensordot(dscore, both, ([0, 1], [0, 1]))
        grads["c"][0] = dscore.sum()
        up = dscore[..., None] * self.weights["v"]
        self._back(x, held_f, up[..., : self.hidden], "f", grads)
        self._back(back_x, held_b, up[..., self.hidden :][turned, rows], "b", grads)
        return loss, grads

    def fit(self, sequences: Sequence[np.ndarray], labels: Sequence[np.ndarray], epochs: int, seed: int, rate: float = 0.01, cells: int = 1 << 10) -> list[float]:
        """Adam over groups of like length in random order; the mean loss of each epoch."""
        rng = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(w) for k, w in self.weights.items()} for _ in range(2))
        t = 0
        groups, losses = list(_groups([len(s) for s in sequences], cells)), []
        for epoch in range(epochs):
            total = 0.0
            for g in rng.permutation(len(groups)):
                x, lengths = _padded([sequences[i] for i in groups[g]])
                y, _ = _padded([labels[i][:, None] for i in groups[g]])
                loss, grads = self.gradients(x, lengths, y[..., 0])
                total += loss
                norm = np.sqrt(sum((v**2).sum() for v in grads.values()))
                t += 1
                step = rate * (1 - epoch / epochs)
                for k, v in grads.items():
                    v = v / max(1.0, norm)
                    first[k] += 0.1 * (v - first[k])
                    second[k] += 0.001 * (v**2 - second[k])
                    self.weights[k] -= step * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
            losses.append(total / max(1, len(groups)))
        return losses


def _groups(lengths: Sequence[int], cells: int) -> Iterator[list[int]]:
    """Places of the sequences that have steps, the longest first, in groups whose padded size is bounded (a longer sequence is a group of its own)."""
    group: list[int] = []
    for i in sorted((i for i, n in enumerate(lengths) if n), key=lambda i: (-lengths[i], i)):
        if group and (len(group) + 1) * lengths[group[0]] > cells:
            yield group
            group = []
        group.append(i)
    if group:
        yield group


def _padded(sequences: Sequence[np.ndarray], kind: type = np.float64) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(s) for s in sequences])
    x = np.zeros((lengths.max(), len(sequences), sequences[0].shape[1]), kind)
    for k, s in enumerate(sequences):
        x[: len(s), k] = s
    return x, lengths
