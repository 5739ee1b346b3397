"""A character-level bidirectional LSTM with CRF transitions, in numpy: scoring, training, decoding.

Both directions run as one batched product; the backward one reads the windows reversed."""

from __future__ import annotations

import numpy as np

#: ASCII stands for itself; other characters are classes.
LETTER, SPACE, MARK, PAD = 128, 129, 130, 131
SYMBOLS = 132


def codes(text: str) -> np.ndarray:
    """A small number for each character."""
    at = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    out = at.astype(np.int16, copy=True)
    wide = np.flatnonzero(at > 127)
    for i in wide.tolist():
        c = text[i]
        out[i] = LETTER if c.isalpha() else SPACE if c.isspace() else MARK
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Tagger:
    """Parameters and passes of the network. tags: number of tags."""

    def __init__(self, tags: int, width: int = 8, hidden: int = 16, seed: int = 7):
        r = np.random.default_rng(seed)
        n = lambda *shape, s: (r.normal(size=shape) * s).astype(np.float32)
        self.tags, self.hidden = tags, hidden
        self.p = {
            "embed": n(SYMBOLS, width, s=0.3), "wx": n(2, width, 4 * hidden, s=0.3), "wh": n(2, hidden, 4 * hidden, s=0.2), "b": np.zeros((2, 1, 4 * hidden), np.float32),
            "out": n(2 * hidden, tags, s=0.2), "bias": np.zeros(tags, np.float32), "move": n(tags, tags, s=0.1), "start": np.zeros(tags, np.float32),
        }
        self.p["b"][:, :, hidden : 2 * hidden] = 1.0

    def _lstm(self, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """x: windows x steps of symbols. Hidden states (steps, 2, windows, hidden), in reading order."""
        p, h = self.p, self.hidden
        n, steps = x.shape
        gates_of = np.einsum("sd,kdg->ksg", p["embed"], p["wx"]) + p["b"]  # what each symbol adds to the gates
        both = np.stack([x, x[:, ::-1]])
        state, cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        out = np.empty((steps, 2, n, h), np.float32)
        tape = []
        for t in range(steps):
            z = np.stack([gates_of[0][both[0, :, t]], gates_of[1][both[1, :, t]]]) + state @ p["wh"]
            i, f, o = _sigmoid(z[..., :h]), _sigmoid(z[..., h : 2 * h]), _sigmoid(z[..., 2 * h : 3 * h])
            g = np.tanh(z[..., 3 * h :])
            before, was = state, cell
            cell = f * cell + i * g
            c = np.tanh(cell)
            state = o * c
            out[t] = state
            if keep:
                tape.append((i, f, o, g, before, was, c))
        return out, tape

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Scores of tags: windows x steps x tags."""
        out, _ = self._lstm(x, keep=False)
        features = np.concatenate([out[:, 0], out[::-1, 1]], axis=-1)
        return (features @ self.p["out"] + self.p["bias"]).transpose(1, 0, 2)

    def train(self, x: np.ndarray, y: np.ndarray, steps: int, batch: int = 48, rate: float = 0.015, seed: int = 11) -> None:
        """Maximise the likelihood of tag sequences y for windows x by Adam. PAD symbols are tagged 0."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        order = np.empty(0, np.int64)
        for step in range(1, steps + 1):
            if len(order) < batch:
                order = np.concatenate([order, r.permutation(len(x))])
            take, order = order[:batch], order[batch:]
            grads = self._gradient(x[take], y[take])
            now = rate * min(1.0, step / 20) * (1 - 0.9 * step / steps)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v2[k] = 0.99 * v2[k] + 0.01 * g * g
                self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, h = self.p, self.hidden
        n, steps = x.shape
        out, tape = self._lstm(x, keep=True)
        features = np.concatenate([out[:, 0], out[::-1, 1]], axis=-1)
        e = features @ p["out"] + p["bias"]  # steps, n, tags
        # forward and backward sums of the CRF, in logarithms
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0] + p["start"]

        def lse(a: np.ndarray, axis: int) -> np.ndarray:
            top = a.max(axis=axis, keepdims=True)
            return (np.log(np.exp(a - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)

        for t in range(1, steps):
            alpha[t] = e[t] + lse(alpha[t - 1][:, :, None] + p["move"], 1)
        for t in range(steps - 2, -1, -1):
            beta[t] = lse(p["move"] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        total = lse(alpha[-1], 1)
        node = np.exp(alpha + beta - total[None, :, None])
        truth = np.eye(self.tags, dtype=np.float32)[y].transpose(1, 0, 2)
        de = (node - truth) / n
        d_move = np.zeros_like(p["move"])
        for t in range(1, steps):
            pair = np.exp(alpha[t - 1][:, :, None] + p["move"] + (e[t] + beta[t])[:, None, :] - total[:, None, None])
            d_move += pair.sum(0)
        np.add.at(d_move, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1.0)
        g = {"move": d_move / n, "start": de[0].sum(0), "bias": de.sum((0, 1)), "out": np.einsum("tnf,tnk->fk", features, de)}
        df = de @ p["out"].T
        dh_at = np.stack([df[..., :h], df[::-1, :, h:]], axis=1)  # in reading order of each direction
        both = np.stack([x, x[:, ::-1]])
        d_wh, d_gates = np.zeros_like(p["wh"]), np.zeros((2, SYMBOLS, 4 * h), np.float32)
        dh, dc = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        for t in range(steps - 1, -1, -1):
            i, f, o, q, before, was, c = tape[t]
            dh = dh + dh_at[t]
            dc = dc + dh * o * (1 - c * c)
            dz = np.concatenate([dc * q * i * (1 - i), dc * was * f * (1 - f), dh * c * o * (1 - o), dc * i * (1 - q * q)], axis=-1)
            d_wh += before.transpose(0, 2, 1) @ dz
            for k in range(2):
                np.add.at(d_gates[k], both[k, :, t], dz[k])
            dh = dz @ p["wh"].transpose(0, 2, 1)
            dc = dc * f
        g["wh"] = d_wh
        g["b"] = d_gates.sum(1, keepdims=True)
        g["wx"] = np.einsum("sd,ksg->kdg", p["embed"], d_gates)
        g["embed"] = np.einsum("ksg,kdg->sd", d_gates, p["wx"])
        return g

    def decode(self, e: np.ndarray, allowed: np.ndarray) -> np.ndarray:
        """The best tag sequence of a run of emissions (steps x tags); moves that are not allowed
        (tags x tags) are ruled out."""
        move = np.where(allowed, self.p["move"], -1e9)
        score = e[0] + self.p["start"]
        back = np.zeros(e.shape, np.int8)
        for t in range(1, len(e)):
            to = score[:, None] + move
            back[t] = to.argmax(0)
            score = to.max(0) + e[t]
        tags = np.empty(len(e), np.int8)
        tags[-1] = score.argmax()
        for t in range(len(e) - 1, 0, -1):
            tags[t - 1] = back[t, tags[t]]
        return tags
