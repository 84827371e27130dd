"""A character tagger: bidirectional LSTM emissions under a linear-chain CRF, in numpy.

Both directions run side by side as one stacked recurrence over a batch of
equally long windows (short ones are padded behind).  Training minimises the
CRF's negative log-likelihood with Adam; gradients go through the chain's
forward-backward sums and back through time.  Decoding gives the best path and
the posterior of each of its tags.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

PAD, SPACE, LETTER, OTHER = 0, 1, 2, 3       # classes of characters outside printable ASCII
CLASSES = 4 + 95
EMBED, HIDDEN = 12, 24
NEVER = -1e4


def codes(texts: list[str], width: int) -> np.ndarray:
    """n x width classes of the characters of texts no longer than ``width``."""
    out = np.zeros((len(texts), width), np.int64)
    for k, text in enumerate(texts):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        found = np.where((points > 32) & (points < 127), points - 32 + 4, OTHER)
        found[(points <= 32) | (points == 0xA0)] = SPACE
        high = np.flatnonzero(points > 127)
        if len(high):
            found[high[[text[i].isalpha() for i in high]]] = LETTER
        out[k, :len(found)] = found
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Tagger:
    tags: list[str]                # O, then B-kind and I-kind for each kind
    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, kinds: tuple[str, ...], seed: int) -> Tagger:
        rng = np.random.default_rng(seed)
        tags = ["O"] + [f"{p}-{k}" for k in kinds for p in "BI"]

        def draw(*shape):
            return (rng.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)

        w = {"embed": draw(CLASSES, EMBED) * 3, "input": draw(2, EMBED, 4 * HIDDEN), "state": draw(2, HIDDEN, 4 * HIDDEN),
             "bias": np.zeros((2, 1, 4 * HIDDEN), np.float32), "out": draw(2 * HIDDEN, len(tags)), "out_bias": np.zeros(len(tags), np.float32),
             "move": np.zeros((len(tags), len(tags)), np.float32), "start": np.zeros(len(tags), np.float32)}
        w["bias"][..., HIDDEN:2 * HIDDEN] = 1          # remember at first
        return cls(tags, w)

    # -- the network -------------------------------------------------------------------------------

    def emissions(self, x: np.ndarray, keep: bool = False):
        """Tag scores (n x width x tags) of classes (n x width), and what the gradient needs."""
        w, (n, width) = self.weights, x.shape
        first = w["embed"][x.T]                        # width x n x EMBED
        both = np.stack([first, first[::-1]], axis=1)  # width x 2 x n x EMBED
        given = both @ w["input"] + w["bias"]
        h, c = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
        states = np.empty((width, 2, n, HIDDEN), np.float32)
        trail = []
        for t in range(width):
            z = given[t] + h @ w["state"]
            gates, new = sigmoid(z[..., :3 * HIDDEN]), np.tanh(z[..., 3 * HIDDEN:])
            before = (h, c)
            c = gates[..., HIDDEN:2 * HIDDEN] * c + gates[..., :HIDDEN] * new
            bent = np.tanh(c)
            h = gates[..., 2 * HIDDEN:] * bent
            states[t] = h
            if keep:
                trail.append((gates, new, before, bent))
        seen = np.concatenate([states[:, 0], states[::-1, 1]], axis=-1).transpose(1, 0, 2)
        scores = seen @ w["out"] + w["out_bias"]
        scores[..., 1:] += NEVER * (x == PAD)[..., None]
        return (scores, (both, trail, seen)) if keep else scores

    def moves(self) -> tuple[np.ndarray, np.ndarray]:
        """Transition and start scores; an inside tag needs its own kind before it."""
        move, start = self.weights["move"].copy(), self.weights["start"].copy()
        for j, tag in enumerate(self.tags):
            if tag[0] == "I":
                start[j] = NEVER
                for i, old in enumerate(self.tags):
                    if old == "O" or old[2:] != tag[2:]:
                        move[i, j] = NEVER
        return move, start

    def chain(self, scores: np.ndarray):
        """log Z, posteriors of tags, and the forward and backward sums."""
        move, start = self.moves()
        n, width, k = scores.shape
        top = scores.max(axis=2, keepdims=True)
        e, m = np.exp((scores - top).astype(np.float64)), np.exp(move.astype(np.float64))
        fore, back = np.empty((width, n, k)), np.empty((width, n, k))
        log_z = top.sum(axis=(1, 2)).astype(np.float64)
        now = np.exp(start.astype(np.float64)) * e[:, 0]
        for t in range(width):
            if t:
                now = (now @ m) * e[:, t]
            total = now.sum(axis=1, keepdims=True)
            now = now / total
            log_z += np.log(total[:, 0])
            fore[t] = now
        now = np.ones((n, k))
        for t in range(width - 1, -1, -1):
            back[t] = now / now.sum(axis=1, keepdims=True)
            now = (back[t] * e[:, t]) @ m.T
        posterior = fore * back
        posterior /= posterior.sum(axis=2, keepdims=True)
        return log_z, posterior.transpose(1, 0, 2), (e, m, fore, back)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags (n x width) and their posteriors."""
        scores = self.emissions(x)
        move, start = self.moves()
        n, width, _ = scores.shape
        best, via = start + scores[:, 0], np.empty((width, n, len(self.tags)), np.int8)
        for t in range(1, width):
            ways = best[:, :, None] + move
            via[t] = ways.argmax(axis=1)
            best = ways.max(axis=1) + scores[:, t]
        path = np.empty((n, width), np.int64)
        path[:, -1] = best.argmax(axis=1)
        for t in range(width - 1, 0, -1):
            path[:, t - 1] = via[t][np.arange(n), path[:, t]]
        _, posterior, _ = self.chain(scores)
        return path, np.take_along_axis(posterior, path[..., None], axis=2)[..., 0]

    # -- training ----------------------------------------------------------------------------------

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss of a batch and its gradients."""
        w, (n, width) = self.weights, x.shape
        scores, (both, trail, seen) = self.emissions(x, keep=True)
        log_z, posterior, (e, m, fore, back) = self.chain(scores)
        move, start = self.moves()
        rows, at = np.arange(n)[:, None], np.arange(width)[None]
        gold = scores[rows, at, y].sum(axis=1) + start[y[:, 0]] + move[y[:, :-1], y[:, 1:]].sum(axis=1)
        loss = float((log_z - gold).mean())
        d_scores = posterior.copy()
        d_scores[rows, at, y] -= 1
        g = {"start": d_scores[:, 0].sum(axis=0) / n}
        ahead = back[1:] * e.transpose(1, 0, 2)[1:]
        pairs = np.einsum("tni,ij,tnj->tn", fore[:-1], m, ahead)
        expected = np.einsum("tni,tnj->ij", fore[:-1] / pairs[..., None], ahead) * m
        np.add.at(expected, (y[:, :-1], y[:, 1:]), -1)
        g["move"] = expected / n
        d_scores = (d_scores / n).astype(np.float32)
        g["out"], g["out_bias"] = np.einsum("nth,ntk->hk", seen, d_scores, optimize=True), d_scores.sum(axis=(0, 1))
        d_seen = (d_scores @ w["out"].T).transpose(1, 0, 2)
        d_states = np.stack([d_seen[..., :HIDDEN], d_seen[::-1, :, HIDDEN:]], axis=1)
        d_z = np.empty((width, 2, n, 4 * HIDDEN), np.float32)
        dh, dc = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
        g["state"] = np.zeros_like(w["state"])
        for t in range(width - 1, -1, -1):
            gates, new, (h, c), bent = trail[t]
            i, f, o = gates[..., :HIDDEN], gates[..., HIDDEN:2 * HIDDEN], gates[..., 2 * HIDDEN:]
            dh = dh + d_states[t]
            dc = dc + dh * o * (1 - bent * bent)
            d_gates = np.concatenate([dc * new, dc * c, dh * bent], axis=-1)
            d_z[t] = np.concatenate([d_gates * gates * (1 - gates), dc * i * (1 - new * new)], axis=-1)
            g["state"] += h.transpose(0, 2, 1) @ d_z[t]
            dh, dc = d_z[t] @ w["state"].transpose(0, 2, 1), dc * f
        g["bias"] = d_z.sum(axis=(0, 2))[:, None]
        g["input"] = np.einsum("tdne,tdnz->dez", both, d_z, optimize=True)
        d_both = d_z @ w["input"].transpose(0, 2, 1)
        g["embed"] = np.zeros_like(w["embed"])
        np.add.at(g["embed"], x.T, d_both[:, 0] + d_both[::-1, 1])
        return loss, g

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.01, seed: int = 0) -> list[float]:
        """Adam over shuffled batches; returns the mean loss of each epoch."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step, losses, steps = 0, [], epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order, total = rng.permutation(len(x)), 0.0
            for lo in range(0, len(x), batch):
                rows = order[lo:lo + batch]
                loss, grads = self.gradients(x[rows], y[rows])
                total += loss * len(rows)
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                step += 1
                now = rate * (1 - 0.9 * step / steps)
                for k, g in grads.items():
                    g = (g * min(1.0, 5 / (norm + 1e-12))).astype(np.float32)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    up, down = first[k] / (1 - 0.9 ** step), np.sqrt(second[k] / (1 - 0.999 ** step))
                    self.weights[k] -= now * up / (down + 1e-8)
            losses.append(total / max(1, len(x)))
        return losses
