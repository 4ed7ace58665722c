"""A gated recurrent language model in numpy with a class-factored softmax.

Numbers of words are grouped into classes of equal size by frequency; the probability of a
word is that of its class times that within the class. Number 0 ends a text and also comes
before its first word, where the state is zero; number 1 stands for all words without a
number of their own.
"""

from __future__ import annotations

import numpy as np

HIDDEN = 16
CLASSES = 32
WORDS = 1024
STEPS = 16
LANES = 512
END, OTHER = 0, 1
_F = np.float32


def shapes(words: int = WORDS, hidden: int = HIDDEN, classes: int = CLASSES) -> dict[str, tuple[int, ...]]:
    each = words // classes
    return {
        "inputs": (words, 3 * hidden),
        "states": (hidden, 3 * hidden),
        "class_weights": (hidden, classes),
        "class_bias": (classes,),
        "word_weights": (classes, each, hidden),
        "word_bias": (classes, each),
    }


def initial(counts: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    """Small random weights; the biases start at the frequencies of the numbers."""
    rng = np.random.default_rng(seed)
    out = {k: rng.normal(0, 0.1, s).astype(_F) for k, s in shapes(len(counts)).items()}
    share = (counts.astype(float) + 0.1).reshape(CLASSES, -1)
    out["class_bias"] = np.log(share.sum(axis=1) / share.sum()).astype(_F)
    out["word_bias"] = np.log(share / share.sum(axis=1, keepdims=True)).astype(_F)
    return out


def flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in shapes()])


def unflat(values: np.ndarray, words: int = WORDS) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in shapes(words).items():
        size = int(np.prod(s))
        out[k] = values[at : at + size].reshape(s).astype(_F)
        at += size
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= _F(0.5)
    np.tanh(x, out=x)
    x *= _F(0.5)
    x += _F(0.5)
    return x


def step(w: dict[str, np.ndarray], x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step of the gated unit for some texts: new state, gates, candidate, state's part."""
    size = h.shape[1]
    g, a = w["inputs"][x], h @ w["states"]
    gates = _sigmoid(g[:, : 2 * size] + a[:, : 2 * size])
    own = np.tanh(g[:, 2 * size :] + gates[:, size:] * a[:, 2 * size :])
    return own + gates[:, :size] * (h - own), gates, own, a[:, 2 * size :]


def _chosen(x: np.ndarray, places: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log softmax at the targets, and exponentials with their sums; changes ``x`` in place.

    Scores are held within +-60, where neither a sum of exponentials nor its log overflows.
    """
    np.clip(x, -60, 60, out=x)
    own = x[places, target]
    np.exp(x, out=x)
    sums = x.sum(axis=1)
    return own - np.log(sums), x, sums


def log_probabilities(w: dict[str, np.ndarray], h: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Natural log probability of each number after each state."""
    each = w["word_bias"].shape[1]
    group, inside = y // each, y % each
    out = _chosen(h @ w["class_weights"] + w["class_bias"], np.arange(len(y)), group)[0]
    order = np.argsort(group, kind="stable")
    ends = np.searchsorted(group[order], np.arange(CLASSES + 1))
    for c in range(CLASSES):
        at = order[ends[c] : ends[c + 1]]
        if len(at):
            scores = h[at] @ w["word_weights"][c].T + w["word_bias"][c]
            out[at] += _chosen(scores, np.arange(len(at)), inside[at])[0]
    return out


def gradients(
    w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, used: np.ndarray, h: np.ndarray
) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
    """Gradients of the mean log loss of one window, the state after it, and the loss.

    x, y and used (1 or 0) are (steps, lanes); propagation stops at the window's start.
    """
    steps, lanes = x.shape
    size = h.shape[1]
    kept, seen = [], []
    for t in range(steps):
        fresh = (x[t] != END).astype(_F)[:, None]
        before = h * fresh
        h, gates, own, part = step(w, x[t], before)
        kept.append((before, gates, own, part, fresh))
        seen.append(h)
    states = np.concatenate(seen)
    target, weight = y.ravel(), used.ravel()
    total = max(float(weight.sum()), 1.0)
    each = w["word_bias"].shape[1]
    group, inside = target // each, target % each
    every = np.arange(len(target))
    logs, error, sums = _chosen(states @ w["class_weights"] + w["class_bias"], every, group)
    loss = -float((logs * weight).sum())
    share = weight / _F(total)
    error *= (share / sums)[:, None]
    error[every, group] -= share
    out = {"class_weights": states.T @ error, "class_bias": error.sum(axis=0)}
    back = error @ w["class_weights"].T
    out["word_weights"], out["word_bias"] = np.zeros_like(w["word_weights"]), np.zeros_like(w["word_bias"])
    moved = np.empty_like(states)
    order = np.argsort(group, kind="stable")
    ends = np.searchsorted(group[order], np.arange(CLASSES + 1))
    by_class, inside, share = states[order], inside[order], share[order]
    for c in range(CLASSES):
        at = slice(ends[c], ends[c + 1])
        own = by_class[at]
        if not len(own):
            continue
        places = np.arange(len(own))
        logs, error, sums = _chosen(own @ w["word_weights"][c].T + w["word_bias"][c], places, inside[at])
        loss -= float((logs * share[at]).sum()) * total
        error *= (share[at] / sums)[:, None]
        error[places, inside[at]] -= share[at]
        out["word_weights"][c], out["word_bias"][c] = error.T @ own, error.sum(axis=0)
        moved[at] = error @ w["word_weights"][c]
    back[order] += moved
    back = back.reshape(steps, lanes, size)
    from_state, from_input = np.empty((steps, lanes, 3 * size), _F), np.empty((steps, lanes, 3 * size), _F)
    later = np.zeros((lanes, size), _F)
    for t in range(steps - 1, -1, -1):
        before, gates, own, part, fresh = kept[t]
        z, r = gates[:, :size], gates[:, size:]
        d = back[t] + later
        d_own = d * (1 - z) * (1 - own * own)
        d_z = d * (before - own) * z * (1 - z)
        d_r = d_own * part * r * (1 - r)
        from_state[t, :, :size] = from_input[t, :, :size] = d_z
        from_state[t, :, size : 2 * size] = from_input[t, :, size : 2 * size] = d_r
        from_state[t, :, 2 * size :] = d_own * r
        from_input[t, :, 2 * size :] = d_own
        later = (d * z + from_state[t] @ w["states"].T) * fresh
    befores = np.concatenate([k[0] for k in kept])
    out["states"] = befores.T @ from_state.reshape(-1, 3 * size)
    rows = x.ravel()
    order = np.argsort(rows, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(rows[order]) > 0))
    out["inputs"] = np.zeros_like(w["inputs"])
    out["inputs"][rows[order][first]] = np.add.reduceat(from_input.reshape(-1, 3 * size)[order], first, axis=0)
    return out, h, loss / total


class Trainer:
    """Truncated backpropagation with Adam over streams of numbers, one lane after the other."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float = 4e-3) -> None:
        self.weights = {k: v.copy() for k, v in weights.items()}
        self.rate, self.steps, self.tokens = rate, 0, 0
        self.mean = {k: np.zeros_like(v) for k, v in weights.items()}
        self.square = {k: np.zeros_like(v) for k, v in weights.items()}

    def update(self, slope: dict[str, np.ndarray]) -> None:
        self.steps += 1
        scale = self.rate * np.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps)
        for k, g in slope.items():
            np.clip(g, -0.1, 0.1, out=g)
            self.mean[k] += _F(0.1) * (g - self.mean[k])
            self.square[k] += _F(0.01) * (g * g - self.square[k])
            self.weights[k] -= _F(scale) * self.mean[k] / (np.sqrt(self.square[k]) + _F(1e-8))

    def learn(self, numbers: np.ndarray) -> None:
        """A stream of whole texts, each closed by 0, is dealt to lanes as one long run each;
        the state is carried from window to window."""
        if not len(numbers):
            return
        lanes = min(LANES, max(1, len(numbers) // STEPS))
        length = -(-len(numbers) // lanes)
        pad = lanes * length - len(numbers)
        y = np.concatenate([numbers, np.zeros(pad, numbers.dtype)]).reshape(lanes, length).T
        used = np.concatenate([np.ones(len(numbers), _F), np.zeros(pad, _F)]).reshape(lanes, length).T
        x = np.concatenate([[END], numbers, np.zeros(pad, numbers.dtype)])[: lanes * length].reshape(lanes, length).T
        h = np.zeros((lanes, HIDDEN), _F)
        for t in range(0, length, STEPS):
            slope, h, _ = gradients(
                self.weights, x[t : t + STEPS], y[t : t + STEPS], np.ascontiguousarray(used[t : t + STEPS]), h
            )
            self.update(slope)
        self.tokens += len(numbers)


def score_texts(w: dict[str, np.ndarray], numbers: np.ndarray, bounds: np.ndarray, window: int = 64) -> np.ndarray:
    """Natural log probability of each whole text, its closing 0 included.

    Text i has ``numbers[bounds[i]:bounds[i + 1]]``, one at least. Texts run side by side, the
    longest first, and the state is carried from window to window up to each text's end.
    """
    lengths = np.diff(bounds)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = bounds[:-1][order], lengths[order]
    sums = np.zeros(len(order))
    h = np.zeros((len(order), HIDDEN), _F)
    for begin in range(0, int(lengths[0]) if len(lengths) else 0, window):
        states, targets, owners = [], [], []
        for t in range(begin, min(begin + window, int(lengths[0]))):
            m = int(np.searchsorted(-lengths, -t, "left"))
            at = starts[:m] + t
            x = numbers[at - 1] if t else np.zeros(m, numbers.dtype)
            h = step(w, x, h[:m])[0]
            states.append(h)
            targets.append(numbers[at])
            owners.append(m)
        logs = log_probabilities(w, np.concatenate(states), np.concatenate(targets))
        place = 0
        for m in owners:
            sums[:m] += logs[place : place + m]
            place += m
    out = np.empty(len(order))
    out[order] = sums
    return out
