"""A small gated recurrent language model in numpy: class-factored softmax, truncated backpropagation through time.

Documents run in lanes side by side. A window is STEPS tokens of every lane that goes on; the state is carried from
window to window and cleared where a document begins, so that a document is scored as a whole, whatever its length.
"""

from __future__ import annotations

import heapq

import numpy as np

STEPS = 16
LANES = 512
#: Tokens of a softmax over classes, and parameters of a step, at once: what a processor's own memory holds.
BLOCK, PART = 2048, 1 << 15
#: Tokens that are scored at once, at least.
SCORED = 8192
#: How many classes there are of each size, in multiples of the least; the rest are of the largest.
TIERS = ((1, 8), (2, 12), (4, 24), (8, None))


def class_bounds(words: int, least: int) -> list[int]:
    """Where classes of words begin, and where the last ends. Frequent words share small classes, so a token costs few exponentials."""
    bounds = [0]
    for times, count in TIERS:
        while bounds[-1] < words and count != 0:
            bounds.append(min(words, bounds[-1] + times * least))
            count = None if count is None else count - 1
    return bounds


class Model:
    """Ids below size - 1 are words, ordered by frequency, and lie in classes that follow each other; the last id stands for all other words and is a class of its own. first stands before a document.

    States lie with one row for each of their numbers, so that gates are contiguous. The last row of wx, wc and of each
    class in wo is a bias.
    """

    def __init__(self, size: int, first: int, width: int = 12, per_class: int = 32, flat: np.ndarray | None = None, counts: np.ndarray | None = None):
        self.size, self.first, self.width = size, first, width
        self.begins = np.array([*class_bounds(size - 1, per_class), size])
        self.sizes = np.diff(self.begins)
        self.classes = len(self.sizes)
        self.class_of = np.repeat(np.arange(self.classes), self.sizes)
        self.place = np.arange(size) - self.begins[self.class_of]
        h, c = width, self.classes
        shapes = [(size, h), (h + 1, 3 * h), (h, 3 * h), (h + 1, c), *((h + 1, n) for n in self.sizes.tolist())]
        self.bounds = np.cumsum([0, *(int(np.prod(x)) for x in shapes)])
        self.shapes = shapes
        self.flat = np.zeros(self.bounds[-1], dtype=np.float32) if flat is None else np.array(flat, dtype=np.float32)
        self.views(self.flat, "")
        if flat is None:
            rng = np.random.default_rng(11)
            for x in (self.embed, self.wx[:h], self.wh):
                x[:] = rng.normal(0, 0.5 / np.sqrt(h), x.shape)
            # the biases begin as the counts have it: before training the model is the corpus' word frequencies
            n = (np.ones(size) if counts is None else counts) + 1e-3
            for i, (low, high) in enumerate(zip(self.begins[:-1], self.begins[1:])):
                self.wc[h, i] = np.log(n[low:high].sum())
                self.wo[i][h] = np.log(n[low:high] / n[low:high].sum())

    def views(self, flat: np.ndarray, prefix: str) -> None:
        found = [flat[low:high].reshape(shape) for low, high, shape in zip(self.bounds[:-1], self.bounds[1:], self.shapes)]
        for name, x in zip(("embed", "wx", "wh", "wc"), found):
            setattr(self, prefix + name, x)
        setattr(self, prefix + "wo", found[4:])

    def run(self, before: np.ndarray, kept: np.ndarray, h: np.ndarray, keep: bool):
        """States of a window. before: ids that went before (STEPS, lanes); kept: 0 where a document begins; h: (width, lanes)."""
        w, (steps, lanes) = self.width, before.shape
        # what a word adds to the gates
        px = (self.embed @ self.wx[:w] + self.wx[w])[before] if self.size < before.size else self.embed[before] @ self.wx[:w] + self.wx[w]
        px = np.ascontiguousarray(px.transpose(0, 2, 1))
        states = np.empty((steps, w, lanes), dtype=np.float32)
        whole, wh, saved = kept.all(1).tolist(), np.ascontiguousarray(self.wh.T), []
        for t in range(steps):
            if not whole[t]:
                h = h * kept[t]
            g = wh @ h
            gate = px[t, : 2 * w] + g[: 2 * w]
            gate *= 0.5
            np.tanh(gate, out=gate)
            gate += 1
            gate *= 0.5
            z, r, u = gate[:w], gate[w:], g[2 * w :]
            n = r * u
            n += px[t, 2 * w :]
            np.tanh(n, out=n)
            new = states[t]
            np.subtract(h, n, out=new)
            new *= z
            new += n
            if keep:
                saved.append((h, z, r, u, n))
            h = new
        return states, saved

    def score(self, states: np.ndarray, target: np.ndarray, grads: bool = False, scale: float = 1.0):
        """Natural log-probabilities of target words after states (tokens, width); with grads also the gradient of the states, and own gradients added up.

        Tokens are sorted by class, so that each class has its own run of rows. Weights are too small (the gradient is
        clipped) for the exponentials to overflow, so no maximum is taken off.
        """
        cls, w, n = self.class_of[target], self.width, len(target)
        order = np.argsort(cls.astype(np.int16), kind="stable")
        cls, word, rows = cls[order], self.place[target][order], np.arange(n)
        s = np.ones((n, w + 1), dtype=np.float32)
        s[:, :w] = states[order]
        cuts = np.searchsorted(cls, np.arange(self.classes + 1)).tolist()
        # a class of one word is certain
        found, total, d_inner = np.zeros(n, dtype=np.float32), np.ones(n, dtype=np.float32), np.zeros((n, w), dtype=np.float32)
        for c, (low, high) in enumerate(zip(cuts[:-1], cuts[1:])):
            if low < high and self.sizes[c] > 1:
                at = slice(low, high)
                self.softmax(s[at], self.wo[c], word[at], rows[: high - low], found[at], total[at], d_inner[at], self.d_wo[c] if grads else None, scale)
        outer, sums, d_sorted = np.empty(n, dtype=np.float32), np.empty(n, dtype=np.float32), np.empty((n, w), dtype=np.float32)
        for low in range(0, n, BLOCK):
            at = slice(low, low + BLOCK)
            self.softmax(s[at], self.wc, cls[at], rows[: len(cls[at])], outer[at], sums[at], d_sorted[at], self.d_wc if grads else None, scale)
        found += outer
        found -= np.log(total)
        found -= np.log(sums)
        out = np.empty_like(found)
        out[order] = found
        if not grads:
            return out
        d_sorted *= (scale / sums)[:, None]
        d_inner *= (scale / total)[:, None]
        d_sorted += d_inner
        d = np.empty_like(d_sorted)
        d[order] = d_sorted
        return out, d

    def softmax(self, s: np.ndarray, weights: np.ndarray, hit: np.ndarray, rows: np.ndarray, found: np.ndarray, total: np.ndarray, d: np.ndarray, grad: np.ndarray | None, scale: float) -> None:
        """For each row of s, what weights give hit into found and the sum of all exponentials into total; with grad the gradient of s, to be multiplied by scale / total, into d, and that of weights is added to grad."""
        x = s @ weights
        found[:] = x[rows, hit]
        np.exp(x, out=x)
        np.dot(x, np.ones(x.shape[1], dtype=np.float32), out=total)
        if grad is not None:
            x[rows, hit] -= total
            np.matmul(x, weights[:-1].T, out=d)
            grad += (s * (scale / total)[:, None]).T @ x

    def back(self, before: np.ndarray, kept: np.ndarray, saved: list, d_states: np.ndarray) -> None:
        """Backpropagation through one window; it ends where the window begins. d_states: (STEPS, width, lanes)."""
        w, (steps, lanes) = self.width, before.shape
        dh = np.zeros((w, lanes), dtype=np.float32)
        d_px, d_g = (np.empty((steps, 3 * w, lanes), dtype=np.float32) for _ in range(2))
        whole = kept.all(1).tolist()
        for t in range(steps - 1, -1, -1):
            h, z, r, u, n = saved[t]
            dh += d_states[t]
            d, dg = d_px[t], d_g[t]
            d[:w] = dh * (h - n) * z * (1 - z)
            dn = dh * (1 - z) * (1 - n * n)
            d[2 * w :] = dn
            d[w : 2 * w] = dn * u * r * (1 - r)
            dg[: 2 * w] = d[: 2 * w]
            np.multiply(dn, r, out=dg[2 * w :])
            dh *= z
            dh += self.wh @ dg
            if not whole[t]:
                dh *= kept[t]
        for t in range(steps):
            self.d_wh += saved[t][0] @ d_g[t].T
        flat, ids = d_px.transpose(0, 2, 1).reshape(-1, 3 * w), before.reshape(-1)
        order = np.argsort(ids.astype(np.int32), kind="stable")
        found, start = np.unique(ids[order], return_index=True)
        by_word = np.add.reduceat(flat[order], start, axis=0)
        self.d_wx[:w] += self.embed[found].T @ by_word
        self.d_wx[w] += by_word.sum(0)
        self.d_embed[found] += by_word @ self.wx[:w].T


def lanes(lengths: np.ndarray, count: int = LANES) -> list[np.ndarray]:
    """Documents dealt to lanes of about equal length, longest first; the longest lane comes first."""
    count = max(1, min(count, len(lengths)))
    total, dealt = np.zeros(count, dtype=np.int64), [[] for _ in range(count)]
    heap = [(0, i) for i in range(count)]
    for d in np.argsort(-lengths, kind="stable").tolist():
        n, i = heapq.heappop(heap)
        dealt[i].append(d)
        total[i] = n + int(lengths[d])
        heapq.heappush(heap, (int(total[i]), i))
    return [np.array(dealt[i], dtype=np.int64) for i in np.argsort(-total, kind="stable") if dealt[i]]


def windows(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: int, steps: int = STEPS):
    """For each window of the lanes: the words, the words before them, 0 where a document begins, where there is a token, and its document."""
    dealt = lanes(lengths)
    order = np.concatenate(dealt)
    long = np.array([lengths[own].sum() for own in dealt])
    offset = np.cumsum(long) - long
    # a slice of texts has fewer than 2^31 tokens
    doc = np.repeat(order.astype(np.int32), lengths[order])
    place = np.repeat((starts[order] - (np.cumsum(lengths[order]) - lengths[order])).astype(np.int32), lengths[order])
    place += np.arange(len(doc), dtype=np.int32)
    word = ids.astype(np.int32, copy=False)[place]
    del place
    begins = np.concatenate([[True], doc[1:] != doc[:-1]])
    before = np.concatenate([np.array([first], dtype=np.int32), word[:-1]])
    before[begins] = first
    begins = (~begins).astype(np.float32)
    for low in range(0, int(long[0]), steps):
        going = int((long > low).sum())
        t = low + np.arange(steps)[:, None]
        there = t < long[:going]
        at = offset[:going] + np.minimum(t, long[:going] - 1)
        yield word[at], before[at], begins[at], there, doc[at]


def document_scores(model: Model, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Natural log-probability of each document. Every document has a token at least."""
    out, h, held, tokens = np.zeros(len(lengths)), None, [], 0

    def add() -> None:
        states, words, own = (np.concatenate(x) for x in zip(*held))
        out[:] += np.bincount(own, model.score(states, words), len(out))

    for word, before, kept, there, doc in windows(ids, starts, lengths, model.first):
        h = np.zeros((model.width, word.shape[1]), dtype=np.float32) if h is None else h[:, : word.shape[1]]
        states, _ = model.run(before, kept, h, False)
        h = states[-1]
        held.append((states.transpose(0, 2, 1)[there], word[there], doc[there]))
        tokens += len(held[-1][1])
        # windows of few tokens, as long documents' ends are, are scored together
        if tokens >= SCORED:
            add()
            held, tokens = [], 0
    if held:
        add()
    return out


class Trainer:
    """Adam over windows. Windows of few tokens, as long documents' ends are, add up their gradients until they have LEAST tokens together; steps of fewer than FULL are the smaller."""

    LEAST, FULL = 512, 4096

    def __init__(self, model: Model, rate: float = 0.01):
        self.model, self.rate, self.step, self.tokens = model, rate, 0, 0
        self.grad, self.m, self.v = (np.zeros_like(model.flat) for _ in range(3))
        model.views(self.grad, "d_")

    def learn(self, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        model, h, held = self.model, None, []
        for word, before, kept, there, _ in windows(ids, starts, lengths, model.first):
            h = np.zeros((model.width, word.shape[1]), dtype=np.float32) if h is None else h[:, : word.shape[1]]
            states, saved = model.run(before, kept, h, True)
            h = states[-1]
            held.append((word, before, kept, there, states, saved))
            self.tokens += int(there.sum())
            if self.tokens >= self.LEAST:
                self.add(held)
                self.adam()
                held = []
        if held:
            self.add(held)
            self.adam()

    def add(self, held: list[tuple]) -> None:
        """Adds up the gradients of windows that the same parameters ran through, side by side."""
        model = self.model
        word, before, kept, there = (np.concatenate(x, axis=1) for x in list(zip(*held))[:4])
        states = np.concatenate([x[4] for x in held], axis=2)
        saved = held[0][5] if len(held) == 1 else [tuple(np.concatenate(x, axis=1) for x in zip(*step)) for step in zip(*(x[5] for x in held))]
        _, d = model.score(states.transpose(0, 2, 1)[there], word[there], True)
        d_states = np.zeros((*word.shape, model.width), dtype=np.float32)
        d_states[there] = d
        model.back(before, kept, saved, d_states.transpose(0, 2, 1))

    def adam(self) -> None:
        """One step by the mean gradient of the tokens since the last. m and v are ten and a hundred times the means."""
        self.step += 1
        share = min(1.0, self.tokens / self.FULL)
        mean = np.float32(1 / (self.tokens * max(1.0, float(np.sqrt(self.grad @ self.grad)) / self.tokens)))
        rate = np.float32(self.rate * share * np.sqrt(1 - 0.99**self.step) / (1 - 0.9**self.step))
        for low in range(0, len(self.grad), PART):
            g, m, v, flat = (x[low : low + PART] for x in (self.grad, self.m, self.v, self.model.flat))
            g *= mean
            m *= np.float32(0.9)
            m += g
            g *= g
            v *= np.float32(0.99)
            v += g
            # 0.1 m / (sqrt(0.01 v) + 1e-6)
            np.sqrt(v, out=g)
            g += np.float32(1e-5)
            np.divide(m, g, out=g)
            g *= rate
            flat -= g
            g[:] = 0
        self.tokens = 0
