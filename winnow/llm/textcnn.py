"""A convolutional text classifier in numpy: hashed word embeddings, several filter widths, max pooling over a text."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from winnow.llm.textscan import Words

BUCKET_BITS, DIM, FILTERS, WIDTHS = 20, 8, 12, (1, 2, 3)
#: A word has an embedding if so many training texts hold it; every other word is the zero vector.
LEAST_TEXTS = 4
EPOCHS, RATE, DECAY = 8, 0.05, 1e-5
_PAD = max(WIDTHS) - 1


#: Code points of the character n-grams that are hashed beside each word, those at its beginning: a rare form shares
#: them with the other forms of its stem.
PREFIXES = (4, 5)


def buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def features(words: Words) -> np.ndarray:
    """For each word a row of buckets: the word's and its prefixes'; a word's vector is the sum of theirs."""
    return np.stack([buckets(words.hashes()), *(buckets(words.prefix_hashes(k)) for k in PREFIXES)], axis=1)


@dataclass
class Model:
    #: A row for each known bucket, after row 0 of zeros for all others; and the row of each bucket.
    embedding: np.ndarray
    row: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    weight: np.ndarray
    offset: float
    #: By language, as told from the text: the logit at which the score is one half.
    threshold: dict[str, float] = field(default_factory=dict)

    def logits(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of texts whose words have the features ``words[first[i]:first[i + 1]]``; an empty text is one unknown word."""
        n = np.maximum(np.diff(first), 1)
        size = n + _PAD  # zero vectors part the texts, so no window sees two
        at = np.cumsum(size) - size
        x = np.zeros((int(size.sum()), DIM), np.float32)
        doc = np.repeat(np.arange(len(n)), np.diff(first))
        total = self.embedding[self.row[words[:, 0]]]
        for k in range(1, words.shape[1]):
            total += self.embedding[self.row[words[:, k]]]
        x[at[doc] + np.arange(len(words)) - first[doc]] = total
        rows = len(x) - _PAD
        pooled = []
        for width, w, b in zip(WIDTHS, self.filters, self.bias, strict=True):
            y = x[:rows] @ w[:DIM]
            for k in range(1, width):
                y += x[k : rows + k] @ w[k * DIM : (k + 1) * DIM]
            pooled.append(np.maximum(np.maximum.reduceat(y, at, axis=0) + b, 0))
        return np.concatenate(pooled, axis=1).astype(np.float64) @ self.weight + self.offset


def _forward(model: Model, ids: np.ndarray):
    x = np.zeros((max(len(ids), 1) + _PAD, DIM), np.float32)
    x[: len(ids)] = model.embedding[ids].sum(axis=1)
    n, outs = max(len(ids), 1), []
    for width, w, b in zip(WIDTHS, model.filters, model.bias, strict=True):
        y = x[:n] @ w[:DIM]
        for k in range(1, width):
            y += x[k : n + k] @ w[k * DIM : (k + 1) * DIM]
        best = y.argmax(axis=0)
        outs.append((best, np.maximum(y[best, np.arange(FILTERS)] + b, 0)))
    return x, outs


@dataclass
class Sums:
    """Adagrad's sums of squared gradients: of each embedding row, of filters and biases, of the last layer."""

    squares: np.ndarray
    dense: list[np.ndarray]
    head: np.ndarray
    offset: float


def start(known: np.ndarray, rng: np.random.Generator) -> tuple[Model, Sums]:
    """An unfitted classifier whose embeddings are those of the buckets marked in ``known``."""
    row = np.zeros(1 << BUCKET_BITS, np.int32)
    row[known] = np.arange(1, int(known.sum()) + 1)
    embedding = np.zeros((int(known.sum()) + 1, DIM), np.float32)
    embedding[1:] = rng.normal(0, 0.1, (len(embedding) - 1, DIM))
    model = Model(embedding, row, [rng.normal(0, 0.3, (k * DIM, FILTERS)).astype(np.float32) for k in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.3, FILTERS * len(WIDTHS)), 0.0)
    return model, Sums(np.full(len(embedding), 1e-3, np.float32), [np.full_like(w, 1e-2) for w in [*model.filters, *model.bias]], np.full_like(model.weight, 1e-2), 1e-2)


def balance_of(share: float) -> dict[int, float]:
    """By label, the weight of a text: classes weigh the same where ``share`` of all texts have label 1."""
    return {1: 0.5 / max(share, 1e-3), 0: 0.5 / max(1 - share, 1e-3)}


def dense_of(model: Model, sums: Sums) -> np.ndarray:
    """All that isn't embeddings, with its sums, as one vector; :func:`set_dense` is its inverse."""
    parts = [*model.filters, *model.bias, model.weight, np.array([model.offset]), *sums.dense, sums.head, np.array([sums.offset])]
    return np.concatenate([p.astype(np.float64).ravel() for p in parts])


def set_dense(model: Model, sums: Sums, values: np.ndarray) -> None:
    at = 0
    for part in [*model.filters, *model.bias, model.weight, None, *sums.dense, sums.head, None]:
        n = 1 if part is None else part.size
        if part is not None:
            part[...] = values[at : at + n].reshape(part.shape)
        elif at + n < len(values):
            model.offset = float(values[at])
        else:
            sums.offset = float(values[at])
        at += n


def learn(model: Model, sums: Sums, texts: list[np.ndarray], labels: np.ndarray, balance: dict[int, float], rng: np.random.Generator) -> None:
    """One pass of stochastic gradient descent over texts of embedding rows, in an order of its own."""
    squares, dense, head = sums.squares, sums.dense, sums.head
    for i in rng.permutation(len(texts)):
        ids = texts[i]
        x, outs = _forward(model, ids)
        pooled = np.concatenate([v for _, v in outs])
        z = float(pooled @ model.weight + model.offset)
        g = balance[int(labels[i])] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[i])
        if abs(g) < 1e-3:
            continue
        back = g * model.weight
        step = g * pooled + DECAY * model.weight
        head += step**2
        model.weight -= RATE * step / np.sqrt(head)
        sums.offset += g * g
        model.offset -= RATE * g / np.sqrt(sums.offset)
        for j, (width, (best, value)) in enumerate(zip(WIDTHS, outs, strict=True)):
            d = np.where(value > 0, back[j * FILTERS : (j + 1) * FILTERS], 0).astype(np.float32)
            live = np.flatnonzero(d)
            if not len(live):
                continue
            window = np.concatenate([x[best[live] + k] for k in range(width)], axis=1)
            dx = model.filters[j][:, live].T * d[live, None]
            step_w = window.T * d[None, live]
            dense[j][:, live] += step_w**2
            model.filters[j][:, live] -= RATE * step_w / np.sqrt(dense[j][:, live])
            dense[len(WIDTHS) + j][live] += d[live] ** 2
            model.bias[j][live] -= RATE * d[live] / np.sqrt(dense[len(WIDTHS) + j][live])
            for k in range(width):
                place = best[live] + k
                inside = place < len(ids)
                word, grad = ids[place[inside]].ravel(), np.repeat(dx[inside, k * DIM : (k + 1) * DIM], ids.shape[1], axis=0)
                own = word > 0
                np.add.at(squares, word[own], (grad[own] ** 2).mean(axis=1))
                np.subtract.at(model.embedding, word[own], RATE * grad[own] / np.sqrt(squares[word[own], None]))


def train(texts: list[np.ndarray], labels: np.ndarray, seed: int = 11) -> Model:
    """Fits the classifier to texts of word features by stochastic gradient descent; classes weigh the same."""
    rng = np.random.default_rng(seed)
    held = np.zeros(1 << BUCKET_BITS, np.int32)
    for t in texts:
        held[np.unique(t)] += 1
    known = held >= LEAST_TEXTS
    known[0] = False  # of words that are too short for a prefix
    model, sums = start(known, rng)
    texts = [model.row[t] for t in texts]  # an unknown word keeps its place, as in scoring
    balance = balance_of(labels.mean() if len(labels) else 0.5)
    for _ in range(EPOCHS):
        learn(model, sums, texts, labels, balance, rng)
    return model
