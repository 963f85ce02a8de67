"""A small convolutional network over bytes, in numpy.

A filter of width w is a learned table of w x 256 weights; its response at a
byte is the sum of w table entries.  Responses are max-pooled over a window of
bytes, and a dense softmax layer turns the pooled responses into classes.  The
whole of a text is covered: it is dealt into cells of `cell` bytes, windows are
one or more neighbouring cells, and a filter may reach past its cell's end.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Positions whose responses are in memory at once.
STEP = 1 << 15
#: Bytes of a long text that are laid out at once.
LONG = 1 << 20


@dataclass
class ByteCNN:
    """`filters`: one array (width, 256, n) for each width; `dense`: (features, classes)."""

    cell: int
    filters: list[np.ndarray]
    dense: np.ndarray
    bias: np.ndarray

    @classmethod
    def new(cls, cell: int, widths: tuple[int, ...], n: int, classes: int, seed: int = 7) -> ByteCNN:
        random = np.random.default_rng(seed)
        filters = [(random.standard_normal((w, 256, n)) * 0.3).astype(np.float32) for w in widths]
        features = n * len(widths)
        return cls(cell, filters, (random.standard_normal((features, classes)) / np.sqrt(features)).astype(np.float32), np.zeros(classes, np.float32))

    @property
    def reach(self) -> int:
        return max(len(f) for f in self.filters) - 1

    def pool(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pooled responses of every cell, and the number of cells of each text (an empty one has one)."""
        reach = self.reach
        if len(offsets) == 2 and len(data) > LONG:
            size = LONG // self.cell * self.cell
            parts = []
            for at in range(0, len(data), size):
                n = min(size, len(data) - at)
                starts = np.arange(0, n, self.cell)
                laid = np.concatenate([data[at : at + n + reach], np.zeros(reach + 1, np.uint8)])
                parts.append(self._steps(laid, starts, np.minimum(starts + self.cell, n)))
            return np.concatenate(parts), np.array([sum(map(len, parts))])
        sizes = np.diff(offsets)
        n_cells = np.maximum(1, -(-sizes // self.cell))
        # Texts are laid out with zero bytes between, so that filters at their ends see no neighbour.
        places = offsets + np.arange(len(offsets)) * (reach + 1)
        laid = np.zeros(int(places[-1]) + reach + 1, np.uint8)
        if len(data):
            laid[np.repeat(places[:-1] - offsets[:-1], sizes) + np.arange(len(data))] = data
        owner = np.repeat(np.arange(len(sizes)), n_cells)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(n_cells) - n_cells, n_cells)
        starts = places[owner] + number * self.cell
        ends = np.maximum(np.minimum(starts + self.cell, places[owner] + sizes[owner]), starts + 1)
        return self._steps(laid, starts, ends), n_cells

    def _steps(self, laid: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty((len(starts), self.dense.shape[0]), np.float32)
        per_step = max(1, STEP // self.cell)
        for at in range(0, len(starts), per_step):
            to = at + per_step
            self._pool(laid, starts[at:to], ends[at:to], out[at:to])
        return out

    def _pool(self, laid: np.ndarray, starts: np.ndarray, ends: np.ndarray, out: np.ndarray) -> None:
        base = int(starts[0])
        n = int(ends[-1]) - base
        # Between two cells of different texts lie positions that belong to neither.
        cuts = np.stack([starts, ends], 1).ravel() - base
        skip = len(cuts) - 1  # the last end is the end of the array
        column = 0
        for table in self.filters:
            response = np.take(table[0], laid[base : base + n], axis=0)
            for k in range(1, len(table)):
                response += np.take(table[k], laid[base + k : base + k + n], axis=0)
            if (ends[:-1] == starts[1:]).all():
                pooled = np.maximum.reduceat(response, starts - base, axis=0)
            else:
                response = np.concatenate([response, response[-1:]])
                pooled = np.maximum.reduceat(response, cuts[:skip], axis=0)[::2]
            out[:, column : column + table.shape[2]] = pooled
            column += table.shape[2]

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.tanh(pooled) @ self.dense + self.bias

    def train(self, windows: np.ndarray, classes: np.ndarray, epochs: int = 20, batch: int = 64, rate: float = 0.02, seed: int = 7) -> None:
        """Cross-entropy by Adagrad. `windows` has rows of `cell` + reach bytes, zeros after a text's end."""
        random = np.random.default_rng(seed)
        squares = [np.full_like(f, 1e-3) for f in self.filters]
        dense_square, bias_square = np.full_like(self.dense, 1e-3), np.full_like(self.bias, 1e-3)
        for _ in range(epochs):
            order = random.permutation(len(windows))
            for at in range(0, len(order), batch):
                chosen = order[at : at + batch]
                rows, own = windows[chosen], classes[chosen]
                best, pooled = [], []
                for table in self.filters:
                    n = self.cell
                    response = np.take(table[0], rows[:, :n], axis=0)
                    for k in range(1, len(table)):
                        response += np.take(table[k], rows[:, k : k + n], axis=0)
                    response[:, 1:][rows[:, 1:n] == 0] = -1e9  # past the text's end
                    where = response.argmax(1)
                    best.append(where)
                    pooled.append(np.take_along_axis(response, where[:, None, :], 1)[:, 0])
                hidden = np.tanh(np.concatenate(pooled, 1))
                scores = hidden @ self.dense + self.bias
                scores -= scores.max(1, keepdims=True)
                chance = np.exp(scores)
                chance /= chance.sum(1, keepdims=True)
                chance[np.arange(len(own)), own] -= 1
                slope = chance / len(own)
                back = (slope @ self.dense.T) * (1 - hidden**2)
                for value, square, step in ((self.dense, dense_square, hidden.T @ slope + 1e-4 * self.dense), (self.bias, bias_square, slope.sum(0))):
                    square += step**2
                    value -= rate * step / np.sqrt(square)
                column = 0
                for table, square, where in zip(self.filters, squares, best, strict=True):
                    own_back = back[:, column : column + table.shape[2]]
                    column += table.shape[2]
                    lanes = np.broadcast_to(np.arange(table.shape[2]), where.shape)
                    for k in range(len(table)):
                        seen = np.take_along_axis(rows, where + k, 1)
                        step = np.zeros_like(table[k])
                        np.add.at(step, (seen, lanes), own_back)
                        square[k] += step**2
                        table[k] -= rate * step / np.sqrt(square[k])


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def sample_windows(data: np.ndarray, offsets: np.ndarray, size: int, most: int) -> tuple[list[bytes], list[int]]:
    """For training: up to `most` windows of `size` bytes from each text, spread evenly over the whole of it."""
    windows, owner = [], []
    for k in range(len(offsets) - 1):
        start, n = int(offsets[k]), int(offsets[k + 1] - offsets[k])
        count = min(most, max(1, -(-n // size)))
        for w in range(count):
            at = start + (max(0, n - size) * w // max(1, count - 1))
            windows.append(data[at : min(at + size, start + n)].tobytes())
            owner.append(k)
    return windows, owner


def as_rows(windows: list[bytes], size: int) -> np.ndarray:
    """Windows as rows of `size` bytes, filled up with zeros."""
    return np.frombuffer(b"".join(w[:size].ljust(size, b"\0") for w in windows), np.uint8).reshape(-1, size)
