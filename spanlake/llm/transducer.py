"""Finite transducers run over numpy code arrays.

A transducer is built from a plain step function by exploring its reachable
states.  Texts are cut into fixed chunks; each chunk is a function from the
state before it to the state after it, and these functions are composed by a
parallel prefix scan (doubling).  With every chunk's entry state known, all
chunks of a batch emit their outputs side by side, one column at a time, so
the number of Python steps is the chunk length, not the text length.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable

import numpy as np


class Transducer:
    def __init__(self, start: Hashable, n_classes: int, step: Callable[[Hashable, int], tuple[Hashable, int]]):
        ids: dict[Hashable, int] = {start: 0}
        order, nxt, out = [start], [], []
        at = 0
        while at < len(order):
            row, emit = [], []
            for c in range(n_classes):
                to, o = step(order[at], c)
                if to not in ids:
                    ids[to] = len(order)
                    order.append(to)
                row.append(ids[to])
                emit.append(o)
            nxt.append(row)
            out.append(emit)
            at += 1
        pad = n_classes  # the padding class keeps the state and says nothing
        self.width = n_classes + 1
        self.pad = pad
        self.size = len(order)
        self.next = np.array([[*r, i] for i, r in enumerate(nxt)], dtype=np.int32)
        self.out = np.array([[*r, 0] for r in out], dtype=np.uint8)
        self._next_flat = self.next.ravel()
        self._out_flat = self.out.ravel()

    def chunk_functions(self, grid: np.ndarray) -> np.ndarray:
        """For each column of grid (position, chunk): the state after it, by the state before it."""
        length, n = grid.shape
        images = np.tile(np.arange(self.size, dtype=np.int32), (n, 1))  # distinct states still alive
        back: list[np.ndarray] = []
        for at in range(0, length, 16):
            for j in range(at, min(at + 16, length)):
                images = self._next_flat[images * self.width + grid[j][:, None]]
            if images.shape[1] > 1:  # states merge fast; carry each distinct one once
                order = np.argsort(images, axis=1, kind="stable")
                ranked = np.take_along_axis(images, order, 1)
                group = np.zeros_like(ranked)
                group[:, 1:] = np.cumsum(ranked[:, 1:] != ranked[:, :-1], axis=1)
                to = np.empty_like(group)
                np.put_along_axis(to, order, group, 1)
                alive = np.zeros((n, int(group.max()) + 1), dtype=np.int32)
                np.put_along_axis(alive, group, ranked, 1)
                images = alive
                back.append(to)
        for to in reversed(back):
            images = np.take_along_axis(images, to, 1)
        return images

    @staticmethod
    def prefix_compose(functions: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Inclusive scan: row i becomes the composition of its document's rows up to i."""
        done, reach = functions.copy(), 1
        while reach < len(done):
            same = np.flatnonzero(doc[reach:] == doc[:-reach]) + reach
            if not len(same):
                break
            done[same] = np.take_along_axis(done[same], done[same - reach], 1)
            reach *= 2
        return done

    def run(self, classes: np.ndarray, lengths: np.ndarray, chunk: int = 512) -> np.ndarray:
        """Outputs for texts laid end to end; each starts in the start state."""
        total = int(lengths.sum())
        if not total:
            return np.zeros(0, dtype=np.uint8)
        pieces = np.maximum(1, -(-lengths // chunk))
        doc = np.repeat(np.arange(len(lengths)), pieces)
        first = np.cumsum(pieces) - pieces
        k = np.arange(len(doc)) - first[doc]
        begin = (np.cumsum(lengths) - lengths)[doc] + k * chunk
        size = np.minimum(chunk, lengths[doc] - k * chunk)
        column = np.arange(min(chunk, int(size.max())))[:, None]
        inside = column < size[None, :]
        where = np.where(inside, begin[None, :] + column, 0)
        grid = np.where(inside, classes[where], self.pad).astype(np.int32)
        state = np.zeros(len(doc), dtype=np.int32)
        ahead = np.flatnonzero(k < pieces[doc] - 1)  # chunks that others follow
        if len(ahead):
            scanned = self.prefix_compose(self.chunk_functions(grid[:, ahead]), doc[ahead])
            state[ahead + 1] = scanned[:, 0]
        said = np.zeros(grid.shape, dtype=np.uint8)
        for j in range(len(grid)):
            at = state * self.width + grid[j]
            said[j] = self._out_flat[at]
            state = self._next_flat[at]
        out = np.zeros(total, dtype=np.uint8)
        out[where[inside]] = said[inside]
        return out
