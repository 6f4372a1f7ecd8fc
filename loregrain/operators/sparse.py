"""Nearest neighbours between two blocks of sparse vectors, as a task's helper."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Documents of a side that are multiplied at a time.
TILE = 1024
#: Terms in more than this part of a block's documents are multiplied as dense columns, the others entry by entry.
DENSE = 0.05


class Block:
    """Documents as one list of (row, term, weight) by term, weights of length 1."""

    def __init__(self, batches: list[pa.RecordBatch]):
        self.ids = np.concatenate([b.column("doc_id").to_numpy(zero_copy_only=False) for b in batches])
        sizes = np.concatenate([b.column("terms").value_lengths().to_numpy(zero_copy_only=False) for b in batches])
        self.terms = np.concatenate([b.column("terms").flatten().to_numpy() for b in batches])
        weights = np.concatenate([b.column("weights").flatten().to_numpy() for b in batches])
        self.rows = np.repeat(np.arange(len(sizes)), sizes)
        length = np.sqrt(np.bincount(self.rows, weights * weights, len(sizes)))
        self.weights = weights / length[self.rows]

    def tiles(self, numbers: np.ndarray, dense: np.ndarray) -> list[tuple]:
        """Of each TILE rows: the first row, a matrix of dense terms, and the other terms' entries by term. numbers: of each entry its term's; dense: of each term its column or -1."""
        out = []
        for low in range(0, len(self.ids), TILE):
            at = slice(*np.searchsorted(self.rows, [low, low + TILE]))
            row, term, weight = self.rows[at] - low, numbers[at], self.weights[at]
            column = dense[term]
            full = column >= 0
            matrix = np.zeros((min(TILE, len(self.ids) - low), int(dense.max(initial=-1)) + 1))
            np.add.at(matrix, (row[full], column[full]), weight[full])
            row, term, weight = row[~full], term[~full], weight[~full]
            by = np.argsort(term, kind="stable")
            out.append((low, matrix, row[by], term[by], weight[by]))
        return out


def _scores(a: tuple, b: tuple) -> np.ndarray:
    """Cosines of a tile's rows with another's, to six places."""
    _, left, rows, terms, weights = a
    _, right, other_rows, other_terms, other_weights = b
    scores = left @ right.T
    first, last = np.searchsorted(other_terms, terms, "left"), np.searchsorted(other_terms, terms, "right")
    n = last - first
    each = np.repeat(np.arange(len(terms)), n)
    partner = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    place = rows[each] * len(right) + other_rows[partner]
    scores += np.bincount(place, weights[each] * other_weights[partner], scores.size).reshape(scores.shape)
    return np.round(scores, 6)


class Best:
    """Of each row the k best partners so far; partners come by rising id, so that the first of equal ones stays."""

    def __init__(self, n: int, k: int):
        self.score, self.at, self.k = np.zeros((n, k)), np.full((n, k), -1), k

    def take(self, low: int, scores: np.ndarray, partner: int) -> None:
        """Scores of rows from low on with partners from partner on; scores is used up."""
        every = np.arange(len(scores))
        score, at = self.score[low : low + len(scores)], self.at[low : low + len(scores)]
        for _ in range(min(self.k, scores.shape[1])):
            column = scores.argmax(axis=1)
            found = scores[every, column]
            on = found > score[:, -1]
            if not on.any():
                break
            scores[every, column] = -1
            # the worst one makes way, and the new one stands behind its equals
            score[on, -1], at[on, -1] = found[on], column[on] + partner
            by = np.argsort(-score[on], axis=1, kind="stable")
            score[on], at[on] = np.take_along_axis(score[on], by, 1), np.take_along_axis(at[on], by, 1)

    def rows(self, ids: np.ndarray, others: np.ndarray) -> pa.RecordBatch:
        row, place = np.nonzero(self.score > 0)
        return pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(others[self.at[row, place]]), pa.array(self.score[row, place])], ["doc_id", "other_id", "score"])


def nearest_rows(first: list[pa.RecordBatch], second: list[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, other_id, score) of the k nearest: of each of a block's documents in the block, or in the other block where there are two. Batches are sorted by doc_id."""
    if not first:
        return
    a, b = Block(first), Block(second) if second else None
    terms = [x.terms for x in (a, b) if x]
    size = sum(len(x.ids) for x in (a, b) if x)
    _, numbers, df = np.unique(np.concatenate(terms), return_inverse=True, return_counts=True)
    often = df > max(DENSE * size, 1)
    dense = np.where(often, np.cumsum(often) - 1, -1)
    best = Best(len(a.ids), k)
    tiles = a.tiles(numbers[: len(a.terms)], dense)
    if b is None:
        for i, x in enumerate(tiles):
            for y in tiles[i:]:
                scores = _scores(x, y)
                if x is y:
                    scores[a.ids[x[0] : x[0] + len(scores), None] == a.ids[None, x[0] : x[0] + len(scores)]] = 0
                else:
                    best.take(y[0], scores.T.copy(), x[0])
                best.take(x[0], scores, y[0])
        yield best.rows(a.ids, a.ids)
        return
    back = Best(len(b.ids), k)
    others = b.tiles(numbers[len(a.terms) :], dense)
    for x in tiles:
        for y in others:
            scores = _scores(x, y)
            back.take(y[0], scores.T.copy(), x[0])
            best.take(x[0], scores, y[0])
    yield best.rows(a.ids, b.ids)
    yield back.rows(b.ids, a.ids)
