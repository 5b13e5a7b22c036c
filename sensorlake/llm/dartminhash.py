"""Weighted minwise signatures by throwing darts, for many documents at a time.

Over each element stands a region as wide as its weight. Hashing throws darts into the plane of weight and rank, one
per unit of area on average and the same ones for every document. A dart that falls below the element's weight belongs
to the document; it also names one of k coordinates, and each coordinate keeps the dart of the lowest rank. Two
documents keep the same dart with the probability of their weighted Jaccard similarity. Only ranks up to about
(k ln k + 3k) / total weight are looked at, so a signature takes about k ln k darts, however long the text is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

U = np.uint64
#: Ranks are cut into cells: [0, 2^-10), and from there on each as long as all before it.
FINEST = -10
#: Documents and rows that darts are thrown for at a time; a document takes about k ln k + 3k of them.
DOCUMENTS, ELEMENTS = 256, 200_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Uniform in [0, 1) from the upper bits."""
    return (x >> U(11)).astype(np.float64) * 2.0**-53


@lru_cache(maxsize=64)
def poisson(exponent: int) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2, ... darts in an area of 2^exponent."""
    mean = 2.0**exponent
    most = int(mean + 12 * mean**0.5 + 24)
    logs = np.arange(most + 1) * np.log(mean) - mean - np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, most + 1)))])
    return np.cumsum(np.exp(logs))


def signatures(document: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """(n, k) uint64 signatures. Row r of the input says that ``document[r]`` holds ``element[r]`` (a 64-bit hash) with
    ``weight[r]`` > 0; a document's elements differ. Every document below n must hold something."""
    total = np.bincount(document, weight, n)
    limit = (k * np.log(k) + 3 * k) / total
    out = np.full((n, k), np.iinfo(np.uint64).max, U)
    todo = np.ones(n, bool)
    while todo.any():
        for rows in portions(document, todo):
            throw(document[rows], element[rows], weight[rows], limit, out)
        # nearly always filled at once; else again, with twice the ranks
        todo = (out == np.iinfo(np.uint64).max).any(axis=1)
        out[todo] = np.iinfo(np.uint64).max
        limit = np.where(todo, 2 * limit, limit)
    return out


def portions(document: np.ndarray, todo: np.ndarray) -> Iterator[np.ndarray]:
    """The rows of documents to do, few documents and few rows at a time. Each dart counts by itself, so a document's
    darts may be thrown in several portions."""
    rows = np.flatnonzero(todo[document])
    rows = rows[np.argsort(document[rows], kind="stable")]
    first = np.flatnonzero(np.append(True, np.diff(document[rows]) != 0)) if len(rows) else rows
    for a, b in zip(first[::DOCUMENTS], np.append(first[DOCUMENTS::DOCUMENTS], len(rows))):
        for k in range(a, b, ELEMENTS):
            yield rows[k : min(b, k + ELEMENTS)]


def throw(document: np.ndarray, element: np.ndarray, weight: np.ndarray, limit: np.ndarray, out: np.ndarray) -> None:
    k = U(out.shape[1])
    flat = out.reshape(-1)
    column = 0
    while True:  # weights [2^column - 1, 2^(column + 1) - 1)
        low = 2.0**column - 1
        own = np.flatnonzero(weight > low)
        if not len(own):
            return
        document, element, weight = document[own], element[own], weight[own]
        partial = bool((weight < low + 2.0**column).any())
        cell = 0
        most = limit[document]
        live = np.arange(len(document))
        while True:  # ranks from start on
            start = 0.0 if not cell else 2.0 ** (FINEST + cell - 1)
            live = live[most[live] > start]
            if not len(live):
                break
            height = FINEST + max(0, cell - 1)
            place = mix(element[live] + U((column << 8 | cell) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            count = np.searchsorted(poisson(column + height), unit(place), "right")
            hit = np.flatnonzero(count)
            count = count[hit]
            dart = np.repeat(place[hit], count)
            number = np.arange(len(dart)) - np.repeat(np.cumsum(count) - count, count)
            dart = mix(dart ^ mix((number + 1).astype(U)))
            of = np.repeat(live[hit], count)
            rank = start + 2.0**height * unit(mix(dart + U(1)))
            kept = rank <= most[of]
            if partial:  # the last column of an element may be wider than its weight
                kept &= low + 2.0**column * unit(mix(dart + U(2))) < weight[of]
            dart, of, rank = dart[kept], of[kept], rank[kept]
            value = rank.astype(np.float32).view(np.uint32).astype(U) << U(32) | dart >> U(32)
            coordinate = (dart & U(0xFFFFFFFF)) * k >> U(32)
            np.minimum.at(flat, document[of] * int(k) + coordinate.astype(np.int64), value)
            cell += 1
        column += 1
