"""Heat traces of graphs.

The normalised adjacency M of a (magnetic) Laplacian L = I - M has its spectrum in [-1, 1], so
exp(-t L) = sum_k c_k(t) T_k(M) with Chebyshev polynomials T_k, and 40 of them give times up to 10 to
machine precision. The trace needs only the moments tr T_k(M): the recurrence is applied to blocks of unit
vectors by sparse products, and since 2 T_j T_k = T_{j+k} + T_{|j-k|}, twenty steps give forty moments. Blocks
are independent and their moments add up, so no matrix of nodes by nodes is ever held.

The non-backtracking trace takes |eigenvalues|, which no short polynomial gives. But the matrix is of low
rank apart from edges that have a reverse: heads and tails span all others, so its spectrum is that of a
matrix of size 2 * nodes + edges with a reverse, instead of edges by edges.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

# Diffusion times, and the phase of the magnetic Laplacian.
TIME_POINTS = 250
TIMES = np.logspace(-2, 1, TIME_POINTS)
MAGNETIC_PHASE = 0.25

STEPS = 20
MOMENTS = 2 * STEPS + 1
BLOCK = 64  # unit vectors of one task
_CELLS = 1 << 22  # products held at once


def _coefficients() -> np.ndarray:
    """c_k(t) for all times: exp(t (cos a - 1)) as a cosine series in a."""
    angles = (np.arange(512) + 0.5) * np.pi / 512
    k = np.arange(MOMENTS)
    series = np.exp(TIMES[:, None] * (np.cos(angles) - 1)) @ np.cos(np.outer(angles, k)) / 512
    return series * np.where(k == 0, 1.0, 2.0)


_HEAT = _coefficients()


def traces_of(moments: np.ndarray, n: int) -> np.ndarray:
    """Heat trace per node from the moments of all blocks."""
    return _HEAT @ moments / max(n, 1)


class Sparse:
    """A square matrix by its entries, multiplied with blocks of vectors."""

    def __init__(self, n: int, row: np.ndarray, column: np.ndarray, value: np.ndarray):
        order = np.argsort(row, kind="stable")
        self.n, self.column, self.value = n, column[order], value[order]
        self.rows, self.starts = np.unique(row[order], return_index=True)

    def __matmul__(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, x.shape[1]), np.result_type(self.value, x))
        if len(self.rows):
            out[self.rows] = np.add.reduceat(self.value[:, None] * x[self.column], self.starts, axis=0)
        return out

    def moments(self, units: np.ndarray) -> np.ndarray:
        """The share of these unit vectors in tr T_k for all k."""
        total = np.zeros(MOMENTS)
        width = max(1, _CELLS // max(len(self.value), self.n, 1))
        for at in range(0, len(units), width):
            own = units[at:at + width]
            before = np.zeros((self.n, len(own)), self.value.dtype)
            before[own, np.arange(len(own))] = 1.0
            now = self @ before
            first = np.vdot(before, now).real
            total[0] += len(own)
            total[1] += first
            for k in range(1, STEPS + 1):
                total[2 * k] += 2 * np.vdot(now, now).real - len(own)
                if 2 * k + 1 < MOMENTS:
                    before, now = now, 2 * (self @ now) - before
                    total[2 * k + 1] += 2 * np.vdot(before, now).real - first
        return total


def adjacencies(pdf: pd.DataFrame, q: float = MAGNETIC_PHASE) -> tuple[int, Sparse, Sparse]:
    """Number of nodes and the normalised adjacency, plain and magnetic: direction enters as a phase."""
    names, ends = np.unique(np.concatenate([pdf["src"].to_numpy(str), pdf["dst"].to_numpy(str)]), return_inverse=True)
    n, m = len(names), len(pdf)
    u, v, w = ends[:m], ends[m:], pdf["weight"].to_numpy(float)
    key, place = np.unique(np.concatenate([u * n + v, v * n + u]), return_inverse=True)
    there, back = (np.bincount(place, x, len(key)) for x in (np.r_[w, np.zeros(m)], np.r_[np.zeros(m), w]))
    row, column, both = key // n, key % n, there + back
    degree = np.bincount(row, both, n)
    scale = np.zeros(n)
    np.divide(1.0, np.sqrt(degree), out=scale, where=degree > 0)
    value = both * scale[row] * scale[column]
    lean = np.zeros(len(key))
    np.divide(there - back, both, out=lean, where=both > 0)
    return n, Sparse(n, row, column, value), Sparse(n, row, column, value * np.exp(2j * np.pi * q * lean))


def block_moments(pdf: pd.DataFrame) -> pd.DataFrame:
    """Moments of one block of unit vectors of one graph, plain and magnetic."""
    block = int(pdf["block"].iloc[0])
    n, plain, turned = adjacencies(pdf)
    units = np.arange(block * BLOCK, min(n, (block + 1) * BLOCK))
    return pd.DataFrame({
        "graph_id": [pdf["graph_id"].iloc[0]], "n": [n], "plain": [plain.moments(units)], "turned": [turned.moments(units)]})


def hashimoto(pdf: pd.DataFrame) -> np.ndarray:
    """Trace over |eigenvalues| of the symmetrised non-backtracking edge matrix, per edge.

    With heads T and weighted tails S, the matrix is (T S + S' T') / 2 less what turns back. U = [T, S'] holds
    all rows; those of edges without a reverse act only through U' U.
    """
    pdf = pdf.groupby(["src", "dst"], as_index=False)["weight"].sum()
    pdf = pdf[pdf["weight"] != 0]
    m = len(pdf)
    if m == 0:
        return np.zeros(TIME_POINTS)
    names, ends = np.unique(np.concatenate([pdf["src"].to_numpy(str), pdf["dst"].to_numpy(str)]), return_inverse=True)
    n, u, v, w = len(names), ends[:m], ends[m:], pdf["weight"].to_numpy(float)
    code = u * n + v
    order = np.argsort(code)
    at = np.searchsorted(code[order], v * n + u).clip(max=m - 1)
    reverse = np.where(code[order][at] == v * n + u, order[at], -1)
    two = np.flatnonzero(reverse >= 0)
    one = np.flatnonzero(reverse < 0)
    gram = np.zeros((2 * n, 2 * n))
    np.add.at(gram, (v[one], v[one]), 1.0)
    np.add.at(gram, (n + u[one], n + u[one]), w[one] ** 2)
    np.add.at(gram, (v[one], n + u[one]), w[one])
    np.add.at(gram, (n + u[one], v[one]), w[one])
    values, vectors = np.linalg.eigh(gram)
    kept = values > 1e-12 * max(values.max(), 1.0)
    root = np.sqrt(values[kept])[:, None] * vectors[:, kept].T  # root' root = gram
    rows = np.zeros((len(two), 2 * n))
    rows[np.arange(len(two)), v[two]] = 1.0
    rows[np.arange(len(two)), n + u[two]] = w[two]
    basis = np.vstack([root, rows])
    swapped = np.concatenate([basis[:, n:], basis[:, :n]], axis=1) / 2
    matrix = basis @ swapped.T
    place = np.full(m, -1)
    place[two] = len(root) + np.arange(len(two))
    matrix[place[two], place[reverse[two]]] -= (w[two] + w[reverse[two]]) / 2
    eigenvalues = np.abs(np.linalg.eigvalsh(matrix))
    return (np.exp(-np.outer(eigenvalues, TIMES)).sum(axis=0) + (m - len(matrix))) / m


def hashimoto_traces(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"graph_id": [pdf["graph_id"].iloc[0]], "hashimoto": [hashimoto(pdf)]})
