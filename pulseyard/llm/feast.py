"""Largest eigenpairs of a symmetric matrix by FEAST contour integration, with inertia counts."""

import numpy as np

#: Gauss points on the half circle above the real axis; the other half follows by conjugation.
NODES = 16

#: Eigenvalues that an interval may hold, where values that lie together allow it.
PER_INTERVAL = 2

#: Residual of an eigenpair against the norm of the matrix, and rounds allowed to reach it.
RESIDUAL, ROUNDS = 1e-13, 60


def count_above(matrix: np.ndarray, shift: float) -> int:
    """Number of eigenvalues above ``shift``, by Sylvester's law of inertia.

    The shifted matrix is eliminated symmetrically with pivots of one or two rows (Bunch and Parlett);
    the signs of the pivots are the signs of the eigenvalues.
    """
    a = matrix - shift * np.eye(len(matrix))
    alpha = (1 + np.sqrt(17)) / 8
    above = 0
    while len(a):
        diagonal = np.abs(np.diag(a))
        off = np.abs(a - np.diag(np.diag(a)))
        one = int(diagonal.argmax())
        i, j = np.unravel_index(off.argmax(), off.shape)
        if off[i, j] == 0 and diagonal[one] == 0:
            break
        pivot = [one] if diagonal[one] >= alpha * off[i, j] else [int(i), int(j)]
        rest = np.setdiff1d(np.arange(len(a)), pivot)
        block = a[np.ix_(pivot, pivot)]
        # A pivot of two rows has a negative determinant, hence one eigenvalue of each sign.
        above += int(block[0, 0] > 0) if len(pivot) == 1 else 1
        border = a[np.ix_(rest, pivot)]
        a = a[np.ix_(rest, rest)] - border @ np.linalg.solve(block, border.T)
        a = (a + a.T) / 2
    return above


def intervals(matrix: np.ndarray, wanted: int, top: float, least: float) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside) from the top down until ``wanted`` eigenvalues are held.

    Halving by inertia counts. Values that lie closer than a few roundings stay in one interval.
    """
    found: list[tuple[float, float, int]] = []
    held = 0

    def split(low: float, high: float, inside: int, above: int) -> None:
        nonlocal held
        if held >= wanted or not inside:
            return
        middle = (low + high) / 2
        # Halve also while the interval is wide against its place, so that a contour lies near what it holds.
        tight = inside <= PER_INTERVAL and high - low <= 0.5 * max(abs(low), abs(high))
        if tight or high - low <= 1e-9 * top:
            found.append((low, high, inside))
            held += inside
            return
        upper = count_above(matrix, middle)
        split(middle, high, upper - above, above)
        split(low, middle, inside - (upper - above), upper)

    beyond = count_above(matrix, top)
    split(least, top, count_above(matrix, least) - beyond, beyond)
    return found


def projected(matrix: np.ndarray, basis: np.ndarray, low: float, high: float) -> np.ndarray:
    """The basis filtered to the eigenvectors inside (low, high).

    The spectral projector is the contour integral of the resolvent around the interval; each quadrature
    point costs one complex solve with the shifted matrix.
    """
    centre, radius = (low + high) / 2, (high - low) / 2
    points, weights = np.polynomial.legendre.leggauss(NODES)
    out = np.zeros_like(basis)
    for x, w in zip(points, weights, strict=True):
        turn = np.exp(1j * np.pi * (1 + x) / 2)
        solved = np.linalg.solve((centre + radius * turn) * np.eye(len(matrix)) - matrix, basis.astype(complex))
        out += (w / 2) * np.real(radius * turn * solved)
    return out


def inside(matrix: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs in (low, high), values falling; an error if one of them is missed."""
    size = len(matrix)
    width = min(size, 2 * count + 6)
    norm = np.abs(matrix).sum(axis=1).max()
    basis = np.random.default_rng(7).standard_normal((size, width))
    reached = False
    for _ in range(ROUNDS):
        filtered = projected(matrix, basis, low, high)
        scale = np.linalg.norm(filtered, axis=0)
        filtered = filtered / np.where(scale > 0, scale, 1)
        # Rayleigh-Ritz on an orthonormal basis of what the filter let through.
        orthonormal, _ = np.linalg.qr(filtered)
        values, turned = np.linalg.eigh(orthonormal.T @ matrix @ orthonormal)
        basis = orthonormal @ turned
        within = np.nonzero((values > low) & (values <= high))[0]
        residual = np.linalg.norm(matrix @ basis[:, within] - basis[:, within] * values[within], axis=0)
        good = within[residual <= RESIDUAL * norm * np.sqrt(size)]
        if len(good) == count:
            if reached:
                order = good[::-1]
                return values[order], basis[:, order]
            reached = True  # one round more, for the last digits
    raise ArithmeticError(f"{count} eigenvalues lie in ({low}, {high}), but {len(good)} were found")


def largest(matrix: np.ndarray, wanted: int, least_share: float = 1e-13) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``wanted`` largest eigenvalues, falling, and their unit eigenvectors as columns.

    The matrix must be symmetric without negative eigenvalues, as a covariance is. Eigenvalues of at most
    ``least_share`` of the trace count as zero and are left out. Each vector's largest entry (the first
    among equals) is positive. Inertia counts say how many eigenvalues an interval holds, and every one
    of them is found or an ``ArithmeticError`` raised.
    """
    trace = float(np.trace(matrix))
    if not len(matrix) or not trace > 0:
        return np.zeros(0), np.zeros((len(matrix), 0))
    unit = matrix / trace
    # The top is above all eigenvalues by Gershgorin's circles.
    top = float(np.abs(unit).sum(axis=1).max()) * (1 + 1e-6)
    parts = [inside(unit, low, high, count) for low, high, count in intervals(unit, wanted, top, least_share)]
    if not parts:
        return np.zeros(0), np.zeros((len(matrix), 0))
    values = np.concatenate([v for v, _ in parts])[:wanted]
    vectors = np.concatenate([x for _, x in parts], axis=1)[:, :wanted]
    # Bases of different intervals are orthogonal up to rounding; one more step makes that exact.
    orthonormal, upper = np.linalg.qr(vectors)
    vectors = orthonormal * np.sign(np.diag(upper))
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values * trace, vectors * signs
