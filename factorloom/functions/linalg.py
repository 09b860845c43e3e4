"""Small dense kernels on NumPy arrays: what a grouped task runs on one model's matrices."""

from __future__ import annotations

import numpy as np

Array = np.ndarray


def eigen_descending(matrix: Array) -> tuple[Array, Array]:
    """Eigenvalues from the largest down and their vectors as columns, each with its largest entry positive."""
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values, vectors * np.where(signs == 0, 1, signs)


def positive_definite(matrix: Array, least: float = 1e-12) -> Array:
    """The symmetric part with eigenvalues of at least ``least``."""
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    return (vectors * np.maximum(values, least)) @ vectors.T


def sample_covariance(centred: Array) -> Array:
    return estimate_covariance(centred)


def two_way_from_products(products: Array, n: float, expiries: int, tenors: int) -> tuple[Array, Array]:
    """Covariances along each axis of n centred rows that are expiry-major grids, from the products of their cells."""
    cells, rows = products.reshape(expiries, tenors, expiries, tenors), max(n - 1, 1)
    return np.einsum("itjt->ij", cells) / tenors / rows, np.einsum("etem->tm", cells) / expiries / rows


def identity_share(n: float, s: Array, fourth: float, method: str) -> float:
    """The weight of the identity in the estimates of Ledoit and Wolf (2004), and of Chen, Wiesel, Eldar and Hero (2010, without the 2/p term)."""
    p = len(s)
    mu, square = np.trace(s) / p, (s**2).sum()
    if method == "oas":
        spread = (n + 1) * (square / p**2 - mu**2 / p)
        return 1.0 if spread == 0 else min((square / p**2 + mu**2) / spread, 1.0)
    delta = (square - p * mu**2) / p
    beta = min(fourth / n - square, delta * n * p) / (n * p)
    return beta / delta if beta > 0 and delta > 0 else 0.0


def covariance_from_sums(n: float, products: Array, fourth: float, method: str = "sample", alpha: float = 0.0, rank: int = 3, dims: tuple[int, int] | None = None) -> Array:
    """One of the estimators by name, from the products of n centred rows and the sum of their sizes' fourth powers; ``alpha`` is held to [0, 1]."""
    method, alpha, p = method.lower(), min(max(alpha, 0.0), 1.0), len(products)
    if method in ("ledoit_wolf", "oas"):
        s = products / n
        share = identity_share(n, s, fourth, method)
        return (1 - share) * s + share * np.trace(s) / p * np.eye(p)
    if n < 2:
        raise ValueError("a covariance needs two rows or more")
    s = products / (n - 1)
    if method == "sample":
        return s
    if method == "diagonal_shrink":
        return positive_definite(s * (1 - alpha + alpha * np.eye(p)))
    if method == "correlation_shrink":
        d = np.sqrt(np.maximum(np.diag(s), 1e-16))
        return positive_definite((s / np.outer(d, d) * (1 - alpha) + alpha * np.eye(p)) * np.outer(d, d))
    if method == "factor_diag":
        values, vectors = eigen_descending(s)
        r = int(min(rank, p, max(n - 1, 1)))
        common = (vectors[:, :r] * np.maximum(values[:r], 0)) @ vectors[:, :r].T
        target = positive_definite(common + np.diag(np.maximum(np.diag(s - common), 1e-12)))
        return positive_definite((1 - alpha) * s + alpha * target)
    if method == "separable_shrink":
        if dims is None:
            raise ValueError("separable_shrink needs the grid's dimensions")
        target = positive_definite(np.kron(*two_way_from_products(products, n, *dims)))
        if np.trace(target) > 1e-16:
            target = target * (np.trace(s) / np.trace(target))
        return positive_definite((1 - alpha) * s + alpha * target)
    raise ValueError(f"no covariance estimator named {method}")


def estimate_covariance(centred: Array, method: str = "sample", alpha: float = 0.0, rank: int = 3, dims: tuple[int, int] | None = None) -> Array:
    """:func:`covariance_from_sums` of centred rows."""
    return covariance_from_sums(len(centred), centred.T @ centred, float(((centred**2).sum(axis=1) ** 2).sum()), method, alpha, rank, dims)


def constrained_least_squares(gram: Array, rhs: Array, a: Array, b: Array) -> Array:
    """Minimises the squared residual whose normal equations are ``gram x = rhs``, subject to ``a x = b``."""
    m, c = len(gram), len(a)
    system = np.zeros((m + c, m + c))
    system[:m, :m], system[:m, m:], system[m:, :m] = 2 * gram, a.T, a
    return np.linalg.solve(system, np.concatenate([2 * rhs, b]))[:m]


def tucker(cube: Array, ranks: tuple[int, int, int], rounds: int = 200, tolerance: float = 1e-6) -> tuple[Array, list[Array], float]:
    """Higher-order orthogonal iteration (De Lathauwer et al., 2000): core, factors and root mean square error."""
    fold = lambda x, mode: np.moveaxis(x, mode, 0).reshape(x.shape[mode], -1)

    def leading(x: Array, mode: int) -> Array:
        m = fold(x, mode)
        return eigen_descending(m @ m.T)[1][:, : min(ranks[mode], x.shape[mode])]

    def along(x: Array, factor: Array, mode: int) -> Array:
        return np.moveaxis(np.tensordot(factor, x, axes=(1, mode)), 0, mode)

    factors, before = [leading(cube, i) for i in range(3)], None
    for _ in range(rounds):
        for mode in range(3):
            x = cube
            for other in range(3):
                if other != mode:
                    x = along(x, factors[other].T, other)
            factors[mode] = leading(x, mode)
        core = cube
        for mode in range(3):
            core = along(core, factors[mode].T, mode)
        size = np.linalg.norm(core)
        if before is not None and abs(size - before) <= tolerance * max(size, 1e-300):
            break
        before = size
    back = core
    for mode in range(3):
        back = along(back, factors[mode], mode)
    return core, factors, float(np.sqrt(np.mean((cube - back) ** 2)))
