"""Largest eigenpairs of a symmetric operator that is known by its products only: Jacobi-Davidson in blocks.

Everything here is of the operator's dimension; the product, a function of the caller, is where the data are read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

EPS = np.finfo(float).eps
#: Residuals up to this many roundings of the largest eigenvalue count as double precision.
ROUNDINGS = 128
#: Beyond it, up to here, they count when the sums themselves let them fall no further.
STALLED = 1e-11
Product = Callable[[np.ndarray], np.ndarray]


def _out_of(basis: np.ndarray, block: np.ndarray) -> np.ndarray:
    """``block`` without its part in the space of the orthonormal ``basis``."""
    return block - basis @ (basis.T @ block)


def extend(basis: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Orthonormal directions that ``block`` adds to ``basis``; dependent columns give none."""
    found = np.empty((len(basis), 0))
    for column in block.T:
        whole = np.hstack([basis, found])
        size = np.linalg.norm(column)
        for _ in range(3):
            column = _out_of(whole, column)
        left = np.linalg.norm(column)
        if size > 0 and left > 1e-12 * size and whole.shape[1] < len(basis):
            found = np.hstack([found, (column / left)[:, None]])
    return found


def minres(product: Product, right: np.ndarray, steps: int, goal: float) -> np.ndarray:
    """Approximate solutions of one symmetric system per column, all of them advanced by one product a step.

    Column j sees ``product`` of column j only; a column whose residual fell by ``goal`` no longer changes.
    """
    beta = np.linalg.norm(right, axis=0)
    live = beta > 0
    v = right / np.where(live, beta, 1)
    v_old, w, w_old, x = (np.zeros_like(right) for _ in range(4))
    one, none = np.ones(len(beta)), np.zeros(len(beta))
    c, c_old, s, s_old, eta, off = one, one, none, none, beta.copy(), none
    for _ in range(steps):
        p = product(v)
        alpha = (v * p).sum(axis=0)
        p = p - alpha * v - off * v_old
        after = np.linalg.norm(p, axis=0)
        delta = c * alpha - c_old * s * off
        rho = np.hypot(delta, after)
        live = live & (rho > EPS * np.maximum(np.abs(alpha), after))
        safe = np.where(live, rho, 1)
        w_new = (v - s_old * off * w_old - (s * alpha + c_old * c * off) * w) / safe
        c_old, s_old, c, s = c, s, np.where(live, delta / safe, 1), np.where(live, after / safe, 0)
        x = x + np.where(live, c * eta, 0) * w_new
        eta = np.where(live, -s * eta, eta)
        live = live & (np.abs(eta) > goal * beta) & (after > 0)
        w_old, w, v_old, off = w, w_new, v, after
        v = p / np.where(after > 0, after, 1)
        if not live.any():
            break
    return x


def largest(product: Product, size: int, k: int, steps: int = 3, space: int = 40, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of the ``k`` largest eigenpairs, values falling, vectors in columns.

    Rayleigh-Ritz on a search space of at most ``space`` directions; every wanted Ritz pair that is not yet
    exact adds the solution of its correction equation, ``steps`` of MINRES within the complement of the locked
    and wanted vectors; leading pairs are locked when their residuals reach double precision, and a last product of
    all locked vectors must confirm it. Raises where that fails within ``rounds``.
    """
    k = min(k, size)
    start = np.random.default_rng(12).standard_normal((size, min(size, 2 * k)))
    locked, images = np.empty((size, 0)), np.empty((size, 0))
    basis = extend(locked, start)
    mapped = product(basis)
    top, best, still = 0.0, np.inf, 0
    for _ in range(rounds):
        if locked.shape[1] == k:
            images = product(locked)
            values, turn = np.linalg.eigh(_symmetric(locked.T @ images))
            locked, images, values = locked @ turn[:, ::-1], images @ turn[:, ::-1], values[::-1]
            worst = np.linalg.norm(images - locked * values, axis=0).max(initial=0)
            if worst <= _goal(top) or still and worst <= STALLED * top:
                return values, locked
            basis, mapped = locked, images  # what was carried along has drifted: go on from the fresh products
            locked, images = np.empty((size, 0)), np.empty((size, 0))
        values, turn = np.linalg.eigh(_symmetric(basis.T @ mapped))
        values, turn = values[::-1], turn[:, ::-1]
        want = k - locked.shape[1]
        top = max(top, values[0], EPS)
        ritz, image = basis @ turn[:, :want], mapped @ turn[:, :want]
        residual = _out_of(locked, image - ritz * values[:want])
        sizes = np.linalg.norm(residual, axis=0)
        still = still + 1 if sizes.max() > best / 2 else 0
        best = min(best, sizes.max())
        full = basis.shape[1] + locked.shape[1] >= size
        exact = (sizes <= _goal(top)) | ((full or still > 8) & (sizes <= STALLED * top))
        done = len(exact) if exact.all() else int(exact.argmin())
        if done:
            locked, best, still = extend(np.empty((size, 0)), np.hstack([locked, ritz[:, :done]])), np.inf, 0
            rest = slice(done, None)
            basis, mapped = basis @ turn[:, rest], mapped @ turn[:, rest]
            if locked.shape[1] == k:
                continue
            ritz, residual, values = ritz[:, done:], residual[:, done:], values[done:want]
            want -= done
        else:
            values = values[:want]
        if basis.shape[1] + want > space:  # start again from the leading directions
            keep = max(2 * want, space // 2)
            if not done:
                basis, mapped = basis @ turn, mapped @ turn
            basis, mapped = basis[:, :keep], mapped[:, :keep]
        fixed = np.hstack([locked, ritz])

        def corrected(t: np.ndarray) -> np.ndarray:
            t = _out_of(fixed, t)
            return _out_of(fixed, product(t) - t * values)

        correction = minres(corrected, -_out_of(fixed, residual), steps, 1e-3)
        new = extend(np.hstack([locked, basis]), correction)
        if not new.shape[1]:  # no direction left in these equations: any other one
            new = extend(np.hstack([locked, basis]), start)
        if new.shape[1]:
            basis, mapped = np.hstack([basis, new]), np.hstack([mapped, product(new)])
    raise RuntimeError(f"residuals reached {best:.3g}, not {_goal(top):.3g}, in {rounds} rounds")


def _goal(top: float) -> float:
    return ROUNDINGS * EPS * top


def _symmetric(matrix: np.ndarray) -> np.ndarray:
    return (matrix + matrix.T) / 2
