"""Small dense solves on sufficient statistics.  Inputs never grow with the row count."""

from __future__ import annotations

import numpy as np

# Directions whose variance is below this share of the largest are dropped.
RANK_TOL = 1e-12
# Fixed value: singular values of the standardised within-class scatter under this are noise.
WITHIN_TOL = 1e-4


def fixed_sign(vectors: np.ndarray) -> np.ndarray:
    """Rows flipped so that their largest-magnitude entry is positive."""
    at = np.argmax(np.abs(vectors), axis=1)
    sign = np.sign(vectors[np.arange(len(vectors)), at])
    return vectors * np.where(sign == 0, 1.0, sign)[:, None]


def joint_diagonal(first: np.ndarray, second: np.ndarray, k: int):
    """Filters W with W (A + B) W' = I and W A W' diagonal, strongest contrast first."""
    values, vectors = np.linalg.eigh(first + second)
    keep = values > RANK_TOL * values[-1]
    white = vectors[:, keep] / np.sqrt(values[keep])
    share, turn = np.linalg.eigh(white.T @ first @ white)
    order = np.argsort(-np.abs(share - 0.5), kind="stable")[:k]
    return fixed_sign((white @ turn[:, order]).T), share[order]


def discriminant(counts: np.ndarray, sums: np.ndarray, squares: np.ndarray):
    """Linear discriminant from class counts, class sums and the total of x x'.

    Returns (coefficients, intercepts), one row per class.
    """
    n, (classes, width) = counts.sum(), sums.shape
    means = sums / counts[:, None]
    within = squares - (sums.T @ means)
    spread = np.sqrt(np.maximum(np.diag(within), 0.0) / n)
    spread[spread == 0] = 1.0
    scaled = within / np.outer(spread, spread) / max(n - classes, 1)
    values, vectors = np.linalg.eigh((scaled + scaled.T) / 2)
    keep = values > WITHIN_TOL**2
    basis = vectors[:, keep] / np.sqrt(values[keep]) / spread[:, None]
    center = sums.sum(axis=0) / n
    offset = (means - center) @ basis
    coef = offset @ basis.T
    intercept = np.log(counts / n) - 0.5 * (offset**2).sum(axis=1) - coef @ center
    return coef, intercept


def leading_directions(gram: np.ndarray, k: int) -> np.ndarray:
    """Top right-singular vectors (as rows) of data with this uncentred Gram matrix."""
    _, vectors = np.linalg.eigh(gram)
    return fixed_sign(vectors[:, ::-1][:, :k].T)


def leading_in_span(weights: np.ndarray, parts: np.ndarray, k: int) -> np.ndarray:
    """Top right-singular vectors (as rows) of ``weights @ parts'``, by a problem of its rank."""
    q, r = np.linalg.qr(parts)
    _, _, turn = np.linalg.svd(weights @ r.T, full_matrices=False)
    return fixed_sign(turn[:k] @ q.T)


def khatri_rao(b: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Column-wise product of two factors, for one problem or a stack of them."""
    cube = b[..., :, None, :] * f[..., None, :, :]
    return cube.reshape(*b.shape[:-2], -1, b.shape[-1])


def cp_start(left: np.ndarray, right: np.ndarray, rank: int, seed: int = 0):
    """Start factors: leading directions of both short unfoldings, filled up at random.

    ``left`` and ``right`` are the Gram matrices of the unfoldings.
    """
    rng = np.random.RandomState(seed)
    out = []
    for unfolding in (left, right):
        lead = leading_directions(unfolding, rank).T
        fill = rng.random_sample((len(unfolding), rank - lead.shape[1]))
        out.append(np.hstack([lead, fill]))
    return out


def cp_start_from_gram(gram: np.ndarray, channels: int, rank: int):
    cube = gram.reshape(channels, len(gram) // channels, channels, -1)
    return cp_start(np.einsum("afbf->ab", cube), np.einsum("cacb->ab", cube), rank)


def gram_of(a: np.ndarray) -> np.ndarray:
    return a.swapaxes(-1, -2) @ a


def inverse(m: np.ndarray) -> np.ndarray:
    """Pseudo-inverse of symmetric matrices, stacked."""
    values, vectors = np.linalg.eigh(m)
    size = np.abs(values)
    usable = size > 1e-15 * size.max(axis=-1, keepdims=True)
    scale = np.divide(1.0, values, out=np.zeros_like(values), where=usable)
    return (vectors * scale[..., None, :]) @ vectors.swapaxes(-1, -2)


def cp_fit(times_gram, norm2: np.ndarray, b: np.ndarray, f: np.ndarray, sweeps: int, tol: float):
    """CP-ALS of stacked tensors, epochs x channels x bins, without touching the epochs.

    The long factor is A = X q, so both short updates need X only through
    ``times_gram(v) = X'X v``.  All arguments have a leading problem axis; a problem
    that has converged stays as it is while the others go on.  Returns
    (q, b, f, errors per sweep); an epoch x reconstructs to ``x @ q @ khatri_rao(b, f).T``.
    """
    n, channels, rank = b.shape
    scale = np.where(norm2 > 0, norm2, 1.0)
    q = np.zeros((n, channels * f.shape[1], rank))
    errors: list[np.ndarray] = []
    going = np.ones(n, dtype=bool)
    for _ in range(sweeps):
        new_q = khatri_rao(b, f) @ inverse(gram_of(b) * gram_of(f))
        product = times_gram(new_q)
        long2 = new_q.swapaxes(1, 2) @ product
        cube = product.reshape(n, channels, -1, rank)
        new_b = (cube * f[:, None]).sum(axis=2) @ inverse(long2 * gram_of(f))
        unscaled = (cube * new_b[:, :, None]).sum(axis=1)
        new_f = unscaled @ inverse(long2 * gram_of(new_b))
        fitted2 = (long2 * gram_of(new_b) * gram_of(new_f)).sum(axis=(1, 2))
        rest = np.maximum(norm2 - 2 * (unscaled * new_f).sum(axis=(1, 2)) + fitted2, 0.0)
        keep = ~going[:, None, None]
        q, b, f = (np.where(keep, old, new) for old, new in ((q, new_q), (b, new_b), (f, new_f)))
        now = np.sqrt(rest / scale)
        errors.append(now if not errors else np.where(going, now, errors[-1]))
        if len(errors) > 1:
            going = going & (np.abs(errors[-2] - errors[-1]) >= tol)
            if not going.any():
                break
    return q, b, f, np.array(errors)
