"""Scores of triples by eleven embedding models, lower is better, in NumPy over batches of rows.

h and t are (n, d), r is (n, d) unless stated. p is the norm of the translation models. unit() is the 2-norm
normalisation, which the translation models apply when `normalise` is set.
"""

from __future__ import annotations

import numpy as np


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x, dtype=np.float64), where=n > 0)


def transe(h, r, t, p=1, normalise=True):
    if normalise:
        h, r, t = unit(h), unit(r), unit(t)
    return np.linalg.norm(h + r - t, ord=p, axis=-1)


def transe_all(fixed, r, ents, tail: bool):
    """transe (L1, normalised) of each row's fixed end and relation with every entity: (n, m), without repeating rows."""
    aim = unit(fixed) + unit(r) if tail else unit(fixed) - unit(r)
    e = np.ascontiguousarray(unit(ents).T)
    out, part = np.zeros((len(aim), e.shape[1])), np.empty_like(e)
    for i in range(len(aim)):
        np.subtract(e, aim[i][:, None], out=part)
        np.abs(part, out=part)
        part.sum(axis=0, out=out[i])
    return out


def transh(h, r, t, w, p=1, normalise=True):
    """Heads and tails projected off the unit normal w of the relation."""
    w = unit(w)
    off = lambda x: x - (x * w).sum(-1, keepdims=True) * w
    return transe(off(h), r, off(t), p, normalise)


def transr(h, r, t, m, p=1, normalise=True):
    """Heads and tails mapped by the relation's (n, d, k) matrix; r is (n, k)."""
    return transe(np.einsum("nd,ndk->nk", h, m), r, np.einsum("nd,ndk->nk", t, m), p, normalise)


def transd(h, r, t, hp, tp, rp, p=1, normalise=True):
    """Heads and tails moved along rp by their product with their own transfer vectors."""
    k = r.shape[-1]

    def fit(e):
        return e[:, :k] if e.shape[1] >= k else np.pad(e, ((0, 0), (0, k - e.shape[1])))

    move = lambda e, ep: unit(fit(e) + (e * ep).sum(-1, keepdims=True) * rp)
    return transe(move(h, hp), r, move(t, tp), p, normalise)


def rotate(h, phase, t, margin=6.0):
    """Halves are real and imaginary parts; r is a rotation by (n, d / 2) phases."""
    d = h.shape[-1] // 2
    a = (h[:, :d] + 1j * h[:, d:]) * np.exp(1j * phase)
    return np.abs(a - (t[:, :d] + 1j * t[:, d:])).sum(-1) - margin


def distmult(h, r, t):
    return -(h * r * t).sum(-1)


def complex_(h, r, t):
    d = h.shape[-1] // 2
    c = lambda x: x[:, :d] + 1j * x[:, d:]
    return -(c(h) * c(r) * np.conj(c(t))).real.sum(-1)


def simple(h, r, t):
    return -(h * r * t).sum(-1)


def simple_forward(h, r, t, h2, r2, t2):
    """The mean of both directions, as in training."""
    return ((h * r * t).sum(-1) + (h2 * r2 * t2).sum(-1)) / 2


def rescal(h, m, t):
    return np.einsum("nd,ndk,nk->n", h, m, t)


def analogy(h, r, t, hs, rs, ts):
    """A complex part and a real part."""
    return complex_(h, r, t) - (hs * rs * ts).sum(-1)


def hole(h, r, t):
    """r times the circular correlation of h and t."""
    corr = np.fft.irfft(np.conj(np.fft.rfft(h, axis=-1)) * np.fft.rfft(t, axis=-1), n=h.shape[-1], axis=-1)
    return -(r * corr).sum(-1)


def regularisation(*parts: np.ndarray) -> float:
    """The mean of the mean squares."""
    return float(np.mean([np.mean(np.asarray(p) ** 2) for p in parts]))


def l3_regularisation(*parts: np.ndarray) -> float:
    """The cubed 3-norms, summed."""
    return float(sum((np.abs(np.asarray(p)) ** 3).sum() for p in parts))
