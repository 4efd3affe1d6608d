"""Batched NumPy kernels on arrays of shape (rows, ...), for use inside Arrow batches.

Voigt order is 11, 22, 33, 23, 13, 12. Stress-like vectors hold plain shear, strain-like ones engineering shear.
"""

from __future__ import annotations

import numpy as np

_P = np.array([0, 1, 2, 1, 0, 0])
_Q = np.array([0, 1, 2, 2, 2, 1])
_SHEAR = np.array([1.0, 1.0, 1.0, 2.0, 2.0, 2.0])
TINY = 1e-30


def rotations(euler: np.ndarray) -> np.ndarray:
    """(rows, 3, 3) from Bunge angles (rows, 3)."""
    c, s = np.cos(euler), np.sin(euler)

    def about_z(k: int) -> np.ndarray:
        out = np.zeros((len(euler), 3, 3))
        out[:, 0, 0] = out[:, 1, 1] = c[:, k]
        out[:, 0, 1], out[:, 1, 0] = -s[:, k], s[:, k]
        out[:, 2, 2] = 1
        return out

    x = np.zeros((len(euler), 3, 3))
    x[:, 0, 0] = 1
    x[:, 1, 1] = x[:, 2, 2] = c[:, 1]
    x[:, 1, 2], x[:, 2, 1] = -s[:, 1], s[:, 1]
    return about_z(0) @ x @ about_z(2)


def stress_bond(a: np.ndarray) -> np.ndarray:
    """(rows, 6, 6): how a rotation turns stress-like vectors.

    Entry (I, J) with I = (i, j), J = (k, l) is a_ik a_jl, plus a_il a_jk if k differs from l.
    """
    direct = a[:, _P[:, None], _P] * a[:, _Q[:, None], _Q]
    return direct + (_P != _Q) * a[:, _P[:, None], _Q] * a[:, _Q[:, None], _P]


def strain_bond(a: np.ndarray) -> np.ndarray:
    """How a rotation turns strain-like vectors: the stress form with shear rows doubled and shear columns halved."""
    return stress_bond(a) * _SHEAR[:, None] / _SHEAR


def rotated_stiffness(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    m = stress_bond(a)
    return m @ c @ m.transpose(0, 2, 1)


def rotated_compliance(a: np.ndarray, s: np.ndarray) -> np.ndarray:
    n = strain_bond(a)
    return n @ s @ n.transpose(0, 2, 1)


def rotated_expansion(a: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    return np.einsum("nij,nj->ni", strain_bond(a), alpha)


def to_tensor(v: np.ndarray, shear: float = 1.0) -> np.ndarray:
    """(rows, 3, 3) symmetric tensors of Voigt vectors whose shear entries are `shear` times the tensor's."""
    out = np.zeros((len(v), 3, 3))
    w = v / np.where(_SHEAR > 1, shear, 1.0)
    out[:, _P, _Q] = w
    out[:, _Q, _P] = w
    return out


def to_voigt(t: np.ndarray, shear: float = 1.0) -> np.ndarray:
    return t[:, _P, _Q] * np.where(_SHEAR > 1, shear, 1.0)


def symmetric_function(m: np.ndarray, f) -> np.ndarray:
    """f of symmetric matrices, by their eigenvalues."""
    values, vectors = np.linalg.eigh(m)
    return (vectors * f(values)[..., None, :]) @ np.swapaxes(vectors, -1, -2)


def safe_log(values: np.ndarray) -> np.ndarray:
    """log |v|, with values near 0 held away from it."""
    return np.log(np.maximum(np.abs(values), TINY))


def engineering_constants(c: np.ndarray) -> dict[str, float]:
    """Young's and shear moduli and Poisson's ratios of one stiffness matrix."""
    s = np.linalg.inv(c)
    out = {f"E{i + 1}": 1 / s[i, i] for i in range(3)} | {"G23": 1 / s[3, 3], "G13": 1 / s[4, 4], "G12": 1 / s[5, 5]}
    return out | {f"nu{i + 1}{j + 1}": -s[j, i] / s[i, i] for i in range(3) for j in range(3) if i != j}


def cleaned(m: np.ndarray, ratio: float = 1e-6) -> np.ndarray:
    """Symmetric part, with entries under a millionth of the largest set to zero."""
    s = (m + np.swapaxes(m, -1, -2)) / 2
    return np.where(np.abs(s) < ratio * np.abs(s).max(axis=(-1, -2), keepdims=True), 0.0, s)


def christoffel(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(rows, 3, 3): g_ik = C_ijkl n_j n_l for directions n."""
    full = np.zeros((3, 3, 3, 3))
    for i, (p, q) in enumerate(zip(_P, _Q, strict=True)):
        for j, (r, s) in enumerate(zip(_P, _Q, strict=True)):
            full[p, q, r, s] = full[q, p, r, s] = full[p, q, s, r] = full[q, p, s, r] = c[i, j]
    return np.einsum("ijkl,nj,nl->nik", full, n, n)


def wave_speeds(c: np.ndarray, density: float, azimuth: np.ndarray, inclination: np.ndarray) -> np.ndarray:
    """(rows, 5): VP, VS1, VS2, VSH, VSV of plane waves.

    The mode that is closest to the sagittal plane's normal is SH, the one closest to the direction is P; the
    lowest mode wins a tie. What is left is SV; if one mode is both, the last of the two left.
    """
    sa, ca, si, ci = np.sin(azimuth), np.cos(azimuth), np.sin(inclination), np.cos(inclination)
    n = np.stack([si * ca, si * sa, ci], 1)
    side = np.stack([-sa, ca, np.zeros_like(sa)], 1)
    values, vectors = np.linalg.eigh(christoffel(c, n))
    speed = np.sqrt(np.maximum(values / density, 0))
    rows = np.arange(len(n))
    sh = np.argmax(np.round(np.abs(np.einsum("ni,nim->nm", side, vectors)), 9), 1)
    p = np.argmax(np.round(np.abs(np.einsum("ni,nim->nm", n, vectors)), 9), 1)
    left = (np.arange(3) != sh[:, None]) & (np.arange(3) != p[:, None])
    sv = 2 - np.argmax(left[:, ::-1], 1)
    vsh, vsv = speed[rows, sh], speed[rows, sv]
    return np.stack([speed[rows, p], np.maximum(vsh, vsv), np.minimum(vsh, vsv), vsh, vsv], 1)
