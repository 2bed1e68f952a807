"""Decomposition of I(Y; V, S) into redundant, unique and synergistic parts, for one
small table of counts in numpy. All values are in nats."""

from __future__ import annotations

import numpy as np

ATOMS = ("red", "u_val", "u_str", "syn")
GAP, RESIDUAL, NEGATIVE = 1e-9, 1e-10, -1e-9


def entropy(p: np.ndarray) -> float:
    p = p[p > 0]
    return float(-(p * np.log(p)).sum())


def nodes(p: np.ndarray) -> tuple[float, float, float]:
    """I(V;Y), I(S;Y) and I(VS;Y) of a distribution over v, s, y."""
    hy = entropy(p.sum((0, 1)))
    vy, sy = p.sum(1), p.sum(0)
    return (
        entropy(vy.sum(1)) + hy - entropy(vy.ravel()),
        entropy(sy.sum(1)) + hy - entropy(sy.ravel()),
        entropy(p.sum(2).ravel()) + hy - entropy(p.ravel()),
    )


def least_information(p: np.ndarray, rounds: int = 200) -> tuple[float, float, float]:
    """min -H(Y|VS) over distributions with p's (v,y) and (s,y) margins, by a primal-dual
    interior point method; with the duality gap that certifies it, and the residual.

    The Hessian is a diagonal less a rank-one term in each (v,s), inverted in closed
    form, so a step solves one system in the margins."""
    vy, sy, y = p.sum(1), p.sum(0), p.sum((0, 1))
    (nv, ny), ns = vy.shape, sy.shape[0]
    on = (vy[:, None, :] > 0) & (sy[None] > 0)
    q = np.where(on, vy[:, None, :] * sy[None] / np.where(y > 0, y, 1), 0.0)
    z = np.where(on, 1.0, 0.0)
    a, b = np.zeros((nv, ny)), np.zeros((ns, ny))
    one = np.where(on, q, 1.0)

    def value(q: np.ndarray) -> float:
        t = q.sum(2, keepdims=True)
        return float((q[on] * np.log(q[on] / np.broadcast_to(t, q.shape)[on])).sum())

    def bound() -> float:
        f = np.where(on, a[:, None] + b[None], -np.inf)
        top = f.max(2)
        some = np.isfinite(top)
        lse = np.where(some, top, 0) + np.log(np.where(some[..., None], np.exp(f - np.where(some, top, 0)[..., None]), 0).sum(2), where=some, out=np.full(top.shape, -np.inf))
        return float((vy * a).sum() + (sy * b).sum() - lse.max())

    best = (np.inf, value(q), np.inf)
    for _ in range(rounds):
        t = q.sum(2, keepdims=True)
        one = np.where(on, q, 1.0)
        rv, rs = q.sum(1) - vy, q.sum(0) - sy
        residual, gap = max(abs(rv).max(), abs(rs).max()), value(q) - bound()
        if residual < RESIDUAL and gap < best[0]:
            best = (gap, value(q), residual)
        if residual < RESIDUAL / 10 and gap < GAP / 100:
            break
        mu = 0.15 * (q * z).sum() / on.sum()
        rd = np.where(on, np.log(one / np.where(t > 0, t, 1)) - a[:, None] - b[None] - z, 0)
        g = np.where(on, -rd - (q * z - mu) / one, 0)
        d = q / (1 + z)
        den = (d * z).sum(2)
        den = np.where(den > 0, den, 1.0)
        inverse = lambda x: d * x + d * ((d * x).sum(2) / den)[..., None]  # noqa: E731, B023
        w = d[..., :, None] * d[..., None, :] / den[..., None, None]
        w[..., range(ny), range(ny)] += d
        m = np.zeros((nv + ns, ny, nv + ns, ny))
        m[range(nv), :, range(nv), :] = w.sum(1)
        m[range(nv, nv + ns), :, range(nv, nv + ns), :] = w.sum(0)
        m[:nv, :, nv:, :] = w.transpose(0, 2, 1, 3)
        m[nv:, :, :nv, :] = w.transpose(1, 3, 0, 2).transpose(0, 1, 2, 3)
        m = m.reshape((nv + ns) * ny, -1)
        kg = inverse(g)
        rhs = np.concatenate([-rv - kg.sum(1), -rs - kg.sum(0)]).ravel()
        scale = np.sqrt(np.where(m.diagonal() > 0, m.diagonal(), 1.0))
        step = np.linalg.lstsq(m / scale[:, None] / scale[None], rhs / scale, rcond=1e-14)[0] / scale
        da, db = step.reshape(nv + ns, ny)[:nv], step.reshape(nv + ns, ny)[nv:]
        dq = np.where(on, inverse(da[:, None] + db[None] + g), 0)
        dz = np.where(on, (mu - q * z - z * dq) / one, 0)
        reach = lambda x, dx: min(1.0, 0.99 * float((-x[on] / dx[on])[dx[on] < 0].min(initial=1e9)))
        ap, ad = reach(q, dq), reach(z, dz)
        q, z, a, b = q + ap * dq, z + ad * dz, a + ad * da, b + ad * db
    return best[1], best[0], best[2]


def broja(table: np.ndarray) -> dict:
    """Atoms of Bertschinger et al. (2014), with ``converged`` and the duality ``gap``;
    atoms are NaN where the solution isn't certified."""
    p = table / table.sum()
    iv, is_, ij = nodes(p)
    least, gap, residual = least_information(p)
    star = entropy(p.sum((0, 1))) + least
    atoms = {"red": iv + is_ - star, "u_val": star - is_, "u_str": star - iv, "syn": ij - star}
    good = bool(gap <= GAP and residual <= RESIDUAL and min(atoms.values()) >= NEGATIVE)
    return {**{k: v if good else float("nan") for k, v in atoms.items()}, "converged": good, "gap": gap}


def pairwise_maxent(p: np.ndarray, rounds: int = 5000) -> np.ndarray:
    """The distribution of most entropy with p's three pairwise margins."""
    q = np.where(p.sum(2, keepdims=True) * p.sum(1, keepdims=True) * p.sum(0, keepdims=True) > 0, 1.0, 0.0)
    q /= q.sum()
    for _ in range(rounds):
        change = 0.0
        for axis in (0, 1, 2):
            have, want = q.sum(axis, keepdims=True), p.sum(axis, keepdims=True)
            change = max(change, float(abs(have - want).max()))
            q = q * np.where(have > 0, want / np.where(have > 0, have, 1), 0)
        if change < 1e-13:
            break
    return q


def ccs(table: np.ndarray) -> dict:
    """Atoms by common change in surprisal (Ince, 2017); they may be negative."""
    p = table / table.sum()
    iv, is_, ij = nodes(p)
    q = pairwise_maxent(p)
    on = q > 0
    y, vy, sy, vs = q.sum((0, 1)), q.sum(1), q.sum(0), q.sum(2)
    ratio = lambda num, den: np.log(np.where(on, num, 1.0) / np.where(on, den, 1.0))
    lv = ratio(vy[:, None], vy.sum(1)[:, None, None] * y)
    ls = ratio(sy[None], sy.sum(1)[None, :, None] * y)
    lj = ratio(q, vs[:, :, None] * y)
    common = lv + ls - lj
    signs = np.sign(np.round([lv, ls, lj, common], 12))
    red = float((q * common)[on & (signs == signs[0]).all(0)].sum())
    return {"red": red, "u_val": iv - red, "u_str": is_ - red, "syn": ij - iv - is_ + red, "converged": True, "gap": 0.0}


def mmi(table: np.ndarray) -> dict:
    """Atoms by the minimum mutual information: redundancy is the smaller of the two."""
    iv, is_, ij = nodes(table / table.sum())
    red = min(iv, is_)
    return {"red": red, "u_val": iv - red, "u_str": is_ - red, "syn": ij - iv - is_ + red, "converged": True, "gap": 0.0}


MEASURES = {"broja": broja, "ccs": ccs, "mmi": mmi}


def atoms(table: np.ndarray, measure: str) -> dict:
    if measure not in MEASURES:
        raise ValueError(f"unknown measure: {measure!r}")
    if table.sum() <= 0 or min(table.shape) < 2:
        return {**dict.fromkeys(ATOMS, float("nan")), "converged": False, "gap": float("nan")}
    return MEASURES[measure](np.asarray(table, float))


def tensor(v, s, y, n) -> np.ndarray:
    """A dense table over the observed levels."""
    places = [np.unique(np.asarray(c), return_inverse=True) for c in (v, s, y)]
    out = np.zeros([len(u) for u, _ in places])
    np.add.at(out, tuple(i for _, i in places), np.asarray(n, float))
    return out
