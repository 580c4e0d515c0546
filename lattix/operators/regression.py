"""Least squares with spatial diagnostics, and maximum-likelihood spatial lag and error models.

Cross products are one-pass sums on the executors; the driver solves k x k systems.  The maximum-likelihood
models take the eigenvalues of the weights matrix by connected parts, places that share all neighbours as one; memory follows the edges and the square of the largest part so reduced.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattix.functions.scalars import scalars
from lattix.functions.special import chi2_sf, f_sf, normal_cdf, t_two_sided


def cross(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Sums of products of all pairs of columns."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = df.agg(*[F.sum(F.col(columns[i]) * F.col(columns[j])) for i, j in pairs]).first()
    out = np.zeros((len(columns), len(columns)))
    for (i, j), v in zip(pairs, row):
        out[i, j] = out[j, i] = v
    return out


def _design(df: DataFrame, key: str, y: str, xs: list[str]) -> DataFrame:
    d = df.select(F.col(key).alias("id"), F.col(y).cast("double").alias("y"), F.lit(1.0).alias("x0"), *[F.col(x).cast("double").alias(f"x{i + 1}") for i, x in enumerate(xs)])
    return d.dropna()


def ols(df: DataFrame, key: str, y: str, xs: list[str], w: DataFrame | None = None) -> tuple[list[dict], dict, DataFrame]:
    """(coefficients, diagnostics, residual DataFrame (key, predicted, residual)) of y on a constant and xs."""
    d = _design(df, key, y, xs)
    names = [f"x{i}" for i in range(len(xs) + 1)]
    k = len(names)
    c = cross(d, [*names, "y"])
    s = scalars(d, n=F.count("*"), syy=F.var_samp("y"))
    n, xtx, xty = s["n"], c[:k, :k], c[:k, k]
    inv = np.linalg.inv(xtx)
    beta = inv @ xty
    fit = sum((F.col(v) * float(b) for v, b in zip(names[1:], beta[1:])), F.lit(float(beta[0])))
    r = d.withColumn("fit", fit).withColumn("e", F.col("y") - F.col("fit"))
    m = scalars(r, s1=F.avg("e"), ss=F.sum(F.col("e") * F.col("e")), m2=F.var_pop("e"), sk=F.skewness("e"), ku=F.kurtosis("e"))
    rss, tss = m["ss"], s["syy"] * (n - 1)
    var = rss / (n - k)
    se = np.sqrt(var * np.diag(inv))
    coefs = [{"variable": v, "coefficient": float(b), "std_error": float(e), "t": float(b / e), "p": t_two_sided(float(b / e), n - k)} for v, b, e in zip(["CONSTANT", *xs], beta, se)]
    r2 = 1 - rss / tss
    lik = -n / 2 * (math.log(2 * math.pi) + math.log(rss / n) + 1)
    f = (r2 / (k - 1)) / ((1 - r2) / (n - k)) if k > 1 else float("nan")
    scale = np.sqrt(np.diag(xtx))
    eig = np.linalg.eigvalsh(xtx / np.outer(scale, scale))
    jb = n / 6 * m["sk"] ** 2 + n / 24 * m["ku"] ** 2
    diag = {
        "n": n, "k": k, "r2": r2, "adj_r2": 1 - (1 - r2) * (n - 1) / (n - k), "f": f, "f_p": f_sf(f, k - 1, n - k) if k > 1 else float("nan"), "rss": rss, "sigma2": var, "sigma2_ml": rss / n,
        "log_likelihood": lik, "aic": -2 * lik + 2 * k, "sc": -2 * lik + k * math.log(n), "condition": math.sqrt(eig[-1] / eig[0]), "jarque_bera": jb, "jarque_bera_p": chi2_sf(jb, 2),
    }
    diag |= _heteroskedasticity(r, names, n, k, rss)
    if w is not None:
        diag |= _spatial(r, names, w, inv, beta, n, k, rss)
    return coefs, diag, r.select(F.col("id").alias(key), F.col("fit").alias("predicted"), F.col("e").alias("residual"))


def _explained(d: DataFrame, names: list[str], y: str) -> tuple[float, float]:
    """Explained and total sum of squares of y about its mean, regressed on names (a constant among them)."""
    c = cross(d, [*names, y])
    k = len(names)
    beta = np.linalg.lstsq(c[:k, :k], c[:k, k], rcond=None)[0]
    s = scalars(d, n=F.count("*"), v=F.var_pop(y))
    total = s["v"] * s["n"]
    rss = c[k, k] - beta @ c[:k, k]
    return max(0.0, total - rss), total


def _heteroskedasticity(r: DataFrame, names: list[str], n: int, k: int, rss: float) -> dict:
    """Breusch-Pagan and Koenker-Bassett on squared regressors, White on squares and products."""
    if k < 2:
        return {}
    z = r.select((F.col("e") * F.col("e") / (rss / n)).alias("g"), F.lit(1.0).alias("x0"), *[(F.col(v) * F.col(v)).alias(v) for v in names[1:]])
    ess, total = _explained(z, names, "g")
    bp, kb = ess / 2, n * ess / total
    more = [(a, b) for i, a in enumerate(names[1:]) for b in names[1 + i :]]
    wide = r.select((F.col("e") * F.col("e")).alias("g"), *names, *[(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in more])
    ess, total = _explained(wide, [*names, *[f"{a}_{b}" for a, b in more]], "g")
    white = n * ess / total
    df = ((k - 1) ** 2 + 3 * (k - 1)) / 2
    return {"breusch_pagan": bp, "breusch_pagan_p": chi2_sf(bp, k - 1), "koenker_bassett": kb, "koenker_bassett_p": chi2_sf(kb, k - 1), "white": white, "white_p": chi2_sf(white, df)}


def _spatial(r: DataFrame, names: list[str], w: DataFrame, inv: np.ndarray, beta: np.ndarray, n: int, k: int, rss: float) -> dict:
    """Moran of residuals and Lagrange multiplier tests; w is row-standardized here."""
    from lattix.operators.weights import row_standardize

    e = w.where("src <> dst").join(r.select(F.col("id").alias("src")), "src", "left_semi").join(r.select(F.col("id").alias("dst")), "dst", "left_semi")
    e = row_standardize(e)
    cols = [*names, "y", "e", "fit"]
    n_ = r.select(F.col("id").alias("dst"), *[F.col(c).alias(f"n_{c}") for c in cols])
    lag = e.join(n_, "dst").groupBy(F.col("src").alias("id")).agg(*[F.sum(F.col("weight") * F.col(f"n_{c}")).alias(f"w_{c}") for c in cols])
    d = r.join(lag, "id", "left").fillna(0.0)
    back = e.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("weight").alias("back"))
    t = scalars(e.join(back, ["src", "dst"], "left"), ww=F.sum(F.col("weight") * F.col("weight")), wb=F.sum(F.col("weight") * F.coalesce("back", F.lit(0.0))), s0=F.sum("weight"))
    trace = (t["ww"] or 0) + (t["wb"] or 0)
    c = cross(d, [*names, *[f"w_{v}" for v in names], "e", "w_e", "w_y", "w_fit"])
    at = {v: i for i, v in enumerate([*names, *[f"w_{v}" for v in names], "e", "w_e", "w_y", "w_fit"])}
    s2 = rss / n
    ewe, ewy = c[at["e"], at["w_e"]], c[at["e"], at["w_y"]]
    proj = c[: k, at["w_fit"]]
    mwxb = c[at["w_fit"], at["w_fit"]] - proj @ inv @ proj
    nj = mwxb / s2 + trace
    err, lg = (ewe / s2) ** 2 / trace, (ewy / s2) ** 2 / nj
    r_lag = (ewy / s2 - ewe / s2) ** 2 / (nj - trace) if nj > trace else float("nan")
    r_err = (ewe / s2 - trace / nj * ewy / s2) ** 2 / (trace * (1 - trace / nj))
    moran = n / t["s0"] * ewe / rss
    # mean and variance of residual Moran under normality
    xwx = c[:k, k : 2 * k]
    a = inv @ xwx
    sym = (xwx + xwx.T) / 2
    wx2 = c[k : 2 * k, k : 2 * k]
    mean = -np.trace(a) * n / ((n - k) * t["s0"])
    # tr(MWMW') + tr(MWMW) with M = I - X inv X'
    cols_w = e.join(r.select(F.col("id").alias("src"), *[F.col(v).alias(f"s_{v}") for v in names]), "src").groupBy(F.col("dst").alias("id")).agg(*[F.sum(F.col("weight") * F.col(f"s_{v}")).alias(f"t_{v}") for v in names])
    both = d.join(cols_w, "id", "left").fillna(0.0)
    c2 = cross(both, [*[f"w_{v}" for v in names], *[f"t_{v}" for v in names]])
    tt, wt = c2[k:, k:], c2[:k, k:]
    tr_ww = (t["wb"] or 0) - 2 * np.trace(inv @ wt.T) + np.trace(a @ a)
    tr_wwt = (t["ww"] or 0) - np.trace(inv @ wx2) - np.trace(inv @ tt) + np.trace(inv @ xwx @ inv @ xwx.T)
    tr_mw = -np.trace(a)
    del sym
    var = (n / t["s0"]) ** 2 * (tr_wwt + tr_ww + tr_mw**2) / ((n - k) * (n - k + 2)) - mean**2
    z = (moran - mean) / math.sqrt(var)
    out = {"moran_e": moran, "moran_e_z": z, "moran_e_p": 2 * (1 - normal_cdf(abs(z))), "lm_lag": lg, "lm_error": err, "robust_lm_lag": r_lag, "robust_lm_error": r_err, "lm_sarma": err + r_lag}
    return out | {f"{v}_p": chi2_sf(out[v], 2 if v == "lm_sarma" else 1) for v in ("lm_lag", "lm_error", "robust_lm_lag", "robust_lm_error", "lm_sarma") if out[v] == out[v]}


class Part:
    """Row-standardized weights of a connected part.  Members of one kind share neighbours and weight, so the weights act on the kinds' scaled means by `matrix` and on what differs within a kind by `apart`."""

    def __init__(self, members: np.ndarray, kind: np.ndarray, matrix: np.ndarray, apart: np.ndarray):
        self.members, self.kind, self.matrix, self.apart = members, kind, matrix, apart
        self.size = np.bincount(kind)

    def times(self, matrix: np.ndarray, apart: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Acts on values of the members by a matrix on the kinds and factors within them."""
        if len(self.size) == len(self.members):
            return matrix @ v
        v2 = v.reshape(len(v), -1)
        mean = np.stack([np.bincount(self.kind, c) for c in v2.T], axis=1) / self.size[:, None]
        root = np.sqrt(self.size)[:, None]
        return ((matrix @ (root * mean) / root)[self.kind] + (v2 - mean[self.kind]) * apart[self.kind, None]).reshape(v.shape)


def _blocks(df: DataFrame, key: str, y: str, xs: list[str], w: DataFrame):
    """(y, design, parts): row-standardized weights of every connected part; places without neighbours are in none."""
    from lattix.operators.weights import edges_of_kinds, twins

    rows = sorted(_design(df, key, y, xs).collect())
    ids = [r[0] for r in rows]
    first, kind = np.unique(twins(w, ids), return_inverse=True)
    kind = kind.reshape(-1)
    a, b, weight = edges_of_kinds(w, ids, first[kind])
    a, b, size = kind[a], kind[b], np.bincount(kind, minlength=len(first))
    part = np.arange(len(first))
    while True:
        before = part.copy()
        np.minimum.at(part, a, part[b])
        np.minimum.at(part, b, part[a])
        part = part[part]
        if (part == before).all():
            break
    order, by_part = np.argsort(part[a], kind="stable"), np.argsort(part[kind], kind="stable")
    at = np.searchsorted(part[kind][by_part], np.arange(len(first) + 1))
    blocks = []
    for own in np.split(order, np.flatnonzero(np.diff(part[a][order])) + 1) if len(order) else []:
        kinds = np.unique(np.r_[a[own], b[own]])
        p = part[kinds[0]]
        members = np.sort(by_part[at[p] : at[p + 1]])
        m, many = np.zeros((len(kinds), len(kinds))), size[kinds]
        m[np.searchsorted(kinds, a[own]), np.searchsorted(kinds, b[own])] = weight[own]
        inner = np.diag(m).copy()
        sums = m @ many - inner
        over = np.divide(1.0, sums, out=np.zeros(len(m)), where=sums != 0)
        apart = -inner * over
        m = m * over[:, None] * np.sqrt(np.outer(many, many)) + np.diag(apart)
        blocks.append(Part(members, np.searchsorted(kinds, kind[members]), m, apart))
    return np.array([r[1] for r in rows]), np.array([list(r[2:]) for r in rows]), blocks


def _golden(f, lo: float, hi: float, tol: float = 1e-10) -> float:
    g = (math.sqrt(5) - 1) / 2
    a, b = hi - g * (hi - lo), lo + g * (hi - lo)
    fa, fb = f(a), f(b)
    while hi - lo > tol:
        if fa > fb:
            hi, b, fb = b, a, fa
            a = hi - g * (hi - lo)
            fa = f(a)
        else:
            lo, a, fa = a, b, fb
            b = lo + g * (hi - lo)
            fb = f(b)
    return (lo + hi) / 2


def ml_model(df: DataFrame, key: str, y: str, xs: list[str], w: DataFrame, kind: str = "lag") -> dict:
    """Concentrated maximum likelihood.  kind "lag": y = rho W y + X b + e; "error": u = lambda W u + e."""
    yv, x, blocks = _blocks(df, key, y, xs, w)
    n = len(yv)
    eig = np.concatenate([v for p in blocks for v in (np.linalg.eigvals(p.matrix), np.repeat(p.apart, p.size - 1))] or [np.zeros(0)])
    logdet = lambda r: float(np.log(np.abs(1 - r * eig)).sum())

    def times(factors: list[tuple[np.ndarray, np.ndarray]], v: np.ndarray) -> np.ndarray:
        out = np.zeros_like(v)
        for p, (m, apart) in zip(blocks, factors):
            out[p.members] = p.times(m, apart, v[p.members])
        return out

    wy, wx = (times([(p.matrix, p.apart) for p in blocks], v) for v in (yv, x))

    def fit(r: float):
        a, b = (yv - r * wy, x) if kind == "lag" else (yv - r * wy, x - r * wx)
        beta = np.linalg.lstsq(b, a, rcond=None)[0]
        e = a - b @ beta
        return beta, float(e @ e) / n

    lik = lambda r: -n / 2 * (math.log(2 * math.pi) + math.log(fit(r)[1]) + 1) + logdet(r)
    r = _golden(lik, -0.999, 0.999)
    beta, s2 = fit(r)
    k = x.shape[1]
    gs = [(p.matrix @ np.linalg.inv(np.eye(len(p.matrix)) - r * p.matrix), p.apart / (1 - r * p.apart)) for p in blocks]
    t1 = sum(np.trace(g) + (p.size - 1) @ h for p, (g, h) in zip(blocks, gs))
    t2 = sum((g * g.T).sum() + (g * g).sum() + 2 * ((p.size - 1) @ h**2) for p, (g, h) in zip(blocks, gs))
    if kind == "lag":
        gx = times(gs, x @ beta)
        info = np.zeros((k + 2, k + 2))
        info[0, 0] = t2 + gx @ gx / s2
        info[0, 1 : k + 1] = info[1 : k + 1, 0] = x.T @ gx / s2
        info[1 : k + 1, 1 : k + 1] = x.T @ x / s2
        info[0, -1] = info[-1, 0] = t1 / s2
        info[-1, -1] = n / (2 * s2 * s2)
        se = np.sqrt(np.abs(np.diag(np.linalg.pinv(info))))
        se_r, se_b = se[0], se[1 : k + 1]
    else:
        xs_ = x - r * wx
        se_b = np.sqrt(np.diag(np.linalg.inv(xs_.T @ xs_ / s2)))
        se_r = math.sqrt(abs(np.linalg.pinv(np.array([[t2, t1 / s2], [t1 / s2, n / (2 * s2 * s2)]]))[0, 0]))
    best, base = lik(r), lik(0.0)
    params = k + (kind == "lag")
    return {
        "n": n, "rho" if kind == "lag" else "lambda": r, "rho_se": float(se_r), "beta": beta.tolist(), "beta_se": se_b.tolist(), "sigma2": s2, "log_likelihood": best,
        "aic": -2 * best + 2 * params, "sc": -2 * best + params * math.log(n), "lr_test": 2 * (best - base), "lr_p": chi2_sf(2 * (best - base), 1),
    }


def difference_in_differences(df: DataFrame, key: str, y: str, inside: str, after: str, mode: str = "both") -> tuple[list[dict], dict, DataFrame]:
    """OLS on dummies: space (inside a selection), time (the later period), or both with their interaction."""
    if mode not in ("space", "time", "both"):
        raise ValueError(f"unknown mode {mode}")
    s, t = F.col(inside).cast("int"), F.col(after).cast("int")
    d = df.withColumn("SPACE", s).withColumn("TIME", t).withColumn("INTERACTION", s * t)
    return ols(d, key, y, {"space": ["SPACE"], "time": ["TIME"], "both": ["SPACE", "TIME", "INTERACTION"]}[mode])
