"""Statistics of a few numbers on the driver: intervals, tests and resampling of contingency cells. No scipy."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np


def wilson(successes: int, total: int, confidence: float = 0.95) -> tuple[float, float]:
    if not total:
        return (0.0, 0.0)
    z = NormalDist().inv_cdf((1 + confidence) / 2)
    p, d = successes / total, 1 + z * z / total
    half = z * math.sqrt(p * (1 - p) / total + z * z / (4 * total * total)) / d
    mid = (p + z * z / (2 * total)) / d
    return (max(0.0, mid - half), min(1.0, mid + half))


def mcnemar_exact(a_only: int, b_only: int) -> float:
    """Two-sided exact binomial p-value of the discordant cells."""
    n, k = a_only + b_only, min(a_only, b_only)
    if n == 0:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
    return min(1.0, 2 * math.fsum(math.exp(x) for x in logs))


def adjust_p_values(p: list[float], method: str = "holm") -> list[float]:
    n = len(p)
    order = sorted(range(n), key=lambda i: p[i])
    out = [0.0] * n
    if method == "bonferroni":
        return [min(1.0, x * n) for x in p]
    if method == "holm":
        top = 0.0
        for rank, i in enumerate(order):
            top = max(top, min(1.0, p[i] * (n - rank)))
            out[i] = top
        return out
    if method == "bh":
        low = 1.0
        for rank in range(n - 1, -1, -1):
            low = min(low, p[order[rank]] * n / (rank + 1))
            out[order[rank]] = low
        return out
    raise ValueError(f"unknown method {method!r}")


def macro_f1(matrix: np.ndarray) -> float:
    """Mean over all classes of 2TP / (row + column), 0 where that is empty; matrix may be stacked (..., K, K)."""
    tp = np.einsum("...ii->...i", matrix).astype(float)
    below = matrix.sum(-1) + matrix.sum(-2)
    return np.divide(2 * tp, below, out=np.zeros_like(tp), where=below > 0).mean(-1)


def bootstrap_cells(matrix: np.ndarray, statistic, *, n_bootstrap: int = 1000, confidence: float = 0.95, seed: int = 42) -> tuple[float, float]:
    """Percentile interval of a statistic of a confusion matrix: resampling rows is resampling cells from a multinomial."""
    flat = matrix.reshape(-1)
    n = int(flat.sum())
    draws = np.random.default_rng(seed).multinomial(n, flat / n, size=n_bootstrap).reshape(n_bootstrap, *matrix.shape)
    values = statistic(draws)
    tail = (1 - confidence) / 2
    low, high = np.quantile(values, [tail, 1 - tail])
    return float(low), float(high)


def quadratic_kappa(matrix: np.ndarray) -> float:
    k, n = len(matrix), matrix.sum()
    w = (np.subtract.outer(np.arange(k), np.arange(k)) ** 2) / (k - 1) ** 2
    expected = np.outer(matrix.sum(1), matrix.sum(0)) / n
    below = (w * expected).sum()
    return float(1 - (w * matrix).sum() / below) if below else 1.0


def stuart_maxwell(matrix: np.ndarray) -> tuple[float, int] | None:
    """Chi-squared of marginal homogeneity and its degrees of freedom; None where the covariance is singular."""
    m = matrix.astype(float) + (0.5 if (matrix == 0).any() else 0.0)
    d = (m.sum(1) - m.sum(0))[:-1]
    v = -(m + m.T)
    np.fill_diagonal(v, m.sum(1) + m.sum(0) - 2 * np.diag(m))
    try:
        return float(d @ np.linalg.solve(v[:-1, :-1], d)), len(m) - 1
    except np.linalg.LinAlgError:
        return None


def average_ranks(x: np.ndarray) -> np.ndarray:
    _, inverse, count = np.unique(x, return_inverse=True, return_counts=True)
    ends = np.cumsum(count)
    return (ends - (count - 1) / 2)[inverse]


def friedman(scores: np.ndarray) -> float:
    """Tie-corrected chi-squared of models (columns) over blocks (rows)."""
    n, k = scores.shape
    if k < 3:
        raise ValueError("at least three models")
    ranks = np.stack([average_ranks(r) for r in scores])
    ties = sum(float((c**3 - c).sum()) for c in (np.unique(r, return_counts=True)[1] for r in ranks))
    c = 1 - ties / (k * (k * k - 1) * n)
    return float((12 / (k * n * (k + 1)) * (ranks.sum(0) ** 2).sum() - 3 * n * (k + 1)) / c)


def fit_temperature(scores: np.ndarray, true: np.ndarray, *, low: float = 0.05, high: float = 20.0) -> float:
    """The temperature in bounds with the least mean negative log likelihood, by golden section."""
    logs = np.log(np.clip(scores, 1e-12, 1))

    def loss(t: float) -> float:
        z = logs / t
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(true)), true]).mean())

    g = (math.sqrt(5) - 1) / 2
    a, b = low, high
    while b - a > 1e-6:
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return (a + b) / 2


def normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2)) / 2


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + term * d or 1e-300)
        c = 1 + term / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def student_p(t: float, df: float) -> float:
    """Two-sided."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def wilcoxon(a, b) -> tuple[float, float]:
    """Signed-rank statistic (the smaller sum) and two-sided p-value: zero differences left out; exact up to 50 without ties, else normal."""
    d = np.asarray(a, dtype=float) - np.asarray(b, dtype=float)
    if not len(d):
        raise ValueError("no scores")
    zeros = bool((d == 0).any())
    d = d[d != 0]
    n = len(d)
    if not n:
        return 0.0, 1.0
    ranks = average_ranks(np.abs(d))
    plus = float(ranks[d > 0].sum())
    statistic = min(plus, n * (n + 1) / 2 - plus)
    ties = np.unique(np.abs(d), return_counts=True)[1]
    if n <= 50 and not zeros and (ties == 1).all():
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):  # subsets of the ranks by their sum
            ways[r:] = ways[r:] + ways[:-r]
        return statistic, min(1.0, 2 * float(ways[: int(statistic) + 1].sum() / 2.0**n))
    deviation = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - float((ties**3 - ties).sum()) / 48)
    return statistic, min(1.0, 2 * normal_tail((statistic - n * (n + 1) / 4) / deviation))


def mann_whitney(a, b) -> tuple[float, float]:
    """U of a and its two-sided p-value by the normal approximation, with corrections for ties and continuity."""
    x = np.concatenate([np.asarray(a, dtype=float), np.asarray(b, dtype=float)])
    n, m = len(a), len(b)
    u = float(average_ranks(x)[:n].sum()) - n * (n + 1) / 2
    ties = np.unique(x, return_counts=True)[1]
    total = n + m
    deviation = math.sqrt(n * m / 12 * ((total + 1) - float((ties**3 - ties).sum()) / (total * (total - 1))))
    return u, min(1.0, 2 * normal_tail(max(0.0, abs(u - n * m / 2) - 0.5) / deviation)) if deviation else 1.0


def range_quantile(p: float, k: int) -> float:
    """Quantile of the studentised range of k groups with endless degrees of freedom: P(range <= q) integrated over the smallest."""
    z = np.linspace(-9, 9, 4001)
    density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    cdf = np.array([0.5 * math.erfc(-x / math.sqrt(2)) for x in z])

    def probability(q: float) -> float:
        above = np.array([0.5 * math.erfc(-(x + q) / math.sqrt(2)) for x in z])
        return float(k * np.trapezoid(density * (above - cdf) ** (k - 1), z))

    low, high = 0.0, 20.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if probability(mid) < p else (low, mid)
    return (low + high) / 2


def nemenyi(scores: np.ndarray, *, alpha: float = 0.05) -> tuple[np.ndarray, float]:
    """Average ranks of models (columns, higher scores first) and the critical difference."""
    if scores.size == 0:
        raise ValueError("no scores")
    n, k = scores.shape
    if k < 2:
        raise ValueError("at least two models")
    ranks = np.stack([average_ranks(-r) for r in scores]).mean(0)
    return ranks, range_quantile(1 - alpha, k) / math.sqrt(2) * math.sqrt(k * (k + 1) / (6 * n))


def corrected_t(a, b, *, n_train: int, n_test: int) -> tuple[float, float, float]:
    """Statistic, two-sided p-value and mean difference over folds, with the variance corrected for shared training rows."""
    d = np.asarray(a, dtype=float) - np.asarray(b, dtype=float)
    if len(d) < 2:
        raise ValueError("at least two folds")
    mean, variance = float(d.mean()), float(d.var(ddof=1))
    if variance == 0:
        return (0.0, 1.0, mean) if mean == 0 else (math.inf, 0.0, mean)
    t = mean / math.sqrt((1 / len(d) + n_test / n_train) * variance)
    return t, student_p(t, len(d) - 1), mean


def paired_bootstrap(cells: np.ndarray, statistic, *, n_bootstrap: int = 1000, confidence: float = 0.95, seed: int = 42) -> tuple[float, float, float]:
    """Difference of a statistic of two models and its interval, from joint counts (true, predicted by a, predicted by b).

    Rows resampled in pairs are cells resampled from a multinomial, so the cost doesn't grow with the rows.
    """
    difference = lambda x: statistic(x.sum(-1)) - statistic(x.sum(-2))
    flat = cells.reshape(-1)
    n = int(flat.sum())
    draws = np.random.default_rng(seed).multinomial(n, flat / n, size=n_bootstrap).reshape(n_bootstrap, *cells.shape)
    low, high = np.quantile(difference(draws), [(1 - confidence) / 2, (1 + confidence) / 2])
    return float(difference(cells)), float(low), float(high)


def slice_against_rest(inside: np.ndarray, outside: np.ndarray, *, least: int = 30, n_bootstrap: int = 1000, confidence: float = 0.95, seed: int = 42) -> dict[str, float | bool]:
    """Macro F1 of a slice's confusion matrix and of the rest's, each with draws of its own, their difference, and whether the slice is worse."""
    rng = np.random.default_rng(seed)
    tail = [(1 - confidence) / 2, (1 + confidence) / 2]

    def draws(m: np.ndarray) -> np.ndarray:
        n = int(m.sum())
        return macro_f1(rng.multinomial(n, m.reshape(-1) / max(n, 1), size=n_bootstrap).reshape(n_bootstrap, *m.shape)) if n else np.zeros(n_bootstrap)

    a, b = draws(inside), draws(outside)
    low, high = np.quantile(a, tail)
    worse_low, worse_high = np.quantile(a - b, tail)
    n = int(inside.sum())
    return {
        "n": n, "share": n / max(1, n + int(outside.sum())), "small_sample": n < least, "accuracy": float(np.trace(inside)) / max(1, n), "f1_macro": float(macro_f1(inside)), "f1_macro_low": float(low),
        "f1_macro_high": float(high), "f1_macro_rest": float(macro_f1(outside)), "difference": float(macro_f1(inside) - macro_f1(outside)), "difference_low": float(worse_low),
        "difference_high": float(worse_high), "significantly_worse": bool(n >= least and worse_high < 0),
    }


def permutation_p(observed: float, null: np.ndarray) -> float:
    return (1 + int((np.asarray(null) >= observed).sum())) / (1 + len(null))


def sanity_decision(ci_low: float, p: float, *, chance: float, min_effect: float, alpha: float = 0.05) -> tuple[bool, str]:
    if ci_low <= chance + min_effect:
        return False, f"lower bound {ci_low:.4f} is not above {chance + min_effect:.4f}"
    return (True, "signal") if p < alpha else (False, f"p-value {p:.4f} is not below {alpha}")


def alpha_nominal(ratings: list[list]) -> float:
    """Krippendorff's alpha of units by raters with missing (None) ratings; 1 where only one value occurs, nan without pairs."""
    counts: dict[tuple, float] = {}
    for unit in ratings:
        seen = [x for x in unit if x is not None]
        for i, x in enumerate(seen):
            for j, y in enumerate(seen):
                if i != j:
                    counts[x, y] = counts.get((x, y), 0.0) + 1 / (len(seen) - 1)
    total = sum(counts.values())
    if not total:
        return math.nan
    margin: dict = {}
    for (x, _), c in counts.items():
        margin[x] = margin.get(x, 0.0) + c
    observed = sum(c for (x, y), c in counts.items() if x != y)
    expected = (total * total - sum(c * c for c in margin.values())) / (total - 1)
    return 1.0 if expected == 0 else 1 - observed / expected


def match_pairs(similarity: np.ndarray) -> list[tuple[int, int]]:
    """The pairing of rows and columns with the highest total (shortest augmenting paths)."""
    turned = similarity.shape[0] > similarity.shape[1]
    cost = -(similarity.T if turned else similarity)
    n, m = cost.shape
    u, v, of = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        of[0], j0 = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while of[j0]:
            used[j0] = True
            free = np.flatnonzero(~used[1:]) + 1
            reduced = cost[of[j0] - 1, free - 1] - u[of[j0]] - v[free]
            better = reduced < least[free]
            least[free[better]], way[free[better]] = reduced[better], j0
            j1 = free[np.argmin(least[free])]
            delta = least[j1]
            u[of[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
        while j0:
            of[j0], j0 = of[way[j0]], way[j0]
    found = [(int(of[j]) - 1, j - 1) for j in range(1, m + 1) if of[j]]
    return sorted((b, a) if turned else (a, b) for a, b in found)
