"""Scoring models as column expressions over term and collection statistics."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Stats:
    """Columns: tf in the document, df and ctf of the term, dl of the document; N documents of avgdl tokens, total tokens."""

    tf: Column
    df: Column
    ctf: Column
    dl: Column
    n: Column
    avgdl: Column
    total: Column


Model = Callable[[Stats], Column]


def bm25_idf(df: Column, n: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25_tf(tf: Column, dl: Column, avgdl: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def bm25(k1: float = 1.2, b: float = 0.75) -> Model:
    return lambda s: bm25_idf(s.df, s.n) * bm25_tf(s.tf, s.dl, s.avgdl, k1, b)


def tf_idf_legacy(s: Stats) -> Column:
    return F.sqrt(s.tf) * (1 + F.log(s.n / (s.df + 1))) / F.sqrt(s.dl)


def classic(s: Stats) -> Column:
    """Classic TF-IDF: square root of tf, squared idf, length norm."""
    idf = F.log((s.n + 1) / (s.df + 1)) + 1
    return F.sqrt(s.tf) * idf * idf / F.sqrt(s.dl)


def sweet_spot(low: int = 10, high: int = 100, steepness: float = 0.5) -> Model:
    """Classic TF-IDF with a length norm of 1 between ``low`` and ``high`` tokens, falling on either side."""

    def score(s: Stats) -> Column:
        idf = F.log((s.n + 1) / (s.df + 1)) + 1
        outside = F.abs(s.dl - low) + F.abs(s.dl - high) - (high - low)
        return F.sqrt(s.tf) * idf * idf / F.sqrt(steepness * outside + 1)

    return score


def sum_of(*models: Model) -> Model:
    """The sum of several models' scores."""
    return lambda s: sum((m(s) for m in models[1:]), models[0](s))


def boolean(s: Stats) -> Column:
    return F.lit(1.0) + 0 * s.tf


def lm_dirichlet(mu: float = 2000.0) -> Model:
    def score(s: Stats) -> Column:
        p = (s.ctf + 1) / (s.total + 1)
        return F.greatest(F.lit(0.0), F.log(1 + s.tf / (mu * p)) + F.log(mu / (s.dl + mu)))

    return score


def lm_jelinek_mercer(mix: float = 0.7) -> Model:
    return lambda s: F.log(1 + ((1 - mix) * s.tf / s.dl) / (mix * (s.ctf + 1) / (s.total + 1)))


def _log2(x: Column) -> Column:
    return F.log(x) / F.log(F.lit(2.0))


def _bose_einstein(total: Column, n: Column, f: Column) -> Column:
    """Limiting form of the Bose-Einstein model; ``n`` counts documents and occurrences."""
    part = lambda a, b: (b + 0.5) * _log2(a / b) + (a - b) * _log2(a)
    return part(n + total - 1, n + total - f - 2) - part(total, total - f) - _log2((n - 1) * math.e)


def _divergence(total: Column, f: Column, p: Column) -> Column:
    """Divergence of a term's share ``f`` / ``total`` from the chance ``p``, by the binomial's approximation."""
    share = f / total
    d = share * _log2(share / p) + (1 - share) * _log2((1 - share) / (1 - p))
    return d * total + 0.5 * _log2(1 + 2 * math.pi * f * (1 - share))


#: Basic models of divergence from randomness: of s and the normalised frequency.
BASIC: dict[str, Callable[[Stats, Column], Column]] = {
    "be": lambda s, f: _bose_einstein(s.ctf + 1 + f, s.ctf + 1 + f + s.n, f),
    "d": lambda s, f: _divergence(s.ctf + 1 + f, f, 1 / (s.n + 1)),
    "p": lambda s, f: (lambda m: f * _log2(f / m) + (m + 1 / (12 * f) - f) * _log2(F.lit(math.e)) + 0.5 * _log2(2 * math.pi * f))((s.ctf + 1) / (s.n + 1)),
    "g": lambda s, f: (lambda x: _log2(x + 1) + f * _log2((1 + x) / x))((s.ctf + 1) / (s.n + s.ctf + 1)),
    "if": lambda s, f: f * _log2(1 + (s.n + 1) / (s.ctf + 0.5)),
    "in": lambda s, f: f * _log2((s.n + 1) / (s.df + 0.5)),
    "ine": lambda s, f: f * _log2((s.n + 1) / (s.n * (1 - F.pow((s.n - 1) / s.n, s.ctf)) + 0.5)),
}
#: After effects: of s and the normalised frequency.
AFTER: dict[str, Callable[[Stats, Column], Column]] = {
    "none": lambda s, f: F.lit(1.0),
    "l": lambda s, f: 1 / (f + 1),
    "b": lambda s, f: (s.ctf + 2) / ((s.df + 1) * (f + 1)),
}
#: Normalisations of tf by length.
NORM: dict[str, Callable[[Stats], Column]] = {
    "none": lambda s: s.tf.cast("double"),
    "h1": lambda s: s.tf * s.avgdl / s.dl,
    "h2": lambda s: s.tf * _log2(1 + s.avgdl / s.dl),
    "h3": lambda s: (s.tf + 800 * (s.ctf + 1) / (s.total + 1)) / (s.dl + 800) * 800,
    "z": lambda s: s.tf * F.pow(s.avgdl / s.dl, 0.3),
}


def dfr(basic: str = "in", after: str = "l", norm: str = "h2") -> Model:
    def score(s: Stats) -> Column:
        f = NORM[norm](s)
        return BASIC[basic](s, f) * AFTER[after](s, f)

    return score


def information_based(distribution: str = "ll", lam: str = "df", norm: str = "h2") -> Model:
    """Log-logistic (ll) or smoothed power-law (spl) model with the mean by df or total frequency (ttf)."""

    def score(s: Stats) -> Column:
        f = NORM[norm](s)
        m = ((s.df if lam == "df" else s.ctf) + 1) / (s.n + 1)
        if distribution == "ll":
            return -F.log(m / (f + m))
        m = F.when(m == 1, 0.99).otherwise(m)
        return -F.log((F.pow(m, f / (f + 1)) - m) / (1 - m))

    return score


def dfi(measure: str = "standardized") -> Model:
    """Divergence from independence by the standardized, saturated or chi-squared measure."""

    def score(s: Stats) -> Column:
        expected = (s.ctf + 1) * s.dl / (s.total + 1)
        over = s.tf - expected
        by = {"standardized": over / F.sqrt(expected), "saturated": over / expected, "chisquared": over * over / expected}[measure]
        return F.when(s.tf <= expected, 0.0).otherwise(_log2(by + 1))

    return score


def axiomatic(form: int, exponential: bool, slope: float = 0.25, k: float = 0.35, query_length: int = 1) -> Model:
    """The axiomatic models: form 1 damps frequency and length apart, 2 together, 3 subtracts a penalty for length.

    The weight of a rare term is a power of N / df if ``exponential``, else its logarithm.
    """

    def score(s: Stats) -> Column:
        rare = F.pow((s.n + 1) / s.df, k) if exponential else F.log((s.n + 1) / s.df)
        damped = 1 + F.log(1 + F.log(s.tf))
        if form == 1:
            return damped * (s.avgdl + slope) / (s.avgdl + s.dl * slope) * rare
        if form == 2:
            return s.tf / (s.tf + slope + slope * s.dl / s.avgdl) * rare
        return damped * rare - (s.dl - query_length) * slope * query_length / s.avgdl

    return score


MODELS: dict[str, Model] = {
    "bm25": bm25(),
    "tf_idf_legacy": tf_idf_legacy,
    "classic": classic,
    "boolean": boolean,
    "sweet_spot": sweet_spot(),
    "sum_of_models": sum_of(boolean, classic),
    "lm_dirichlet": lm_dirichlet(),
    "lm_jelinek_mercer": lm_jelinek_mercer(),
    **{f"axiomatic_f{form}{kind}": axiomatic(form, kind == "exp") for form in (1, 2, 3) for kind in ("exp", "log")},
    **{f"dfr_{b}_{a}_{n}": dfr(b, a, n) for b in BASIC for a in AFTER for n in NORM},
    **{f"ib_{d}_{lam}_{n}": information_based(d, lam, n) for d in ("ll", "spl") for lam in ("df", "ttf") for n in NORM},
    **{f"dfi_{m}": dfi(m) for m in ("standardized", "saturated", "chisquared")},
}
