"""Column expressions for rates, effects and intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.96


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash01(key: Column | str, seed) -> Column:
    """Deterministic uniform number in [0, 1) of a key and a seed."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    h = F.md5(F.concat_ws("|", col(key).cast("string"), seed.cast("string")).cast("binary"))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def smoothed_rate(clicks: Column | str, impressions: Column | str) -> Column:
    return (col(clicks) + 0.5) / (col(impressions) + 1.0)


def log_odds_variance(clicks: Column | str, impressions: Column | str) -> Column:
    return 1.0 / (col(clicks) + 0.5) + 1.0 / (col(impressions) - col(clicks) + 0.5)


def clamped(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))


def local_ceiling(impressions: Column, rate: Column, effect_sd: float = 0.098) -> Column:
    """Best pairwise accuracy at a sample size for effects of the given spread."""
    p, n = clamped(rate), F.greatest(impressions.cast("double"), F.lit(1.0))
    noise = F.sqrt(2 * (1 / (n * p) + 1 / (n * (1 - p))))
    return 0.5 + F.atan(F.lit(effect_sd) / noise) / math.pi


def required_impressions(delta: Column, rate: Column, z: float = Z95) -> Column:
    """Impressions per arm that resolve a log-odds difference; null when there is none to resolve."""
    d, p = F.abs(delta), clamped(rate)
    return F.when(d >= 1e-6, F.ceil(2 * F.pow(z / d, F.lit(2)) * (1 / p + 1 / (1 - p))).cast("double"))


def wilson(k: Column | str, n: Column | str, z: float = Z95) -> tuple[Column, Column]:
    """Wilson interval of k successes in n; [0, 1] for n = 0."""
    k, n = col(k).cast("double"), col(n).cast("double")
    safe = F.greatest(n, F.lit(1.0))
    p, d = k / safe, 1 + z * z / safe
    mid, half = (p + z * z / (2 * safe)) / d, z * F.sqrt(p * (1 - p) / safe + z * z / (4 * safe * safe)) / d
    return (F.when(n > 0, F.greatest(mid - half, F.lit(0.0))).otherwise(0.0), F.when(n > 0, F.least(mid + half, F.lit(1.0))).otherwise(1.0))


def ln_factorial(n: Column) -> Column:
    """ln n!: by Stirling's series from 32 on, where its next term is below 1e-16, and as a sum below."""
    x = F.greatest(n, F.lit(32)).cast("double")
    large = x * F.ln(x) - x + 0.5 * F.ln(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5))) - 1 / (1680 * F.pow(x, F.lit(7)))
    small = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(n, F.lit(32))).cast("int")), F.lit(0.0), lambda a, i: a + F.ln(i.cast("double")))
    return F.when(n >= 32, large).otherwise(small)


def mcnemar_exact(b: Column | str, c: Column | str) -> Column:
    """Two-sided exact p-value on discordant counts; 1 for no discordant item.

    The terms of the smaller count and below are taken relative to the last, which is the largest, so the work grows with
    that count; only the last one's logarithm needs factorials."""
    b, c = col(b).cast("int"), col(c).cast("int")
    n, k = b + c, F.least(b, c)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    next_ = lambda a, i: a["term"] * i / (n - i + 1)  # noqa: E731  from the term of i to that of i - 1
    rest = F.aggregate(F.filter(F.sequence(k, F.lit(0)), lambda i: i > 0), start, lambda a, i: F.struct(next_(a, i).alias("term"), (a["sum"] + next_(a, i)).alias("sum")), lambda a: a["sum"])
    last = F.exp(ln_factorial(n) - ln_factorial(k) - ln_factorial(n - k) - n * math.log(2))
    return F.when(n > 0, F.least(F.lit(1.0), 2 * last * rest)).otherwise(1.0)


def items_needed(p_human: Column, p_model: Column) -> Column:
    """Answered items that detect a human/model gap with 80 % power; 0 where the judges cannot be told apart."""
    d = p_human * (1 - p_model) + p_model * (1 - p_human)
    q = p_model * (1 - p_human) / F.nullif(d, F.lit(0.0))
    n = F.pow(Z95 * 0.5 + 0.84 * F.sqrt(q * (1 - q)), F.lit(2)) / F.pow(q - 0.5, F.lit(2))
    return F.when((d > 0) & (F.abs(q - 0.5) >= 1e-9), F.ceil(n / d)).otherwise(0).cast("long")


def outcomes_needed(rate: Column) -> Column:
    """Outcomes that would show a rate above one half; null where it is not above."""
    n = F.pow((Z95 * 0.5 + 0.84 * F.sqrt(rate * (1 - rate))) / (rate - 0.5), F.lit(2))
    return F.when(rate > 0.5, F.ceil(n)).cast("long")


def confidence_tier(margin: Column, high: float = 0.948, moderate: float = 0.519) -> Column:
    return F.when(margin >= high, "high").when(margin >= moderate, "moderate").otherwise("insufficient")


def readiness(n: Column, floor: int = 200) -> tuple[Column, Column]:
    """Whether a tenant may be fitted on its own, and how far to shrink it to the global fit."""
    return n >= floor, F.greatest(F.lit(0.0), 1 - n / F.lit(float(floor)))


def sigmoid(x: Column) -> Column:
    """Logistic function that overflows on neither side."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


# The rational approximation 7.1.26 of Abramowitz and Stegun.
ERF_P, ERF_A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: Column) -> Column:
    """Error function, to 1.5e-7."""
    t = 1 / (1 + ERF_P * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def gelu(x: Column) -> Column:
    return x * 0.5 * (1 + erf(x / math.sqrt(2)))


def layer_norm(v: Column, eps: float = 1e-5) -> Column:
    """A vector less its mean over its spread (the variance divides by the vector's length)."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    once = lambda c, f: F.transform(F.array(c), f)[0]  # noqa: E731  c is computed once and not wherever f uses it
    centred = once(v, lambda a: once(total(a) / F.size(a), lambda m: F.transform(a, lambda x: x - m)))
    return once(centred, lambda a: once(F.sqrt(total(F.transform(a, lambda x: x * x)) / F.size(a) + eps), lambda sd: F.transform(a, lambda x: x / sd)))
