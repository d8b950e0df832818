"""Audiences: rating offsets, module gains from prior tables, and the score of gained activations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialworks.functions import stats as S

AXES = ("involvement", "age", "gender", "education")
MODULES = ("salience", "affect", "valuation", "encoding", "approach", "control")
# Half of the measured difference between the groups of an axis; the other group has the opposite sign.
HALVES = {
    ("gender", "male", "female"): (0.0635, 0.1425, -0.008),
    ("age", "younger", "older"): (0.027, 0.091, -0.04),
    ("education", "lower", "higher"): (-0.0295, -0.0695, 0.013),
}
# Spread of valence and arousal over the lexicon, and the least offset that counts as perceptible.
VALENCE_SD, AROUSAL_SD, PERCEPTIBLE = 1.275, 0.897, 0.2
# Gains of an axis value by module, with how sure they are.
GAINS = {
    ("involvement", "high", "moderate"): {"valuation": 1.12, "control": 1.10, "salience": 0.94, "affect": 0.94},
    ("involvement", "low", "moderate"): {"salience": 1.12, "affect": 1.10, "valuation": 0.94, "control": 0.96},
    ("age", "older", "moderate"): {"approach": 1.10, "valuation": 1.06, "affect": 0.95},
    ("age", "younger", "low"): {"affect": 1.06, "salience": 1.04},
    ("gender", "male", "low"): {"affect": 1.05},
    ("gender", "female", "low"): {"affect": 0.95},
    ("education", "higher", "low"): {"control": 1.04, "valuation": 1.03},
    ("education", "lower", "low"): {"salience": 1.04, "affect": 1.03},
}
MOST_GAIN = 0.15


def offset_priors(spark: SparkSession) -> DataFrame:
    """(axis, value, valence, arousal, dominance), a row for each group of an axis."""
    rows = [(axis, value, *(sign * x for x in half)) for (axis, plus, minus), half in HALVES.items() for value, sign in ((plus, 1.0), (minus, -1.0))]
    return spark.createDataFrame(rows, "axis string, value string, valence double, arousal double, dominance double")


def gain_priors(spark: SparkSession) -> DataFrame:
    """(axis, value, confidence, gains as a map), a row for each axis value that has any."""
    return spark.createDataFrame([(*k, g) for k, g in GAINS.items()], "axis string, value string, confidence string, gains map<string, double>")


def _matched(audiences: DataFrame, key: str, axes: list[str], priors: DataFrame) -> DataFrame:
    """A row for each audience and axis, with the prior of the axis's value, if there is one."""
    if priors.count() > 1000:
        raise ValueError("a prior table has a row for each value of an axis")
    long = audiences.select(key, *[F.col(a).cast("string").alias(a) for a in axes]).unpivot([key], axes, "axis", "value")
    return long.join(F.broadcast(priors), ["axis", "value"], "left")


def audience_offset(audiences: DataFrame, key: str, priors: DataFrame) -> DataFrame:
    """(key, valence, arousal, dominance, valence_sd, arousal_sd, perceptible): the sum of the axes' offsets.

    Values that no prior names, nulls among them, add nothing. Sizes are in spreads of the lexicon. Keys are distinct.
    """
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0)).alias(c)
    out = _matched(audiences, key, [a for a in AXES if a != "involvement"], priors).groupBy(key).agg(*[total(c) for c in ("valence", "arousal", "dominance")])
    out = out.withColumns({"valence_sd": F.abs("valence") / VALENCE_SD, "arousal_sd": F.abs("arousal") / AROUSAL_SD})
    return out.withColumn("perceptible", F.greatest("valence_sd", "arousal_sd") >= PERCEPTIBLE)


def segment_gains(audiences: DataFrame, key: str, priors: DataFrame, most: float = MOST_GAIN) -> DataFrame:
    """(key, a gain for each module, applied, unsure, neutral, max_deviation) of audiences with the four axes.

    Gains of one module multiply over the axes (a sum of logarithms, so partial sums meet in any order) and are kept within
    ``most`` of 1. Without any prior all gains are 1 and the audience is neutral. ``unsure`` counts priors of low confidence.
    """
    found = _matched(audiences, key, list(AXES), priors)
    product = lambda m: F.exp(F.sum(F.ln(F.coalesce(F.try_element_at("gains", F.lit(m)), F.lit(1.0)))))
    out = found.groupBy(key).agg(*[F.round(product(m), 12).alias(m) for m in MODULES], F.count("gains").alias("applied"), F.count_if(F.col("confidence") == "low").alias("unsure"))
    out = out.withColumns({m: F.least(F.lit(1 + most), F.greatest(F.lit(1 - most), F.col(m))) for m in MODULES})
    return out.withColumn("max_deviation", F.greatest(*[F.abs(F.col(m) - 1) for m in MODULES])).withColumn("neutral", F.col("max_deviation") == 0)


def apply_gains(activations: DataFrame, gains: DataFrame, key: str) -> DataFrame:
    """Activations of each row of ``activations`` times its audience's gains; all gains come from :func:`segment_gains`."""
    g = gains.select(key, *[F.col(m).alias(f"gain_{m}") for m in MODULES])
    out = activations.join(g, key, "left").withColumns({m: F.col(m) * F.coalesce(f"gain_{m}", F.lit(1.0)) for m in MODULES})
    return out.drop(*[f"gain_{m}" for m in MODULES])


def module_score(weights: dict[str, float]) -> Column:
    """Score of (gained) activations: salience gates valuation, arousal helps encoding, and affect counts as an inverted U.

    ``weights``: gate_w, gate_b, arousal_to_encoding, arousal_quad, arousal_lin, fluency, load, free_salience,
    free_valuation, free_encoding, bias. Column algebra only.
    """
    w, c = weights, F.col
    valuation = c("valuation") * S.sigmoid(w["gate_w"] * c("salience") + w["gate_b"])
    encoding = c("encoding") * (1 + w["arousal_to_encoding"] * c("affect"))
    free = w["free_salience"] * c("salience") + w["free_valuation"] * valuation + w["free_encoding"] * encoding
    return w["arousal_quad"] * c("affect") * c("affect") + w["arousal_lin"] * c("affect") + w["fluency"] * c("control") + w["load"] * (1 - c("control")) + free + w["bias"]
