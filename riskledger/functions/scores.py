"""Score formulas as column expressions: the heuristic label, the adverse-outcome
composite, ceilings, tiers, recommendations, z-scores and the normal CDF."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two-digit industry sectors that have an indicator column.
SECTORS = ["11", "21", "22", "23", "31", "32", "33", "42", "44", "45", "48", "49", "51", "52", "53", "54", "55", "56", "61", "62", "71", "72", "81", "92"]
#: Features that are log-compressed.
LOGGED = ["n_inspections", "n_violations", "total_penalty", "avg_penalty", "max_penalty", "accident_rate", "fatality_rate", "injury_rate", "penalty_per_inspection"]


def where(test: Column, value: Column | float, other: Column | float = 0.0) -> Column:
    """value where test holds, else other (also where test is null)."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(test, lit(value)).otherwise(lit(other))


def capped(x: Column, most: float) -> Column:
    return F.least(x, F.lit(float(most)))


def heuristic_label(c: Mapping[str, Column]) -> Column:
    """Label from 0 to 100 (to 9 decimals, so that equal cases tie) of an establishment's feature columns (see operators.features)."""
    n, ser, wil, rep, sev = c["n_inspections"], c["serious_rate"], c["willful_rate"], c["repeat_rate"], c["severe_rate"]
    acc, fat, inj, rr = c["accident_rate"], c["fatality_rate"], c["injury_rate"], c["recent_ratio"]
    vpi, grav, tot, ppi, clean = c["violations_per_inspection"], c["avg_gravity"], c["total_penalty"], c["penalty_per_inspection"], c["clean_ratio"]
    dormant = rr < 0.01
    scale, confidence = where(dormant, 0.5, 1.0), capped(0.5 + n / 10, 1.0)
    deaths = where(fat > 0, capped(12 + 3 * F.greatest(capped(5 * fat, 5) - 1, F.lit(0.0)), 24) * scale * confidence)
    harm = capped(deaths + capped(25 * sev, 6) + capped(6 * inj, 4) + capped(10 * acc, 4), 34)
    kind = scale * (capped(14 * wil, 14) + capped(10 * rep, 10))
    gravity = capped(8 * ser, 8) + where(grav > 0, capped(0.6 * grav, 6))
    pace = 12 * rr + capped(2.5 * vpi, 10)
    rising, falling = (rr > 0.5) & (vpi >= 1.5), (rr < 0.2) & (vpi < 0.5) & (n >= 3)
    course = F.when(rising, capped(2 * (rr - 0.5) * (vpi - 1), 8)).when(falling, -capped(10 * (0.2 - rr), 5)).otherwise(0.0)
    money = where(tot > 0, capped(0.4 * F.log1p(tot), 4)) + where(ppi > 0, capped(0.3 * F.log1p(ppi), 2))
    unknown = where(c["naics_unknown"] == 1, 4.0)
    harmless = ~((fat > 0) | (acc > 0) | (sev > 0)) | dormant
    credit = F.when((clean > 0) & harmless, F.when(n >= 3, -10 * clean).when(n == 2, -4 * clean).otherwise(0.0)).otherwise(0.0)
    sparse = F.when(n <= 1, 2.5).when(n <= 3, 1.5).when(n <= 5, 0.5).otherwise(0.0)
    together = where((fat > 0) & (wil + rep > 0), 8 * confidence * scale) + where((wil > 0) & (rep > 0), 5 * confidence * scale) + where((rr > 0.5) & (ser >= 0.25), 4.0)
    total = harm + kind + gravity + pace + course + money + unknown + credit + sparse + together
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total)), 9)


def adverse_outcome(fatalities: Column, willful_repeat: Column, serious: Column, penalty: Column, violations: Column, inspections: Column) -> Column:
    """Severity of an outcome window, 0 to about 88."""
    return F.round(
        where(fatalities > 0, 20.0) + where(fatalities > 1, capped(5.0 * (fatalities - 1), 15)) + where(willful_repeat > 0, 8.0) + capped(3.0 * willful_repeat, 15)
        + capped(serious.cast("double"), 10) + capped(0.8 * F.log1p(penalty), 10) + capped(2.0 * violations / inspections, 10),
        9,
    )


def ceiling(n: Column, fatal: Column, willful: Column) -> Column:
    """The highest score that so much evidence supports."""
    return F.when((fatal > 0) & (willful > 0), 70.0).when(n <= 2, 50.0).when(n <= 4, 58.0).otherwise(100.0)


def recommendation(score: Column, sites: Column, systemic: Column) -> Column:
    return F.when((score >= 60) & ((sites <= 1) | systemic), "Do Not Recommend").when(score >= 60, "Proceed with Caution").when(score < 30, "Recommend").otherwise("Proceed with Caution")


def tier(score: Column) -> Column:
    return F.when(score < 30, "Low").when(score < 60, "Medium").otherwise("High")


def z_score(x: Column, mean: Column, std: Column, clip: float | None = 3.0) -> Column:
    """Clipped to -clip..clip, if that is given; null without statistics."""
    z = (x - mean) / F.greatest(F.abs(std), F.lit(1e-6))
    return F.when(mean.isNotNull(), z if clip is None else F.greatest(F.lit(-clip), F.least(F.lit(clip), z)))


def erf(x: Column) -> Column:
    """Rational approximation (Abramowitz and Stegun 7.1.26), error below 1.5e-7."""
    t = 1 / (1 + 0.3275911 * F.abs(x))
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def normal_percentile(z: Column) -> Column:
    return F.bround(50 * (1 + erf(z / F.sqrt(F.lit(2.0)))), 1)


def confidence_label(similarity: Column) -> Column:
    return F.when(similarity >= 0.85, "High").when(similarity >= 0.65, "Medium").otherwise("Low")


def evidence_tag(n: Column, recent: Column) -> Column:
    return F.when((n >= 5) & (recent >= 1), "High").when(n <= 1, "Low").otherwise("Medium")


def tail_weight(label: Column) -> Column:
    return F.greatest(F.lit(1.0), F.least(F.lit(8.0), 1 + F.greatest(F.lit(0.0), label - 30) / 10))
