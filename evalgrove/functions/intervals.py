"""Intervals for rates and their differences as column expressions."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = NormalDist().inv_cdf(0.975)


def wilson(successes: Column, n: Column, z: float = Z95) -> dict[str, Column]:
    """mean, n, stdev, ci_low and ci_high of a rate; without items mean 0, n 0 and nulls.

    The ends are exactly 0 and 1 where no item, or every item, counts.
    """
    s, m = successes.cast("double"), n.cast("double")
    p = F.try_divide(s, m)
    spread = F.lit(z) / (1 + z * z / m) * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    centre = (p + z * z / (2 * m)) / (1 + z * z / m)
    some = n > 0
    return {
        "mean": F.when(some, p).otherwise(0.0),
        "n": n.cast("long"),
        "stdev": F.when(some, F.sqrt(p * (1 - p) / m)),
        "ci_low": F.when(some, F.when(successes == 0, 0.0).otherwise(F.greatest(F.lit(0.0), centre - spread))),
        "ci_high": F.when(some, F.when(successes == n, 1.0).otherwise(F.least(F.lit(1.0), centre + spread))),
    }


def wilson_columns(successes: Column, n: Column, prefix: str = "", digits: int | None = 9) -> list[Column]:
    """The interval's columns, rounded for comparison."""
    def end(c: Column) -> Column:
        return F.round(c, digits) if digits is not None else c

    w = wilson(successes, n)
    return [(w[k] if k == "n" else end(w[k])).alias(prefix + k) for k in ("mean", "n", "stdev", "ci_low", "ci_high")]


def rate(flag: Column, prefix: str = "") -> list[Column]:
    """Aggregates: the share of rows whose flag is true, of those whose flag isn't null, with its interval."""
    return wilson_columns(F.count_if(F.coalesce(flag, F.lit(False))), F.count(flag), prefix)


def newcombe(mean_a: Column, low_a: Column, high_a: Column, n_a: Column, mean_b: Column, low_b: Column, high_b: Column, n_b: Column) -> dict[str, Column]:
    """The difference of two Wilson rates with its hybrid-score interval; null unless both have items."""
    both = (n_a > 0) & (n_b > 0)
    delta = mean_a - mean_b
    low = delta - F.sqrt(F.pow(mean_a - low_a, 2) + F.pow(high_b - mean_b, 2))
    high = delta + F.sqrt(F.pow(high_a - mean_a, 2) + F.pow(mean_b - low_b, 2))
    return {
        "delta": F.when(both, delta), "delta_n": F.when(both, F.least(n_a, n_b)),
        "delta_low": F.when(both, F.greatest(F.lit(-1.0), low)), "delta_high": F.when(both, F.least(F.lit(1.0), high)),
    }


def disjoint(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    """Whether two intervals share no point; null if an end is unknown."""
    return (low_a > high_b) | (low_b > high_a)


def wilson_sql(s: str, n: str, prefix: str = "") -> str:
    """The same columns as DuckDB SQL."""
    z, p = repr(Z95), f"(({s})::double/({n}))"
    spread = f"({z}/(1+{z}*{z}/({n}))*sqrt({p}*(1-{p})/({n})+{z}*{z}/(4.0*({n})*({n}))))"
    centre = f"(({p}+{z}*{z}/(2.0*({n})))/(1+{z}*{z}/({n})))"
    return (
        f"round(case when ({n})>0 then {p} else 0.0::double end, 9) as {prefix}mean, cast({n} as bigint) as {prefix}n, "
        f"round(case when ({n})>0 then sqrt({p}*(1-{p})/({n})) end, 9) as {prefix}stdev, "
        f"round(case when ({n})>0 then case when ({s})=0 then 0.0::double else greatest(0.0, {centre}-{spread}) end end, 9) as {prefix}ci_low, "
        f"round(case when ({n})>0 then case when ({s})=({n}) then 1.0::double else least(1.0, {centre}+{spread}) end end, 9) as {prefix}ci_high"
    )
