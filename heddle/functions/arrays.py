"""Column builders over probability vectors and other arrays; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def argmax(p: Column) -> Column:
    """0-based index of the largest element, the first on ties."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def total(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda s, x: s + x)


def normalize(p: Column) -> Column:
    """Divide by the sum; a vector without mass stays as it is."""
    return let(p, lambda q: let(total(q), lambda s: F.when(s > 0, F.transform(q, lambda x: x / s)).otherwise(q)))


def clip_normalize(p: Column) -> Column:
    """Clip to [1e-12, 1], then divide by the sum."""
    return normalize(F.transform(p, lambda x: F.least(F.greatest(x, F.lit(EPS)), F.lit(1.0))))


def prob_violation(p: Column) -> Column:
    """Name of the first rule that a probability vector breaks, else null."""
    bad = lambda test: F.exists(p, test)
    return (
        F.when(p.isNull() | (F.size(p) == 0), "empty")
        .when(bad(lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not finite")
        .when(bad(lambda x: x < -EPS), "negative")
        .when(total(p) <= 0, "no mass")
    )


def at_temperature(p: Column, t: Column | float) -> Column:
    """softmax(log p / t) of the clipped vector; t must be positive."""
    t = F.lit(t) if not isinstance(t, Column) else t
    t = F.when(t > 0, t).otherwise(F.raise_error(F.lit("temperature must be positive")).cast("double"))
    shifted = lambda logs: let(F.array_max(logs), lambda top: F.transform(logs, lambda x: F.exp(x - top)))
    scaled = lambda t: let(F.transform(clip_normalize(p), lambda x: F.log(x) / t), shifted)
    return normalize(let(t, scaled))


def entropy(p: Column) -> Column:
    """Entropy over log K of the clipped vector, within [0, 1]."""
    q = clip_normalize(p)
    h = F.aggregate(q, F.lit(0.0), lambda s, x: s - x * F.log(x)) / F.log(F.size(p).cast("double"))
    return F.least(F.greatest(h, F.lit(0.0)), F.lit(1.0))


def agency_loss(p_user: Column, action: Column) -> Column:
    """How much less likely an action is than the user's own, by the user's vector."""
    return F.greatest(F.lit(0.0), F.array_max(p_user) - F.element_at(p_user, action + 1))


def align(p: Column, classes: Column, vocabulary: Column) -> Column:
    """A model's probabilities in the order of a vocabulary, 0 for classes it doesn't know, renormalised."""
    at = lambda v: F.array_position(classes, v)
    return normalize(F.transform(vocabulary, lambda v: F.when(at(v) > 0, F.element_at(p, F.greatest(at(v), F.lit(1)).cast("int"))).otherwise(0.0)))


def one_hot(value: Column, choices: list[float], tolerance: float = 1e-9) -> Column:
    """1.0 at choices within tolerance; unknown and null values give zeros."""
    return F.transform(F.array(*[F.lit(float(c)) for c in choices]), lambda c: F.coalesce((F.abs(c - value) <= tolerance).cast("double"), F.lit(0.0)))


def pad_left(values: Column, length: int) -> Column:
    """The last `length` elements, zeros before them if there are fewer."""
    n = F.size(values)
    return F.when(n >= length, F.slice(values, F.greatest(n - length + 1, F.lit(1)), length)).otherwise(F.concat(F.array_repeat(F.lit(0.0), F.lit(length) - n), values))


def pad_right(values: Column, length: int) -> Column:
    """The first `length` elements, zeros after them if there are fewer."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(0.0), length)), 1, length)
