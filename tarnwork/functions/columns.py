"""Plain Column expressions, all evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two tokens that mark a device of another maker.
EXTERNAL_TOKENS = ("未知", "未知型号")
# Blank and "none" mean a confirmed absence; the last means "not visible".
NONE_TOKENS = ("", "无")
OCCLUDED = "遮挡"
UNKNOWN_DEVICE = "未知型号"
NOT_OVEN_DEVICE = "无"


def strip(s: Column) -> Column:
    """Unicode white space off both ends (``trim`` takes U+0020 only)."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def is_none(s: Column, tokens: Sequence[str] = NONE_TOKENS) -> Column:
    """A null, or a string that strips to a none token."""
    return s.isNull() | strip(s).isin("", *tokens)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also where a lambda uses it for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ratio(num: Column, den: Column) -> Column:
    """num / den, null for an empty denominator (ANSI mode would raise)."""
    return F.when(den > 0, num.cast("double") / den)


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def l2_normalised(v: Column) -> Column:
    """v / max(|v|, 1e-12), in doubles."""

    def scaled(x: Column) -> Column:
        return let(F.greatest(F.sqrt(dot(x, x)), F.lit(1e-12)), lambda norm: F.transform(x, lambda c: c / norm))

    return let(F.transform(v, lambda c: c.cast("double")), scaled)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(logits: Column) -> Column:
    """Shifted by the maximum; masked entries are -infinity and get 0."""

    def shifted(v: Column) -> Column:
        return let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top)))

    def scaled(e: Column) -> Column:
        return let(total(e), lambda s: F.transform(e, lambda x: x / s))

    return let(logits, lambda v: let(shifted(v), scaled))


def first_argmax(xs: Column) -> Column:
    """0-based index of the maximum, the first one on ties."""
    return (F.array_position(xs, F.array_max(xs)) - 1).cast("int")


def level_mask(logits: Column, levels: Column, floor_usable: Column) -> Column:
    """Logits of levels that a device does not have become -infinity; level 0 is the floor."""

    def keep(x: Column, k: Column) -> Column:
        return F.when((k <= levels) & ((k > 0) | floor_usable), x).otherwise(F.lit(float("-inf")))

    return F.transform(logits, keep)


def multi_hot(names: Column, vocabulary: Sequence[str]) -> Column:
    """1.0 / 0.0 in vocabulary order; null names give zeros."""
    return F.array(*[F.coalesce(F.array_contains(names, c), F.lit(False)).cast("double") for c in vocabulary])


def score_map(scores: Column, vocabulary: Sequence[str]) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, vocabulary)), F.transform(scores, lambda x: F.round(x, 4)))


def normalised_value(x: Column) -> Column:
    """A list for comparison by value: sorted strings."""
    return F.array_sort(F.transform(x, lambda c: c.cast("string")))


def is_external(model: Column) -> Column:
    return F.coalesce(model.isin(*EXTERNAL_TOKENS), F.lit(False))


def has_item(food: Column, container: Column, accessory: Column) -> Column:
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False)) & c.isNotNull()
    return F.coalesce(food, F.lit(False)) | some(container) | some(accessory)


def items_known(food: Column, container: Column, accessory: Column) -> Column:
    return food.isNotNull() & container.isNotNull() & accessory.isNotNull()
