"""Similarity scalars (M1-M6) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once, scoring_tokens


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def jaccard(a, b) -> Column:
    """M1/M3: set Jaccard of two arrays; 0 when both are empty."""
    def share(x, y):
        return once(F.size(F.array_union(x, y)), lambda union: F.when(
            union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(F.lit(0.0)))

    return once(a, lambda x: once(b, lambda y: share(x, y)))


def characters(c) -> Column:
    """Characters of a string as an array; ``''`` gives an empty array."""
    return once(c, lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, "")))


def char_jaccard(a, b) -> Column:
    """M2: Jaccard over the character sets of two strings."""
    return jaccard(characters(a), characters(b))


def edit_similarity(a, b) -> Column:
    """M4: 1 - levenshtein / longer length; two empty strings give 1."""
    def alike(x, y):
        longest = F.greatest(F.length(x), F.length(y))
        return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(x, y) / longest)

    return once(a, lambda x: once(b, lambda y: alike(x, y)))


def template_similarity(a, b) -> Column:
    """M6: |set(a) & set(b)| / (len a + len b - |set(a) & set(b)|) over scoring tokens."""
    def alike(ta, tb):
        return once(F.size(F.array_intersect(ta, tb)), lambda inter: F.try_divide(
            inter.cast("double"), (F.size(ta) + F.size(tb) - inter).cast("double")))

    return once(scoring_tokens(a), lambda ta: once(scoring_tokens(b), lambda tb: alike(ta, tb)))


def masked_similarity(msg_tokens, known_positions, template_tokens) -> Column:
    """M5: message tokens at known slot positions become ``<*>``, then Jaccard
    with the template's match tokens. Positions are 0-based."""
    msg_tokens, known_positions = _col(msg_tokens), _col(known_positions)
    masked = F.transform(
        msg_tokens,
        lambda x, i: F.when(F.array_contains(F.coalesce(known_positions, F.array().cast("array<int>")), i),
                            F.lit("<*>")).otherwise(x))
    return jaccard(masked, template_tokens)
