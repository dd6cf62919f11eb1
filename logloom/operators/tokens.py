"""Dictionary and token predicates.

The word dictionary is a DataFrame ``<word>`` (lower case, case-sensitive
lookups as in the reference). Lookups are equi-joins; Spark's adaptive
execution broadcasts the dictionary only when its measured size is under the
broadcast threshold and falls back to a shuffle join otherwise, so no size is
assumed here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import message_tokens, remove_punctuation, zero_digits

ALPHA_WORD = "^[A-Za-z]+$"


def corpus_dictionary(logs: DataFrame, content: str = "Content", min_messages: int = 50) -> DataFrame:
    """Common words: lower-cased alphabetic match tokens occurring in at least
    ``min_messages`` messages. A word count with map-side combine. Messages that are
    equal but for their numbers hold the same words: they are counted, then cut once."""
    alike = logs.groupBy(zero_digits(content).alias("like")).agg(F.count(F.lit(1)).alias("n"))
    return (alike.select(F.explode(_words_of(message_tokens("like"))).alias("word"), "n")
            .groupBy("word").agg(F.sum("n").alias("n_messages"))
            .where(F.col("n_messages") >= min_messages))


def _words_of(tokens_col) -> F.Column:
    """The distinct lower-cased alphabetic tokens."""
    return F.array_distinct(F.transform(F.filter(tokens_col, lambda t: t.rlike(ALPHA_WORD)), F.lower))


def token_dictionary(rows: DataFrame, tokens_col: str = "tokens", min_messages: int = 50) -> DataFrame:
    """:func:`corpus_dictionary` of messages that are cut into tokens already."""
    return (rows.select(F.explode(_words_of(tokens_col)).alias("word"))
            .groupBy("word").agg(F.count(F.lit(1)).alias("n_messages"))
            .where(F.col("n_messages") >= min_messages))


def with_is_common(df: DataFrame, token: str, words: DataFrame, out: str = "is_common") -> DataFrame:
    """strip punctuation; all-upper is never common; otherwise the lower
    form, or its stem before a trailing ``ed``, is in the dictionary."""
    w = words.select("word").distinct()
    stripped = remove_punctuation(token)
    low = F.lower(stripped)
    upper_only = (stripped == F.upper(stripped)) & (stripped != low)
    stem = F.when(low.endswith("ed"), F.left(low, F.length(low) - 2))
    base = df.select("*", low.alias("_low"), stem.alias("_stem"), upper_only.alias("_upper"))
    flagged = (base
               .join(w.select(F.col("word").alias("_low"), F.lit(True).alias("_h1")), "_low", "left")
               .join(w.select(F.col("word").alias("_stem"), F.lit(True).alias("_h2")), "_stem", "left"))
    common = ~F.col("_upper") & (F.coalesce("_h1", F.lit(False)) | F.coalesce("_h2", F.lit(False)))
    return flagged.withColumn(out, common).drop("_low", "_stem", "_upper", "_h1", "_h2")


def uncommon_tokens(df: DataFrame, keys: list[str], tokens_col: str, words: DataFrame,
                    out: str = "uncommon", distinct: bool = False, carry: list[str] | None = None) -> DataFrame:
    """The tokens of ``tokens_col`` not in the dictionary (case-sensitive),
    in order and with duplicates (``distinct`` keeps first occurrences).

    ``keys`` identify a row. Exploded tokens are flagged by a left join with the
    dictionary and folded back per key; the row itself travels with its first
    token, so the input is read once and nothing is joined back. Every input row
    survives (``posexplode_outer``). Later tokens that are common end before the fold.
    ``carry``: the columns besides the keys that the result has; all by default.
    """
    w = words.select(F.col("word").alias("_tok"), F.lit(True).alias("_common")).distinct()
    rest = [c for c in df.columns if c not in keys] if carry is None else carry
    exploded = df.select(*keys, F.struct(*rest).alias("_row"), F.posexplode_outer(tokens_col).alias("_pos", "_tok"))
    row = F.when(F.coalesce("_pos", F.lit(0)) == 0, F.col("_row"))
    flagged = exploded.select(*keys, "_pos", "_tok", row.alias("_row")).join(w, "_tok", "left")
    flagged = flagged.where(F.col("_row").isNotNull() | F.col("_common").isNull())
    keep = F.when(F.col("_tok").isNotNull() & F.col("_common").isNull(), F.struct("_pos", "_tok"))
    folded = flagged.groupBy(*keys).agg(F.collect_list(keep).alias("_u"), F.first("_row", ignorenulls=True).alias("_row"))
    arr = F.transform(F.array_sort("_u"), lambda s: s["_tok"])
    if distinct:
        arr = F.array_distinct(arr)
    return folded.select(*(F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in (df.columns if carry is None else [*keys, *carry])), arr.alias(out))


def literal_flag(tokens_col: str, uncommon_col: str) -> F.Column:
    """One token, or every token common."""
    return (F.size(tokens_col) == 1) | (F.size(uncommon_col) == 0)
