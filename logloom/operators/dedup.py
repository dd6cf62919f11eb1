"""Deduplication and candidate grouping (A1-A4).

"Keep first" is ``min_by(struct, seq)`` per key: a declarative aggregate that
combines map-side, so a key holding a third of all rows costs one partial
row per partition, not one task holding the whole group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import format_signature, mask_message, message_tokens
from .tokens import uncommon_tokens


def dedup_first(df: DataFrame, key, partition: str = "system", order: str = "seq") -> DataFrame:
    """A1/A2/A3: one row per ``(partition, key)`` — the one with the smallest ``order``."""
    key_col = F.col(key) if isinstance(key, str) else key
    cols = [c for c in df.columns]
    first = (df.withColumn("_key", key_col)
             .groupBy(partition, "_key")
             .agg(F.min_by(F.struct(*cols), F.col(order)).alias("_r")))
    return first.select("_r.*")


def dedup_by_mask(logs: DataFrame) -> DataFrame:
    """A1: first message per masked key."""
    return dedup_first(logs, mask_message("Content"))


def dedup_by_format(logs: DataFrame) -> DataFrame:
    """A2: first message per format signature (letters and digits removed)."""
    return dedup_first(logs, format_signature("Content"))


def candidate_groups(logs: DataFrame, words: DataFrame) -> DataFrame:
    """A2 then A3: deduplicate by format, tokenise (F5), keep uncommon tokens
    and deduplicate by the uncommon-token list (order-sensitive list equality).

    Returns ``system, seq, Content, EventTemplate?, tokens, uncommon``.
    """
    by_format = dedup_by_format(logs)
    tok = by_format.withColumn("tokens", message_tokens("Content"))
    with_unc = uncommon_tokens(tok, ["system", "seq"], "tokens", words)
    return dedup_first(with_unc, F.col("uncommon"))


def distinct_uncommon(groups: DataFrame) -> DataFrame:
    """A4: distinct uncommon tokens per system."""
    return groups.select("system", F.explode("uncommon").alias("token")).distinct()
