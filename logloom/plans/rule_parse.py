"""Rule parse: label every message with the rule labeller (F8) and score it.

This is the minimum end-to-end answer — "how well do rules alone group my
logs?" — and the engine's flagship query. It is a single narrow projection
followed by the template-pair aggregate of :mod:`logloom.operators.metrics`,
so its cost is one scan plus one map-side-combined shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_template, correct_message, rule_label
from ..operators.metrics import evaluate, template_pairs


def normalise_logs(logs: DataFrame) -> DataFrame:
    """S1's normalisation: F1 on both ``Content`` and ``EventTemplate``."""
    return logs.select("system", "seq",
                       correct_message("Content").alias("Content"),
                       correct_message("EventTemplate").alias("EventTemplate"))


def rule_parse(logs: DataFrame) -> DataFrame:
    """``system, seq, truth, parsed`` with parsed = F9(F8(Content)), truth = F9(EventTemplate)."""
    norm = normalise_logs(logs)
    return norm.select("system", "seq",
                       canonical_template("EventTemplate").alias("truth"),
                       canonical_template(rule_label("Content")).alias("parsed"))


def rule_pairs(logs: DataFrame) -> DataFrame:
    """Rows per distinct ``system, truth, parsed`` of :func:`rule_parse`.

    F9 and the truth's F1 depend on one text only. So rows are counted by their
    truth as it stands and their F8 first, and each distinct pair is rewritten once.
    """
    counted = template_pairs(logs.select("system", "EventTemplate", rule_label(correct_message("Content")).alias("labelled")),
                             "EventTemplate", "labelled")
    norm = counted.select("system", canonical_template(correct_message("truth")).alias("truth"),
                          canonical_template("parsed").alias("parsed"), "n")
    return template_pairs(norm)


def rule_parse_metrics(logs: DataFrame) -> DataFrame:
    """Per-system rows, template counts, GA, PGA, RGA, FGA, PA, PTA, RTA, FTA."""
    return evaluate(rule_pairs(logs), canonical=False)
