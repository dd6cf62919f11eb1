"""Labelling step.

Only distinct unmatched masked keys are ever labelled. A *labeller* is a
function ``DataFrame -> DataFrame``: it receives requests
``system, masked, seq, msg, truth, prompt`` and returns
``system, masked, response, tokens``. Three are provided:

* :func:`truth_labeller` — offline: the ground-truth template of the message
  with every ``<*>`` written as a ``{variable}`` slot, else the rule result;
* :func:`rule_labeller` — the rule labeller (F8);
* :func:`callable_labeller` — wraps a user function ``(prompt, msg) -> str``
  (e.g. a client for a language model) in ``mapInPandas``: Arrow batches per
  partition, so calls run in parallel on executors, never on the driver.

:func:`durable_labeller` keeps the answers of any of them in a table.

No network client is included.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import rule_label
from ..session import read_if_any, written

# Fixed instruction text of the prompt (L1).
INSTRUCTION = ("As a log parsing expert, refer to historical examples and output, replace variables with the "
               "corresponding label (no spaces in curly brackets) in the log if present. Just return only the "
               "parsed log in backtick and ensure it matches exactly")


def build_prompts(keys: DataFrame, hints: DataFrame, refs: DataFrame) -> DataFrame:
    """L1: ``instruction`` (the fixed text) and ``prompt``: ``Variable Examples:
    'v' -> {label}, ...`` (when any), the format reference and the back-ticked
    message; one row per key."""
    h = hints.select("system", "masked", F.array_join(F.transform(
        "hints", lambda x: F.concat(F.lit("'"), x["symbol"], F.lit("' -> {"), x["label"], F.lit("}"))), ", ")
        .alias("hint_text"))
    p = keys.join(h, ["system", "masked"], "left").join(refs, ["system", "masked"], "left")
    var_part = F.when(F.coalesce(F.length("hint_text"), F.lit(0)) > 0,
                      F.concat(F.lit("Variable Examples: "), F.col("hint_text"), F.lit("\n"))).otherwise(F.lit(""))
    prompt = F.concat(var_part, F.lit("Format Reference: "), F.col("reference"), F.lit("\n`"), F.col("msg"), F.lit("`"))
    return p.withColumn("instruction", F.lit(INSTRUCTION)).withColumn("prompt", prompt).drop("hint_text", "reference")


def _tokens_estimate(prompt, response):
    return (F.size(F.split(F.concat_ws(" ", F.lit(INSTRUCTION), prompt), r"\s+"))
            + F.size(F.split(response, r"\s+"))).cast("bigint")


def numbered_slots(template) -> F.Column:
    """``<*>`` slots of a template written as ``{var_1}``, ``{var_2}``, ..."""
    parts = F.split(template, r"<\*>", -1)
    return F.aggregate(
        F.sequence(F.lit(2), F.size(parts)), F.get(parts, 0),
        lambda acc, i: F.concat(acc, F.lit("{var_"), (i - 1).cast("string"), F.lit("}"), F.get(parts, i - 1)))


def truth_labeller(requests: DataFrame) -> DataFrame:
    """Offline labeller: the ground truth with its ``<*>`` slots as numbered
    ``{var_k}`` labels, else the rule result."""
    resp = F.when(F.col("truth").isNotNull(), numbered_slots(F.col("truth"))).otherwise(rule_label("msg"))
    return requests.select("system", "masked", resp.alias("response"),
                           _tokens_estimate(F.col("prompt"), resp).alias("tokens"))


def rule_labeller(requests: DataFrame) -> DataFrame:
    """Rule labeller: F8 of the message."""
    resp = rule_label("msg")
    return requests.select("system", "masked", resp.alias("response"),
                           _tokens_estimate(F.col("prompt"), resp).alias("tokens"))


RETRIES = 10


def callable_labeller(fn: Callable[[str, str], str], retries: int = RETRIES) -> Callable[[DataFrame], DataFrame]:
    """L2 around a user callable ``fn(prompt, msg) -> response``; the prompt begins
    with the instruction's line, and back-ticks are stripped from the response.

    A call that raises is made again, ``retries`` times at most; a request whose
    calls all fail gets no answer (its key stays out of the result)."""

    def ask(prompt: str, msg: str) -> str | None:
        for _ in range(retries):
            try:
                return str(fn(prompt, msg)).strip("`")
            except Exception as e:  # noqa: BLE001 — whatever the client raises is tried again
                logging.getLogger(__name__).warning("labelling call failed: %s", e)
        return None

    def run(batches):
        for pdf in batches:
            asked = [f"{i}\n{p}" for i, p in zip(pdf["instruction"], pdf["prompt"])]
            out = [ask(p, m) for p, m in zip(asked, pdf["msg"])]
            got = pd.DataFrame({
                "system": pdf["system"], "masked": pdf["masked"], "response": out,
                "tokens": [len(p.split()) + len((r or "").split()) for p, r in zip(asked, out)]})
            yield got[got["response"].notna()]

    def labeller(requests: DataFrame) -> DataFrame:
        return requests.select("system", "masked", "instruction", "prompt", "msg").mapInPandas(run, ANSWERS)

    return labeller


ANSWERS = "system string, masked string, response string, tokens bigint"


def durable_labeller(labeller: Callable[[DataFrame], DataFrame], path: str) -> Callable[[DataFrame], DataFrame]:
    """L2 with an answer table at ``path``, keyed by ``(system, masked)``.

    Requests that the table answers are not asked again; the others are asked
    in parts, and a part's answers are appended before the next part is asked
    and before any of them is used. After a crash, or when a result is
    recomputed because an executor was lost, only requests of the part that was
    being asked can be asked a second time. ``path`` must be a folder that
    driver and executors share.
    """

    def run(requests: DataFrame) -> DataFrame:
        spark = requests.sparkSession
        key = ["system", "masked"]
        todo = written(requests.join(read_if_any(spark, path, ANSWERS), key, "left_anti"), "requests")
        n = todo.count()
        parts = -(-n // PART)
        for i in range(parts):
            part = todo.where(F.pmod(F.xxhash64(*key), F.lit(parts)) == i) if parts > 1 else todo
            labeller(part).select("system", "masked", "response", F.col("tokens").cast("bigint").alias("tokens")) \
                .write.mode("append").parquet(path)
        answers = read_if_any(spark, path, ANSWERS).groupBy(*key).agg(F.min(F.struct("response", "tokens")).alias("a"))
        return answers.select(*key, "a.*").join(requests.select(*key), key, "left_semi")

    return run


#: Requests asked between two appends to the answer table.
PART = 10_000


def labelling_stats(labels: DataFrame, parse_time: float = 0.0, invoc_time: float = 0.0) -> DataFrame:
    """Per system the number of labelling calls and mean tokens (0 without calls).
    Times are wall-clock for the whole run (all systems run together)."""
    return labels.groupBy("system").agg(
        F.count(F.lit(1)).cast("bigint").alias("invoc_num"),
        F.coalesce(F.avg("tokens"), F.lit(0.0)).alias("invoc_token")).select(
        "system", F.lit(float(parse_time)).alias("parse_time"), F.lit(float(invoc_time)).alias("invoc_time"),
        "invoc_num", "invoc_token")
