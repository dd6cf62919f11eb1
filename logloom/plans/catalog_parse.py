"""Catalog parse (L3): the reference's online parse as a batch fixpoint.

1. Seed the catalog with the first ``shot`` labelled examples per system
   (not indexed for wildcard matching).
2. Reduce the logs to distinct masked keys, each with its earliest message.
3. Exact key (J1) and literal rule (P3/J2) decide their keys. Rounds then
   match the open keys: wildcard tree walk (J3) -> similar template (J4). Of
   the keys still open one representative per (system, first token, number of
   tokens) is labelled and inserted (U1), and the rest retry against the grown
   catalog. Stops when no key is left.
4. Messages matched by J3/J4 add their values to the labels they meet, and
   their templates are generalised (A11); every log row gets its template's
   final text (J8).

Deviation from the reference (order-dependent by nature): within a round all
keys see the catalog as of the round start, and a template created later
never re-labels an earlier message. Ids follow ``(round, seq)``, so results
do not depend on partitioning.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import correct_message, mask_message, tokens, zero_digits
from ..operators.catalog import (generalise_templates, merged_values, positional_diff, unknown_labels,
                                 unknown_values, upsert_catalog, variable_symbols)
from ..operators.labelling import build_prompts, labelling_stats, truth_labeller
from ..operators.matching import (literal_keys, match_exact, match_literal, match_similar,
                                  match_wildcard, reference_example, relevant_variables)
from ..operators.sampling import head_per_system
from ..operators.tokens import uncommon_tokens
from ..session import cap_plan_strings, written


def masked_keys(logs: DataFrame, raw: bool = False) -> DataFrame:
    """Distinct masked keys with their earliest message and its tokens. Of messages
    that are equal but for their numbers the earliest is taken first; they have one
    masked key, so the masks run once for all of them. ``raw`` messages are not yet
    normalised (F1): that looks at no digit, so it runs once for all of them, too."""
    def fixed(c):
        return correct_message(c) if raw else F.col(c)

    alike = logs.groupBy("system", zero_digits("Content").alias("like")).agg(
        F.min_by(F.struct("seq", "Content", "EventTemplate"), F.col("seq")).alias("f"))
    keyed = alike.select("system", mask_message(fixed("like")).alias("masked"), "f")
    first = keyed.groupBy("system", "masked").agg(F.min_by("f", F.col("f.seq")).alias("f"))
    first = first.select("system", "masked", F.col("f.seq").alias("seq"), fixed("f.Content").alias("msg"),
                         fixed("f.EventTemplate").alias("truth"))
    return first.withColumn("tokens", tokens("msg"))


def distinct_keys(logs: DataFrame, words: DataFrame, raw: bool = False, carry: tuple[str, ...] | None = None) -> DataFrame:
    """:func:`masked_keys` with their uncommon tokens. ``words`` is best stored.
    ``carry``: the columns that go along with ``system, masked, uncommon``; all by default."""
    # a masked key can be a whole text: its tokens go by a number
    keys = masked_keys(logs, raw).withColumn("_key", F.monotonically_increasing_id())
    if carry is None:
        return uncommon_tokens(written(keys, "first"), ["_key"], "tokens", words).drop("_key")
    own = [c for c in carry if c != "tokens"]
    keys = written(keys.select("system", "masked", *own, "tokens", "_key"), "first")
    return uncommon_tokens(keys, ["_key"], "tokens", words, carry=["system", "masked", *carry]).drop("_key")


class CatalogState(NamedTuple):
    """What the parse carries between rounds and between stream batches."""

    catalog: DataFrame
    matching: DataFrame
    units: DataFrame
    next_round: int = 1


class Resolved(NamedTuple):
    """Result of :func:`resolve_keys`; all frames are stored tables."""

    keys: DataFrame  # system, masked, template_id
    catalog: DataFrame
    matching: DataFrame  # new entries of the matching table: system, masked, template_id
    units: DataFrame  # new slot values
    hits: DataFrame  # messages matched by tree or similarity: system, template_id, seq, msg
    labels: DataFrame  # system, masked, tokens of the labelling calls
    next_round: int
    invoc_time: float


def seed_state(examples: DataFrame, words: DataFrame, shot: int = 32) -> CatalogState:
    """U1 over the first ``shot`` labelled examples per system (not indexed)."""
    seeds = head_per_system(examples, shot).select(
        "system", "seq", F.col("Content").alias("msg"), F.col("EventTemplate").alias("response"))
    catalog, asg, units = upsert_catalog(None, seeds, words, 0, indexed=False)
    last = asg.groupBy("system", "masked").agg(F.max_by("template_id", "seq").alias("template_id"))
    return CatalogState(catalog, written(last, "matching"), written(units, "units"), 1)


def representatives(keys: DataFrame) -> DataFrame:
    """The earliest key of each (system, first token, number of tokens). Keys of
    different groups seldom share a template, so a round labels them side by side."""
    group = ["system", F.get("tokens", 0).alias("_first"), F.size("tokens").alias("_n")]
    first = keys.groupBy(*group).agg(F.min(F.struct("seq", "masked")).alias("f")).select("system", "f.masked")
    return keys.join(first, ["system", "masked"], "left_semi")


def _empty(df: DataFrame) -> bool:
    return not df.limit(1).count()


def resolve_keys(keys: DataFrame, state: CatalogState, words: DataFrame,
                 labeller: Callable[[DataFrame], DataFrame] = truth_labeller,
                 max_rounds: int | None = None) -> Resolved:
    """The round loop of L3 over distinct, stored ``keys``; ``state`` stays as it is.

    The exact key (J1) and the literal rule (P3, J2) decide once: a key they
    leave open is not decided by them in a later round of the same call. A round
    then matches the open keys (J3, J4), labels representatives of the rest and
    adds their templates. Answers are stored before they are used.
    """
    spark = keys.sparkSession
    res = ["system", "masked", "template_id"]
    catalog, rnd, invoc_time = state.catalog, state.next_round, 0.0
    units, found, table, hits, labels = [state.units], [], [], [], []

    def insert(rows: DataFrame) -> None:
        nonlocal catalog
        so_far = units[0]
        for u in units[1:]:
            so_far = so_far.unionByName(u)
        catalog, asg, new = upsert_catalog(catalog, rows.select("system", "seq", "msg", "response"), words, rnd, units=so_far)
        units.append(written(new, "units"))
        got = written(rows.select("system", "masked", "seq").join(
            asg.select("system", "seq", "template_id"), ["system", "seq"]).select(res), "inserted")
        found.append(got)
        table.append(got)

    exact = written(match_exact(keys, state.matching).select(res), "exact")
    found.append(exact)
    todo = written(keys.join(exact, ["system", "masked"], "left_anti"), "open")
    literal = literal_keys(todo)
    old = match_literal(literal, catalog).select(res)
    literal = written(literal.join(old, ["system", "masked"], "left"), "literal")
    if not _empty(literal):
        found.append(literal.where("template_id IS NOT NULL").select(res))
        new = literal.where("template_id IS NULL").withColumn("response", F.col("msg"))
        if not _empty(new):
            insert(new)
        todo = written(todo.join(literal, ["system", "masked"], "left_anti"), "open")
    first_round = rnd
    while not _empty(todo):
        if max_rounds is not None and rnd - first_round >= max_rounds:
            raise RuntimeError(f"catalog parse did not converge in {max_rounds} rounds")
        walk = written(match_wildcard(todo, catalog, "msg", "tokens"), "walk")
        failed = walk.where(~F.col("ok")).select("system", "masked", "msg", "tokens", "fail_node")
        got = written(walk.where("ok").select(res).unionByName(match_similar(failed, catalog).select(res)), "matched")
        met = written(got.join(todo.select("system", "masked", "seq", "msg"), ["system", "masked"])
                      .select("system", "template_id", "seq", "msg"), "hits")
        found.append(got)
        table.append(got)
        hits.append(met)
        units.append(written(merged_values(positional_diff(met, catalog), rnd), "merged"))
        rest = written(todo.join(got, ["system", "masked"], "left_anti"), "rest")
        if _empty(rest):
            break
        reps = written(representatives(rest), "representatives")
        t0 = time.time()
        known = units[0]
        for u in units[1:]:
            known = known.unionByName(u)
        prompts = build_prompts(reps, relevant_variables(reps, written(variable_symbols(known), "symbols")), reference_example(reps, catalog))
        answers = written(labeller(prompts), "answers")
        invoc_time += time.time() - t0
        if _empty(answers):
            raise RuntimeError("the labeller answered none of the requests")
        labels.append(answers.select("system", "masked", "tokens"))
        insert(reps.join(answers, ["system", "masked"]))
        # a request without an answer stays open and is asked again in the next round
        todo = written(rest.join(answers, ["system", "masked"], "left_anti"), "open")
        rnd += 1

    def all_of(frames: list[DataFrame], schema: str) -> DataFrame:
        out = spark.createDataFrame([], schema)
        for f in frames:
            out = out.unionByName(f)
        return written(out, "resolved")

    pairs = "system string, masked string, template_id bigint"
    unit = "system string, round int, seq bigint, li int, label string, pos int, value string"
    return Resolved(all_of(found, pairs), catalog, all_of(table, pairs), all_of(units[1:], unit),
                    all_of(hits, "system string, template_id bigint, seq bigint, msg string"),
                    all_of(labels, "system string, masked string, tokens bigint"), rnd + 1, invoc_time)


def generalised(r: Resolved) -> tuple[DataFrame, DataFrame]:
    """A11 over all hits of a call: the catalog with its final templates and unknown
    labels, and the unknown labels' slot values."""
    diff = written(positional_diff(r.hits, r.catalog), "diff")
    unknown = written(unknown_labels(diff, r.catalog), "unknown")
    catalog = written(generalise_templates(r.hits, r.catalog, unknown), "catalog")
    return catalog, written(unknown_values(diff, unknown, r.next_round - 1), "units")


def parse_logs(logs: DataFrame, examples: DataFrame, words: DataFrame,
               labeller: Callable[[DataFrame], DataFrame] = truth_labeller, shot: int = 32,
               max_rounds: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """L3. Returns ``(parsed, catalog, stats)``.

    ``parsed``: ``system, seq, truth, parsed`` for every log row;
    ``catalog``: final template catalog (with ``final_template`` after A11);
    ``stats``: A13 per system.
    ``logs``: ``system, seq, Content, EventTemplate`` (normalised here with F1);
    ``examples``: labelled ``system, seq, Content, EventTemplate`` with ``{label}`` slots.
    """
    normal = logs.select("system", "seq", correct_message("Content").alias("Content"),
                         correct_message("EventTemplate").alias("EventTemplate"))
    found, catalog, stats = _parse(logs, examples, words, labeller, shot, max_rounds)
    row_keys = normal.select("system", "seq", F.col("EventTemplate").alias("truth"), mask_message("Content").alias("masked"))
    parsed = _with_template(row_keys, found, catalog).select("system", "seq", "truth", "parsed")
    return parsed, catalog, stats


def parse_pairs(logs: DataFrame, examples: DataFrame, words: DataFrame,
                labeller: Callable[[DataFrame], DataFrame] = truth_labeller, shot: int = 32,
                max_rounds: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """:func:`parse_logs` with the rows counted per ``system, truth, parsed``: ``n``.

    Rows are counted by their truth as it stands and by their message without its
    numbers; each such pair is then normalised, masked and given its template once.
    """
    found, catalog, stats = _parse(logs, examples, words, labeller, shot, max_rounds)
    counted = logs.groupBy("system", "EventTemplate", zero_digits("Content").alias("like")).agg(F.count(F.lit(1)).alias("n"))
    keyed = counted.select("system", correct_message("EventTemplate").alias("truth"),
                           mask_message(correct_message("like")).alias("masked"), "n")
    pairs = _with_template(keyed, found, catalog).groupBy("system", "truth", "parsed").agg(F.sum("n").alias("n"))
    return pairs, catalog, stats


def _with_template(keyed: DataFrame, found: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows by masked key with the final text of their template."""
    return (keyed.join(found, ["system", "masked"], "left")
            .join(catalog.select("system", "template_id", F.col("final_template").alias("parsed")),
                  ["system", "template_id"], "left"))


def _parse(logs: DataFrame, examples: DataFrame, words: DataFrame, labeller: Callable[[DataFrame], DataFrame],
           shot: int, max_rounds: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The templates of the distinct keys, the final catalog and A13."""
    t_start = time.time()
    cap_plan_strings(logs.sparkSession)
    words = written(words.select("word"), "words")
    state = seed_state(examples, words, shot)
    keys = written(distinct_keys(logs, words, raw=True), "keys")
    done = resolve_keys(keys, state, words, labeller, max_rounds)
    catalog, _ = generalised(done)
    stats = labelling_stats(done.labels, time.time() - t_start, done.invoc_time)
    all_systems = keys.select("system").distinct()
    stats = all_systems.join(stats, "system", "left").fillna(
        {"parse_time": time.time() - t_start, "invoc_time": 0.0, "invoc_num": 0, "invoc_token": 0.0})
    return done.keys, catalog, stats
