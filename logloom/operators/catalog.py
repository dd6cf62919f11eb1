"""Template catalog from labelled messages.

A *labelled row* is ``(system, seq, msg, response)`` where ``response`` is the
message with variables replaced by ``{label}`` slots. The catalog is a
DataFrame with one row per template::

    system, template_id, template, final_template, example, labelled, tokens,
    label_positions, indexed

``template`` is canonical (F9), ``final_template`` the same after generalisation
(A11), ``tokens`` its match tokens (F10),
``label_positions`` maps each kept label to whitespace-token positions of the
example (E2), ``indexed`` says whether wildcard matching (J3) may use it
(seed examples are not indexed, and neither is the bare ``<*>``).

Ids are deterministic: a round's new templates take the numbers after their
system's highest, by the first message that produced them, so ids increase with
insertion order and do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import (canonical_template, mask_message, match_tokens,
                              once, remove_punctuation, repair_response, rule_label)
from ..functions.text import words as split_words
from ..session import written
from .cluster import cluster_leaders
from .tokens import with_is_common

MAX_SLOTS = 30


_PLACED_TYPE = "array<struct<label:string,value:string,start:int>>"
_CAPS_TYPE = "array<struct<label:string,value:string,start:int,first:int,last:int>>"


def _n_spaces(text: Column, upto: Column) -> Column:
    prefix = F.substring(text, F.lit(1), upto)
    return F.length(prefix) - F.length(F.replace(prefix, F.lit(" "), F.lit("")))


def extract_slots(df: DataFrame, msg: str = "msg", template: str = "response") -> DataFrame:
    r"""Adds ``caps array<struct<label, value, start, first, last>>`` — one entry
    per ``{label}`` slot in order, with the captured text, its character offset
    and the whitespace tokens that its span touches (none if first > last).
    Empty when there are more than 30 slots, no slots, or no match. Token spans
    assume single spaces, as in the reference; a span that ends where a token
    starts touches it.
    """
    out = placed_slots(df, msg, template)
    return out.withColumn("caps", F.coalesce(_spans(F.col("caps"), msg), F.array().cast(_CAPS_TYPE)))


def placed_slots(df: DataFrame, msg: str = "msg", template: str = "response") -> DataFrame:
    r"""E1 without the token spans: adds ``caps array<struct<label, value, start>>``.

    The first literal must begin the message and every slot takes as much as it
    can (greedy, line breaks too). So each literal stands at its last place that
    leaves room for those after it: one fold over the literals, from the last,
    finds them all.
    """
    slot = r"\{.*?\}"
    out = df.withColumn("_labels", F.regexp_extract_all(F.col(template), F.lit(r"\{(.*?)\}"), 1))
    out = out.withColumn("_lits", F.split(F.col(template), slot, -1))
    # (text before the literal, texts after the literals from here on, all found)
    lead = F.get("_lits", 0)
    init = F.struct(F.substring(msg, F.length(lead) + 1, F.length(msg)).alias("rem"),
                    F.array().cast("array<string>").alias("after"), F.startswith(F.col(msg), lead).alias("ok"))

    def place(a, lit):
        rest = F.when(lit == "", F.lit("")).otherwise(F.call_function("substring_index", a["rem"], lit, F.lit(-1)))
        return once(rest, lambda after: F.struct(
            F.substring(a["rem"], F.lit(1), F.length(a["rem"]) - F.length(after) - F.length(lit)).alias("rem"),
            F.concat(F.array(after), a["after"]).alias("after"), (a["ok"] & F.contains(a["rem"], lit)).alias("ok")))

    n = F.size("_labels")
    out = out.withColumn("_fold", F.when((n > 0) & (n <= MAX_SLOTS), F.aggregate(
        F.reverse(F.slice("_lits", F.lit(2), n)), init, place)))
    values = F.concat(F.array("_fold.rem"), F.slice("_fold.after", F.lit(1), n - 1))
    pieces = F.zip_with(values, F.slice("_lits", F.lit(2), n), lambda v, l: F.struct(v.alias("v"), F.length(l).alias("gap")))
    laid = F.aggregate(
        pieces, F.struct(F.array().cast("array<struct<value:string,start:int>>").alias("s"), F.length(lead).alias("p")),
        lambda a, x: F.struct(F.concat(a["s"], F.array(F.struct(x["v"].alias("value"), a["p"].alias("start")))).alias("s"),
                              (a["p"] + F.length(x["v"]) + x["gap"]).alias("p")))["s"]
    out = out.withColumn("_caps", F.when(F.col("_fold.ok"), F.zip_with("_labels", laid, lambda l, c: F.struct(
        l.alias("label"), c["value"].alias("value"), c["start"].alias("start")))))
    return (out.withColumn("caps", F.coalesce("_caps", F.array().cast(_PLACED_TYPE)))
            .drop("_labels", "_lits", "_fold", "_caps"))


def _spans(caps: Column, msg: str) -> Column:
    """Placed slots with the whitespace tokens that their spans touch."""
    text = F.array_repeat(F.array_join(split_words(msg), " "), F.size(caps))
    return F.zip_with(caps, text, lambda c, t: F.struct(
        c["label"].alias("label"), c["value"].alias("value"), c["start"].alias("start"),
        (_n_spaces(t, c["start"]) + F.when((c["start"] > F.length(t)) | (t == ""), 1).otherwise(0)).alias("first"),
        _n_spaces(t, c["start"] + F.length(c["value"])).alias("last")))


def _first_slots(caps: Column) -> Column:
    """The first slot of each label, in order."""
    return F.filter(caps, lambda c, i: F.array_position(F.transform(caps, lambda x: x["label"]), c["label"]) == i + 1)


def _positions(caps: Column, label: Column) -> Column:
    """Tokens touched by any slot whose value is one of the label's values."""
    same = F.filter(caps, lambda d: (d["first"] <= d["last"]) & F.exists(
        caps, lambda e: (e["label"] == label) & (e["value"] == d["value"])))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(same, lambda d: F.sequence(d["first"], d["last"])))))


def slot_positions(caps: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, label, positions)`` — the whitespace tokens whose span
    touches any capture with one of the label's values (equal values share
    positions). ``caps`` comes from :func:`extract_slots`, best stored."""
    per = F.transform(_first_slots(F.col("caps")), lambda c: F.struct(
        c["label"].alias("label"), _positions(F.col("caps"), c["label"]).alias("positions")))
    return caps.select(*keys, F.explode(per).alias("p")).select(*keys, "p.label", "p.positions").where(F.size("positions") > 0)


def correct_slots(df: DataFrame, words: DataFrame, msg: str = "msg", response: str = "response",
                  keys: list[str] | None = None) -> DataFrame:
    """E3 (P7): drop erroneous slots and fold their first value into the response.

    A label is wrong if it equals its first value (case-insensitively) or is
    ``label``; if label or value is only punctuation; if the value is a common
    word (F14); or if the value has nine or more words. With no captured slot
    the response becomes the message itself. Adds ``corrected``, ``label_vars``
    (array<struct<label, values>>, label order) and ``label_positions``
    (map<label, array<int>>). ``keys`` identify a row.

    The captures are stored once, without their token spans: those and the positions
    are worked out only for a caller that reads ``label_positions``. Of the rules only F14 needs a join: values meet
    the stored dictionary, and rows the stored list of those with a common value,
    so that Spark knows both sizes and moves no rows while they are small; the
    other rules are judged in the row.
    """
    keys = keys or ["system", "seq"]
    ex = written(placed_slots(df, msg, response), "captures")
    caps = F.col("caps")

    def wrong(label, value):
        # nine words take 17 characters at least
        long = (F.length(value) >= 17) & (F.size(split_words(value)) >= 9)
        return ((F.lower(label) == F.lower(value)) | (F.lower(label) == "label") | (remove_punctuation(label) == "")
                | (remove_punctuation(value) == "") | long)

    values = lambda label: F.transform(F.filter(caps, lambda c: c["label"] == label), lambda c: c["value"])
    slots = F.transform(_first_slots(caps), lambda s: F.struct(
        s["label"].alias("label"), s["value"].alias("value"), values(s["label"]).alias("values"),
        wrong(s["label"], s["value"]).alias("wrong")))
    firsts = ex.select(*keys, F.explode(_first_slots(caps)).alias("s")).select(*keys, "s.label", "s.value")
    words = written(words.select("word"), "words")
    common = with_is_common(firsts, "value", words).where("is_common")
    common = written(common.groupBy(*keys).agg(F.collect_set("label").alias("_common")), "common")
    ex = ex.withColumn("_slots", slots).join(common, keys, "left")
    ex = ex.withColumn("_common", F.coalesce("_common", F.array().cast("array<string>")))
    bad = F.filter("_slots", lambda s: s["wrong"] | F.array_contains("_common", s["label"]))
    good = F.filter("_slots", lambda s: ~s["wrong"] & ~F.array_contains("_common", s["label"]))
    fixed = F.aggregate(bad, F.col(response),
                        lambda acc, x: F.replace(acc, F.concat(F.lit("{"), x["label"], F.lit("}")), x["value"]))
    positions = once(_spans(caps, msg), lambda spans: F.map_from_entries(F.transform(
        good, lambda s: F.struct(s["label"], _positions(spans, s["label"])))))
    return ex.select(
        "*", F.when(F.size("caps") == 0, F.col(msg)).otherwise(fixed).alias("corrected"),
        F.transform(good, lambda s: F.struct(s["label"].alias("label"), s["values"].alias("values"))).alias("label_vars"),
        positions.alias("label_positions"),
    ).drop("_common", "_slots", "caps")


def template_from_response(df: DataFrame, words: DataFrame, msg: str = "msg", response: str = "response",
                           keys: list[str] | None = None) -> DataFrame:
    """U1's per-row part: F11 -> E3 -> F8 -> F9. Adds ``labelled``, ``template``,
    ``label_vars``, ``label_positions``; what the caller does not read is not worked out."""
    repaired = df.withColumn("_resp", repair_response(msg, response))
    fixed = correct_slots(repaired, words, msg, "_resp", keys)
    return (fixed.withColumn("labelled", F.col("corrected"))
            .withColumn("template", canonical_template(rule_label("corrected")))
            .drop("_resp", "corrected"))


_BUCKET = 1 << 16


def _numbered(new: DataFrame) -> DataFrame:
    """Give a round's new templates the ids after their system's highest, by first
    message: unique within a system however large ``seq`` gets, in order of insertion.
    Templates are ranked within buckets of ``seq``; a running sum over the
    buckets' counts places them, so no task ranks a whole system."""
    new = new.withColumn("_b", F.coalesce(F.floor(F.col("_seq") / _BUCKET), F.lit(-1)))
    ahead = Window.partitionBy("system").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = new.groupBy("system", "_b").agg(F.count(F.lit(1)).alias("_c")).select(
        "system", "_b", F.coalesce(F.sum("_c").over(ahead), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("system", "_b").orderBy("_seq", "template"))
    return (new.join(before, ["system", "_b"])
            .withColumn("template_id", F.coalesce("_top", F.lit(-1).cast("bigint")) + F.col("_before") + rank)
            .drop("_top", "_seq", "_b", "_before"))


def upsert_catalog(catalog: DataFrame | None, labelled: DataFrame, words: DataFrame, round_no: int,
                   indexed: bool = True, units: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Add the templates of ``labelled`` rows ``(system, seq, msg, response)``.

    ``units``: slot values kept so far; a message whose template exists already
    merges its values into known labels only. Returns ``(catalog, assignments, units)``: the new catalog; per labelled row
    its ``template_id`` and masked key; and the slot values per
    ``(system, label)`` contributed by this batch (for A9/A10).
    """
    rows = written(template_from_response(labelled, words), "templates")
    first = (rows.groupBy("system", "template")
             .agg(F.min_by(F.struct("seq", "msg", "labelled", "label_positions"), F.col("seq")).alias("f")))
    new = first.select(
        "system", "template", F.col("template").alias("final_template"), F.col("f.seq").alias("_seq"),
        F.col("f.msg").alias("example"), F.col("f.labelled").alias("labelled"),
        match_tokens("template").alias("tokens"),
        F.col("f.label_positions").alias("label_positions"),
        (F.lit(indexed) & (F.col("template") != "<*>")).alias("indexed"))
    known = catalog
    if catalog is not None:
        existing = catalog.select("system", "template", F.col("template_id").alias("old_id"),
                                  F.col("indexed").alias("old_indexed"))
        new = new.join(existing, ["system", "template"], "left")
        # existing template: keep its id; it becomes indexed once a non-seed insert reaches it
        upd = (new.where(F.col("old_id").isNotNull())
               .select("system", "template", "old_id", (F.col("old_indexed") | F.col("indexed")).alias("ix")))
        catalog = (catalog.join(upd.select("system", F.col("old_id").alias("template_id"), "ix"),
                                ["system", "template_id"], "left")
                   .withColumn("indexed", F.coalesce("ix", "indexed")).drop("ix"))
        added = new.where(F.col("old_id").isNull()).drop("old_id", "old_indexed")
        top = catalog.groupBy("system").agg(F.max("template_id").alias("_top"))
        catalog = catalog.unionByName(_numbered(added.join(top, "system", "left")))
    else:
        catalog = _numbered(new.withColumn("_top", F.lit(None).cast("bigint")))
    catalog = written(catalog, "catalog")
    ids = catalog.select("system", "template", "template_id")
    assignments = rows.join(ids, ["system", "template"]).select(
        "system", "seq", "template_id", mask_message("msg").alias("masked"))
    return catalog, assignments, _known_labels(slot_units(rows, round_no, "template"), rows, known, units)


def _known_labels(new: DataFrame, rows: DataFrame, known: DataFrame | None, units: DataFrame | None) -> DataFrame:
    """The slot values that U1 keeps: a message whose template was there before it
    (``known``, or made by an earlier message of the batch) adds values only to
    labels that were in use by then."""
    by = rows.groupBy("system", "template").agg(F.min("seq").alias("_made"))
    if known is not None:
        old = known.select("system", "template", F.lit(True).alias("_old"))
        by = by.join(old, ["system", "template"], "left")
    else:
        by = by.withColumn("_old", F.lit(None).cast("boolean"))
    new = new.join(by, ["system", "template"])
    creates = (F.col("seq") == F.col("_made")) & F.col("_old").isNull()
    first = new.where(creates).groupBy("system", "label").agg(F.min("seq").alias("_use"))
    if units is not None:
        used = units.select("system", "label").distinct().withColumn("_use", F.lit(None).cast("bigint"))
        first = used.withColumn("_before", F.lit(True)).unionByName(first.withColumn("_before", F.lit(False)))
        first = first.groupBy("system", "label").agg(F.min("_use").alias("_use"), F.max("_before").alias("_before"))
    else:
        first = first.withColumn("_before", F.lit(False))
    return (new.join(first, ["system", "label"]).where(creates | F.col("_before") | (F.col("_use") < F.col("seq")))
            .select("system", "round", "seq", "li", "label", "pos", "value"))


def slot_units(rows: DataFrame, round_no: int, *keep: str) -> DataFrame:
    """Slot values ``system, round, seq, li, label, pos, value`` of corrected rows:
    ``li`` is the label's place in its message, ``pos`` the value's place in its label."""
    return rows.select("system", *keep, F.lit(round_no).alias("round"), "seq",
                       F.posexplode("label_vars").alias("li", "lv")).select(
        "system", *keep, "round", "seq", "li", F.col("lv.label").alias("label"),
        F.posexplode("lv.values").alias("pos", "value"))


def unit_values(units: DataFrame) -> DataFrame:
    """The distinct lower-cased values of every label, a row each (``system, label,
    value``): one label may have as many as there are messages."""
    return units.select("system", "label", F.lower("value").alias("value")).where(F.col("value").isNotNull()).distinct()


def variable_symbols(units: DataFrame) -> DataFrame:
    """A10: per (system, label) the place of its first use and the
    representative symbols (first-fit leaders by
    character-set Jaccard >= 0.8, in order of first appearance; of a label's
    first message only its first value is a symbol candidate). Order is by
    round, message and place, then by value, so no two values share one."""
    first = units.groupBy("system", "label").agg(F.min(F.struct("round", "seq", "li")).alias("first_use"))
    first = written(first, "first_use")
    start = first.select("system", "label", F.col("first_use.round").alias("_r"), F.col("first_use.seq").alias("_s"))
    later = (F.col("round") != F.col("_r")) | (F.col("seq") != F.col("_s"))
    cand = (units.join(start, ["system", "label"]).where(later | (F.col("pos") == 0))
            .groupBy("system", "label", "value")
            .agg(F.min(F.struct("round", "seq", "pos")).alias("_at"))
            .select("system", "label", "value", F.struct("_at.round", "_at.seq", "_at.pos", "value").alias("_o")))
    leaders = cluster_leaders(cand, "value", order="_o", partition=["system", "label"])
    symbols = leaders.groupBy("system", "label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("o", "leader"))), lambda s: s["leader"]).alias("symbols"))
    return first.join(symbols, ["system", "label"], "left")


def variable_units(units: DataFrame) -> DataFrame:
    """A9 + A10: :func:`variable_symbols` with ``n_values``, the number of a label's :func:`unit_values`."""
    counts = unit_values(units).groupBy(F.col("system").alias("_s"), F.col("label").alias("_l")).agg(
        F.count(F.lit(1)).alias("n_values"))
    same = F.col("system").eqNullSafe(F.col("_s")) & F.col("label").eqNullSafe(F.col("_l"))
    return (variable_symbols(units).join(counts, same, "left").drop("_s", "_l")
            .withColumn("n_values", F.coalesce("n_values", F.lit(0).cast("bigint"))))


def positional_diff(hits: DataFrame, catalog: DataFrame) -> DataFrame:
    """Where messages differ from the template that they matched (A11):
    ``system, template_id, seq, pos, token, own, label``.

    ``hits``: ``(system, template_id, seq, msg)`` of messages resolved by wildcard
    or similarity matching. Only messages with as many whitespace tokens as the
    template's ``final_template`` count. ``own`` is the template's token there
    and ``label`` the first label whose positions hold ``pos``, if any.
    """
    cat = catalog.select("system", "template_id", split_words("final_template").alias("tw"),
                         F.map_entries("label_positions").alias("lp"))
    h = hits.join(cat, ["system", "template_id"]).select(
        "system", "template_id", "seq", "lp", "tw", split_words("msg").alias("mw")).where(F.size("mw") == F.size("tw"))
    at = h.select("system", "template_id", "seq", "lp", F.posexplode(F.arrays_zip("mw", "tw")).alias("pos", "z"))
    label = F.get(F.filter("lp", lambda e: F.array_contains(e["value"], F.col("pos"))), F.lit(0))["key"]
    return at.where(F.col("z.mw") != F.col("z.tw")).select(
        "system", "template_id", "seq", "pos", F.col("z.mw").alias("token"), F.col("z.tw").alias("own"), label.alias("label"))


def merged_values(diff: DataFrame, round_no: int) -> DataFrame:
    """The tokens at labelled positions as slot values (see :func:`slot_units`) of their label."""
    return (diff.where(F.col("label").isNotNull()).groupBy("system", "label", F.col("token").alias("value"))
            .agg(F.min(F.struct("seq", "pos")).alias("f"))
            .select("system", F.lit(round_no).alias("round"), F.col("f.seq").alias("seq"), F.col("f.pos").alias("li"),
                    "label", F.lit(1).alias("pos"), "value"))


def unknown_labels(diff: DataFrame, catalog: DataFrame) -> DataFrame:
    """A label ``unknown_k`` for each differing position without one:
    ``system, template_id, pos, label, seq, own, token`` with the message that
    differed first. Numbers follow a system's highest, by that message and place."""
    first = (diff.where(F.col("label").isNull()).groupBy("system", "template_id", "pos", "own")
             .agg(F.min(F.struct("seq", "token")).alias("f")))
    used = (catalog.select("system", F.explode(F.map_keys("label_positions")).alias("l"))
            .select("system", F.regexp_extract("l", "^unknown_([0-9]{1,18})$", 1).alias("k")).where("k <> ''")
            .groupBy("system").agg(F.max(F.col("k").cast("bigint")).alias("top")))
    # as many rows as template positions that were generalised
    rank = F.row_number().over(Window.partitionBy("system").orderBy("f.seq", "pos", "template_id"))
    k = F.coalesce("top", F.lit(-1).cast("bigint")) + rank
    return first.join(used, "system", "left").select(
        "system", "template_id", F.col("pos").cast("int").alias("pos"), F.concat(F.lit("unknown_"), k.cast("string")).alias("label"),
        F.col("f.seq").alias("seq"), "own", F.col("f.token").alias("token"))


def unknown_values(diff: DataFrame, unknown: DataFrame, round_no: int) -> DataFrame:
    """The slot values of new unknown labels: the template's own token, the one that
    differed first, and those of later messages."""
    own = unknown.select("system", F.lit(round_no).alias("round"), "seq", F.lit(0).alias("li"), "label",
                         F.lit(0).alias("pos"), F.col("own").alias("value"))
    named = diff.where(F.col("label").isNull()).drop("label").join(
        unknown.select("system", "template_id", "pos", "label"), ["system", "template_id", "pos"])
    return own.unionByName(merged_values(named, round_no))


def generalise_templates(hits: DataFrame, catalog: DataFrame, unknown: DataFrame | None = None) -> DataFrame:
    """Positions where a matched message differs from the template and that no
    label covers become ``<*>`` in ``final_template`` and get a label ``unknown_k``
    in ``label_positions``. ``hits``: see :func:`positional_diff`; ``unknown``:
    their :func:`unknown_labels`, if known already."""
    if unknown is None:
        unknown = unknown_labels(positional_diff(hits, catalog), catalog)
    gen = unknown.groupBy("system", "template_id").agg(F.sort_array(F.collect_list(F.struct("pos", "label"))).alias("gen"))
    out = catalog.join(gen, ["system", "template_id"], "left")
    text = F.array_join(F.transform(split_words("final_template"), lambda t, i: F.when(
        F.exists("gen", lambda g: g["pos"] == i), F.lit("<*>")).otherwise(t)), " ")
    more = F.map_from_entries(F.transform("gen", lambda g: F.struct(g["label"], F.array(g["pos"]))))
    return (out.withColumn("final_template", F.when(F.col("gen").isNull(), F.col("final_template")).otherwise(text))
            .withColumn("label_positions", F.when(F.col("gen").isNull(), F.col("label_positions"))
                        .otherwise(F.map_concat("label_positions", more))).drop("gen"))
