"""Evaluation metrics (Q0-Q10) as aggregations keyed by ``system``.

All metrics derive from one aggregate: row counts per distinct
``(system, truth, parsed)`` pair. That aggregate combines map-side, so the
only data that crosses the network is one row per distinct template pair per
partition; everything after it works on template-sized tables.

Input frames carry ``system``, a truth column and a parsed column (default
names ``truth`` and ``parsed``). A *stratum* is a frame ``(system, template)``
listing the truth templates that count (the reference's ``filter_templates``).
A frame that is that aggregate already (see :func:`template_pairs`) carries the
rows of each pair in a column ``n``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import template_similarity
from ..functions.text import canonical_template, fold_wildcards
from ..session import written

ROUND = 6


def _r(c):
    return F.round(c.cast("double"), ROUND)


def _f1(p, r):
    return F.when((p != 0) | (r != 0), 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def canonicalise(df: DataFrame, truth: str = "truth", parsed: str = "parsed") -> DataFrame:
    """Q0: canonical form (F9) of both template columns."""
    return df.withColumn(truth, canonical_template(truth)).withColumn(parsed, canonical_template(parsed))


def align(truth: DataFrame, parsed: DataFrame) -> DataFrame:
    """A truth table ``system, seq, truth`` with a parsed table ``system, seq,
    parsed``. A truth row that was not parsed has a null parsed template; parsed
    rows without a truth row are dropped."""
    return truth.select("system", "seq", "truth").join(
        parsed.select("system", "seq", "parsed"), ["system", "seq"], "left")


def template_pairs(df: DataFrame, truth: str = "truth", parsed: str = "parsed") -> DataFrame:
    """Rows per distinct (system, truth, parsed); the single heavy aggregate. Of a
    frame with a column ``n`` each row counts as many."""
    n = F.sum("n") if "n" in df.columns else F.count(F.lit(1))
    return df.groupBy("system", F.col(truth).alias("truth"), F.col(parsed).alias("parsed")).agg(n.alias("n"))


def _stored_pairs(df: DataFrame, truth: str, parsed: str) -> DataFrame:
    """The pairs of rows with a truth, stored: several aggregates read them, and
    the rows below must not be parsed again for each."""
    return written(template_pairs(df, truth, parsed).where(F.col("truth").isNotNull()), "pairs")


def _stratum_keys(stratum: DataFrame) -> DataFrame:
    return stratum.select("system", F.col("template").alias("truth")).distinct()


def grouping_accuracy(df: DataFrame, truth: str = "truth", parsed: str = "parsed",
                      stratum: DataFrame | None = None) -> DataFrame:
    """Q1-Q3: GA, PGA, RGA, FGA per system.

    A truth group is right when all its rows carry one parsed template and that
    template has exactly as many rows overall. Null truths are dropped first;
    a null parsed template is never right and never counted.
    With a stratum only listed truths can be right and the denominators become
    the listed rows, the parsed templates touched by listed truths, and the
    stratum size.
    """
    pairs = _stored_pairs(df, truth, parsed)
    by_truth = pairs.groupBy("system", "truth").agg(
        F.count("parsed").alias("k"), F.sum("n").alias("rows"), F.max("parsed").alias("parsed"))
    by_parsed = pairs.where(F.col("parsed").isNotNull()).groupBy("system", "parsed").agg(F.sum("n").alias("parsed_rows"))
    right = (by_truth.where(F.col("k") == 1)
             .join(by_parsed, ["system", "parsed"])
             .where(F.col("rows") == F.col("parsed_rows"))
             .select("system", "truth", "rows"))
    if stratum is None:
        hits = right.groupBy("system").agg(F.sum("rows").alias("good_rows"),
                                           F.count(F.lit(1)).alias("good_groups"))
        truth_tot = by_truth.groupBy("system").agg(F.sum("rows").alias("rows"),
                                                   F.count(F.lit(1)).alias("ground_templates"))
        parsed_tot = by_parsed.groupBy("system").agg(F.count(F.lit(1)).alias("identified_templates"))
        out = truth_tot.join(parsed_tot, "system").join(hits, "system", "left")
        n_truth = F.col("ground_templates")
    else:
        keys = _stratum_keys(stratum)
        hits = (right.join(keys, ["system", "truth"], "left_semi").groupBy("system")
                .agg(F.sum("rows").alias("good_rows"), F.count(F.lit(1)).alias("good_groups")))
        listed_pairs = pairs.join(keys, ["system", "truth"], "left_semi")
        truth_tot = listed_pairs.groupBy("system").agg(F.sum("n").alias("rows"))
        parsed_tot = (listed_pairs.where(F.col("parsed").isNotNull()).groupBy("system")
                      .agg(F.countDistinct("parsed").alias("identified_templates")))
        size = keys.groupBy("system").agg(F.count(F.lit(1)).alias("ground_templates"))
        out = (size.join(truth_tot, "system", "left").join(parsed_tot, "system", "left")
               .join(hits, "system", "left"))
        n_truth = F.col("ground_templates")
    good_rows = F.coalesce(F.col("good_rows"), F.lit(0))
    good_groups = F.coalesce(F.col("good_groups"), F.lit(0))
    ga = F.try_divide(good_rows.cast("double"), F.col("rows").cast("double"))
    pga = F.try_divide(good_groups.cast("double"), F.col("identified_templates").cast("double"))
    rga = F.try_divide(good_groups.cast("double"), n_truth.cast("double"))
    return out.select(
        "system",
        F.col("rows").cast("bigint").alias("rows"),
        F.col("ground_templates").cast("bigint").alias("ground_templates"),
        F.col("identified_templates").cast("bigint").alias("identified_templates"),
        _r(ga).alias("GA"), _r(pga).alias("PGA"), _r(rga).alias("RGA"), _r(_f1(pga, rga)).alias("FGA"))


def parsing_accuracy(df: DataFrame, truth: str = "truth", parsed: str = "parsed",
                     folded: bool = False, stratum: DataFrame | None = None) -> DataFrame:
    """Q4/Q5: share of rows whose parsed template equals the truth.

    Null never equals null. ``folded`` compares single-space tokens with the
    truth's ``<*>``-bearing tokens folded to ``<*>`` (P8). A stratum keeps only
    rows whose truth is listed.
    """
    rows = df
    if stratum is not None:
        rows = rows.join(_stratum_keys(stratum).withColumnRenamed("truth", truth),
                         ["system", truth], "left_semi")
    if folded:
        eq = fold_wildcards("truth") == F.split(F.col("parsed"), " ")
    else:
        eq = F.col("truth") == F.col("parsed")
    right = F.sum(F.when(F.coalesce(eq, F.lit(False)), F.col("n")).otherwise(0))
    return template_pairs(rows, truth, parsed).groupBy("system").agg(_r(right / F.sum("n")).alias("PA"))


def template_accuracy(df: DataFrame, truth: str = "truth", parsed: str = "parsed",
                      folded: bool = False, stratum: DataFrame | None = None) -> DataFrame:
    """Q6-Q8: PTA, RTA, FTA per system plus both template counts.

    A parsed template is right when its rows carry exactly one truth and that
    truth is the template itself (``folded``: the parsed template with
    ``<*>``-bearing tokens folded equals the truth token-wise — the reference
    passes the parsed side first). Null truths are dropped first.
    """
    pairs = _stored_pairs(df, truth, parsed)
    by_parsed = pairs.where(F.col("parsed").isNotNull()).groupBy("system", "parsed").agg(
        F.count(F.lit(1)).alias("k"), F.max("truth").alias("truth"))
    if folded:
        same = fold_wildcards("parsed") == F.split(F.col("truth"), " ")
    else:
        same = F.col("truth") == F.col("parsed")
    right = by_parsed.where((F.col("k") == 1) & same)
    if stratum is None:
        good = right.groupBy("system").agg(F.count(F.lit(1)).alias("good"))
        n_parsed = by_parsed.groupBy("system").agg(F.count(F.lit(1)).alias("identified_templates"))
        n_truth = (pairs.select("system", "truth").distinct().groupBy("system")
                   .agg(F.count(F.lit(1)).alias("ground_templates")))
        out = n_parsed.join(n_truth, "system").join(good, "system", "left")
    else:
        keys = _stratum_keys(stratum)
        good = (right.join(keys, ["system", "truth"], "left_semi").groupBy("system")
                .agg(F.count(F.lit(1)).alias("good")))
        n_parsed = (pairs.join(keys, ["system", "truth"], "left_semi").groupBy("system")
                    .agg(F.countDistinct("parsed").alias("identified_templates")))
        n_truth = keys.groupBy("system").agg(F.count(F.lit(1)).alias("ground_templates"))
        out = n_truth.join(n_parsed, "system", "left").join(good, "system", "left")
    g = F.coalesce(F.col("good"), F.lit(0)).cast("double")
    pta = F.try_divide(g, F.col("identified_templates").cast("double"))
    rta = F.try_divide(g, F.col("ground_templates").cast("double"))
    return out.select(
        "system",
        F.coalesce(F.col("identified_templates"), F.lit(0)).cast("bigint").alias("identified_templates"),
        F.col("ground_templates").cast("bigint").alias("ground_templates"),
        _r(pta).alias("PTA"), _r(rta).alias("RTA"), _r(_f1(pta, rta)).alias("FTA"))


def similarity_accuracy(df: DataFrame, truth: str = "truth", parsed: str = "parsed") -> DataFrame:
    """Q9: mean template similarity (M6) between truth and parsed per system,
    scored once per pair; pairs without a similarity do not count."""
    scored = template_pairs(df, truth, parsed).withColumn("s", template_similarity("truth", "parsed"))
    rows = F.sum(F.when(F.col("s").isNotNull(), F.col("n")))
    return scored.groupBy("system").agg(_r(F.try_divide(F.sum(F.col("s") * F.col("n")), rows)).alias("SA"))


def evaluate(df: DataFrame, truth: str = "truth", parsed: str = "parsed",
             canonical: bool = True) -> DataFrame:
    """GA, PGA, RGA, FGA, PA, PTA, RTA, FTA and template counts per system.

    One lineage: the pair aggregate (the only pass over the rows), then two
    windows over the small pair table — per truth and per parsed template —
    and a final per-system aggregate. No self-joins, so the row-level
    projection runs once.
    """
    if canonical:
        df = canonicalise(df, truth, parsed)
    pairs = template_pairs(df, truth, parsed)
    has_truth = F.col("truth").isNotNull()
    by_truth = Window.partitionBy("system", "truth")
    by_parsed = Window.partitionBy("system", "parsed")
    scored = pairs.select(
        "system", "truth", "parsed", "n",
        F.count("parsed").over(by_truth).alias("k_t"),
        F.sum("n").over(by_truth).alias("rows_t"),
        F.count("truth").over(by_parsed).alias("k_p"),
        F.sum(F.when(has_truth, F.col("n"))).over(by_parsed).alias("rows_p"))
    ga_hit = has_truth & F.col("parsed").isNotNull() & (F.col("k_t") == 1) & (F.col("rows_t") == F.col("rows_p"))
    ta_hit = has_truth & (F.col("k_p") == 1) & (F.col("truth") == F.col("parsed"))
    agg = scored.groupBy("system").agg(
        F.sum(F.when(has_truth, F.col("n"))).alias("rows"),
        F.sum("n").alias("all_rows"),
        F.count_distinct("truth").alias("ground_templates"),
        F.count_distinct(F.when(has_truth, F.col("parsed"))).alias("identified_templates"),
        F.sum(F.when(ga_hit, F.col("rows_t")).otherwise(0)).alias("good_rows"),
        F.count(F.when(ga_hit, 1)).alias("good_groups"),
        F.count(F.when(ta_hit, 1)).alias("good_t"),
        F.sum(F.when(F.col("truth") == F.col("parsed"), F.col("n")).otherwise(0)).alias("pa_rows"))

    def ratio(a, b):
        return F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))

    ga, pga, rga = ratio("good_rows", "rows"), ratio("good_groups", "identified_templates"), \
        ratio("good_groups", "ground_templates")
    pta, rta = ratio("good_t", "identified_templates"), ratio("good_t", "ground_templates")
    return agg.select(
        "system", F.col("rows").cast("bigint").alias("rows"),
        F.col("ground_templates").cast("bigint").alias("ground_templates"),
        F.col("identified_templates").cast("bigint").alias("identified_templates"),
        _r(ga).alias("GA"), _r(pga).alias("PGA"), _r(rga).alias("RGA"), _r(_f1(pga, rga)).alias("FGA"),
        _r(ratio("pa_rows", "all_rows")).alias("PA"),
        _r(pta).alias("PTA"), _r(rta).alias("RTA"), _r(_f1(pta, rta)).alias("FTA"))


def result_rows(metrics: DataFrame, run_stats: DataFrame | None = None) -> DataFrame:
    """Q10: one result row per system with run statistics and metrics.

    ``run_stats`` has ``system, parse_time, invoc_time, invoc_num, invoc_token``
    (see :func:`logloom.operators.labelling.labelling_stats`); missing systems get 0.
    """
    base = metrics
    if run_stats is None:
        stats = [F.lit(0.0).alias(c) for c in ("parse_time", "invoc_time")] + [
            F.lit(0).cast("bigint").alias("invoc_num"), F.lit(0.0).alias("invoc_token")]
        base = base.select("*", *stats)
    else:
        base = base.join(run_stats, "system", "left")
    return base.select(
        F.col("system").alias("Dataset"),
        _r(F.coalesce(F.col("parse_time"), F.lit(0.0))).alias("parse_time"),
        _r(F.coalesce(F.col("invoc_time"), F.lit(0.0))).alias("invoc_time"),
        F.coalesce(F.col("invoc_num"), F.lit(0)).cast("bigint").alias("invoc_num"),
        _r(F.coalesce(F.col("invoc_token"), F.lit(0.0))).alias("invoc_token"),
        F.col("identified_templates"), F.col("ground_templates"),
        "GA", "PA", "FGA", "PTA", "RTA", "FTA")
