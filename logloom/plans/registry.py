"""Registered queries: ``name -> callable(spark, sf_dir) -> DataFrame``.

Every query reads the driver's tables (or frames Spark derives from them) in
full; none runs on made-up input. Column names match the oracle SQL in
:mod:`logloom.checks.oracles`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import fixtures as fx
from .rule_parse import rule_parse_metrics

Query = Callable[[SparkSession, str], DataFrame]


def _logs_and_texts(spark: SparkSession, sf_dir: str, normalise_logs: bool = False) -> DataFrame:
    logs = fx.log_view(spark, sf_dir)
    c = T.correct_message("Content") if normalise_logs else F.col("Content")
    return logs.select("system", "seq", c.alias("Content")).unionByName(fx.text_view(spark, sf_dir))


def q_rule_parse_metrics(spark, sf_dir):
    return rule_parse_metrics(fx.log_view(spark, sf_dir))


def q_log_view(spark, sf_dir):
    return fx.log_view(spark, sf_dir)


def q_labelled_examples(spark, sf_dir):
    return fx.labelled_examples(spark, sf_dir)


def q_correct_message(spark, sf_dir):
    return _logs_and_texts(spark, sf_dir).select("system", "seq", T.correct_message("Content").alias("value"))


def q_mask_message(spark, sf_dir):
    return _logs_and_texts(spark, sf_dir).select("system", "seq", T.mask_message("Content").alias("value"))


def q_rule_label(spark, sf_dir):
    return _logs_and_texts(spark, sf_dir, normalise_logs=True).select(
        "system", "seq", T.rule_label("Content").alias("value"))


def q_canonical_template(spark, sf_dir):
    logs = fx.log_view(spark, sf_dir).select("system", "seq", F.col("EventTemplate").alias("Content"))
    src = logs.unionByName(fx.text_view(spark, sf_dir))
    return src.select("system", "seq", T.canonical_template("Content").alias("value"))


def queries() -> dict[str, Query]:
    return {
        "rule_parse_metrics": q_rule_parse_metrics,
        "log_view": q_log_view,
        "labelled_examples": q_labelled_examples,
        "correct_message": q_correct_message,
        "mask_message": q_mask_message,
        "rule_label": q_rule_label,
        "canonical_template": q_canonical_template,
    }


# ---------------------------------------------------------------------------
# Per-row text operators (F3-F13) over the log view and the text tables.
# ---------------------------------------------------------------------------
from ..functions import similarity as S  # noqa: E402
from ..operators import dedup as D  # noqa: E402
from ..operators import metrics as Q  # noqa: E402
from ..operators import sampling as SM  # noqa: E402
from ..operators import tokens as TK  # noqa: E402
from .rule_parse import rule_pairs, rule_parse  # noqa: E402

SEP = "\u0001"


def _joined(arr):
    return F.array_join(arr, SEP)


def _per_row(expr_fn, normalise=False):
    def q(spark, sf_dir):
        src = _logs_and_texts(spark, sf_dir, normalise_logs=normalise)
        return src.select("system", "seq", *expr_fn(F.col("Content")))
    return q


def _arr_out(arr_fn):
    return lambda c: [_joined(arr_fn(c)).alias("value"), F.size(arr_fn(c)).cast("bigint").alias("n")]


def _templates(spark, sf_dir):
    """Truth templates of the log view and labelled templates of the examples."""
    logs = fx.log_view(spark, sf_dir).select("system", "seq", F.col("EventTemplate").alias("Content"))
    ex = fx.labelled_examples(spark, sf_dir).select(
        F.concat(F.col("system"), F.lit("/labelled")).alias("system"), "seq", F.col("EventTemplate").alias("Content"))
    return logs.unionByName(ex)


def q_match_tokens(spark, sf_dir):
    t = _templates(spark, sf_dir)
    return t.select("system", "seq", _joined(T.match_tokens("Content")).alias("value"))


def q_repair_response(spark, sf_dir):
    lv = fx.labelled_log_view(spark, sf_dir)
    msg = T.correct_message("Content")
    return lv.select("system", "seq", T.repair_response(msg, F.col("Labelled")).alias("value"))


def q_scoring_tokens(spark, sf_dir):
    t = _templates(spark, sf_dir).unionByName(fx.text_view(spark, sf_dir))
    return t.select("system", "seq", _joined(T.scoring_tokens("Content")).alias("value"),
                    F.size(T.scoring_tokens("Content")).cast("bigint").alias("n"))


def _norm_logs(spark, sf_dir):
    lv = fx.log_view(spark, sf_dir)
    return lv.select("system", "seq", T.correct_message("Content").alias("Content"),
                     T.correct_message("EventTemplate").alias("EventTemplate"))


def q_jaccard(spark, sf_dir):
    lv = _norm_logs(spark, sf_dir)
    return lv.select("system", "seq", F.round(S.jaccard(T.tokens("Content"), T.match_tokens("EventTemplate")), 6)
                     .alias("similarity"))


def q_char_jaccard(spark, sf_dir):
    lv = _norm_logs(spark, sf_dir)
    return lv.select("system", "seq", F.round(S.char_jaccard("Content", "EventTemplate"), 6).alias("similarity"))


def q_edit_similarity(spark, sf_dir):
    lv = _norm_logs(spark, sf_dir)
    return lv.select("system", "seq", F.round(S.edit_similarity(T.star_digits("Content"),
                                                                T.star_digits("EventTemplate")), 6).alias("similarity"))


# ---------------------------------------------------------------------------
# Dictionary, uncommon tokens, dedup, sampling
# ---------------------------------------------------------------------------
MIN_MESSAGES = 50


def _dictionary(spark, sf_dir):
    return TK.corpus_dictionary(fx.log_view(spark, sf_dir), "Content", MIN_MESSAGES)


def _tokenised(spark, sf_dir):
    return fx.log_view(spark, sf_dir).select("system", "seq", T.message_tokens("Content").alias("tokens"))


def _uncommon(spark, sf_dir, distinct=False):
    """The uncommon tokens of every message; messages are cut into tokens once, for the dictionary too."""
    rows = written(_tokenised(spark, sf_dir), "tokens")
    return TK.uncommon_tokens(rows, ["system", "seq"], "tokens", TK.token_dictionary(rows, "tokens", MIN_MESSAGES),
                              distinct=distinct)


def q_dictionary(spark, sf_dir):
    return _dictionary(spark, sf_dir)


def q_is_common(spark, sf_dir):
    toks = _tokenised(spark, sf_dir).select(F.explode("tokens").alias("token")).distinct()
    return TK.with_is_common(toks, "token", _dictionary(spark, sf_dir))


def q_uncommon_tokens(spark, sf_dir):
    u = _uncommon(spark, sf_dir)
    return u.select("system", "seq", _joined("uncommon").alias("value"), F.size("uncommon").cast("bigint").alias("n"),
                    TK.literal_flag("tokens", "uncommon").alias("is_literal"))


def q_distinct_uncommon_tokens(spark, sf_dir):
    u = _uncommon(spark, sf_dir, distinct=True)
    return u.select("system", "seq", _joined("uncommon").alias("value"))


def q_dedup_by_mask(spark, sf_dir):
    d = D.dedup_by_mask(fx.log_view(spark, sf_dir))
    return d.select("system", "seq", T.mask_message("Content").alias("masked"))


def q_dedup_by_format(spark, sf_dir):
    d = D.dedup_by_format(fx.log_view(spark, sf_dir))
    return d.select("system", "seq", T.format_signature("Content").alias("signature"))


def q_candidate_groups(spark, sf_dir):
    return _groups(spark, sf_dir).select("system", "seq", _joined("uncommon").alias("uncommon"))


def q_distinct_uncommon(spark, sf_dir):
    return D.distinct_uncommon(_groups(spark, sf_dir))


def q_prefix_sample(spark, sf_dir):
    return SM.prefix_sample(fx.log_view(spark, sf_dir), 0.2).select("system", "seq")


def q_head_per_system(spark, sf_dir):
    return SM.head_per_system(fx.log_view(spark, sf_dir), 32).select("system", "seq", "Content")


def _groups(spark, sf_dir, text=False):
    """Candidate groups, stored: the clustering and what is counted over its clusters read them several times."""
    src = written(fx.log_view(spark, sf_dir), "logs") if not text else fx.text_view(spark, sf_dir)
    words = TK.corpus_dictionary(src, "Content", MIN_MESSAGES)
    return written(D.candidate_groups(src, words), "groups")


def q_token_clusters(spark, sf_dir):
    return SM.token_clusters(_groups(spark, sf_dir))


def q_text_token_clusters(spark, sf_dir):
    return SM.token_clusters(_groups(spark, sf_dir, text=True))


def q_cluster_positions(spark, sf_dir):
    g = _groups(spark, sf_dir)
    return SM.cluster_positions(g, written(SM.token_clusters(g), "clusters"))


def q_contribution_scores(spark, sf_dir):
    g = _groups(spark, sf_dir)
    return SM.contribution_scores(g, written(SM.token_clusters(g), "clusters"))


def q_diversified_sample(spark, sf_dir):
    s = SM.sample_examples(fx.log_view(spark, sf_dir), _dictionary(spark, sf_dir), 32, fraction=0.2)
    return s.select("system", "seq", "pick", T.correct_message("Content").alias("Content"),
                    T.correct_message("EventTemplate").alias("EventTemplate"))


# ---------------------------------------------------------------------------
# Metric variants over the rule parse (Q3, Q5, Q7, Q8, Q9, Q10)
# ---------------------------------------------------------------------------
def _parsed(spark, sf_dir):
    return rule_parse(fx.log_view(spark, sf_dir))


def _pairs(spark, sf_dir):
    """The rule parse as rows per distinct template pair, stored; one pass over the log view."""
    return written(rule_pairs(fx.log_view(spark, sf_dir)), "pairs")


def _stratum(parsed):
    """Truth templates that carry at least one variable slot."""
    return parsed.where(F.col("truth").contains("<*>")).select("system", F.col("truth").alias("template")).distinct()


def q_grouping_accuracy(spark, sf_dir):
    return Q.grouping_accuracy(_pairs(spark, sf_dir))


def q_grouping_accuracy_stratified(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return Q.grouping_accuracy(p, stratum=_stratum(p))


def q_parsing_accuracy_folded(spark, sf_dir):
    return Q.parsing_accuracy(_pairs(spark, sf_dir), folded=True)


def q_parsing_accuracy_stratified(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return Q.parsing_accuracy(p, stratum=_stratum(p))


def q_template_accuracy(spark, sf_dir):
    return Q.template_accuracy(_pairs(spark, sf_dir))


def q_template_accuracy_folded(spark, sf_dir):
    return Q.template_accuracy(_pairs(spark, sf_dir), folded=True)


def q_template_accuracy_stratified(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return Q.template_accuracy(p, stratum=_stratum(p))


def q_similarity_accuracy(spark, sf_dir):
    return Q.similarity_accuracy(_pairs(spark, sf_dir))


def q_aligned_metrics(spark, sf_dir):
    p = _parsed(spark, sf_dir)
    return Q.evaluate(Q.align(p.select("system", "seq", "truth"), p.select("system", "seq", "parsed")), canonical=False)


def q_result_rows(spark, sf_dir):
    return Q.result_rows(Q.evaluate(_pairs(spark, sf_dir), canonical=False))


_MORE: dict[str, Query] = {
    "remove_punctuation": _per_row(lambda c: [T.remove_punctuation(c).alias("value")]),
    "tokens": _per_row(_arr_out(T.tokens)),
    "message_tokens": _per_row(_arr_out(T.message_tokens)),
    "words": _per_row(_arr_out(T.words)),
    "format_signature": _per_row(lambda c: [T.format_signature(c).alias("value")]),
    "star_digits": _per_row(lambda c: [T.star_digits(c).alias("value")]),
    "match_tokens": q_match_tokens,
    "repair_response": q_repair_response,
    "scoring_tokens": q_scoring_tokens,
    "jaccard": q_jaccard,
    "char_jaccard": q_char_jaccard,
    "edit_similarity": q_edit_similarity,
    "dictionary": q_dictionary,
    "is_common": q_is_common,
    "uncommon_tokens": q_uncommon_tokens,
    "distinct_uncommon_tokens": q_distinct_uncommon_tokens,
    "dedup_by_mask": q_dedup_by_mask,
    "dedup_by_format": q_dedup_by_format,
    "candidate_groups": q_candidate_groups,
    "distinct_uncommon": q_distinct_uncommon,
    "prefix_sample": q_prefix_sample,
    "head_per_system": q_head_per_system,
    "token_clusters": q_token_clusters,
    "text_token_clusters": q_text_token_clusters,
    "cluster_positions": q_cluster_positions,
    "contribution_scores": q_contribution_scores,
    "diversified_sample": q_diversified_sample,
    "grouping_accuracy": q_grouping_accuracy,
    "grouping_accuracy_stratified": q_grouping_accuracy_stratified,
    "parsing_accuracy_folded": q_parsing_accuracy_folded,
    "parsing_accuracy_stratified": q_parsing_accuracy_stratified,
    "template_accuracy": q_template_accuracy,
    "template_accuracy_folded": q_template_accuracy_folded,
    "template_accuracy_stratified": q_template_accuracy_stratified,
    "similarity_accuracy": q_similarity_accuracy,
    "aligned_metrics": q_aligned_metrics,
    "result_rows": q_result_rows,
}

_BASE = queries


def queries() -> dict[str, Query]:  # noqa: F811
    out = _BASE()
    out.update(_MORE)
    return out


# ---------------------------------------------------------------------------
# Catalog, matching, labelling, catalog parse
# Iterative or regex-built per row: rows-only checks, replay tests in tests/.
# ---------------------------------------------------------------------------
from ..operators import catalog as CT  # noqa: E402
from ..operators import labelling as LB  # noqa: E402
from ..operators import matching as MT  # noqa: E402
from ..session import written  # noqa: E402
from .catalog_parse import distinct_keys, masked_keys, parse_pairs  # noqa: E402


def _labelled_rows(spark, sf_dir):
    """Every message of the log view with its labelled response."""
    lv = fx.labelled_log_view(spark, sf_dir)
    return lv.select("system", "seq", T.correct_message("Content").alias("msg"), F.col("Labelled").alias("response"))


def _seed_catalog(spark, sf_dir, indexed=True, logs=None, words=None):
    """``logs``, ``words``: the stored log tables and dictionary of a query that reads them again."""
    examples = fx.labelled_examples(spark, sf_dir) if logs is None else logs.labelled_examples()
    ex = examples.select(
        "system", "seq", F.col("Content").alias("msg"), F.col("EventTemplate").alias("response"))
    words = _dictionary(spark, sf_dir) if words is None else words
    cat, assigned, units = CT.upsert_catalog(None, ex, words, 0, indexed=indexed)
    return cat, assigned, units


def _words_of(logs):
    """The stored dictionary of stored log tables."""
    return written(TK.corpus_dictionary(logs.log_view(), "Content", MIN_MESSAGES), "words")


def _all_rows(spark, sf_dir):
    """The log view and the text tables, normalised (the texts have no truth)."""
    texts = fx.text_view(spark, sf_dir).withColumn("EventTemplate", F.lit(None).cast("string"))
    rows = fx.log_view(spark, sf_dir).unionByName(texts)
    return rows.select("system", "seq", T.correct_message("Content").alias("Content"),
                       T.correct_message("EventTemplate").alias("EventTemplate"))


def _uncommon_keys(spark, sf_dir, logs, words, *carry):
    """The keys of the log view and the text tables with their uncommon tokens."""
    texts = fx.text_view(spark, sf_dir).withColumn("EventTemplate", F.lit(None).cast("string"))
    return distinct_keys(logs.log_view().unionByName(texts), words, raw=True, carry=carry)


def q_slot_capture(spark, sf_dir):
    e = written(CT.extract_slots(_labelled_rows(spark, sf_dir)), "captures")
    caps = e.select("system", "seq", F.posexplode("caps").alias("k", "s")).select(
        "system", "seq", F.col("k").cast("bigint").alias("k"), F.col("s.label").alias("label"),
        F.col("s.value").alias("value"), F.col("s.start").cast("bigint").alias("start"))
    pos = CT.slot_positions(e, ["system", "seq"]).select(
        "system", "seq", "label", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",")
        .alias("positions"))
    return caps.join(pos, ["system", "seq", "label"], "left")


def q_slot_correction(spark, sf_dir):
    t = CT.template_from_response(_labelled_rows(spark, sf_dir), _dictionary(spark, sf_dir))
    return t.select("system", "seq", "labelled", "template",
                    F.array_join(F.transform("label_vars", lambda x: x["label"]), ",").alias("labels"))


def q_catalog_seed(spark, sf_dir):
    cat, _, _ = _seed_catalog(spark, sf_dir, indexed=False)
    return cat.select("system", "template_id", "template", "example", "labelled",
                      _joined("tokens").alias("tokens"), "indexed")


def q_variable_units(spark, sf_dir):
    rows = CT.template_from_response(_labelled_rows(spark, sf_dir), _dictionary(spark, sf_dir))
    u = CT.variable_units(written(CT.slot_units(rows, 0), "units"))
    return u.select("system", "label", "n_values", _joined("symbols").alias("symbols"))


def q_wildcard_match(spark, sf_dir):
    cat, _, _ = _seed_catalog(spark, sf_dir)
    return MT.match_wildcard(masked_keys(_all_rows(spark, sf_dir)), cat).select(
        "system", "masked", "ok", "template_id", _joined("fail_node").alias("fail_node"))


def q_similar_match(spark, sf_dir):
    cat, _, _ = _seed_catalog(spark, sf_dir)
    walk = MT.match_wildcard(masked_keys(_all_rows(spark, sf_dir)), cat, "msg", "tokens")
    return MT.match_similar(walk.where(~F.col("ok")).select("system", "masked", "msg", "tokens", "fail_node"), cat)


def q_reference_example(spark, sf_dir):
    cat, _, _ = _seed_catalog(spark, sf_dir)
    return MT.reference_example(masked_keys(_all_rows(spark, sf_dir)), cat)


def q_relevant_variables(spark, sf_dir):
    logs = fx.stored_logs(spark, sf_dir)
    words = _words_of(logs)
    _, _, units = _seed_catalog(spark, sf_dir, logs=logs, words=words)
    hints = MT.relevant_variables(_uncommon_keys(spark, sf_dir, logs, words), written(CT.variable_symbols(units), "symbols"))
    return hints.select("system", "masked", F.array_join(F.transform(
        "hints", lambda h: F.concat(h["label"], F.lit("="), h["symbol"])), SEP).alias("hints"))


def q_labelling_prompts(spark, sf_dir):
    logs = fx.stored_logs(spark, sf_dir)
    words = _words_of(logs)
    cat, _, units = _seed_catalog(spark, sf_dir, logs=logs, words=words)
    keys = written(_uncommon_keys(spark, sf_dir, logs, words, "msg"), "keys")
    p = LB.build_prompts(keys, MT.relevant_variables(keys, written(CT.variable_symbols(units), "symbols")), MT.reference_example(keys, cat))
    return p.select("system", "masked", "instruction", "prompt")


def q_generalised_templates(spark, sf_dir):
    cat, _, _ = _seed_catalog(spark, sf_dir)
    walk = MT.match_wildcard(masked_keys(_all_rows(spark, sf_dir)), cat, "seq", "msg")
    hits = walk.where("ok").select("system", "template_id", "seq", "msg")
    out = CT.generalise_templates(written(hits, "hits"), cat)
    names = F.filter(F.map_keys("label_positions"), lambda l: l.rlike("^unknown_[0-9]+$"))
    return out.select("system", "template_id", "template", "final_template", F.array_join(names, ",").alias("unknown"))


def q_catalog_parse_metrics(spark, sf_dir):
    logs = fx.stored_logs(spark, sf_dir)
    pairs, _, stats = parse_pairs(logs.log_view(), logs.labelled_examples(), _words_of(logs))
    return Q.result_rows(Q.evaluate(pairs), stats).drop("parse_time", "invoc_time")  # wall-clock times


_MORE.update({
    "slot_capture": q_slot_capture,
    "slot_correction": q_slot_correction,
    "catalog_seed": q_catalog_seed,
    "variable_units": q_variable_units,
    "wildcard_match": q_wildcard_match,
    "similar_match": q_similar_match,
    "reference_example": q_reference_example,
    "relevant_variables": q_relevant_variables,
    "labelling_prompts": q_labelling_prompts,
    "generalised_templates": q_generalised_templates,
    "catalog_parse_metrics": q_catalog_parse_metrics,
})


# ---------------------------------------------------------------------------
# Streaming (ST2): first-seen masked keys, with the log view read as a stream.
# ---------------------------------------------------------------------------
def _first_messages(spark, logs):
    """``system, masked, seq, msg`` of every key: ``logs`` is written to the
    checkpoint folder (a line's number in its order needs a window, which streams
    lack), read as a file stream, and the stream's table is read back."""
    from ..session import ensure_checkpoint_dir
    from ..streaming import first_seen_keys
    import uuid
    base = f"{ensure_checkpoint_dir(spark)}/first_seen_{uuid.uuid4().hex}"
    logs = logs.select("system", "seq", "Content")
    logs.write.parquet(f"{base}/logs")
    found = first_seen_keys(spark.readStream.schema(logs.schema).parquet(f"{base}/logs"))
    q = (found.writeStream.format("parquet").option("path", f"{base}/keys").option("checkpointLocation", f"{base}/state")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{base}/keys")


def q_stream_first_seen(spark, sf_dir):
    """Every key of the whole log view."""
    return _first_messages(spark, fx.log_view(spark, sf_dir)).select("system", "masked")


def q_stream_first_messages(spark, sf_dir):
    """Every key of the whole log view with its earliest message."""
    return _first_messages(spark, fx.log_view(spark, sf_dir))


def q_stream_parse(spark, sf_dir):
    """Every row of the log view with the template that the streaming parse gives it:
    the log table is read as a file stream, a third of its files a batch."""
    import uuid
    from ..session import ensure_checkpoint_dir
    from ..streaming import StreamState, start_parse_stream
    from .catalog_parse import seed_state
    base = f"{ensure_checkpoint_dir(spark)}/stream_parse_{uuid.uuid4().hex}"
    logs = fx.log_view(spark, sf_dir)
    logs.write.parquet(f"{base}/logs")
    files = len(spark.read.parquet(f"{base}/logs").inputFiles())
    words = _dictionary(spark, sf_dir)
    stream = spark.readStream.schema(logs.schema).option("maxFilesPerTrigger", -(-files // 3)).parquet(f"{base}/logs")
    start_parse_stream(stream, seed_state(fx.labelled_examples(spark, sf_dir), words), words, f"{base}/out",
                       f"{base}/state").awaitTermination()
    return StreamState(spark, f"{base}/out").parsed()


_MORE["stream_parse"] = q_stream_parse
_MORE["stream_first_messages"] = q_stream_first_messages
_MORE["stream_first_seen"] = q_stream_first_seen
