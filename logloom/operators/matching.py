"""Matching messages to the template catalog.

All matchers take *keys* — one row per distinct masked message with its
representative (earliest) message — so work is shared by every message with
the same masked key, as the reference does with its matching table.

``keys``: ``system, masked, seq, msg, tokens`` (``tokens`` = F4 of ``msg``).
``catalog``: see :mod:`logloom.operators.catalog`.

J3 is the prefix-tree walk of the reference re-expressed as a frontier
iteration of equi-joins: each step advances every still-walking message by
one tree edge (literal child first; else a ``<*>`` child that skips 0-6
tokens, 0-1 at the root, to the nearest following literal; a trailing ``<*>``
absorbs 1-6, 1 at the root). Tree nodes are the numbered token prefixes of the
indexed templates' match tokens, so no tree is ever built on the driver. The
number of steps is bounded by the longest template.

A masked key can be a whole text. So wherever a key is spread over its tokens or
meets templates it goes by a number, and its text is joined back once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import characters, edit_similarity, jaccard
from ..functions.text import WILDCARD, star_digits
from ..session import ensure_checkpoint_dir, written

def _empty():
    return F.array().cast("array<string>")


# ---------------------------------------------------------------- J1, J2, P3
def match_exact(keys: DataFrame, matching_table: DataFrame) -> DataFrame:
    """Keys found in the matching table ``(system, masked, template_id)``."""
    return keys.join(matching_table.select("system", "masked", "template_id"), ["system", "masked"])


def literal_keys(keys: DataFrame, uncommon_col: str = "uncommon") -> DataFrame:
    """One token, or every token common."""
    return keys.where((F.size("tokens") == 1) | (F.size(uncommon_col) == 0))


def match_literal(keys: DataFrame, catalog: DataFrame) -> DataFrame:
    """Literal messages whose text equals an existing template (lowest id)."""
    cat = catalog.groupBy("system", "template").agg(F.min("template_id").alias("template_id"))
    return keys.join(cat.withColumnRenamed("template", "msg"), ["system", "msg"])


# ------------------------------------------------------------------- tree
def tree_tables(catalog: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges ``(system, node, tok, child)``, terminals ``(system, node, template_id)``
    and prefixes ``(system, template_id, depth, node)`` of the indexed templates."""
    idx = catalog.where("indexed").select("system", "template_id", "tokens")
    pref = idx.select("system", "template_id", "tokens",
                      F.explode(F.sequence(F.lit(0), F.size("tokens"))).alias("depth"))
    pref = pref.select("system", "template_id", "depth", F.slice("tokens", 1, F.col("depth")).alias("node"),
                       F.get("tokens", F.col("depth")).alias("next"))
    edges = (pref.where(F.col("next").isNotNull())
             .select("system", "node", F.col("next").alias("tok"),
                     F.concat("node", F.array("next")).alias("child")).distinct())
    # a later insert of the same token path overwrites the terminal
    terminals = (idx.groupBy("system", F.col("tokens").alias("node"))
                 .agg(F.max("template_id").alias("template_id")))
    return edges, terminals, pref.select("system", "template_id", "depth", "node")


def interned_tree(catalog: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The prefix tree of the indexed templates in numbers.

    ``nodes``: ``system, prefix, id, star, terminal, star_terminal`` — a node per
    token prefix, its ``<*>`` child and the templates that end at either;
    ``edges``: ``node, tok, child`` with numbered tokens; ``vocab``: ``token, tok``.
    """
    paths, terminals, _ = tree_tables(catalog)
    roots = catalog.where("indexed").select("system", _empty().alias("prefix"))
    ids = written(paths.select("system", F.col("child").alias("prefix")).unionByName(roots).distinct()
                  .withColumn("id", F.monotonically_increasing_id()), "nodes")
    vocab = written(paths.select(F.col("tok").alias("token")).distinct()
                    .withColumn("tok", F.monotonically_increasing_id()), "vocab")
    ends = terminals.select("system", F.col("node").alias("prefix"), F.col("template_id").alias("terminal"))
    ids = ids.join(ends, ["system", "prefix"], "left")
    edges = (paths.withColumnRenamed("tok", "token").join(vocab, "token")
             .join(ids.select("system", F.col("prefix").alias("node"), F.col("id").alias("from")), ["system", "node"])
             .join(ids.select("system", F.col("prefix").alias("child"), F.col("id").alias("to"), "terminal"), ["system", "child"]))
    edges = written(edges.select(F.col("from").alias("node"), "token", "tok", F.col("to").alias("child"), "terminal"), "edges")
    stars = edges.where(F.col("token") == WILDCARD).select(
        F.col("node").alias("id"), F.col("child").alias("star"), F.col("terminal").alias("star_terminal"))
    nodes = written(ids.join(stars, "id", "left").select("system", "prefix", "id", "star", "terminal", "star_terminal"), "tree")
    return nodes, edges.select("node", "tok", "child"), vocab


_WALK = "key bigint, n int, node bigint, i int, walking boolean, template_id bigint"


def match_wildcard(keys: DataFrame, catalog: DataFrame, *carry: str) -> DataFrame:
    """Returns ``system, masked, ok, template_id, fail_node`` for every key, and
    its columns ``carry``, so that nothing has to be joined back by the masked text.

    Keys, tree nodes and tokens are numbered, and only tokens that stand in a
    template are kept of a message, as ``(key, pos, tok)``. A step thus moves a
    key's number, node and place: it tries the literal edge at the place and the
    edges of the ``<*>`` child at the places after it, and takes the first hit.
    Each step is stored; finished keys are read from the stored steps.
    """
    spark = keys.sparkSession
    nodes, edges, vocab = interned_tree(catalog)
    own = list(dict.fromkeys(("system", "masked", "tokens", *carry)))
    base = written(keys.select(own).withColumn("key", F.monotonically_increasing_id()), "keys")
    # a long message may hold most of the tokens: they are looked up by token, and AQE splits a frequent one
    at = base.select("key", F.posexplode("tokens").alias("pos", "token")).join(vocab, "token").select("key", "pos", "tok")
    at = written(at, "tokens")
    info = nodes.select(F.col("id").alias("node"), "star", "terminal", "star_terminal", (F.size("prefix") == 0).alias("root"))
    state = base.join(nodes.where(F.size("prefix") == 0).select("system", F.col("id").alias("node")), "system").select(
        "key", F.size("tokens").alias("n"), "node", F.lit(0).alias("i"), F.lit(True).alias("walking"),
        F.lit(None).cast("bigint").alias("template_id"))
    steps = []
    folder = f"{ensure_checkpoint_dir(spark)}/walk-{uuid.uuid4().hex}"
    while True:
        here = state.join(info, "node").withColumn("reach", F.when(F.col("root"), 2).otherwise(7))
        star_tries = F.transform(
            F.sequence(F.lit(0), F.greatest(F.least("reach", F.col("n") - F.col("i")) - 1, F.lit(0))),
            lambda k: F.struct(F.col("star").alias("node"), (F.col("i") + k).alias("pos"), (k + 1).alias("rank")))
        literal = F.array(F.struct("node", F.col("i").alias("pos"), F.lit(0).alias("rank")))
        tries = here.where(F.col("i") < F.col("n")).select("key", F.explode(
            F.when(F.col("star").isNull(), literal).otherwise(F.concat(literal, star_tries))).alias("t")).select("key", "t.*")
        hit = (tries.join(at, ["key", "pos"]).join(edges, ["node", "tok"]).groupBy("key")
               .agg(F.min(F.struct("rank", "child", "pos")).alias("h")))
        ended, left = F.col("i") >= F.col("n"), F.col("n") - F.col("i")
        moved = F.col("h").isNotNull()
        found = F.when(ended, F.col("terminal")).when(~moved & (left < F.col("reach")), F.col("star_terminal"))
        step = here.join(hit, "key", "left").select(
            "key", "n", F.when(moved, F.col("h.child")).otherwise(F.col("node")).alias("node"),
            F.when(moved, F.col("h.pos") + 1).otherwise(F.col("i")).alias("i"), moved.alias("walking"),
            found.alias("template_id"))
        steps.append(f"{folder}/step={len(steps)}")
        step.write.parquet(steps[-1])
        state = spark.read.schema(_WALK).parquet(steps[-1]).where("walking")
        if not state.limit(1).count():
            break
    done = spark.read.schema(_WALK).parquet(*steps).where("NOT walking")
    ends = nodes.select(F.col("id").alias("node"), F.col("prefix"))
    out = base.select("key", "system", "masked", *carry).join(done.select("key", "node", "template_id"), "key", "left")
    # a system without templates has no tree: its keys fail at the root
    return out.join(ends, "node", "left").select(
        "system", "masked", F.col("template_id").isNotNull().alias("ok"), "template_id",
        F.coalesce("prefix", _empty()).alias("fail_node"), *carry)


# ---------------------------------------------------------------- J4, P4, M5
def dfs_order(catalog: DataFrame) -> DataFrame:
    """Pre-order position of every indexed template: children are visited in
    the order they were first created (smallest template id through them)."""
    _, _, pref = tree_tables(catalog)
    first = pref.groupBy("system", "node").agg(F.min("template_id").alias("first_id"))
    keyed = pref.where(F.col("depth") > 0).join(first, ["system", "node"])
    return (keyed.groupBy("system", "template_id")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "first_id"))),
                             lambda s: s["first_id"]).alias("dfs")))


def similar_candidates(failed: DataFrame, catalog: DataFrame) -> DataFrame:
    """Pairs ``system, key, template_id`` that J4 has to look at, and all it may take;
    ``failed`` has ``system, key, msg, tokens``, its keys numbered.

    A masked similarity of 0.8 needs ``ceil(0.8 n)`` of the template's n different
    tokens in the message; ``<*>`` may stand for masked ones, literals must occur.
    So a pair shares one of the template's first literals, all but as many as may
    be missing, in any fixed order: longest first, as long tokens are rare.
    Templates without literals are the lone ``<*>``; P4 then wants an edit
    similarity of 0.8, so lengths must agree within that.
    """
    t = catalog.where("indexed").select("system", "template_id", "example", F.array_distinct("tokens").alias("set"))
    literals = F.filter("set", lambda x: x != WILDCARD)
    ordered = F.transform(F.array_sort(F.transform(literals, lambda x: F.struct((-F.length(x)).alias("l"), x.alias("x")))),
                          lambda s: s["x"])
    n, star = F.size("set"), F.array_contains("set", WILDCARD).cast("int")
    # 5 * found >= 4 * n, in integers
    needed = F.floor((4 * n + 4) / 5).cast("int") - star
    first = t.where(needed > 0).select("system", "template_id", F.explode(
        F.slice(ordered, F.lit(1), n - star - needed + 1)).alias("token"))
    words = failed.select("system", "key", F.explode(F.array_distinct("tokens")).alias("token"))
    by_token = words.join(first, ["system", "token"]).select("system", "key", "template_id")
    size = F.length("example")
    lone = t.where(needed <= 0).select("system", "template_id", F.explode(F.sequence(
        F.ceil(size * 0.8).cast("int"), F.floor(size / 0.8).cast("int"))).alias("size"))
    by_size = failed.select("system", "key", F.length("msg").alias("size")).join(lone, ["system", "size"])
    return by_token.unionByName(by_size.select("system", "key", "template_id")).distinct()


def match_similar(failed: DataFrame, catalog: DataFrame) -> DataFrame:
    """For keys the tree failed on, the first template in DFS order under
    the failing node that passes P4 and has masked similarity (M5) >= 0.8.

    ``failed``: ``system, masked, msg, tokens, fail_node``. Keys of systems without
    indexed templates have nothing to meet; the others are numbered and stored.
    """
    order = dfs_order(catalog)
    some = catalog.where("indexed").select("system").distinct()
    failed = written(failed.join(some, "system", "left_semi").withColumn("key", F.monotonically_increasing_id()), "failed")
    cat = catalog.where("indexed").select(
        "system", "template_id", F.col("tokens").alias("ttok"), F.col("example"), "label_positions")
    cand = (similar_candidates(failed, catalog).join(failed.drop("system", "masked"), "key").join(cat, ["system", "template_id"])
            .where(F.slice("ttok", F.lit(1), F.size("fail_node")) == F.col("fail_node")))
    lt, tt = F.col("tokens"), F.col("ttok")
    p4 = (F.get(lt, 0) == F.get(tt, 0)) | F.when(
        F.size(tt) == 1,
        (F.get(tt, 0) == WILDCARD) & (edit_similarity(star_digits("msg"), star_digits("example")) >= 0.8)
    ).otherwise(F.coalesce(F.get(tt, 1) == F.get(lt, 1), F.lit(False)))
    known = F.flatten(F.map_values(F.map_filter("label_positions", lambda k, v: ~k.startswith("unknown"))))
    masked = F.transform(lt, lambda x, i: F.when(F.array_contains(known, i), F.lit(WILDCARD)).otherwise(x))
    ok = cand.where(F.coalesce(p4, F.lit(False)) & (jaccard(masked, tt) >= 0.8)).join(order, ["system", "template_id"])
    best = ok.groupBy("key").agg(F.min_by("template_id", F.struct("dfs", "template_id")).alias("template_id"))
    return best.join(failed.select("key", "system", "masked"), "key").select("system", "masked", "template_id")


# ---------------------------------------------------------------- J5, J6, J8
# Fixed value.
DEFAULT_REFERENCE = "env.createBean2(): Factory error creating {module} ({module}, {module})"


def reference_example(keys: DataFrame, catalog: DataFrame) -> DataFrame:
    """The labelled example whose message shares most whitespace tokens
    (Jaccard) with the key's message; examples of 30+ tokens are skipped;
    ties go to the earliest template; the fixed default when none qualifies.

    Candidates come from an inverted index (shared token equi-join); when no
    example shares a token every similarity is 0 and the earliest eligible
    example wins, as in the reference's strict ``>`` scan from -1.
    """
    ex = catalog.select("system", "template_id", "labelled",
                        F.split(F.trim(F.regexp_replace("example", r"(?U)\s+", " ")), " ").alias("et"))
    # the limit counts all tokens, repeated ones too
    ex = ex.where(F.size("et") < 30).withColumn("et", F.array_distinct("et"))
    kw = written(keys.select("system", "masked", F.array_distinct(
        F.filter(F.split(F.col("msg"), r"(?U)\s+"), lambda x: x != "")).alias("mt"))
        .withColumn("key", F.monotonically_increasing_id()), "words")
    inv_k = kw.select("system", "key", F.size("mt").alias("nm"), F.explode("mt").alias("w"))
    inv_e = ex.select("system", "template_id", F.size("et").alias("ne"), F.explode("et").alias("w"))
    # both are sets: a pair meets once for each word that they share
    shared = inv_k.join(inv_e, ["system", "w"]).groupBy("key", "nm", "template_id", "ne").count()
    sim = F.col("count") / (F.col("nm") + F.col("ne") - F.col("count"))
    best = shared.groupBy("key").agg(F.max(F.struct(sim.alias("sim"), (-F.col("template_id")).alias("id"))).alias("b"))
    best = best.select("key", (-F.col("b.id")).alias("template_id"))
    earliest = ex.groupBy("system").agg(F.min_by("labelled", F.col("template_id")).alias("first_labelled"))
    return (kw.select("key", "system", "masked").join(best, "key", "left")
            .join(ex.select("system", "template_id", "labelled"), ["system", "template_id"], "left")
            .join(earliest, "system", "left")
            .select("system", "masked",
                    F.coalesce(F.col("labelled"), F.col("first_labelled"), F.lit(DEFAULT_REFERENCE))
                    .alias("reference")))


def relevant_variables(keys: DataFrame, units: DataFrame, uncommon_col: str = "uncommon") -> DataFrame:
    """Per key, label -> symbol hints. For each uncommon token the symbol
    (digits starred) with the highest character Jaccard wins — on ties that of
    the label used first, then its first symbol — if it reaches 0.5;
    ``unknown*`` labels and empty symbols are skipped; a later token overwrites
    a label's symbol.

    ``units``: ``system, label, symbols, first_use`` (A10), best stored. Each
    distinct token of a system is compared once. Sets of n characters with a
    Jaccard of 0.5 share one of their first n - ceil(n / 2) + 1 characters, in
    any fixed order, and neither has over twice the other's size; the order is
    from the highest code point, so digits' stars and ``e`` seldom decide.
    """
    def with_prefix(df: DataFrame, text: str) -> DataFrame:
        chars = F.sort_array(F.array_distinct(characters(text)), asc=False)
        n = F.size("chars")
        return df.withColumn("chars", chars).withColumn("n", n).withColumn(
            "ch", F.explode(F.slice("chars", F.lit(1), n - F.ceil(n / 2).cast("int") + 1)))

    sym = (units.where(~F.col("label").startswith("unknown"))
           .select("system", "label", "first_use", F.posexplode("symbols").alias("spos", "symbol"))
           .where(F.col("symbol") != ""))
    sch = with_prefix(sym.withColumn("starred", star_digits("symbol")), "starred").select(
        "system", "ch", F.col("n").alias("sn"), F.col("chars").alias("schars"), "label", "first_use", "spos", "symbol")
    named = written(keys.join(sym.select("system").distinct(), "system", "left_semi")
                    .select("system", "masked", uncommon_col).withColumn("key", F.monotonically_increasing_id()), "uncommon")
    tok = named.select("system", "key", F.posexplode(uncommon_col).alias("tpos", "token"))
    tch = with_prefix(tok.select("system", "token").distinct(), "token")
    # exploded sides look smaller to the planner than they are: no broadcast here
    pairs = (tch.hint("merge").join(sch, ["system", "ch"]).where((F.col("sn") <= 2 * F.col("n")) & (F.col("n") <= 2 * F.col("sn")))
             .withColumn("score", jaccard("chars", "schars")).where("score >= 0.5"))
    best = pairs.groupBy("system", "token").agg(
        F.min_by(F.struct("label", "symbol"), F.struct(-F.col("score"), F.col("first_use"), F.col("label"), F.col("spos"))).alias("b"))
    last = (tok.hint("merge").join(best, ["system", "token"]).groupBy("key", F.col("b.label").alias("label"))
            .agg(F.max_by(F.col("b.symbol"), F.col("tpos")).alias("symbol"), F.min("tpos").alias("first_pos")))
    hints = last.groupBy("key").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("first_pos", "label", "symbol"))),
                    lambda s: F.struct(s["label"].alias("label"), s["symbol"].alias("symbol"))).alias("hints"))
    return hints.join(named.select("key", "system", "masked"), "key").select("system", "masked", "hints")


def resolve_templates(assign: DataFrame, catalog: DataFrame, template_col: str = "final_template") -> DataFrame:
    """Template text for every assignment ``(system, template_id, ...)``."""
    return assign.join(catalog.select("system", "template_id", F.col(template_col).alias("parsed")),
                       ["system", "template_id"], "left")


def window_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
