"""One row for each fault that a review reproduced."""
from pyspark.sql import functions as F

from logloom.functions import text as T
from logloom.operators import catalog as CT
from logloom.operators import labelling as LB
from logloom.operators import matching as MT
from logloom.operators import metrics as M
from logloom.operators import tokens as TK
from logloom.plans.catalog_parse import masked_keys
from logloom.sources import logs


def test_null_parsed_is_never_right_nor_counted(spark):
    df = spark.createDataFrame([("s", "a", "a"), ("s", "b", None)], "system string, truth string, parsed string")
    one, two = M.grouping_accuracy(df).first(), M.evaluate(df, canonical=False).first()
    assert (one.GA, one.identified_templates) == (0.5, 1)
    assert (two.GA, two.identified_templates) == (0.5, 1)


def test_long_example_is_skipped_by_all_of_its_tokens(spark):
    long = " ".join(f"w{i % 23}" for i in range(32))
    cat = spark.createDataFrame([("s", 1, long, "long"), ("s", 2, "w1 x", "short")], "system string, template_id bigint, example string, labelled string")
    keys = spark.createDataFrame([("s", "k", long)], "system string, masked string, msg string")
    assert MT.reference_example(keys, cat).first().reference == "short"


def test_positions_count_words_over_double_spaces(spark):
    df = spark.createDataFrame([("s", 1, "open  file 77 now", "open  file {n} now")], "system string, seq bigint, msg string, response string")
    got = CT.slot_positions(CT.extract_slots(df), ["system", "seq"]).first()
    assert got.label == "n" and 2 in got.positions and 4 not in got.positions


UNITS = "system string, round int, seq bigint, li int, label string, pos int, value string"


def test_symbols_keep_the_order_of_insertion(spark):
    rows = [("s", 0, 0, 0, "v", 0, "aaaa"), ("s", 1, 0, 0, "v", 0, "zzzz"), ("s", 1, 1, 0, "v", 0, "aaab")]
    assert CT.variable_units(spark.createDataFrame(rows, UNITS)).first().symbols == ["aaaa", "zzzz", "aaab"]


def test_equal_scores_go_to_the_label_used_first(spark):
    rows = [("s", 0, 0, 0, "zeta", 0, "ab"), ("s", 0, 1, 0, "alpha", 0, "ab")]
    keys = spark.createDataFrame([("s", "k", ["ab"])], "system string, masked string, uncommon array<string>")
    got = MT.relevant_variables(keys, CT.variable_units(spark.createDataFrame(rows, UNITS))).first()
    assert [h.label for h in got.hints] == ["zeta"]


def test_callable_labeller_gets_the_instruction(spark):
    keys = spark.createDataFrame([("s", "k", "open x")], "system string, masked string, msg string")
    hints = spark.createDataFrame([], "system string, masked string, hints array<struct<label:string,symbol:string>>")
    refs = spark.createDataFrame([("s", "k", "ref")], "system string, masked string, reference string")
    asked = LB.build_prompts(keys, hints, refs)
    got = LB.callable_labeller(lambda prompt, msg: "`" + prompt.replace("\n", "|") + "`")(asked).first()
    assert got.response == LB.INSTRUCTION + "|Format Reference: ref|`open x"


def test_truth_and_parsed_tables_are_aligned(spark):
    truth = spark.createDataFrame([("s", 1, "a"), ("s", 2, "b")], "system string, seq bigint, truth string")
    parsed = spark.createDataFrame([("s", 3, "c"), ("s", 1, "a")], "system string, seq bigint, parsed string")
    assert sorted(M.align(truth, parsed).collect()) == [("s", 1, "a", "a"), ("s", 2, "b", None)]


def test_files_are_read_by_their_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Content,EventTemplate\nopen x,open <*>\n")
    (tmp_path / "b.csv").write_text("Level,Content,Day,EventTemplate\nINFO,shut y,today,shut <*>\n")
    got = logs.read_structured_logs(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert [(r.system, r.Content, r.EventTemplate) for r in got.orderBy("seq").collect()] == [
        ("a", "open x", "open <*>"), ("b", "shut y", "shut <*>")]


def test_results_have_no_thousands_separators(spark, tmp_path):
    cols = ["parse_time", "invoc_time", "invoc_num", "invoc_token", "identified_templates", "ground_templates", "GA", "PA", "FGA", "PTA", "RTA", "FTA"]
    row = spark.range(1).select(F.lit("s").alias("Dataset"), *(F.lit(1234.5).alias(c) for c in cols))
    logs.append_results(row, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).first().parse_time == "1234.50"


def test_masks_and_words_once_for_messages_alike(spark):
    # messages that differ in their numbers are masked and cut into words once
    rows = [("a", 2, "User 17 saw 10.0.0.1:80", "t2"), ("a", 1, "User 93 saw 10.0.0.1:80", "t1"), ("a", 3, None, "t3"),
            ("a", 4, "12:34:56:78:9a:bc up", "t4"), ("a", 5, "12:34:56:78:9a:bcd up", "t5"), ("b", None, "User 5 saw ٣", "t6"),
            ("b", 7, "User 6 saw ٣ ٣x", "t7"), ("b", 7, "User x saw x.co2 1 1", "t8")]
    df = spark.createDataFrame(rows, "system string, seq long, Content string, EventTemplate string")
    both = df.select(T.mask_message("Content").alias("a"), T.mask_message(T.zero_digits("Content")).alias("b")).collect()
    assert all(r.a == r.b for r in both)
    keys = masked_keys(df)
    got = {(r.system, r.masked): (r.seq, r.msg, r.truth) for r in keys.collect()}
    assert got[("a", "User Varsaw Var")] == (1, "User 93 saw 10.0.0.1:80", "t1")
    assert got[("a", None)] == (3, None, "t3")
    few = {r.word: r.n_messages for r in TK.corpus_dictionary(df, "Content", 2).collect()}
    assert few == {"user": 5, "saw": 5, "up": 2}
    for plan in (keys, TK.corpus_dictionary(df, "Content", 2)):
        lines = plan._jdf.queryExecution().optimizedPlan().toString().splitlines()
        below = lines[max(i for i, line in enumerate(lines) if "Aggregate" in line) + 1:]
        assert not any("regexp_replace" in line for line in below)
