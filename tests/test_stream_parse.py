"""ST1: batches, a restart and a replay equal the batch parse; L2: no call is made twice."""

import glob
import uuid

from pyspark.sql import functions as F

from logloom.operators import labelling as LB
from logloom.operators import tokens as TK
from logloom.plans.catalog_parse import parse_logs, seed_state
from logloom.sources import fixtures as fx
from logloom.streaming import StreamState, parse_batch, start_parse_stream
from conftest import SF001

LOG = "system string, seq bigint, Content string, EventTemplate string"


def test_stream_parse_equals_the_batch_parse(spark, tmp_path):
    logs = fx.log_view(spark, SF001).where("system <> 'shipping'")
    words = TK.corpus_dictionary(logs, "Content", 50).cache()
    examples = fx.labelled_examples(spark, SF001)
    cuts = {"events": (300, 700), "orders": (2000, 4500)}
    third = sum((F.when((F.col("system") == s) & (F.col("seq") >= c), 1).otherwise(0) for s, cs in cuts.items() for c in cs), F.lit(0))
    parts = [logs.where(third == i).coalesce(1) for i in range(3)]
    out, src, ckpt = str(tmp_path / "out"), str(tmp_path / "in"), str(tmp_path / "ckpt")
    state = seed_state(examples, words)

    def run():
        stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(src)
        start_parse_stream(stream, state, words, out, ckpt).awaitTermination()

    parts[0].write.mode("append").parquet(src)
    run()
    folder = StreamState(spark, out)
    assert sorted(folder.commits()) == [-1, 0]
    parts[1].write.mode("append").parquet(src)
    run()  # a new query: all it knows is in the folders
    before = sorted(map(tuple, folder.parsed().collect()))
    parse_batch(parts[1], 1, folder, words)  # a replay after the commit
    assert sorted(map(tuple, folder.parsed().collect())) == before
    # a batch that stopped before its commit: its leavings are overwritten
    spark.createDataFrame([("orders", "left over", 99)], "system string, masked string, template_id bigint").write.parquet(f"{out}/matching/batch=2")
    parts[2].write.mode("append").parquet(src)
    run()
    assert sorted(folder.commits()) == [-1, 0, 1, 2]
    assert folder.before(3).matching.where("masked = 'left over'").count() == 0
    parsed, _, _ = parse_logs(logs, examples, words)
    want = sorted(map(tuple, parsed.select("system", "seq", "parsed").collect()))
    assert sorted(map(tuple, folder.parsed().collect())) == want and len(want) == logs.count()


def test_answers_are_kept(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    folder = str(calls)

    def fn(prompt, msg):
        open(f"{folder}/{msg}-{uuid.uuid4().hex}", "w").close()
        if msg == "shy" and len(glob.glob(f"{folder}/shy-*")) < 3:
            raise OSError("busy")
        if msg == "dead":
            raise OSError("gone")
        return f"`{msg} {{x}}`"

    requests = spark.createDataFrame([("s", m, "i", "p", m) for m in ("one", "two", "shy", "dead")],
                                     "system string, masked string, instruction string, prompt string, msg string")
    ask = LB.durable_labeller(LB.callable_labeller(fn, retries=4), str(tmp_path / "answers"))
    first = ask(requests)
    want = [("s", "one", "one {x}"), ("s", "shy", "shy {x}"), ("s", "two", "two {x}")]
    assert sorted(map(tuple, first.select("system", "masked", "response").collect())) == want
    made = sorted(p.split("-")[0] for p in (q.name for q in calls.iterdir()))
    assert made == ["dead"] * 4 + ["one"] + ["shy"] * 3 + ["two"]
    # the result is used again, computed again, and asked for by a new driver: answered requests make no call
    first.count()
    again = LB.durable_labeller(LB.callable_labeller(fn, retries=4), str(tmp_path / "answers"))(requests.where("masked <> 'dead'"))
    assert sorted(map(tuple, again.select("system", "masked", "response").collect())) == want
    assert len(list(calls.iterdir())) == len(made)
