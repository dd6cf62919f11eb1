"""Rows keep the order of the list, the files and the rows in a file, however they are split."""

from logloom.sources import logs


def test_seq_follows_files_and_splits(spark, tmp_path):
    def write(name, rows):
        (tmp_path / name).write_text("Content,EventTemplate\n" + "".join(f"{r},t\n" for r in rows))
        return str(tmp_path / name)

    big = [f"b{i} " + "x" * (i % 90) for i in range(900)]
    small, tail = [f"s{i}" for i in range(5)], [f"t{i}" for i in range(300)]
    names = [write("m_part1.csv", small), write("m_part2.csv", big), write("a.csv", tail)]
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
        spark.conf.set("spark.sql.files.openCostInBytes", "10")
        got = logs.read_structured_logs(spark, names, normalise=False).orderBy("system", "seq").collect()
        back = logs.read_structured_logs(spark, names[::-1], system="one", normalise=False)
        assert back.rdd.getNumPartitions() > 5
        back = back.orderBy("seq").collect()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert [r.Content for r in got] == tail + small + big
    assert [r.seq for r in got] == [*range(300), *range(905)]
    assert [r.Content for r in back] == tail + big + small and [r.seq for r in back] == list(range(1205))
