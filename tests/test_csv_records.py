import random

import pytest

from sievelog.sources.csv_records import Assembler, read_quoted_csv
from sievelog.sources.readers import read_labelled_csv
from sievelog.sources.writers import write_csv


@pytest.fixture()
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _texts(seed, n=150):
    rnd = random.Random(seed)
    parts = ["a", "b c", ",", '"', '""', "\n", "\n\n", "x\ny", "é", "", "end", '",\n"', "long " * 60]
    return [(i, "".join(rnd.choices(parts, k=rnd.randint(0, 6)))) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_the_reader_of_whole_files(spark, tmp_path, small_splits, seed):
    df = spark.createDataFrame(_texts(seed), "id int, message string").repartition(2)
    write_csv(df, str(tmp_path / "t"))
    whole = spark.read.csv(str(tmp_path / "t"), header=True, multiLine=True, escape='"')
    found = read_quoted_csv(spark, str(tmp_path / "t"))
    assert found.columns == whole.columns
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)
    assert spark.read.text(str(tmp_path / "t")).rdd.getNumPartitions() > 20


def test_carriage_returns_blank_lines_and_no_last_break(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'message,is_anomaly\r\n"one\r\ntwo",1\r\n\r\nplain,0\r\n"q ""x"" q",true')
    rows = read_labelled_csv(spark, str(tmp_path / "a.csv"))
    assert sorted(tuple(r) for r in rows.collect()) == [("one\r\ntwo", True), ("plain", False), ('q "x" q', True)]


def test_any_cut_gives_the_same_records():
    lines = 'h\n"a\nb","c"\nd\n"e\n\nf\ng"\nh,"i"\n"j\nk"'.split("\n")
    whole = ["h", '"a\nb","c"', "d", '"e\n\nf\ng"', 'h,"i"', '"j\nk"']
    for mask in range(1 << (len(lines) - 1)):
        found, inside, block, pieces = Assembler(), False, 0, []
        for i, line in enumerate(lines):
            if i and mask >> (i - 1) & 1:
                block = i
            if block == i:
                begins = inside
            found.line(7, block, line, begins)
            inside ^= line.count('"') % 2 == 1
        found.close()
        records = []
        for record, _, _, kind in found.out:
            if kind in (0, 2):
                records.append(record)
            else:
                records[-1] += "\n" + record
        assert records == whole
