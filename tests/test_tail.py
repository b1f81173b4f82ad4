import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievelog.sources import tail
from sievelog.sources.readers import follow_files, stream_table


class Followed:
    """A followed path; each call is a new query on the same checkpoint."""

    def __init__(self, spark, path, at, **options):
        self.spark, self.path, self.at, self.options, self.seen = spark, str(path), str(at), options, Counter()

    def new(self):
        lines = follow_files(self.spark, self.path, **self.options).select("file", "at", "value")
        query = lines.writeStream.option("checkpointLocation", f"{self.at}/cp").trigger(availableNow=True).start(f"{self.at}/out")
        query.awaitTermination()
        rows = Counter(tuple(r) for r in self.spark.read.schema(lines.schema).parquet(f"{self.at}/out").collect())
        assert not self.seen - rows
        new, self.seen = rows - self.seen, rows
        self.rows = sorted(rows.elements())
        out = sorted(new.elements())
        return [r[2] for r in out]


def append(path, text):
    with open(path, "ab") as f:
        f.write(text if isinstance(text, bytes) else text.encode())


def test_appended_lines_arrive_once(spark, tmp_path):
    log = tmp_path / "logs"
    log.mkdir()
    append(log / "a.log", "one\ntwo\nthr")
    append(log / "b.log", "x\r\n\n")
    followed = Followed(spark, log, tmp_path / "at")
    assert sorted(followed.new()) == ["", "one", "two", "x"]
    assert followed.new() == []
    append(log / "a.log", "ee\nfour\n")
    append(log / "c.log", b"caf\xc3\xa9 \xff!\n")
    assert sorted(followed.new()) == ["café !", "four", "three"]
    append(log / "a.log", "no end yet")
    assert followed.new() == []
    append(log / "a.log", "\n")
    assert followed.new() == ["no end yet"]


def test_rotated_by_renaming(spark, tmp_path):
    log = tmp_path / "logs"
    log.mkdir()
    append(log / "a.log", "same head\n1\n")
    followed = Followed(spark, log, tmp_path / "at")
    assert followed.new() == ["same head", "1"]
    append(log / "a.log", "2\n")
    os.rename(log / "a.log", log / "a.log.1")
    append(log / "a.log", "same head\nnew 1\nnew 2\nnew 3\n")
    assert sorted(followed.new()) == ["2", "new 1", "new 2", "new 3", "same head"]
    os.rename(log / "a.log.1", log / "a.log.2")
    os.rename(log / "a.log", log / "a.log.1")
    append(log / "a.log.1", "late\n")
    append(log / "a.log", "third\n")
    assert sorted(followed.new()) == ["late", "third"]


def test_rotated_by_copying_and_truncating(spark, tmp_path):
    log = tmp_path / "logs"
    log.mkdir()
    append(log / "a.log", "1\n2\n")
    followed = Followed(spark, log, tmp_path / "at")
    assert followed.new() == ["1", "2"]
    append(log / "a.log", "3\n")
    (log / "a.log.1").write_bytes((log / "a.log").read_bytes())
    (log / "a.log").write_text("4\n")
    assert sorted(followed.new()) == ["3", "4"]


def test_a_copy_beside_its_original_is_a_file_of_its_own(spark, tmp_path):
    log = tmp_path / "logs"
    log.mkdir()
    append(log / "a.log", "1\n2\n")
    followed = Followed(spark, log, tmp_path / "at")
    followed.new()
    (log / "b.log").write_bytes((log / "a.log").read_bytes())
    assert followed.new() == ["1", "2"]


def test_from_the_end_and_patterns(spark, tmp_path):
    append(tmp_path / "a.log", "old\n")
    append(tmp_path / "a.txt", "other\n")
    followed = Followed(spark, tmp_path / "*.log", tmp_path / "at", from_end=True)
    assert followed.new() == []
    append(tmp_path / "a.log", "new\n")
    append(tmp_path / "b.log", "whole\n")
    assert sorted(followed.new()) == ["new", "whole"]


@pytest.mark.parametrize("split", [1, 3, 7, 64])
def test_splits_cut_anywhere(spark, tmp_path, split):
    texts = [f"{i}" * (i % 5) for i in range(40)]
    append(tmp_path / "a.log", "\n".join(texts) + "\n")
    followed = Followed(spark, tmp_path / "a.log", tmp_path / "at", split_bytes=split)
    followed.new()
    rows = sorted(followed.rows, key=lambda r: r[1])
    assert [r[2] for r in rows] == texts
    places = [sum(len(t) + 1 for t in texts[:i]) for i in range(40)]
    assert [r[1] for r in rows] == places


def test_lines_longer_than_a_chunk(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "CHUNK", 16)
    lines = [b"a" * 100, b"", b"b" * 15, b"c" * 16, b"d" * 17, b"e"]
    data = b"\n".join(lines) + b"\n" + b"f" * 50
    append(tmp_path / "x", data)
    files, path = tail.file_system(str(tmp_path / "x"))
    with files.open_input_file(path) as file:
        until = tail.last_break(file, len(data))
        assert until == len(data) - 50
        for size in (1, 10, 40, 1000):
            found = []
            for a in range(0, until, size):
                split = tail.Split(path, a == 0, a, min(a + size, until), until, tail.mark(file, until))
                found += [x for _, part in tail.lines_of_split(file, split) for x in part]
            assert found == lines


def test_lost_lines_fail_unless_allowed(tmp_path):
    path = tmp_path / "a.log"
    append(path, "1\n")
    reader = tail.TailReader({"path": str(path)})
    start = reader.latestOffset()
    append(path, "2\n")
    end = reader.latestOffset()
    path.write_text("other\n")
    with pytest.raises(RuntimeError):
        reader.partitions(start, end)
    assert tail.TailReader({"path": str(path), "failOnDataLoss": "false"}).partitions(start, end) == []
    # a replay finds them where they lie now
    path.write_text("1\n2\n")
    os.rename(path, tmp_path / "a.log.1")
    append(path, "3\n")
    whole = tail.TailReader({"path": str(tmp_path / "a.log*")})
    assert [(s.path.rsplit("/")[-1], s.start, s.end) for s in whole.partitions(start, end)] == [("a.log.1", 2, 4)]


@pytest.mark.parametrize("parts", [1, 4])
def test_tables_as_file_or_folder(spark, tmp_path, parts):
    df = spark.range(100).select("id", F.col("id").cast("string").alias("name"))
    df.repartition(parts).write.parquet(f"{tmp_path}/t.parquet")
    if parts == 1:
        part = next(p for p in os.listdir(tmp_path / "t.parquet") if p.endswith(".parquet") and p[0] == "p")
        os.rename(tmp_path / "t.parquet", tmp_path / "whole")
        os.link(tmp_path / "whole" / part, tmp_path / "t.parquet")
    df.limit(3).write.parquet(f"{tmp_path}/t2.parquet")
    stream = stream_table(spark, str(tmp_path), "t", df.schema)
    query = stream.writeStream.format("memory").queryName(f"tables{parts}").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table(f"tables{parts}").count() == 100


def test_a_missing_table_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        stream_table(spark, str(tmp_path), "none", spark.range(1).schema)
