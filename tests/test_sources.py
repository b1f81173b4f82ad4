import json

from pyspark.sql import functions as F

from sievelog.operators.context import entry_index
from sievelog.operators.evaluate import binary_metrics, confusion_matrix
from sievelog.sources import readers, writers

LABELLED = [
    {"message": "ok", "raw_log": "[INFO] ok", "is_anomaly": False, "timestamp": "t"},
    {"message": 'bad "x",\n y', "raw_log": "r", "is_anomaly": True, "timestamp": "t"},
    {"message": " padded ", "raw_log": "r", "timestamp": "t"},
]


def test_lines_keep_their_order_across_splits(spark, tmp_path):
    n = 20_000
    (tmp_path / "big.log").write_text("".join(f"line {i}\n" for i in range(n)))
    (tmp_path / "small.log").write_text("x\r\ny\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
        spark.conf.set("spark.sql.files.openCostInBytes", "1000")
        lines = readers.read_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 2
        rows = entry_index(lines, rows_per_cell=1000).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    big = sorted((r["entry_index"], r["value"]) for r in rows if r["file"].endswith("big.log"))
    assert big == [(i, f"line {i}") for i in range(n)]
    small = sorted((r["entry_index"], r["value"]) for r in rows if r["file"].endswith("small.log"))
    assert small == [(0, "x"), (1, "y")]


def test_undecodable_bytes_are_dropped(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"caf\xe9 ok\n" + "kept � é\n".encode())
    values = [r["value"] for r in readers.read_lines(spark, str(tmp_path)).orderBy("line_no").collect()]
    assert values == ["caf ok", "kept � é"]


def test_mixed_file(spark, tmp_path):
    (tmp_path / "a.log").write_text(
        "\n".join(
            [
                r'1.2.3.4 - - \[04/Sep/2025:22:15:00 +0530] "GET /x HTTP/1.1" 200 523 "-" "agent"',
                "",
                r"Sep 04 22:19:00 web01 sshd\[2001]: Failed password for root from 203.0.113.55",
                r'{"ts": "2025-09-04T22:22:00+05:30", "event": "network\_connection"}',
                "2025-09-04 22:25:00 fw01 action=ALLOW",
            ]
        )
    )
    rows = readers.read_logs(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [r["format"] for r in rows] == ["generic", "syslog", "generic"]
    assert rows[1]["source"] == "web01"


def test_labelled_json_array(spark, tmp_path):
    path = tmp_path / "data.json"
    path.write_text(json.dumps(LABELLED, indent=2))
    rows = readers.read_training(spark, str(path)).collect()
    assert [(r["message"], r["is_anomaly"]) for r in rows] == [(d["message"], d.get("is_anomaly", False)) for d in LABELLED]


def test_labelled_csv(spark, tmp_path):
    df = spark.createDataFrame([(d["message"], d.get("is_anomaly", False)) for d in LABELLED], "message string, is_anomaly boolean")
    writers.write_csv(df, str(tmp_path / "a.csv"))
    rows = readers.read_training(spark, str(tmp_path / "a.csv")).collect()
    assert sorted(map(tuple, rows)) == sorted((d["message"], d.get("is_anomaly", False)) for d in LABELLED)
    writers.write_csv(df.select("message"), str(tmp_path / "b.csv"))
    assert readers.read_training(spark, str(tmp_path / "b.csv")).where("is_anomaly").count() == 0
    writers.write_csv(df.withColumn("is_anomaly", F.col("is_anomaly").cast("int")), str(tmp_path / "c.csv"))
    assert readers.read_training(spark, str(tmp_path / "c.csv")).where("is_anomaly").count() == 1


def test_raw_training_rows_are_normal(spark, tmp_path):
    (tmp_path / "raw.txt").write_text("2024-01-01 10:00:00 [ERROR] x boom\nfree\n")
    rows = readers.read_training(spark, str(tmp_path / "raw.txt")).collect()
    assert [(r["message"], r["is_anomaly"]) for r in rows] == [("boom", False), ("free", False)]


def test_metrics_report(spark, tmp_path):
    df = spark.createDataFrame([(1, 1), (0, 1)], "label int, prediction int")
    path = str(tmp_path / "metrics")
    writers.write_metrics({"metrics": binary_metrics(df), "confusion": confusion_matrix(df)}, path)
    rows = spark.read.json(path).collect()
    assert sorted(r["section"] for r in rows) == ["confusion", "confusion", "metrics"]


def test_outbox_replay_replaces(spark, tmp_path):
    df = spark.createDataFrame([("a", "slack", "p")], "alert_id string, channel string, payload string").withColumn("ts", F.current_timestamp())
    for _ in range(2):
        writers.append_outbox(df, str(tmp_path / "o"), 0)
    writers.append_outbox(df, str(tmp_path / "o"), 1)
    assert writers.read_outbox(spark, str(tmp_path / "o")).count() == 2
