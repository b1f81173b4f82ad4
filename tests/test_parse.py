import datetime as dt

from pyspark.sql import functions as F

from sievelog.functions.timestamps import parse_timestamp
from sievelog.operators.parse import COMBINED, detect_format, parse_logs, parse_rejects, strip

STAMP = "2020-02-03 04:05:06"


def _parse(spark, lines, **options):
    df = spark.createDataFrame(list(enumerate(lines)), "i int, value string")
    rows = parse_logs(df, ingest_ts=F.lit(STAMP).cast("timestamp"), **options).collect()
    return {r["i"]: r for r in rows}


GOLDEN = [
    ("2024-03-07 08:15:00 [INFO] Session s-17 opened at desk 4",
     ("application", "INFO", "Session", "s-17 opened at desk 4")),
    ("2024-03-07 08:16:00 [ERROR] Gate 10.9.8.7 stays shut - wrong badge",
     ("application", "ERROR", "Gate", "10.9.8.7 stays shut - wrong badge")),
    ("2024-01-15 10:00:35 [WARNING] High memory", ("application", "WARN", "ING]", "High memory")),
    ("2024-01-15 10:00:00,123 ERROR [main] com.App - boom", ("application", "ERROR", "com.App", "boom")),
    ('{"timestamp": "2024-03-07T08:15:00Z", "level": "error", "message": "disk is full", "service": "store"}',
     ("json", "ERROR", "store", "disk is full")),
    ('10.4.3.2 - - [07/Mar/2024:08:15:00 +0000] "GET /map.html HTTP/1.1" 200 77',
     ("apache", "INFO", "apache", "GET /map.html HTTP/1.1 - 200")),
    ("Sep 04 22:19:00 web01 sshd[2001]: Failed password for root",
     ("syslog", "INFO", "web01", "Failed password for root")),
    ("  invalid log line\t", ("generic", "INFO", "unknown", "invalid log line")),
    ("2024-01-15 10:00:00 INFO", ("application", "INFO", None, "")),
    ("2024-01-15 10:00:00 [DEBUG]x: y", ("application", "DEBUG", "x:", "y")),
    ("{}", ("json", "INFO", "unknown", "{}")),
    ('{"message":"a","msg":"b","severity":"warn","logger":"l"}', ("json", "WARN", "l", "a")),
    ('{"message":null,"msg":"b"}', ("json", "INFO", "unknown", None)),
    ('{"level":"info","level":"warn","msg":5}', ("json", "WARN", "unknown", "5")),
    (" Jan 5 1:02:03 h p: m 　", ("syslog", "INFO", "h", "m")),
]


def test_golden_lines(spark):
    rows = _parse(spark, [line for line, _ in GOLDEN])
    for i, (line, expected) in enumerate(GOLDEN):
        r = rows[i]
        assert (r["format"], r["level"], r["source"], r["message"]) == expected, line
        assert r["raw_log"] == line


def test_batch_keeps_free_text_and_drops_blank(spark):
    lines = ["2024-01-01 10:00:00 [INFO] Normal log entry", "2024-01-01 10:00:01 [ERROR] Error occurred",
             "invalid log line", "", " \t "]
    assert sorted(_parse(spark, lines)) == [0, 1, 2]


def test_rejects_and_reasons(spark):
    lines = ['{"timestamp": broken}', '{"level":5}', '{"level":null}', '{"time":12}', '{"a":1} {"b":2}',
             '{"a":1},{"b":2}', "{'a':1}", '{"time":0}', '{"timestamp":""}', "fine", ""]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, value string")
    found = {r["i"]: r["reason"] for r in parse_rejects(df).collect()}
    assert found == {
        0: "malformed_json", 1: "json_level_not_text", 2: "json_level_not_text", 3: "json_time_not_text",
        4: "malformed_json", 5: "malformed_json", 6: "malformed_json",
    }
    assert sorted(_parse(spark, lines)) == [7, 8, 9]


def test_times(spark):
    rows = _parse(
        spark,
        [
            '1.2.3.4 - - [15/Jan/2024:10:00:00 +0530] "GET / HTTP/1.1" 200 -',
            "Sep  4 22:19:00 web01 cron: x",
            '{"timestamp":"soon"}',
            '{"msg":"no time"}',
            "free text",
            "2024-02-30 10:00:00 [INFO] a b",
        ],
    )
    assert rows[0]["ts_wall"] == dt.datetime(2024, 1, 15, 10, 0)
    assert rows[0]["ts"] == rows[4]["ts"].__class__(2024, 1, 15, 4, 30)
    assert rows[1]["ts_wall"] == dt.datetime(1900, 9, 4, 22, 19)
    assert rows[2]["ts"] is None and rows[2]["ts_wall"] is None
    for i in (3, 4, 5):
        assert rows[i]["ts_wall"] == dt.datetime(2020, 2, 3, 4, 5, 6)


def test_default_year(spark):
    assert _parse(spark, ["Feb 29 01:00:00 h p: m"], default_year=2024)[0]["ts_wall"].year == 2024


def test_timestamp_shapes(spark):
    texts = {
        "2024-01-05 01:02:03": "2024-01-05 01:02:03",
        "2024-1-5 1:2:3": "2024-01-05 01:02:03",
        "2024-01-05 01:02:03,5": "2024-01-05 01:02:03.500000",
        "2024-01-05T01:02:03.000001Z": "2024-01-05 01:02:03.000001",
        "05/jan/2024:01:02:03 -0100": "2024-01-05 01:02:03",
        "Jan 5, 2024 01:02:03": "2024-01-05 01:02:03",
        "01/05/2024 01:02:03": "2024-01-05 01:02:03",
        "2024/01/05 01:02:03": "2024-01-05 01:02:03",
        "2024-01-05": "2024-01-05 00:00:00",
        "xan 05 01:02:03": None,
        "nonsense": None,
        "2024-13-05 01:02:03": None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found = {r["text"]: r["ts_wall"] for r in parse_timestamp(df, "text").collect()}
    for text, expected in texts.items():
        assert (str(found[text]) if found[text] else None) == expected, text


def test_strict_levels_and_combined(spark):
    combined = '1.2.3.4 - bob [15/Jan/2024:10:00:00 +0000] "GET /a HTTP/1.1" 200 5 "http://r/" "Agent (x) 1.0"'
    plain = _parse(spark, ["2024-01-15 10:00:35 [WARNING] High memory", combined])
    assert plain[1]["format"] == "apache"
    opted = _parse(
        spark, ["2024-01-15 10:00:35 [WARNING] High memory", combined], strict_levels=True, combined=True
    )
    assert (opted[0]["level"], opted[0]["source"]) == ("WARNING", "High")
    assert opted[1]["format"] == "nginx"
    assert '"referer":"http://r/","user_agent":"Agent (x) 1.0"' in opted[1]["metadata"]
    assert COMBINED


def test_detect_order(spark):
    df = spark.createDataFrame([("a: b",), ("[x] {1}",), ("{a}",)], "value string")
    found = [r[0] for r in df.select(detect_format(strip(F.col("value")))).collect()]
    assert found == [None, None, "json"]


def test_parse_plan_reads_each_line_once(spark):
    df = spark.createDataFrame([("x",)], "value string")
    plan = parse_logs(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1 and "Filter" not in plan
