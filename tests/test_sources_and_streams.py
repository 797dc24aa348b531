import json

from pyspark.sql import functions as F

from flowlens import schema as S
from flowlens.fixtures import view
from flowlens.operators import anchored, profiles
from flowlens.sources import envelope, zeek
from flowlens.streaming import state
from flowlens.streaming.run import parse_lines, start

CONN = ["1.5", "C1", "10.0.0.1", "1000", "10.0.0.2", "80", "tcp", "http", "0.25", "7", "9", "SF", "T", "F", "0", "Dd", "1", "2", "3", "4", "-"]


def write(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_format_dispatch(spark, tmp_path):
    tab = "\t".join
    shapes = {
        "plain": ["#fields", tab(CONN)], "ip_proto": [tab([*CONN, "6"])], "labelled": [tab([*CONN, "benign", "-"])],
        "json": [json.dumps(dict(zip(S.CONN_FIELDS, CONN)))],
    }
    for name, lines in shapes.items():
        row = zeek.typed(zeek.read_conn(spark, write(tmp_path / f"{name}.log", lines)), "conn").first()
        assert (row["uid"], row["resp_p"], row["duration"], row["local_orig"], row["ts_us"]) == ("C1", 80, 0.25, True, 1_500_000), name
        assert "ip_proto" not in row.asDict()
    assert zeek.read_conn(spark, str(tmp_path / "labelled.log")).first()["label"] == "benign"
    csv = write(tmp_path / "c.csv", ["ts,uid,resp_p", "1.5,C9,443"])
    row = zeek.read_conn(spark, csv).first()
    assert (row["uid"], row["proto"], row["tunnel_parents"]) == ("C9", "unknown", "none")


def test_malformed_and_header(spark, tmp_path):
    path = write(tmp_path / "d.log", ["#fields\tts\tuid\tquery", "1\tD1\ta.b", "2\tD2", "3\tD3\t-"])
    rows = zeek.read_zeek_tsv(spark, path, "dns", header=True).orderBy("uid").collect()
    assert [(r["uid"], r["query"]) for r in rows] == [("D1", "a.b"), ("D3", None)]
    other = write(tmp_path / "e.log", ["#fields\tts\tuid\tquery\trcode_name", "4\tD4\tc.d\tNXDOMAIN"])
    both = zeek.read_dns(spark, [path, other])
    assert both.count() == 3 and both.filter("rcode_name is not null").count() == 1


def test_every_file_has_its_own_layout(spark, tmp_path):
    tab = "\t".join
    folder = tmp_path / "logs"
    folder.mkdir()
    write(folder / "a.log", ["#separator x", "#fields\tts\tuid\tquery", "1\tD1\ta.b", "1\tD1b", ""])
    write(folder / "b.log", ["#fields\tquery\trcode_name\tuid\tts", "c.d\t-\tD2\t2"])
    write(folder / "c.log", ["#fields\tuid\tid.orig_h\tTTLs", "D3\t10.0.0.9\t5,6"])
    write(folder / "d.log", ["#only a comment"])
    rows = {r["uid"]: r for r in zeek.read_dns(spark, [str(folder / "*.log")]).collect()}
    assert set(rows) == {"D1", "D2", "D3"}
    assert (rows["D1"]["query"], rows["D2"]["query"], rows["D2"]["ts"], rows["D2"]["rcode_name"]) == ("a.b", "c.d", "2", None)
    assert (rows["D3"]["orig_h"], rows["D3"]["TTLs"], rows["D3"]["query"]) == ("10.0.0.9", "5,6", None)
    mixed = tmp_path / "conn"
    mixed.mkdir()
    write(mixed / "a.log", [tab(CONN)])
    write(mixed / "b.log", [tab(["2", "C2", *CONN[2:], "evil", "why"]), tab(CONN)])
    write(mixed / "c.csv", ["ts,uid,label,detailed-label", '3,C3,"a,b",-', "4,C4,good,x"])
    write(mixed / "d.json", [json.dumps({"ts": 5, "uid": "C5", "id.resp_p": 9, "label": "jl"}), "{broken"])
    write(mixed / "e.log", [tab(["6", "C6", *CONN[2:], "1", "2", "3", "4"])])
    rows = {r["uid"]: r for r in zeek.read_conn(spark, str(mixed)).collect()}
    assert {u: r["label"] for u, r in rows.items()} == {"C1": None, "C2": "evil", "C3": "a,b", "C4": "good", "C5": "jl", "C6": "1"}
    assert (rows["C4"]["detailed_label"], rows["C3"]["detailed_label"], rows["C5"]["resp_p"], rows["C3"]["proto"], rows["C6"]["resp_p"]) == ("x", None, "9", "unknown", "80")
    import pytest
    with pytest.raises(ValueError):
        zeek.read_dns(spark, [str(folder / "d.log")])


def test_ragged_lines(spark):
    lines = spark.createDataFrame([("1\tC1\t10.0.0.1",), ("\t".join([*CONN, "x", "y"]),), ("#c",), ("  ",)], "value string")
    rows = {r["uid"]: r for r in zeek.split_lines(lines, "conn").collect()}
    assert set(rows) == {"C1"} or len(rows) == 1
    assert zeek.split_lines(lines, "conn").count() == 2


def test_envelopes(spark):
    good = {"ts": 1.5, "uid": "C1", "id.resp_p": 80, "local_orig": True, "duration": None, "missed_bytes": "x"}
    lines = [json.dumps({"message": json.dumps(m)}) for m in (good, {**good, "uid": ""})] + ["not json"]
    rows = envelope.unwrap_conn(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r["ts"], r["resp_p"], r["local_orig"], r["duration"], r["missed_bytes"]) for r in rows] == [("1.5", "80", "T", "0", "0")]
    dns = {"ts": 2, "uid": "D1", "query": "q.x", "answers": ["1.1.1.1", "2.2.2.2"], "TTLs": [60.0, 30.0]}
    row = envelope.unwrap_dns(spark.createDataFrame([(json.dumps({"message": json.dumps(dns)}),)], "value string")).first()
    assert (row["answers"], row["TTLs"]) == ("1.1.1.1,2.2.2.2", "60.0,30.0")


def split_files(spark, df, path, parts=4):
    """Time slices of a table as parquet files, oldest first."""
    rows = df.orderBy("ts_us", "uid").collect()
    step = len(rows) // parts + 1
    for i in range(parts):
        spark.createDataFrame(rows[i * step:(i + 1) * step], df.schema).coalesce(1).write.mode("append").parquet(f"{path}/{i}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def collect_stream(df, name, path, spark):
    query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(path)).trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination(120)
    return spark.sql(f"select * from {name}")


def test_stream_profile_equals_batch(spark, sf_dir, tmp_path):
    conn = view(spark, sf_dir, "conn").select("ts_us", "uid", "orig_h", "resp_p", "resp_h", "conn_state", "duration", "orig_bytes")
    stream = state.event_time(split_files(spark, conn, tmp_path / "in"), "8 hours")
    got = collect_stream(state.sliding_rate(stream, window_us=300_000_000), "rates", tmp_path / "ck", spark)
    want = profiles.ip_profile(conn, window_us=300_000_000).select("uid", "ip_profile_uid_rate")
    late = {r["uid"]: r["ip_profile_uid_rate"] for r in got.collect()}
    assert late == {r["uid"]: r["ip_profile_uid_rate"] for r in want.collect()}


def test_stream_windows_equal_batch(spark, sf_dir, tmp_path):
    alerts = view(spark, sf_dir, "alerts").select("ts_us", "src_ip", F.col("alert_id").alias("uid"))
    stream = state.event_time(split_files(spark, alerts, tmp_path / "in"), "8 hours")
    got = collect_stream(state.stream_windows(stream, span_us=300_000_001, id_column="uid"), "wins", tmp_path / "ck", spark)
    want = anchored.anchor_windows(alerts, ["src_ip"], span_us=300_000_001)
    assert {(r["uid"], r["start_us"]) for r in got.collect()} == {(r["uid"], r["start_us"]) for r in want.collect()}


def test_stream_of_lines_catches_up(spark, tmp_path):
    source = tmp_path / "lines"
    source.mkdir()
    for i in range(3):
        write(source / f"{i}.log", ["#h", "\t".join([str(i), f"C{i}", *CONN[2:]]), ""])
    seen = []
    rows = parse_lines(zeek.stream_lines(spark, str(source), max_files=1), "conn")
    query = start(rows, lambda df, n: seen.extend(r["uid"] for r in df.select("uid").collect()), str(tmp_path / "ck"))
    query.awaitTermination(60)
    assert sorted(seen) == ["C0", "C1", "C2"]


def test_envelopes_are_read_once(spark):
    message = '{"ts": 1.5, "uid": "a", "id.orig_h": "h", "duration": "x"}'
    lines = [(1, json.dumps({"message": m})) for m in (message, '{"ts": 1.5}', '{"ts": 1.5, "uid": ""}', '{"uid": "b"}', "no json")] + [(2, "broken"), (3, None)]
    opened = envelope.unwrap_conn(spark.createDataFrame(lines, "n int, value string").withColumn("value", F.concat("value", F.lit(""))))
    assert opened._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    assert [(r["n"], r["ts"], r["uid"], r["orig_h"], r["duration"]) for r in opened.collect()] == [(1, "1.5", "a", "h", "0")]
