"""Log readers, rule files, file manifest."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from ravenhunt.sources import logs as L
from ravenhunt.sources.files import file_manifest
from ravenhunt.sources.rules import decode_rule, read_rules


def _write(d, name, text):
    p = os.path.join(d, name)
    with open(p, "w") as f:
        f.write(text)
    return p


def test_csv_bad_and_short_lines(spark, tmp_dir):
    text = (
        "TimeCreated,ComputerName,UserName,ProcessName,EventID,SourceIpAddress,DestinationIpAddress,EventData,Action,Extra\n"
        "2024-01-01 00:00:00,H1,u,p.exe,1,,,m,a,x\n"
        "2024-01-01 00:00:01,H2,u,p.exe,2,,,m,a,x,TOO,MANY\n"
        "2024-01-01 00:00:02,H3\n"
        '2024-01-01 00:00:03,H4,u,p.exe,4.0,NA,,"a, quoted",a,x\n'
        "not a time,H5,u,p.exe,abc,,,m,a,x\n"
    )
    rows = {r.hostname: r for r in L.read_csv_logs(spark, _write(tmp_dir, "a.csv", text)).collect()}
    assert set(rows) == {"H1", "H3", "H4", "H5"}
    assert rows["H3"].username is None and rows["H4"].message == "a, quoted" and rows["H4"].event_id == 4
    assert rows["H4"].source_ip is None and rows["H5"].timestamp is None and rows["H5"].event_id is None
    assert L.read_csv_logs(spark, _write(tmp_dir, "b.csv", text), max_rows=2).count() == 2


def test_json_documents_and_lines(spark, tmp_dir):
    doc_list = [{"@timestamp": "2024-01-01 00:00:00", "host": "A", "event_id": 1, "src_ip": "1.1.1.1"},
                {"host": "B", "event_id": "2", "message": "m"}]
    p1 = _write(tmp_dir, "list.json", json.dumps(doc_list, indent=2))
    assert sorted(r.hostname for r in L.read_logs(spark, p1).collect()) == ["A", "B"]
    p2 = _write(tmp_dir, "one.json", json.dumps({"host": "C", "event_id": 3}, indent=2))
    assert [r.hostname for r in L.read_logs(spark, p2).collect()] == ["C"]
    p3 = _write(tmp_dir, "l.jsonl", '{"host": "D", "event_id": 4}\n{"host": \n\n{"host": "E", "user": "u"}\n')
    rows = L.read_logs(spark, p3).collect()
    assert sorted(r.hostname for r in rows) == ["D", "E"] and all(r.action is None for r in rows)


def test_unsupported_extension(tmp_dir, spark):
    import pytest

    with pytest.raises(ValueError):
        L.read_logs(spark, _write(tmp_dir, "x.log", "a"))


def test_csv_goes_by_each_files_header(spark, tmp_dir):
    d = os.path.join(tmp_dir, "two")
    os.makedirs(d)
    _write(d, "a.csv", "TimeCreated,ComputerName,UserName\n2024-01-01 00:00:00,H1,u1\n")
    _write(d, "b.csv", "UserName,Extra,ComputerName\nu2,x,H2\nu3,x,H3,too,long\n")
    _write(d, "empty.csv", "")
    rows = {r.hostname: r for r in L.read_csv_logs(spark, d).collect()}
    assert set(rows) == {"H1", "H2"} and rows["H2"].username == "u2" and rows["H2"].timestamp is None
    assert str(rows["H1"].timestamp) == "2024-01-01 00:00:00"
    stream = L.read_log_stream(spark, d).writeStream.format("memory").queryName("by_header").trigger(availableNow=True).start()
    stream.awaitTermination()
    assert {(r.hostname, r.username) for r in spark.table("by_header").collect()} == {("H1", "u1"), ("H2", "u2")}


def test_quoted_line_breaks(spark, tmp_dir):
    p = _write(tmp_dir, "q.csv", 'ComputerName,EventData\nH1,"one\ntwo ""x"", three"\nH2,plain\n')
    with pytest.warns(UserWarning, match="1 CSV files"):
        rows = {r.hostname: r.message for r in L.read_csv_logs(spark, p).collect()}
    assert rows == {"H1": 'one\ntwo "x", three', "H2": "plain"}
    whole = spark.read.text(p, wholetext=True)
    assert sorted(tuple(r) for r in L.csv_rows(whole, ["ComputerName", "EventData"]).collect()) == sorted(rows.items())


def test_json_documents_in_a_folder(spark, tmp_dir):
    d = os.path.join(tmp_dir, "docs")
    os.makedirs(d)
    _write(d, "a.json", json.dumps([{"host": "A"}, {"host": "B"}], indent=2))
    _write(d, "b.json", '{"host": "C"}\n{"host": "D"}\n')
    assert sorted(r.hostname for r in L.read_logs(spark, d).collect()) == ["A", "B", "C", "D"]


def test_mixed_directory(spark, tmp_dir):
    d = os.path.join(tmp_dir, "mixed")
    os.makedirs(d)
    _write(d, "a.csv", "TimeCreated,ComputerName\n2024-01-01 00:00:00,CSV1\n")
    _write(d, "b.jsonl", '{"host": "J1"}\n')
    _write(d, "c.json", '[{"host": "J2"}, {"host": "J3"}]\n')
    _write(d, "ignored.txt", "x")
    assert sorted(r.hostname for r in L.read_logs(spark, d).collect()) == ["CSV1", "J1", "J2", "J3"]


RULE_YAML = """title: T
id: r1
detection:
  selection:
    Image|contains|all: ['*power*', 'x']
    EventID: 4104
    CommandLine: '*'
  condition: selection
tags: [attack.t1059.001]
---
title: Keywords
id: r2
detection:
  keywords: [a, b]
  condition: keywords
---
title: Broken
id: r3
detection: [oops
"""


def test_rule_files(spark, tmp_dir):
    d = os.path.join(tmp_dir, "rules")
    os.makedirs(d)
    _write(d, "multi.yml", RULE_YAML.split("---\ntitle: Broken")[0])
    _write(d, "bad.yaml", "title: [unclosed\n")
    _write(d, "skip.txt", "title: not a rule")
    rows = {r.id: r for r in read_rules(spark, d).collect()}
    r1 = rows["r1"]
    items = {i.field: (i.op, list(i.values)) for i in r1.selections[0].items}
    assert items == {"Image": ("contains", ["power", "x"]), "EventID": ("equals", ["4104"]), "CommandLine": ("equals", [""])}
    assert r1.level is None and r1.error is None
    assert "keyword" in rows["r2"].error
    assert [r for r in rows.values() if r.id is None][0].error.startswith("yaml")
    assert len(rows) == 3


def test_rule_file_is_not_held_as_objects(spark, tmp_dir, monkeypatch):
    import tracemalloc

    from ravenhunt.sources import rules

    monkeypatch.setattr(rules, "DECODED_AT_ONCE", 50)
    one = "title: T%d\nid: r%d\nlogsource: {product: w}\ndetection:\n  s: {Image|contains: [a, b], action: x}\n  condition: s\n"
    text = "---\n".join(one % (i, i) for i in range(1500))
    tracemalloc.start()
    held = rules._decoded_file(text, "p")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * len(text) and sum(b.num_rows for b in held) == 1500
    assert held[1].num_rows == 50 and held[-1].num_rows == 0
    bad = rules._decoded_file(text + "---\ntitle: [open\n", "p")
    assert [r["error"] for b in bad for r in b.to_pylist()] == ["yaml: ParserError"]
    path = _write(tmp_dir, "many.yml", text)
    rows = read_rules(spark, path).collect()
    assert sorted(r.id for r in rows) == sorted(f"r{i}" for i in range(1500)) and rows[0].logsource == {"product": "w"}


def test_decode_rule_list_of_maps_left_undefined():
    r = decode_rule({"id": "x", "detection": {"sel": [{"a": 1}, {"b": 2}], "condition": "sel"}})
    assert r["selections"] == [] and r["error"] is None


def test_file_manifest(spark, tmp_dir):
    p = _write(tmp_dir, "f.csv", "abc\n")
    _write(tmp_dir, "g.exe", "zz")
    rows = {os.path.basename(r.path): r for r in file_manifest(spark, tmp_dir).collect()}
    assert rows["f.csv"].sha256 == hashlib.sha256(b"abc\n").hexdigest() and rows["f.csv"].extension_allowed
    assert not rows["g.exe"].extension_allowed and rows["f.csv"].length == 4
    small = {os.path.basename(r.path): r for r in file_manifest(spark, tmp_dir, max_bytes=3).collect()}
    assert small["f.csv"].sha256 is None and small["g.exe"].sha256 is not None and small["f.csv"].size_ok
    del p


def test_numbers_of_a_json_document_do_not_open_it_again(spark, tmp_dir):
    rows = [{"host": f"H{i}", "event_id": i, "message": 1.5} for i in range(5000)]
    p = _write(tmp_dir, "n.json", json.dumps(rows, indent=1).replace("1.5", "1.50"))

    def read_bytes():
        return sum(s.getBytesRead() for s in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())

    before = read_bytes()
    found = L.read_json_logs(spark, p).collect()
    assert read_bytes() - before < 3 * os.path.getsize(p)
    assert sorted((r.event_id, r.hostname, r.message) for r in found) == [(i, f"H{i}", "1.50") for i in range(5000)]


def test_json_documents_beyond_one_record(spark, tmp_dir, monkeypatch):
    _write(tmp_dir, "s.json", '{"host": "S"}')
    _write(tmp_dir, "l.json", json.dumps([{"host": "L", "event_id": 7}, {"host": "M"}], indent=2))
    monkeypatch.setattr("ravenhunt.sources.files.ONE_RECORD", 20)
    assert sorted((r.hostname, r.event_id or 0) for r in L.read_json_logs(spark, tmp_dir).collect()) == [("L", 7), ("M", 0), ("S", 0)]


def test_kinds_of_files_are_given_as_folders(spark, tmp_dir):
    for name in ("p/x/1.json", "p/x/y/2.json", "p/l/3.json", "p/m/4.json", "p/m/5.json"):
        os.makedirs(os.path.dirname(os.path.join(tmp_dir, name)), exist_ok=True)
        host = os.path.basename(name)[0]
        _write(tmp_dir, name, json.dumps({"host": host}, indent=2 if host in "125" else None))
    lines = L._first_lines(spark, tmp_dir, ".json").withColumn("document", F.col("line") == "{")
    found = {k: {p.split(os.path.basename(tmp_dir) + "/")[1] for p in paths} for k, paths in L._file_groups(lines, tmp_dir, "document")}
    assert found == {True: {"p/x", "p/m/5.json"}, False: {"p/l", "p/m/4.json"}}
    assert sorted(r.hostname for r in L.read_logs(spark, tmp_dir).collect()) == list("12345")
    pattern = {p.rsplit("/")[-1] for _, paths in L._file_groups(lines, tmp_dir + "/*", "document") for p in paths}
    assert pattern == {f"{i}.json" for i in range(1, 6)}


def test_many_small_files_are_written_by_the_tasks(spark, tmp_dir):
    from ravenhunt.plans.catalog_io import _write_files

    rows = spark.createDataFrame([("k=1", "a"), ("k=2", None), ("k=2", "\u00e9"), ("k=3", "c")], "name string, value string")
    rows = rows.repartition(2, "name").sortWithinPartitions("name")
    assert _write_files(rows, "file:" + os.path.join(tmp_dir, "w x").replace(" ", "%20"), ".txt")
    found = {os.path.basename(r.path): r.content for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(tmp_dir).collect()}
    assert found["k=1.txt"] == b"a\n" and found["k=3.txt"] == b"c\n" and sorted(found["k=2.txt"].decode().split("\n")) == ["", "", "\u00e9"]
    assert len(found) == 3 and not _write_files(rows, "hdfs://x/y", ".txt")
