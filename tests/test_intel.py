"""IOC validation, feed parsing, bundle scan, lookups and feed tables."""

import json
import os

import pytest
from pyspark.sql import functions as F

from ravenhunt.functions.validate import url_is_safe, valid_ioc
from ravenhunt.operators import intel
from ravenhunt.operators.hunt import first_technique
from ravenhunt.sources import intel as src
from tests import fixtures as fx

NOW = "2024-02-01T00:00:00"


@pytest.mark.parametrize(
    "value,ioc_type,ok",
    [
        ("192.168.1.1", "ip", True),
        ("example.com", "domain", True),
        ("999.999.999.999", "ip", False),
        ("", "ip", False),
        ("001.002.003.255", "ip", True),
        ("abc", "domain", True),
        ("http://x.example.com/a", "domain", False),
        ("1.2.3", "ip", False),
        ("1.2.3.4\n", "ip", False),
        ("ab", "mixed", False),
        ("whatever", "mixed", True),
        ("d41d8cd98f00b204e9800998ecf8427e", "md5", True),
        ("d41d8cd98f00b204e9800998ecf8427", "md5", False),
        ("https://x", "url", True),
        ("HTTPS://x", "url", False),
    ],
)
def test_valid_ioc(spark, value, ioc_type, ok):
    df = spark.createDataFrame([(value, ioc_type)], "v string, t string")
    assert df.select(valid_ioc(F.col("v"), F.col("t")).alias("x")).first().x is ok


@pytest.mark.parametrize(
    "url,ok",
    [
        ("https://feeds.example/x", True),
        ("http://feeds.example/x", False),
        ("https://localhost/x", False),
        ("https://host10.example/x", False),
        ("https://user@192.168.0.1:8443/f", False),
        ("HTTPS://ok.example", True),
    ],
)
def test_url_safety(spark, url, ok):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(url_is_safe(F.col("u")).alias("x")).first().x is ok


def _write(tmp_dir, name, text):
    path = os.path.join(tmp_dir, name)
    with open(path, "w") as f:
        f.write(text)
    return path


def test_text_feed(spark, tmp_dir):
    p = _write(tmp_dir, "f.txt", "# comment\n// other\n\n  1.2.3.4  extra col\n999.1.1.1\n10.0.0.1\tx\n")
    got = [r.value for r in src.read_text_feed(spark, p, "ips", "ip", NOW).collect()]
    assert sorted(got) == ["1.2.3.4", "10.0.0.1"]


@pytest.mark.parametrize(
    "doc,values",
    [
        ([{"value": "1.2.3.4", "type": "ip"}, 5, {"ip": "5.6.7.8"}], {"1.2.3.4", "5.6.7.8"}),
        ({"data": [{"indicator": "evil.example"}]}, {"evil.example"}),
        ({"iocs": [{"url": "https://x.example/a"}]}, {"https://x.example/a"}),
        ({"data": {"iocs": [{"hash": "abcd"}]}}, {"abcd"}),
        ({"data": None, "iocs": [{"value": "zzz"}]}, set()),
        ({"other": [{"value": "zzz"}]}, set()),
        ([{"value": None, "url": "https://y"}], set()),
    ],
)
def test_json_feed_shapes(spark, tmp_dir, doc, values):
    p = _write(tmp_dir, "feed.json", json.dumps(doc))
    got = {r.value for r in src.read_json_feed(spark, p, "f", "mixed", NOW).collect()}
    assert got == values


def test_json_feed_defaults(spark, tmp_dir):
    p = _write(tmp_dir, "feed.json", json.dumps([{"ip": "1.2.3.4", "tags": ["a", "b"]}]))
    r = src.read_json_feed(spark, p, "f", "ip", NOW).first()
    assert (r.type, r.source, r.confidence, r.timestamp, r.description) == ("ip", "unknown", "medium", NOW, "")
    assert list(r.tags) == ["a", "b"]


def test_attack_bundle(spark, tmp_dir):
    p = _write(tmp_dir, "bundle.json", json.dumps(fx.TECHNIQUE_BUNDLE))
    t = src.read_attack_bundle(spark, p)
    rows = sorted((r.technique_id, r.name) for r in t.collect())
    assert rows == [("T2000", "Two Refs"), ("T7001", "Duplicate Later"), ("T7001", "Firmware Swap")]
    first = {r.technique_id: r.name for r in first_technique(t).collect()}
    assert first == {"T7001": "Firmware Swap", "T2000": "Two Refs"}
    assert t.where("technique_id = 'T7001'").first().url == "https://attack.mitre.org/techniques/T7001"


def test_cache_envelope_and_missing(spark, tmp_dir):
    env = {"timestamp": NOW, "count": 1, "iocs": [{"value": "1.2.3.4", "type": "ip", "source": "s",
                                                  "timestamp": NOW, "confidence": "high"}]}
    p = _write(tmp_dir, "c.json", json.dumps(env))
    assert [r.value for r in src.read_ioc_cache(spark, p, "feed").collect()] == ["1.2.3.4"]
    assert src.read_ioc_cache(spark, os.path.join(tmp_dir, "missing.json")).count() == 0


def test_feed_config_defaults(spark, tmp_dir):
    assert [r.name for r in src.read_feed_config(spark, os.path.join(tmp_dir, "none.json")).collect()] == [
        "feodotracker_ips", "malware_domains", "threatfox_iocs"]
    cfg = {"ioc_feeds": [{"name": "a", "url": "https://a", "feed_type": "ip", "update_interval": 1},
                         {"name": "b", "url": "https://b", "feed_type": "domain", "update_interval": 2, "enabled": False}]}
    p = _write(tmp_dir, "cfg.json", json.dumps(cfg))
    got = {r.name: r.enabled for r in src.read_feed_config(spark, p).collect()}
    assert got == {"a": True, "b": False}


def test_lookups(spark):
    iocs = spark.createDataFrame(
        [("Evil.Example", "domain", "s", "f1"), ("evil.example", "domain", "s", "f2"), ("1.2.3.4", "ip", "s", "f1")],
        "value string, type string, source string, feed string",
    )
    vals = spark.createDataFrame([("EVIL.example",), ("nothing",), ("1.2.3.4",)], "value string")
    pairs = intel.ioc_lookup(vals, iocs).collect()
    assert sorted((r.indicator, r.feed) for r in pairs) == [("1.2.3.4", "f1"), ("EVIL.example", "f1"), ("EVIL.example", "f2")]
    bulk = {r.indicator: (r.match_count, r.feeds) for r in intel.ioc_bulk_lookup(vals, iocs).collect()}
    assert bulk == {"EVIL.example": (2, "f1,f2"), "1.2.3.4": (1, "f1")}
    exact = intel.ioc_lookup(vals, iocs, case_sensitive=True).collect()
    assert [r.indicator for r in exact] == ["1.2.3.4"]
    logs = spark.createDataFrame([(1, None, "h", "1.2.3.4", "9.9.9.9"), (2, None, "h", "8.8.8.8", "1.2.3.4")],
                                 "event_id long, timestamp timestamp, hostname string, source_ip string, destination_ip string")
    m = sorted((r.event_id, r.matched_field) for r in intel.log_ioc_match(logs, iocs).collect())
    assert m == [(1, "source_ip"), (2, "destination_ip")]


def test_feeds_stale(spark):
    feeds = spark.createDataFrame([("a", "ip", 6, True), ("b", "ip", 6, True), ("c", "ip", 6, False)],
                                  "name string, feed_type string, update_interval long, enabled boolean")
    man = spark.createDataFrame([("a", "2024-01-31 23:00:00"), ("b", "2024-01-31 12:00:00")], "feed string, t string") \
        .select("feed", F.to_timestamp("t").alias("modificationTime"))
    got = {r.feed: r.stale for r in intel.feeds_stale(feeds, man, NOW).collect()}
    assert got == {"a": False, "b": True}


@pytest.mark.parametrize("doc", [
    '[{"ioc": "a.example", "type": "domain"}, 3, "x", null, [1], {"tags": ["a"], "n": {"m": 1.50}}]', '{"data": [{"ioc": "1.2.3.4"}], "iocs": [{"ioc": "5.6.7.8"}]}',
    '{"data": {"iocs": {"data": [{"a": 1}, {"b": null}]}}}', '{"data": null, "iocs": [{"a": 1}]}', '{"iocs": [{"a": 1}]}', '{"x": 1}', " \n [ ]", "{}", '"text"', "7", '{"data": "text"}'])
def test_items_of_documents_beyond_a_variant(spark, doc):
    """The text form, which takes over where a variant is too small, gives the same objects."""
    from ravenhunt.sources import intel as src

    one = spark.createDataFrame([(doc,)], "value string")
    by_variant = src.json_feed_items(one.select(F.parse_json("value").alias("doc")), "doc")
    want = by_variant.where(src._is_kind(F.col("item"), "OBJECT")).select(F.to_json("item").alias("obj"))
    got = src.text_items(one, "value").where(F.ltrim("item").startswith("{")).select(F.col("item").alias("obj"))
    as_map = F.from_json("obj", "map<string,string>").alias("m")
    assert [r.m for r in got.select(as_map).collect()] == [r.m for r in want.select(as_map).collect()]


def test_documents_that_cannot_be_read(spark):
    from ravenhunt.functions import documents

    df = spark.createDataFrame([('{"a": 1}',), ("[1]",), ("{bad",), ("{bad" * (5 << 20),), ("[" + "7, " * (6 << 20) + "7]",), (None,)], "value string")
    got = df.select(F.octet_length("value").alias("n"), documents.readable(F.col("value")).alias("ok")).collect()
    assert [bool(r.ok) for r in got] == [True, True, False, False, True, False]
