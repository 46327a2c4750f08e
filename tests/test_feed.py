import json
from collections import Counter

import pytest

from contestkit.sources import feed
from contestkit.sources.remote import FetchError


def calls(folder):
    path = folder / "calls"
    return [json.loads(x) for x in path.read_text().splitlines()] if path.exists() else []


def options(folder, **more):
    base = {"url": f"http://x/odds?log={folder}&at={{time}}", "cache": f"{folder}/cache", "start": "2024-01-01T00:00:00Z", "end": "2024-01-01T07:00:00Z", "rate": "20", "partitions": "3", "transport": "tests.fake_transport:send"}
    return base | {"allowNetwork": "true", "allowBillable": "true"} | more


def test_batch_read_and_rate(spark, tmp_path):
    spark.dataSource.register(feed.HttpFeed)
    read = spark.read.format("http_feed").options(**options(tmp_path))
    assert read.load().rdd.getNumPartitions() == 3
    rows = read.load().collect()
    assert len(rows) == 8 and {json.loads(r["payload"])["at"] for r in rows} == {f"2024-01-01T{h:02}:00:00Z" for h in range(8)} and not any(r["cached"] for r in rows)
    sent = sorted(t for _, t in calls(tmp_path))
    assert len(sent) == 8 and all(b - a > 0.02 for a, b in zip(sent, sent[1:], strict=False))  # slots of 0.05 s over all partitions
    again = read.load().collect()
    assert all(r["cached"] for r in again) and len(calls(tmp_path)) == 8
    offline = spark.read.format("http_feed").options(**options(tmp_path, allowBillable="false"))
    assert offline.load().count() == 8


def test_a_failed_partition_pays_for_the_rest_only(spark, tmp_path):
    spark.dataSource.register(feed.HttpFeed)
    (tmp_path / "broken").write_text("2024-01-01T02:00:00Z")
    read = spark.read.format("http_feed").options(**options(tmp_path, partitions="1"))
    with pytest.raises(Exception, match="404"):
        read.load().collect()
    (tmp_path / "broken").write_text("")
    assert read.load().count() == 8
    counts = Counter(json.loads(json.dumps(u)) for u, _ in calls(tmp_path))
    assert sorted(counts.values()) == [1] * 7 + [2]  # the broken one was asked twice


def test_closed_gates(tmp_path):
    settings = feed.Settings(options(tmp_path, allowNetwork="false"))
    with pytest.raises(FetchError, match="offline"):
        list(settings.rows(settings.planned(0, 1)[0]))
    assert not calls(tmp_path)
    with pytest.raises(ValueError, match="start"):
        feed.Settings({"url": "http://x/{time}", "cache": "c"})
    one = feed.Settings({"url": "http://x/now", "cache": str(tmp_path)})
    assert [p.wanted for p in one.planned(0, one.due(None))] == [[("http://x/now", None)]]


def test_stream_goes_on_from_its_offset(spark, tmp_path):
    spark.dataSource.register(feed.HttpFeed)
    for end, n in (("2024-01-01T03:00:00Z", 4), ("2024-01-01T07:00:00Z", 8)):
        stream = spark.readStream.format("http_feed").options(**options(tmp_path, end=end)).load()
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        got = spark.read.parquet(f"{tmp_path}/out")
        assert got.count() == n == got.select("url").distinct().count() == len(calls(tmp_path))
