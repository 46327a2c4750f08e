import json
import threading
import urllib.error
import urllib.request

import pytest

from contestkit.serve import answer, serve
from contestkit.sources import remote


def client(replies, **more):
    left = list(replies)
    return remote.Client(transport=lambda url, timeout: left.pop(0), allow_network=True, allow_billable=True, sleep=lambda s: None, **more)


def test_client():
    assert client([(500, b""), (429, b""), (200, b'{"a": 1}')]).json("u") == {"a": 1}
    for replies, kind in (([(401, b"")], "unauthorized"), ([(200, b"x")], "schema"), ([(503, b"")] * 4, "server")):
        with pytest.raises(remote.FetchError) as e:
            client(replies).json("u")
        assert e.value.kind == kind
    with pytest.raises(remote.FetchError, match="offline"):
        remote.Client().json("u")


def test_cached_page(tmp_path):
    with pytest.raises(remote.FetchError, match="offline"):
        remote.cached_page("u", tmp_path)
    assert remote.cached_page("u", tmp_path, lambda u, t: (200, b"<p>x</p>"), offline=False, delay=0) == "<p>x</p>"
    assert remote.cached_page("u", tmp_path) == "<p>x</p>"
    with pytest.raises(remote.FetchError, match="challenge"):
        remote.cached_page("v", tmp_path, lambda u, t: (200, b""), offline=False, delay=0, classify=lambda p: "challenge")


def test_serve(spark):
    server = serve(lambda: spark.createDataFrame([("e", 1)], "event string, bouts int"), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        reply = urllib.request.urlopen(f"{base}/api/predictions/upcoming?x=1")
        assert json.loads(reply.read()) == {"event": "e", "bouts": 1} and reply.headers["X-Content-Type-Options"] == "nosniff" and "default-src" in reply.headers["Content-Security-Policy"]
        assert urllib.request.urlopen(urllib.request.Request(f"{base}/api/predictions/upcoming", method="HEAD")).read() == b""
        for request, status in ((urllib.request.Request(f"{base}/x"), 404), (urllib.request.Request(f"{base}/api/predictions/upcoming", data=b"x"), 405)):
            with pytest.raises(urllib.error.HTTPError) as e:
                urllib.request.urlopen(request)
            assert e.value.code == status
    finally:
        server.shutdown()

    def broken(error):
        raise error

    views = {"/none": lambda: broken(FileNotFoundError("p")), "/table": lambda: spark.read.parquet("/nowhere"), "/bad": lambda: broken(ValueError("secret"))}
    assert [answer(views, "GET", p)[0].value for p in ("/none", "/table", "/bad", "/other")] == [503, 503, 500, 404]
    assert b"secret" not in answer(views, "GET", "/bad")[1] and answer(views, "DELETE", "/none")[0].value == 405
