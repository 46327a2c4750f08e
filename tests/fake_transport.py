"""A transport for tests: replies with its address, writes down when it was asked, and fails where a file says so."""

import json
import os
import time
import urllib.parse


def send(url, timeout):
    query = dict(urllib.parse.parse_qsl(urllib.parse.urlsplit(url).query))
    folder = query["log"]
    with open(f"{folder}/calls", "a", encoding="utf-8") as f:
        f.write(json.dumps([url, time.time()]) + "\n")
    broken = f"{folder}/broken"
    if os.path.exists(broken) and query.get("at", "") in open(broken, encoding="utf-8").read().split():
        return 404, b""
    return 200, json.dumps({"at": query.get("at"), "n": 1.5}).encode()
