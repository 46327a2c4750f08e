import hashlib
import random
import re
import time
from dataclasses import replace

import pytest

from contestkit.llm import queries, secrets

from .conftest import documents

ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""")


def plain(text):
    """Base spans, kind by kind, without the operator."""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


def test_query_against_brute_force(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op3_secret_scan(spark, sf).collect()
    assert len(rows) == len(texts)
    assert sum(r["n_assign"] + r["n_access"] + r["n_hex"] for r in rows) > 10
    for r in rows:
        spans = plain(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(r["spans"].split(",")) or not spans
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s.startswith(k) for s in spans) for k in secrets.BASE_KINDS]


def test_failing_match_takes_its_text(spark):
    text = "é token: token: abcdef and Api_Key='x+/9_.=-' Key AKIA" + "Z" * 16 + " ſecret=abcdefgh " + "ab" * 12
    got = secrets.scan_documents(documents(spark, [(1, text)])).first()["spans"]
    assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in got] == plain(text)


@pytest.mark.parametrize("most", [secrets.BROADCAST_BLOBS, 1, -1])
def test_ledger_scans_unseen_pairs_only(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(secrets, "BROADCAST_BLOBS", most)  # all ways of joining the texts
    ledger = f"file://{tmp_path}/ledger"
    one, two = documents(spark, [(1, "token=abcdef"), (2, "token=abcdef")]), documents(spark, [(2, "token=abcdef"), (3, "passwd: ghijkl")])
    scanned = lambda: sorted(tuple(r["rules"]) for r in spark.read.parquet(ledger).collect())
    secrets.scan_documents(one, ledger).collect()
    keys = tuple(r.key for r in secrets.RULES)
    assert scanned() == [keys]
    secrets.scan_documents(two, ledger).collect()
    assert scanned() == [keys, keys]
    newer = (replace(secrets.RULES[0], version=2), *secrets.RULES[1:])
    rows = secrets.scan_documents(two, ledger, newer).collect()
    assert scanned() == sorted([keys, keys, (newer[0].key,), (newer[0].key,)])
    assert {r["doc_id"]: len(r["spans"]) for r in rows} == {2: 1, 3: 1}


def test_texts_of_a_first_run_are_not_shuffled(spark, tmp_path):
    docs = documents(spark, [(k, f"token=abcdef{k}") for k in range(50)] + [(100 + k, "token=same123") for k in range(20)])
    todo = secrets.unseen(docs, f"file://{tmp_path}/none")
    assert "Exchange hashpartitioning" not in todo._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["text"] for r in todo.collect()) == sorted([f"token=abcdef{k}" for k in range(50)] + ["token=same123"])


def test_redact(spark, monkeypatch):
    docs = documents(spark, [(1, "é token=abcdef end"), (2, "clean"), (3, None), (4, "secret = " + "0123456789abcdef" * 2), (4, "clean")])
    want = [(1, "é [assign] end", 14), (2, "clean", 5), (3, None, None), (4, "[assign]", 8), (4, "clean", 5)]
    for most in (secrets.BROADCAST_BLOBS, -1):
        monkeypatch.setattr(secrets, "BROADCAST_BLOBS", most)
        out = secrets.redact(docs)
        assert out.columns == docs.columns
        assert sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()), key=str) == sorted(want, key=str)


def test_odd_rows(spark, odd):
    rows = secrets.scan_documents(odd).collect()
    assert len(rows) == odd.count() and [r["doc_id"] for r in rows if r["spans"]] == [9]
    assert secrets.scan_documents(odd.limit(0)).collect() == [] and secrets.redact(odd).count() == odd.count()


def test_tokens_with_dots():
    plain = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
    rng = random.Random(3)
    pieces = ["eyJ", "abcdefgh", "eyJabcdefgh", "x", ".", ".", " ", "-_0"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 40)))
        assert secrets.find_jwt(text) == [m.span() for m in plain.finditer(text)]


def test_hostile_texts_take_linear_time():
    began = time.process_time()
    for piece in ("eyJ", "eyJabcdefgh.", "token ", "token = ", "-----BEGIN PRIVATE KEY-----", "AKIA", "abcdef0123", "PRIVATE KEY "):
        for rule in secrets.RULES:
            rule.find(piece * (1_000_000 // len(piece)))
    text = "token=abcdef " * 80_000
    spans = secrets.find_assign(text)
    assert secrets._covered(text, [a for a, _ in spans], [b for _, b in spans], ["assign"] * len(spans)) == "[assign] " * 80_000
    assert time.process_time() - began < 20
