import random
import zlib

import numpy as np
import pytest

from contestkit.llm import packing

from .conftest import documents


def check(rows, capacity):
    """Sequences are gapless and within the capacity; returns their number."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pieces_and_places(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack_documents(docs).collect()
    encode = packing.encoder("byte_bpe_50k.json")
    want = set()
    for d in docs.collect():
        ids = np.array([*encode(d["text"]), 0], dtype="<u4")
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids), 2048), len(ids)]
        want |= {(d["doc_id"], k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))}
    assert {tuple(r)[:5] for r in rows} == want and len(rows) == len(want)
    least = -(-sum(r["length"] for r in rows) // 2048)
    assert least <= check(rows, 2048) <= least * 1.01 + 1


@pytest.mark.parametrize("seed", range(5))
def test_fullest_against_brute_force(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 30) for _ in range(9)]
    room = rng.randint(1, 90)
    best = max(s for m in range(512) if (s := sum(x for k, x in enumerate(lengths) if m >> k & 1)) <= room)
    counts = {x: lengths.count(x) for x in lengths}
    found = packing.fullest(room, counts, sorted(counts, reverse=True))
    assert sum(k * n for k, n in found.items()) == best
    assert all(n <= counts[k] for k, n in found.items())


def test_plan_uses_every_piece():
    rng = random.Random(3)
    histogram = {rng.randint(1, 64): rng.randint(1, 500) for _ in range(40)}
    plan = packing.minimum_bin_slack(histogram, 64)
    used = {}
    for bin_, times in plan:
        assert sum(k * n for k, n in bin_.items()) <= 64
        for k, n in bin_.items():
            used[k] = used.get(k, 0) + n * times
    assert used == histogram


def test_odd_rows(spark, odd):
    rows = packing.pack_documents(odd).collect()
    assert sum(r["piece"] == 0 for r in rows) == odd.count()
    assert sum(r["doc_id"] == 5 for r in rows) == 2 and sum(r["doc_id"] is None for r in rows) == 1
    assert {r["length"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    check(rows, 2048)
    assert packing.pack_documents(odd.limit(0)).collect() == []


def test_one_length_only(spark):
    rows = packing.pack_documents(documents(spark, [(k, "same text") for k in range(300)]), capacity=16).collect()
    n = rows[0]["length"]
    assert check(rows, 16) == -(-300 // (16 // n))


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_of_added_tokens_and_long_runs(spark):
    texts = ["text <|endoftext|> more", "<|endoftext|><|endoftext|>", "<|endoftext", "a" + "\n" * 1_100_000 + "b", "x" + " \n" * 60_000, "y  z " * 30_000]
    rows = packing.token_pieces(documents(spark, list(enumerate(texts))), capacity=1 << 22).collect()
    want = {}
    for k, text in enumerate(texts):
        ids = np.array([*tokenizer().encode(text, add_special_tokens=False).ids, packing.END_ID], dtype="<u4")
        want[k] = (len(ids), zlib.crc32(ids.tobytes()))
    assert {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in rows} == want
    assert want[0][0] == 5


def test_fast_ids_are_the_tokenizers():
    """Both merge the pair of least rank, so they agree if ranks are ids and every entry's own merges lead to it."""
    import base64

    import public_tokenizers
    from tokenizers import Tokenizer, pre_tokenizers

    exact = tokenizer()
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    # the byte alphabet as the pre-tokenizer writes it: printable Latin-1 as is, the others from U+0100 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in plain)}
    assert set(letter.values()) == set(pre_tokenizers.ByteLevel.alphabet())
    merges = Tokenizer(exact.model)  # no pre-tokenizer: each text is one piece
    vocabulary = {k: v for k, v in exact.get_vocab(with_added_tokens=False).items() if v != 50256}
    assert {"".join(letter[b] for b in word): rank for word, rank in ranks.items()} == vocabulary
    for word, number in vocabulary.items():
        assert merges.encode(word).ids == [number]
    fast, rng = packing.encoder(), random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("aeinst  \n'é漢1!\u3000") for _ in range(rng.choice((5, 50, 700))))
        assert fast(text) == exact.encode(text, add_special_tokens=False).ids
        letters = "".join(rng.choice("aeinst") for _ in range(1500))
        assert fast(letters) == exact.encode(letters, add_special_tokens=False).ids
