"""Inputs on which an operator once did less than the whole job."""

import random

import brute
import numpy as np
import pytest
import zstandard

from denspark.llm import decontaminate, quality_rules, suffix_dedup, url_filter


def test_hot_key_equal_to_a_rule(spark):
    n = 4000
    urls = ["http://any.host.net/", "http://example.net/en/", "http://a.org/x"]
    rows = [(i, urls[i % 3]) for i in range(n)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = url_filter.url_filter(spark.createDataFrame(rows, "page_id long, url string").repartition(4)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = {0: ("net/", "block"), 1: ("example.net/en/", "allow"), 2: (None, "allow")}
    assert len(got) == n
    assert [r for r in got if (r["rule"], r["verdict"]) != want[r["page_id"] % 3]] == []


def holds(item, words):
    """Whether a stretch of the words has enough of the item in order, by brute force."""
    n, answer = len(item), decontaminate.answer_of(" ".join(item))
    for k in range(len(words)):
        part = words[k : k + -(-3 * n // 2)]
        share = decontaminate.lcs(item, part) / n
        if share >= 0.8 or share >= 0.6 and decontaminate.lcs(item[n - answer :], part) / answer >= 0.5:
            return True
    return False


@pytest.mark.parametrize("size", [8, 10, 15, 20])
def test_short_items_against_brute_force(size):
    rng = random.Random(size)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(1500)]
    text = lambda n: [rng.choice(["the", "of", "and"]) if rng.random() < 0.4 else rng.choice(words) for _ in range(n)]
    items, docs = [text(size) for _ in range(60)], []
    for k, item in enumerate(items):
        kept = (1.0, 0.75, 0.6)[k % 3]
        docs.append(text(rng.randint(20, 90)) + [w if rng.random() < kept else rng.choice(words) for w in item] + text(rng.randint(20, 90)))
    # A space without any cosine: what the words alone find.
    space = np.zeros((decontaminate.TERMS, decontaminate.RANK), np.float32)
    raw = [" ".join(d).encode() for d in docs]
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    block = decontaminate.Items([(i, " ".join(x)) for i, x in enumerate(items)], space)
    got = {(d, i) for d, i, *_ in decontaminate.matches(np.frombuffer(b"".join(raw), np.uint8), offs, block, space)}
    want = {(d, i) for d, doc in enumerate(docs) for i, item in enumerate(items) if holds(item, doc)}
    assert len({(d, i) for d, i in want if d == i}) >= 20
    assert got == want


def test_part_of_a_long_item():
    words = [f"w{i}" for i in range(400)]
    space = np.zeros((decontaminate.TERMS, decontaminate.RANK), np.float32)
    block = decontaminate.Items([(1, " ".join(words[:200]))], space)
    raw = " ".join(words[300:340] + words[50:110] + words[340:380]).encode()
    got = decontaminate.matches(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), block, space)
    assert [x[1] for x in got] == [1]


def test_blocks_with_a_common_anchor_are_split(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 5)
    sizes, split = [], suffix_dedup.split_hot

    def seen(rows):
        cold, same = split(rows)
        sizes.append((rows.groupBy("gram").count().agg({"count": "max"}).first()[0], cold.groupBy("gram").count().agg({"count": "max"}).first()[0], same is not None))
        return cold, same

    monkeypatch.setattr(suffix_dedup, "split_hot", seen)
    rng = random.Random(11)
    body = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    line, left, right = body(100), body(150), body(150)
    # Every context differs; some share 199, 200 or more bytes around the line, on either side.
    texts = [body(150) + line + body(150) for _ in range(30)]
    for k in (0, 1, 30, 49, 50, 51, 70, 99, 100, 101, 120):
        texts += [body(150) + left[len(left) - k :] + line + right[: rng.choice([0, 99 - k, 100 - k, 101 - k]) if k < 99 else 0] + body(150) for _ in range(3)]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.dedup_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute.repeats(rows)
    ((before, after, same),) = sizes
    assert before > 5 >= after
    assert same


def test_the_last_chunk_is_judged():
    rng = random.Random(1)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    prose = " ".join(rng.choice(words) for _ in range(4000)).encode()
    noise = bytes(rng.randrange(33, 127) for _ in range(4095))
    packer = zstandard.ZstdCompressor(level=quality_rules.LEVEL)
    chunks = lambda text: quality_rules.compression(text, packer)[1:]
    assert chunks(prose[:8192] + noise) == (3, 1, False)
    assert chunks(prose[:12288]) == (3, 0, True)
    assert chunks(prose[:4097])[:2] == (2, 0)
    assert chunks(prose[:2000] + noise)[:2] == (2, 1)
    assert chunks(prose[:8192])[:2] == (2, 0)
    assert chunks(prose[:4096])[:2] == (0, 0)


def test_very_long_addresses_and_deep_rules(spark):
    deep = ".".join(["a"] * 200)
    many = [("block", ".".join(["b"] * k), "/") for k in range(1, 150)]
    rules = url_filter.rule_table(spark, [("block", "net", "/"), ("allow", "net", "/x/"), ("block", deep, "/"), *many])
    urls = [f"http://h.net/x/{'y' * 1_000_000}{i}" for i in range(60)] + [f"http://{'h' * 1_000_000}.net/", f"http://c.{deep}/p", f"http://{'.'.join('b' * 149)}/", f"http://{'b.' * 5_000}c/"]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = url_filter.url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(8), rules)
        got = {r["page_id"]: (r["rule"], r["verdict"]) for r in got.select("page_id", "rule", "verdict").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {got[i] for i in range(60)} == {("net/x/", "allow")}
    assert [got[i] for i in range(60, 64)] == [("net/", "block"), (f"{deep}/", "block"), (f"{'.'.join('b' * 149)}/", "block"), (None, "allow")]


@pytest.mark.parametrize("hot", [2, 4])
def test_equal_and_different_texts_in_split_blocks(spark, monkeypatch, hot):
    """Blocks over HOT whose rows all share a window: equal texts in many shards, and others that only share it."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(hot)
    body = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    shared = [body(200), body(230)]
    texts = []
    for piece in shared:
        same = body(90) + piece + body(70)
        texts += [same] * 12 + [body(rng.randint(0, 80)) + piece + body(rng.randint(0, 80)) for _ in range(6)]
    texts += [rng.choice(["", body(60)]) + rng.choice(shared) + rng.choice(["", body(30)]) for _ in range(12)] + [body(500), body(500)]
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.dedup_report(frame).collect()}
    assert got == brute.repeats(rows)
