"""SimHash near-dedup, the filter audit and fill-in-middle against brute force."""

import random
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from denspark.llm import fill_in_middle, filter_audit, simhash_dedup, textops


def slice_of(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])


def test_fingerprints(rows, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "HASHED", 17)
    texts = [t or "" for _, t in rows]
    assert simhash_dedup.fingerprints(*slice_of(texts)).tolist() == [brute.fingerprint(t) for t in texts]


def flipped(rng, x, bits):
    for b in rng.sample(range(64), bits):
        x ^= 1 << b
    return x


def near_prints(seed, n):
    """Fingerprints in chains of a few bits, groups of near copies, and others."""
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n // 6)] + [0, (1 << 64) - 1]
    while len(out) < n:
        out.append(flipped(rng, rng.choice(out), rng.choice([1, 2, 3, 4, 5, 6])))
    return sorted(set(out))


def test_gray_order():
    x = np.array(near_prints(1, 300), np.uint64)
    assert (simhash_dedup.gray_code(simhash_dedup.gray_rank(x)) == x).all()
    steps = simhash_dedup.gray_code(np.arange(1000, dtype=np.uint64))
    assert (np.bitwise_count(steps[1:] ^ steps[:-1]) == 1).all()


@pytest.mark.parametrize("n", [1, 7, 65, 700])
def test_links_of_blocks(monkeypatch, n):
    monkeypatch.setattr(simhash_dedup, "OPENED", 5)
    x = np.array(near_prints(n, n), np.uint64)
    x = x[np.argsort(simhash_dedup.gray_rank(x))]
    a, b = x[: len(x) // 3 + 1], x[len(x) // 3 + 1 :]
    for left, right, same in ((x, x, True), (a, b, False)):
        if not len(right):
            continue
        got = [p for i, j in simhash_dedup.links(simhash_dedup.Tree(left), simhash_dedup.Tree(right), same) for p in zip(i.tolist(), j.tolist(), strict=True)]
        want = [(i, j) for i, y in enumerate(left.tolist()) for j, z in enumerate(right.tolist()) if (i < j or not same) and (y ^ z).bit_count() <= 4]
        assert sorted(got) == want


@pytest.mark.parametrize(("block", "fan"), [(16, 4), (4, 2)])
def test_classes_over_many_blocks(spark, monkeypatch, block, fan):
    monkeypatch.setattr(simhash_dedup, "BLOCK", block)
    monkeypatch.setattr(simhash_dedup, "FAN", fan)
    monkeypatch.setattr(simhash_dedup, "HEIGHT", 2)
    prints = near_prints(5, 400)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(x,) for x in signed for _ in range(2)], "print long")
    got = {r["node"]: r["component"] for r in simhash_dedup.classes(frame).collect()}
    want = brute.near_classes(prints)
    classes = {}
    for x, c in zip(signed, want, strict=True):
        classes.setdefault(c, set()).add(x)
    assert {frozenset(c) for c in classes.values() if len(c) > 1} == {frozenset(x for x in got if got[x] == c) for c in set(got.values())}


def test_upper_levels_leave_blocks_out(spark):
    rng = random.Random(9)
    codes = np.array([rng.getrandbits(64) for _ in range(4000)], np.uint64)
    codes = codes[np.argsort(simhash_dedup.gray_rank(codes))].reshape(-1, 4)
    mask, pattern = simhash_dedup.shared(np.full(codes.shape, ~np.uint64(0)), codes)
    nodes = spark.createDataFrame([(i, m, p) for i, (m, p) in enumerate(zip(mask.view(np.int64).tolist(), pattern.view(np.int64).tolist(), strict=True))], "id long, mask long, pattern long")
    got = {(r["a"], r["b"]) for r in simhash_dedup.near_blocks(nodes, len(codes)).collect()}
    both = mask[:, None] & mask[None]
    apart = np.bitwise_count((pattern[:, None] ^ pattern[None]) & both)
    i, j = np.nonzero(np.triu(apart <= 4))
    assert got == set(zip(i.tolist(), j.tolist(), strict=True))
    assert len(got) < len(codes) ** 2 / 4


def test_simhash_dedup(spark, docs, rows, empty):
    got = simhash_dedup.simhash_dedup(docs).collect()
    prints = [brute.fingerprint(t) for _, t in rows]
    assert Counter((r["doc_id"], r["fingerprint"]) for r in got) == Counter((d, f"{p:016x}") for (d, _), p in zip(rows, prints, strict=True))
    label = brute.near_classes(prints)
    least = {}
    for (d, _), c in zip(rows, label, strict=True):
        if d is not None:
            least[c] = min(d, least.get(c, d))
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == Counter((d, least.get(c)) for (d, _), c in zip(rows, label, strict=True))
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in kept.collect()) == sorted(least.get(c, -1) for c in set(label))
    assert simhash_dedup.simhash_dedup(empty).collect() == [] and simhash_dedup.keep_one(empty).collect() == []


def test_fill_in_middle(docs, rows, empty, monkeypatch):
    for chunk, run in ((4096, 1 << 20), (3, 7), (1, 1)):
        texts = [t or "" for _, t in rows] + ["a<P>b", " lead", "trail \n", "\t\n ", "é 日本\n語"]
        parts = fill_in_middle.Chunks(*slice_of(texts), chunk, run)
        ends = [np.cumsum([len(x.encode()) for x in brute.TOKEN.findall(t)]).tolist() for t in texts]
        assert parts.tokens.tolist() == [len(x) for x in ends]
        assert [[parts.place(k, r) - int(parts.offs[k]) for r in range(1, len(x) + 1)][:300] for k, x in enumerate(ends)] == [x[:300] for x in ends]
    got = fill_in_middle.fim_report(docs).collect()
    assert Counter(map(tuple, got)) == Counter(brute.fill_in_middle(d, t) for d, t in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle.fim_report(empty).collect() == []


def test_transformed_texts(spark, docs, rows):
    made = fill_in_middle.transform_texts(docs, rate=100, spm=0)
    assert made.columns == docs.columns
    texts = Counter((r["doc_id"], r["text"]) for r in made.collect())
    assert sum(v for (_, t), v in texts.items() if t is None) == sum(t is None for _, t in rows)
    assert all(t.startswith("<P>") for _, t in texts if t)
    odd = spark.createDataFrame([(1, "a <S> b"), (2, "x <P"), (3, "<S")], "doc_id long, text string")
    both = fill_in_middle.fill_in_middle(odd, rate=100).withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form")))
    assert {(r["doc_id"], r["back"], r["form"] == "plain") for r in both.collect()} == {(1, "a <S> b", True), (2, "x <P", False), (3, "<S", False)}


def test_distinct_words_are_verified(monkeypatch):
    texts = ["a b a c", "", "x x x y", "Ab ab AB ab", "q w e r t y q"]
    raw, offs = slice_of(texts)
    for compared in (1, 3, 1 << 20):
        monkeypatch.setattr(filter_audit, "COMPARED", compared)
        words = textops.Words(raw, offs, lower=False)
        want = [len(set(t.split())) for t in texts]
        assert filter_audit.distinct_words(raw, words).tolist() == want
        # Hashes that say nothing: the words decide.
        words.hashes = words.hashes % np.uint64(2)
        assert filter_audit.distinct_words(raw, words).tolist() == want


def test_audit(spark, docs, rows, empty):
    labels = [(1, 1, 0), (9, 1, 1), (9, 0, 0), (10, None, 1), (18, 1, None), (19, 1, 1), (None, 1, 1), (25, 0, 1)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    sources = [(d, t, None if k % 7 == 0 else f"s{k % 3}") for k, (d, t) in enumerate(rows)]
    got = filter_audit.audit(docs, frame).collect()
    assert len(got) == 600 * 4
    assert {tuple(r) for r in got} == brute.audit(sources, labels)
    assert filter_audit.audit(empty, frame).collect() == []
    assert len(filter_audit.audit(docs, frame.limit(0)).collect()) == 2400
