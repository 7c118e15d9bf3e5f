"""Decontamination and toxicity."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from denspark.llm import decontaminate, toxicity


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("etaoinshrdlucm") for _ in range(rng.randint(2, 10))) for _ in range(1500)]
    common = ["the", "of", "and", "to", "in", "is"]
    text = lambda n: " ".join(rng.choice(common) if rng.random() < 0.4 else rng.choice(words) for _ in range(n))
    items = [(i, text(rng.randint(16, 60))) for i in range(30)]
    docs = [(i, text(rng.randint(5, 300))) for i in range(200)]
    leaked = set()
    for k in range(20):
        item = items[k][1].split()
        if k % 3 == 1:  # a paraphrase: some words replaced
            for _ in range(len(item) // 8):
                item[rng.randrange(len(item))] = rng.choice(words)
        docs[k * 7] = (k * 7, text(rng.randint(0, 90)) + " " + " ".join(item) + " " + text(rng.randint(0, 90)))
        leaked.add((k * 7, k))
    docs += [(900, None), (901, ""), (902, items[3][1].upper()), (903, text(9000)), (None, items[4][1]), (5, docs[5][1])]
    leaked |= {(902, 3), (None, 4)}
    # A short item of common words is looked up like any other.
    leaked |= {(d, 52) for d, t in docs if " the of and " in f" {(t or '').lower()} "}
    rows = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, item_id string").repartition(3)
    return rows, spark.createDataFrame([*items, (50, None), (51, ""), (52, "the of and")], "item_id long, text string"), leaked


def test_leaks(corpus):
    docs, bench, leaked = corpus
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()} == leaked


def test_blocks_of_the_benchmark(corpus, monkeypatch):
    docs, bench, leaked = corpus
    monkeypatch.setattr(decontaminate, "ITEMS", 7)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()} == leaked


def test_clean_documents_stay(corpus):
    docs, bench, leaked = corpus
    left = decontaminate.without_leaks(docs, bench)
    assert left.schema == docs.schema
    gone = {d for d, _ in leaked}
    assert left.count() == docs.count() - sum(r["doc_id"] in gone for r in docs.collect())
    assert not {r["doc_id"] for r in left.collect()} & gone


def test_short_items_at_two_sizes(corpus, spark):
    """What is found doesn't hang on how often the item's words stand in the whole corpus."""
    docs, bench, leaked = corpus
    short = bench.where("item_id = 52")
    one = decontaminate.leaks(docs, short).count()
    assert one >= 3
    many = docs.crossJoin(spark.range(20).select(F.col("id").alias("again"))).drop("again")
    assert decontaminate.leaks(many, short).count() == 20 * one
    left = decontaminate.without_leaks(many, short)
    assert left.count() == 20 * decontaminate.without_leaks(docs, short).count() < many.count()


def test_empty_tables(corpus, spark):
    docs, bench, _ = corpus
    none, no_items = spark.createDataFrame([], docs.schema), spark.createDataFrame([], bench.schema)
    assert decontaminate.leaks(none, bench).count() == 0
    assert decontaminate.leaks(docs, no_items).count() == 0
    assert decontaminate.without_leaks(docs, no_items).count() == docs.count()


def test_common_subsequence():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
            row = new
        return row[-1]

    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(1, 90))] for _ in range(2))
        assert decontaminate.lcs(a, b) == slow(a, b)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(700):
        own = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        toxic = int(rng.random() < 0.2)
        for _ in range(3 * toxic):
            own.insert(rng.randrange(len(own)), rng.choice(["vexgrump", "Blorgoid", "snarkfool"]))
        docs.append((i, " ".join(own), "x"))
        labels.append((i, toxic))
    docs += [(9000, None, None), (9001, "", None), (None, "snarkfool vexgrump", None), (3, docs[3][1], None)]
    labels += [(None, 1), (5, None), (labels[7][0], labels[7][1])]
    return spark.createDataFrame(docs, "doc_id long, text string, toxic string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels[:700])


def test_held_out_accuracy(labelled):
    docs, labels, truth = labelled
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95


def test_held_out_labels_are_never_seen(labelled, spark):
    docs, labels, truth = labelled
    turned = spark.createDataFrame([(d, 1 - t if zlib.crc32(str(d).encode()) % 5 == 0 else t) for d, t in truth.items()], "doc_id long, toxic int")
    a = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels).collect()}
    b = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, turned).collect()}
    assert all(abs(a[d] - b[d]) < 1e-4 for d in truth)


def test_without_labels(labelled, spark):
    docs, labels, _ = labelled
    none = spark.createDataFrame([], labels.schema)
    assert {round(r["score"], 3) for r in toxicity.toxicity(docs, none).collect()} == {0.333}
    assert toxicity.toxicity(spark.createDataFrame([], docs.schema), labels).count() == 0


def words_of(rng, n):
    return ["".join(rng.choice("etaoinshrdlucm") for _ in range(rng.randint(3, 9))) for _ in range(n)]


def confirmed(item, words):
    """Whether a stretch of the words has enough of the item in order, by trying them all."""
    n, answer = len(item), decontaminate.answer_of(" ".join(item))
    for k in range(len(words)):
        part = words[k : k + -(-3 * n // 2)]
        share = decontaminate.lcs(item, part) / n
        if share >= decontaminate.SURE or share >= decontaminate.SHARED and decontaminate.lcs(item[n - answer :], part) / answer >= decontaminate.ANSWER:
            return True
    return False


def test_recall_against_every_stretch(spark):
    """The whole operator against an exhaustive search: paraphrases of every strength."""
    rng = random.Random(21)
    words = words_of(rng, 1200)
    text = lambda n: [rng.choice(["the", "of", "and", "to"]) if rng.random() < 0.4 else rng.choice(words) for _ in range(n)]
    items = [text(rng.choice([9, 14, 20, 30])) for _ in range(40)]
    docs = []
    for k in range(120):
        own = [w if rng.random() < (1.0, 0.85, 0.7, 0.55)[k % 4] else rng.choice(words) for w in items[k % 40]]
        if k % 5 == 0:
            own = [x for w in own for x in ((w,) if rng.random() < 0.8 else (w, rng.choice(words)))]
        docs.append(text(rng.randint(0, 60)) + own + text(rng.randint(0, 60)))
    want = {(d, i) for d, doc in enumerate(docs) for i, item in enumerate(items) if len(set(item) & set(doc)) >= 0.6 * len(set(item)) and confirmed(item, doc)}
    frame = spark.createDataFrame([(d, " ".join(x)) for d, x in enumerate(docs)], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(frame, bench).collect()}
    assert len(want) >= 60
    assert len(got & want) >= 0.98 * len(want)
    # What is found beside that has its words a little further apart than a stretch is long.
    assert len(got - want) <= 0.1 * len(want)
    assert all(decontaminate.lcs(items[i], docs[d]) >= 0.6 * len(items[i]) for d, i in got)


def test_short_items_stand_word_by_word(spark):
    rng = random.Random(4)
    words = words_of(rng, 800)
    text = lambda n: [rng.choice(["the", "of", "and"]) if rng.random() < 0.5 else rng.choice(words) for _ in range(n)]
    items = [[rng.choice(words) for _ in range(n)] for n in (3, 4, 5, 6, 7, 5)] + [["the", "of"], ["and", "the", "of"], []]
    docs = [text(rng.randint(3, 90)) for _ in range(80)]
    for k in range(24):
        at = rng.randrange(len(docs[k]))
        own = list(items[k % 6])
        if k >= 12:  # torn apart, or one word short: no leak
            own = own[:-1] if k % 2 else [*own[:2], "between", *own[2:]]
        docs[k] = docs[k][:at] + own + docs[k][at:]
    there = lambda item, doc: any(doc[i : i + len(item)] == item for i in range(len(doc)))
    want = {(d, i) for d, doc in enumerate(docs) for i, item in enumerate(items) if item and there(item, doc)}
    frame = spark.createDataFrame([(d, " ".join(x).title()) for d, x in enumerate(docs)], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(frame, bench).collect()} == want
    assert len(want) >= 12
    assert decontaminate.without_leaks(frame, bench).count() == len(docs) - len({d for d, _ in want})


def test_scores_against_plain_sums(labelled):
    docs, labels, _ = labelled
    model = toxicity.train(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}

    def bucket(gram):
        h = len(gram) * 0x1B873593 & 0xFFFFFFFF
        for j, c in enumerate(gram):
            h = (h + ord(c) * int(toxicity._ODD[j])) & 0xFFFFFFFF
        h ^= h >> 15
        return (h * 0x2C1B3C6D & 0xFFFFFFFF) >> 14

    for row in docs.orderBy("doc_id").limit(60).collect():
        if row["doc_id"] in (3, None):
            continue
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in row["text"] or "")
        grams = [bucket(text[i : i + n]) for n in toxicity.SIZES for i in range(len(text) - n + 1)]
        own = {int(model.slot[b]) for b in grams} - {-1}
        z = sum(model.weight[f] for f in own) + sum(float(model.rest[b]) for b in grams) / max(1, len(grams)) + model.intercept
        assert abs(scores[row["doc_id"]] - 1 / (1 + np.exp(-z))) < 1e-4
    # Every n-gram of the training texts is weighed.
    assert (model.slot >= 0).sum() == toxicity.FEATURES
    assert np.count_nonzero(model.rest) > toxicity.FEATURES
