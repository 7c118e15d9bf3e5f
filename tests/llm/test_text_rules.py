"""Quality rules, personal data and licences against plain Python."""

from collections import Counter

import brute
from pyspark.sql import functions as F

from denspark.llm import license_scan, pii, quality_rules


def multiset(df):
    return Counter(tuple(r) for r in df.collect())


def test_quality_counts(docs, rows):
    got = multiset(quality_rules.quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
    assert got == Counter((d, *brute.quality(t)) for d, t in rows)


def test_compression_bands(spark):
    import os
    import random

    rng = random.Random(1)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    prose = " ".join(rng.choice(words) for _ in range(600))
    noise = " ".join(os.urandom(30).hex().translate(str.maketrans("0123456789", "ghijklmnop")) for _ in range(60))
    loops = " ".join(f"{w} same thing again and again and" for w in rng.sample(words, 8)) + " " + "ab ab cd " * 500
    rare = bytes(rng.randrange(33, 127) for _ in range(9000)).decode()
    spaced = " ".join(rare[i : i + 7] for i in range(0, len(rare), 7))
    df = quality_rules.quality_rules(spark.createDataFrame(list(enumerate([prose, loops, spaced, noise])), "doc_id long, text string"))
    kept = {r["doc_id"]: r["kept"] for r in df.collect()}
    assert kept[0]
    assert not kept[1]
    assert not kept[2]


def test_quality_of_an_empty_table(empty):
    assert quality_rules.quality_rules(empty).count() == 0
    assert quality_rules.keep_good(empty).columns == empty.columns


def test_keep_good_keeps_rows_as_they_were(docs):
    kept = quality_rules.keep_good(docs)
    assert kept.schema == docs.schema
    want = quality_rules.quality_rules(docs).where("kept").groupBy("doc_id").count()
    assert multiset(kept.groupBy("doc_id").count()) == multiset(want)


def test_personal_data(docs, rows):
    got = multiset(pii.pii_report(docs).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"))
    assert got == Counter((d, *brute.pii(t)) for d, t in rows)
    assert pii.pii_report(docs).agg(F.sum("n_iban")).first()[0] == 1


def test_long_runs_are_scanned_in_time(spark):
    texts = ["a" * 200_000, "1" * 100_000, "1 " * 60_000, "a@" + "b." * 60_000, "+1" + "." * 100_000, "1.2.3." * 30_000, "a.b@c.d " * 3000]
    out = pii.pii_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["n_email"] for r in out] == [0, 0, 0, 1, 0, 0, 3000]


def test_context_raises_scores(spark):
    text = "phone +15551234567 " + "x " * 60 + "+15551234567"
    score = pii.pii_report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["scores"].split(",")
    assert score == ["0.7", "0.5"]


def test_other_words_lower_scores(spark):
    text = "firmware version 10.2.3.4 " + "x " * 60 + "server 10.2.3.4 " + "x " * 60 + "10.2.3.4"
    score = pii.pii_report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["scores"].split(",")
    assert score == ["0.3", "0.7", "0.5"]


def test_account_numbers(spark):
    good = ["BE68 5390 0754 7034 NEXT", "BE68539007547034.", "GB82 WEST 1234 5698 7654 32 AND", "konto DE89370400440532013000 x", "NO93 8601 1117 947"]
    bad = ["BE68 5390 0754 7035", "DE8937040044053201300", "ZZ68 5390 0754 7034", "xBE68539007547034", "BE685390075470341"]
    got = {r["doc_id"]: r["spans"] for r in pii.pii_report(spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")).collect()}
    assert [x for i in range(5) for x in got[i].split(",") if "iban" in x] == ["iban:0:19", "iban:0:16", "iban:0:27", "iban:6:28", "iban:0:18"]
    assert not any("iban" in got[i] for i in range(5, 10))


def test_very_many_matches(spark):
    import re
    import time

    n = 320_000
    text = "é " + " ".join(f"a{i % 7}@b.c +1555123456{i % 10}" for i in range(n // 2)) + " end"
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    began = time.time()
    got = pii.pii_report(df).where("doc_id = 1").select("n_email", "n_ip", "n_card", "n_phone", "base_sha256").first()
    assert tuple(got) == brute.pii(text)
    masked = pii.mask_pii(df).where("doc_id = 1").first()["text"]
    assert masked == "é " + " ".join(["<EMAIL> <PHONE>"] * (n // 2)) + " end"
    assert re.search("@|[0-9]", masked) is None
    assert time.time() - began < 240


def test_masking_across_blocks(spark, monkeypatch):
    from denspark.llm import scans

    monkeypatch.setattr(scans, "BLOCK", 7)
    monkeypatch.setattr(scans, "CHUNK", 2)
    text = "é😀 " + "".join(f"{'x' * k} a@b.c{'-' * (k % 3)} +1.2.3.45.678 " for k in range(30)) + "tail of it"
    want = "é😀 " + "".join(f"{'x' * k} <EMAIL> <PHONE> " for k in range(30)) + "tail of it"
    columns = "doc_id long, text string, pii_spans int, spans string, body string, `a.b` long, row string, n_chars int"
    df = spark.createDataFrame([(1, text, 7, "s", "b", 5, "r", 1), (2, None, None, None, None, None, None, None)], columns)
    rows = {r["doc_id"]: r for r in pii.mask_pii(df).collect()}
    assert pii.mask_pii(df).schema == df.schema
    assert tuple(rows[1]) == (1, want, 7, "s", "b", 5, "r", len(want))
    assert tuple(rows[2]) == (2, *[None] * 7)
    assert pii.find_spans(df, into="found").columns == [*df.columns, "found"]


def test_masking(docs, spark, empty):
    masked = pii.mask_pii(docs)
    assert masked.columns == docs.columns
    text = next(r["text"] for r in masked.collect() if r["text"] and r["text"].startswith("Mail"))
    assert text.startswith("Mail <EMAIL><EMAIL>, a.b@c..d <EMAIL>. Call <PHONE> or +12, host <IP> 1.2.3.256 <IP>.5 card <CARD> and")
    assert text.endswith("é😀 <EMAIL>")
    changed = masked.where(F.col("text").contains("<EMAIL>")).first()
    assert changed["n_chars"] == len(changed["text"])
    clean = lambda df: multiset(df.where(~F.coalesce(F.col("text").rlike("<|@|[0-9]"), F.lit(False))))
    assert clean(masked) == clean(docs.where(~F.coalesce(F.col("text").rlike("@"), F.lit(False))))
    assert pii.mask_pii(empty).count() == 0


def test_licences(docs, rows, empty):
    got = multiset(license_scan.license_scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"))
    assert got == Counter((d, *brute.licenses(t)) for d, t in rows)
    tagged = license_scan.license_scan(docs).where("score = 1").first()
    assert tagged["labels"] == "apache,cc-by,gpl,mit"
    assert tagged["expressions"] == "mit apache-2.0 or gpl-2.0-only classpath-exception-2.0 with and"
    assert license_scan.license_scan(empty).count() == 0


def test_licence_expressions():
    for text, want in [("MIT", ["mit"]), ("a OR b AND c", ["a", "b", "c", "and", "or"]), ("(a OR b) AND c", ["a", "b", "or", "c", "and"]), ("a WITH e", ["a", "e", "with"]), ("OR a", None), ("(a", ["a"]), ("a AND (b OR c", ["a", "b", "c", "or", "and"]), ("a/b", ["a", "b", "or"]), ("", None), ("MIT some words", ["mit"])]:
        assert license_scan.to_postfix(text) == want
    assert license_scan.evaluate(["mit", "gpl-3.0", "or"]) == ({"mit", "gpl"}, True)
    assert license_scan.evaluate(["mit", "gpl-3.0", "and"]) == ({"mit", "gpl"}, False)


def test_licence_verdicts_against_plain_searches(spark):
    import random

    rng = random.Random(12)
    names = ["MIT", "Apache-2.0", "GPL-2.0-only", "GPL-3.0+", "BSD-3-Clause", "CC-BY-SA-4.0", "LicenseRef-own", "mitsubishi", "contact", "this", "Apache-9.0", "LGPL-2.1-or-later", "Zlib-acknowledgement", "CeCILL-2.1"]
    glue = [" OR ", " and ", " AND ", " WITH Classpath-exception-2.0 ", " with ", " (", ") ", "/", " ", "\n", ". ", ", "]
    lead = ["SPDX-License-Identifier: ", "SPDX License Identifier ", "spdx license identifier: ", 'License-Expression = "', "license ", "SPDX-License-Identifiers: "]
    phrases = license_scan.NOTICES | license_scan.BASE
    texts = ["SPDX License Identifier: MIT", "SPDX-License-Identifier: MIT or contact us", "SPDX-License-Identifier: Apache-2.0 and this file is free", "SPDX-License-Identifier: MIT and", "SPDX-License-Identifier: mitsubishi", "SPDX-License-Identifier:", "x SPDX-License-Identifier"]
    for _ in range(300):
        text = "".join(rng.choice([rng.choice(lead), rng.choice(names), rng.choice(glue), rng.choice(glue), rng.choice(names), " " + rng.choice(list(phrases)).title() + " "]) for _ in range(rng.randint(1, 12)))
        texts.append(text)
    got = {r["doc_id"]: r for r in license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    exception = lambda x: bool(license_scan._EXCEPTION.fullmatch(x))
    for i, text in enumerate(texts):
        labels, score, choices = brute.license_verdict(text, phrases, license_scan.TAGS, license_scan.weight, license_scan.label_of, exception, lambda x: x in license_scan.OPEN)
        assert (got[i]["labels"], got[i]["score"]) == (labels, score), text
        if choices:
            assert got[i]["is_open"] == (all(choices) and all(x in license_scan.OPEN for x in got[i]["base_labels"].split(",") if x)), text
        else:
            assert got[i]["is_open"] == (bool(labels) and all(x in license_scan.OPEN for x in labels.split(","))), text
    assert [got[i]["labels"] for i in range(7)] == ["mit", "mit", "apache", "mit", "", "", ""]
    assert {0.0, 0.5, 0.95, 1.0} <= {r["score"] for r in got.values()}
    assert len({r["score"] for r in got.values()}) > 6


def test_valid_parts_of_expressions_and_own_tables(spark):
    texts = ["(MIT OR Apache-2.0", "Zlib-acknowledgement OR MIT", "MPL-2.0-no-copyleft-exception", "MIT/Apache-2.0", "some-name AND other-name", "CeCILL-2.1 OR GPL-2.0+", "House-1.0"]
    docs = spark.createDataFrame([(i, f"SPDX-License-Identifier: {t}") for i, t in enumerate(texts)], "doc_id long, text string")
    got = [(r["labels"], r["score"]) for r in license_scan.license_scan(docs).orderBy("doc_id").collect()]
    assert got == [("apache,mit", 1.0), ("mit", 1.0), ("mpl", 1.0), ("apache,mit", 1.0), ("", 0.0), ("cecill,gpl", 1.0), ("", 0.0)]
    own = license_scan.license_scan(docs.selectExpr("doc_id", "concat(text, ' our own terms') as text"), {"our own terms": "own"}, {"house": ("house", "1.0")}).orderBy("doc_id").collect()
    assert [r["labels"] for r in own] == ["own"] * 6 + ["house,own"]
