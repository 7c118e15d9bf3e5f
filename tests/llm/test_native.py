"""URL filters, chat formatting, mixing, and the pipeline."""

import hashlib
import math
import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from denspark.llm import chat_format, mixing, url_filter

PLAN = re.compile("Python|Pandas|Arrow")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def oracle(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    return sorted((tuple(r) for r in con.sql(sql).fetchall()), key=str)


URLS = [None, "", "no scheme", "http://", "https://example.net/en/1", "https://a.b.EXAMPLE.net/en/x?q#f", "http://example.net/fr/", "http://badexample.net/en/", "ftp://x.org/fr/", "x://org/fr/a", "http://example.com/de/", "http://www.example.com/de", "http://a.example.com/de/x/../y", "http://net", "http://net/", "http://com.net.org/fr/#/net/", "http://ünï.net/ä", "http://a..net/", "http://net./", "x://y://z.net/p"]


def test_urls(spark):
    pages = spark.createDataFrame([(i % 18, u, "h", 1) for i, u in enumerate(URLS * 2)], "page_id long, url string, rule string, row long").repartition(5)
    got = url_filter.url_filter(pages)
    assert rows_of(got) == oracle(f"SELECT page_id, host, path, rule, verdict FROM ({url_filter.ORACLE_SQL})", pages=pages)
    assert url_filter.url_filter(spark.createDataFrame([], pages.schema)).count() == 0


def test_nested_rules_over_many_partitions(spark):
    rules = [("block", "com", "/"), ("allow", "com", "/a/"), ("block", "com", "/a/b"), ("allow", "x.com", "/"), ("block", "x.com", "/a/b/c/"), ("allow", "com", "/a/b/c")]
    hosts, paths = ["com", "x.com", "y.x.com", "ax.com", "org"], ["/", "/a", "/a/", "/a/b", "/a/bz", "/a/b/c/d", "/b", ""]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] * 9
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = {(r["host"], r["path"]): (r["rule"], r["verdict"]) for r in url_filter.url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), url_filter.rule_table(spark, rules)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for h in hosts:
        for p in paths:
            fits = [(len(rh + rp), len(rh), rh + rp, v) for v, rh, rp in rules if (h == rh or h.endswith("." + rh)) and p.startswith(rp)]
            want = max(fits)[2:] if fits else (None, "allow")
            assert got[h, p] == want, (h, p)


def conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|> <\\|x <\\\\| ok"), (2, 3, "assistant", None), (2, 1, None, "a\nb"), (2, 2, "us%0A\ner%", "x"), (3, 0, "user", ""), (3, 0, "user", ""), (4, 0, "assistant", "é😀"), (None, 0, "user", "u"), (None, 1, "assistant", "v")]
    rows += [(5, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(37)]
    return spark.createDataFrame([(*r, "leaf", 1) for r in rows], "conv_id long, turn long, role string, text string, leaf string, node long")


def test_conversations(spark):
    df = conversations(spark)
    got = chat_format.chat_report(df)
    assert rows_of(got) == oracle(f"SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars FROM ({chat_format.ORACLE_SQL})", conversations=df)
    assert not PLAN.search(got._jdf.queryExecution().toString())
    assert chat_format.chat_report(spark.createDataFrame([], df.schema)).count() == 1


def test_branches(spark):
    rows = [(1, 0, None, 1.0), (1, 1, 0, 5.0), (1, 2, 0, 2.0), (1, 3, 2, 4.0), (1, 4, 3, 1.0), (1, 5, 2, 1.0), (2, 0, 99, 1.0), (2, 1, 0, 1.0), (3, 0, 1, 1.0), (3, 1, 0, 1.0), (3, 2, 1, 1.0)]
    messages = spark.createDataFrame([(c, n, p, "user", f"m{n}", s) for c, n, p, s in rows], "conv long, node long, parent long, role string, text string, score double")

    def paths(keep):
        out = defaultdict(list)
        for r in sorted(chat_format.branches(messages, keep).collect(), key=lambda r: -r["back"]):
            out[r["conv"], r["leaf"]].append(r["text"])
        return dict(out)

    assert paths(1) == {(1, 4): ["m0", "m2", "m3", "m4"], (2, 1): ["m0", "m1"]}
    assert set(paths(2)) == {(1, 4), (1, 1), (2, 1)}
    text = chat_format.format_turns(chat_format.branches(messages, 1)).where("conv = 2").first()["formatted"]
    assert text == "<|im_start|>user\nm0<|im_end|>\n<|im_start|>user\nm1<|im_end|>\n"


def test_mix(docs, rows, empty):
    got = mixing.mix(docs)
    # Rows that share id and text share a draw, as in the SQL.
    assert rows_of(got.select("doc_id", "size", "source_size", "taken", "copies")) == oracle(f"SELECT doc_id, size, source_size, taken, copies FROM ({mixing.ORACLE_SQL})", documents=docs)
    taken, target, largest = defaultdict(int), {}, defaultdict(int)
    for r in got.collect():
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert r["taken"] <= 2 * r["size"]
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in target)
    assert math.isclose(sum(target.values()), 1.5 * sum(r["size"] for r in got.collect()), rel_tol=1e-9)
    assert mixing.mix(empty).count() == 0
    assert not PLAN.search(got._jdf.queryExecution().toString())


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 1000, 5], [0, 4, 0], [7], [3, 3, 900, 2, 2]])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    w = [mixing.WEIGHTS[i % 3] for i in range(len(sizes))]
    stopped, left = {}, 1.5 * sum(sizes)
    while True:
        free = [i for i in range(len(sizes)) if i not in stopped]
        share = {i: (left - sum(stopped.values())) * w[i] / sum(w[j] for j in free) for i in free}
        over = {i: 2 * sizes[i] for i in free if share[i] > 2 * sizes[i]}
        if not over:
            break
        stopped |= over
    want = stopped | share
    assert all(math.isclose(got[f"s{i}"], want[i], abs_tol=1e-9) for i in want)


def test_take_mix_takes_what_mix_says(docs):
    taken = mixing.take_mix(docs)
    assert taken.columns == [c for c in docs.columns if c != "copies"] + ["copies"]
    want = mixing.mix(docs).where("copies > 0").groupBy("doc_id").agg(F.sum("copies").alias("n"))
    assert rows_of(taken.groupBy("doc_id").agg(F.sum("copies").alias("n"))) == rows_of(want)


def test_pipeline(spark, tmp_path, docs, rows):
    import brute
    import corpus_pipeline

    # One row for each id, as the tables have it, and long enough to be judged.
    texts = {d: t for d, t in rows if d is not None}
    texts |= {100: "Please write to someone@example.org soon. " + " ".join(f"word{i}" for i in range(60)), 101: texts[9] + " tail end", 102: None}
    items = [(0, " ".join(texts[26].split()[10:50]))]
    spark.createDataFrame([(d, t, "en", f"s{d % 3}", len(t or "")) for d, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    seen = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = seen.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in seen.collect()}
        path = str(tmp_path / f"out{k}")
        stage(spark, seen, str(tmp_path)).write.parquet(path)
        seen = spark.read.parquet(path)
        after = {r["doc_id"]: r["text"] for r in seen.collect()}
        if k < 4:
            assert seen.columns == columns
        if k == 0:
            assert not any(brute.quality(t)[-1] for t in after.values())
        elif k == 1:
            assert set(after) == {d for d, (_, c, _) in brute.components(list(before.items())).items() if c == d}
        elif k == 2:
            assert set(before) - set(after) == {26} & set(before)
        elif k == 3:
            assert set(after) == set(before)
            assert all(sum(brute.pii(t)[:4]) == 0 for t in after.values())
        else:
            assert {d: after[d] for d in after} == {d: before[d] for d in after}
            assert seen.where("copies < 1").count() == 0
    run = {r["doc_id"]: (hashlib.md5(r["text"].encode()).hexdigest(), r["copies"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert run == {r["doc_id"]: (hashlib.md5(r["text"].encode()).hexdigest(), r["copies"]) for r in seen.collect()}


def test_long_documents_are_drawn_more_often(spark):
    sizes = [10, 20, 40, 80]
    rows = [(i, " ".join(["w"] * sizes[i % 4]), f"s{i % 3}") for i in range(9000)] + [(9000, "w " * 20_000, "s0"), (9001, "", "s1")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    groups = defaultdict(list)
    for r in got:
        whole = math.floor(r["target"] / r["source_size"])
        groups[r["source"], r["size"], whole, r["chance"]].append(r["copies"] - whole)
    partial = {k: v for k, v in groups.items() if 0 < k[3] < 1}
    assert len(partial) >= 6
    for (_, _, _, chance), extra in partial.items():
        assert abs(sum(extra) / len(extra) - chance) < 4.5 * math.sqrt(chance * (1 - chance) / len(extra))
    for source in {k[0] for k in partial}:
        own = sorted((k[1], k[3]) for k in partial if k[0] == source)
        assert all(math.isclose(a[1] / a[0], b[1] / b[0]) for a, b in zip(own, own[1:], strict=False))
    # A document so long that its share would be over 1 is certain, and one without words never taken in.
    (long,) = (r for r in got if r["doc_id"] == 9000)
    assert long["chance"] == 1 or long["copies"] == 2
    assert next(r for r in got if r["doc_id"] == 9001)["taken"] == 0


def test_order_of_ranks_is_not_that_of_the_random_odds(spark):
    rows = [(i, " ".join(["w"] * (5 if i % 2 else 100)), "a") for i in range(2000)] + [(5000 + i, "w " * 50, "b") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in mixing.mix(df, weights=(1, 1)).collect()}
    odds = {r["doc_id"]: r["odds"] for r in df.select("doc_id", mixing._odds().alias("odds")).collect()}
    part = [d for d in got if d < 5000 and 0 < got[d]["chance"] < 1]
    taken = [d for d in part if got[d]["copies"] > min(got[x]["copies"] for x in part)]
    rest = [d for d in part if d not in set(taken)]
    assert taken
    assert rest
    assert max(odds[d] for d in taken) > min(odds[d] for d in rest)


#: Names that helpers of the stages use themselves.
CLASHING = "doc_id long, text string, lang string, source string, n_chars int, row string, node long, body string, spans string, pii_spans string, `key` long, _node long, _of string, _id long, kept boolean, id long, size int, rank double"


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_columns_of_any_name(spark, tmp_path, k):
    import corpus_pipeline

    spark.createDataFrame([(0, "some words that stand in no document here"), (1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    good = "Write to me@example.org about " + " ".join(f"word{i}" for i in range(40))
    rest = ("r", 7, "b", "s", "p", 2, 3, "o", 4, True, 5, 6, 0.5)
    docs = [(1, good, "en", "a", len(good), *rest), (1, good, "en", "a", len(good), *rest), (None, good + " tail", None, None, None, *([None] * 13)), (2, None, None, None, None, *([None] * 13)), (3, "", "en", "a", 0, *rest)]
    docs = spark.createDataFrame(docs, CLASHING)
    stage = corpus_pipeline.STAGES[k][1]
    out = stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    rows = sorted(out.collect(), key=str)
    # Quality drops null and empty texts; near duplicates keep them and one of the copies; the others keep every row.
    assert len(rows) == (3, 3, 5, 5)[k]
    keys = docs.columns[5:]
    assert {tuple(r[c] for c in keys) for r in rows} <= {rest, (None,) * 13}
    if k == 3:
        masked = next(r for r in rows if r["doc_id"] == 1)
        assert masked["text"].startswith("Write to <EMAIL> about")
        assert masked["n_chars"] == len(masked["text"])
    nothing = stage(spark, docs.where("false"), str(tmp_path))
    assert (nothing.columns, nothing.count()) == (docs.columns, 0)


def test_mixing_stage_with_nulls_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    stage = corpus_pipeline.STAGES[4][1]
    docs = spark.createDataFrame([(None, None, None, 5, "r"), (1, "a b c", None, 6, "r"), (1, "a b c", None, 6, "r"), (2, "", "s", 7, "r")], "doc_id long, text string, source string, copies long, row string")
    out = stage(spark, docs, str(tmp_path))
    assert out.columns == ["doc_id", "text", "source", "row", "copies"]
    assert {r["doc_id"] for r in out.collect()} <= {1, 2, None}
    assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
