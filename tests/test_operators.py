import hashlib
import itertools
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.functions import minhash as M
from gleanery.functions import text as T
from gleanery.operators import coverage, embedding, evaluate, labels, linkage, metrics
from gleanery.operators.components import connected_components
from gleanery.plans import docket
from gleanery.sources import records, store
from gleanery.streaming import exact


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def brute_linkage(d, below):
    groups = [[i] for i in range(len(d))]
    while True:
        best = min(((max(d[i][j] for i in a for j in b), x, y) for x, a in enumerate(groups) for y, b in enumerate(groups) if x < y), default=(1e9, 0, 0))
        if best[0] >= below:
            return sorted(sorted(g) for g in groups)
        groups[best[1]] += groups.pop(best[2])


def test_complete_linkage_equals_brute_force():
    draw = np.random.default_rng(1)
    for n in (1, 2, 5, 12):
        for _ in range(10):
            x = draw.normal(size=(n, 2))
            d = np.linalg.norm(x[:, None] - x[None], axis=2)
            label = linkage.complete_linkage(d, 1.0)
            assert sorted(sorted(np.flatnonzero(label == k).tolist()) for k in set(label.tolist())) == brute_linkage(d, 1.0)


def test_linkage_refuses_to_chain_and_is_strict():
    chain = np.array([[0, 0.3, 0.6], [0.3, 0, 0.3], [0.6, 0.3, 0]])
    assert len(set(linkage.complete_linkage(chain, 0.5).tolist())) == 2
    assert len(set(linkage.complete_linkage(np.array([[0, 0.5], [0.5, 0]]), 0.5).tolist())) == 2


def test_oversized_component_is_flagged(spark):
    vectors = spark.createDataFrame([(i, [1.0, 0.0], str(i)) for i in range(5)], "id long, vec array<double>, same string")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(4)], "i long, j long")
    assert {r.linkage for r in linkage.semantic_clusters(vectors, pairs, 0.9, most=3).collect()} == {"single"}
    alike = vectors.withColumn("same", F.lit("x"))
    assert {(r.cluster_id, r.linkage) for r in linkage.semantic_clusters(alike, pairs, 0.9, most=3).collect()} == {(0, "complete")}


def test_components_on_a_long_path_and_none(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    found = {r.node: r.component for r in connected_components(path, "a", "b").collect()}
    assert found == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert connected_components(path.where("a > 1000"), "a", "b").count() == 0


def test_exact_signature_wraps_and_marks_empty():
    hasher = M.ExactHasher(8)
    assert (hasher.signature([]) == np.iinfo(np.uint64).max).all()
    a, b = hasher.signature(["x y", "y z"]), hasher.signature(["y z", "x y"])
    assert (a == b).all() and (a < M.MERSENNE).all()


def test_shingles(spark):
    assert one(spark, T.shingles_of(T.words("t")), t="A b, c") == ["a b c"]
    assert one(spark, T.shingles_of(T.words("t")), t="...") == []
    assert one(spark, T.shingles_of(T.words("t"), 2), t="a b a b") == ["a b", "b a"]
    assert one(spark, T.words("t"), t="café d'or") == ["caf", "d'or"]


def test_assemble_order_and_sources(spark):
    pick = lambda body, *a: tuple(one(spark, T.assembled("b", "a", unicode=True), b=body, a=list(a)))
    assert pick("I object.", "long text") == ("I object.", "body")
    assert pick("See attached", "one", "two") == ("one two", "attachment")
    assert pick("Acme hereby submits the attached letter.") == ("Acme hereby submits the attached letter.", "body")
    assert pick("Acme hereby submits the attached letter.", "the letter") == ("the letter", "attachment")
    assert pick("", "  ") == ("", "none")
    assert pick("ﬁne text") == ("fine text", "body")


def test_records_round_trip(spark, tmp_path):
    (tmp_path / "A-2020-0001-0002(1).json").write_text('{"data": {"attributes": {"comment": "Hi", "duplicateComments": 3}, "relationships": {"attachments": {"data": [{"id": "1"}]}}}}')
    row = records.read_records(spark, str(tmp_path)).first()
    assert (row.id, row.comment, row.duplicateComments, row.city, row.has_attachment) == ("A-2020-0001-0002", "Hi", 3, None, True)
    (tmp_path / "t").mkdir()
    for n, text in ((10, "ten"), (2, "two")):
        (tmp_path / "t" / f"A-2020-0001-0002_attachment_{n}_extracted.txt").write_text(text)
    texts = records.read_attachments(spark, str(tmp_path / "t"))
    rows = spark.createDataFrame([("A-2020-0001-0002", "See attached", 0)], "id string, comment string, duplicateComments long")
    got = records.corpus(rows, texts).first()
    assert (got.text, got.source, got.n_attachments, got.dc_populated) == ("ten two", "attachment", 2, False)


def test_submissions_unknown_is_not_one(spark):
    def total(*v):
        rows = spark.createDataFrame([(x,) for x in v], "dc long")
        r = rows.agg(*(c.alias(k) for k, c in metrics.submissions("dc").items())).first()
        return r.total, r.populated_records, r.field_populated

    assert total(None, 0) == (None, 0, False)
    assert total(None, 0, 1, 500) == (503, 1, True)


def test_thresholds(spark):
    rows = lambda *v: spark.createDataFrame(list(v), "score double, y int")
    pick = lambda r: evaluate.select_threshold(r, "score", F.col("y") == 1).first().threshold
    assert pick(rows((0.9, 1), (0.8, 1), (0.7, 0))) == 0.8
    assert pick(rows((0.9, 1), (0.9, 0))) is None
    kappa = lambda *v: evaluate.kappa(spark.createDataFrame(list(v), "a int, b int"), "a", "b").first().kappa
    assert kappa((1, 1), (0, 0)) == 1 and kappa((1, 1), (1, 1)) == 1 and kappa((1, 0), (0, 1)) < 0 and kappa() is None
    assert tuple(evaluate.bootstrap_kappa(rows((0.1, 1)), "score", "y", "y", 10).first()) == (None, None)


def test_draws_are_the_hashes(spark):
    rows = [(r, p) for r in (0, 9, 10, 101) for p in range(1234)]
    want = spark.createDataFrame(rows, "r long, p long").select(evaluate.draw(F.col("r"), F.col("p"), F.lit(1234), 3)).collect()
    got = {r: {} for r in range(102)}
    place = dict.fromkeys(got, 0)
    for lo, block in evaluate.draws(0, 102, 1234, 3):
        for r, ks in enumerate(block.tolist(), lo):
            got[r] |= dict(enumerate(ks, place[r]))
            place[r] += len(ks)
    assert [w[0] for w in want] == [got[r][p] for r, p in rows]


def test_bootstrap_makes_no_row_a_draw(spark):
    rows = spark.range(3000, numPartitions=7).select(F.when(F.col("id") > 0, (F.col("id") * 37) % 4001).alias("key"), (F.col("id") % 2).alias("a"), F.when(F.col("id") % 11 > 0, F.least(F.col("id") % 2, F.col("id") % 5)).alias("b"))
    got = evaluate.bootstrap_kappa(rows, "key", "a", "b", 60)
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    by_key = sorted(rows.collect(), key=lambda r: (r.key is None, r.key))
    n, values = len(by_key), []
    for r in range(60):
        some = [by_key[int(hashlib.md5(f"3:{r}:{p}".encode()).hexdigest()[:7], 16) % n] for p in range(n)]
        sa, sb = sum(x.a for x in some), sum(x.b or 0 for x in some)
        chance = sa * sb + (n - sa) * (n - sb)
        values.append((sum(x.a == x.b for x in some) * n - chance) / (n * n - chance))
    values.sort()
    assert tuple(got.first()) == (values[1], values[58])


def test_agreement_report_makes_no_row_a_draw_and_puts_null_keys_last(spark):
    rows = spark.createDataFrame([(None if i == 5 else i, "same" if i % 3 else "variant", "same" if i % 7 else "distinct") for i in range(40)], "pair long, machine string, human string")
    got = labels.agreement_report(rows, "pair", "machine", "human", 40)
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    bits = [(i % 3 > 0, i % 7 > 0) for i in (*range(5), *range(6, 40), 5)]
    values = []
    for r in range(40):
        some = [bits[int(hashlib.md5(f"3:{r}:{p}".encode()).hexdigest()[:7], 16) % 40] for p in range(40)]
        sa, sb = (sum(x) for x in zip(*some, strict=True))
        chance = sa * sb + (40 - sa) * (40 - sb)
        values.append((sum(x == y for x, y in some) * 40 - chance) / (1600 - chance))
    values.sort()
    assert (got.first().low, got.first().high) == (round(values[1], 3), round(values[39], 3))


def test_agreement_report_joins_no_counts_and_keeps_null_labels(spark):
    rows = [(i, ("same", "variant", None)[i % 3], ("same", None, "variant", "distinct")[i % 4]) for i in range(30)]
    got = labels.agreement_report(spark.createDataFrame(rows, "pair long, machine string, human string"), "pair", "machine", "human", 10)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "HashJoin" not in plan and "SortMergeJoin" not in plan and plan.count("BroadcastExchange") <= 2  # jobs to labels, the interval's row

    def kappa(pairs):
        a, b = (Counter(x) for x in zip(*pairs, strict=True))
        chance = sum(a[x] * b[x] for x in a if x is not None) / 900
        return (sum(x is not None and x == y for x, y in pairs) / 30 - chance) / (1 - chance)

    pairs = [r[1:] for r in rows]
    merge = [tuple("merge" if x == "same" else "keep" for x in r) for r in pairs]
    one = got.first()
    assert (one.kappa, one.kappa_merge) == (round(kappa(pairs), 4), round(kappa(merge), 4))
    assert (one.pairs_compared, one.disagreements) == (30, sum(x is None or x != y for x, y in pairs))


def test_encoder_budget_and_batches(spark):
    def call(text):
        if len(text) > 100:
            raise embedding.TooLong
        return np.array([len(text)])

    assert 50 < embedding.encode_within("x" * 1000, call)[0] <= 100
    assert embedding.encode_within("", call)[0] == 1
    assert [len(x) for x in embedding.beginnings("x" * 1000, 100)][:5] == [400, 200, 100, 64, 64]
    with pytest.raises(embedding.TooLong):
        embedding.encode_within("x" * 1000, lambda t: (_ for _ in ()).throw(embedding.TooLong()))
    waited, answers = [], iter([ValueError(), ValueError(), np.ones(1)])

    def flaky(text):
        x = next(answers)
        if isinstance(x, Exception):
            raise x
        return x

    assert embedding.encode_within("a", flaky, sleep=waited.append)[0] == 1 and waited == [2.0, 4.0]
    with pytest.raises(ValueError):
        embedding.encode_within("a", lambda t: (_ for _ in ()).throw(ValueError()), sleep=waited.append)
    assert len(waited) == 2 + embedding.CALLS - 1
    lines = spark.createDataFrame([('{"recordId":"1","modelOutput":{"embedding":[1.0]}}',)], "value string")
    want = spark.createDataFrame([(1,), (2,)], "id long")
    with pytest.raises(Exception, match="no vector for 2"):
        embedding.batch_output(lines, want, "id").collect()


class Fake:
    def encode(self, texts):
        return np.array([[len(t.split()), 1.0] for t in texts])


def test_embedding_is_of_unit_length(spark):
    docs = spark.createDataFrame([(1, "a " * 400), (2, None)], "id long, text string")
    got = {r.id: r.vec for r in embedding.embedded(docs, "id", "text", Fake).collect()}
    assert all(abs(np.linalg.norm(v) - 1) < 1e-9 for v in got.values()) and len(got) == 2


class Call:
    def __call__(self, text):
        if len(text) > 300:
            raise embedding.TooLong
        return np.array([len(text), 1.0])


def test_remote_arms(spark):
    docs = spark.createDataFrame([(1, "a " * 400), (2, None), (3, " ")], "id long, text string")
    matched = {r.id: r.vec for r in embedding.embedded(docs, "id", "text", Fake, skip_blank=True).collect()}
    assert abs(np.linalg.norm(matched[1]) - 1) < 1e-9 and not any(matched[2]) and not any(matched[3])
    whole = {r.id: r.vec for r in embedding.embedded_whole(docs, "id", "text", Call, tokens=300).collect()}
    assert whole[1] == pytest.approx([300 / np.hypot(300, 1), 1 / np.hypot(300, 1)]) and whole[2] == whole[3] == pytest.approx([0.5**0.5, 0.5**0.5])


def test_large_buckets_are_paired_exactly(spark):
    draw = np.random.default_rng(3)
    base = draw.integers(0, 100, 32)
    rows = []
    for i in range(120):
        sig = base.copy()
        sig[draw.choice(np.arange(4, 32), int(draw.integers(1, 18)), replace=False)] = 1000 + i
        rows.append((i, sig.tolist(), "x" if i % 2 else "y"))
    signed = spark.createDataFrame(rows, "id long, sig array<long>, by string")
    like = lambda a, b: (np.array(a) == np.array(b)).mean()
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[2] == b[2] and like(a[1], b[1]) >= 0.6}
    for largest in (7, 200):
        got = M.near_pairs(signed, 0.6, 8, 4, ("by",), largest).collect()
        assert {(r.i, r.j) for r in got} == want and len(got) == len(want) and want


def test_gaps_over_ranges(spark):
    numbers = [0, 1, 9, 10, 11, 25, 61, 62, 100]
    rows = spark.createDataFrame([(n,) for n in numbers], "n long")
    want = {(a + 1, b - 1) for a, b in itertools.pairwise(numbers) if b > a + 1}
    for width in (10, 1 << 20):
        assert {(r.first_missing, r.last_missing) for r in coverage.gaps(rows, "n", width=width).collect()} == want


def test_store_and_cache(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "root"))
    assert s.names() == [] and not s.exists("a/b")
    s.put("a/b", b"one")
    s.put("a/b", b"two")
    (tmp_path / "local").write_bytes(b"three")
    s.upload(str(tmp_path / "local"), "a/c")
    assert s.get("a/b") == b"two" and s.get("a/c") == b"three" and s.names() == ["a/b", "a/c"] and s.names("a") == ["a/b", "a/c"]
    assert s.uri("a/b").endswith("root/a/b")
    calls = []
    fetch = lambda: calls.append(1) or "the rule"
    assert store.fetched_once(s, "rule.txt", fetch) == store.fetched_once(s, "rule.txt", fetch) == "the rule" and len(calls) == 1


def test_sinks_and_labels(spark, tmp_path):
    at = lambda x: str(tmp_path / x)
    rows = spark.createDataFrame([(1, "a", 2, [0.5, 1.0])], "id long, text_clean string, duplicateComments long, vec array<double>")
    records.write_clean(rows, at("clean"))
    assert [tuple(r) for r in spark.read.json(at("clean")).select("id", "text", "duplicateComments").collect()] == [(1, "a", 2)]
    records.write_vectors(rows, at("vectors"))
    assert spark.read.parquet(at("vectors")).first().vec == [0.5, 1.0]
    (tmp_path / "labels.json").write_text('{"0": "same", "1": "unusable", "2": "distinct"}')
    read = records.read_labels(spark, at("labels.json")).withColumnRenamed("pair_id", "pair")
    sample = spark.createDataFrame([("0", 0.9), ("1", 0.8), ("2", 0.7), ("3", 0.6)], "pair string, score double")
    got = {r.pair: (r.label, r.positive) for r in labels.labelled(read, sample).collect()}
    assert got == {"0": ("same", True), "2": ("distinct", False)}
    tasks = spark.createDataFrame([(0, "same")], "pair long, label string")
    records.write_tasks(tasks, at("tasks"), ["choose one", "or none"])
    (tmp_path / "both.jsonl").write_text("# choose one\n#\n" + '{"pair": 0, "label": "same"}\n\n')
    assert [tuple(r) for r in records.read_tasks(spark, at("both.jsonl"), "pair long, label string").collect()] == [(0, "same")]
    assert spark.read.text(at("tasks-header")).count() == 2


def test_merge_predicates_and_bundles(spark):
    rows = spark.createDataFrame([("k", "k", [1, 2, 3, 4], [1, 2, 3, 9], [0.6, 0.8], [0.8, 0.6])], "a string, b string, s array<long>, t array<long>, u array<double>, v array<double>")
    pick = lambda rung, a, b, t=None: rows.select(labels.merges(rung, F.col(a), F.col(b), t).alias("x")).first().x
    assert pick("exact", "a", "b") and pick("near", "s", "t", 0.75) and not pick("near", "s", "t", 0.76)
    assert pick("semantic", "u", "v", 0.95) and not pick("semantic", "u", "v", 0.97)
    with pytest.raises(ValueError):
        pick("other", "a", "b")
    letters = lambda t: one(spark, T.bundled("t", 10), t=t)
    assert letters("Dear Sir, no. " * 5) == 5 and letters("") == 0 and letters("short") == 1


def test_prefixes_and_ids(spark):
    assert one(spark, T.listing_prefix("comments", F.lit("D-1"), F.lit("A")), t="") == "raw-data/A/D-1/text-D-1/comments/"
    assert one(spark, T.listing_prefix("attachments", F.lit("D-1"), F.lit("A")), t="") == "raw-data/A/D-1/binary-D-1/comments_attachments/"
    assert "pdfminer" in one(spark, T.listing_prefix("extracted", F.lit("D-1"), F.lit("A")), t="")
    assert one(spark, T.any_comment_id("t"), t="x/ABC-2020-0001-0002 (3).json") == "ABC-2020-0001-0002" and one(spark, T.any_comment_id("t"), t="nothing") is None


def test_nfkc_only_where_it_changes(spark):
    texts = ["plain", "d\u00e9j\u00e0", "e\u0301", "\ufb01n \u00bd \u2460", "\u00a0x\u00aa", "\u0153uvre", None, ""]
    rows = spark.createDataFrame([(x,) for x in texts], "t string")
    got = [r.x for r in rows.select(T.nfkc(F.col("t")).alias("x")).collect()]
    assert got == [x and unicodedata.normalize("NFKC", x) for x in texts]
    assert all(unicodedata.normalize("NFKC", chr(c)) == chr(c) for c in range(256) if not re.search(T.COMPOSED, chr(c)))


def test_whole_components_are_flagged_in_the_ladder(spark, monkeypatch):
    rows = [(i, "d", f"text number {i} " + "same words in every one of these texts " * 3, "body", 0) for i in range(6)]
    corpus = spark.createDataFrame(rows, "id long, docket string, text string, source string, duplicateComments long")
    vectors = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(6)], "id long, vec array<double>")
    out = docket.run(corpus, "docket", vectors).first()
    assert (out.semantic_linkage, out.edges, out.components, out.oversized, out.semantic_clusters) == ("complete", 15, 1, [], 1)
    assert out.cosine_threshold == docket.COSINE and out.official_share is None and out.additional_collapse == 6
    monkeypatch.setattr(linkage.semantic_clusters, "__defaults__", (3,))
    flagged = docket.run(corpus, "docket", vectors).first()
    assert flagged.semantic_linkage == "MIXED: 1 component(s) by single linkage, sizes [6]"


def test_stream_windows(spark, tmp_path):
    rows = [("2020-01-01 00:00:00", "A  b"), ("2020-01-01 00:01:00", "a b"), ("2020-01-01 00:02:00", "c"), ("2020-01-01 05:00:00", "late")]
    spark.createDataFrame(rows, "ts string, text string").selectExpr("cast(ts as timestamp) ts", "text").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, text string").parquet(str(tmp_path / "in"))
    q = exact.collapse_by_window(stream, "ts", "text").writeStream.format("memory").queryName("windows").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.records, r.distinct) for r in spark.table("windows").collect()] == [(3, 2)]


def test_stream_keeps_the_first_of_each(spark, tmp_path):
    rows = [("2020-01-01 00:00:00", "A  b"), ("2020-01-01 00:01:00", "a b"), ("2020-01-01 00:02:00", "c")]
    spark.createDataFrame(rows, "ts string, text string").selectExpr("cast(ts as timestamp) ts", "text").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, text string").parquet(str(tmp_path / "in"))
    q = exact.first_of_each(stream, "ts", "text").writeStream.format("memory").queryName("firsts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("firsts").count() == 2
