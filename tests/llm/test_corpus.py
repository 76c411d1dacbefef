import zlib
from collections import Counter

import numpy as np
import pytest
from compare import database, rows
from pyspark.sql import functions as F

import corpus_pipeline
from gleanery.llm import decontamination, link_graph, mixing, quality_cnn, registry, token_packing
from gleanery.session import table


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    got = rows(registry.queries()[name](spark, sf).toPandas())
    assert got == rows(database(sf).sql(registry.oracle_sql()[name]).df())


def test_apportion_is_sainte_lague():
    draw = np.random.default_rng(2)
    for _ in range(200):
        n = int(draw.integers(1, 6))
        t, most, seats = draw.integers(0, 50, n).astype(float), draw.integers(0, 12, n), int(draw.integers(0, 30))
        given = np.zeros(n, int)
        for _ in range(seats):
            q = np.where((given < most) & (t > 0), t / (2 * given + 1), -1)
            if q.max() < 0:
                break
            given[int(q.argmax())] += 1
        assert mixing.apportion(t, most, seats).tolist() == given.tolist()


def test_targets_fill_to_caps(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, None: 2000, "d": 0}
    got = {r.source: r for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    weight, total = {"a": 3, "b": 1, "c": 2, "d": 3, None: 1}, 1.5 * sum(sizes.values())
    lo, hi = 0.0, 1e9
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(2 * sizes[k], mid * w) for k, w in weight.items()) < total else (lo, mid)
    for k, w in weight.items():
        assert got[k].target == pytest.approx(min(2 * sizes[k], hi * w), rel=1e-6, abs=1e-6)


def test_mix_is_near_its_targets(spark, sf, odd, none):
    got = mixing.mixed(table(spark, sf, "documents")).toPandas()
    assert (got["taken"] <= 2 * got["size"]).all()
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((by["taken"] / by["target"] - 1).abs() < 0.02).all()
    again = mixing.mixed(table(spark, sf, "documents").repartition(5)).toPandas()
    assert dict(zip(got.doc_id, got.taken, strict=True)) == dict(zip(again.doc_id, again.taken, strict=True))
    r = mixing.mixed(odd).collect()
    assert len(r) == odd.count() and all(x.taken <= 2 * x.size for x in r)
    assert mixing.mixed(none).count() == 0
    whole = mixing.mixed_documents(odd)
    assert whole.columns == odd.columns and whole.count() > 0 and mixing.mixed_documents(none).count() == 0


def test_taken_words_are_those_of_the_plain_form(spark, odd):
    base = spark.createDataFrame([(k, " ".join(f"w{k}x{i}" for i in range(40 + 97 * k % 1500)), "abc"[k % 3]) for k in range(60)], "doc_id long, text string, source string")
    docs = base.unionByName(odd.select("doc_id", "text", "source")).unionByName(base.where("doc_id = 5"))
    block, seed = mixing.BLOCK_WORDS, 17
    dealt = mixing._dealt(docs, (3, 1, 2), 1.5, 2, seed, "doc_id", "text", "source", ()).collect()
    want = Counter()
    for shard in {r.shard for r in dealt}:
        rows = [r for r in dealt if r.shard == shard]
        runs = {}
        for r in sorted(rows, key=lambda r: (r.source is None, r.source or "", r.order, 1 << 62 if r.id is None else r.id, r.size)):
            runs.setdefault((r.source is None, r.source or ""), []).append(r)
        runs = {k: v for k, v in runs.items() if sum(r.size for r in v)}
        total = {k: sum(r.size for r in v) for k, v in runs.items()}
        target = {k: v[0].target * total[k] / v[0].source_size for k, v in runs.items()}
        given, most = dict.fromkeys(runs, 0), {k: 2 * -(-total[k] // block) for k in runs}
        for _ in range(min(round(sum(target.values()) / block), sum(most.values()))):
            best = max((k for k in runs if given[k] < most[k]), key=lambda k: (target[k] / (2 * given[k] + 1), [-ord(c) for c in k[1]]))
            given[best] += 1
        for k, v in runs.items():
            n, rng = -(-total[k] // block), np.random.default_rng([seed, shard, int(k[0]), zlib.crc32(k[1].encode())])
            often = np.zeros(total[k], int)  # how often each word of the run is taken
            if v[0].target < mixing.LEAST_BLOCKS * block:
                words = min(round(target[k]), 2 * total[k])
                often += words // total[k]
                rest = words % total[k]
                for b in rng.permutation(n).tolist():
                    own = min(rest, min(total[k], (b + 1) * block) - b * block)
                    often[b * block : b * block + own] += 1
                    rest -= own
            else:
                for b, extra in enumerate(np.isin(np.arange(n), rng.permutation(n)[: given[k] % n])):
                    often[b * block : (b + 1) * block] += given[k] // n + extra
            at = 0
            for r in v:
                want[r.id, r.source, r.size, int(often[at : at + r.size].sum())] += 1
                at += r.size
        for r in rows:
            if (r.source is None, r.source or "") not in runs:
                want[r.id, r.source, r.size, 0] += 1
    assert Counter((r.doc_id, r.source, r.size, r.taken) for r in mixing.mixed(docs).collect()) == want


def test_small_source_leaves_the_others_in_long_runs(spark):
    text = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    docs = [(k, text(k, 3000), "large") for k in range(40)] + [(100, text(100, 15), "tiny"), (101, text(101, 700), "small"), (102, text(102, 5000), "zero")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = mixing.mixed(df).collect()
    taken, target = {}, {}
    for r in got:
        taken[r.source], target[r.source] = taken.get(r.source, 0) + r.taken, r.target
        assert r.taken <= 2 * r.size and len(r.spans) <= r.size / 256 + 3  # not cut into words
        assert sum(s.end - s.start < 256 and 0 < s.start and s.end < r.size for s in r.spans) <= 2
    assert all(abs(taken[k] - target[k]) <= 1 for k in ("tiny", "small", "zero")) and taken["large"] == pytest.approx(target["large"], rel=0.01)
    assert sum(len(r.text.split()) for r in mixing.mixed_documents(df).collect()) == sum(taken.values())


def test_urls(spark):
    pages = [(1, "HTTP://A.Example.NET/en/x?q", '<a href="https://b.example.com/z">'), (2, "https://net", None), (3, "https://x.net/", ""), (4, None, None), (5, "no scheme", ""), (6, "//x.net/", ""), (7, "https://b.example.com/fr#t", '<a HREF=//x.net/>'), (7, "https://b.example.com/fr#t", ""), (8, "https://l.org/fr/", "")]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in link_graph.judged(df).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert (got[2].host, got[2].path, got[2].rule) == ("net", "", None)
    assert (got[3].rule, got[3].verdict, got[8].rule) == ("net/", "block", "org/fr/")
    assert all((got[i].host, got[i].path, got[i].rule, got[i].verdict) == ("", "", None, "allow") for i in (4, 5, 6))
    assert got[7].trust > 0 and got[7].distrust > 0  # linked from a trusted host, links to a blocked one
    assert link_graph.judged(df.limit(0)).count() == 0


def test_leaks_are_found_and_clean_documents_left(spark, sf):
    draw = np.random.default_rng(4)
    pool = [f"{a}{b}" for a in ("lor", "mip", "tes", "quo", "vad", "nur") for b in ("an", "ep", "il", "om", "us", "ra")]
    text = lambda n: " ".join(draw.choice(pool, n))
    items = [(i, text(30)) for i in range(20)] + [(20, None), (21, ""), (22, "few words here")]
    clean = [(i, text(int(draw.integers(1, 400)))) for i in range(200)]
    leaks = []
    for i in range(20):
        w = items[i][1].split()
        for k in (3, 17):
            w[k] = "changed"
        leaks.append((1000 + i, f"{text(150)} {' '.join(w).upper()}, {text(150)}"))
    other = [(None, items[0][1]), (5000, None), (5001, ""), (5002, "x few words here y"), (5003, "few here words")]
    docs = spark.createDataFrame([(*r, "z") for r in clean + leaks + other], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()}
    assert got == {(1000 + i, i) for i in range(20)} | {(None, 0), (5002, 22)}
    assert got == {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench, block_pieces=7).collect()}
    assert decontamination.contaminated(docs.limit(0), bench).count() == 0 and decontamination.contaminated(docs, bench.limit(0)).count() == 0


def test_quotes_across_cuts_are_found(spark):
    draw = np.random.default_rng(14)
    text = lambda k, n: [f"{k}v{j}" for j in draw.integers(0, 5000, n)]
    quotes = [(59, 10, 50), (70, 11, 59), (96, 15, 81), (96, 19, 53), (96, 31, 65), (144, 63, 129), (144, 67, 101), (59, 0, 22), (48, 5, 39)]
    items = [text(f"i{k}", n) for k, (n, _, _) in enumerate(quotes)]
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    docs = [(k, " ".join(text("d", 100 + 13 * k) + items[k][a:b] + text("d", 150))) for k, (_, a, b) in enumerate(quotes)]
    docs += [(100 + k, " ".join(text("d", 90) + x[20:32] + text("d", 90))) for k, x in enumerate(items)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for pieces in (decontamination.BLOCK_PIECES, 4):
        got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(df, bench, block_pieces=pieces).collect()}
        assert got == {(k, k) for k in range(len(quotes))}


def test_copies_do_not_swell_the_fit(spark):
    text = " ".join(f"word{i}" for i in range(300))
    docs = spark.range(500, numPartitions=4).select(F.lit(text).alias("text"))
    rows = decontamination._sampled(docs, "text", 1).collect()
    assert len([r for r in rows if r.kind == 1]) == len({r.ids for r in rows if r.kind == 1}) == 9
    assert {r.n for r in rows if r.kind == 0} == {500}


def test_retrieval_against_all_passages(spark, sf):
    """Paraphrases of many items put into documents: what the exact checks alone find is what the query finds."""
    draw = np.random.default_rng(5)
    docs = [(r.doc_id, (r.text or "").split()) for r in table(spark, sf, "documents").collect()]
    vocabulary = [w for _, words in docs for w in words]
    items = [(r.item_id, r.text) for r in table(spark, "/root/testdata/sf0.1", "benchmark").collect()]
    items += [(10_000 + k, " ".join(draw.choice(vocabulary, int(draw.integers(20, 60))))) for k in range(900)]
    out = []
    for k, (i, words) in enumerate(docs):
        item = items[int(draw.integers(len(items)))][1].split()
        kept = [w if draw.random() > 0.2 else vocabulary[int(draw.integers(len(vocabulary)))] for w in item]
        at = int(draw.integers(len(words) + 1))
        out.append((i, " ".join(words[:at] + (kept if k % 2 else []) + words[at:])))
    pieces = [(i, *p) for i, t in items for p in decontamination.pieces_of(decontamination.words_of(t))]
    assert len(pieces) > decontamination.BLOCK_PIECES
    q, want = decontamination.Queries(pieces), set()
    for i, text in out:
        words = decontamination.words_of(text)
        for at in range(0, len(words), decontamination.HALF):
            near = words[max(0, at - decontamination.MARGIN) : at + decontamination.PASSAGE + decontamination.MARGIN]
            distinct = set(near)
            want |= {(i, q.items[k]) for k in range(len(pieces)) if decontamination._checked(q, k, near, distinct, 0.0)}
    df, bench = spark.createDataFrame(out, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(df, bench).collect()}
    assert len(want) > 80 and got <= want and len(got) >= 0.97 * len(want)
    clean = {r.doc_id for r in decontamination.cleaned(df, bench).collect()}
    assert clean == {i for i, _ in out} - {i for i, _ in got}


def test_rows_are_cleaned_each_by_its_own_text(spark):
    item = " ".join(f"word{i}" for i in range(40))
    rows = [(None, f"before it {item} after it"), (None, "a clean text"), (None, None), (1, ""), (1, item), (1, "clean too")]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, cosine string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert sorted(map(repr, decontamination.cleaned(docs, bench).collect())) == sorted(map(repr, docs.where("text is null or text not like '%word3%'").collect()))
    assert decontamination.cleaned(docs, bench.limit(0)).count() == 6 and decontamination.cleaned(docs.limit(0), bench).count() == 0


def test_conflicting_labels_teach_nothing(spark):
    docs = spark.createDataFrame([(i, ("good words " if i % 2 else "#### ") * 50) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    turned = labels.unionByName(labels.withColumn("quality", 1 - labels.quality).where("doc_id > 40")).unionByName(labels.where("doc_id < 9"))
    plain = {r.doc_id: r.score for r in quality_cnn.classified(docs, labels.where("doc_id <= 40")).collect()}
    assert plain == {r.doc_id: r.score for r in quality_cnn.classified(docs, turned).collect()}
    assert all((s >= 0.7) == (i % 2 == 1) for i, s in plain.items())


def test_lcs():
    draw = np.random.default_rng(6)
    for _ in range(50):
        a, b = (draw.choice([b"x", b"y", b"z"], int(draw.integers(1, 12))).tolist() for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        q = decontamination.Queries([(0, a, True)])
        assert decontamination.lcs(q.masks[0], len(a), b) == best[-1][-1]


def test_quality_on_held_out_rows(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = quality_cnn.classified(docs, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.93
    assert all(h == (quality_cnn.crc_remainder(i) == 2) for i, h in zip(got.doc_id, got.held_out, strict=True))
    r = quality_cnn.classified(odd, labels).collect()
    assert len(r) == odd.count() and all(0 <= x.score <= 1 for x in r)
    assert quality_cnn.classified(none, labels).count() == 0
    assert {x.score for x in quality_cnn.classified(odd, labels.limit(0)).collect()} == {0.5}


def test_network_gradients():
    net = quality_cnn.Network(1)
    for k in net.w:
        net.w[k] = net.w[k].astype(np.float64)
    net.w["out"] = np.random.default_rng(0).normal(size=net.w["out"].shape)
    texts, y, weight = [b"abc def ghi " * 60, b"zzz"], np.array([1.0, 0.0]), np.ones(2)

    def loss():
        data, at = np.frombuffer(b"".join(texts), np.uint8), np.array([0, len(texts[0]), len(texts[0]) + 3])
        p = net.scores(data, at)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    grads = net.gradients(texts, y, weight)
    for k in ("out", "filters", "table", "level", "bias"):
        at = tuple(np.unravel_index(np.abs(grads[k]).argmax(), grads[k].shape))
        eps, own = 1e-5, net.w[k][at]
        net.w[k][at] = own + eps
        up = loss()
        net.w[k][at] = own - eps
        down = loss()
        net.w[k][at] = own
        assert grads[k][at] == pytest.approx((up - down) / (2 * eps), rel=0.05, abs=1e-4)


def test_pipeline_stages_do_what_they_say(spark, sf):
    """Each stage of the pipeline over its predecessor's rows against a plain form of what it promises."""
    docs = table(spark, sf, "documents")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    network = quality_cnn.trained(docs, table(spark, sf, "labels"))
    kept = corpus_pipeline.staged(stages["quality classifier"](spark, docs, sf), "one")

    def score(text):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        return network.scores(raw, np.array([0, len(raw)]))[0]

    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect() if score(r.text) >= 0.7}

    single = corpus_pipeline.staged(stages["SimHash near-dedup"](spark, kept, sf), "two")
    rows = sorted(kept.collect(), key=lambda r: r.doc_id)
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in ((r.text or "").encode().lower().split() for r in rows)]
    root = list(range(len(rows)))
    near = [[j for j in range(len(rows)) if sets[i] == sets[j] or sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(len(rows))]
    for _ in rows:
        root = [min(root[j] for j in near[i]) for i in range(len(rows))]
    assert single.columns == columns and sorted(r.doc_id for r in single.collect()) == [rows[i].doc_id for i in sorted(set(root))]

    clean = corpus_pipeline.staged(stages["benchmark decontamination"](spark, single, sf), "three")
    pieces = [(r.item_id, *p) for r in table(spark, sf, "benchmark").collect() for p in decontamination.pieces_of(decontamination.words_of(r.text))]
    q = decontamination.Queries(pieces)

    def holds(text):
        words = decontamination.words_of(text)
        spans = [words[max(0, at - decontamination.MARGIN) : at + decontamination.PASSAGE + decontamination.MARGIN] for at in range(0, len(words), decontamination.HALF)]
        return any(decontamination._checked(q, k, near, set(near), 0.0) for near in spans for k in range(len(pieces)))

    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect() if not holds(r.text)}

    mixed = corpus_pipeline.staged(stages["mixing to target weights"](spark, clean, sf), "four")
    taken = {r.doc_id: r for r in mixing.mixed(clean).collect()}
    words, source = Counter(), {r.doc_id: (r.text or "").split() for r in clean.collect()}
    for r in mixed.collect():
        own = r.text.split()
        words[r.doc_id] += len(own)
        assert Counter(own) <= Counter(source[r.doc_id]) and r.n_chars == len(r.text)
    assert mixed.columns == columns and {i: n for i, n in words.items() if n} == {i: r.taken for i, r in taken.items() if r.taken}

    packed = corpus_pipeline.staged(stages["token-ID output"](spark, mixed, sf), "five")
    total = sum(r.n_tokens for r in packed.collect())
    with open(token_packing.VOCABULARY, "rb") as f:
        enc = token_packing.encoding(f.read())
    assert total == sum(len(enc.encode_ordinary(r.text)) + 1 for r in mixed.collect())
    assert corpus_pipeline.run(spark, sf).selectExpr("sum(n_tokens)").first()[0] == total


def test_pipeline_stages_take_odd_rows(spark, sf, odd, none):
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.staged(stage(spark, odd, sf), "odd")
        assert out.count() > 0 and (out.columns == odd.columns or name == "token-ID output")
        assert stage(spark, none, sf).count() == 0
