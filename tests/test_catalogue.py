import numpy as np
import pytest
from compare import database, rows

from gleanery.functions import minhash, text
from gleanery.operators import linkage
from gleanery.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    got = rows(catalogue.queries()[name](spark, sf).toPandas())
    assert got == rows(database(sf).sql(catalogue.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_gives_the_same_rows_twice(spark, sf, name):
    first, again = ([tuple(r) for r in catalogue.queries()[name](spark, sf).collect()] for _ in range(2))
    assert first and sorted(map(repr, first)) == sorted(map(repr, again))


def test_exact_signatures_are_those_of_the_hasher(spark, sf):
    docs = catalogue._docs(spark, sf)
    hasher = minhash.ExactHasher(128, 17)
    sets = {r.doc_id: r.s for r in docs.select("doc_id", text.shingles_of(text.words("text")).alias("s")).collect()}
    got = {r.id: r.sig for r in catalogue.queries()["minhash_exact_sigs"](spark, sf).collect()}
    assert got == {i: hasher.signature(s).view("int64").tolist() for i, s in sets.items()}


def test_complete_linkage_of_the_near_rung_is_brute_force(spark, sf):
    signed, pairs = catalogue._near(spark, sf)
    sig = {r.id: np.array(r.sig) for r in signed.collect()}
    got = {r.id: r.cluster_id for r in linkage.near_clusters(signed, pairs, catalogue.JACCARD).collect()}
    assert set(got) == set(sig)
    for i, c in got.items():
        assert c <= i and (i == c or (sig[i] == sig[c]).mean() > catalogue.JACCARD)
    clusters = {}
    for i, c in got.items():
        clusters.setdefault(c, []).append(i)
    far = lambda a, b: min((sig[x] == sig[y]).mean() for x in a for y in b)
    multi = [m for m in clusters.values() if len(m) > 1]
    assert multi and all(far(m, m) > catalogue.JACCARD for m in multi)
    assert all(far(a, b) <= catalogue.JACCARD for k, a in enumerate(multi) for b in multi[:k])  # no two could still be merged


def test_recall_of_bands_at_the_threshold(spark):
    """32 bands of 4 miss one pair in 200 at the threshold: pairs of signatures that agree in 80 of 128 places."""
    draw = np.random.default_rng(8)
    rows = []
    for k in range(400):
        a = draw.integers(0, 1 << 30, 128)
        b = a.copy()
        b[draw.choice(128, 48, replace=False)] = -1 - k
        rows += [(2 * k, a.tolist()), (2 * k + 1, b.tolist())]
    found = minhash.near_pairs(spark.createDataFrame(rows, "id long, sig array<long>"), 80 / 128)
    assert found.count() >= 0.99 * 400
