"""Ranking, periodic runs and clustering against plain versions, on awkward rows and on the smallest given tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import compare, connect
from pyspark.sql import functions as F

from annolake.llm import clustering, queries, ranking, runs

SF = "/root/testdata/sf0.001"
CLASH = ["features", "good", "score", "runs", "collapsed", "cluster", "v", "lower", "_w", "_p", "held_out", "label"]


def clashing(df):
    return df.withColumns({c: F.lit("?") for c in CLASH if c not in df.columns})


# Periodic runs

def plain_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(12, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in found.items())


def plain_rest(words, found):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in found)]


PIECES = st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 7)), max_size=8)


@given(st.lists(PIECES, min_size=1, max_size=3))
@settings(max_examples=300, deadline=None)
def test_runs_of_looped_pieces(texts):
    texts = [[w for unit, times in pieces for w in unit * times] for pieces in texts]
    found = runs.find_runs(np.asarray([w for t in texts for w in t], np.int32), np.repeat(np.arange(len(texts)), list(map(len, texts))))
    expected, at = [], 0
    for t in texts:
        expected += [(s + at, length, q) for s, length, q in plain_runs(t)]
        at += len(t)
    assert list(zip(*(x.tolist() for x in found))) == expected


@pytest.mark.parametrize("n", [9, 40, 77])
def test_all_runs_between_two_stretches_of_one_period(n):
    words = [0, 1] * n + [1] + [0, 1] * n
    found = runs.find_runs(np.asarray(words, np.int32), np.zeros(len(words), np.int64))
    assert list(zip(*(x.tolist() for x in found))) == plain_runs(words)


def test_one_repeated_word_stays_cheap():
    found = runs.find_runs(np.zeros(300_000, np.int32), np.zeros(300_000, np.int64))
    assert [x.tolist() for x in found] == [[0], [300_000], [1]]


def awkward_texts():
    rnd = random.Random(3)
    loop = " ".join(["alpha", "beta", "gamma"] * 9)
    long = " ".join(rnd.choice("abcdefgh") + str(rnd.randrange(300)) for _ in range(30_000))
    texts = [None, "", " \n\t", "one", "a " * 12, "a b " * 11, f"start {loop} end", f"{loop}\n{loop}", long, long + " " + loop + " " + long[:500], "\x1cx " * 13]
    return [(i, t) for i, t in enumerate(texts)] + [(6, "a " * 11), (6, "a " * 30), (None, "b c " * 7), (None, None)]


@pytest.mark.parametrize("which", ["awkward", "given", "empty"])
def test_runs_per_document(spark, which):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("length(text) < 9000") if which == "given" else clashing(
        spark.createDataFrame(awkward_texts() if which == "awkward" else [], "doc_id long, text string"))
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    expected = []
    for doc_id, text in texts:
        words = (text or "").encode().split()
        found = plain_runs(words) if len(words) < 5000 else None
        expected.append((str(doc_id), len(words), found, None if found is None else b" ".join(plain_rest(words, found)).decode()))
    got = [(str(r["doc_id"]), r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in runs.periodic_runs(docs).collect()]
    got = [(d, n, f if n < 5000 else None, c if n < 5000 else None) for d, n, f, c in got]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_loops_are_planted_as_stated(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 90))) for i in range(400)] + [(None, "x y"), (10, None)]
    told = {}
    for r in runs.planted(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id is not null and text is not null").collect():
        told[r["doc_id"]] = r["text"].split()
    for i, text in rows[:400]:
        words, h = text.split(), zlib.crc32(str(i).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (k - a) % p] if k >= a else words[k] for k in range(n)]
        assert told[i] == words


# Clustering

def plain_clusters(vectors, k, rounds):
    """Cluster and squared distance of each vector (Python integers) and the last centroids; ``vectors`` is [(vec_id, tuple)]."""
    order = sorted(range(len(vectors)), key=lambda i: (hashlib.sha256(f"2:{vectors[i][0]}".encode()).hexdigest(), vectors[i][1]))
    centroids = [vectors[i][1] for i in order[:k]]
    for r in range(rounds + 1):
        own = [min(range(len(centroids)), key=lambda c: (sum((a - b) ** 2 for a, b in zip(v, centroids[c])), c)) for _, v in vectors]
        if r < rounds:
            for c in range(len(centroids)):
                inside = [v for (_, v), o in zip(vectors, own) if o == c]
                if inside:
                    centroids[c] = tuple(sum(x) // len(inside) for x in zip(*inside))
    return own, [sum((a - b) ** 2 for a, b in zip(v, centroids[o])) for (_, v), o in zip(vectors, own)], centroids


def vectors_of(kind):
    rnd = random.Random(5)
    if kind == "empty":
        return []
    if kind == "few":
        return [(i, tuple(rnd.randrange(-9, 9) for _ in range(4))) for i in range(3)]
    if kind == "huge":
        return [(i, tuple(rnd.randrange(-9, 9) << 48 for _ in range(4))) for i in range(40)]
    if kind == "wide":
        return [(i, tuple(rnd.randrange(-9, 9) << 22 for _ in range(4))) for i in range(40)]
    centres = [[rnd.gauss(0, 200) for _ in range(4)] for _ in range(9)]
    rows = [(i, tuple(int(rnd.gauss(x, 30)) for x in rnd.choice(centres))) for i in range(500)]
    rows += [(i, (0, 0, 0, 0)) for i in range(600, 700)]  # ties
    return rows + rows[:7] + [(3, (5, 5, 5, 5))]


@pytest.mark.parametrize("kind", ["blobs", "few", "huge", "wide", "empty"])
def test_clusters_equal_plain_rounds(spark, kind):
    rows = vectors_of(kind)
    bad = [(9000, None), (9001, [1.0]), (9002, [1.0, None, 2.0, 3.0]), (9003, [1.0, float("nan"), 2.0, 3.0]), (9004, [float("inf")] * 4)]
    given_rows = [(i, [x / 256 for x in v]) for i, v in rows] + bad
    df = clashing(spark.createDataFrame(given_rows, "vec_id long, embedding array<double>")).repartition(3)
    state, centroids = clustering.cluster(clustering.whole_vectors(df, 4), 12, 4, 4, "2")
    got = clustering.with_totals(state, centroids).select("vec_id", "v", "cluster", "distance", "centroid_sha256").collect() if kind != "huge" else state.collect()
    own, distances, last = plain_clusters(rows, 12, 4) if rows else ([], [], [])
    assert [tuple(c) for c in centroids] == last
    assert sorted((r["vec_id"], tuple(map(int, r["v"])), r["cluster"], int(r["distance"])) for r in got) == sorted(
        (i, v, o, d) for (i, v), o, d in zip(rows, own, distances))


def test_fractions_are_floored(spark):
    df = spark.createDataFrame([(1, [-1e-20, 0.1, -0.1, 3.0e15])], "vec_id long, embedding array<double>")
    assert clustering.whole_vectors(df, 4).first()["v"] == [-1, 25, -26, 256 * 3.0e15]


@given(st.integers(0, 10_000))
@settings(max_examples=60, deadline=None)
def test_loosening_is_a_bound_and_below_the_drift(seed):
    rng = np.random.default_rng(seed)
    old, new = rng.normal(0, 100, (6, 3)), rng.normal(0, 100, (6, 3))
    radii = rng.uniform(0, 80, 6)
    loss = clustering.loosening(old, new, radii)
    drift = np.linalg.norm(new - old, axis=1)
    for i in range(6):
        way = rng.normal(0, 1, (300, 3))
        inside = old[i] + way / np.linalg.norm(way, axis=1)[:, None] * radii[i] * rng.uniform(0, 1, (300, 1)) ** 0.2
        for j in set(range(6)) - {i}:
            lost = np.linalg.norm(inside - old[j], axis=1) - np.linalg.norm(inside - new[j], axis=1)
            assert lost.max() <= loss[i] + 1e-9
        assert loss[i] <= max(drift[j] for j in range(6) if j != i) * (1 + 1e-8)


def test_bounds_spare_most_scans(spark, monkeypatch):
    """On separate clusters most vectors keep their cluster by bounds alone, and a sideways move loosens less than the drift."""
    old = np.array([[0.0, 0.0], [1000.0, 0.0]])
    new = np.array([[0.0, 0.0], [1000.0, 300.0]])
    assert clustering.loosening(old, new, np.array([10.0, 10.0]))[0] < 10
    rng = np.random.default_rng(0)
    x = np.floor(np.concatenate([rng.normal(c, 20, (500, 2)) for c in ([0, 0], [900, 0], [0, 900])]))
    nearest, best, lower = clustering.scan(x, old.astype(np.int64).astype(object))
    near = np.sqrt(clustering.own_distance(x, new.astype(np.int64).astype(object), nearest).astype(float))
    loss = clustering.loosening(old, new, np.array([np.sqrt(best[nearest == k].max(initial=0)) for k in (0, 1)]))
    assert (near < lower - loss[nearest]).mean() > 0.6


# Quality ranking

def test_held_out_accuracy_and_full_coverage(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = queries.QUERIES["op11_quality_ranking"](spark, sf).collect()
    assert len(rows) == docs.count()
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    test = [(r["predicted"], known[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in known]
    assert len(test) > 50 and sum(a == b for a, b in test) / len(test) >= 0.97


def ranked_rows(spark, docs, labels):
    docs = clashing(spark.createDataFrame(docs, "doc_id long, text string"))
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    return ranking.rank_quality(docs, labels).collect()


def test_awkward_documents_and_labels(spark):
    docs = [(i, f"plain prose number {i} goes on here. It ends." if i % 3 else "## $$ %% && ** ## $$" * (i % 7 + 1)) for i in range(200)]
    docs += [(200, None), (201, ""), (202, " \n"), (None, "no id"), (5, "another text of five"), (203, "x" * 300_000)]
    labels = [(i, int(bool(i % 3)), 0) for i in range(200)] + [(None, 1, 0), (7, 1, 1), (8, 0, 0), (201, None, 0), (5, 1, 0)]
    rows = ranked_rows(spark, docs, labels)
    assert len(rows) == len(docs) and all(r["score"] is not None and 0 <= r["score"] <= 1 for r in rows)
    sure = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 200 and r["doc_id"] not in (5, 8)]
    assert all(r["predicted"] == int(bool(r["doc_id"] % 3)) for r in sure)


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, 1, 0), (3, 1, 0)]])
def test_without_both_classes_nothing_is_ranked(spark, labels):
    assert {r["score"] for r in ranked_rows(spark, [(1, "a"), (2, "b c"), (3, None)], labels)} == {0.5}
    assert ranked_rows(spark, [], labels) == []


def test_labels_of_the_test_fold_teach_nothing(spark):
    docs = [(i, f"text {i} of plain words" if i % 2 else f"# $ % {i}") for i in range(120)]
    labels = [(i, i % 2, 0) for i in range(120)]
    turned = [(i, 1 - i % 2 if zlib.crc32(str(i).encode()) % 5 == 0 else i % 2, 0) for i in range(120)]
    a, b = ({r["doc_id"]: r["score"] for r in ranked_rows(spark, docs, some)} for some in (labels, turned))
    assert a == pytest.approx(b, abs=1e-12)


@given(st.lists(st.floats(-50, 50) | st.integers(-3, 3).map(float), min_size=1, max_size=60), st.floats(0, 1))
@settings(max_examples=15, deadline=None)
def test_quantile_lies_between_its_neighbours(spark, values, share):
    cut = ranking.score_quantile(spark.createDataFrame([(v,) for v in values], "s double"), share)
    ordered = sorted(values)
    last = ordered[max(1, min(len(values), round(share * len(values)))) - 1]
    above = [v for v in ordered if v > last]
    assert cut == (last if not above else (last + above[0]) / 2)


@pytest.mark.parametrize("name", ["op12_periodic_runs", "op13_centroid_clusters"])
def test_same_rows_as_sql_at_the_next_size(spark, name):
    assert compare(name, spark, connect("/root/testdata/sf0.01"), "/root/testdata/sf0.01", queries.QUERIES, queries.ORACLES) == ""


@pytest.mark.parametrize("values, share, cut", [([0.0, 1.0, 6.8e-15, 4e-91], 0.0, 2e-91), ([0.0, 5e-324, 1.0], 0.7, 0.5), ([0.3, 0.3], 0.5, 0.3)])
def test_quantile_of_scores_of_very_different_size(spark, values, share, cut):
    assert ranking.score_quantile(spark.createDataFrame([(v,) for v in values], "s double"), share) == cut
