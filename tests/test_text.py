import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.operators import naming, profiles, text
from cohortry.operators.clustering import kmeans, nmf_topics
from cohortry.operators.metrics import purity

DOCS = [
    (0, "The red fox jumps"),
    (1, "red fox, red barn"),
    (2, "a blue whale and a blue sea"),
    (3, "the and of"),  # stop words only
    (4, ""),
    (5, None),
    (6, "blue whale"),
]
STOPS = ["the", "and", "of"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "id int, text string")


def test_terms_drop_stop_words_before_bigrams(spark):
    df = text.with_terms(spark.createDataFrame([("Cat and the DOG x1 a",)], "t string"), "t", STOPS)
    assert df.first()["terms"] == ["cat", "dog", "x1", "cat dog", "dog x1"]


def test_tfidf_weights(docs):
    long, vocabulary, n = text.term_weights(docs, "id", stop_words=STOPS, ngrams=1, min_df=2)
    terms = {r["term"]: r["df"] for r in vocabulary.collect()}
    assert n == 7 and terms == {"blue": 2, "fox": 2, "red": 2, "whale": 2}
    got = {(r["id"], r["term"]): r["tfidf"] for r in long.collect()}
    idf = math.log(8 / 3) + 1
    red, fox = (1 + math.log(2)) * idf, idf
    assert got[(1, "red")] == pytest.approx(red / math.hypot(red, fox))


def test_documents_without_terms_keep_an_empty_row(docs):
    corpus = text.tfidf(docs, "id", stop_words=STOPS)
    sizes = {r["id"]: len(r["idx"]) for r in corpus.rows.collect()}
    assert len(sizes) == 7 and sizes[3] == sizes[4] == sizes[5] == 0


def test_svd_matches_numpy(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(words[: 5 + i % 6], 12))) for i in range(60)]
    corpus = text.tfidf(spark.createDataFrame(rows, "id int, text string"), "id", stop_words=[], ngrams=1)
    dense = np.zeros((60, corpus.n_terms))
    for r in corpus.rows.collect():
        dense[r["id"], r["idx"]] = r["val"]
    svd = text.truncated_svd(corpus, 4)
    expected = np.linalg.svd(dense, compute_uv=False)[:4]
    assert np.allclose(svd.singular, expected, rtol=1e-3)
    rows_out = {r["id"]: r["features"] for r in text.project(corpus, svd).collect()}
    assert np.allclose([np.linalg.norm(v) for v in rows_out.values()], 1.0)


def test_topics_and_clusters_follow_the_language(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    done = text.prepare_text(df, "doc_id", ["text"], svd_dims=8)
    unit = done.vectors.where(F.aggregate("features", F.lit(0.0), lambda a, x: a + x * x) > 0)
    langs = df.select(F.col("doc_id").alias("id"), "lang")
    for labels in (kmeans(unit, 4, restarts=3, metric="cosine"), nmf_topics(done.corpus, 4, max_iter=20)):
        assert purity(labels.join(langs, "id"), "cluster_id", "lang").first()[0] >= 0.50


def test_first_column_counts_twice(spark):
    df = spark.createDataFrame([(" t ", "b"), ("", "b"), (None, None)], "title string, body string")
    assert [r["document"] for r in text.join_text_columns(df, ["title", "body"]).collect()] == ["t. t. b", "b", ""]


def test_similar_texts_against_brute_force(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(40)]
    base = [" ".join(rng.choice(words, 15)) for _ in range(20)]
    rows = [(i, b) for i, b in enumerate(base)] + [(20 + i, b + " extra" * (i % 3)) for i, b in enumerate(base)]
    df = spark.createDataFrame(rows, "id int, t string")
    long, _, _ = text.term_weights(df, "id", "t", stop_words=[], ngrams=1, min_df=1, sublinear=False)
    vectors: dict = {}
    for r in long.collect():
        vectors.setdefault(r["id"], {})[r["term"]] = r["tfidf"]
    expected = {
        (a, b)
        for a in vectors
        for b in vectors
        if a < b and sum(w * vectors[b].get(t, 0.0) for t, w in vectors[a].items()) > 0.7
    }
    got = {(r["a"], r["b"]) for r in naming.similar_texts(df, "id", "t", 0.7, []).collect()}
    assert got == expected and len(expected) >= 15


def test_gate_finds_twins_and_missing_types(spark):
    rows = [
        (0, "Savers", "keeps money at home", ["a", "b", "c"], 9.0),
        (1, "Savers", "keeps money at home always", ["C", " b", "a", "d"], 8.0),
        (2, "Night owls", "active after dark", ["x", "y", "z"], 7.0),
    ]
    df = spark.createDataFrame(rows, "cluster_id int, name string, description string, dominant_features array<string>, confidence double")
    kinds = {(r["kind"], r["subject"]) for r in naming.gate_issues(df, ["night-owls", "early birds"], []).collect()}
    assert ("duplicate_name", "Savers") in kinds and ("shared_features", "0 & 1") in kinds
    assert ("missing_must_have", "early birds") in kinds and not any(s == "night-owls" for _, s in kinds)
    forced = naming.clarity_gate(df, force=True, stop_words=[])
    assert forced["passed"] and all(i.startswith("[forced]") for i in forced["issues"])


def test_views_stay_blind(spark):
    f = spark.createDataFrame([(i, i % 2, float(i), float(i * i % 7)) for i in range(30)], "id int, cluster_id int, a double, b double")
    people = spark.createDataFrame([(0, "MARKER_ONE", "d" * 50 + " tail " * 60, ""), (1, "MARKER_TWO", "short", "")], "cluster_id int, name string, description string, tagline string")
    prof = profiles.cluster_profiles(f, ["a", "b"])
    assert "MARKER" not in str(profiles.statistical_view(prof, people).collect())
    view = profiles.business_view(people)
    assert view.columns == ["name", "description"] and all(len(r["description"]) <= 200 for r in view.collect())


def test_texts_are_cut_into_words_once_and_moved_once(spark):
    df = spark.createDataFrame([(1, "red cat sat red"), (2, "blue cat sat"), (3, None)], "id int, t string")
    long, _, _ = text.term_weights(df, "id", "t", stop_words=[], ngrams=1, min_df=1)
    assert {(r["id"], r["term"], r["tf"]) for r in long.collect()} == {(1, "red", 2), (1, "cat", 1), (1, "sat", 1), (2, "blue", 1), (2, "cat", 1), (2, "sat", 1)}
    plan = long._jdf.queryExecution().toString()
    cached = plan[plan.rindex("== Physical Plan ==") :]
    assert not [line for line in cached.splitlines() if "Filter" in line and "regexp_extract_all" in line]
    assert "hashpartitioning(id#" in cached and not re.search(r"hashpartitioning\(id#\d+L?, term#", cached)


def test_an_encoder_needs_no_term_rows(spark, monkeypatch):
    asked = []
    made = text.tfidf
    monkeypatch.setattr(text, "tfidf", lambda *a, **k: asked.append(1) or made(*a, **k))
    df = spark.createDataFrame([(i, f"word{i % 5} and more words") for i in range(25)], "id int, t string")
    done = text.prepare_text(df, "id", ["t"], method="transformer", load_encoder=lambda: lambda texts: [[float(len(t))] for t in texts])
    assert done.vectors.count() == 25 and not asked
    assert done.corpus.n_docs == 25 and done.corpus.n_docs == 25 and asked == [1]


def test_similar_texts_move_no_pairs(spark, monkeypatch):
    """Pairs are found inside tasks, for any number of groups: neither they nor their terms are joined."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(words, 30)) + f" only{i}") for i in range(120)]
    df = spark.createDataFrame(rows, "id long, t string")
    results = []
    for held in (10_000_000, 700):
        monkeypatch.setattr(naming, "GROUP_TERMS", held)
        monkeypatch.setattr(naming, "SMALL_TERMS", 10_000_000)
        found = naming.similar_texts(df, "id", "t", 0.4, [])
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
        results.append({(r["a"], r["b"]): round(r["cosine"], 9) for r in found.collect()})
    tf = np.array([[t.split().count(w) for w in words] for _, t in rows], dtype=float)
    idf = np.log(121 / (1 + (tf > 0).sum(axis=0))) + 1
    own = np.log(121 / 2) + 1
    x = tf * idf
    norm = np.sqrt((x * x).sum(axis=1) + own * own)
    cos = (x / norm[:, None]) @ (x / norm[:, None]).T
    want = {(i, j): round(float(cos[i, j]), 9) for i in range(120) for j in range(i + 1, 120) if cos[i, j] > 0.4}
    assert len(want) > 50 and results[0].keys() == results[1].keys() == want.keys()
    assert all(abs(results[0][p] - c) < 1e-8 and abs(results[1][p] - c) < 1e-8 for p, c in want.items())
