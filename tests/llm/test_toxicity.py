import numpy as np

from docloom.llm import queries as Q, toxicity as T
from docloom.llm.common import table


def test_ordinal_fit():
    rng = np.random.default_rng(1)
    x = rng.random((600, 3)) * 2
    grade = np.digitize(x @ np.array([4.0, 2.0, 0.0]) + rng.logistic(size=600) * 0.3, [4, 8])
    at, columns = np.nonzero(x)
    w, t = T.fit_ordinal(at, columns, x[at, columns], grade, 3)
    assert w[0] > w[1] > w[2] >= 0 and t[0] < t[1]
    expected = (1 / (1 + np.exp(-((x @ w)[:, None] - t)))).sum(1)
    assert np.corrcoef(expected, grade)[0, 1] > 0.9


def test_held_out(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = T.fit(docs, Q.severity_labels(labels.filter("doc_id % 4 <> 0")))
    rows = T.score(docs, model).join(labels.filter("doc_id % 4 = 0").select("doc_id", labels["toxic"].alias("label")), "doc_id").collect()
    clean = [r.toxic for r in rows if r.label == 0]
    assert sum(clean) <= 0.03 * len(clean)
    severe, mild = (np.mean([r.severity for r in rows if r.label == k]) for k in (1, 0))
    assert severe > 3 * mild


def test_held_out_recall_and_severity(spark):
    """Fitted on three quarters of the labelled rows of sf0.1, judged on the last quarter."""
    folder = "/root/testdata/sf0.1"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = T.fit(docs, Q.severity_labels(labels.filter("doc_id % 4 <> 0")))
    held = Q.severity_labels(labels.filter("doc_id % 4 = 0"))
    rows = T.score(docs.join(held.select("doc_id"), "doc_id", "left_semi"), model).join(held, "doc_id").collect()
    found = {g: [r.toxic for r in rows if r.grade == g] for g in (0, 1, 2)}
    toxic = found[1] + found[2]
    assert sum(toxic) >= 0.85 * len(toxic) and sum(found[0]) <= 0.01 * len(found[0])
    mean = {g: np.mean([r.severity for r in rows if r.grade == g]) for g in (0, 1, 2)}
    assert mean[0] < 0.1 and min(mean[1], mean[2]) > 0.7  # the grades' own means are 0, 1 and 2
    assert abs(np.mean([r.p_toxic for r in rows]) - len(toxic) / len(rows)) < 0.02  # calibrated in the large


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, None if i == 3 else 1, int(i in (1, 2))) for i in range(20)] + [(None, 1, 1), (200, 0, None), (77, 1, 1)], "doc_id long, quality int, toxic int")
    model = T.fit(odd_docs, Q.severity_labels(labels))
    rows = T.score(odd_docs, model, keep=("lang", "h")).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.severity <= 2 and r.toxic == (r.p_toxic >= 0.5) for r in rows)
    assert T.score(no_docs, model).count() == 0
    none = T.fit(no_docs, Q.severity_labels(labels.limit(0)))
    assert not any(r.toxic for r in T.score(odd_docs, none).collect())


def test_values():
    known = T.Known(["clow", "idiot$"])
    assert T.values(["clown"] * 3 + ["x"] * 97, known) == {"clow": 1.5}
    assert T.values(["idiot"], known) == {"idiot$": 1.0}
    assert T.values(["idiots", "idiot"] * 50, known) == {"idiot$": 2.0}


def by_hand(model, text):
    """Expected grade and chance of being toxic, feature by feature."""
    import math
    import re

    words = re.findall(r"\w+", (text or "").lower())
    odds = 0.0
    for feature, weight in sorted(model.weights.items()):
        times = sum(w + "$" == feature or not feature.endswith("$") and w.startswith(feature) for w in words)
        odds += weight * min(times * 50 / max(len(words), 50), 2.0)
    p = [1 / (1 + math.exp(-min(max(odds - t, -30), 30))) for t in model.thresholds]
    return sum(p), p[0]


def test_scores_by_hand(spark, odd_docs):
    folder = "/root/testdata/sf0.001"
    docs = table(spark, folder, "documents")
    model = T.fit(docs, Q.severity_labels(table(spark, folder, "labels")), min_rows=2)
    assert model.weights and list(model.thresholds) == sorted(model.thresholds)
    texts = docs.select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text"))
    rows = T.score(texts, model).collect()
    assert len(rows) == texts.count()
    for r in rows:
        severity, p = by_hand(model, r.text)
        assert abs(r.severity - severity) < 2e-6 and abs(r.p_toxic - p) < 2e-6 and r.toxic == (r.p_toxic >= 0.5)


def test_fit_is_near_the_best(spark):
    """No small step from the fitted weights lowers the loss by much."""
    rng = np.random.default_rng(4)
    x = (rng.random((400, 4)) < 0.4) * rng.random((400, 4)) * 2
    grade = np.digitize(x @ np.array([3.0, 1.5, 0.0, 2.0]) + rng.logistic(size=400) * 0.5, [2, 4])
    at, columns = np.nonzero(x)
    w, t = T.fit_ordinal(at, columns, x[at, columns], grade, 4)

    def loss(w, t):
        z = (x @ w)[:, None] - t
        above = np.stack([grade >= 1, grade >= 2], 1)
        return np.mean(np.sum(np.logaddexp(0, z) - above * z, 1)) + 0.01 * (w**2).sum() / 800

    best = loss(w, t)
    for _ in range(300):
        v, u = np.maximum(w + rng.normal(0, 0.1, 4), 0), np.sort(t + rng.normal(0, 0.1, 2))
        assert loss(v, u) > best - 1e-4


def test_one_label_with_very_many_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"awful text number {i}") for i in range(3000)] + [(2, "a kind text")] * 3000 + [(3, f"kind {i}") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (1, 1)], "doc_id long, grade int")
    seen = []
    fit = T.fit_ordinal
    monkeypatch.setattr(T, "fit_ordinal", lambda rows, columns, values, grade, width: seen.append(len(grade)) or fit(rows, columns, values, grade, width))
    model = T.fit(docs, labels, rows=800)
    assert seen == [800] and T.score(docs.limit(1), model).first().toxic
    T.fit(docs.filter("doc_id > 1").unionByName(docs.filter("doc_id = 1").limit(30)), labels, rows=800)
    assert seen == [800, 51]  # the repeated text counts once
