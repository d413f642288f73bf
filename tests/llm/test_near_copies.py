import random

import numpy as np

import corpus_pipeline as P
from docloom.llm import near_copies as N, simhash as S


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or ({" ".join(words)} if words else set())


def texts(seed=3):
    """Texts with edits, groups that only chains link, a common passage, short texts, copies and nulls."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(30)]
    out = [None, "", " \n", "one", "One", "a b c", "a b c d e", "A b c d e"]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(20, 200))] + (passage if rng.random() < 0.5 else [])
        for _ in range(rng.randint(1, 6)):
            out.append(" ".join(base))
            base = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 40)):
                base[rng.randrange(len(base))] = word()
    hub = [word() for _ in range(120)]
    for k in range(60):  # near the hub, some of them not near each other
        out.append(" ".join(hub[: 2 * k] + [word(), word()] + hub[2 * k :]))
    return out


def brute(all_texts):
    sets = [shingles(t) for t in all_texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    return pairs, S.components(len(sets), *np.array(pairs).T)


def test_near_copies(spark):
    all_texts = texts()
    pairs, label = brute(all_texts)
    close = [(i, j) for i, j in pairs if shingles(all_texts[i]) != shingles(all_texts[j])]
    assert len(close) > 100 and len(set(label.tolist())) > 12
    docs = spark.createDataFrame(list(enumerate(all_texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in N.near_copies(docs).collect()}
    assert got == dict(enumerate(label.tolist()))
    assert N.near_copies(docs.limit(0)).count() == 0


def test_edited_copies_of_one_text(spark):
    """Copies with up to six edits, of which those with four or more link to nothing, and a chain away from the original."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    all_texts = [" ".join(base)]
    for k in range(300):
        own = list(base)
        for i in rng.sample(range(150), k % 7):
            own[i] = f"e{rng.randrange(40)}"
        all_texts.append(" ".join(own))
    chain = list(base)
    for k in range(12):
        chain = [*chain[:k], f"c{k}", *chain[k:]]
        all_texts.append(" ".join(chain))
    _, label = brute(all_texts)
    docs = spark.createDataFrame(list(enumerate(all_texts)), "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.component_id for r in N.near_copies(docs).collect()} == dict(enumerate(label.tolist()))
    assert len(set(label.tolist())) > 20


def test_all_pairs_within_the_radius(spark):
    """The trees find every pair of 0.8 or more that has different labels, at the radius of the stage."""
    rng = random.Random(6)
    sets = []
    for _ in range(150):
        base = [rng.getrandbits(64) for _ in range(rng.randint(40, 300))]
        for _ in range(3):
            drop = int(len(base) * rng.choice([0, 0.02, 0.05, 0.1]))
            sets.append(sorted(set(base[drop:]) | {rng.getrandbits(64) for _ in range(drop)}))
    prints = S.majority(np.array([h for s in sets for h in s], np.uint64), np.array(list(map(len, sets))))
    near = {(i, j) for i, s in enumerate(sets) for j in range(i) if 5 * len(set(s) & set(sets[j])) >= 4 * len(set(s) | set(sets[j]))}
    order = np.argsort(prints, kind="stable")
    forest = S.Forest(prints[order], np.zeros(len(sets), int), N.RADIUS, np.arange(len(sets)))
    found = {tuple(sorted((int(order[a]), int(order[b])), reverse=True)) for i, j in forest.pairs() for a, b in zip(i, j)}
    assert len(near) > 100 and near <= found
    # the trees leave nothing out that is within the radius
    away = np.bitwise_count(prints[:, None] ^ prints[None, :])
    assert found == {(i, j) for i, j in np.argwhere(away <= N.RADIUS).tolist() if i > j}


def test_stage_finds_copies_of_08(spark):
    all_texts = texts(8)
    _, label = brute(all_texts)
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(all_texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in P.drop_near_duplicates(spark, docs, "").collect()) == sorted(set(label.tolist()))
