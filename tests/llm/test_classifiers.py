import random

import numpy as np
import pytest

from passageway.llm import langid, toxicity
from passageway.llm.linear import Rows, descend, fit
from passageway.llm.ngrams import STRETCH, gram_counts, gram_slots


def naive_slots(text, n):
    padded = f" {text} ".lower()
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


@pytest.mark.parametrize("text", ["", "a", "Abc ÄÖ𝒳 abc", "x" * (STRETCH + 5)])
def test_grams(text):
    for n in (1, 3, 5):
        slots = np.concatenate([*gram_slots(text, (n,), 18), np.zeros(0, dtype=np.int64)])
        grams = naive_slots(text, n)
        assert len(slots) == len(grams) and gram_counts(text, (n,), 18).sum() == len(grams)
        if len(grams) < 100:
            assert len(set(zip(grams, slots.tolist()))) == len(set(grams))


@pytest.mark.parametrize("loss", ["logistic", "hinge"])
def test_fit_finds_the_minimum(loss):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)) * (rng.random((300, 8)) < 0.5)
    positive = x @ rng.normal(size=8) + 0.4 + rng.normal(size=300) > 0
    row, column = np.nonzero(x)
    w, b = fit(Rows(row, column, x[row, column], x.shape), positive, loss, 2.0)
    y = np.where(positive, 1, -1)

    def cost(w, b):
        m = y * (x @ w + b)
        return 0.5 * w @ w + 2.0 * (np.logaddexp(0, -m) if loss == "logistic" else np.maximum(0, 1 - m) ** 2).sum()

    best = cost(w, b)
    for _ in range(200):
        assert cost(w + rng.normal(size=8) * 0.01, b + rng.normal() * 0.01) > best - 0.02


BAD = ["lostra", "grimble", "vequon"]


def sentences(rng, bad):
    syllables = ["ba", "re", "ti", "on", "es", "lu", "mi", "da"]
    text = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(20, 120))]
    for _ in range(max(1, len(text) // 30) if bad else 0):
        text.insert(rng.randrange(len(text)), rng.choice(BAD) + rng.choice(syllables))
    return " ".join(text)


def test_toxicity_on_texts_not_seen(spark):
    rng = random.Random(2)
    rows = [(i, sentences(rng, i % 6 == 0), int(i % 6 == 0)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    seen = df.filter("doc_id < 600")
    model = toxicity.train(toxicity.labelled_texts(seen.drop("toxic"), df.select("doc_id", "toxic")), features=1024)
    scored = toxicity.score_toxicity(df.filter("doc_id >= 600"), model).collect()
    assert sum((r["score"] >= 0.5) == (r["toxic"] == 1) for r in scored) >= 0.97 * len(scored)
    few = toxicity.train(toxicity.labelled_texts(seen.drop("toxic"), df.select("doc_id", "toxic")), most_rows=200, features=1024)
    assert few.weight.any()


def test_log_count_ratios():
    counts = np.zeros((2, 4), dtype=np.int64)
    counts[0], counts[1] = [4, 0, 1, 0], [0, 9, 1, 0]
    p, q = (counts[1] + 1) / 14, (counts[0] + 1) / 9
    assert np.allclose(toxicity.log_count_ratios(counts), np.log(p / q))


def test_toxicity_of_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(1, 0), (1, 1), (6, 0), (7, 0), (3, None), (99, 1), (None, 1), (4, 1)], "doc_id bigint, toxic int")
    labelled = toxicity.labelled_texts(odd_docs, labels)
    assert sorted((r["id"], r["label"]) for r in labelled.collect()) == [(1, 1), (4, 1), (6, 0), (7, 0)]
    scored = toxicity.score_toxicity(odd_docs, toxicity.train(labelled)).collect()
    assert len(scored) == 12 and all(0 <= r["score"] <= 1 for r in scored)
    assert len({r["score"] for r in scored if r["doc_id"] in (3, 4)}) == 1
    for mark, score in ((0, 0), (1, 1)):
        one = toxicity.train(labelled.filter(f"label = {mark}"))
        assert {round(r["score"]) for r in toxicity.score_toxicity(odd_docs, one).collect()} == {score}
    nothing = toxicity.train(labelled.filter("false"))
    assert {round(r["score"], 6) for r in toxicity.score_toxicity(odd_docs, nothing).collect()} == {0}
    assert toxicity.score_toxicity(odd_docs.filter("false"), nothing).count() == 0


PARTS = {"en": ["the", "and", "th", "ing", "er"], "de": ["der", "und", "sch", "ung", "ei"], "nl": ["het", "een", "ij", "oo", "van"], "fr": ["le", "eau", "que", "ment", "é"], "es": ["el", "ción", "ñ", "que", "os"], "xx": ["zza", "kwu", "qq"]}


def test_languages_not_seen(spark):
    rng = random.Random(3)
    rows = []
    for i in range(720):
        lang = list(PARTS)[i % 6]
        rows.append((i, " ".join("".join(rng.choices(PARTS[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(15, 60))), lang))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.train(langid.training_texts(df.filter("doc_id < 480")), rows_each=60)
    assert model.languages == {"germanic": ["de", "en", "nl"], "romance": ["es", "fr"], "=xx": ["xx"]}
    assert set(model.pair) == {("de", "en"), ("de", "nl"), ("en", "nl"), ("es", "fr")}
    found = langid.identify(df.filter("doc_id >= 480"), model).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in found) >= 0.98 * len(found) and all(0 <= r["lang_score"] <= 1 for r in found)


def test_languages_of_odd_rows(spark, odd_docs):
    model = langid.train(langid.training_texts(odd_docs))
    found = {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in langid.identify(odd_docs, model).collect()}
    assert all(found[i] == ("und", 0.0) for i in (3, 4, 5, 8)) and found[1][0] in ("en", "de", "fr")
    nothing = langid.train(langid.training_texts(odd_docs.filter("false")))
    assert {r["lang_pred"] for r in langid.identify(odd_docs, nothing).collect()} == {"und"}
    assert langid.identify(odd_docs.filter("false"), model).count() == 0
    alone = langid.train(langid.training_texts(odd_docs.filter("lang = 'fr'")))
    assert langid.identify(odd_docs.filter("doc_id = 1"), alone).collect()[0]["lang_pred"] == "fr"


def naive_features(text):
    """Counts of hashed n-grams in a dictionary, by the plain reading of the padded, lower-cased text."""
    counts = {}
    for n in toxicity.SIZES:
        for slots in gram_slots(text, (n,), toxicity.BITS):
            for s in slots.tolist():
                counts[s] = counts.get(s, 0) + 1
    return counts


def test_scores_against_plain_dictionaries(spark):
    rng = random.Random(12)
    rows = [(i, sentences(rng, i % 5 == 0), int(i % 5 == 0)) for i in range(200)]
    rows += [(300, rows[0][1], 1), (301, rows[1][1], 0), (302, "", 0), (303, "x" * (toxicity.LONG + 9), 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.train(toxicity.labelled_texts(df.drop("toxic"), df.select("doc_id", "toxic")))
    # Ratios: documents with a slot, by label, over different texts.
    texts = sorted({(t, y) for _, t, y in rows})
    held = [{}, {}]
    for t, y in texts:
        for s in naive_features(t):
            held[y][s] = held[y].get(s, 0) + 1
    total = [sum(h.values()) + (1 << toxicity.BITS) for h in held]
    ratio = {s: np.log((held[1].get(s, 0) + 1) / total[1]) - np.log((held[0].get(s, 0) + 1) / total[0]) for s in {*held[0], *held[1]}}
    slots = sorted(ratio)
    place = {s: i for i, s in enumerate(slots)}
    row, column, value = [], [], []
    for i, (t, _) in enumerate(texts):
        x = {s: n * ratio[s] for s, n in naive_features(t).items()}
        norm = max(1e-12, sum(v * v for v in x.values()) ** 0.5)
        row += [i] * len(x)
        column += [place[s] for s in x]
        value += [v / norm for v in x.values()]
    w, b = fit(Rows(np.array(row), np.array(column), np.array(value), (len(texts), len(slots))), np.array([y == 1 for _, y in texts]), "logistic", 30.0, rounds=200)
    plain = np.bincount(row, np.array(value) * w[column], minlength=len(texts)) + b
    plain = dict(zip([t for t, _ in texts], 1 / (1 + np.exp(-plain))))
    for r in toxicity.score_toxicity(df, model).collect():
        assert abs(r["score"] - plain[r["text"]]) < 0.02


def test_packed_features():
    rng = np.random.default_rng(3)
    for n, most in ((0, 5), (1, 1 << 18), (4, 1 << 18), (3000, 1 << 18), (40, 41)):
        at = np.sort(rng.choice(most, n, replace=False))
        x = rng.normal(size=n)
        back, value = toxicity.unpacked(*toxicity.packed(at, x))
        kept = value != 0
        assert back[kept].tolist() == at[x != 0].tolist() and np.allclose(value[kept], x, rtol=1e-3, atol=1e-6)
        assert len(set(back.tolist())) == len(back) and (len(back) == 0 or back.max() < most)
    assert toxicity.unpacked(*toxicity.packed(np.array([0, 262143]), np.ones(2)))[0].tolist() == [0, 65535, 131070, 196605, 262140, 262143]


def test_descent_finds_the_minimum():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(40, 12))
    target = rng.normal(size=40)
    found = descend(lambda w: (0.5 * ((a @ w - target) ** 2).sum(), a.T @ (a @ w - target)), 12, 1e-8)
    assert np.allclose(found, np.linalg.lstsq(a, target, rcond=None)[0], atol=1e-5)
    assert not descend(lambda w: (0.0, np.zeros(3)), 3).any()


def test_sample_holds_each_text_once(spark):
    rows = [(1, "copy", 1)] * 50 + [(i, "copy", 1) for i in range(50)] + [(7, f"t{i}", 0) for i in range(20)] + [(8, None, 0), (9, "copy", 0)]
    labelled = spark.createDataFrame(rows, "id bigint, text string, label bigint")
    got = [tuple(r) for r in toxicity._sample(labelled, 1000).collect()]
    assert sorted(got, key=str) == sorted({(t, y) for _, t, y in rows}, key=str)
    assert toxicity._sample(labelled, 5).count() == 5


def test_copies_do_not_crowd_out_other_toxic_words(spark):
    rng = random.Random(6)
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    copied = " ".join("".join(rng.choices(alphabet, k=6)) for _ in range(1500))
    rows = [(i, sentences(rng, i % 6 == 0), int(i % 6 == 0)) for i in range(900)]
    rows += [(1000 + i, copied, 1) for i in range(450)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    seen = df.filter("doc_id < 600 OR doc_id >= 1000")
    model = toxicity.train(toxicity.labelled_texts(seen.drop("toxic"), df.select("doc_id", "toxic")))
    scored = toxicity.score_toxicity(df.filter("doc_id >= 600 AND doc_id < 1000"), model).collect()
    assert sum(r["score"] >= 0.5 for r in scored if r["toxic"] == 1) >= 0.9 * sum(r["toxic"] for r in scored)
    assert sum(r["score"] >= 0.5 for r in scored if r["toxic"] == 0) <= 0.02 * len(scored)
