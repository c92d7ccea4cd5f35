import math
import random
import tracemalloc
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from brute import words

from passageway.llm import lmscore


def model(train, tables):
    """Probability of a word after another, by the formulas, from token lists; ``tables``: of each (context, word)."""
    count, word = Counter(), Counter()
    for tokens in train:
        word.update(tokens)
        count.update(zip(["", *tokens], tokens))
    n, v, kinds = sum(word.values()), len(word), len(count)
    contexts, followers, context_tables = Counter(w for _, w in count), Counter(u for u, _ in count), defaultdict(float)
    for (u, _), t in ((k, tables(k, c)) for k, c in count.items()):
        context_tables[u] += t
    share = lambda values: min(0.95, max(0.05, sum(x == 1 for x in values) / max(1, sum(x == 1 for x in values) + 2 * sum(x == 2 for x in values))))
    d0, d = share(contexts.values()), share(count.values())
    base = lambda w: (word[w] + 0.5) / (n + 0.5 * (v + 1))

    def p(u, w):
        parent = (max(0, contexts[w] - d0) + (1 + d0 * v) * base(w)) / (1 + kinds)
        if not word[u]:
            return parent
        c = count[u, w]
        return (c - d * (tables((u, w), c) if c else 0) + (1 + d * context_tables[u]) * parent) / (1 + word[u])

    return p, base, word, n


@pytest.fixture
def small_buckets(monkeypatch):
    monkeypatch.setattr(lmscore, "BUCKET_BYTES", 400)
    monkeypatch.setattr(lmscore, "BLOCK_BYTES", 300)


def corpus(repeat):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.sample(vocabulary, 12)) for _ in range(12)]
    if repeat:
        texts += texts[:6] * 3
    return texts + ["", None, "Unknown words only", "W1 w2\tw3\n w4"]


@pytest.mark.parametrize("repeat", [False, True])
def test_scores(spark, small_buckets, repeat):
    texts = corpus(repeat)
    rows = [(i, t, i % 5 == 4 or i >= len(texts) - 2, 1, 2) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, held_out boolean, score int, bucket int").repartition(3)
    got = {r["doc_id"]: r for r in lmscore.score_texts(df).collect()}
    assert len(got) == len(rows)
    tokens = {i: [*words(t), ""] for i, t, *_ in rows}
    train = [tokens[i] for i, _, held, *_ in rows if not held]
    # With one table a dish, and with a table a customer: without repeated pairs the same, else the bounds of the seating.
    few, base, word, n = model(train, lambda key, c: 1)
    many, *_ = model(train, lambda key, c: c)
    for i, _, held, *_ in rows:
        r, t = got[i], tokens[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, len(t), sum(word[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10(base(w)) for w in t))
        bounds = [sum(math.log10(p(u, w)) for u, w in zip(["", *t], t)) for p in (few, many)]
        if not repeat and len(set(zip(["", *t], t))) == len(t):
            assert min(bounds) - 0.35 <= r["score"] <= max(bounds) + 0.35  # pairs with the end may repeat
        assert r["score"] < 0
    if repeat:
        assert all(got[i]["score"] > got[i]["base_score"] for i in range(6))


def test_probabilities_add_up():
    rng = random.Random(1)
    train = [[*rng.choices("abcdef", k=8), ""] for _ in range(20)]
    p, base, word, n = model(train, lambda key, c: 1 + c // 3)
    assert sum(map(base, word)) + base("unknown") == pytest.approx(1)
    for u in ("a", "", "f"):
        assert sum(p(u, w) for w in word) + p(u, "unknown") == pytest.approx(1)


def test_tables_follow_their_conditional():
    """One dish: t has weight S(c, t) * parent^t * prod(strength + discount * k)."""
    rng = np.random.default_rng(0)
    for c, parent, d, s in ((2, 0.3, 0.5, 1.0), (7, 0.2, 0.7, 2.0), (40, 0.9, 0.3, 0.5)):
        stirling = lmscore.log_stirling(c, d)[c, 1:]
        weight = stirling + np.arange(1, c + 1) * math.log(parent) + np.cumsum(np.log(s + d * np.arange(c)))
        weight = np.exp(weight - weight.max())
        mean = (weight @ np.arange(1, c + 1)) / weight.sum()
        n = 6_000
        got = lmscore.sample_tables(np.full(n, c), np.arange(n), np.ones(n), np.full(n, parent), d, s, 3, 1, rng)
        assert abs(got.mean() - mean) < 0.1 and got.min() >= 1 and got.max() <= c
    large = lmscore.sample_tables(np.array([600, 100_000]), np.array([0, 0]), np.array([2.0]), np.array([0.1, 0.2]), 0.8, 1.0, 6, 3, rng)
    assert 1 <= large[0] < 600 and large[0] < large[1] < 100_000


def test_stirling():
    assert np.allclose(np.exp(lmscore.log_stirling(4, 0.5)[3, 1:4]), [0.5 * 1.5, 0.5 + 1.0, 1.0])


@pytest.mark.parametrize("texts", [["a b", "", " x ", "\t", "A a Ä ä", "a" * 3_000_000, "b\x0bc\x85d"], [""], ["", ""]])
def test_words(texts):
    hashed, numbers = lmscore._hashed([t.encode() for t in texts])
    expected = [[*words(t), ""] for t in texts]
    assert numbers.tolist() == [len(t) for t in expected]
    names = {}
    for h, w in zip(hashed.tolist(), (w for t in expected for w in t)):
        assert names.setdefault(h, w) == w
    assert len(set(names.values())) == len(names)
    assert (lmscore._from_six(lmscore._six(hashed)) == hashed).all()


def test_odd_rows(spark, odd_docs):
    rows = lmscore.score_texts(odd_docs.selectExpr("*", "doc_id % 2 = 0 AS held_out")).collect()
    assert len(rows) == 12 and sum(r["doc_id"] is None for r in rows) == 1
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (3, 4, 5)} == {1}
    nothing = lmscore.score_texts(odd_docs.selectExpr("*", "true AS held_out")).collect()
    assert all(r["train_tokens"] == r["n_known"] == 0 and r["base_score"] == pytest.approx(0, abs=1e-9) == r["score"] for r in nothing)
    assert lmscore.score_texts(odd_docs.selectExpr("*", "true AS held_out").filter("false")).count() == 0


def seat_by_seat(train, sweeps, kept, d0, d, s, base, rng):
    """Mean probabilities of the two-level Pitman-Yor model, its customers taken out and seated again one by one."""
    rooms, top = defaultdict(list), defaultdict(list)  # (context, word) or word: sizes of its tables
    n, tables, top_n, top_tables = Counter(), Counter(), 0, 0

    def parent(w):
        return (sum(top[w]) - d0 * len(top[w]) + (s + d0 * top_tables) * base(w)) / (s + top_n)

    def p(u, w):
        own = rooms[u, w]
        return (sum(own) - d * len(own) + (s + d * tables[u]) * parent(w)) / (s + n[u])

    def choose(sizes, discount, fresh):
        return rng.choices(range(len(sizes) + 1), [*(x - discount for x in sizes), fresh])[0]

    def change(u, w, sign):
        nonlocal top_n, top_tables
        own, above = rooms[u, w], top[w]
        k = choose(own, d, (s + d * tables[u]) * parent(w)) if sign > 0 else rng.choices(range(len(own)), own)[0]
        n[u] += sign
        if k < len(own):
            own[k] += sign
            if own[k]:
                return
            own.pop(k)
        else:
            own.append(1)
        tables[u] += sign
        k = choose(above, d0, (s + d0 * top_tables) * base(w)) if sign > 0 else rng.choices(range(len(above)), above)[0]
        top_n += sign
        if k == len(above):
            above.append(1)
            top_tables += 1
            return
        above[k] += sign
        if not above[k]:
            above.pop(k)
            top_tables -= 1

    names = [pair for tokens in train for pair in zip(["", *tokens], tokens)]
    for sweep in range(sweeps):
        for u, w in names:
            if sweep:
                change(u, w, -1)
            change(u, w, 1)
        if sweep >= sweeps - kept:
            yield p


def test_against_seating_one_by_one(spark, monkeypatch):
    """A context with very many dishes, spread over many buckets, is one restaurant below a sampled parent."""
    draw = np.random.default_rng(3)
    follower = (draw.pareto(0.7, 4_800) * 3).astype(int) % 600
    train = [" ".join(f"hot f{x}" for x in follower[i : i + 60]) for i in range(0, 4_800, 60)]
    asked = ["hot", "hot never", "hot f599", "hot f598 hot f597", *(f"hot f{x}" for x in range(0, 300, 10))]
    lists = [[*t.split(), ""] for t in train]
    _, base, word, total = model(lists, lambda key, c: 1)
    pairs = Counter(pair for x in lists for pair in zip(["", *x], x))
    contexts = Counter(w for _, w in pairs)
    share = lambda values: min(0.95, max(0.05, sum(x == 1 for x in values) / max(1, sum(x == 1 for x in values) + 2 * sum(x == 2 for x in values))))
    sums = np.zeros(len(asked))
    for p in seat_by_seat(lists, 12, 6, share(contexts.values()), share(pairs.values()), 1.0, base, random.Random(5)):
        for i, t in enumerate(asked):
            tokens = [*t.split(), ""]
            sums[i] += sum(math.log10(p(u, w)) for u, w in zip(["", *tokens], tokens)) / 6
    rows = [(i, t, False) for i, t in enumerate(train)] + [(10_000 + i, t, True) for i, t in enumerate(asked)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, held_out boolean").repartition(4)
    monkeypatch.setattr(lmscore, "BUCKET_BYTES", 2_000)
    got = {r["doc_id"]: r["score"] for r in lmscore.score_texts(df).filter("held_out").collect()}
    off = np.array([got[10_000 + i] for i in range(len(asked))]) - sums
    assert abs(off[:4]).max() < 0.2 and abs(off.mean()) < 0.12, off.round(3).tolist()


def cells_of(texts, held, buckets, monkeypatch):
    monkeypatch.setattr(lmscore.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array(held)], names=["k", "text", "held"])
    return pa.Table.from_batches(list(lmscore._cells(buckets)(iter([batch]))))


@pytest.mark.parametrize("key_bits", [64, 0])
def test_cells_give_back_pairs(monkeypatch, key_bits):
    """Also where the numbers of an entry do not fit into one."""
    monkeypatch.setattr(lmscore, "KEY_BITS", key_bits)
    monkeypatch.setattr(lmscore, "BLOCK_BYTES", 300)
    texts = corpus(True)
    held = [i % 3 == 0 for i in range(len(texts))]
    rows = cells_of(texts, held, 3, monkeypatch)
    names = {h: t for text in texts for h, t in zip(lmscore._hashed([(text or "").encode()])[0].tolist(), [*words(text), ""])}
    got, documents = Counter(), Counter()
    for bucket in range(3):
        x = lmscore.Bucket(rows.filter(pc.equal(rows["bucket"], bucket)))
        for i, j, n in zip(x.iu.tolist(), x.iw.tolist(), x.count.tolist()):
            got[names[int(x.words[i])], names[int(x.words[j])]] += n
        assert x.is_context[x.iu].all() and x.is_dish[x.iw].all() and (x.is_context | x.is_dish).all()
        documents.update(dict(enumerate(np.bincount(x.pair, x.number).astype(int).tolist())))
    tokens = [[*words(t), ""] for t in texts]
    want = Counter(p for t, h in zip(tokens, held) if not h for p in zip(["", *t], t))
    assert +got == want and sum(documents.values()) == sum(map(len, tokens))


def test_cells_name_a_word_once(monkeypatch):
    """A word that many others follow and precede is sent with its place, no row holds a flag a document."""
    texts = [f"common w{i} common v{i}" for i in range(3000)]
    rows = cells_of(texts, [False] * len(texts), 1, monkeypatch)
    rows = rows.filter(pc.equal(rows["kind"], 0))
    assert rows.num_rows == 1 and len(rows["e"][0].as_py()) < 100
    assert len(lmscore._from_gaps(rows["a"][0].as_py())) == 6002


def test_sums_of_a_task_come_together(monkeypatch):
    line = np.array([1.0, 9.0, 3.0]).tobytes()
    row = lambda bucket, block, value: (
        bucket, block, 0, lmscore._bits(np.array([True, False, True])), *[lmscore._planes(np.full(2, value), "<f8")] * 2, lmscore._planes(np.ones(2), "<u4"), line
    )
    given = lmscore._table([row(0, 5, -1.5), row(1, 5, -2.0), row(1, 6, -1.0), row(2, 5, -1.0)]).to_batches()
    for most, n in ((lmscore.HELD_DOCS, 2), (3, 3)):
        monkeypatch.setattr(lmscore, "HELD_DOCS", most)
        out = pa.Table.from_batches(list(lmscore._together(given))).to_pylist()
        assert len(out) == n
        x = lmscore.Sums(3)
        for r in out:
            if r["block"] == 5:
                x.add(r)
        assert x.values.tolist() == [[-4.5, 0, -4.5], [-4.5, 0, -4.5], [3, 0, 3]] and x.present.tolist() == [True, False, True]


def test_blocks_are_held_narrowly(monkeypatch):
    """The bytes that a map task holds for a block, its cells included."""
    rng = random.Random(8)
    texts = [" ".join(f"w{int(rng.paretovariate(0.7)) % 20_000}" for _ in range(300)) for _ in range(1000)]
    tracemalloc.start()
    cells_of(texts, [False] * len(texts), 2, monkeypatch)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held < 120 * 301 * len(texts)
