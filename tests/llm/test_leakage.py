import random

from footmesh.llm import leakage as K
from footmesh.llm.lookalike import normal_texts


def brute(docs, items, run):
    grams = {}
    for k, t in items:
        w = K.words_of(normal_texts([t])[0])
        for s in range(len(w) - run + 1):
            grams.setdefault(tuple(w[s : s + run]), set()).add(k)
    out = set()
    for d, t in docs:
        w = K.words_of(normal_texts([t])[0])
        for s in range(len(w) - run + 1):
            out |= {(d, k) for k in grams.get(tuple(w[s : s + run]), ())}
    return out


def found(spark, docs, items, run=K.RUN):
    d = spark.createDataFrame([(*r, 7) for r in docs], "doc_id bigint, text string, item_id bigint")
    i = spark.createDataFrame([(*r, "s") for r in items], "item_id bigint, text string, suite string")
    got = [tuple(r) for r in K.leaks(d, "doc_id", "text", i, "item_id", "text", run).collect()]
    assert len(got) == len(set(got))
    return set(got)


def data(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["the", "a", "of"] * 10 + [str(k) for k in range(40)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(5, 120)))) for k in range(60)]
    docs = []
    for k in range(200):
        w = [rng.choice(words) for _ in range(rng.randrange(0, 300))]
        if k % 3 == 0:
            t = rng.choice(items)[1].split()
            s, n = rng.randrange(0, max(1, len(t) - 18)), rng.choice([18, 19, 20, 21, 40, 200])
            at = rng.randrange(0, len(w) + 1)
            w[at:at] = t[s : s + n]
        docs.append((k, rng.choice([" ", ", ", "\n# ", " "]).join(w)))
    return docs, items


def test_against_brute_force(spark, monkeypatch):
    docs, items = data(1)
    want = brute(docs, items, K.RUN)
    assert want and found(spark, docs, items) == want
    # many small indexes, several passes
    monkeypatch.setattr(K, "INDEX_CHARS", 1500)
    monkeypatch.setattr(K, "SENT", 2)
    assert found(spark, docs, items) == want


def test_edges(spark):
    text = " ".join(f"t{k}" for k in range(20))
    assert found(spark, [(1, text), (1, text), (2, None), (None, text), (3, ""), (4, text.upper().replace(" ", " # ")), (5, text[:-4])], [(9, text), (9, text), (8, None), (None, text), (7, ""), (6, "short item")]) == {(1, 9), (4, 9)}
    assert found(spark, [], [(9, text)]) == set() and found(spark, [(1, text)], []) == set()


def test_long_text_and_repeated_words(spark):
    item = "go " * 30
    far = "x " * 200_000 + item
    assert found(spark, [(1, far), (2, "go " * 19), (3, "go " * 50_000)], [(5, item), (6, "go " * 25)]) == {(1, 5), (1, 6), (3, 5), (3, 6)}


def test_hidden_characters(spark):
    text = " ".join(f"word{k}" for k in range(25))
    assert found(spark, [(1, text.replace("o", "ο").replace("d1", "d​1"))], [(5, text)]) == {(1, 5)}
