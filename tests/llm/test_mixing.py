import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from footmesh.llm import mixing as M


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(1, 1000)), max_size=60), st.integers(0, 2**31))
def test_pivotal_keeps_mass(items, seed):
    p, w = np.array([a for a, _ in items]), np.array([b for _, b in items], float)
    out = M.pivotal(p, w, np.random.default_rng(seed).random(len(p)))
    assert ((out > 0) & (out < 1)).sum() <= 1 and ((out >= 0) & (out <= 1)).all()
    assert abs(out @ w - p @ w) <= 1e-6 * max(1, w.sum())


def test_pivotal_keeps_expectations():
    p, w = np.array([0.3, 0.7, 0.5, 0.2]), np.array([5.0, 1.0, 3.0, 2.0])
    rng = np.random.default_rng(1)
    mean = np.mean([M.pivotal(p, w, rng.random(4)) for _ in range(20_000)], axis=0)
    assert np.abs(mean - p).max() < 0.02


def test_cascade_reaches_target():
    rng = np.random.default_rng(2)
    w = np.floor(rng.pareto(1.2, 3000) * 50) + 1
    got = M.cascade(w, 0.37 * w.sum(), w.sum(), 1, rng.random(len(w)), rng.random(len(w)))
    assert set(np.unique(got)) <= {0.0, 1.0} and abs(got @ w - 0.37 * w.sum()) <= 4


def mix(spark, rows, targets, **kw):
    d = spark.createDataFrame([(*r, "z") for r in rows], "doc_id bigint, text string, source string, src string")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    mixed, plan = M.mix_sources(d, "doc_id", "text", "source", t, "source", "target_share", "max_repeats", **kw)
    return mixed.collect(), {r.source: r for r in M.mix_shares(mixed, plan).collect()}


def test_shares_and_caps(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET", 50)
    monkeypatch.setattr(M, "FAN_IN", 3)
    monkeypatch.setattr(M, "LARGE", 0.01)
    rng = np.random.default_rng(3)
    rows = [(k, "word " * int(rng.integers(1, 60)), ["Big Source", "big-source", "BIG_SOURCE "][k % 3]) for k in range(2000)] + [(5000 + k, "tiny text here " * 3, "small") for k in range(40)] + [(9000, "x", None), (9001, "x", "other"), (9002, None, "small"), (9003, "", "small")]
    targets = [("big_source", 0.7, 1), ("small", 0.25, 4), ("absent", 0.05, 9)]
    out, shares = mix(spark, rows, targets)
    assert len({r.doc_id for r in out}) == len(out) == 2042 and {r.src for r in out} == {"bigsource", "small"}
    assert all(0 <= r.copies <= (1 if r.src == "bigsource" else 4) for r in out)
    assert abs(shares["small"].actual_share - 0.25 / 0.95) < 0.002 and shares["absent"].actual_share == 0
    assert abs(sum(s.actual_share for s in shares.values()) - 1) < 1e-9
    again, _ = mix(spark, rows, targets)
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))
    _, short = mix(spark, rows, targets, total_tokens=1000)
    assert abs(short["big_source"].mix_tokens - 700) <= 60


def test_degenerate(spark):
    out, shares = mix(spark, [], [("a", 1.0, 1)])
    assert out == [] and shares["a"].actual_share == 0
    out, shares = mix(spark, [(1, "text", "a")], [])
    assert out == [] and shares == {}
    out, shares = mix(spark, [(1, "some text", "a"), (1, "some text", "a")], [("a", 0.5, None), (" A", 0.5, 3), (None, 0.2, 1), ("b", 0.0, 1)])
    assert [r.copies for r in out] == [1, 1] and len(shares) == 1


def test_tokens_of_whole_long_text(spark):
    d = spark.createDataFrame([(1, "a b " * 100_000), (2, None), (3, "")], "id bigint, t string")
    got = {r.id: r.n_tokens for r in M.token_counts(d, "t").collect()}
    assert got[1] > 150_000 and got[2] == got[3] == 0
