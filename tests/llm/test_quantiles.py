import math

import numpy as np
from hypothesis import given, settings, strategies as st

from folioflow.llm.quantiles import Sketch, build_sketches, merge_sketches, read_quantiles

AT = [0.01, 0.25, 0.5, 0.9, 0.99]


def check(values, s):
    v = np.sort(values)
    assert s.n == len(v)
    for q, x in zip(AT, s.quantiles(AT), strict=True):
        want = max(1, math.ceil(q * len(v)))
        assert np.searchsorted(v, x, "left") + 1 - s.rank_error() <= want <= np.searchsorted(v, x, "right") + s.rank_error()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 6000), st.integers(1, 9), st.sampled_from([8, 32, 128]), st.integers(0, 5))
def test_bound_and_merge(n, parts, k, seed):
    rng = np.random.default_rng(seed)
    values = rng.choice([rng.lognormal(2, 2, n), np.sort(rng.normal(size=n)), rng.integers(0, 5, n).astype(float)])
    whole = Sketch(k)
    for piece in np.array_split(values, parts):
        whole.merge(Sketch.unpack(Sketch(k).add(piece).pack()))
    check(values, whole)
    assert whole.rank_error() <= max(1, n * (math.log2(max(2, n / k)) + 2) / k)


def test_small_is_exact():
    s = Sketch().add(np.array([3.0, 1.0, np.nan, 2.0]))
    assert (s.n, s.invalid, s.rank_error(), s.quantiles([0, 0.5, 1])) == (3, 1, 0, [1.0, 2.0, 3.0])
    assert Sketch().quantiles([0.5]) == [None]


def test_frame(spark):
    rows = [("a", None, float(i % 100)) for i in range(9000)] + [("b", "", None), ("b", "", float("nan")), (None, "x", math.inf)]
    df = spark.createDataFrame(rows, "g string, h string, v double").repartition(7)
    sk = build_sketches(df, ["g", "h"], "v", k=256)
    got = {(r.g, r.h): r for r in read_quantiles(sk, ["g", "h"], {"p50": 0.5}).collect()}
    assert got["a", None].n == 9000 and abs(got["a", None].p50 - 49) * 90 <= got["a", None].rank_error + 90
    assert (got["b", ""].n, got["b", ""].n_invalid, got["b", ""].p50) == (0, 2, None)
    assert got[None, "x"].p50 == math.inf
    assert build_sketches(df.limit(0), ["g", "h"], "v").count() == 0
    again = read_quantiles(merge_sketches(sk, ["h"]), ["h"], {"p50": 0.5})
    assert sum(r.n for r in again.collect()) == 9001


def test_many_groups_and_buffer_sizes(spark, monkeypatch):
    from folioflow.llm import quantiles as Q

    monkeypatch.setattr(Q, "MOST_GROUPS", 5)
    df = spark.range(3000).selectExpr("id % 40 as g", "cast(id div 40 as double) as v").coalesce(1)
    got = {r.g: (r.n, r.p50) for r in Q.read_quantiles(Q.build_sketches(df, ["g"], "v"), ["g"], {"p50": 0.5}).collect()}
    assert len(got) == 40 and all(n == 75 and abs(p - 37) <= 1 for n, p in got.values())
    import numpy as np

    for error, n in ((0.05, 5000), (0.01, 40_000)):
        s = Q.Sketch(Q.buffer_size(error, n))
        s.add(np.random.default_rng(1).normal(size=n))
        assert s.rank_error() <= error * n
