import re
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weft.llm import mixing


def want_targets(rows):
    sizes = defaultdict(int)
    for _, text, _, source, _ in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, out = 1.5 * sum(sizes.values()), {}
    out = {s: total * weight[s] / sum(weight.values()) for s in names}
    while any(out[s] > 2 * sizes[s] + 1e-9 for s in names):
        over = [s for s in names if out[s] > 2 * sizes[s] + 1e-9]
        excess = sum(out[s] - 2 * sizes[s] for s in over)
        out.update({s: 2.0 * sizes[s] for s in over})
        under = [s for s in names if out[s] < 2 * sizes[s] - 1e-9]
        for s in under:
            out[s] += excess * weight[s] / sum(weight[x] for x in under)
    return sizes, out


def reachable(sizes):
    """Sums in which every size counts once or twice, or never or once, as the operator's whole copies have it."""
    sums = {0}
    for x in sizes:
        sums |= {a + x for a in sums}
    return sums | {x + sum(sizes) for x in sums}


def test_targets_are_met(documents, rows):
    got = mixing.mix(documents).collect()
    assert len(got) == len(rows)
    sizes, goals = want_targets(rows)
    source = {r[0]: r[3] for r in rows}
    taken = defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - goals[s]) < 1e-6
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
    for s, goal in goals.items():
        assert abs(taken[s] - goal) == min(abs(x - goal) for x in reachable([r.size for r in got if source[r.doc_id] == s])), s
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(documents.repartition(3)).collect()))


def test_resampling_takes_what_the_mix_takes(documents):
    odd = documents.withColumn("size", F.lit("x")).withColumn("slice", F.lit(1)).withColumn("n", F.lit(1))
    assert mixing.resample(odd).columns == odd.columns
    copies = {r.doc_id: r["count"] for r in mixing.resample(odd).groupBy("doc_id").count().collect()}
    assert copies == {r.doc_id: r.taken // r.size for r in mixing.mix(documents).collect() if r.taken}


def test_one_size_and_empty(spark, empty):
    same = spark.createDataFrame([(i, "a b c", None) for i in range(1000)] + [(5000, None, "z")], "doc_id long, text string, source string")
    got = mixing.mix(same).collect()
    assert sum(r.taken for r in got) == 4500
    assert mixing.mix(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.integers(1, 4)), min_size=1, max_size=6, unique_by=lambda x: x[0]), st.integers(0, 200))
def test_knapsack_is_exact(items, budget):
    size, count = (np.array(x) for x in zip(*items, strict=True))
    sums = {0}
    for s, c in items:
        sums = {x + k * s for x in sums for k in range(c + 1)}
    got = mixing.knapsack(size, count, budget)
    assert (got <= count).all() and (size * got).sum() == max(x for x in sums if x <= budget)
