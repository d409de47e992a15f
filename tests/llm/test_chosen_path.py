import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import chosen_path
from weft.llm.chosen_path import Join
from weft.llm.components import components


def sets(rows):
    out = []
    for _, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute(rows):
    """Class and links of every row, by comparing all pairs."""
    every, n = sets(rows), len(rows)
    links, label = [0] * n, list(range(n))
    for i in range(n):
        for j in range(i):
            common = len(every[i] & every[j])
            if common and 9 * common >= 4 * (len(every[i]) + len(every[j])):
                links[i] += 1
                links[j] += 1
                a, b = label[i], label[j]
                if a != b:
                    label = [b if x == a else x for x in label]
    least = {k: min((r[0] for r, x in zip(rows, label) if x == k and r[0] is not None), default=None) for k in set(label)}
    return Counter((r[0], r[0] if least[x] is None else least[x], k) for r, x, k in zip(rows, label, links))


@pytest.fixture(scope="module")
def near():
    rng = random.Random(8)
    words = ["w%d" % i for i in range(300)]
    rows = []
    for family in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(20, 150))]
        for _ in range(rng.randint(1, 25)):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows), " ".join(text)))
    rows += [(None, rows[3][1]), (3, rows[3][1]), (2000, ""), (2001, None), (2002, "a b"), (2003, "a  b"), (2004, "a b c")]
    return rows


def got(df):
    return Counter(tuple(r) for r in df.collect())


def test_all_links_are_found(spark, near, rows):
    for given in (near, [r[:2] for r in rows]):
        docs = spark.createDataFrame(given, "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("th", F.lit(1)).withColumn("cid", F.lit(1))
        assert got(chosen_path.join(docs)) == brute(given)


def test_splits_and_chunks_change_nothing(spark, near):
    docs = spark.createDataFrame(near, "doc_id long, text string")
    assert got(chosen_path.join(docs, Join(node=10, brute=4, chunk=3))) == brute(near)


def test_recall_right_at_the_similarity():
    """Signatures of pairs with similarity 0.8: almost all meet in a node at the root and within large nodes."""
    rng = np.random.default_rng(2)
    how, n = Join(), 3000
    base = rng.integers(0, 1 << 16, (n, chosen_path.TOKENS)).astype("<u2")
    other = np.where(rng.random(base.shape) < 0.8, base, rng.integers(0, 1 << 16, base.shape)).astype("<u2")
    sig = np.concatenate([base, other])
    pairs = {tuple(sorted((p, int(o)))) for p, others in chosen_path.links_in(sig, how, rng) for o in others}
    assert sum((i, i + n) in pairs for i in range(n)) >= 0.995 * n


def test_keeps_the_first_of_each(spark, near):
    docs = spark.createDataFrame(near, "doc_id long, text string").withColumn("class_id", F.lit("x"))
    kept = chosen_path.first_of_each(docs)
    assert kept.columns == docs.columns
    groups = {}
    for k, top, _ in brute([(k, t) for k, (_, t) in enumerate(near)]):
        groups.setdefault(top, []).append(near[k][0])
    want = sorted(str(min(ids, key=lambda x: (x is None, x or 0))) for ids in groups.values())
    assert sorted(str(r.doc_id) for r in kept.collect()) == want


def test_empty_table(empty):
    assert chosen_path.join(empty).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)]
    label = {}
    for e in edges:
        for x in e:
            label.setdefault(x, x)
    for _ in edges:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    want = {x: k for x, k in label.items() if x != k}
    assert {r.u: r.v for r in components(spark.createDataFrame(edges, "u long, v long")).collect()} == want
