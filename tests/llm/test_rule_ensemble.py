import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from weft.llm import rule_ensemble
from weft.llm.rule_ensemble import STATISTICS
from weft.llm.textblock import Block

from .conftest import text


def corpus(n=600):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        t = text(rng, rng.randint(30, 120))
        bad = i % 4 == 0
        if bad:
            t = [t.upper(), t.replace(" ", "### "), "buy now " * 40, " | ".join(t.split())][i // 4 % 4]
        rows.append((i, t, int(not bad)))
    return rows


def test_held_out_rows_are_told_apart(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows] + [(None, None), (9000, "")], "doc_id long, text string").withColumn("upper", F.lit("x")).withColumn("label", F.lit(1))
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in rows] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in rule_ensemble.classify(docs, labels).collect()}
    assert len(got) == len(rows) + 2
    for r in got.values():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [(got[i].score, q) for i, _, q in rows if got[i].held_out]
    assert np.mean([(s >= 0.5) == q for s, q in held]) >= 0.95
    again = {r.doc_id: r.score for r in rule_ensemble.classify(docs.repartition(5), labels.repartition(2)).collect()}
    assert again == {k: r.score for k, r in got.items()}


def test_spark_expression_is_the_model(spark):
    rng = np.random.default_rng(0)
    x = rng.random((800, len(STATISTICS)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] < 0.7) | (x[:, 5] > 0.9)).astype(float)
    model = rule_ensemble.fit(x, y)
    want = 1 / (1 + np.exp(-(model.intercept + sum(w * rule_ensemble.holds(x, r) for r, w in model.rules))))
    assert np.mean((want > 0.5) == y) > 0.97 and len(model.rules) < 200
    rows = spark.createDataFrame([[i, *map(float, v)] for i, v in enumerate(x)], "i long, " + ", ".join(f"{s} double" for s in STATISTICS))
    got = np.array([r.score for r in rows.select("i", model.score().alias("score")).orderBy("i").collect()])
    assert np.allclose(got, want)


def test_statistics_by_hand():
    s = dict(zip(STATISTICS, rule_ensemble.statistics(Block.of(pa.array(["Ab ab ab, É!\nAb ab ab, É!\n12 | x", None])))[0]))
    assert np.isclose(s["log_words"], np.log(12)) and np.isclose(s["mean_word"], 22 / 11) and np.isclose(s["upper"], 4 / 22)
    assert np.isclose(s["dup_lines"], 1 / 3) and np.isclose(s["distinct"], 7 / 11) and np.isclose(s["same_as_last"], 0)
    assert np.isclose(s["digits"], 2 / 22) and np.isclose(s["bars"], 1 / 11) and np.isclose(s["words_per_line"], 11 / 3)


def test_labels_of_one_kind_and_empty_tables(spark, documents, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in rule_ensemble.classify(documents, none).collect()} == {0.5}
    assert rule_ensemble.classify(empty, none).count() == 0


def plain_statistics(text):
    """Each statistic from the text, character by character."""
    text, word = text or "", re.compile(r"[^\x20\x09-\x0D]+")
    words, lines = word.findall(text), [x for x in text.split("\n") if word.search(x)]
    n, chars, n_lines = max(len(words), 1), max(sum(map(len, words)), 1), max(len(lines), 1)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    repeated = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 8)}
    upper = lambda c: "A" <= c <= "Z" or "À" <= c <= "Þ"
    letters = lambda w: sum(1 if c.isascii() and c.isalpha() else len(c.encode()) * (not c.isascii()) for c in w)
    share = lambda some, of=n: sum(c in some for c in text) / of
    return [
        math.log1p(len(words)), sum(map(len, words)) / n, share("#*$%&|<>"), sum(map(upper, text)) / chars, (len(lines) - len(set(lines))) / n_lines, len(repeated) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n, len(set(words)) / n, share(".,;:?"), share("!"), share("|"), share("0123456789", chars), n / n_lines, sum(not c.isascii() for c in text) / chars,
        sum("A" <= w[0] <= "Z" and len(w) > 1 and "a" <= w[1] <= "z" for w in words) / n, sum(2 * letters(w) < len(w.encode()) for w in words) / n,
    ]


def test_statistics_are_those_of_the_definitions(spark, rows):
    more = ["A", "a b A", "Éa éa Ab", "x! y? #5 12 a|b", "same same other other\nsame same other other\n", None, "", "word " * 20_000]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([r[1] for r in rows] + more)], "doc_id long, text string")
    for r in rule_ensemble.described(docs).collect():
        want = plain_statistics(([x[1] for x in rows] + more)[r.doc_id])
        assert np.allclose([r[s] for s in rule_ensemble.STATISTICS], want, atol=1e-9), r.doc_id


def test_lasso_is_at_its_optimum():
    rng = np.random.default_rng(3)
    z = (rng.random((800, 12)) < 0.4).astype(np.float32)
    z = (z - z.mean(axis=0)) / z.std(axis=0)
    y = (rng.random(800) < 1 / (1 + np.exp(-(z[:, 0] * 1.5 - z[:, 1] + 0.3)))).astype(float)
    for penalty in (0.05, 0.01):
        w = rule_ensemble.lasso(z, y, penalty, np.zeros(13), steps=800)
        p = 1 / (1 + np.exp(-(w[0] + z @ w[1:])))
        gradient = z.T @ (p - y) / len(y)
        assert abs(np.mean(p - y)) < 1e-3
        for g, x in zip(gradient, w[1:]):
            assert abs(g + penalty * np.sign(x)) < 1e-3 if abs(x) > 1e-4 else abs(g) <= penalty + 1e-3


def test_repeated_rows_and_long_texts_score_alike(spark, rows):
    docs = spark.createDataFrame([(1, rows[0][1]), (1, rows[0][1]), (2, rows[0][1] * 900), (3, rows[0][1] * 900), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (3, 0)], "doc_id long, quality int")
    got = rule_ensemble.classify(docs, labels).collect()
    assert len(got) == 5 and len({r.score for r in got if r.doc_id in (2, 3)}) == 1 and all(0 <= r.score <= 1 for r in got)
