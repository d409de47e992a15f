import math
import re
from collections import Counter

from pyspark.sql import functions as F

from weft.llm import top_k
from weft.llm.top_k import Search


def brute(docs, queries, k=10, k1=1.2, b=0.75):
    words = [(i, Counter(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t in docs]
    n, mean = len(words), sum(sum(c.values()) for _, c in words) / max(len(words), 1)
    df = Counter(w for _, c in words for w in c)
    out = []
    for q, text in queries:
        if q is None:
            continue
        asked = sorted(set(re.findall(r"[^\x20\x09-\x0D]+", text or "")))
        found = []
        for i, c in words:
            if i is not None:
                size = sum(c.values())
                s = sum(math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * (k1 + 1) / (c[w] + k1 * (1 - b + b * size / mean)) for w in asked if w in c)
                if s > 0:
                    found.append((-round(s, 6), i))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


def same(got, want):
    got = sorted(map(tuple, got))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) < 2e-6 for g, w in zip(got, want))


def test_results_are_those_of_scoring_all(spark, rows):
    every = [r[:3] for r in rows] + [(None, rows[0][1], "en"), (500, rows[1][1], None), (500, rows[1][1], None)]
    docs = spark.createDataFrame(every, "doc_id long, text string, lang string").withColumn("score", F.lit("x")).withColumn("found", F.lit(1))
    queries = docs.filter("doc_id % 3 = 0 or doc_id is null")
    want = brute([e[:2] for e in every], [e[:2] for e in every if e[0] is None or e[0] % 3 == 0])
    same(top_k.search(docs, queries).collect(), want)
    same(top_k.search(docs, queries, Search(round_terms=300, round_queries=5, index=16, block=2, frequent=0.3, columns=7)).collect(), want)
    same(top_k.search(docs.drop("lang").repartition(7), queries, Search(index=5, block=3, frequent=2.0)).collect(), want)


def test_empty_tables(spark, empty, documents):
    assert top_k.search(empty, empty).count() == 0
    assert top_k.search(documents, documents.filter("doc_id < 0")).count() == 0


def test_blocks_are_passed_by_and_nothing_is_lost():
    """On topics that differ many pairs of a query and a block are never met; long texts and repeated rows among them."""
    import numpy as np
    import pyarrow as pa

    from weft.llm.textblock import Block

    rng = np.random.default_rng(2)
    topics = [[f"t{k}w{j}" for j in range(60)] for k in range(12)]
    texts = [" ".join(rng.choice(topics[i // 80], 40)) + " the of" for i in range(960)]
    texts[7] = " ".join(rng.choice(topics[0], 90_000))
    texts[11] = texts[10]
    rows = list(enumerate(texts))
    queries = rows[::37]
    block, how = Block.of(pa.array(texts)), Search(k=3, block=16)
    doc, word, times = top_k.distinct(block)
    asked = [word[doc == i] for i, _ in queries]
    q = top_k.packed_round([i for i, _ in queries], asked)
    at = np.minimum(np.searchsorted(q.terms, word), len(q.terms) - 1)
    mine = q.terms[at] == word
    size = np.diff(block.words[3])
    scorer = top_k.Scorer(q, np.bincount(at[mine], minlength=len(q.terms)), len(rows), int(size.sum()), how)
    scorer.index(np.arange(len(rows)), size, doc[mine], at[mine], times[mine])
    best = scorer.best
    order = np.lexsort((best.doc, -best.score, best.query))
    got = [(int(q.ids[best.query[k]]), int(best.doc[k])) for k in order]
    assert got == [(w[0], w[2]) for w in brute(rows, queries, 3)]
    assert scorer.scored <= scorer.asked < 0.6 * scorer.pairs


def test_texts_are_read_once_and_shards_begin_with_known_scores(spark, rows):
    """However many rounds there are; a sixteenth of the indexes is searched first, and equal queries are one."""
    every = [r[:3] for r in rows] + [(100 + r[0], r[1], r[2]) for r in rows[:20]] + [(None, rows[0][1], "en")]
    plain = spark.createDataFrame(every, "doc_id long, text string, lang string").repartition(4).cache()
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    docs = plain.mapInArrow(counted, plain.schema)
    how = Search(k=4, round_queries=11, index=2, block=2, group=3)
    assert len(every) > top_k.FIRST * how.index
    same(top_k.search(docs, plain.filter("doc_id % 2 = 0"), how).collect(), brute([e[:2] for e in every], [e[:2] for e in every if e[0] is not None and e[0] % 2 == 0], 4))
    assert read.value == len(every)


def test_groups_end_where_the_language_changes():
    """But for very small ones."""
    import numpy as np

    label = np.repeat(["de", "en", "x", "y"], [300, 9000, 3, 400])
    edges = top_k.pieces(label, 4096)
    assert edges.tolist() == [0, 300, 3300, 6300, 9300, 9703]
    assert top_k.pieces(label[:0], 4096).tolist() == [0] and top_k.pieces(label[:5], 4096).tolist() == [0, 5]
