import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weft.llm import recompression
from weft.llm.textblock import Block


def brute(rows, width=35):
    words = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows]
    count = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for r, w in zip(rows, words):
        gone = {j for i in range(len(w) - width + 1) if count[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        out.append((str(r[0]), len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out)


def test_against_every_window(spark, rows):
    every = [r[:2] for r in rows] + [(None, rows[0][1]), (None, rows[55][1]), (0, rows[0][1]), (900, "b " * 34), (901, "c " * 35), (902, "c " * 36), (903, "x " + "a " * 60 + "y"), (904, "z " + "a " * 34 + "y")]
    given_ = spark.createDataFrame(every, "doc_id long, text string").withColumn("part", F.lit("x")).withColumn("kind", F.lit(1))
    got = recompression.dedup(given_).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == brute(every)


def test_near_copies_in_numbers(spark):
    rng = np.random.default_rng(4)
    base = [str(x) for x in rng.integers(0, 40, 300)]
    rows = []
    for i in range(200):
        text = list(base)
        for k in rng.integers(0, 300, rng.integers(0, 6)):
            text[k] = str(rng.integers(0, 40))
        rows.append((i, " ".join(text[int(rng.integers(0, 60)) :])))
    for hot in (4096, 0, 3):
        got = recompression.dedup(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == brute(rows)


def test_empty_table(empty):
    assert recompression.dedup(empty).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from("ab"), min_size=40, max_size=120), st.lists(st.sampled_from("abc"), max_size=40), st.lists(st.sampled_from("abc"), max_size=40))
def test_equal_windows_have_equal_anchors(middle, before, after):
    windows = recompression.WordWindows(35)
    seen: dict = {}
    for words in (middle, before + middle + after, after + middle):
        block = Block.of(pa.array(["q r s", " ".join(words)]))
        runs = windows.runs(block, None)
        total = 0
        for name, a, z, anchor in zip(runs.name.tolist(), runs.start.tolist(), runs.end.tolist(), runs.anchor.tolist()):
            for s in range(a, z):
                total += 1
                window = tuple(words[s - 3 : s - 3 + 35])
                assert seen.setdefault(window, (name, anchor - (s - a))) == (name, anchor - (s - a))
        assert total == max(0, len(words) - 34)
