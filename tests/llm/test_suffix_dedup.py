import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weft.llm import suffix_dedup, suffix_sort


def brute(rows, width=50):
    least = {}
    for doc_id, text, *_ in rows:
        data = (text or "").encode()
        for i in range(len(data) - width + 1):
            if doc_id is not None:
                least[data[i : i + width]] = min(doc_id, least.get(data[i : i + width], doc_id))
    out = []
    for doc_id, text, *_ in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - width + 1):
            if doc_id is not None and least[data[i : i + width]] < doc_id:
                gone[i : i + width] = b"\1" * width
        spans = len(bytes(gone).replace(b"\0", b" ").split())
        out.append((str(doc_id), len(data), sum(gone), spans, bytes(b for b, g in zip(data, gone) if not g)))
    return sorted(out)


def test_against_every_window(spark, documents, rows):
    more = [(None, rows[0][1]), (5000, rows[0][1]), (5000, rows[1][1]), (5001, "é" * 200), (5002, "é" * 90), (5003, "ab" * 60)]
    every = [r[:2] for r in rows] + more
    given_ = spark.createDataFrame(every, "doc_id long, text string").withColumn("part", F.lit("x")).withColumn("kind", F.lit(1))
    got = suffix_dedup.dedup(given_).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == brute(every)


def test_near_copies_in_numbers(spark):
    rng = np.random.default_rng(4)
    base = "".join(map(chr, rng.integers(97, 101, 700)))
    rows = []
    for i in range(300):
        text = list(base)
        for k in rng.integers(0, 700, rng.integers(0, 6)):
            text[k] = chr(int(rng.integers(97, 101)))
        rows.append((i, "".join(text)[int(rng.integers(0, 99)) :]))
    for hot in (4096, 0, 3):
        got = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == brute(rows)


def test_empty_table(empty):
    assert suffix_dedup.dedup(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text("ab", min_size=12, max_size=80), st.integers(1, 9), st.integers(0, 99))
def test_suffixes_in_order(text, width, seed):
    data = np.frombuffer(text.encode(), np.uint8)
    rng = np.random.default_rng(seed)
    suffix = rng.permutation(len(data) - width + 1)
    group = np.sort(rng.integers(0, 3, len(suffix)))
    got = suffix_sort.equal_classes(data, width, suffix, group)
    for i in range(len(suffix)):
        for j in range(i):
            same = group[i] == group[j] and text[suffix[i] :][:width] == text[suffix[j] :][:width]
            assert (got[i] == got[j]) == same
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.append(edge, len(group)))
    order = suffix_sort.Suffixes(data, width).sort(suffix, np.repeat(edge, sizes), np.repeat(sizes, sizes))
    for a, n in zip(edge, sizes):
        mine = [text[s:][:width] for s in order[a : a + n]]
        assert mine == sorted(mine)


@pytest.mark.parametrize("codes", [np.ones(256), np.arange(256) & 1, np.arange(256) << 62])
def test_a_collision_is_settled_on_bytes(monkeypatch, codes):
    """With codes that tell few bytes apart, or lose their high bits, the hashes' order is wrong, and noticed."""
    monkeypatch.setattr(suffix_sort, "BYTE_CODE", codes.astype(np.uint64))
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 400).astype(np.uint8)
    suffix, group = rng.permutation(390), np.sort(rng.integers(0, 5, 390))
    got = suffix_sort.equal_classes(data, 4, suffix, group)
    keys = [(g, data[s : s + 4].tobytes()) for s, g in zip(suffix, group)]
    assert len(set(zip(got.tolist(), keys))) == len(set(got.tolist())) == len(set(keys))
