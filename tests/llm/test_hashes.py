"""Names by hashes: structured texts that cancel out in polynomials, and hashes made so weak that collisions abound."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import test_chosen_path, test_packing, test_quality_rules, test_recompression, test_suffix_dedup, test_top_k
from weft.llm import chosen_path, packing, quality_rules, recompression, registry, suffix_dedup, textblock, top_k
from weft.llm.repeats import ARROW, Repeats
from weft.llm.textblock import Block

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def thue_morse(n, a, b):
    return [(a, b)[k.bit_count() & 1] for k in range(n)]


def pairs():
    """Texts that differ as a sequence and its complement: as one word, as lines, and as words."""
    out = []
    for n in (1024, 2048):
        x, y = thue_morse(n, "a", "b"), thue_morse(n, "b", "a")
        out += ["".join(x), "".join(y), "".join(x) + "\n" + "".join(y) + "\n" + "".join(x)]
        out += [" ".join(thue_morse(n, "one", "two")), " ".join(thue_morse(n, "two", "one"))]
        big = lambda w: " ".join(f"{w}{k} " + "x" * (k % 3) for k in range(40))
        out += [f"{big('p')} {''.join(x)} {big('q')}", f"{big('r')} {''.join(y)} {big('s')}"]
    return [(k, t, "en", None, len(t)) for k, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(pairs(), SCHEMA)


def test_op2(docs):
    test_packing.check(pairs(), packing.pack(docs, test_packing.PATH, 2048).collect(), 2048)


def test_op3(docs):
    for r in quality_rules.score(docs, registry.FERTILITY).collect():
        want = test_quality_rules.brute(pairs()[r.doc_id][1])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want


def test_op4(docs):
    assert sorted(map(tuple, chosen_path.join(docs).collect())) == sorted(test_chosen_path.brute(pairs()))


def test_op5(docs):
    got = suffix_dedup.dedup(docs).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == test_suffix_dedup.brute(pairs())


def test_op8(docs):
    got = recompression.dedup(docs).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == test_recompression.brute(pairs())


def test_op10(docs):
    rows = [r[:2] for r in pairs()]
    test_top_k.same(top_k.search(docs, docs).collect(), test_top_k.brute(rows, rows))


def locally(windows, rows, parts=4):
    """The passes of repeats.find without Spark, so that hashes can be replaced."""
    every = Repeats(windows, parts)
    tables = [pa.table({"doc_id": pa.array([r[0] for r in rows[k::parts]], pa.int64()), "text": [r[1] or "" for r in rows[k::parts]], "part": pa.array([k] * len(rows[k::parts]), pa.int32())}) for k in range(parts)]

    def by(column, found):
        table = pa.concat_tables([*found, ARROW.empty_table()])
        return {k: table.filter(pa.compute.equal(table.column(column), k)) for k in set(table.column(column).to_pylist())}

    marked = by("part", [every.mark(t) for t in by("bucket", map(every.names, tables)).values()])
    sent = by("bucket", [every.send(t, marked.get(k, ARROW.empty_table())) for k, t in enumerate(tables)])
    settled = by("part", [every.settle(t) for t in sent.values()])
    return {d: (block, starts, i) for k, t in enumerate(tables) for found, block, starts in every.repeated(t, settled.get(k, ARROW.empty_table())) for i, d in enumerate(found.column("doc_id").to_pylist())}


def weak(monkeypatch, bits, *modules):
    """Codes and sequence hashes keep some bits only; what is left is spread, as buckets ask for."""
    for name in ("span_codes", "window_codes", "sequence_codes"):
        own = getattr(textblock, name)
        less = lambda *a, own=own: textblock.mix(own(*a) & np.uint64((1 << bits) - 1))
        for m in (textblock, *modules):
            if hasattr(m, name):
                monkeypatch.setattr(m, name, less)


def random_rows(rng):
    words = [f"w{k}" + "é" * (k % 9) for k in range(60)]
    passage = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(4)]
    return [(k, " ".join([*(rng.choice(words) for _ in range(rng.randrange(60))), rng.choice(passage), *(rng.choice(words) for _ in range(9)), rng.choice(passage)])) for k in range(40)]


@pytest.mark.parametrize("bits", [2, 6, 64])
def test_collisions_don_t_change_what_op5_and_op8_find(monkeypatch, bits):
    rows = random_rows(random.Random(bits))
    weak(monkeypatch, bits, suffix_dedup, recompression)
    for windows, brute, text in ((suffix_dedup.ByteWindows(), test_suffix_dedup.brute, 2), (recompression.WordWindows(), test_recompression.brute, 2)):
        want = {r[0]: r[text] for r in brute(rows)}
        for d, (block, starts, i) in locally(windows, rows).items():
            edge = block.words[3] if isinstance(windows, recompression.WordWindows) else block.bounds
            mine = starts[(starts >= edge[i]) & (starts < edge[i + 1])]
            gone = textblock.covered(np.sort(mine), int(edge[-1]), windows.width)
            assert int(gone[edge[i] : edge[i + 1]].sum()) == want[str(d)]


@pytest.mark.parametrize("bits", [1, 5])
def test_collisions_don_t_change_words_or_shingles(monkeypatch, bits):
    rng = random.Random(bits)
    texts = [" ".join(rng.choice(["ab", "abcdefgh", "abcdefghi", "y" * 300, "y" * 299 + "z", "é" * 5]) for _ in range(rng.randrange(30))) for _ in range(30)]
    weak(monkeypatch, bits)
    block = Block.of(pa.array(texts))
    words = [w for t in texts for w in t.split()]
    assert len(set(zip(block.numbers.tolist(), words, strict=True))) == len(set(words)) == len(set(block.numbers.tolist()))
    number, doc = chosen_path.numbered_shingles(block, 5)
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (t.split() for t in texts)]
    found = [set(number[doc == k].tolist()) for k in range(len(texts))]
    assert [[len(a & b) for b in found] for a in found] == [[len(a & b) for b in sets] for a in sets]
