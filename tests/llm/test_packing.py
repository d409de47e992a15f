import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weft.llm import packing, registry

PATH = str(registry.VOCABULARIES / "word_bpe_49k.json")


def check(rows, got, capacity):
    tokenizer = Tokenizer.from_file(PATH)
    by_doc, places = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc_id, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        mine = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(-(-len(ids) // capacity)))
        for r in mine:
            part = ids[r.start : r.start + r.length]
            assert r.start == r.piece * capacity and len(part) == r.length
            assert r.ids_crc32 == zlib.crc32(np.array(part, dtype="<u4").tobytes())
        assert sum(r.length for r in mine) == len(ids)
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places), sum(r.length for r in got)


def test_every_piece_has_its_place(documents, rows):
    for capacity in (64, 2048):
        sequences, total = check(rows, packing.pack(documents, PATH, capacity).collect(), capacity)
        assert sequences <= 1.1 * total / capacity + 2


def test_repeated_rows_and_more_columns(documents, rows):
    twice = documents.union(documents).withColumn("piece", F.lit("x")).withColumn("slice", F.lit(1))
    got = packing.pack(twice, PATH, 2048).collect()
    assert len(got) == 2 * packing.pack(documents, PATH, 2048).count()
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)


def test_empty_table(empty):
    assert packing.pack(empty, PATH).count() == 0


def test_plan_uses_the_histogram_up_near_the_bound():
    rng = np.random.default_rng(3)
    lengths = np.clip(rng.lognormal(6, 1, 30_000).astype(int), 1, 2048)
    histogram = np.bincount(lengths, minlength=2049)
    used = np.zeros_like(histogram)
    planned = packing.plan(histogram, 2048)
    for pattern, n in planned:
        assert sum(pattern) <= 2048
        for x in pattern:
            used[x] += n
    assert (used == histogram).all()
    assert sum(n for _, n in planned) <= -(-lengths.sum() // 2048) + 3
