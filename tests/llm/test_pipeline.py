import re
from collections import Counter

import corpus_pipeline
from weft.llm import chosen_path, quality_rules, registry

from . import test_chosen_path, test_mixing, test_packing, test_secrets


def as_rows(df):
    return [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect()]


def test_each_stage_does_its_work_on_what_is_left(spark, documents, rows):
    docs, before = documents, rows
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == documents.columns
        docs = spark.createDataFrame(after := as_rows(docs), documents.schema)
        if name == "quality_rules":
            kept = {r.doc_id for r in quality_rules.score(documents, registry.FERTILITY).collect() if r.kept}
            assert Counter(after) == Counter(r for r in before if r[0] in kept) and kept
        elif name == "near_duplicates":
            want = {k[0] for k in test_chosen_path.brute(before) if k[0] == k[1]}
            assert Counter(after) == Counter(r for r in before if r[0] in want)
        elif name == "secrets":
            assert [r[0] for r in sorted(after)] == [r[0] for r in sorted(before)]
            old = {r[0]: r[1] for r in before}
            for r in after:
                assert not test_secrets.brute(r[1]) and (r[1] == old[r[0]]) == (not test_secrets.brute(old[r[0]])) and r[4] == len(r[1])
        else:
            _, goals = test_mixing.want_targets(before)
            size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1])) for r in before}
            assert max(Counter(r[0] for r in after).values()) <= 2
            for s, goal in goals.items():
                mine = [size[r[0]] for r in before if r[3] == s]
                taken = sum(size[r[0]] for r in after if r[3] == s)
                assert abs(taken - goal) == min(abs(x - goal) for x in test_mixing.reachable(mine))
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    once = list({r[0]: r for r in before}.values())
    times = Counter(r[0] for r in before)
    seen, first = Counter(), []
    for r in sorted(pieces, key=lambda r: (r.doc_id, r.piece, r.sequence_id, r.offset)):
        if not seen[r.doc_id, r.piece]:
            first.append(r)
        seen[r.doc_id, r.piece] += 1
    assert all(n == times[doc_id] for (doc_id, _), n in seen.items())
    tokens = sum(r.length for r in pieces)
    assert len({r.sequence_id for r in pieces}) <= 1.1 * tokens / 2048 + 2
    spans = {}
    for r in pieces:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in spans.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 2048
    assert {r[0] for r in once} == {r.doc_id for r in first}


def test_run(spark, documents, tmp_path):
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_empty_table(spark, empty):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_one_document_of_each_group_stays(spark, rows):
    """Repeated rows, rows without an id, and columns named like those of the operators."""
    long = [r[1] for r in rows if len((r[1] or "").split()) > 100]
    given = [(5, long[0]), (5, long[0]), (3, long[0]), (3, long[0]), (None, long[0]), (None, long[1]), (None, long[1]), (7, ""), (7, ""), (8, None), (9, long[2])]
    docs = spark.createDataFrame(given, "doc_id long, text string").selectExpr("*", "1 as row", "2 as number", "3 as class_id", "4 as th", "5 as cid")
    got = chosen_path.first_of_each(docs)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(3, long[0]), (None, long[1]), (7, ""), (7, ""), (8, None), (9, long[2])])


def test_null_ids_repeated_rows_and_more_columns(spark, documents):
    docs = documents.union(documents.limit(5)).selectExpr("CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id END AS doc_id", "text", "lang", "source", "n_chars", "1 AS rules", "'a' AS found", "2 AS size", "3 AS piece")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns, docs = docs.columns, stage(spark, docs, "")
        assert docs.columns == columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() > 0
