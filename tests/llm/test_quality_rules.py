import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tests import oracle
from weft.llm import quality_rules, registry

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)} if len(windows) < 3000 else None
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, None if hit is None else len(hit)


def test_counts_are_those_of_the_definitions(documents, rows):
    got = {r.doc_id: r for r in quality_rules.score(documents, registry.FERTILITY).collect()}
    assert len(got) == len(rows)
    for doc_id, text, *_ in rows:
        r, want = got[doc_id], brute(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == want[:4], doc_id
        if want[4] is not None:
            assert r.n_repeat_words == want[4], doc_id
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_measures_are_those_of_whole_texts(documents, rows):
    import math
    from collections import Counter

    from weft.llm import wordpieces

    model = wordpieces.load(*registry.FERTILITY.pieces).model
    got = {r.doc_id: r for r in quality_rules.score(documents, registry.FERTILITY).collect()}
    for doc_id, text, *_ in rows[:40]:
        ids = model.encode(" ".join(WORD.findall(text)))
        assert math.isclose(got[doc_id].chars_per_token, sum(map(len, WORD.findall(text))) / len(ids))
        assert math.isclose(got[doc_id].byte_share, sum(map(model.is_byte, ids)) / len(ids))
    encode = wordpieces.load(*registry.FERTILITY.bytes).encode
    for doc_id, text, *_ in rows[:40]:
        ids = [i for w in encode(WORD.findall(text)) for i in w]
        n, c = len(ids), Counter(ids)
        want = -sum(k / n * math.log(k / n) for k in c.values()) / math.log(min(n, 256)) if n > 1 else 0
        assert math.isclose(got[doc_id].evenness, want, abs_tol=1e-9)


def test_empty_table_and_more_columns(documents, empty):
    assert quality_rules.score(empty, registry.FERTILITY).count() == 0
    more = documents.withColumn("n_words", F.lit("x")).withColumn("kept", F.lit(None).cast("string"))
    assert quality_rules.score(more, registry.FERTILITY).count() == documents.count()


MEASURES = ("chars_per_token", "chars_per_byte_token", "byte_share", "evenness")


def test_the_verdict_is_that_of_the_bands(documents, rows):
    rules = registry.FERTILITY
    for r in quality_rules.score(documents, rules).collect():
        lang = rows[r.doc_id][2]
        band = rules.by_language.get(lang) or rules.by_script[r.script]
        inside = [band.chars_per_token[0] <= r.chars_per_token <= band.chars_per_token[1], band.chars_per_byte_token[0] <= r.chars_per_byte_token <= band.chars_per_byte_token[1], r.byte_share <= band.byte_share, r.evenness >= band.evenness]
        assert r.kept == (not r.base_failed and all(inside))


def test_each_measure_rejects_alone(spark):
    """Texts that pass the base rules and all bands but one."""
    plain = "the quick brown fox jumps over a lazy dog while seven old wizards quietly mix strange potions before any morning bells ring out loudly"
    texts = {
        "none": plain, "chars_per_byte_token": plain.replace("the", "t.h.e").replace(" ", " q;x;z;"), "byte_share": plain + " \U00013000\U00013001\U00013002 \U00013003",
        "evenness": " ".join(["data"] * 3 + [f"w{k}" for k in range(3)] + ["data"]) * 9,
    }
    band = registry.FERTILITY.by_language["en"]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts.values())], "doc_id long, text string, lang string")
    wide = quality_rules.FertilityRules(registry.FERTILITY.pieces, registry.FERTILITY.bytes, {"en": quality_rules.Band((0, 99), (0, 99), 1.0, 0.0)}, {}, 0, 100)
    found = {name: r for name, r in zip(texts, sorted(quality_rules.score(docs, wide).collect()), strict=True)}
    assert all(r.kept for r in found.values()) and band.holds(found["none"].asDict())
    assert found["byte_share"].byte_share > 0.02 >= found["none"].byte_share
    assert found["chars_per_byte_token"].chars_per_byte_token < band.chars_per_byte_token[0]
    for name in MEASURES[1:]:
        fine = {m: found["none"][m] for m in MEASURES}
        assert band.holds(fine) and (name == "evenness" or not band.holds(fine | {name: found[name][name]}))
    assert not band.holds({m: found["none"][m] for m in MEASURES} | {"evenness": 0.1})


COUNTS = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
at AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM at QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(w) < 20 OR 100 * coalesce(n, 0) > 30 * len(w) AS base_failed
FROM d JOIN l USING (doc_id) LEFT JOIN hit USING (doc_id)
""".replace("at AS", "places AS").replace("FROM at ", "FROM places ")


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not here")
def test_counts_are_those_of_sql(spark):
    got = registry.op3_quality_rules(spark, "/root/testdata/sf0.001").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    oracle.same(got, oracle.connect("/root/testdata/sf0.001"), COUNTS)


def test_a_text_is_not_rejected_for_its_length(spark, rows):
    """The same words, more and more of them in ever other orders: evenness doesn't fall."""
    words = WORD.findall(max((r[1] or "" for r in rows), key=len))[:1500]
    rng = random.Random(3)
    texts = [" ".join(w for _ in range(k) for w in rng.sample(words, len(words))) for k in (1, 3, 30)]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = sorted(quality_rules.score(docs, registry.FERTILITY).collect())
    assert got[0].evenness <= got[1].evenness + 1e-9 <= got[2].evenness + 2e-9


def test_repeated_rows_and_null_ids(spark, rows):
    twice = spark.createDataFrame([(None, rows[0][1], "en"), (1, rows[0][1], "en"), (1, rows[0][1], "en"), (None, None, None)], "doc_id long, text string, lang string")
    got = quality_rules.score(twice, registry.FERTILITY).collect()
    assert len(got) == 4 and len({r.n_words for r in got}) == 2 and len({r.kept for r in got if r.n_words}) == 1
