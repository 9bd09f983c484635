"""The pipeline against its stages done by brute force."""

from collections import Counter

import corpus_pipeline
import __spark_entry__ as entry
from watchloom.llm import language_id

from .test_dedup import exact_brute, near_brute
from .test_language_and_mixing import poisson


def test_stages_equal_brute_force(spark, docs):
    d = "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "mix", "pack"]
    stage = dict(corpus_pipeline.STAGES)
    first = stage["language"](spark, docs, d)
    said = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert {r.doc_id for r in first.collect()} == {i for i, r in said.items() if r.lang_pred != "und" and r.score >= 0.5}
    second = stage["exact"](spark, first, d)
    assert {r.doc_id for r in second.collect()} == {x[0] for x in exact_brute(first.collect()) if x[3]}
    third = stage["near"](spark, second, d)
    rows = second.collect()
    assert {r.doc_id for r in third.collect()} == {x[0] for x in near_brute(rows) if x[0] == x[2]}
    fourth = stage["mix"](spark, third, d)
    assert fourth.columns == third.columns == second.columns == first.columns == docs.columns
    import hashlib
    import math

    rows = third.collect()
    n = Counter(r.source for r in rows)
    norm = sum(map(math.sqrt, n.values()))
    want = Counter({r.doc_id: poisson(math.sqrt(n[r.source]) / norm * len(rows) / n[r.source], int(hashlib.md5(f"17:{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52) for r in rows})
    assert Counter(r.doc_id for r in fourth.collect()) == +want
    packed = stage["pack"](spark, fourth, d).collect()
    whole = entry.queries()["pipeline"](spark, d)
    strip = lambda rows: Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows)
    assert strip(whole.collect()) == strip(packed)


def test_stages_take_odd_rows(spark, odd_docs, no_docs):
    stage = dict(corpus_pipeline.STAGES)
    ids = lambda name: Counter(r.doc_id for r in stage[name](spark, odd_docs, "").collect())
    # of equal texts the largest id with all its rows; a null text is an empty one
    assert ids("exact") == Counter([2, 3, 3, 5, 6, 7, 8])
    # of linked fingerprints the smallest id; texts without words are linked
    assert ids("near") == Counter([1, 3, 3, 4, 7, 8])
    # texts without a letter go, and of the others only those that half of a language's mixture is said of
    said = {(r.doc_id, r.lang_pred): r.score for r in language_id.identify(odd_docs).collect()}
    assert set(ids("language")) == {i for (i, lang), score in said.items() if lang != "und" and score >= 0.5} and not {1, 2, 6, 8} & set(ids("language"))
    pieces = stage["pack"](spark, odd_docs, "").collect()
    rows = Counter(r.doc_id for r in odd_docs.collect())
    for i, n in rows.items():
        own = [r for r in pieces if r.doc_id == i]
        assert sum(r.length for r in own if r.doc_id == i) == sum({r.doc_tokens for r in own}) * n
    mixed = stage["mix"](spark, odd_docs, "")
    assert mixed.columns == odd_docs.columns and mixed.exceptAll(odd_docs).select("doc_id").distinct().count() <= len(rows)
    assert {r.doc_id for r in mixed.collect()} <= set(rows)
    for name in stage:
        assert stage[name](spark, no_docs, "").count() == 0, name


def test_every_operator_has_a_query():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
