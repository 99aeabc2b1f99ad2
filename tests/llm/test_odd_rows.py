"""The stages of the pipeline on repeated rows, repeated ids and rows without id."""

import random
from collections import Counter

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(60))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in rows], COLUMNS).repartition(3)


def seen(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_one_row_of_each_class_stays_and_none_vanishes(spark):
    a, b, c, d, e = (prose(k) for k in range(5))
    # a: a repeated row; b: rows without id only; c: without id and with one; 5: two texts under one id, d also under 7
    rows = [(1, a), (1, a), (None, b), (None, b), (None, c), (2, c), (5, d), (5, e), (7, d + " more"), (9, None), (9, None), (None, ""), (None, "")]
    docs = table(spark, rows)
    near = corpus_pipeline.one_of_near_duplicates(spark, docs, "")
    want = Counter({(1, a): 1, (None, b): 1, (2, c): 1, (5, d): 1, (5, e): 1, (9, None): 1, (None, ""): 2})
    assert near.columns == docs.columns and seen(near) == want
    cut = corpus_pipeline.cut_repeats(spark, near, "")
    assert Counter((i, t or "") for i, t in seen(cut).elements()) == Counter((i, t or "") for i, t in want.elements())


def test_mixing_counts_and_returns_rows_without_id(spark):
    rows = [(i % 3 if i % 2 else None, prose(100 + i // 4)) for i in range(40)]
    docs = table(spark, rows)
    mixed = corpus_pipeline.mix(spark, docs, "")
    got = seen(mixed)
    assert not got - Counter(rows)
    # all texts have 60 words and one source, so four fifths of the rows are four fifths of the tokens
    assert sum(got.values()) == 32 and any(i is None for i, _ in got)
    # the choice is the same however the rows lie
    assert seen(corpus_pipeline.mix(spark, docs.repartition(5, "text"), "")) == got


def test_ids_that_are_not_repeated_are_the_keys(spark):
    docs = table(spark, [(3, "x"), (8, "y")])
    assert {(r["row"]["doc_id"], r["row_key"]) for r in corpus_pipeline.keyed(docs).collect()} == {(3, 3), (8, 8)}
