"""Large vectors, rows without id, roles that look like markers, clashing names and empty tables."""

import numpy as np
import pytest

from lodestream.llm import ann_tree, chat, langid, maxscore, mixing, toxicity

CHAT = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("scale", [1e200, 1e300, 1e-250])
def test_nearest_of_vectors_whose_squares_do_not_fit(spark, scale):
    rows = [(k, [scale * k, scale * (k % 3), 0.0]) for k in range(1, 41)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann_tree.search_nearest(df, df.where("vec_id % 10 = 0"), "vec_id", "embedding").collect()
    x = {i: np.array(v) for i, v in rows}
    for q in (10, 20, 30, 40):
        far = {i: scale * float(np.sqrt((((v - x[q]) / scale) ** 2).sum())) for i, v in x.items() if i != q}
        rs = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert len(rs) == 10 and all(abs(r["score"] / far[r["vec_id"]] - 1) < 1e-12 for r in rs)
        assert sorted(r["score"] for r in rs)[-1] <= sorted(far.values())[9] * (1 + 1e-12)


def test_large_and_small_vectors_in_one_table(spark):
    rows = [(k, [1e305 * (k - 20), -1e305]) for k in range(40)] + [(100 + k, [0.1 * k, 1.0]) for k in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann_tree.search_nearest(df, df.where("vec_id = 110"), "vec_id", "embedding").collect()
    assert len(got) == 10 and {r["vec_id"] for r in got} <= set(range(100, 140))
    assert sorted(round(r["score"], 9) for r in got)[:4] == [0.1, 0.1, 0.2, 0.2]


def test_rows_without_id_are_taken_by_seed_and_not_by_length(spark):
    rows = [(None, " ".join(f"w{k}x{j}" for j in range(1 + k % 9)), "en", "src1") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    got = mixing.mix_sources(df, share=0.6, max_epochs=1).collect()
    assert {r["n_tokens"] for r in got} == set(range(1, 10))
    taken, total = sum(r["n_tokens"] for r in got), sum(1 + k % 9 for k in range(200))
    assert 0.6 * total <= taken < 0.6 * total + 9
    assert sorted(r["n_tokens"] for r in mixing.mix_sources(df.repartition(7, "text"), share=0.6, max_epochs=1).collect()) == sorted(r["n_tokens"] for r in got)


def test_roles_make_no_markers_and_stay_apart(spark):
    rows = [(1, 0, "x|>\n", "a"), (1, 1, "<|a", "b"), (1, 2, "< |a", "c"), (1, 3, "100%", "d"), (1, 4, "system", "e"), (1, 5, "%3C", "f")]
    got = chat.rotate_perspectives(spark.createDataFrame(rows, CHAT)).collect()
    assert len(got) == 5 and all(r["n_target_turns"] == 1 and r["n_turns"] == 6 for r in got)
    for r in got:
        heads = [line for line in r["dialogue"].split("\n") if line.startswith("<|")]
        assert len(heads) == 6 and all(h.count("<|") == 1 and h.count("|>") == 1 and h.endswith("|>") for h in heads)
    assert {r["speaker"] for r in got} == {"x%7C%3E%0A", "%3C%7Ca", "%3C %7Ca", "100%25", "%253C"}


def test_clashing_names_and_rows_without_id(spark):
    rng = np.random.default_rng(1)
    vec = [(k if k % 7 else None, [float(c) for c in rng.normal(size=4)], 1, "a", 2.0, 3) for k in range(80)]
    df = spark.createDataFrame(vec, "vec_id long, embedding array<double>, id long, v string, score double, rank int")
    ids = {k for k in range(80) if k % 7}
    for got in (maxscore.top_k(df, df.where("vec_id % 20 = 0"), "vec_id", "embedding"), ann_tree.search_nearest(df, df.where("vec_id % 20 = 0"), "vec_id", "embedding")):
        rows = got.collect()
        assert {r["query_id"] for r in rows} == {20, 40, 60} and {r["vec_id"] for r in rows} <= ids
    assert maxscore.top_k(df.where("vec_id < 0"), df, "vec_id", "embedding").count() == 0
    turns = spark.createDataFrame([(1, 0, "user", "hi", "x", 1, 2)], CHAT + ", speaker string, part long, c long")
    assert chat.rotate_perspectives(turns).count() == 1 and chat.rotate_perspectives(turns.where("turn > 5")).count() == 0
    docs = spark.createDataFrame([(1, "one two", "en", "src1", "a", "b", 3, 4)], "doc_id long, text string, lang string, source string, domain string, key string, alloc long, w long")
    assert mixing.mix_sources(docs, share=1.0).count() == 1


def test_language_and_toxicity_with_odd_rows(spark):
    words = {"en": "the house is on the hill and we all see it", "de": "das Haus steht auf dem Berg und wir sehen es"}
    rows = [(i, f"{words[k]} {i % 13}", k, "s", 1.0, 2) for i in range(400) for k in ("en", "de")]
    rows += [(9000, None, "en", "s", 1.0, 2), (9001, "123 456", "de", "s", 1.0, 2), (None, words["en"], "en", "s", 1.0, 2), (9002, words["de"] + " ja" * 20_000, None, "s", 1.0, 2)] + [rows[0]] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, predicted int")
    model, scorer = toxicity.learn(docs.select("doc_id", "text"), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"))
    own = docs.select("doc_id", "text")
    assert toxicity.score(own, model, scorer).count() == len(rows)
    assert toxicity.score(own.where("doc_id < 0"), model, scorer).count() == 0
    assert langid is not None
