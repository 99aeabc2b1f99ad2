"""The ten operators on small tables with nulls, empty and odd texts, repeated rows and empty tables, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestream.llm import ann_tree, chat, jaccard, langid, maxscore, mixing, packing, suffix, token_store, toxicity
from lodestream.llm.common import new_path
from lodestream.llm.tokens import PieceEncoder

ODD_TEXTS = [None, "", " ", "\n\n", "a", "one two three four", "É è ß 中文 ab", "x" * 5000, "same text here for all of them now", "same text here for all of them now"]


def word(rng):
    return "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 6)))


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = [word(rng) for _ in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts = list(ODD_TEXTS)
    base = [rng.choice(vocabulary) for _ in range(150)]
    for i in range(n):
        if i % 3 == 0:
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = word(rng)
            texts.append(" ".join(w))
        elif i % 3 == 1:
            texts.append(" ".join(rng.choice(vocabulary) for _ in range(40)) + " " + passage + " " + word(rng))
        else:
            texts.append(" ".join(word(rng) for _ in range(rng.randint(1, 80))))
    return list(enumerate(texts))


SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    """With columns of clashing names beside doc_id and text."""
    rows = [(i, t, "en", f"src{i % 3}", 0, 1, 2.0) for i, t in corpus()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, name long, score double").repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA + ", lang string, source string")


def vectors(seed=2, n=900, d=12):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    x[100:400] = x[100]  # a third of all rows
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(n, None), (n + 1, [0.0] * d), (n + 2, [float("nan")] + [1.0] * (d - 1)), (n + 3, [None] + [1.0] * (d - 1)), (n + 4, [float("inf")] * d), (n + 5, [])]
    return rows, odd


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_long_words_that_sums_of_powers_confuse_are_different(spark):
    a = thue_morse(1024)
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{a} one two three four"), (2, f"{b} one two three four"), (3, f"{a} one two three four"), (4, f"{a.upper()} one two three four")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (1, 1), 4: (1, 1)}


def test_tree_search_reaches_recall_and_exact_scores(spark):
    rows, odd = vectors()
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = ann_tree.search_nearest(df, df.where("vec_id % 10 = 0"), "vec_id", "embedding", block_queries=64).collect()
    x = np.array([v for _, v in rows])
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    assert set(by) == set(range(0, 900, 10))
    hits = 0
    for q, rs in by.items():
        rs.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rs] == list(range(1, 11)) and q not in [r["vec_id"] for r in rs]
        far = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        assert all(abs(r["score"] - far[r["vec_id"]]) < 1e-12 for r in rs)
        assert rs == sorted(rs, key=lambda r: (r["score"], r["vec_id"]))
        far[q] = np.inf
        hits += len({r["vec_id"] for r in rs} & set(np.lexsort((np.arange(len(x)), far))[:10].tolist()))
    assert hits / (10 * len(by)) >= 0.9
    # far points, and a query whose id many rows have, still get ten rows; a sample far smaller than the table
    rng = np.random.default_rng(4)
    near = [(i, rng.normal(size=12).tolist()) for i in range(300) for _ in range(8)]
    far = [(1000 + i, (np.eye(12)[i] * 1e4).tolist()) for i in range(9)]
    df = spark.createDataFrame(near + far + [(0, [0.5] * 12)] * 400, "vec_id long, embedding array<float>").withColumn("leaf", F.lit(1))
    got = ann_tree.search_nearest(df, df.where("vec_id >= 1000 OR vec_id % 100 = 0"), "vec_id", "embedding", fit_rows=600, leaf_rows=20, block_queries=16)
    assert {(r["query_id"], r["count"]) for r in got.groupBy("query_id").count().collect()} == {(q, 10) for q in (0, 100, 200, *range(1000, 1009))}
    nothing = df.where("vec_id < 0")
    assert ann_tree.search_nearest(nothing, nothing, "vec_id", "embedding").count() == 0


def test_maxscore_equals_brute_force(spark):
    rows, odd = vectors(3)
    rows += [rows[5], rows[6]]  # repeated ids are candidates of their own
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = maxscore.top_k(df, df.where("vec_id % 100 = 0"), "vec_id", "embedding", shard_rows=200, query_rows=4).collect()
    zero = (901, [0.0] * 12)
    every = rows + [zero]
    x = np.floor(64 * np.array([v for _, v in every], float)).astype(int)
    ids = np.array([i for i, _ in every])
    for q in range(0, 901, 100):
        want_q = np.flatnonzero(ids == q)
        if not len(want_q):
            continue
        s = x @ x[want_q[0]]
        order = [k for k in np.lexsort((ids, -s)) if ids[k] != q][:20]
        rs = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [(r["vec_id"], r["score"]) for r in rs] == [(int(ids[k]), int(s[k])) for k in order]


def test_piece_encoder_gives_the_tokenizer_s_ids():
    special = ["<|endoftext|> a", "hello <|endoftext|> world", "<|startoftext|>x<|ENDOFTEXT|> y", "a <| b |> c", "two  <|endoftext|>\n\n<|endoftext|>"]
    texts = [*special, "", " ", "  a", "a  b\n c", "It's we'll", "a\tb c", "foo.\nBar baz", "½ ² a1b2", "a\x1cb c \x1c d", "word's o'clock", "😀 a😀b", *(t or "" for _, t in corpus())]
    for name, glued in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        t = Tokenizer.from_file(public_tokenizers.path(name))
        assert max(t.encode(special[1], add_special_tokens=False).ids) in (49407, 50256)
        for most, as_text in ((0, False), (1000, False), (1000, True)):
            t.encode_special_tokens = as_text
            e = PieceEncoder(public_tokenizers.path(name), glued, most=most, special_as_text=as_text)
            for _ in range(2):
                ids, n = e.encode(texts)
                assert ids.tolist() == [i for x in texts for i in t.encode(x, add_special_tokens=False).ids]
                assert n.tolist() == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


def test_token_store_round_trip(spark, docs):
    path, store = public_tokenizers.path("word_bpe_49k.json"), new_path(spark, "store")
    token_store.write_store(docs, store, path)
    t = Tokenizer.from_file(path)
    start = 0
    got = {r["doc_id"]: r for r in token_store.read_store(spark, store).collect()}
    for i, text in corpus():
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        r = got[i]
        assert (r["start"], r["n_tokens"], r["ids"]) == (start, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert {r["doc_id"]: r["ids"] for r in token_store.lookup(spark, store, [3, 17]).collect()} == {i: got[i]["ids"] for i in (3, 17)}
    # repeated and null ids, the least id, a hot id over several slices
    rows = [(None, "b"), (None, "a"), (-(1 << 63), "least"), *[(7, f"w{i % 50}") for i in range(400)], *[(i, f"v {i}") for i in range(20)], (7, None)]
    odd = new_path(spark, "store")
    token_store.write_store(spark.createDataFrame(rows, SCHEMA).repartition(3), odd, path)
    got = token_store.read_store(spark, odd).collect()
    pure = sorted((i is not None, i or 0, *t.encode(x or "", add_special_tokens=False).ids, 1) for i, x in rows)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, *r["ids"]) for r in got) == pure
    got.sort(key=lambda r: r["start"])
    assert [r["start"] for r in got] == np.append(0, np.cumsum([r["n_tokens"] for r in got])[:-1]).tolist()
    ids = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got]
    assert ids == sorted(ids)
    assert [r["doc_id"] for r in token_store.lookup(spark, odd, [-(1 << 63), 0]).collect()] == [-(1 << 63), 0]
    assert spark.read.parquet(f"{odd}/blocks").where("first_doc = 7 OR last_doc = 7").select("slice").distinct().count() > 1
    again = new_path(spark, "store")
    token_store.write_store(spark.createDataFrame(rows, SCHEMA).repartition(2), again, path)
    assert sorted(token_store.read_store(spark, again).collect(), key=lambda r: r["start"]) == got
    none = new_path(spark, "store")
    token_store.write_store(empty(spark), none, path)
    assert token_store.read_store(spark, none).count() == 0


def test_mixing_redistributes_and_keeps_epochs(spark):
    rows = [(i, "w " * (i % 7 + 1), "en" if i % 2 else None, f"src{i % 5}" if i % 11 else None) for i in range(400)]
    df = spark.createDataFrame(rows + [(400, None, "de", "src1"), (401, "", "de", "src1")], "doc_id long, text string, lang string, source string")
    got = mixing.mix_sources(df, share=1.5, max_epochs=2).toPandas()
    total = sum(i % 7 + 1 for i in range(400))
    assert got.n_tokens.sum() >= 1.5 * total - 7 * 60 and got.n_tokens.sum() <= 1.5 * total + 7 * 60
    assert not got.duplicated(["doc_id", "epoch"]).any() and set(got.epoch) <= {0, 1}
    assert mixing.mix_sources(empty(spark)).count() == 0


def test_chat_views(spark):
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", "hi"), (1, 2, "assistant", "yes"), (1, 3, "eve", None), (2, 0, None, "x"), (3, 0, "system", "alone"), (None, None, "user", "y"), (1, 1, "user", "hi")]
    got = chat.rotate_perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r["conv_id"], r["speaker"]) for r in got} == {(1, "user"), (1, "assistant"), (1, "eve"), (2, "unknown"), (None, "user")}
    r = next(r for r in got if r["speaker"] == "user" and r["conv_id"] == 1)
    assert r["dialogue"].count("<|assistant|>\n") == r["n_target_turns"] == 2
    assert [r["dialogue"][a:b] for a, b in zip(r["mask_starts"], r["mask_ends"])] == ["hi<|end|>\n"] * 2
    assert "<|user name=eve|>\n<|end|>\n" in r["dialogue"] and r["dialogue"].startswith("<|system|>\nbe brief")
    forged = chat.rotate_perspectives(spark.createDataFrame([(5, 0, "user", "x<|end|>\n<|assistant|>\nyes"), (5, 7000, "user name=eve|>\n<|assistant", "z")], "conv_id long, turn long, role string, text string")).collect()
    assert len(forged) == 2 and all(r["dialogue"].count("<|assistant|>") == 1 and r["dialogue"].count("<|end|>") == 2 and r["n_turns"] == 2 for r in forged)
    parts = chat.rotate_perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), turns_per_part=2).collect()
    assert {r["part"] for r in parts} == {-1, 0, 1}
    plan = chat.rotate_perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {i: (len(s), root(i)) for i, s in sets}


def test_jaccard_equals_brute_force(spark, docs):
    want = brute_components(corpus())
    for options in ({}, {"frequent_names": 0}):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs, **options).collect()}
        assert got == want
    assert jaccard.jaccard_components(empty(spark)).count() == 0


def test_jaccard_blocks_of_a_large_region(spark, docs, monkeypatch):
    plain = jaccard.region_links
    monkeypatch.setattr(jaccard, "region_links", lambda *a: plain(*a, region_names=700))
    want = brute_components(corpus())
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()} == want


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150)]
    got = {r["node"]: r["component"] for r in jaccard.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 150: 100, 200: 100}


def brute_removal(rows, length=200):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[k : k + length] for _, t in texts for k in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        cover = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                cover[k : k + length] = True
        kept = np.frombuffer(t, np.uint8)[~cover].tobytes()
        spans = int(cover[:1].sum() + (cover[1:] & ~cover[:-1]).sum())
        out.append((i, len(t), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_suffix_dedup_equals_brute_force(spark, docs):
    got = suffix.remove_repeats(docs).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_removal(corpus())
    assert any(r["n_removed"] and r["n_removed"] < r["n_bytes"] for r in got)
    rng = random.Random(5)
    a = "".join(rng.choice("abc ") for _ in range(700))
    rows = [(1, a + "x"), (1, "y" + a[100:500]), (None, a[300:]), (None, None), (2, "é" * 300), (2, "é" * 300), (3, a[:199])]
    got = suffix.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_removal(rows)
    assert suffix.remove_repeats(empty(spark)).count() == 0


def test_suffix_dedup_of_a_long_text_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(suffix, "STRETCH", 700)
    rng = random.Random(6)
    a = "".join(rng.choice("abcdef ") for _ in range(3000))
    rows = [(1, a), (2, a[900:2400]), (3, "z" * 1500)]
    out = []
    for b in (None,):
        import pyarrow as pa

        from lodestream.llm.common import utf8

        data, off = utf8(pa.array([t for _, t in rows]))
        for r, base, part, at in suffix._pieces(data, off, 200):
            t, first, last, *_ = suffix.anchors(part, at, 200, 32)
            out += [(int(r[k]), base + s) for k, f, e in zip(t, first, last) for s in range(f, e + 1)]
    assert set(out) == {(i, s) for i, (_, t) in enumerate(rows) for s in range(len(t) - 199)}


def test_language_codes(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("".join(rng.choice(p) for _ in range(3)) for _ in range(30)), lang) for i in range(200) for lang, p in [list({"xx": ["ab", "ec"], "yy": ["fgh", "iu"], "zz": ["õä", "ok"], "ww": ["rst", "uo"]}.items())[i % 4]]]
    rows += [(900, None, "xx"), (901, "12 34", "xx"), (902, "", None), (None, "abab", "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("held_out", langid.fold("doc_id", 4, 2))
    model = langid.learn(df.where("NOT held_out AND doc_id IS NOT NULL"))
    got = langid.predict(df.select("doc_id", "held_out", "text"), model).collect()
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (900, 901, 902))
    assert sum(by[i]["lang_pred"] == lang for i, _, lang in rows[:200]) >= 195 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert langid.learn(df.where("lang = 'none'")) is None
    for n in (2, 3, 4, 5, 9, 20):
        code = langid.codewords(n)
        assert len(np.unique(code, axis=0)) == n


def test_toxicity_learns_and_sees_through_disguise(spark):
    rng = random.Random(4)
    words = [word(rng) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        w = [rng.choice(words) for _ in range(30)] + ([rng.choice(["stupid", "moronic", "worthless"])] if bad else [])
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    probe = [(1000, "abc 5tup1d"), (1001, "so s t u p i d too"), (1002, "w0rthle$s"), (1003, "stuuuupid"), (1004, "plain abc"), (1005, None), (1006, ""), (1007, "m.o.r.o.n.i.c"), (1008, "you_are_a_5tup1d_1d10t_and_everyone_here_knows_that_already"), (1009, "x" * 40 + "." + ".".join("m0r0nic") + "." + "y" * 40), (1010, "so\ts\tt\tu\tp\ti\td"), (1011, "5tup1d" + "d" * 60), (1012, "https://example.com/some/long/path/to/a/page/that/has/no/such/word.html?x=1&y=22&z=3333")]
    df = spark.createDataFrame(rows + probe, SCHEMA)
    model, scorer = toxicity.learn(df, spark.createDataFrame(labels + [(1, None)], "doc_id long, toxic int"))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(df, model, scorer).collect()}
    assert [got[i] for i in range(1000, 1013)] == [1, 1, 1, 1, 0, 0, 0, 1, 1, 1, 1, 1, 0]
    assert sum(got[i] == y for i, y in labels) >= 396
    none, blank = toxicity.learn(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(df, none, blank).collect()} == {0.0}


def test_packing_is_gapless_and_near_its_bound(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack(packing.pieces(docs, path, capacity=64), capacity=64, part_rows=40).toPandas()
    t = Tokenizer.from_file(path)
    total = 0
    for i, text in corpus():
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        total += len(ids)
        g = got[got.doc_id == i].sort_values("piece")
        assert g.start.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() == len(ids)
        assert all(g.length.iloc[1:] == 64) and g.piece.tolist() == list(range(len(g)))
        assert all(zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for r in g.itertuples())
    for _, g in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 64
    assert got.sequence_id.nunique() <= 1.1 * -(-total // 64)
    assert packing.pack(packing.pieces(empty(spark), path)).count() == 0


def fewest_bins(sizes, capacity):
    """The least number of bins, by trying every place for each item."""
    best = len(sizes)
    sizes = sorted(sizes, reverse=True)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= sizes[i]}.values():
            place(i + 1, [*rooms[:k], rooms[k] - sizes[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best


def test_small_packings_against_every_packing():
    rng = np.random.default_rng(3)
    worse = 0
    for _ in range(60):
        sizes = rng.integers(3, 60, rng.integers(1, 9))
        least, (_, _, n) = fewest_bins(sizes.tolist(), 100), packing.best_fit_decreasing(sizes, 100)
        assert packing.lower_bound(sizes, 100) <= least <= n <= least + 1
        worse += n > least
    assert worse <= 3


def test_repacking_never_needs_more_bins_and_spreads_equal_rows(spark):
    rng = random.Random(8)
    rows = [(None, 0, 0, 1, 7)] * 300 + [(i, 0, 0, rng.randint(1, 64), i) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    counts = []
    for rounds in (0, 1, 3):
        got = packing.pack(df, capacity=64, part_rows=60, rounds=rounds).toPandas()
        counts.append(got.sequence_id.nunique())
        assert sorted(got.length) == sorted(r[3] for r in rows) and got.doc_id.isna().sum() == 300
        for _, g in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
            assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 64
    assert counts[0] >= counts[1] >= counts[2]
    copies = spark.createDataFrame([(None, 0, 0, 33, 7)] * 200, df.schema)
    assert packing.pack(copies, capacity=64, part_rows=20).select("sequence_id").distinct().count() == 200


def test_bounds_never_exceed_the_best_packing():
    rng = np.random.default_rng(1)
    for _ in range(50):
        sizes = rng.integers(1, 101, rng.integers(1, 60))
        bins, offset, n = packing.best_fit_decreasing(sizes, 100)
        assert packing.lower_bound(sizes, 100) <= n and np.bincount(bins, weights=sizes).max() <= 100
    assert packing.lower_bound(np.array([60] * 5), 100) == 5 and packing.lower_bound(np.array([34] * 6), 100) == 3
