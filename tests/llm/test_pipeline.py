"""The corpus pipeline against brute-force versions of its stages."""

import hashlib
import random
import re

import corpus_pipeline
import public_tokenizers
from lodestream.llm import mixing
from test_operators import brute_components, brute_removal, corpus
from tokenizers import Tokenizer


def test_stages_against_brute_force(spark, tmp_path):
    rows = [(i, t, "en", f"src{i % 4}", len(t or "")) for i, t in corpus(9, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    rng = random.Random(1)
    bad = {i for i, t, *_ in rows if t and len(t) > 50 and rng.random() < 0.3}
    rows = [(i, f"{t} stupid" if i in bad else t, *rest) for i, t, *rest in rows]
    docs = spark.createDataFrame(rows, docs.schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in bad)) for i, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} == {r[0] for r in rows} - bad
    near = corpus_pipeline.one_of_near_duplicates(spark, left, str(tmp_path))
    kept = [(i, t) for i, t, *_ in rows if i not in bad]
    want = {i for i, (_, c) in brute_components(kept).items() if c == i}
    assert {r["doc_id"] for r in near.collect()} == want and near.columns == docs.columns
    kept = [(i, t) for i, t in kept if i in want]
    cut = corpus_pipeline.cut_repeats(spark, near, str(tmp_path))
    gone = {r[0]: r for r in brute_removal(kept)}
    assert cut.columns == docs.columns
    assert {r["doc_id"]: len((r["text"] or "").encode()) for r in cut.collect()} == {i: r[1] - r[2] for i, r in gone.items() if not r[2] or r[2] < r[1]}
    left = [r for r in cut.collect()]
    mixed = corpus_pipeline.mix(spark, cut, "")
    assert mixed.columns == docs.columns and sorted(r["doc_id"] for r in mixed.collect()) == brute_mix(left)
    packed = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = {r["doc_id"]: len(tokens.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in left if r["doc_id"] in set(brute_mix(left))}
    assert packed.groupby("doc_id").length.sum().to_dict() == sizes
    for _, g in packed.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 1024
    assert packed.sequence_id.nunique() <= -(-sum(sizes.values()) // 1024) + 1


def brute_fill(budget, children):
    """{child: budget} of (name, cap, weight): shares by weight, what a full child leaves goes to its siblings."""
    out, open_ = {}, sorted(children)
    while open_:
        level = budget / sum(w for _, _, w in open_)
        full = [c for c in open_ if c[1] <= level * c[2]]
        if not full:
            return out | {n: level * w for n, _, w in open_}
        for n, cap, _ in full:
            out[n], budget = cap, budget - cap
        open_ = [c for c in open_ if c not in full]
    return out


def brute_mix(rows, share=0.8):
    """Ids that are taken: budgets down the tree of domain, language and source, then a prefix of the seeded order."""
    w = mixing.WEIGHTS
    leaf = {}
    for r in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        key = f"domain{int(r['source'][3:]) % 4}", r["lang"], r["source"]
        leaf.setdefault(key, []).append((hashlib.md5(f"7:0:{r['doc_id']}".encode()).hexdigest(), r["doc_id"], n))
    caps = {k: sum(n for *_, n in v) for k, v in leaf.items()}
    total = sum(caps.values())
    cap = lambda *head: sum(c for k, c in caps.items() if k[: len(head)] == head)
    out = []
    for d, a in brute_fill(share * total, [(d, cap(d), w["domain"].get(d, 1)) for d in {k[0] for k in caps}]).items():
        for lang, b in brute_fill(a, [(x, cap(d, x), w["lang_key"].get(x, 1)) for x in {k[1] for k in caps if k[0] == d}]).items():
            for source, c in brute_fill(b, [(x, cap(d, lang, x), 1) for x in {k[2] for k in caps if k[:2] == (d, lang)}]).items():
                at = 0
                if c >= caps[d, lang, source] - 1e-3:
                    c = float("inf")
                for _, i, n in sorted(leaf[d, lang, source]):
                    if at < round(c, 3):
                        out.append(i)
                    at += n
    return sorted(out)


CLASHING = ("score", "predicted", "n_removed", "n_bytes", "n_spans", "row_key", "again", "copy", "copies", "row", "id", "class", "doc", "domain", "other0", "a.b")


def test_clashing_names_nulls_and_long_texts_pass_through_all_stages(spark, tmp_path):
    rng = random.Random(6)
    texts = [t for _, t in corpus(5, 30)] + [None, "", " ".join(f"w{rng.randrange(10**6)}" for _ in range(40_000))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    rows = [(i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"src{i % 4}", len(t or ""), *[f"{c}{i}" if i % 3 else None for c in CLASHING]) for i, t in enumerate(texts)]
    rows += [(None, *rows[12][1:]), (None, *rows[12][1:]), rows[13]]
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    extra = {(r[0], *r[5:]) for r in rows}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        got = out.collect()
        assert got and {(r[0], *r[5:]) for r in got} <= extra, name
        now = spark.createDataFrame(got, docs.schema)
    assert corpus_pipeline.pack(spark, now, "").select("doc_id").distinct().count() > 5
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 5


def test_empty_table_stays_empty_in_all_stages(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, score string")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
