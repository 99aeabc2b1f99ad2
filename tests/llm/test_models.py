"""The learned models of op5 and op9 against plain Python models of the same counts and weights."""

import itertools
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from lodestream.llm import langid, toxicity
from lodestream.llm.common import utf8
from lodestream.llm.toxicity import LETTERS, Channel, CharModel, letter

WORDS = {
    "en": "the house on a hill that we all see and then some of it was there with them",
    "de": "das haus auf dem berg und wir sehen es alle schön über die straße nicht",
    "fr": "la maison sur la colline que nous voyons tous été où l'on va être déjà",
}


def code(byte):
    return byte - 96 if 97 <= byte <= 122 else byte - 64 if 65 <= byte <= 90 else 27 + (byte - 128) % 37 if byte >= 128 else 0


def plain_trigrams(text):
    """A feature at each byte; the last two, which begin none, count as three blanks."""
    c = [code(b) for b in text.encode()]
    return [(c[i] << 12) | (c[i + 1] << 6) | c[i + 2] for i in range(len(c) - 2)] + [0] * min(2, len(c))


def sample(k):
    words = WORDS[k].split()
    return [" ".join(words[(i * 7 + j * 3) % len(words)] for j in range(6 + i % 5)) for i in range(60)]


def test_language_model_against_plain_counts(spark):
    rows = [(i, t, k) for k in WORDS for i, t in enumerate(sample(k))] + [(900, None, "en"), (901, "", "de"), (902, "house haus", None)] + [(0, sample("en")[0], "en")] * 2
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4))
    langs = sorted(WORDS)
    counts = {k: Counter(f for i, t, kk in rows if kk == k and t for f in plain_trigrams(t)) for k in langs}
    kinds = set().union(*counts.values())
    share = {k: {f: (counts[k][f] + 0.5) / sum(counts[k][g] + 0.5 for g in kinds) for f in kinds} for k in langs}
    floor = 0.5 / len(kinds) * 1e-3
    assert model.langs == langs and all(any(a != b for a, b in zip(x, y)) for x, y in itertools.combinations(model.code.tolist(), 2))
    texts = [t for k in langs for t in sample(k)[:4]] + ["", "haus house maison", "12 34"]
    data, off = utf8(pa.array(texts))
    got = model.margins(data, off)
    for t, row in zip(texts, got, strict=True):
        fs = [f for f in plain_trigrams(t) if f > 0]
        for b in range(model.code.shape[1]):
            pos, neg = ([k for k, s in zip(langs, model.code[:, b]) if s == side] for side in (1, -1))
            weight = lambda f: math.log(sum(share[k].get(f, 0) for k in pos) / len(pos) + floor) - math.log(sum(share[k].get(f, 0) for k in neg) / len(neg) + floor)  # noqa: E731, B023
            want = sum(map(weight, fs)) / len(fs) if fs else 0.0
            assert abs(row[b] - want) < 1e-4
    # the nearest codeword by weighted losses
    best, p, close = model.decode(got)
    for i, row in enumerate(got):
        z = [max(-30.0, min(30.0, m * a + s)) for m, a, s in zip(row, model.slope, model.shift)]
        loss = [sum(w * math.log1p(math.exp(-x * c)) for w, x, c in zip(model.trust, z, word)) for word in model.code]
        top = sum(math.exp(-(x - min(loss))) for x in loss)
        assert best[i] == loss.index(min(loss)) and abs(p[i] - 1 / top) < 1e-9 and close[i] == (1 / top < 0.75)
    held_out = [(i, False, t) for i, t in enumerate(t for k in langs for t in (f"{sample(k)[3]} {sample(k)[8]}", sample(k)[5]))] + [(50, True, None), (51, True, "12 !")]
    said = {r["doc_id"]: r["lang_pred"] for r in langid.predict(spark.createDataFrame(held_out, "doc_id long, held_out boolean, text string"), model).collect()}
    assert [said[i] for i in range(6)] == ["de", "de", "en", "en", "fr", "fr"] and said[50] == said[51] == "und"


def grams(texts):
    """4-grams of letters: 0 for what parts words, 1 to 26, 27 for other letters."""
    out = Counter()
    for t in texts:
        for w in re.findall(r"[a-zA-Zà-öø-ÿÀ-ÖØ-Þ]+", t or ""):
            c = [0, 0, 0, *[ord(x.lower()) - 96 if x.lower() in "abcdefghijklmnopqrstuvwxyz" else 27 for x in w], 0]
            out.update(tuple(c[i : i + 4]) for i in range(len(c) - 3))
    return out


def test_character_model_against_plain_counts(spark):
    texts = ["Hello there", "naïve été", None, "", "a-b c1d", "hello  hello", "x" * 3000]
    model = toxicity.char_model(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3))
    # what parts words is one mark in the model's stream, so grams reach over it; single words compare exactly
    one = toxicity.char_model(spark.createDataFrame([(1, "banana")], "doc_id long, text string"))
    n = grams(["banana"])
    c3, c2, c1 = Counter(), Counter(), Counter()
    for g, k in n.items():
        c3[g[1:]] += k
        c2[g[2:]] += k
        c1[g[3:]] += k

    def p(g):
        total = sum(c1.values())
        q = (c1[g[3:]] + 1) / (total + LETTERS)
        q = (c2[g[2:]] + 4 * q) / (sum(k for x, k in c2.items() if x[:1] == g[2:3]) + 4)
        q = (c3[g[1:]] + 8 * q) / (sum(k for x, k in c3.items() if x[:2] == g[1:3]) + 8)
        return (n[g] + 16 * q) / (sum(k for x, k in n.items() if x[:3] == g[:3]) + 16)

    for g in [*n, (0, 0, 0, 1), (2, 1, 14, 5), (9, 9, 9, 9)]:
        assert abs(math.exp(one.log[g]) - p(g)) < 1e-5
    assert abs(float(np.exp(model.log).sum(axis=3).min()) - 1) < 1e-4


def spelled_out(channel, chars):
    """The likeliest word of a lattice by trying every way through it."""
    best = None

    def go(i, word, last, cost):
        nonlocal best
        if i == len(chars):
            h = [0, 0, 0, *map(letter, word[-3:])][-3:]
            end = cost - float(channel.log[h[0], h[1], h[2], 0])
            if best is None or end < best[0] - 1e-9:
                best = (end, word)
            return
        c = chars[i]
        options = [(c, 0.0)] if c.isalpha() else []
        options += [(m, Channel.ACCENT if c.isalpha() else Channel.SUBSTITUTE) for m in toxicity.LEET.get(c, "")]
        for o, price in options:
            h = [0, 0, 0, *map(letter, word[-3:])][-3:]
            go(i + 1, word + o, o, cost + price - float(channel.log[h[0], h[1], h[2], letter(o)]))
            if o == last:
                go(i + 1, word, last, cost + price + Channel.REPEAT)
        if c in toxicity.SEPARATORS:
            go(i + 1, word, last, cost + Channel.SEPARATE)
        elif not c.isalpha():
            go(i + 1, word, last, cost + Channel.JUNK)

    go(0, "", "", 0.0)
    return best[1]


def test_decoding_against_all_ways_through_the_lattice():
    counts = np.zeros(LETTERS**4)
    for w in ("stupid idiot little battle bottle loser moron grass apple banana total ".split()) * 20:
        for g in grams([w]):
            counts[((g[0] * LETTERS + g[1]) * LETTERS + g[2]) * LETTERS + g[3]] += 1
    channel = Channel(CharModel(counts), beam=4096)
    for chars in ("5tup1d", "s.t.u.p.i.d", "stuuupid", "1d10t", "l0$er", "m0r0n!", "b@n4n4", "ggrr4ss", "b0++le", "4pp|e", "a_p_p_l3"):
        assert channel.decode(chars) == spelled_out(channel, chars), chars
    assert Channel(CharModel(counts)).decode("5tup1d") == "stupid" and Channel(CharModel(counts)).decode("i.d.i.0.t") == "idiot"
