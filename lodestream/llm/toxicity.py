"""Toxicity with noisy-channel deobfuscation.

A word that looks disguised (digits or symbols among letters, letters run three times or more, separators between
letters, single letters spaced out) becomes a lattice: each character may stand for itself or for letters it resembles,
may repeat the letter before, or may be junk.  A Viterbi search with a beam finds the likeliest word under a character
4-gram model of the corpus; the restored text is then scored.

A token of more than ``longest`` characters is no one word: the parts between its marks are restored one by one, single
letters between marks are joined, and a run without marks is decoded in windows that overlap by 16 characters.

* The language model counts 4-grams over all words of all documents, summed in each task before the shuffle.
* The scorer is a noisy-or model over words and word beginnings of restored texts, learned from at most ``fit_rows``
  labelled documents (those with the smallest hash of their id).  Words with a strong likelihood ratio are candidates,
  and candidates are taken up greedily while they explain toxic documents that earlier ones explain seldom or not.

Defined results: a null text is empty and gets the score of a text without any listed word; documents with several
label rows count as toxic if one of them says so, null labels are left out; without labels every score is 0; rows
without doc_id are scored and not held out; repeated rows stay; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from .common import held, let_go, slim, written
from .langid import fold

#: Letters that a digit or symbol may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "gq",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "€": "e", "£": "l", "¡": "i",
    "ä": "a", "à": "a", "á": "a", "â": "a", "ã": "a", "å": "a", "è": "e", "é": "e", "ê": "e", "ë": "e", "ì": "i", "í": "i", "î": "i", "ï": "i",
    "ò": "o", "ó": "o", "ô": "o", "õ": "o", "ö": "o", "ù": "u", "ú": "u", "û": "u", "ü": "u", "ñ": "n", "ç": "c", "v": "u", "ß": "b",
}
SEPARATORS = set(".-_*'`~^,:;/\\ ​‌‍﻿­·")
#: Answers that a worker keeps, for its speed alone.
KEPT = 120_000
LETTERS = 28  # boundary, a to z, any other
_PLAIN = re.compile(r"[a-zà-öø-ÿ]+\Z")
_RUN = re.compile(r"(.)\1\1")
_ENDS = ".,;:!?\"'()[]{}<>«»…"
_LEADS = _ENDS.replace("!", "")
_SPACED = re.compile(r"(?:(?<=\s)|^)\S(?:[ \t]\S){2,}(?=\s|$)")
_MAYBE_SPACED = re.compile(r"\s\S[ \t]\S[ \t]")
_SINGLES = re.compile(r"(?:(?<=[^a-zà-öø-ÿ0-9@$!|+])|^)[a-zà-öø-ÿ0-9@$!|+](?:[^a-zà-öø-ÿ0-9@$!|+]+[a-zà-öø-ÿ0-9@$!|+]){2,}(?![a-zà-öø-ÿ0-9@$!|+])")
_DISGUISED = re.compile(r"[0-9@$!|+(<{€£¡.\-_*'`~^,:;/\\​‌‍﻿­·]")


def letter(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27


class CharModel:
    """Interpolated character 4-grams as a table of log probabilities."""

    def __init__(self, counts: np.ndarray):
        c4 = counts.reshape(LETTERS, LETTERS, LETTERS, LETTERS).astype(float)
        c3, c2 = c4.sum(axis=0), c4.sum(axis=(0, 1))
        c1 = c2.sum(axis=0)
        p = (c1 + 1) / (c1.sum() + LETTERS)
        p = (c2 + 4 * p) / (c2.sum(axis=1, keepdims=True) + 4)
        p = (c3 + 8 * p[None]) / (c3.sum(axis=2, keepdims=True) + 8)
        p = (c4 + 16 * p[None]) / (c4.sum(axis=3, keepdims=True) + 16)
        self.log = np.log(p).astype(np.float32)


def word_counts(batches):
    """4-gram counts of one task."""
    let_go()
    code = np.full(256, 27, np.int64)
    code[97:123] = np.arange(1, 27)
    code[65:91] = np.arange(1, 27)
    total = np.zeros(LETTERS**4, np.int64)

    def count(text: str) -> None:
        for s in range(0, len(text), 1 << 18):
            x = np.frombuffer(re.sub(r"[^a-zA-Zà-öø-ÿÀ-ÖØ-Þ]+", " ", text[s : s + (1 << 18)]).encode("latin-1", "replace"), np.uint8)
            c = code[x]
            c[x == 32] = 0
            c = np.concatenate([[0, 0, 0], c, [0]])
            g = ((c[:-3] * LETTERS + c[1:-2]) * LETTERS + c[2:-1]) * LETTERS + c[3:]
            np.add(total, np.bincount(g, minlength=LETTERS**4), out=total)

    for b in batches:
        some, size = [], 0
        for t in b.column(0):  # a few texts at a time, as one of them may need four bytes a character
            t = t.as_py()
            if t:
                some.append(t)
                size += len(t)
                if size > 1 << 18:
                    count(" ".join(some))
                    some, size = [], 0
        if some:
            count(" ".join(some))
    k = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], ["gram", "n"])


def char_model(docs: DataFrame) -> CharModel:
    t = docs.select("text").mapInArrow(slim(word_counts), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(LETTERS**4)
    counts[t.column("gram").to_numpy()] = t.column("n").to_numpy()
    return CharModel(counts)


def fold_text(text: str) -> str:
    return text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).lower()


def inside(whole: str) -> list[str]:
    """The joined run itself and its substrings of four letters and more: what may be a word of it."""
    return [whole] + [whole[i:j] for i in range(len(whole)) for j in range(i + 4, min(len(whole), i + 16) + 1)]


BEGINNINGS = range(4, 8)


def features(word: str) -> list[str]:
    """The word and its beginnings, marked by ^."""
    return [word, *[f"^{word[:k]}" for k in BEGINNINGS if len(word) > k]]


class Listed:
    """The words and beginnings that a scorer knows."""

    def __init__(self, found: list[str]):
        self.words = frozenset(f for f in found if f[0] != "^")
        self.starts = tuple(f[1:] for f in found if f[0] == "^")
        self.collapsed = frozenset(re.sub(r"(.)\1+", r"\1", w) for w in self.words)

    def holds(self, word: str) -> bool:
        return word in self.words or bool(self.starts) and word.startswith(self.starts)


class Channel:
    """Restores disguised words; answers are kept for the worker's life, up to a bound."""

    SUBSTITUTE, REPEAT, SEPARATE, JUNK, ACCENT = 1.0, 0.3, 0.3, 3.0, 1.5

    def __init__(self, model: CharModel, beam: int = 24, longest: int = 48):
        self.log, self.beam, self.longest = model.log, beam, longest
        self.known: dict[str, tuple[str, ...]] = {}

    def decode(self, chars: str, listed: Listed | None = None, margin: float = 14.0) -> str:
        """The likeliest word; a listed word within ``margin`` of the best path is preferred (its prior is higher)."""
        log = self.log
        heads: dict[tuple[str, str], tuple[float, str]] = {("", ""): (0.0, "")}
        for c in chars:
            out: dict[tuple[str, str], tuple[float, str]] = {}

            def put(word: str, cost: float, last: str, out=out) -> None:
                k = (word[-3:], last)
                if k not in out or cost < out[k][0]:
                    out[k] = (cost, word)

            maps = LEET.get(c, "")
            plain = c.isalpha()
            for (_, last), (cost, word) in heads.items():
                options = [(c, 0.0)] if plain else []
                options += [(m, self.ACCENT if plain else self.SUBSTITUTE) for m in maps]
                for o, price in options:
                    h = [0, 0, 0, *map(letter, word[-3:])][-3:]
                    put(word + o, cost + price - float(log[h[0], h[1], h[2], letter(o)]), o)
                    if o == last:
                        put(word, cost + price + self.REPEAT, last)
                if c in SEPARATORS:
                    put(word, cost + self.SEPARATE, last)
                elif not plain:
                    put(word, cost + self.JUNK, last)
            heads = dict(sorted(out.items(), key=lambda x: x[1][0])[: self.beam])
        ends = []
        for cost, word in heads.values():
            h = [0, 0, 0, *map(letter, word[-3:])][-3:]
            ends.append((cost - float(log[h[0], h[1], h[2], 0]), word))
        ends.sort()
        for cost, word in ends:
            if listed and cost <= ends[0][0] + margin and listed.holds(word):
                return word
        return ends[0][1] if ends else chars

    def restore(self, word: str, listed: Listed | None = None) -> tuple[str, ...]:
        """The words that a lower-case token stands for: one, or the parts of a joined token beside the whole."""
        core = word.lstrip(_LEADS).rstrip(_ENDS)
        if _PLAIN.match(core) and not _RUN.search(core):
            return (core,)
        if not core or not any(c.isalpha() or c in "@$" for c in core):
            return (core,) if core else ()
        core = core.rstrip("$*_~^-+=|<>/\\#%&") or core
        if _PLAIN.match(core) and not _RUN.search(core):
            return (core,)
        parts = [p for p in re.split(r"[^a-zà-öø-ÿ0-9@$!|+]+", core) if len(p) > 2]
        if len(core) > self.longest:
            # no one word: what stands between marks is restored by itself, and single letters between marks are joined
            out = [w for p in parts if p != core for w in self.restore(p, listed)]
            if p_runs := _SINGLES.findall(core):
                out += [w for r in p_runs for x in self.windows(re.sub(r"[^a-zà-öø-ÿ0-9@$!|+]+", "", r)) for w in inside(self.decode(x, listed))]
            if parts == [core] or not parts:
                squeezed = re.sub(r"(.)\1{2,}", r"\1\1", core)
                if len(squeezed) <= self.longest:
                    out.append(self.decode(squeezed, listed))
                else:
                    out += [w for x in self.windows(squeezed) for w in inside(self.decode(x, listed))]
            return tuple(dict.fromkeys(out))
        if _PLAIN.match(core) or _DISGUISED.search(core):
            whole = self.decode(core, listed)
            more = [self.decode(p, listed) if not _PLAIN.match(p) or _RUN.search(p) else p for p in parts if p != core]
            return tuple(dict.fromkeys([whole, *more]))
        return (core,)

    def words(self, text: str, listed: Listed | None = None) -> set[str]:
        """All words of the restored text."""
        text = fold_text(text)
        out: set[str] = set()
        for w in set(text.split()):
            got = self.known.get(w)
            if got is None:
                got = self.restore(w, listed)
                if len(self.known) < KEPT:
                    self.known[w] = got
            out.update(got)
        for joined in self.spaced(text):
            whole = self.decode(joined, listed)
            out.update(inside(whole))
        return out

    def spaced(self, text: str) -> list[str]:
        """Runs of single characters with a blank between them, joined."""
        if not _MAYBE_SPACED.search(f" {text} "):
            return []
        return [x for m in _SPACED.findall(text) for x in self.windows(re.sub(r"\s", "", m))]

    def windows(self, run: str) -> list[str]:
        """Stretches that overlap by 16, the most that a word is taken to have in a longer run."""
        return [run[i : i + self.longest] for i in range(0, max(1, len(run) - 16), self.longest - 16)]

    def restored(self, text: str | None, listed: Listed | None = None) -> str:
        """The text with disguised words put right."""
        text = _SPACED.sub(lambda m: "".join(self.decode(r[i : i + self.longest], listed) for r in [re.sub(r"\s", "", m[0].lower())] for i in range(0, len(r), self.longest)), text or "")
        return re.sub(r"\S+", lambda m: m[0] if _PLAIN.match(m[0].strip(_ENDS).lower()) and not _RUN.search(m[0].lower()) else (self.restore(m[0].lower(), listed) or ("",))[0], text)


def channel(model: CharModel) -> Channel:
    """One for each model in a worker process."""
    return held(("channel", hashlib.md5(model.log.tobytes()).digest()), lambda: Channel(model))


def feature_counts(rows: DataFrame, model: CharModel) -> DataFrame:
    """(feature, a, b): toxic and other documents that have it, from every labelled row (text, toxic)."""

    def work(batches):
        ch = channel(model)
        seen: dict[str, list[int]] = {}

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(seen, pa.string()), pa.array([x[0] for x in seen.values()], pa.int64()), pa.array([x[1] for x in seen.values()], pa.int64())], ["feature", "a", "b"])
            seen.clear()
            return out

        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                k = 0 if toxic == 1 else 1
                for f in {f for w in ch.words(text or "") if len(w) >= 3 for f in features(w)}:
                    seen.setdefault(f, [0, 0])[k] += 1
                if len(seen) > 400_000:
                    yield flush()
        if seen:
            yield flush()

    return rows.mapInArrow(slim(work), "feature string, a long, b long").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


class Scorer:
    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.listed = Listed([w for w, x in weights.items() if x > 0])
        self.known: dict[str, tuple[str, ...]] = {}

    def _hits(self, words) -> tuple[str, ...]:
        return tuple(f for w in words for f in features(w) if f in self.weights)

    def _token(self, token: str, ch: Channel) -> tuple[str, ...]:
        words = ch.restore(token, self.listed)
        hit = self._hits(words)
        # doubled letters are too common to decode each; they are decoded if a listed word would come out
        for w in () if hit else words:
            if (c := re.sub(r"(.)\1+", r"\1", w)) != w and c in self.listed.collapsed:
                hit += self._hits([ch.decode(w, self.listed)])
        return hit

    def score(self, text: str, ch: Channel) -> float:
        hit: set[str] = set()
        text = fold_text(text)
        for w in set(text.split()):
            got = self.known.get(w)
            if got is None:
                got = self._token(w, ch)
                if len(self.known) < KEPT:
                    self.known[w] = got
            if got:
                hit.update(got)
        for joined in ch.spaced(text):
            hit.update(self._hits(inside(ch.decode(joined, self.listed))))
        return float(-np.expm1(-self.bias - sum(self.weights[w] for w in hit)))


def learn_scorer(rows: DataFrame, model: CharModel, candidates: int = 3000, ratio: float = 22.0, precision: float = 0.9) -> Scorer:
    """rows: (text, toxic) of every labelled row to learn from."""
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}  # two numbers
    pos, neg = n.get(1, 0), n.get(0, 0)
    if not pos or not neg:
        return Scorer({}, 0.0 if not pos else 30.0)
    # Likelihood ratio of toxic documents with and without the feature, for those that are more frequent in toxic ones.
    part = lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(0.0)
    a, b, p = F.col("a").cast("double"), F.col("b").cast("double"), pos / (pos + neg)
    g = 2 * (part(a, (a + b) * p) + part(b, (a + b) * (1 - p)) + part(pos - a, (pos + neg - a - b) * p) + part(neg - b, (pos + neg - a - b) * (1 - p)))
    best = feature_counts(rows, model).where((F.col("a") > 3) & (F.col("a") > precision * (F.col("a") + F.col("b")))).withColumn("g", F.round(g, 6)).where(F.col("g") > ratio)
    found = [r["feature"] for r in best.orderBy(F.desc("g"), F.col("feature").startswith("^"), F.desc(F.length("feature")), "feature").limit(candidates).select("feature").collect()]
    base = float(-np.log1p(-pos / (pos + neg)))
    if not found:
        return Scorer({}, base)
    at = {f: i for i, f in enumerate(found)}

    def present(batches):
        ch = channel(model)
        for b in batches:
            got = [sorted({at[f] for w in ch.words(t or "") for f in features(w) if f in at}) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(got, pa.list_(pa.int32()))], ["toxic", "found"])

    fit = rows.select("text", "toxic").mapInArrow(slim(present), "toxic int, found array<int>").toArrow()
    y = fit.column("toxic").to_numpy()
    x = np.zeros((len(y), len(found)), bool)
    for i, ks in enumerate(fit.column("found").to_pylist()):
        x[i, ks] = True
    # Weighted greedy cover: what explains most toxic documents, each of which counts less the more often it is explained.
    weight, taken, free = (y == 1).astype(float), [], np.ones(len(found), bool)
    both = (x & (y == 1)[:, None]).astype(np.float32)
    size = both.sum(axis=0)
    prior = np.where([f[0] == "^" for f in found], 0.8, 1.0)  # a beginning has to explain more than a whole word
    while len(taken) < 256 and free.any():
        gain = np.where(free, weight @ both * prior, 0)
        k = int(np.argmax(gain))
        if gain[k] < 2.5:
            break
        taken.append(k)
        # what comes with it in the same documents (a longer beginning, the words of one copied text) tells nothing new
        shared = both[:, k] @ both
        free &= shared < 0.8 * (size + size[k] - shared)
        weight[x[:, k]] *= 0.8
    if not taken:
        return Scorer({}, base)
    # Noisy or: each one makes a document toxic by itself with its own precision, none of them with the rate of the rest.
    hit = x[:, taken]
    p = ((hit & (y == 1)[:, None]).sum(axis=0) + 0.5) / (hit.sum(axis=0) + 1)
    none = ~hit.any(axis=1)
    rest = ((y[none] == 1).sum() + 0.5) / (none.sum() + 2)
    return Scorer({found[k]: float(-np.log1p(-q)) for k, q in zip(taken, p, strict=True)}, float(-np.log1p(-min(rest, 0.4))))


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000) -> tuple[CharModel, Scorer]:
    """docs: (doc_id, text) for the language model; labels: (doc_id, toxic) to learn from, at most ``fit_rows`` documents."""
    model = char_model(docs)
    label = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    # at most ``fit_rows`` pairs of numbers, so the texts need not be shuffled
    label = label.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = written(docs.join(F.broadcast(label), "doc_id").select("text", "toxic"), "labelled")
    return model, learn_scorer(rows, model)


def score(docs: DataFrame, model: CharModel, scorer: Scorer) -> DataFrame:
    """All columns of ``docs`` (which has ``text``) and score, predicted."""
    cols = docs.columns
    at = cols.index("text")

    def work(batches):
        ch = channel(model)
        for b in batches:
            s = np.array([scorer.score(t or "", ch) for t in b.column(at).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*cols, "score", "predicted"])

    kind = StructType([*docs.schema.fields]).add("score", DoubleType()).add("predicted", IntegerType())
    return docs.mapInArrow(slim(work), kind)


def op9_toxicity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~fold("doc_id", 5, 0))
    model, scorer = learn(docs, labels)
    out = score(docs.withColumn("held_out", fold("doc_id", 5, 0)), model, scorer)
    return out.select("doc_id", "held_out", "score", "predicted")
