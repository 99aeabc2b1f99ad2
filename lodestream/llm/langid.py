"""Language identification by error-correcting output codes.

Each language has a codeword; each bit of the code is a binary classifier (multinomial naive Bayes over hashed byte
trigrams, one against the other group of languages), calibrated to a probability by a logistic fit.  A text's bits
are decoded to the codeword of the least weighted logistic loss, bits weighing by their accuracy.  Texts whose two
nearest codewords are close are flagged as ambiguous.

Counts are taken from every training row, in Spark; only the calibration uses a bounded sample (the ``fit_rows`` training
rows with the smallest hash of id, text and language, equal rows once, of those with up to ``fit_bytes`` bytes).  Every
text is read whole.  Defined results: ``und`` with score 0 for a null
text or one without a letter; ``und`` for all if nothing could be learned; rows without doc_id are predicted, not held
out and not trained on; repeated rows count as rows; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spans, utf8

UNKNOWN = "und"
#: Letters have codes of their own, other ASCII is 0, bytes of longer characters share the rest of 64 codes.
CODE = np.zeros(256, np.int32)
CODE[97:123] = np.arange(1, 27)
CODE[65:91] = np.arange(1, 27)
CODE[128:] = 27 + np.arange(128) % 37
FEATURES = 1 << 18
_LETTER = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]")


def trigrams(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The feature at each byte; 0 (three blanks) where a trigram would leave its text."""
    c = CODE[data]
    f = np.zeros(len(c), np.int32)
    if len(c) > 2:
        f[:-2] = (c[:-2] << 12) | (c[1:-1] << 6) | c[2:]
    end = off[1:]
    for back in (1, 2):
        at = end - back
        f[at[at >= off[:-1]]] = 0
    return f


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1: the exhaustive code up to 5 classes, else the best of some seeded random codes."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 5:
        bits = 2 ** (n - 1) - 1
        return np.array([[1 if i == 0 or ((b + 1) >> (i - 1)) & 1 == 0 else -1 for b in range(bits)] for i in range(n)], float)
    bits, rng, best = math.ceil(10 * math.log2(n)), np.random.default_rng(3), None
    for _ in range(200):
        m = rng.choice([-1.0, 1.0], (n, bits))
        m = m[:, np.abs(m.sum(axis=0)) < n]
        d = (m.shape[1] - m @ m.T) / 2 + np.eye(n) * bits
        if best is None or d.min() > best[0]:
            best = (d.min(), m)
    return best[1]


class Codes:
    """The learned model: languages, codewords, feature weights of each bit, calibration, bit weights."""

    def __init__(self, langs: list[str], counts: np.ndarray, smooth: float = 0.5):
        self.langs, self.code = langs, codewords(len(langs))
        self.weights = np.zeros((self.code.shape[1], FEATURES), np.float32)
        kinds = (counts.sum(axis=0) > 0).sum()
        share = counts + smooth * (counts.sum(axis=0) > 0)
        share = share / np.maximum(share.sum(axis=1, keepdims=True), 1)  # languages weigh alike, however many rows they have
        floor = 0.5 / max(kinds, 1) * 1e-3
        for b in range(self.code.shape[1] if len(langs) > 1 else 0):
            pos, neg = (share[self.code[:, b] == s].mean(axis=0) for s in (1, -1))
            self.weights[b] = np.log(pos + floor) - np.log(neg + floor)
        self.weights[:, 0] = 0
        self.slope, self.shift, self.trust = np.full(len(self.weights), 4.0), np.zeros(len(self.weights)), np.ones(len(self.weights))

    def margins(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Mean log odds of each text (rows) for each bit."""
        f = trigrams(data, off)
        full = np.diff(off) > 0
        n = np.zeros(len(full))
        out = np.zeros((len(full), len(self.weights)))
        if full.any():
            at = off[:-1][full]
            n[full] = np.add.reduceat((f > 0).astype(np.int32), at)
            for b, w in enumerate(self.weights):
                out[full, b] = np.add.reduceat(w[f], at)
        return out / np.maximum(n, 1)[:, None]

    def calibrate(self, margins: np.ndarray, lang: np.ndarray) -> None:
        """Fit P(bit = 1) = 1 / (1 + exp(-(slope m + shift))) by a damped Newton method; trust is 1 - 2 errors."""
        for b in range(len(self.weights)):
            y = (self.code[lang, b] > 0).astype(float)
            if y.min() == y.max():
                continue
            x = np.stack([margins[:, b], np.ones(len(y))], axis=1)
            t = np.array([4.0, 0.0])
            for _ in range(30):
                p = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
                h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-2, 1e-2])
                t = t + np.clip(np.linalg.solve(h, x.T @ (y - p) - 1e-2 * t), -5, 5)
            self.slope[b], self.shift[b] = t
            self.trust[b] = max(0.05, 1 - 2 * float(((x @ t > 0) != (y > 0)).mean()))

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest codeword, its share of exp(-loss), and whether the next one is close."""
        z = np.clip(margins * self.slope + self.shift, -30, 30)
        loss = np.stack([(self.trust * np.logaddexp(0, -z * c)).sum(axis=1) for c in self.code], axis=1)
        p = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        p /= p.sum(axis=1, keepdims=True)
        best = loss.argmin(axis=1)
        return best, p[np.arange(len(p)), best], p.max(axis=1) < 0.75


def language_counts(rows: DataFrame) -> DataFrame:
    """(lang, feature, n): trigrams of all rows (text, lang), summed in each task before the shuffle."""

    def work(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            data, off = utf8(b.column(0))
            lang = np.array(b.column(1).to_pylist(), object)
            for i, j in spans(off):
                at = off[i : j + 1] - off[i]
                f = trigrams(data[off[i] : off[j]], at)
                size = np.diff(at)
                for name in set(lang[i:j]):
                    mine = f if (lang[i:j] == name).all() else f[np.repeat(lang[i:j] == name, size)]
                    got = np.bincount(mine, minlength=FEATURES)
                    total[name] = total[name] + got if name in total else got
        for name, n in total.items():
            k = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(k), pa.string()), pa.array(k), pa.array(n[k])], ["lang", "feature", "n"])

    return rows.mapInArrow(work, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))


def learn(rows: DataFrame, fit_rows: int = 2000, fit_bytes: int = 20_000) -> Codes | None:
    """rows: (doc_id, text, lang) to learn from."""
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    t = language_counts(rows.select("text", "lang")).toArrow()  # at most 2**18 numbers for each language
    if not t.num_rows:
        return None
    names = t.column("lang").to_numpy(zero_copy_only=False).astype(str)
    langs = sorted(set(names))
    counts = np.zeros((len(langs), FEATURES))
    counts[np.searchsorted(langs, names), t.column("feature").to_numpy()] = t.column("n").to_numpy()
    model = Codes(langs, counts)
    # hashes first (at most ``fit_rows`` numbers), then the rows of the smallest: no task gathers texts to sort them
    short = rows.where(F.octet_length("text") <= fit_bytes).withColumn("h", F.xxhash64("doc_id", "text", "lang"))
    least = short.select("h").orderBy("h").limit(fit_rows).agg(F.max("h")).first()[0]
    fit = short.where(F.col("h") <= F.lit(least)).dropDuplicates(["h"]).select("text", "lang").toArrow()
    if fit.num_rows:
        data, off = utf8(fit.column("text"))
        model.calibrate(model.margins(data, off), np.searchsorted(langs, fit.column("lang").to_numpy(zero_copy_only=False).astype(str)))
    return model


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_LETTER.search(text)) or any(c.isalpha() for c in text))


def predict(docs: DataFrame, model: Codes | None) -> DataFrame:
    """Columns lang_pred, score and ambiguous beside doc_id and held_out; docs: (doc_id, held_out, text)."""

    def work(batches):
        for b in batches:
            data, off = utf8(b.column(2))
            lang = np.full(b.num_rows, UNKNOWN, object)
            score, close = np.zeros(b.num_rows), np.ones(b.num_rows, bool)
            if model is not None:
                ok = np.array([has_letter(t) for t in b.column(2).to_pylist()], bool)
                for i, j in spans(off):
                    best, p, c = model.decode(model.margins(data[off[i] : off[j]], off[i : j + 1] - off[i]))
                    k = ok[i:j]
                    lang[i:j][k] = np.array(model.langs, object)[best[k]]
                    score[i:j][k], close[i:j][k] = p[k], c[k]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score), pa.array(close)], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return docs.mapInArrow(work, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def fold(id_col: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text falls into one part."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


def op5_language_codes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", fold("doc_id", 4, 2).alias("held_out"))
    model = learn(docs.where("NOT held_out AND doc_id IS NOT NULL").select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", "held_out", "text"), model)
