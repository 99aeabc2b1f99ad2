"""Removal of long repeated substrings by distributed prefix doubling over a sparse suffix order.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else.  As in prefix doubling, Spark
sorts string starts by the names of ever longer beginnings, and starts whose name is unique are dropped before the next
comparison; the last one is at ``length`` bytes.  A name is a hash of the bytes rather than a pair of the ranks of two
halves: README.md gives what the plain form, in which every byte carries a rank from round to round, would move.

Not all starts are sorted.  Equal strings of ``length`` bytes have the same smallest 32-byte name at the same place, so
each start belongs to one anchor, and its equals belong to anchors of the same name.  The rounds are:

1. Anchors (about one in 85 bytes) are sorted by (32-byte name, name of the stretch that all starts of the anchor
   cover).  A unique 32-byte name drops all starts of the anchor; an equal stretch settles all of them at once.
2. The starts of the anchors left are taken 16 at a time, by their distance from the anchor.  What all 16 strings have
   in common (185 bytes) is the next name, what they cover together (215 bytes) the next stretch: a unique name drops
   them, an equal stretch settles them.
3. Starts still left - those within 16 bytes of the end of a repeat - are sorted by the name of their ``length`` bytes,
   one representative standing for equal stretches.  Names met twice are repeats.

Names are hashes: 64 bits in rounds 1 and 2 beside the stretch's 64, 128 bits in round 3.  Documents never match across
their borders.  Copies of a text within a task are sorted once, with their weight; of equal stretches that a task meets
one goes on for all, and the others are settled in the task, so a passage that is everywhere is no hot key.

Defined results: a null text is empty; shorter texts than ``length`` keep all bytes; rows that repeat
doc_id and text are copies of each other, so all their bytes go; rows without doc_id, or that repeat a doc_id with
another text, get an id of their own inside and keep their doc_id in the result; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import SECOND_BASE, mix, names, prefix_hash, slim, spans, utf8, written

LENGTH, GRAM, BIN = 200, 32, 16
_LOW = np.uint64((1 << 24) - 1)


def anchors(data: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, first start, last start, anchor name, stretch name, anchor minus first start) of each anchor."""
    none = np.zeros(0, np.int64)
    n = len(data) - length + 1
    if n <= 0:
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none
    h = prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    g = names(h, at, at + gram)
    low = (g & ~_LOW) | at.astype(np.uint64)
    wide, width = low, 1
    want = length - gram + 1
    while width * 2 <= want:
        wide = np.minimum(wide[: len(wide) - width], wide[width:])
        width *= 2
    wide = np.minimum(wide[:n], wide[want - width : want - width + n])
    owner = (wide & _LOW).astype(np.int64)
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))[:n]
    ok = np.arange(n) + length <= off[1:][text]
    new = np.ones(n, bool)
    new[1:] = (owner[1:] != owner[:-1]) | (text[1:] != text[:-1]) | (ok[1:] != ok[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], n) - 1
    k = ok[first]
    first, last = first[k], last[k]
    stretch = names(h, first, last + length)
    t = text[first]
    return t, first - off[t], last - off[t], g[owner[first]], stretch, owner[first] - first


#: Longer texts are read in stretches that overlap by all but one byte of ``length``.
STRETCH = 1 << 22


def _pieces(data: np.ndarray, off: np.ndarray, length: int):
    """(rows, base, bytes, offsets): some texts whole, or a stretch of a long one that begins at ``base``."""
    for i, j in spans(off, min(1 << 20, STRETCH)):
        if off[j] - off[i] <= STRETCH:
            yield np.arange(i, j), 0, data[off[i] : off[j]], off[i : j + 1] - off[i]
        else:
            for s in range(0, int(off[j] - off[i]), STRETCH - length + 1):
                part = data[off[i] + s : min(off[j], off[i] + s + STRETCH)]
                yield np.array([i]), s, part, np.array([0, len(part)])


def settled_here(cols: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of ``anchor_rows``; of equal (name, stretch) one row goes on with weight 2, the others are told with weight -1.

    The latter need no comparison; their name is a number of their own, so that they are dealt evenly.
    """
    name, stretch, doc, first, more, weight = cols
    o = np.lexsort((-weight, stretch, name))
    name, stretch, doc, first, more, weight = (c[o] for c in (name, stretch, doc, first, more, weight))
    lead = np.append(True, (name[1:] != name[:-1]) | (stretch[1:] != stretch[:-1])) if len(name) else np.zeros(0, bool)
    run = np.cumsum(lead) - 1
    several = (np.bincount(run, weights=weight) >= 2)[run] if len(run) else lead
    spread = mix(doc.view(np.uint64) * np.uint64(31) + first.astype(np.uint64)).view(np.int64)
    name, stretch = np.where(lead, name, spread), np.where(lead, stretch, 0)
    weight = np.where(lead, np.where(several, 2, weight), -1)
    return pa.RecordBatch.from_arrays([pa.array(name), pa.array(stretch), pa.array(doc), pa.array(first.astype(np.int32)), pa.array(more.astype(np.int32)), pa.array(weight.astype(np.int32))], ["name", "stretch", "doc", "first", "more", "weight"])


#: So many rows are compared within a task at once.
HELD_ROWS = 1_000_000


def _settled(parts):
    """``settled_here`` over some parts at a time."""
    held: list = []
    for cols in parts:
        held.append(cols)
        if sum(len(c[0]) for c in held) > HELD_ROWS:
            yield settled_here([np.concatenate(x) for x in zip(*held, strict=True)])
            held = []
    if held:
        yield settled_here([np.concatenate(x) for x in zip(*held, strict=True)])


def anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(name, stretch, doc, first, more, weight): ``more`` starts follow ``first`` (times 256, plus the anchor's place).

    Weight 2 stands for more texts of this task with the same bytes.
    """

    def parts(batches):
        seen: set[bytes] = set()
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            data, off = utf8(b.column(1))
            raw = data.tobytes()
            kept, weight = [], {}
            for i in range(len(ids)):
                x = hashlib.md5(raw[off[i] : off[i + 1]]).digest()
                if x in weight:
                    weight[x][1] = 2
                    continue
                weight[x] = row = [i, 2 if x in seen else 1]
                kept.append(row)
                if len(seen) < 200_000:  # more would only save work
                    seen.add(x)
            # a text seen before in this task has its copy sorted already; both are repeats
            w = np.zeros(len(ids), np.int32)
            for i, k in kept:
                w[i] = k
            for rows, base, part, at in _pieces(data, off, length):
                t, first, last, name, stretch, lead = anchors(part, at, length, gram)
                r = rows[t] if len(t) else t
                k = w[r] > 0
                r = r[k]
                yield name[k].view(np.int64), stretch[k].view(np.int64), ids[r].astype(np.int64), first[k] + base, ((last - first) * 256 + lead)[k], w[r]

    return docs.mapInArrow(slim(lambda batches: _settled(parts(batches))), "name long, stretch long, doc long, first int, more int, weight int")


def _runs(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)


def compare_anchors(rows: DataFrame) -> DataFrame:
    """(doc, first, more, kind) of the repeated rows - kind 0: repeated; 1: repeated, and to be compared with others; 2: to be compared.

    Anchors come sorted by name and stretch.  A name is held until it ends; a very frequent one is told in parts, all
    its stretches then being compared in the next round.
    """
    most = 400_000

    def told(cols, whole: bool):
        name, stretch, doc, first, more, weight = cols
        a = _runs(name)
        both = np.stack([name, stretch])
        s = np.flatnonzero(np.append(True, (both[:, 1:] != both[:, :-1]).any(axis=0)))
        of_name = np.searchsorted(a, s, "right") - 1
        total = np.add.reduceat(weight, a)
        stretches = np.bincount(of_name, minlength=len(a))
        w = np.add.reduceat(weight, s)
        size = np.diff(np.append(s, len(name)))
        kind = np.where(np.repeat(w, size) >= 2, 0, 2)
        several = np.repeat(stretches[of_name] > 1, size) if whole else np.ones(len(name), bool)
        lead = np.zeros(len(name), bool)
        lead[s] = True
        kind[lead & (kind == 0) & several] = 1
        keep = np.repeat(total, np.diff(np.append(a, len(name)))) >= 2 if whole else np.ones(len(name), bool)
        return pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(first[keep]), pa.array(more[keep]), pa.array(kind[keep].astype(np.int32))], ["doc", "first", "more", "kind"])

    def work(batches):
        held = None
        parted = None  # the name that is being told in parts
        for b in batches:
            if not b.num_rows:
                continue
            cols = [c.to_numpy() for c in b.columns]
            done = cols[5] < 0
            if done.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[done]) for c in cols[2:5]] + [pa.array(np.zeros(done.sum(), np.int32))], ["doc", "first", "more", "kind"])
                cols = [c[~done] for c in cols]
            if not len(cols[0]):
                continue
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            cut = int(_runs(cols[0])[-1])
            if cut:
                a = [c[:cut] for c in cols]
                k = np.searchsorted(a[0], parted, "right") if parted is not None else 0
                if k:
                    yield told([c[:k] for c in a], False)
                if k < cut:
                    yield told([c[k:] for c in a], True)
                parted = None
            held = [c[cut:] for c in cols]
            if len(held[0]) > most:
                # the last stretch stays, so that its copies meet
                k = int(_runs(held[1])[-1]) or len(held[1]) - 1
                parted = held[0][0]
                yield told([c[:k] for c in held], False)
                held = [c[k:] for c in held]
        if held is not None and len(held[0]):
            yield told(held, parted is None or parted != held[0][0])

    parts = rows.repartition("name").sortWithinPartitions("name", "stretch", "doc", "first")
    return parts.mapInArrow(slim(work), "doc long, first int, more int, kind int")


def bin_rows(texts: DataFrame, length: int) -> DataFrame:
    """Rows as of ``anchor_rows`` for the starts to be compared, 16 by their distance from the anchor."""

    def parts(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            data, off = utf8(b.column(1))
            row, first, more, kind = _todo(b.column(2))
            for i, j in spans(off):
                part = data[off[i] : off[j]]
                k = slice(np.searchsorted(row, i), np.searchsorted(row, j))
                if k.start == k.stop:
                    continue
                r, f, m, lead, w = row[k], first[k], more[k] // 256, more[k] % 256, np.where(kind[k] == 1, 2, 1)
                base = off[r] - off[i]
                low = (lead - m) // BIN  # bins of the distances lead - m to lead
                n = lead // BIN - low + 1
                at = np.repeat(np.arange(len(r)), n)
                bins = low[at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                anchor = f[at] + lead[at]
                begin, end = np.maximum(f[at], anchor - BIN * bins - BIN + 1), np.minimum(f[at] + m[at], anchor - BIN * bins)
                h, base = prefix_hash(part), base[at]
                core = names(h, base + anchor - BIN * bins, base + anchor - BIN * bins - BIN + 1 + length)
                whole = names(h, base + begin, base + end + length)
                yield core.view(np.int64), whole.view(np.int64), ids[r[at]].astype(np.int64), begin, (end - begin) * 256, w[at]

    return texts.mapInArrow(slim(lambda batches: _settled(parts(batches))), "name long, stretch long, doc long, first int, more int, weight int")


def _todo(column: pa.Array) -> tuple[np.ndarray, ...]:
    """(row, first, more, kind) of a list column of structs, in the order of the rows."""
    size = np.diff(column.offsets.to_numpy())
    v = column.flatten()
    return np.repeat(np.arange(len(size)), size), *(v.field(c).to_numpy().astype(np.int64) for c in range(3))


def start_names(texts: DataFrame, length: int) -> DataFrame:
    """(n1, n2, doc, start, weight) of the starts to be compared; weight -1 marks a start that is settled already."""

    def work(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            data, off = utf8(b.column(1))
            rows, first, more, kinds = _todo(b.column(2))
            for i, j in spans(off):
                part = data[off[i] : off[j]]
                t = slice(np.searchsorted(rows, i), np.searchsorted(rows, j))
                if t.start == t.stop:
                    continue
                n = more[t] // 256 + 1
                row, kind = np.repeat(rows[t], n), np.repeat(kinds[t], n)
                start = np.repeat(first[t], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = start + off[row] - off[i]
                n1 = names(prefix_hash(part), at, at + length)
                n2 = names(prefix_hash(part, SECOND_BASE), at, at + length, SECOND_BASE)
                weight = np.where(kind == 1, 2, 1)
                # Names met twice here are settled here, and one row tells the others.
                order = np.lexsort((-weight, n2, n1))
                row, start, n1, n2, weight, kind = (x[order] for x in (row, start, n1, n2, weight, kind))
                lead = np.append(True, (n1[1:] != n1[:-1]) | (n2[1:] != n2[:-1]))
                run = np.cumsum(lead) - 1
                total = np.bincount(run, weights=weight)
                several = total[run] >= 2
                settled = several & (kind == 2)
                send = lead | settled
                out_w = np.where(lead, np.where(several, 2, 1), -1)
                # a settled start at the head of its run is told as well, in a row of its own
                extra = lead & settled
                col = lambda x: np.concatenate([x[send], x[extra]])  # noqa: B023, E731
                w = np.concatenate([out_w[send], np.full(int(extra.sum()), -1)])
                d, s = ids[col(row)], col(start)
                a, c = col(n1), col(n2)
                spread = mix(d.astype(np.int64).view(np.uint64) * np.uint64(31) + s.astype(np.uint64))
                a = np.where(w < 0, spread, a)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(c.view(np.int64)), pa.array(d, pa.int64()), pa.array(s.astype(np.int32)), pa.array(w.astype(np.int32))], ["n1", "n2", "doc", "start", "weight"])

    return texts.mapInArrow(slim(work), "n1 long, n2 long, doc long, start int, weight int")


def compare_starts(rows: DataFrame) -> DataFrame:
    """(doc, first): starts whose name is met twice. The first row of a name waits for a second one."""

    def work(batches):
        last = None  # name, doc, start, weight of the last row
        for b in batches:
            if not b.num_rows:
                continue
            n1, n2, doc, start, weight = (c.to_numpy() for c in b.columns)
            if last is not None:
                n1, n2, doc, start, weight = (np.append(x, y) for x, y in zip(last, (n1, n2, doc, start, weight), strict=True))
            done = weight < 0
            same = (n1[1:] == n1[:-1]) & (n2[1:] == n2[:-1])
            twice = np.zeros(len(n1), bool)
            twice[1:] |= same
            twice[:-1] |= same
            hit = done | (twice & (weight == 1))
            last = (n1[-1:], n2[-1:], doc[-1:], start[-1:], np.where(hit[-1:], 2, weight[-1:]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(doc[hit]), pa.array(start[hit])], ["doc", "first"])

    parts = rows.repartition("n1").sortWithinPartitions("n1", "n2")
    return parts.mapInArrow(slim(work), "doc long, first int")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document.

    With ``keep_text`` the columns of ``docs`` come too, ``text`` being what is left.
    """
    given = docs
    others = [c for c in docs.columns if c not in ("doc_id", "text")] if keep_text else []
    own_id = F.col("doc_id").cast("long")
    repeated = docs.where("doc_id IS NOT NULL").groupBy(own_id.alias("again")).agg(F.count("*").alias("n")).where("n > 1").select("again")
    docs = docs.select(own_id.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *[F.col(f"`{c}`").alias(f"other{i}") for i, c in enumerate(others)])
    if docs.where("doc_id IS NULL").limit(1).count() or repeated.limit(1).count():
        # ids of such rows are made from id and text, so that equal rows share one; others stay as they are
        docs = docs.join(repeated, F.col("doc_id") == F.col("again"), "left")
        odd = F.col("doc_id").isNull() | F.col("again").isNotNull()
        docs = docs.withColumn("doc", F.when(odd, F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id"))).drop("again")
    else:
        docs = docs.withColumn("doc", F.col("doc_id"))
    plain = docs.select("doc", "text")
    # Copies that a task left out are found again below by their text's hash: they repeat as a whole.
    found = written(compare_anchors(anchor_rows(plain, length, gram)), "anchors")

    def with_text(rows: DataFrame) -> DataFrame:
        # The texts are dealt by doc once; Spark reuses that exchange in all rounds.
        todo = rows.where("kind > 0").groupBy("doc").agg(F.collect_list(F.struct("first", "more", "kind")).alias("todo"))
        return plain.join(todo.hint("shuffle_merge"), "doc").select("doc", "text", "todo")

    bins = compare_anchors(bin_rows(with_text(found), length))
    fine = compare_starts(start_names(with_text(bins), length))
    settled = found.where("kind < 2").union(bins.where("kind < 2")).select("doc", "first", F.floor(F.col("more") / 256).cast("int").alias("more"))
    gone = settled.union(fine.select("doc", "first", F.lit(0).alias("more")))
    gone = gone.groupBy("doc").agg(F.collect_list(F.struct("first", "more")).alias("gone"))
    copies = docs.select(F.md5(F.col("text").cast("binary")).alias("md5")).groupBy("md5").count().where("count > 1").select("md5", F.lit(True).alias("copied"))
    own = docs.select("doc", F.md5(F.col("text").cast("binary")).alias("md5")).join(copies, "md5").select("doc", "copied").distinct()
    marks = gone.join(own, "doc", "full")

    def work(batches):
        for b in batches:
            ids = b.column(4)
            data, off = utf8(b.column(1))
            out: list[tuple] = []
            texts: list[bytes] = []
            for i in range(b.num_rows):
                x = data[off[i] : off[i + 1]]
                marks, copied = b.column(2)[i], b.column(3)[i].as_py()
                if copied and len(x) >= length:
                    k, spans_ = np.zeros(0, np.uint8), 1
                elif marks.is_valid:
                    v = marks.values
                    first, more = v.field(0).to_numpy(), v.field(1).to_numpy()
                    edge = np.bincount(first, minlength=len(x) + 1).astype(np.int64) - np.bincount(np.minimum(first + more + length, len(x)), minlength=len(x) + 1)
                    cover = np.cumsum(edge)[:-1] > 0
                    spans_ = int(cover[:1].sum() + (cover[1:] & ~cover[:-1]).sum())
                    k = x[~cover]
                else:
                    k, spans_ = x, 0
                raw = k.tobytes()
                out.append((len(x), len(x) - len(k), spans_, hashlib.sha256(raw).hexdigest()))
                if keep_text:
                    texts.append(raw)
            cols = list(zip(*out, strict=True)) or [[]] * 4
            arrays = [ids, *(pa.array(list(c), pa.int64()) for c in cols[:3]), pa.array(list(cols[3]), pa.string())]
            if keep_text:
                # a cut may fall inside a character; what is left of it is dropped
                arrays += [pa.array([t.decode("utf-8", "ignore") for t in texts], pa.string()), *b.columns[5:]]
            yield pa.RecordBatch.from_arrays(arrays, schema_names[: len(arrays)])

    kind = StructType().add("doc_id", "long").add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")
    if keep_text:
        kind = kind.add("text", "string")
        for i, c in enumerate(others):
            kind = kind.add(f"other{i}", given.schema[c].dataType)
    schema_names = kind.names
    joined = docs.join(marks, "doc", "left").select("doc", "text", "gone", "copied", "doc_id", *[f"other{i}" for i in range(len(others))])
    out = joined.mapInArrow(slim(work), kind)
    if not keep_text:
        return out
    back = {c: f"other{i}" for i, c in enumerate(others)}
    return out.select(*[F.col(back.get(c, c)).alias(c) for c in given.columns], "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_suffix_dedup(spark, sf_dir):
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
