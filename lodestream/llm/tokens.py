"""Fast encoding of many texts with a public tokenizer file.

A text is cut at single spaces between two non-space characters.  Both tokenizer files split there before they merge,
so the ids of a text are those of its pieces in a row; pieces are looked up in a bounded table of the worker, and only
unknown ones are encoded.  Pieces in Latin letters are cut once more at line ends and between letters and symbols.  A text that may
hold the string of a special token is given to the tokenizer whole.
"""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np

from .common import held

_CUT = re.compile(r"(?<=\S) (?=\S)|^ (?=\S)")
#: A word in Latin letters and a run of ASCII symbols; an apostrophe may begin a contraction and is left to the tokenizer.
_SHAPE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)\Z")

#: The printable characters that byte-level files use for bytes: bytes that print stand for themselves, others for 256 and up.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SHOWN = {b: (b if b in _PLAIN else 256 + sum(x not in _PLAIN for x in range(b))) for b in range(256)}


class PieceEncoder:
    """``glued``: a space belongs to the piece behind it (byte-level files); else spaces are dropped.

    Strings of special tokens in a text get the special ids, as the tokenizer does by itself; with ``special_as_text``
    they are ordinary text.  Texts that may hold one go through the tokenizer whole.
    """

    def __init__(self, path: str, glued: bool, most: int = 650_000, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: A text that holds one of these is not cut into pieces; the zero character marks a piece without a space before it.
        self.leads = ("\0", *(() if special_as_text else dict.fromkeys(x[:2] for x in added)))
        self.glued, self.most = glued, most
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 20, np.int32)
        self.used = 0
        self.start = np.zeros(1 << 18, np.int64)
        self.size = np.zeros(1 << 18, np.int64)
        self.rows = 0
        self.marks: dict[str, list[int]] = {}  # ids of runs of symbols

    def _ids(self, keys: list[str]) -> list[list[int]]:
        """Ids of each new piece. A key that begins with a zero character has no space before it.

        Lines that are a Latin word and perhaps symbols go through the merges; anything else through the whole tokenizer.
        """
        merge, glued, marks, known, start, size, flat = self.tokenizer.model.tokenize, self.glued, self.marks, self.known, self.start, self.size, self.flat

        def word(w: str, lead: bool) -> list[int]:
            if lead and (r := known.get(w, -1)) >= 0:
                return flat[start[r] : start[r] + size[r]].tolist()
            if not glued:
                w = w.lower()
            if not w.isascii():
                w = w.encode().decode("latin-1").translate(_SHOWN)
            return [t.id for t in merge("Ġ" + w if glued and lead else w)]

        def symbols(x: str) -> list[int]:
            if (ids := marks.get(x)) is None:
                if len(marks) > 100_000:
                    marks.clear()
                ids = marks[x] = self.tokenizer.encode(x, add_special_tokens=False).ids
            return ids

        out: list = []
        slow: list[int] = []
        for k in keys:
            if k.isascii() and k.isalpha():
                out.append([t.id for t in merge("Ġ" + k if glued else k.lower())])
                continue
            lead = not k.startswith("\0")
            if lead and (m := _SHAPE.match(k)):
                out.append(word(m[1], True) + symbols(m[2]) if m[2] else word(m[1], True))
                continue
            ids: list[int] = []
            for i, line in enumerate((k if lead else k[1:]).split("\n")):
                m = _SHAPE.match(line)
                if not m:
                    slow.append(len(out))
                    ids = (" " if glued and lead else "") + k.removeprefix("\0")
                    break
                if i and glued:
                    ids += symbols("\n")
                ids += word(m[1], lead and not i or not glued)
                if m[2]:
                    ids += symbols(m[2])
            out.append(ids)
        if slow:
            for i, e in zip(slow, self.tokenizer.encode_batch([out[i] for i in slow], add_special_tokens=False), strict=True):
                out[i] = e.ids
        return out

    def _add(self, keys: list[str]) -> dict[str, int]:
        """Rows of the table for new pieces; the caller drops those past the bound after the batch."""
        found = self._ids(keys)
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int32, int(size.sum()))
        rows, used = self.rows, self.used
        self.rows, self.used = rows + len(found), used + len(flat)
        while self.used > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.rows > len(self.start):
            self.start, self.size = (np.concatenate([a, np.zeros_like(a)]) for a in (self.start, self.size))
        self.flat[used : self.used] = flat
        self.size[rows : self.rows] = size
        self.start[rows : self.rows] = used + np.cumsum(size) - size
        return dict(zip(keys, range(rows, self.rows), strict=True))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids of each text."""
        whole = [i for i, t in enumerate(texts) if t and any(x in t for x in self.leads)]
        if not whole:
            return self._encode(texts)
        rest = list(texts)
        for i in whole:
            rest[i] = None
        ids, n = self._encode(rest)
        each = np.split(ids, np.cumsum(n)[:-1])
        for i in whole:
            each[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.int32)
        return np.concatenate(each), np.array([len(x) for x in each], np.int64)

    def _encode(self, texts: list[str | None], cut: frozenset[int] = frozenset()) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, by pieces. cut: texts in which spaces stand beside other spaces."""
        pieces: list[str] = []
        counts = []
        for i, t in enumerate(texts):
            p = _CUT.split(t or "") if i in cut else (t or "").split(" ")
            if self.glued:
                p[0] = "\0" + p[0]
            pieces += p
            counts.append(len(p))
        ends = np.cumsum(np.array(counts, np.int64))
        rows = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        lost = np.flatnonzero(rows < 0)
        held = (self.rows, self.used)
        if len(lost):
            missed = [pieces[i] for i in lost]
            keys = dict.fromkeys(missed)
            odd = {p for p in keys if not (q := p.removeprefix("\0")) or q.strip() != q}
            if odd and (more := {int(np.searchsorted(ends, i, "right")) for i, p in zip(lost, missed, strict=True) if p in odd} - cut):
                return self._encode(texts, cut | more)
            new = self._add(list(keys))
            rows[lost] = [new[p] for p in missed]
            if len(self.known) < self.most:
                for p in odd:
                    del new[p]
                self.known |= new
                held = None
        else:
            held = None
        size = self.size[rows]
        end = np.cumsum(size)
        ids = self.flat[np.repeat(self.start[rows] - (end - size), size) + np.arange(end[-1] if len(end) else 0)]
        if held is not None:
            self.rows, self.used = held
        total = np.append(0, end)[ends] if len(ends) else np.zeros(0, np.int64)
        return ids, np.diff(np.append(0, total))


#: Pieces that a worker keeps, and characters that it encodes at a time: for its speed and memory alone.
PIECES, ROOM = 650_000, 4_000_000


def encoder(path: str, glued: bool, most: int = PIECES) -> PieceEncoder:
    """One for each worker process; its table lives on between tasks."""
    return held(("encoder", path, glued, most), lambda: PieceEncoder(path, glued, most))


def encoded(texts: list[str | None], path: str, glued: bool, step: int = 500, most: int = PIECES, room: int = ROOM) -> Iterator[tuple[int, np.ndarray]]:
    """(position, ids) of each text, a few texts at a time."""
    enc = encoder(path, glued, most)
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and end - at < step and (end == at or chars < room):
            chars += len(texts[end] or "")
            end += 1
        on = gc.isenabled()
        gc.disable()  # the table holds millions of small objects, none in a cycle
        try:
            ids, n = enc.encode(texts[at:end])
        finally:
            if on:
                gc.enable()
        first = 0
        for j, size in enumerate(n):
            yield at + j, ids[first : first + size]
            first += size
        at = end
