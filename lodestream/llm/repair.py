"""Conversation repair by a Viterbi search whose decisions come out when all survivors share them.

A conversation's rows pass one after the other, in turn order, through four states: nothing put out yet, after the
system turn, after a user turn, after an assistant turn.  Each state keeps its cheapest way there.  The ways are a tree of
back pointers: a node holds a run of edits and counts what stands on it (ways and branches); a node that nothing stands
on goes, one that a single branch stands on takes that branch's edits up, so what all survivors share gathers in the
root and can be put out.  There are at most four ways, so the tree has at most seven nodes, and beside the edits that are
still undecided nothing of a conversation is held: texts are hashed (or put out) as they pass, one hash a way.

Ways of equal cost are compared by their whole undecided edits, from their last common node on; the smaller string in
ASCII wins.  Ways that can no longer win go at once: a way without output that costs over 3 more than one after an
assistant turn (which could delete a system turn instead), or a way after a system turn that costs more than one after
an assistant turn.

Spark shuffles once, by conversation; repeated rows are found by a window and rows are put in order by sorts inside the
same partitions, both of which spill.  SHA-256 of a whole conversation has to see its texts one after the other, so one
conversation is one task's stream, however long; the task holds its edits (a byte each), not its rows.

Defined results: null ids form one conversation of their own; rows of equal turn go by role, then text, in code point
order; null turns come first; null roles and texts are one space; an empty table gives no rows; other columns are left
out; ``gaps`` beyond a long is given as the largest long.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT = b"K", b"R", b"D", b"I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state that a turn of this initial leads to, by the state before it.
AFTER = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: What a new turn has to be, by the state before it.
NEEDED = {NOTHING: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}


def prepared(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text), nulls of role and text as one space."""
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")).alias(c)
    return df.select(F.col("`conv_id`").cast("long").alias("conv_id"), F.col("`turn`").cast("long").alias("turn"), text("role"), text("text"))


def damage(rows: DataFrame) -> DataFrame:
    """Rows of ``prepared`` with planted faults, and ``gone`` for those that are dropped, so that no conversation vanishes."""
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.pmod(F.crc32(F.concat(number("conv_id"), F.lit(":"), number("turn"))), F.lit(20))
    out = rows.withColumn("k", k).withColumn("gone", F.col("k") == 0)
    text = F.when(F.col("k") <= 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    out = out.withColumns({"text": text, "role": F.when(F.col("k") == 4, "user").otherwise(F.col("role"))})
    return out.withColumn("copy", F.explode(F.when(F.col("k") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("k", "copy")


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``gone``) and ``fault``: blank, duplicate, truncated or null; one partition holds a conversation whole."""
    d = rows.repartition("conv_id")
    trimmed = F.rtrim("text", F.lit(SPACE))
    again = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    fault = F.when(trimmed == "", "blank").when(again > 1, "duplicate").when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), "truncated")
    return d.withColumn("fault", F.when(~F.col("gone"), fault)).sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")


class Node:
    """A run of edits; ``stands`` counts the ways that end here and the branches that go on from here."""

    __slots__ = ("edits", "stands", "up")

    def __init__(self, up: Node | None, edits: bytes = b""):
        self.up, self.edits, self.stands = up, bytearray(edits), 0
        if up is not None:
            up.stands += 1


def line(node: Node) -> list[Node]:
    """The nodes from the root to ``node``."""
    out = []
    while node is not None:
        out.append(node)
        node = node.up
    return out[::-1]


def smaller(a: tuple[Node, bytes], b: tuple[Node, bytes]) -> bool:
    """Whether the undecided edits of the first way come before those of the second."""
    x, y = line(a[0]), line(b[0])
    i = 0
    while i < len(x) and i < len(y) and x[i] is y[i]:
        i += 1
    return b"".join([*[bytes(n.edits) for n in x[i:]], a[1]]) < b"".join([*[bytes(n.edits) for n in y[i:]], b[1]])


class Way:
    __slots__ = ("cost", "node", "hash", "any")

    def __init__(self, cost, node, digest, any_out):
        self.cost, self.node, self.hash, self.any = cost, node, digest, any_out


class Survivors:
    """The cheapest way to each state, over the rows so far."""

    def __init__(self):
        self.root = Node(None)
        self.ways: dict[int, Way] = {NOTHING: Way(0, self.root, hashlib.sha256(), False)}
        self.root.stands = 1
        self.inserts()

    def put(self, way: Way, line_: bytes | None) -> tuple:
        """The hash after one more turn, or the same one after none."""
        if line_ is None:
            return way.hash, way.any
        h = way.hash.copy()
        h.update(b"\n" + line_ if way.any else line_)
        return h, True

    def take(self, best: dict[int, tuple[int, Way, bytes, bytes | None]], kept: dict[int, Way]) -> None:
        """Let ``best`` (state: cost, from, edit, line) and the ways of ``kept`` be the survivors."""
        before = list(self.ways.values())
        new = dict(kept)
        users: dict[int, int] = {}
        for _, way, _, _ in best.values():
            users[id(way)] = users.get(id(way), 0) + 1
        staying = {id(w) for w in kept.values()}
        grown: set[int] = set()
        for state, (cost, way, edit, out) in best.items():
            digest, any_out = self.put(way, out)
            if users[id(way)] == 1 and id(way) not in staying and way.node.stands == 1:
                node = way.node  # nothing else stands here, so the run goes on
                node.edits += edit
                grown.add(id(way))
            else:
                node = Node(way.node, edit)
                node.stands = 1
            new[state] = Way(cost, node, digest, any_out)
        for w in before:
            if id(w) not in staying and id(w) not in grown:
                self.leave(w.node)
        self.ways = new
        self.gather()

    def leave(self, node: Node | None) -> None:
        while node is not None:
            node.stands -= 1
            if node.stands:
                return
            node = node.up

    def gather(self) -> None:
        """Nodes with a single branch take its edits up."""
        ends = {id(w.node) for w in self.ways.values()}
        lines = [line(w.node) for w in self.ways.values()]
        for nodes in lines:
            for n in reversed(nodes[1:]):
                up = n.up
                if up is not None and up.stands == 1 and id(up) not in ends and n.up is up:
                    up.edits += n.edits
                    up.stands = n.stands
                    # what stood on the branch stands on the node now
                    for other in lines:
                        for m in other:
                            if m.up is n:
                                m.up = up
                    for w in self.ways.values():
                        if w.node is n:
                            w.node = up
                    ends = {id(w.node) for w in self.ways.values()}
                    n.up = None

    def inserts(self) -> None:
        """Ways that go on with one or two turns of no text."""
        for state, sources in ((USER, (NOTHING, SYSTEM, ASSISTANT)), (ASSISTANT, (USER,))):
            best: dict = {}
            for s in sources:
                if (w := self.ways.get(s)) is not None:
                    self.offer(best, state, w.cost + INSERT_COST, w, INSERT, f"{NEEDED[s]}:".encode())
            if best:
                cost, w, edit, _ = best[state]
                old = self.ways.get(state)
                if old is None or cost < old.cost or cost == old.cost and smaller((w.node, edit), (old.node, b"")):
                    self.take(best, {s: x for s, x in self.ways.items() if s != state})

    @staticmethod
    def offer(best: dict, state: int, cost: int, way: Way, edit: bytes, out: bytes | None) -> None:
        old = best.get(state)
        if old is None or cost < old[0] or cost == old[0] and smaller((way.node, edit), (old[1].node, old[2])):
            best[state] = (cost, way, edit, out)

    def row(self, role: str, text: str, fault: str | None) -> None:
        best: dict = {}
        must_go = fault in ("blank", "duplicate")
        more = TRUNCATED_COST if fault == "truncated" else 0
        go_on = AFTER.get(role[:1], {})
        body = f":{text}".encode()
        for s, w in self.ways.items():
            self.offer(best, s, w.cost + DELETE_COST, w, DELETE, None)
            if must_go:
                continue
            if s in go_on:
                self.offer(best, go_on[s], w.cost + more, w, KEEP, role.encode() + body)
            to = NEEDED[s]
            self.offer(best, AFTER[to[0]][s], w.cost + REROLE_COST + more, w, REROLE, to.encode() + body)
        limit = best[ASSISTANT][0] if ASSISTANT in best else None
        if limit is not None:
            for s, room in ((NOTHING, 3), (SYSTEM, 0)):
                if s in best and best[s][0] > limit + room:
                    del best[s]
        self.take(best, {})
        self.inserts()

    def decided(self) -> bytes:
        """The edits that all survivors share, which are given out once."""
        out = bytes(self.root.edits)
        self.root.edits.clear()
        return out

    def end(self) -> tuple[int, bytes, str]:
        """Cost, the edits that were still undecided, and the hash of what is put out."""
        done = [w for s, w in self.ways.items() if s in (NOTHING, ASSISTANT)]
        best = done[0]
        for w in done[1:]:
            if w.cost < best.cost or w.cost == best.cost and smaller((w.node, b""), (best.node, b"")):
                best = w
        return best.cost, b"".join(bytes(n.edits) for n in line(best.node)), best.hash.hexdigest()


FAULTS = ("blank", "duplicate", "truncated")
LEGAL = {"su", "ua", "au"}
LARGEST = (1 << 63) - 1


class Conversation:
    """Counts of one conversation and its search, row by row."""

    def __init__(self, conv_id):
        self.conv_id, self.search = conv_id, Survivors()
        self.counts = dict.fromkeys(FAULTS, 0)
        self.illegal, self.turns, self.first, self.last, self.before = 0, 0, None, None, None
        self.audit = bytearray()

    def row(self, turn, role: str, text: str, fault: str | None) -> bytes:
        if fault:
            self.counts[fault] += 1
        if self.before is not None and self.before + role[:1] not in LEGAL:
            self.illegal += 1
        self.before = role[:1]
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1
        self.search.row(role, text, fault)
        return self.search.decided()

    def gaps(self) -> int:
        return 0 if self.first is None else min(LARGEST, self.last - self.first + 1 - self.turns)


def stream(batches):
    """Batches of sorted rows -> (conversation, decided edits or None at its end)."""
    now = None
    for b in batches:
        cols = [b.column(i).to_pylist() for i in range(6)]
        for conv, turn, role, text, gone, fault in zip(*cols, strict=True):
            if now is None or conv != now.conv_id:
                if now is not None:
                    yield now, None
                now = Conversation(conv)
            if not gone and (out := now.row(turn, role, text, fault)):
                yield now, out
    if now is not None:
        yield now, None


COLUMNS = ["conv_id", "turn", "role", "text", "gone", "fault"]


def summarise(rows: DataFrame) -> DataFrame:
    """A row for each conversation of ``faults``: counts, cost, audit and the hash of the repaired turns."""
    names = ["conv_id", "gaps", *FAULTS, "illegal", "cost", "audit", "repaired_sha256"]

    def work(batches):
        held: list[tuple] = []
        size = 0
        for c, out in stream(batches):
            if out is not None:
                c.audit += out
                continue
            cost, rest, digest = c.search.end()
            c.audit += rest
            held.append((c.conv_id, c.gaps(), *c.counts.values(), c.illegal, cost, c.audit.decode(), digest))
            size += len(c.audit) + 100
            if size > 1 << 20:
                yield batch(held)
                held, size = [], 0
        if held:
            yield batch(held)

    def batch(held):
        cols = list(zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.string() if i > 6 else pa.int64()) for i, x in enumerate(cols)], names)

    return rows.select(*COLUMNS).mapInArrow(work, "conv_id long, " + ", ".join(f"{c} long" for c in names[1:7]) + ", audit string, repaired_sha256 string")


def edits(rows: DataFrame) -> DataFrame:
    """(conv_id, step, edit, nth): every edit in order, ``nth`` the number (from 0) of the row it is about, null for an
    insertion.  Edits leave the task as soon as they are decided."""

    def work(batches):
        done: dict = {}
        for c, out in stream(batches):
            step, nth = done.get("at", (0, 0)) if done.get("of") is c else (0, 0)
            if out is None:
                out = c.search.end()[1]
            about, of = [], out.decode()
            for e in of:
                about.append(None if e == "I" else nth)
                nth += e != "I"
            done = {"of": c, "at": (step + len(of), nth)}
            if of:
                yield pa.RecordBatch.from_arrays([pa.array([c.conv_id] * len(of), pa.int64()), pa.array(range(step, step + len(of)), pa.int64()), pa.array(list(of)), pa.array(about, pa.int64())], ["conv_id", "step", "edit", "nth"])

    return rows.select(*COLUMNS).mapInArrow(work, "conv_id long, step long, edit string, nth long")


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, position, role, text): the repaired turns of rows with ``gone`` and ``fault``, in one shuffle more."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    own = rows.where(~F.col("gone")).withColumn("nth", F.row_number().over(order) - 1)
    kept = edits(rows).where("edit <> 'D'").withColumn("position", F.row_number().over(Window.partitionBy("conv_id").orderBy("step")) - 1)
    a, b = kept.alias("a"), own.alias("b")
    j = a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.nth") == F.col("b.nth")), "left")
    # a system turn can only be the first; from there on user and assistant take turns
    system: Column = F.max(F.when((F.col("position") == 0) & (F.col("edit") == "K") & (F.left("role", F.lit(1)) == "s"), 1).otherwise(0)).over(Window.partitionBy("conv_id"))
    out = j.select("a.conv_id", "position", "edit", "b.role", "b.text").withColumn("s", system)
    turn = F.when(F.pmod(F.col("position") - F.col("s"), F.lit(2)) == 0, "user").otherwise("assistant")
    return out.select("conv_id", "position", F.when(F.col("edit") == "K", F.col("role")).otherwise(turn).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def op11_conversation_repair(spark, sf_dir):
    return summarise(faults(damage(prepared(spark.read.parquet(f"{sf_dir}/conversations.parquet")))))
