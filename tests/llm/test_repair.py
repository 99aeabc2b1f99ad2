"""Conversation repair: the search against all edit sequences, the query against a plain model of its contract."""

import hashlib
import random
import re
import zlib

from lodestream.llm import repair
from lodestream.llm.repair import Conversation, line

COLUMNS = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def exhaustive(rows):
    """The cheapest and then smallest edits of (role, text, fault) rows, by trying all."""
    best = [3 * len(rows), "D" * len(rows), []]

    def go(i, cost, audit, roles, out):
        if cost > best[0] or not re.match(r"(s?(ua)*u?)?\Z", roles):
            return
        if i == len(rows) and GRAMMAR.match(roles) and (cost, audit) < (best[0], best[1]):
            best[:] = [cost, audit, out]
        for r in ("user", "assistant"):
            go(i, cost + 2, audit + "I", roles + r[0], [*out, f"{r}:"])
        if i < len(rows):
            role, text, fault = rows[i]
            more = fault == "truncated"
            go(i + 1, cost + 3, audit + "D", roles, out)
            if fault not in ("blank", "duplicate"):
                go(i + 1, cost + more, audit + "K", roles + (role[:1] or "?"), [*out, f"{role}:{text}"])
                for r in ("user", "assistant"):
                    go(i + 1, cost + 2 + more, audit + "R", roles + r[0], [*out, f"{r}:{text}"])

    go(0, 0, "", "", [])
    return best[0], best[1], hashlib.sha256("\n".join(best[2]).encode()).hexdigest()


def searched(rows):
    c, audit = Conversation(1), b""
    for i, (role, text, fault) in enumerate(rows):
        audit += c.row(i, role, text, fault)
    cost, rest, digest = c.search.end()
    return cost, (audit + rest).decode(), digest


def test_search_finds_the_cheapest_and_smallest_edits():
    rng = random.Random(5)
    for _ in range(1200):
        roles = rng.choice([["user"], ["user", "assistant"], ["user", "assistant", "system", "tool", ""]])
        rows = [(rng.choice(roles), f"t{i}", rng.choice([None, None, None, "blank", "duplicate", "truncated"])) for i in range(rng.randint(0, 6))]
        assert searched(rows) == exhaustive(rows), rows


def test_what_is_decided_leaves_the_tree():
    rng = random.Random(2)
    c = Conversation(1)
    for i in range(5000):
        c.row(i, rng.choice(["user", "assistant"]), "x.", rng.choice([None, None, "blank", "truncated"]))
        nodes = {id(n): n for w in c.search.ways.values() for n in line(w.node)}
        assert len(nodes) <= 7 and sum(len(n.edits) for n in nodes.values()) < 200
    # a run of one role is undecided to its end, and takes two bytes a row
    c = Conversation(1)
    for i in range(1000):
        c.row(i, "user", f"x{i}.", None)
    nodes = {id(n): n for w in c.search.ways.values() for n in line(w.node)}
    assert len(nodes) <= 7 and sum(len(n.edits) for n in nodes.values()) < 4000
    assert c.search.end()[0] == 1000


def modelled(rows):
    """The contract on a list of (conv_id, turn, role, text), in plain Python."""
    groups = {}
    for conv, turn, role, text in rows:
        role, text = role or (" " if role is None else ""), " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        g = groups.setdefault(conv, [])
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        g += [] if k == 0 else [(turn is not None, turn or 0, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    out = {}
    for conv, g in groups.items():
        g.sort()
        turns = [t for known, t, _, _ in g if known]
        seen, faulty = set(), []
        for _, _, role, text in g:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            faulty.append((role, text, fault))
        count = lambda f: sum(x[2] == f for x in faulty)  # noqa: E731, B023
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:], strict=False))
        cost, audit, digest = exhaustive(faulty)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, digest)
    return out


def odd_rows():
    rng = random.Random(9)
    texts = ["Yes.", "No", " ", "", None, "Why?\n", "a.b!c?", "same.", "same.", "é 中.", "cut\u0085", "end. \u0085", "x" * 50_000 + "."]
    rows = [(conv, turn, rng.choice(["user", "assistant", "assistant", "system", "tool", "", None]), rng.choice(texts)) for conv in [*range(120), None] for turn in range(rng.randint(1, 6))]
    rows += [(500, None, "user", "a."), (500, None, "user", "a."), (500, 4, "assistant", "b."), (501, 3, "user", "q?"), (501, 3, "assistant", "r."), (502, -5, "user", "q?"), (502, 9, "assistant", "q.")]
    return rows


def test_query_follows_the_contract(spark, tmp_path):
    rows = odd_rows()
    path = str(tmp_path / "a")
    spark.createDataFrame([(*r, 1, 2, 3, "z") for r in rows], COLUMNS + ", fault long, gone long, k long, cost string").repartition(5).write.parquet(f"{path}/conversations.parquet")
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.op11_conversation_repair(spark, path).collect()}
    assert got == modelled(rows)
    # all rows of a conversation dropped: zeros, no edits, the hash of nothing
    gone = [v for v in got.values() if v == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert gone


def test_repaired_turns_have_the_hash(spark):
    df = spark.createDataFrame(odd_rows(), COLUMNS)
    rows = repair.faults(repair.damage(repair.prepared(df)))
    turns = {}
    for r in sorted(repair.repaired(rows).collect(), key=lambda r: r["position"]):
        turns.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for r in repair.summarise(rows).collect():
        assert hashlib.sha256("\n".join(turns.get(r["conv_id"], [])).encode()).hexdigest() == r["repaired_sha256"]
        assert GRAMMAR.match("".join(t[0] for t in turns.get(r["conv_id"], [])))


def test_empty_table_and_long_conversation(spark):
    none = spark.createDataFrame([], COLUMNS)
    run = lambda d: repair.summarise(repair.faults(repair.damage(repair.prepared(d))))
    assert run(none).count() == 0 and repair.repaired(repair.faults(repair.damage(repair.prepared(none)))).count() == 0
    long = spark.range(20_000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('text ', id, '.') AS text")
    [r] = run(long).collect()
    assert r["conv_id"] == 1 and 19_000 < len(r["audit"]) < 24_000 and r["duplicate"] > 500 and r["gaps"] > 500
