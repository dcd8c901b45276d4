"""Exact duplicates, the prefix trie and structure repair against plain Python."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbline.llm import exact_dedup, prefix_trie, queries, repair, skew

TALK = "conv_id bigint, turn bigint, role string, text string, place int, x string, fault int, part string"


def talk(spark, rows):
    """Rows of (conv_id, turn, role, text) with further columns of clashing names."""
    return spark.createDataFrame([(*r, 1, "a", 2, "b") for r in rows], TALK)


# Exact duplicates


def by_hand(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), i is None, i or 0, i))
    found = []
    for form, members in groups.items():
        members.sort(key=lambda m: m[:3])
        digest = hashlib.sha256(form.encode()).hexdigest()
        found += [(m[3], members[0][3], len(members), place == 0, digest) for place, m in enumerate(members)]
    return sorted(found, key=str)


def odd_texts():
    rng = np.random.default_rng(1)
    rows = [(i, f"text {rng.integers(0, 150)}" + " " * int(rng.integers(0, 3))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, " \t\n\x0b\x0c\r"), (1003, " "), (None, "text 1"), (None, "text 1"), (None, "only here")]
    rows += [(5, rows[5][1]), (5, rows[5][1]), (7, "other"), (2000, "x y " * 200_000), (2001, "xy" * 200_000), (2002, "É é"), (2003, "É\té")]
    return rows + [(3000 + i, "hot") for i in range(300)]


@pytest.mark.parametrize("slice_rows", [1 << 25, 100])
def test_exact_duplicates_against_brute_force(spark, slice_rows):
    rows = odd_texts()
    table = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], "doc_id bigint, text string, h int, maybe string, size int").repartition(5)
    got = exact_dedup.exact_duplicates(table, slice_rows=slice_rows).collect()
    assert sorted((tuple(r) for r in got), key=str) == by_hand(rows)


def test_filter_keeps_unlike_rows_out_of_the_shuffle(spark):
    rows = spark.range(20_000).select(F.xxhash64(F.col("id") % 19_000).alias("h"), "id")
    flagged = exact_dedup._with_maybe(rows, 20_000)
    counts = {r["again"]: r["n"] for r in flagged.where("maybe").groupBy((F.col("id") % 19_000 < 1000).alias("again")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts[True] == 2000 and counts[False] < 0.03 * 18_000


def test_exact_duplicates_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert not exact_dedup.exact_duplicates(none).collect()


def test_join_by_heat_loses_no_row(spark, monkeypatch):
    monkeypatch.setattr(skew, "MOST_HOT", 3)
    rows = spark.range(200).select((F.when(F.col("id") < 100, 0).otherwise(F.col("id") % 20)).alias("k"), "id")
    stats = rows.where("k < 15").groupBy("k").agg(F.count(F.lit(1)).alias("size"), F.max("id").alias("top"))
    assert skew.join_by_heat(rows, stats, ["k"], "size").count() == rows.where("k < 15").count()
    left = skew.join_by_heat(rows, stats, ["k"], "size", "left").collect()
    assert len(left) == 200 and all((r["top"] is None) == (r["k"] >= 15) for r in left)


# Prefix trie


def trie_by_hand(members):
    """Nodes of {conv_id: [(role, text), ...]}."""
    nodes = {}
    for conv, turns in members.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(conv)
    out = []
    for node, convs in nodes.items():
        below = [n for n in nodes if n[: len(node)] == node]
        inner = {n[:-1] for n in nodes if n}
        ends = ",".join(str(c) for c in sorted(convs) if len(members[c]) == len(node))
        out.append(
            (
                min(convs),
                len(node),
                min(nodes[node[:-1]]) if node else None,
                len(convs),
                sum(n[:-1] == node for n in nodes if n),
                sum(n not in inner for n in below),
                sum((len(nodes[n]) - 1) * len(n[-1][1].encode()) for n in below if n),
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(out, key=str)


def chats(seed, n):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(-n // 3, n):
        for turn in range(int(rng.integers(0, 14))):
            text = None if rng.random() < 0.05 else "é" * int(rng.integers(0, 2 if turn < 5 else 3))
            rows.append((c, None if turn == 0 and rng.random() < 0.2 else turn, ["user", "assistant", None][int(turn % 2 + (rng.random() < 0.05))], text))
    return rows


def ordered(rows):
    found = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "")):
        found.setdefault(c, []).append((role or "", text or ""))
    return found


@pytest.mark.parametrize("run,chunk", [(1024, 8192), (2, 3)])
def test_trie_against_brute_force(spark, monkeypatch, run, chunk):
    """With small runs and chunks, long conversations and hot nodes are put together from parts."""
    monkeypatch.setattr(prefix_trie, "RUN", run)
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    rows = chats(2, 60)
    rows += [(500 + i, t, "user", f"same {t}") for i in range(9) for t in range(40 + i % 2)]
    rows += [(None, 0, "user", "no conversation"), (900, 3, "user", "twice"), (900, 3, "user", "twice"), (901, 0, "system", "long " * 200_000)]
    got = prefix_trie.prefix_trie(talk(spark, rows).repartition(6)).collect()
    assert sorted((tuple(r) for r in got), key=str) == trie_by_hand(ordered(rows))


def test_rebuilt_trie_against_brute_force(spark):
    # Without the conversation it begins like, one whose turns are all taken away has none.
    gone = next(c for c in range(1001, 1100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [*chats(3, 70), (gone, 0, "user", "x")]
    own = ordered(rows)
    members = {}
    for c in own:
        head = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        members[c] = own.get(base, [])[:head] + own[c][head:]
    turns, sizes = queries.rebuilt(*prefix_trie.number_turns(talk(spark, rows)))
    got = prefix_trie.build_trie(turns, sizes).collect()
    assert any(not m for m in members.values())
    assert sorted((tuple(r) for r in got), key=str) == trie_by_hand(members)


def test_trie_of_nothing(spark):
    assert not prefix_trie.prefix_trie(talk(spark, [])).collect()
    assert not prefix_trie.prefix_trie(talk(spark, [(None, 0, "user", "x")])).collect()


# Structure repair


def cheapest(rows):
    """(cost, audit, lines) over every way to edit rows of (role, text, fault)."""
    gaps = ["", "u", "a", "ua", "au"]
    best = None
    for how in itertools.product(*[["D"] if f in ("blank", "duplicate") else ["K", "u", "a", "D"] for _, _, f in rows]):
        for put in itertools.product(gaps, repeat=len(rows) + 1):
            cost, audit, lines = 0, "", []
            for (role, text, fault), act, before in zip([*rows, (None, None, None)], [*how, ""], put):
                for initial in before:
                    cost, audit = cost + 2, audit + "I"
                    lines.append(repair.MADE_ROLES[initial] + ":")
                if act:
                    cost += {"K": 0, "D": 3}.get(act, 2) + (fault == "truncated" and act != "D")
                    audit += act if act in "KD" else "R"
                    if act != "D":
                        lines.append((role if act == "K" else repair.MADE_ROLES[act]) + ":" + text)
            # An empty role has no initial and fits no order.
            if re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, lines)
    return best


def test_repair_against_every_edit():
    rng = np.random.default_rng(4)
    machine = repair.Automaton()
    for _ in range(60):
        rows = [
            (str(rng.choice(["user", "assistant", "system", "tool", ""])), f"t{i}", [None, None, "truncated", "blank", "duplicate"][rng.integers(5)])
            for i in range(int(rng.integers(0, 4)))
        ]
        one = repair.Repair(machine, repair.Costs())
        edits = [e for r in rows for e in one.row(*r)]
        cost, rest = one.end()
        edits += rest
        lines = [f"{role}:{text}" for edit, role, text, _ in edits if edit != "D"]
        assert (cost, "".join(e[0] for e in edits), lines) == cheapest(rows)


def test_repair_lets_go_of_what_is_decided():
    rng = np.random.default_rng(5)
    rows = [(str(rng.choice(["user", "assistant", "system"])), str(i), [None, None, None, "truncated", "blank"][rng.integers(5)]) for i in range(5000)]
    results = []
    for every in (64, 1, 10**9):
        one = repair.Repair(repair.Automaton(), repair.Costs())
        one.EVERY = one.look_at = every
        edits, most = [], 0
        for r in rows:
            edits += one.row(*r)
            most = max(most, len(one.held))
        cost, rest = one.end()
        results.append((cost, edits + rest))
        assert every > 5000 or most < 600
    assert results[0] == results[1] == results[2]
    assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for edit, role, _, _ in results[0][1] if edit != "D"))


def test_repair_odd_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 2, "assistant", "Yes!"), (1, 2, "assistant", "Yes!"), (1, 5, "user", "and so")]
    rows += [(2, None, None, None), (2, 1, "", "x."), (3, None, "user", "Only?"), (None, 0, "assistant", "Ok."), (4, 0, "system", "Be brief.")]
    rows += [(5, 0, "user", "word " * 200_000), (5, 1, "assistant", "End.\n")]
    got = {r["conv_id"]: r for r in repair.summarise(repair.repair_conversations(talk(spark, rows))).collect()}
    assert len(got) == 6
    one = got[1]
    assert (one["gaps"], one["blank"], one["duplicate"], one["truncated"], one["illegal"]) == (3, 0, 1, 1, 1)
    assert (one["cost"], one["audit"]) == (6, "KKDD")
    assert one["repaired_sha256"] == hashlib.sha256(b"user:Hi.\nassistant:Yes!").hexdigest()
    assert (got[2]["audit"], got[2]["cost"], got[2]["blank"], got[2]["gaps"], got[2]["illegal"]) == ("DD", 6, 1, 0, 1)
    assert (got[3]["audit"], got[3]["gaps"]) == ("KI", 0) and got[3]["repaired_sha256"] == hashlib.sha256(b"user:Only?\nassistant:").hexdigest()
    assert (got[None]["audit"], got[None]["cost"]) == ("IK", 2)
    assert (got[4]["audit"], got[4]["cost"]) == ("D", 3)
    assert (got[5]["audit"], got[5]["cost"], got[5]["truncated"]) == ("KK", 1, 1)
    assert not repair.repair_conversations(talk(spark, [])).collect()


def test_repaired_rows_join_to_the_digest(spark):
    rows = [(1, 0, "tool", "a."), (1, 1, "user", "b."), (1, 2, "user", "c."), (1, 3, "assistant", "d.")]
    edits = repair.repair_conversations(talk(spark, rows)).orderBy("part").collect()
    lines = [f"{r['role']}:{r['text']}" for r in edits if r["edit"] and r["edit"] != "D"]
    done = repair.summarise(repair.repair_conversations(talk(spark, rows))).first()
    assert done["audit"] == "".join(r["edit"] or "" for r in edits)
    assert done["repaired_sha256"] == hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_dropped_conversations_are_listed(spark, tmp_path):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hi."), (gone, 0, "user", "Hi."), (5000, 0, "user", None)]
    talk(spark, rows).select("conv_id", "turn", "role", "text").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r.asDict() for r in queries.op13_repair_structure(spark, str(tmp_path)).collect()}
    assert set(got) == {gone, 5000}
    assert got[gone] == {"conv_id": gone, **dict.fromkeys(["gaps", "blank", "duplicate", "truncated", "illegal", "cost"], 0), "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
