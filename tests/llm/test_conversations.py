"""Conversation repair against exhaustive search and a plain DP on strings."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from docutally.llm import conversations as conv

SPACE = " \t\n\x0b\x0c\r"


def faults(rows):
    """(role, text, fault) of (turn, role, text) rows in order."""
    seen, out = set(), []
    for _, role, text in rows:
        last = text.rstrip(SPACE)[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else None if last in ".!?" else "truncated"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def cheapest(rows):
    """(cost, audit, repaired lines): lists of edits in order of cost and audit, the first that gives legal roles."""
    heap = [(0, "", 0, (), "")]
    while heap:
        cost, audit, n, lines, initials = heapq.heappop(heap)
        if n == len(rows) and re.fullmatch(r"(s?(ua)+)?", initials):
            return cost, audit, list(lines)
        if not re.fullmatch(r"(s?(ua)*u?)?", initials):
            continue
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 5, audit + "I", n, (*lines, f"{role}:"), initials + role[0]))
        if n < len(rows):
            role, text, fault = rows[n]
            heapq.heappush(heap, (cost + 2, audit + "D", n + 1, lines, initials))
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault else 0
                heapq.heappush(heap, (cost + extra, audit + "K", n + 1, (*lines, f"{role}:{text}"), initials + role[:1]))
                for other in ("user", "assistant"):
                    heapq.heappush(heap, (cost + extra + 1, audit + "R", n + 1, (*lines, f"{other}:{text}"), initials + other[0]))


def by_strings(rows):
    """The same from a DP whose states carry whole strings."""
    step = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}

    def put(states, q, value):
        states[q] = min(states.get(q, value), value)

    def more(states):
        for q in (0, 1, 3):
            if q in states:
                c, a, t = states[q]
                put(states, 2, (c + 5, a + "I", (*t, "user:")))
        if 2 in states:
            c, a, t = states[2]
            put(states, 3, (c + 5, a + "I", (*t, "assistant:")))
        return states

    states = more({0: (0, "", ())})
    for role, text, fault in rows:
        after = {}
        for q, (c, a, t) in states.items():
            put(after, q, (c + 2, a + "D", t))
            if fault in ("blank", "duplicate"):
                continue
            extra = 5 if fault else 0
            to = q if not role else step.get(role[0], {}).get(q)
            if to is not None:
                put(after, to, (c + extra, a + "K", (*t, f"{role}:{text}")))
            for other in ("user", "assistant"):
                if (to := step[other[0]].get(q)) is not None:
                    put(after, to, (c + extra + 1, a + "R", (*t, f"{other}:{text}")))
        states = more(after)
    cost, audit, lines = min(states[q] for q in (0, 3) if q in states)
    return cost, audit, list(lines)


def random_rows(rng, n):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", ""]
    texts = ["Yes.", "No!", "why?", "cut off", "  ", "", "x. \t", "one more"]
    return [(t, rng.choice(roles), rng.choice(texts) + (f" {t}." if rng.random() < 0.5 else "")) for t in range(n)]


def test_searches_agree():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 5):
        for _ in range(12):
            own = faults(random_rows(rng, n))
            assert cheapest(own) == by_strings(own)


@pytest.mark.parametrize("modulus", [(1 << 61) - 1, 1, 3])
def test_edits_of_a_piece(modulus):
    rng = random.Random(2)
    for n in (1, 3, 9, 40, 120):
        for _ in range(10):
            own = faults(random_rows(rng, n))
            found = conv.best_edits([(role[:1], fault) for role, _, fault in own], conv.START, modulus)
            cost, audit = min((c, labels.translate(conv.TO_AUDIT)) for q, c, labels in found if q in conv.FINAL)
            assert (cost, audit) == by_strings(own)[:2]


@pytest.mark.parametrize("modulus", [(1 << 61) - 1, 1, 2, 7])
def test_order_of_audits_despite_collisions(modulus):
    rng = random.Random(3)
    audits, texts = conv.Audits(modulus), [""]
    for _ in range(400):
        node = rng.randrange(len(texts)) if rng.random() < 0.3 else len(texts) - 1
        letter = rng.choice("DIKR" if rng.random() < 0.2 else "K")
        assert audits.add(node, letter, letter) == len(texts)
        texts.append(texts[node] + letter)
    for _ in range(4000):
        a, b = rng.randrange(len(texts)), rng.randrange(len(texts))
        assert audits.compare(a, b) == (texts[a] > texts[b]) - (texts[a] < texts[b])
        assert audits.labels(a) == texts[a]


def table():
    rng = random.Random(5)
    rows = [(i, *r) for i in range(40) for r in random_rows(rng, rng.randrange(1, 9))]
    rows += [(500, *r) for r in random_rows(rng, 300)]  # a conversation that many partitions share
    rows += [(None, None, None, None)] * 4 + [(None, 3, "user", "So?"), (600, None, "user", "Late."), (600, None, "assistant", "early."), (600, 2, None, "hm"), (600, 2, None, "hm")]
    rows += [(700, 5, "user", "ä" * 5000), (700, 9, "assistant", "fin."), (701, -4, "user", None), (702, 1, "user", "a."), (702, 3, "assistant", "b."), (702, 3, "user", "c.")]
    return rows


def expected(rows):
    groups = {}
    for i, turn, role, text in rows:
        groups.setdefault(i, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = []
    for i, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        marked = faults(own)
        kinds = [f for _, _, f in marked]
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, lines = by_strings(marked)
        out.append((i, gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, lines))
    return out


@pytest.mark.parametrize(("piece_rows", "modulus"), [(4096, (1 << 61) - 1), (1, 5), (7, (1 << 61) - 1)])
def test_repair(llm, piece_rows, modulus):
    rows = table()
    frame = llm.createDataFrame([(*r, 0, "x") for r in rows], "conv_id long, turn long, role string, text string, at int, fault string").repartition(5)
    whole, repaired = conv.repair(frame, piece_rows=piece_rows, modulus=modulus)
    lines = {}
    for r in sorted(repaired.collect(), key=lambda r: (r["at"], r["pos"])):
        lines.setdefault(r["conv"], []).append(f"{r['role']}:{r['text']}")
        assert r["edit"] != "I" or r["text"] == ""
    got = [(r["conv"], r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], lines.get(r["conv"], [])) for r in whole.collect()]
    assert sorted(got, key=repr) == sorted(expected(rows), key=repr)
    hashes = {r["conv"]: r["repaired_sha256"] for r in conv.digests(repaired).collect()}
    assert hashes == {i: hashlib.sha256("\n".join(own).encode()).hexdigest() for i, own in lines.items()}


def test_query(llm, tmp_path):
    rows = table()
    llm.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    hurt = []
    for i, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if i is None else i}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else re.sub(r"[.!?]", "", text) if fault == 2 else text
        hurt += [] if fault == 0 else [(i, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    want = {r[0]: (*r[:8], hashlib.sha256("\n".join(r[8]).encode()).hexdigest()) for r in expected(hurt)}
    gone = hashlib.sha256(b"").hexdigest()
    got = conv.op13_conversations(llm, str(tmp_path)).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((want.get(i, (i, 0, 0, 0, 0, 0, 0, "", gone)) for i in {r[0] for r in rows}), key=repr)


def test_empty(llm):
    none = llm.createDataFrame([], "conv_id long, turn long, role string, text string")
    whole, repaired = conv.repair(none)
    assert whole.count() == 0 and repaired.count() == 0 and conv.digests(repaired).count() == 0
    assert conv.damaged(none).where(F.lit(True)).count() == 0
