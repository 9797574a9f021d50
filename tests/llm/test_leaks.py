"""Benchmark windows in documents against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docutally.llm import leaks

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, length):
    grams = {}
    for i, t in items:
        w = split(t)
        n = min(len(w), length)
        for p in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[p : p + n]), set()).add(i)
    out = []
    for i, t in docs:
        w = split(t)
        hit, ids = [False] * len(w), set()
        for n in {len(g) for g in grams}:
            for p in range(len(w) - n + 1):
                if (own := grams.get(tuple(w[p : p + n]))) is not None:
                    hit[p : p + n] = [True] * n
                    ids |= own
        spans = [(p, next((q for q in range(p, len(w)) if not hit[q]), len(w))) for p in range(len(w)) if hit[p] and (p == 0 or not hit[p - 1])]
        out.append((i, len(w), spans, sorted(str(x) for x in ids if x is not None)))
    return out


def tables():
    rng = random.Random(4)
    pick = lambda n: [rng.choice("amber Basalt cedar9 été 中文 delta ember fjord".split()) for _ in range(n)]
    items = [(i, " ".join(pick(rng.choice([0, 1, 2, 3, 4, 6, 12])))) for i in range(100, 112)]
    items += [(200, None), (201, ""), (202, "-- !"), (203, "Lone"), (None, "nobody owns this"), (100, "again the same id"), (9, "again the same id")]
    docs = [(i, rng.choice([" ", ", ", "\n-"]).join(pick(rng.randrange(0, 60)))) for i in range(60)]
    docs += [(70, "LONE"), (71, "x lone_lone"), (72, None), (73, ""), (74, "..."), (None, "we say NOBODY owns, this!"), (75, "it is again the SAME id, again the same id."), (75, "it is again the SAME id, again the same id."), (75, "other"), (76, "\0lone\0\x7fÉté")]
    docs += [(80, " ".join(["again the same id"] * 300))]
    return docs, items


@pytest.mark.parametrize(("length", "part_words", "block_bytes"), [(10, 2048, 1 << 26), (4, 3, 1 << 26), (4, 5, 2000), (3, 1, 700)])
def test_found(llm, length, part_words, block_bytes):
    docs, items = tables()
    frame = llm.createDataFrame([(i, t, 1, "k", [1]) for i, t in docs], "doc_id long, text string, _row int, items string, n array<int>").repartition(3)
    bench = llm.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, gram int")
    got = leaks.find_leaks(frame, bench, length, part_words=part_words, block_bytes=block_bytes, keep=["_row", "n"])
    assert got.columns == ["doc_id", "_row", "n", "n_words", "spans", "items"]
    rows = [(r["doc_id"], r["n_words"], [tuple(s) for s in r["spans"]], r["items"]) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted(brute(docs, items, length), key=repr)
    assert any(s for _, _, s, _ in rows)


def test_removed(llm):
    docs, items = tables()
    frame = llm.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, _whole0 int").repartition(3)
    bench = llm.createDataFrame(items, "item_id long, text string")
    want, clean = [], []
    for (i, t), (_, _, spans, _) in zip(docs, brute(docs, items, 4)):
        at = [m.span() for m in re.finditer(leaks.ANY_CASE_WORD, t or "")]
        cut = t
        for a, b in reversed(spans):
            cut = cut[: at[a][0]] + cut[at[b - 1][1] :]
        want.append((i, cut, 1))
        clean += [] if spans else [(i, t, 1)]
    assert sorted(map(tuple, leaks.remove_leaks(frame, bench, length=4).collect()), key=repr) == sorted(want, key=repr)
    left = leaks.remove_leaks(frame, bench, drop_documents=True, length=4)
    assert left.columns == frame.columns and sorted(map(tuple, left.collect()), key=repr) == sorted(clean, key=repr)


def test_no_python_on_the_main_path(llm, docs):
    bench = llm.createDataFrame([(1, "a few words of an item")], "item_id long, text string")
    plan = leaks.find_leaks(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty(llm, docs, empty):
    bench = llm.createDataFrame([], "item_id long, text string")
    assert leaks.find_leaks(empty, bench).count() == 0
    none = leaks.find_leaks(docs, bench)
    assert none.count() == docs.count() and none.where((F.size("spans") > 0) | (F.size("items") > 0)).count() == 0
    assert sorted(map(tuple, leaks.remove_leaks(docs, bench).collect()), key=repr) == sorted(map(tuple, docs.collect()), key=repr)
