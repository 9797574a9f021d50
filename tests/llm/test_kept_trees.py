"""Trees of token counts that are kept from one batch of edits to the next."""

import random

from pyspark.sql import functions as F

from docutally.llm import edits, packing

EDITS = "array<struct<position: int, removed: int, inserted: string>>"


def changed(text, steps):
    for position, removed, inserted in steps:
        text = text[:position] + inserted + text[position + removed :]
    return text


def test_second_batch_encodes_touched_leaves_only(llm, docs, rows):
    length = lambda t: len(packing.encoder()(t)) if t else 0
    kept = edits.trees(docs)
    now = {(i, t or ""): t or "" for i, t in rows}
    for n, step in enumerate([[(100, 4, " new words, 12")], [(30_000, 0, "x")], []]):
        frame = kept.withColumn("edits", F.lit(None).cast(EDITS) if not step else F.array(*[F.struct(F.lit(p).alias("position"), F.lit(r).alias("removed"), F.lit(t).alias("inserted")) for p, r, t in step]))
        kept = edits.written(edits.edited(frame), "kept")
        now = {k: changed(t, [(min(p, len(t)), r, x) for p, r, x in step]) for k, t in now.items()}
        got = kept.collect()
        assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted(((i, now[i, t or ""]) for i, t in rows), key=repr)
        for r in got:
            assert r["tokens_after"] == length(r["text"]) == sum(r["leaf_tokens"]) and r["chars_after"] == len(r["text"]) == sum(r["leaf_chars"])
            assert r["n_edits"] == len(step)
            if r["doc_id"] == 64:
                assert r["chars_encoded"] <= (6 * edits.LEAF if step else 0) and len(r["text"]) > 60_000
            if not step:
                assert r["chars_encoded"] == 0 and r["tokens_before"] == r["tokens_after"]


def test_texts_without_spaces():
    count = lambda t: len(packing.encoder()(t)) if t else 0
    for text in ("一二三，四五六。" * 12_000, "abc12,de;" * 11_000, "f(x)=y7;" * 12_000):
        tree = edits.CountTree(text, count)
        tree.edit(50_000, 1, "q")
        assert tree.encoded < 8 * edits.LEAF and tree.total == count(text[:50_000] + "q" + text[50_001:])


def test_leaves_split_as_they_grow():
    tree = edits.CountTree("some quiet words " * 100, lambda t: len(packing.encoder()(t)) if t else 0)
    text, at = "".join(tree.leaves), 800
    for i in range(400):
        tree.edit(at, 0, f" more {i} of it")
        text = text[:at] + f" more {i} of it" + text[at:]
    assert "".join(tree.leaves) == text and tree.total == len(packing.encoder()(text))
    assert max(map(len, tree.leaves)) < 4 * edits.LEAF and tree.encoded < 400 * 8 * edits.LEAF


def test_counts_after_many_edits_of_every_kind():
    count = lambda t: len(packing.encoder()(t)) if t else 0
    draw = random.Random(4)
    bits = ["a", "Zq", "7", "12 ", " ", "  ", "\n", "'s", "'", "<|", "endoftext", "|>", "<|endoftext|>", "ä", "漢字", "，", ".", "-", "\x1c", " it", "don't", "😀", "x" * 60]
    for round_ in range(12):
        text = "".join(draw.choices(bits, k=900))
        tree = edits.CountTree(text, count)
        for step in range(60):
            if step % 20 == 10:
                tree = edits.CountTree(text, count, tree.kept())
            position, removed = draw.randrange(len(text) + 1), draw.choice([0, 1, 2, 9, 40, 400])
            inserted = "".join(draw.choices(bits, k=draw.choice([0, 1, 3, 80])))
            tree.edit(position, removed, inserted)
            text = text[:position] + inserted + text[position + removed :]
            assert "".join(tree.leaves) == text and tree.total == count(text), (round_, step)
