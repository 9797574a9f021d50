"""Large groups of near copies, most of them not linked with each other."""

import random

from conftest_llm import near_groups
from test_texts import sorted_rows

from docutally.llm import minhash


def group(n, edits):
    """Copies of one text, each with a few words of its own; every tenth differs from the one before by one word."""
    rng = random.Random(7)
    base, rows = [f"w{rng.randrange(10**6)}" for _ in range(120)], []
    for i in range(n):
        words = list(rows[-1][1].split()) if i % 10 == 9 else list(base)
        for _ in range(1 if i % 10 == 9 else edits):
            words[rng.randrange(120)] = f"v{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    return rows


def test_few_pairs_of_a_large_group_are_compared(llm, monkeypatch):
    rows, counts, agreement = group(240, 4), [], minhash._agreement

    def counted(pairs, sigs, least):
        counts.append(pairs.count())
        return agreement(pairs, sigs, least)

    monkeypatch.setattr(minhash, "_agreement", counted)
    frame = llm.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted_rows(minhash.near_duplicates(frame, percent=85, pairs_per_member=4, rest_per_entry=0)) == near_groups(rows)
    # The first count is of one comparison per bucket; all pairs would be 28,680.
    assert sum(counts[1:]) < 2400
