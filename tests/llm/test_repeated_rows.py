"""Repeated rows and long windows in the operators that remove repeated text."""

from pyspark.sql import functions as F
from test_texts import cut_bytes, cut_words, sorted_rows

from docutally.llm import substrings, suffixtree


def texts(rows):
    base = dict(rows)[1]
    return [(1, base)] * 40 + [(2, base + " tail")] * 3 + [(None, base)] * 2


def test_ranges_do_not_grow_with_repeated_rows(llm, rows):
    frame = llm.createDataFrame(texts(rows), "doc_id long, text string").repartition(4)
    lengths = []
    for n in (1, 40):
        own = llm.createDataFrame([(1, dict(rows)[1])] * n + [(2, dict(rows)[1])], "doc_id long, text string")
        lengths.append([sorted(r["n"] for r in f.select(F.size("ranges").alias("n")).collect()) for f in (substrings.repeated_ranges(own), suffixtree.repeated_windows(own))])
    assert lengths[0] == lengths[1]
    assert sorted_rows(substrings.remove_repeats(frame)) == cut_bytes(texts(rows), 400)
    assert sorted_rows(suffixtree.remove_passages(frame)) == cut_words(texts(rows), 13)


def test_windows_of_many_words(llm, rows):
    long = dict(rows)[64].split()
    own = [(1, " ".join(long[:900])), (2, " ".join(["new", *long[100:700], "end"])), (3, " ".join(long[690:1200])), (4, " ".join(long[20:600]))]
    frame = llm.createDataFrame(own, "doc_id long, text string")
    assert sorted_rows(suffixtree.remove_passages(frame, 300)) == cut_words(own, 300)
