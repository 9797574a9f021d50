"""Fill-in-the-middle examples against plain Python."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docutally.llm import infill


def example(i, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in infill.MARKS) or h[2] % 100 >= 90:
        return (i, len(units), "plain", None, None, None, text)
    if h[3] % 100 < 20:
        return (i, len(units), "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}")
    return (i, len(units), "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}")


def odd_texts():
    rng = random.Random(9)
    alphabet = ["a", "Z", "z", "A", "{", "[", "@", "`", "é", "ß", "中", "😀", "\0", "\x7f", "\x80", "߿", "￿", " ", "\n", "9", "<", ">", "P", "́"]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 40)))) for i in range(400)]
    rows += [(1000, "a" * 100_000), (1001, "é" * 70_001), (1002, "x <P> y"), (1003, "<S>"), (1004, "<M"), (1005, "<<S<P"), (None, "nameless words"), (None, None), (7, "again"), (7, "again")]
    return rows + [(1100 + i, c) for i, c in enumerate(alphabet)]


@pytest.mark.parametrize("batch", ["7", "512"])
def test_examples(llm, rows, batch):
    own = [*rows, *odd_texts()]
    docs = llm.createDataFrame([(i, t, "k", 1, b"x") for i, t in own], "doc_id long, text string, form string, _text int, output binary").repartition(3)
    llm.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        made = infill.rearrange(docs, keep=["form", "_text"])
        assert made.columns == ["doc_id", "_text", "n", "form", "prefix", "middle", "suffix", "output"]
        got = made.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    finally:
        llm.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    want = [(*example(i, t), t or "") for i, t in own]
    assert sorted((tuple(r.asDict()[c] for c in ("doc_id", "n", "form", "prefix", "middle", "suffix", "output", "back")) for r in got), key=repr) == sorted(want, key=repr)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_every_cut_of_sliced_columns():
    texts = [t or "" for _, t in odd_texts() if t is None or len(t) < 100]
    column = pa.array(["dropped", *texts, "dropped"]).slice(1, len(texts))
    units = infill.Units(*infill._string_bytes(column))
    for k in range(45):
        wanted = np.minimum(units.counts, k)
        parts = [re.findall(r"[A-Za-z]+|[^A-Za-z]", t) for t in texts]
        assert units.cut(wanted).tolist() == [len("".join(p[:k]).encode()) for p in parts]
        assert units.counts.tolist() == [len(p) for p in parts]


def test_empty(llm, empty):
    made = infill.rearrange(empty, keep=empty.columns)
    assert made.count() == 0 and "output" in made.columns
