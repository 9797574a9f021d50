"""What the operators that remove repeated text leave on disk, and how they pass texts on."""

import os

from conftest import frame, prose
from pyspark.sql import functions as F

from docutally.llm import hashing, substrings, suffixtree
from docutally.llm.common import CLEANED, discard, written
from docutally.session import shared_dir


def test_only_ranges_stay_on_disk(llm, docs):
    for remove in (substrings.remove_repeats, suffixtree.remove_passages):
        folder = shared_dir(llm).removeprefix("file:")
        before = set(os.listdir(folder))
        remove(docs).collect()
        assert {name.split("-")[0] for name in set(os.listdir(folder)) - before} == {"ranges"}


def test_written_keeps_the_setting_of_the_session(llm):
    rows = written(llm.range(50).groupBy((F.col("id") % 7).alias("k")).count(), "rows")
    assert rows.count() == 7 and llm.conf.get(CLEANED, None) is None
    discard(rows)


def test_texts_of_a_batch_are_read_together(llm, monkeypatch):
    passage = prose(5, 80)
    own = frame(llm, [(i, f"{prose(1000 + i, 20)} {passage} {prose(2000 + i, 20)}") for i in range(300)])
    made, plain = llm.sparkContext.accumulator(0), type(own).mapInArrow

    def counted(self, func, schema, *more):
        def run(batches):
            for batch in func(batches):
                made.add(1)
                yield batch

        return plain(self, run, schema, *more)

    monkeypatch.setattr(type(own), "mapInArrow", counted)
    for remove in (substrings.remove_repeats, suffixtree.remove_passages):
        start = made.value
        assert remove(own).filter("n_removed > 0").count() >= 299
        assert made.value - start < 150


def test_runs_end_with_their_text():
    import numpy as np

    assert hashing.covered(np.array([0, 3]), np.array([3, 4]), 6).tolist() == [True] * 4 + [False] * 2
    values = np.random.default_rng(3).integers(0, 1 << 63, 500, dtype=np.uint64)
    values[40:60] = values[40]
    for width in (1, 7, 10, 337, 500, 501):
        assert hashing.window_minima(values, width).tolist() == [i + int(np.argmin(values[i : i + width])) for i in range(501 - width)]
