"""Every stage of the pipeline against plain Python, each on what the one before has kept."""

import re
from collections import Counter

from conftest_llm import cut_text, found_runs, near_groups
from pyspark.sql import functions as F

import corpus_pipeline
from docutally.llm import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(llm, rows, tmp_path):
    rude = [(500 + i, f"quiet words here and there {i} {i * 7} grolbin") for i in range(40)]
    mild = [(600 + i, f"quiet words here and there {i} {i * 11} meadow{i}") for i in range(160)]
    held = [*rows, *rude, *mild]
    docs = llm.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in held], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(i, 0, 1) for i, _ in rude] + [(i, 0, 0) for i, _ in mild]
    llm.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    now, out = llm.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(llm, now, str(tmp_path)).write.parquet(f"{tmp_path}/out{n}")
        now = out[name] = llm.read.parquet(f"{tmp_path}/out{n}")
        if name != "packing":
            assert now.columns == COLUMNS and now.dtypes == docs.dtypes
    texts = {name: [(r["doc_id"], r["text"]) for r in frame.collect()] for name, frame in out.items() if name != "packing"}

    bad = {i for i, _ in rude}
    assert sorted(texts["toxicity"], key=repr) == sorted([r for r in held if r[0] not in bad], key=repr)
    # Rows are told apart by their place in the order of their ids (null last), so one row of a group stays, at 80 percent.
    lined = sorted(texts["toxicity"], key=lambda r: (r[0] is None, r[0] or 0))
    groups = near_groups([(n, t) for n, (_, t) in enumerate(lined)], corpus_pipeline.SIMILAR)
    assert sorted(texts["minhash near-dedup"], key=repr) == sorted([lined[g[0]] for g in groups if g[3]], key=repr)
    assert sorted(texts["suffix-array dedup"], key=repr) == sorted(cut_text(texts["minhash near-dedup"], corpus_pipeline.REPEATED), key=repr)
    before, after = sorted(texts["suffix-array dedup"], key=repr), sorted(texts["secret scans"], key=repr)
    masked = [(i, found_runs(t)) for i, t in before]
    assert after == sorted(masked, key=repr) and any("[SECRET]" in t for _, t in after)
    pieces = Counter()
    for r in out["packing"].collect():
        pieces[r["doc_id"]] += r["length"]
    assert set(pieces) == {i for i, _ in after}
    whole = corpus_pipeline.run(llm, str(tmp_path))
    assert whole.columns == out["packing"].columns and sorted(map(tuple, whole.collect()), key=repr) == sorted(map(tuple, out["packing"].collect()), key=repr)
    assert corpus_pipeline.ORACLE_SQL is None and re.match("toxicity", corpus_pipeline.STAGES[0][0])
    assert toxicity.THRESHOLD == 0.3 and out["toxicity"].filter(F.col("doc_id").between(600, 759)).count() == len(mild)


def test_stages_carry_columns_of_any_name(llm, rows, tmp_path):
    names = ["score", "n_removed", "kept_text", "spans", "_row", "_node", "_id", "_keep", "node", "hash", "last", "id", "packed"]
    full = [(i, t, "en", "s", None if t is None else len(t), *[f"{n} of {i}" for n in names]) for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    docs = llm.createDataFrame(full, schema).repartition(3)
    llm.createDataFrame([(i, 0, 0) for i, _ in rows[:5]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(llm, docs, str(tmp_path))
        assert out.columns == docs.columns
        found = out.collect()
        assert found and all(r[n] == f"{n} of {r['doc_id']}" for r in found for n in names), name
    assert corpus_pipeline.STAGES[-1][1](llm, docs, str(tmp_path)).count() > 0
