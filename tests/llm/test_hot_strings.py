"""A passage that very many documents hold, in the operator that removes repeated strings."""

from conftest import frame, prose
from test_texts import cut_bytes, sorted_rows

from docutally.llm import substrings

#: Few bytes count as a skewed partition already, as the check's hot table has it.
SKEWED = {
    "spark.sql.shuffle.partitions": "23",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
}


def test_starts_of_a_frequent_passage_are_split(llm, monkeypatch):
    passage = prose(5, 80)
    rows = [(i, f"{prose(1000 + i, 20)} {passage} {prose(2000 + i, 20)}") for i in range(200)]
    plans, plain = {}, substrings.written

    def run(rows, name):
        if name == "ranges":
            rows.collect()
            plans[name] = rows._jdf.queryExecution().executedPlan().toString()
        return plain(rows, name)

    monkeypatch.setattr(substrings, "written", run)
    before = {k: llm.conf.get(k, None) for k in SKEWED}
    try:
        for k, v in SKEWED.items():
            llm.conf.set(k, v)
        got = sorted_rows(substrings.remove_repeats(frame(llm, rows)))
    finally:
        for k, v in before.items():
            llm.conf.unset(k) if v is None else llm.conf.set(k, v)
    assert got == cut_bytes(rows, 400)
    assert "SortMergeJoin(skew=true) [left" in plans["ranges"]
