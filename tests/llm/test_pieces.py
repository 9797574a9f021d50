"""Pieces of packed documents: their ids, their sequences' numbers."""

import zlib
from collections import Counter, defaultdict

import numpy as np

from docutally.llm import packing


def test_every_piece_has_the_checksum_of_its_ids(docs, rows):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    backend = Tokenizer.from_file(path("byte_bpe_50k.json"))
    ids = defaultdict(list)
    for i, t in rows:
        ids[i].append(np.array([*backend.encode(t or "", add_special_tokens=False).ids, packing.END], "<u4"))
    got = packing.pack(docs, window=256, cut=16, shard=8).collect()
    assert sum(r["start"] % 256 != 0 for r in got) > 5
    for r in got:
        assert any(zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] and len(own) == r["doc_tokens"] for own in ids[r["doc_id"]])
    filled = defaultdict(list)
    for r in got:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in filled.values():
        pieces.sort()
        assert [p[0] for p in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))] and sum(n for _, n in pieces) <= 256


def test_groups_are_numbered_without_gaps(llm):
    sizes = [(b, 1 + b % 3) for b in range(0, 60, 2)] + [(70, 100_000)]
    got = packing.numbered(llm.createDataFrame(sizes, "bucket int, parts long"), span=7).orderBy("bucket").collect()
    at = 0
    for r, (bucket, parts) in zip(got, sizes):
        assert (r["bucket"], r["parts"], r["first"]) == (bucket, parts, at)
        at += parts


def test_repeated_rows_and_empty_texts_spread_over_groups(llm):
    copies = [(1, "one text that is repeated", "x")] * 300 + [(i, None, "x") for i in range(300)] + [(None, "", "x")] * 50
    got = packing.pack(llm.createDataFrame(copies, "doc_id long, text string, bucket string"), window=64, cut=8, shard=16).collect()
    assert len({r["sequence_id"] >> 23 for r in got}) > 20
    used = Counter()
    for r in got:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 64 and sum(used.values()) == sum(r["length"] for r in got)
    assert sum(r["length"] for r in got if r["doc_id"] is None) == 50


def test_terms_are_counted_in_full(llm):
    frame = llm.createDataFrame([(1, " word" * 900)], "doc_id long, text string")
    row = packing.tails(frame).first()
    assert max(np.frombuffer(row["counts"], "<u4")) >= 890
