"""Operators on document texts against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_llm import covered, found_secrets, near_groups
from pyspark.sql import functions as F

from docutally.llm import edits, minhash, packing, secrets, sentencepieces, substrings, suffixtree, toxicity

LAST = 1 << 63


def sorted_rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


# --- suffix-array dedup --------------------------------------------------------------
def cut_bytes(rows, length):
    out = []
    for i, b, gone in covered(rows, length):
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("length", "gram", "block"), [(400, 64, 64), (60, 16, 8)])
def test_repeated_strings(docs, rows, length, gram, block):
    assert sorted_rows(substrings.remove_repeats(docs, length, gram=gram, block=block)) == cut_bytes(rows, length)


# --- suffix trees --------------------------------------------------------------------
def cut_words(rows, length):
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in sorted(texts, key=lambda r: LAST if r[0] is None else r[0]):
        for p in range(len(w) - length + 1):
            first.setdefault(tuple(w[p : p + length]), LAST if i is None else i)
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for p in range(len(w) - length + 1):
            if first[tuple(w[p : p + length])] < (LAST if i is None else i):
                gone[p : p + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("length", "prefix", "block"), [(13, 4, 5), (6, 2, 3)])
def test_repeated_passages(docs, rows, length, prefix, block):
    assert sorted_rows(suffixtree.remove_passages(docs, length, prefix=prefix, block=block)) == cut_words(rows, length)


# --- near-duplicates -----------------------------------------------------------------
@pytest.mark.parametrize(("each", "rest"), [(64, 2), (0, 0)])
def test_near_duplicates(docs, rows, each, rest):
    assert sorted_rows(minhash.near_duplicates(docs, pairs_per_member=each, rest_per_entry=rest)) == near_groups(rows)


# --- secrets -------------------------------------------------------------------------
def test_secrets(llm, docs, rows):
    tricky = [(1, "ä😀 api_key=\"abcdef\" secret=token :abcdefgh"), (2, "TOKEN==abc12 apikey:x passwd = abcdefg"), (3, "AKIAAKIA" + "B" * 13 + " AKIA"), (4, "f" * 23 + "g" + "0" * 24), (5, None)]
    for own in (docs, llm.createDataFrame(tricky, "doc_id long, text string")):
        got = secrets.find_secrets(own).select("text", secrets.listed(F.col("spans"))).collect()
        assert len(got) == own.count()
        for text, spans in got:
            assert spans == ",".join(f"{k}:{s}:{e}" for s, _, k, e in found_secrets(text or ""))


def test_redacted(llm):
    own = llm.createDataFrame([(1, "a token=abcdef0123456789abcdef012345 z"), (2, "plain"), (3, None)], "doc_id long, text string")
    got = secrets.find_secrets(own).select("doc_id", secrets.redacted(F.col("text"), F.col("spans")).alias("text")).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == ["a [SECRET] z", "plain", None]


def test_trigram_queries():
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == [["aki", "kia"]]
    assert secrets.trigram_query("[0-9a-f]+") is None
    assert secrets.trigram_query("ab(cd|xy)?z+") is None
    assert secrets.trigram_query("abc(def|xyz)") == [["abc", "bcd", "cde", "def"], ["abc", "bcx", "cxy", "xyz"]]


# --- packing -------------------------------------------------------------------------
def test_packing(docs, rows):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    backend = Tokenizer.from_file(path("byte_bpe_50k.json"))
    whole = Counter()
    for i, t in rows:
        ids = np.array([*backend.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        whole[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    got = packing.pack(docs).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"], r["doc_tokens"]].append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= packing.WINDOW
    for (i, n), parts in pieces.items():
        copies = sum(c for (j, m, _), c in whole.items() if (j, m) == (i, n))
        assert sum(p["length"] for p in parts) == n * copies
    assert len(pieces) == len({k[:2] for k in whole})
    one = [r for r in got if r["start"] == 0 and r["length"] == r["doc_tokens"]]
    assert one and all((r["doc_id"], r["doc_tokens"], r["ids_crc32"]) in whole for r in one)
    used = sum(r["length"] for r in got)
    assert used == sum(k[1] * c for k, c in whole.items())


def test_windows_fill_and_cut_once():
    lengths = np.array([2000, 1500, 900, 300, 64, 30, 7, 0])
    windows = packing.fill(lengths, lambda seed: np.arange(len(lengths)), 2048, 128)
    held = Counter()
    for window in windows:
        size = [((lengths[t] if b < 0 else b * 128) - a * 128) for t, a, b in window]
        assert sum(size) <= 2048 and min(size) > 0
        for (t, _, _), n in zip(window, size):
            held[t] += n
    assert all(held[t] == n for t, n in enumerate(lengths) if n)


def test_neighbours_share_rare_terms():
    terms = [np.array(t, np.uint32) for t in ([1, 2, 9], [1, 3], [2, 9, 4], [1, 5])]
    index = packing.Index(terms, [np.ones(len(t), np.uint8) for t in terms], np.array([3, 2, 3, 2]))
    assert index.neighbours(0)[1] == 2


# --- edit-aware counts ---------------------------------------------------------------
def test_edits_count_like_a_new_document(llm, rows):
    ids = packing.encoder()
    own = [(i, t, [(5, 3, " and, x"), (0, 1, ""), (10**6, 4, "end."), (max(0, len(t or "") // 2), 9, None), (-3, -1, "  ")]) for i, t in rows]
    frame = llm.createDataFrame(own, "doc_id long, text string, edits array<struct<position: int, removed: int, inserted: string>>")
    got = sorted_rows(edits.count_edits(frame).select("doc_id", "tokens_before", "tokens_after", "chars_after"))
    want = []
    for i, t, steps in own:
        now = t or ""
        for position, removed, inserted in steps:
            position = min(max(position, 0), len(now))
            removed = min(max(removed, 0), len(now) - position)
            now = now[:position] + (inserted or "") + now[position + removed :]
        want.append((i, len(ids(t or "")), len(ids(now)), len(now)))
    assert got == sorted(want, key=repr)


def test_edits_encode_little(llm):
    text = "some quiet words about rivers and stones " * 4000
    tree = edits.CountTree(text, lambda t: len(t.split()))
    tree.edit(80_000, 5, "abc")
    assert tree.encoded < 6 * edits.LEAF and tree.chars[1] == len(text) - 2


# --- sentencepiece -------------------------------------------------------------------
def test_sentencepiece_ids_equal_the_library(docs, rows):
    import public_tokenizers
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = sentencepieces.encode(docs, with_ids=True).collect()
    assert sorted((str(r["doc_id"]), r["ids"]) for r in got) == sorted((str(i), own.encode(t or "")) for i, t in rows)
    assert all(r["round_trip"] and r["differences"] == 0 for r in got)


def test_byte_fallback_and_spaces_round_trip():
    texts = ["", " a  b ", "\U0001f9ff͸ x", "▁ mark", "a\nb\tc"]
    for (ids, whole, differences, back), text in zip(sentencepieces.encode_texts(texts, "piece_bpe_32k.model"), texts):
        assert differences == 0 and back == whole[1:].replace("▁", " ")
        assert sentencepieces.decode_ids([ids.tolist()], "piece_bpe_32k.model") == [back]


# --- toxicity ------------------------------------------------------------------------
def test_toxicity_on_held_out_rows(llm):
    words = "calm river stone garden window letter bread music paper winter".split()
    rude = ["vexmo", "grolbin", "snaddle"]
    texts, labels = [], []
    for i in range(600):
        own = [words[(i * k) % 10] + str((i * k) % 37) for k in range(1, 30)]
        toxic = i % 7 == 0
        texts.append((i, " ".join([*own, rude[i % 3] + "xyz"[i % 3] * (i % 2)] if toxic else own)))
        labels.append((i, 0, int(toxic)))
    texts += [(9001, None), (9002, ""), (None, "calm")]
    docs = llm.createDataFrame(texts, "doc_id long, text string")
    marks = llm.createDataFrame([*labels, (5, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.scores(docs, marks).collect()
    assert len(got) == len(texts) and all(0 <= r["score"] <= 1 for r in got)
    toxic = {i for i, _, t in labels if t}
    held = [r for r in got if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all((r["score"] >= toxicity.THRESHOLD) == (r["doc_id"] in toxic) for r in held if r["doc_id"] < 600)
    none = toxicity.scores(docs, marks.withColumn("toxic", F.lit(0))).collect()
    assert all(r["score"] < 0.01 for r in none)


# --- empty tables --------------------------------------------------------------------
def test_empty_tables(llm, empty):
    labels = llm.createDataFrame([], "doc_id long, quality int, toxic int")
    frames = [
        substrings.remove_repeats(empty), suffixtree.remove_passages(empty), minhash.near_duplicates(empty), secrets.find_secrets(empty), packing.pack(empty),
        sentencepieces.encode(empty), toxicity.scores(empty, labels), edits.count_edits(empty.withColumn("edits", F.lit(None).cast("array<struct<position: int, removed: int, inserted: string>>"))),
    ]
    for frame in frames:
        assert frame.columns and frame.count() == 0
