"""Pairs, rows and terms that a shorter job would leave out."""

import math
import random

import numpy as np
from conftest_llm import near_groups

import corpus_pipeline
from docutally.llm import minhash, packing


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(f"word{rng.randrange(900)}" for _ in range(n))


def edited(words, *places):
    return " ".join("new" + str(p) if p in places else w for p, w in enumerate(words))


def kept_rows(llm, rows):
    docs = llm.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(map(tuple, corpus_pipeline.drop_near_duplicates(llm, docs, "").collect()), key=repr)


def test_stage_drops_pairs_from_080_on(llm):
    words = prose(11, 160).split()
    rows = [(1, " ".join(words)), (2, edited(words, 20, 60, 100)), (3, edited(words, 20, 50, 80, 110))]  # 141 / 171 and 136 / 176 with the first
    assert near_groups(rows, 80) != near_groups(rows, 85)
    kept = [g[0] for g in near_groups(rows, 80) if g[3]]
    assert kept_rows(llm, rows) == [r for r in rows if r[0] in kept]


def test_bands_follow_from_the_threshold():
    assert minhash.bands_for(85) == 16 and minhash.bands_for(80) == 22


def test_stage_keeps_one_of_repeated_rows_and_rows_that_share_an_id(llm):
    twice, shared, other = prose(21, 120), prose(22, 120), prose(23, 120)
    rows = [(5, twice), (5, twice), (7, shared), (9, shared), (9, other), (None, twice), (None, "alone " + prose(24, 30)), (11, ""), (12, None)]
    kept = kept_rows(llm, rows)
    assert kept == sorted([(5, twice), (7, shared), (9, other), rows[6], (11, ""), (12, None)], key=repr)
    docs = llm.createDataFrame([(i, t, 0) for i, t in kept], "doc_id long, text string, n_chars long")
    assert {(r["doc_id"], r["text"]) for r in corpus_pipeline.cut_repeats(llm, docs, "").collect()} >= {(5, twice), (9, other)}


def test_neighbours_by_all_terms():
    rare, common = list(range(12)), list(range(20, 60))
    terms = [np.array(t, np.uint32) for t in ([*rare, *common], rare, common, common, [70])]
    counts, lengths = [np.ones(len(t), np.uint8) for t in terms], np.array([52, 12, 40, 40, 1])
    assert packing.Index(terms, counts, lengths).neighbours(0).tolist() == [0, 2, 3, 1]
    # In the whole corpus the others' terms are common ones.
    df = np.full(71, 2)
    df[20:60] = 900
    assert packing.Index(terms, counts, lengths, packing.Corpus(1000, 30.0, df)).neighbours(0).tolist() == [1, 0, 2, 3]


def test_scores_from_rows_and_postings_agree():
    rng = np.random.default_rng(2)
    terms = [np.unique(rng.zipf(1.3, 60).clip(0, 400)).astype(np.uint32) for _ in range(200)]
    counts, lengths = [np.ones(len(t), np.uint8) for t in terms], np.array([len(t) for t in terms])
    index = packing.Index(terms, counts, lengths)
    assert 0 < len(index.rows) < len(index.terms)
    df = np.bincount(np.concatenate(terms))
    for seed in (0, 50, 199):
        score = np.zeros(200)
        for i, t in enumerate(terms):
            both = np.intersect1d(t, terms[seed])
            score[i] = sum(np.log(1 + (200.5 - df[x]) / (df[x] + 0.5)) for x in both) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * lengths[i] / lengths.mean()))
        got = index.neighbours(seed)
        assert set(got) == set(np.flatnonzero(score)) and np.all(np.diff(score[got]) <= 1e-9)


def test_signature_check_loses_next_to_nothing():
    for percent in (80, 85):
        n, p = minhash.bands_for(percent) * minhash.ROWS, percent / 100
        lost = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n) if i / n < p - minhash.MARGIN)
        assert lost < 1e-6
