"""Candidates of the Jaccard join in corpora where very many texts share a passage; codes of words in op1."""

from __future__ import annotations

import random

import numpy as np
import pytest

from loomstead.llm import jaccard, lm
from tests.llm.test_operators import SCHEMA, VOCAB, components_of, pairs, prose


def candidates_of(monkeypatch) -> list[int]:
    """How many links each call of components gets."""
    found, components = [], jaccard.components

    def counted(edges):
        found.append(edges.distinct().count())
        return components(edges)

    monkeypatch.setattr(jaccard, "components", counted)
    return found


def test_a_shared_passage_makes_no_cluster(spark, monkeypatch):
    """A chain of texts, each with a passage of the next one, and a passage that 40 others have."""
    passage = [prose(20, 7000 + i) for i in range(60)]
    rows = [(i, f"{passage[i]} {prose(260, 7100 + i)} {passage[(i + 1) % 60]}", "en", "a", 1) for i in range(60)]
    rows += [(100 + i, f"{prose(260, 7200 + i)} {passage[0]}", "en", "a", 1) for i in range(40)]
    found = candidates_of(monkeypatch)
    got = pairs(tuple(x) for x in jaccard.component_ids(spark.createDataFrame(rows, SCHEMA), 5, 4, 5).collect())
    assert got == components_of(rows, 5, 4, 5)
    assert found == [0, 0]


@pytest.mark.parametrize(("n", "num", "den"), [(3, 9, 10), (5, 4, 5)])
def test_near_copies_whose_keys_many_and_few_have(spark, n, num, den):
    """Groups of more than FEW near copies, of fewer, and of pairs, about as similar as they need be, all with passages of one another."""
    r, rows = random.Random(n), []
    passage = [prose(12, 7300 + i) for i in range(8)]
    for k, size in enumerate((45, 30, 18, 17, 16, 9, *[2] * 60)):
        base = prose(r.choice([25, 60, 150, 400]), 7400 + k).split()
        for _ in range(size):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 30))):
                w[r.randrange(len(w))] = r.choice(VOCAB)
            if r.random() < 0.4:
                w += r.choice(passage).split()[: r.randint(1, 12)]
            rows.append((len(rows), " ".join(w), "en", "a", 1))
    want = components_of(rows, n, num, den)
    assert pairs(tuple(x) for x in jaccard.component_ids(spark.createDataFrame(rows, SCHEMA), n, num, den).collect()) == want
    assert 20 < len({x[2] for x in want}) < len(rows) - 60


def test_runs_number_unknown_words_from_the_callers_head():
    """op1: a task's blocks are read with the HEAD of the session, which the task's module need not have."""
    r = np.random.default_rng(4)
    runs, h, n = lm.Runs(2, 150), r.integers(0, 1 << 63, 40).astype(np.uint64), 40
    rank = np.where(r.random(n) < 0.5, r.integers(0, 150, n), -1)
    runs.add(np.arange(1), np.zeros(1, bool), np.zeros(n, np.int64), h, rank, np.zeros(n, np.int64))
    for _, size, data in runs.blocks():
        code, *_, hashes, _ = lm._thick(size, data)
        assert code.max() < 150 + len(hashes)
