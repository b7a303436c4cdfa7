"""How much is compared to find similar texts: groups of copies, long texts that are nearly similar, sets in parts."""

import random

import pytest
from test_llm_operators import documents, first_of_each, fresh

from intervale.llm import simhash


def kept_and_confirmed(spark, rows, monkeypatch):
    """The ids that stay, and (pairs, sets) of each time that pairs were compared on whole sets."""
    seen, plain = [], simhash.confirmed

    def counted(pairs, sets, share):
        seen.append((pairs.count(), sets.count()))
        return plain(pairs, sets, share)

    monkeypatch.setattr(simhash, "confirmed", counted)
    kept = {r.doc_id for r in simhash.without_similar(documents(spark, rows)).collect()}
    return kept, seen


def changed(rng, words, times):
    out = list(words)
    for _ in range(times):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**9)}"
    return " ".join(out)


def test_copies_with_changes_meet_in_the_least_changed(spark, monkeypatch):
    """Of 240 copies any two of few changes are similar; as pairs they would be thousands."""
    rng = random.Random(41)
    base = fresh(rng, 150)
    rows = [(k, changed(rng, base, k % 7)) for k in range(240)]
    kept, seen = kept_and_confirmed(spark, rows, monkeypatch)
    assert kept == first_of_each(rows)
    assert sum(pairs for pairs, _ in seen) < 4 * len(rows)


def test_long_texts_below_the_similarity_need_no_sets(spark, monkeypatch):
    rng = random.Random(42)
    shared = fresh(rng, 2600)
    rows = [(k, " ".join(shared + fresh(rng, 400))) for k in range(12)]  # 0.76 of each other
    rows.append((100, " ".join(shared + rows[0][1].split()[2600:2900] + fresh(rng, 100))))
    kept, seen = kept_and_confirmed(spark, rows, monkeypatch)
    assert kept == set(range(12))
    assert sum(pairs for pairs, _ in seen) <= 3


@pytest.mark.parametrize("at_once", [1, 1 << 26])
def test_sets_in_parts(spark, monkeypatch, at_once):
    """Beyond a share of all sets pairs are compared in parts; a text's copies give its set once."""
    rng = random.Random(43)
    rows = []
    for k in range(30):
        words = fresh(rng, 100)
        rows += [(10 * k + c, changed(rng, words, c % 3)) for c in range(5)]
    rows += [(1000 + k, rows[0][1].upper()) for k in range(200)]
    monkeypatch.setattr(simhash, "SET_BYTES_AT_ONCE", at_once)
    kept, seen = kept_and_confirmed(spark, rows, monkeypatch)
    assert kept == first_of_each(rows)
    assert max(sets for _, sets in seen) <= 150
    assert (len(seen) > 3) == (at_once == 1)
