"""Near-duplicate groups against brute force, the signature's properties, and odd rows."""

import random
import re

import numpy as np
import pytest
from corpus_tables import rows_of

from planloom.llm import minhash
from planloom.llm.minhash import distinct_documents, near_duplicates, signature
from planloom.llm.queries import QUERIES

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWERED = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_set(text, width):
    words = WORD.findall((text or "").encode().translate(LOWERED))
    size = min(width, len(words))
    return frozenset(tuple(words[n : n + size]) for n in range(len(words) - size + 1)) if words else frozenset()


def components(sets, percent=80):
    """{id: smallest linked id} for {id: [sets]}."""
    root = {key: key for key in sets}

    def find(key):
        while root[key] != key:
            key = root[key]
        return key

    keys = sorted(sets)
    for n, a in enumerate(keys):
        for b in keys[:n]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {key: find(key) for key in sets}


def check(rows, found, width):
    sets = {}
    for row in rows:
        if row[0] is not None:
            sets.setdefault(row[0], []).append(shingle_set(row[1], width))
    expected = components(sets)
    wanted = sorted(
        ((row[0], len(shingle_set(row[1], width)), expected.get(row[0]), expected.get(row[0]) == row[0]) for row in rows),
        key=repr,
    )
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in found), key=repr)
    assert got == wanted


def test_query_on_odd_rows(spark, odd_folder, odd_rows):
    check(odd_rows, rows_of(QUERIES["op1_minhash_near_dedup"](spark, odd_folder)), 2)


def test_five_words(spark, odd_folder, odd_rows):
    check(odd_rows, rows_of(near_duplicates(spark.read.parquet(f"{odd_folder}/documents.parquet"))), 5)


def test_chains_of_near_copies(spark):
    """Each text is like the next only, and many texts share a bucket without being linked."""
    rng = random.Random(4)
    text = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for number in range(60):
        rows.append((number * 7 % 60, " ".join(text)))
        for place in rng.sample(range(120), 3):
            text[place] = f"w{rng.randrange(10**6)}"
    far = [" ".join(text[:90] + [f"v{rng.randrange(10**6)}" for _ in range(30)]) for _ in range(30)]
    rows += [(100 + n, text) for n, text in enumerate(far)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    check([(a, b) for a, b in rows], rows_of(near_duplicates(frame, 2)), 2)


def test_empty_table(spark, empty_folder):
    frame = QUERIES["op1_minhash_near_dedup"](spark, empty_folder)
    assert rows_of(frame) == []
    assert frame.columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_signature_agreement_is_similarity_with_low_variance():
    rng = np.random.default_rng(2)
    agreement = []
    for _ in range(150):
        pool = rng.integers(0, 2**63, 150, dtype=np.uint64)
        agreement.append((signature(np.sort(pool[:135])) == signature(np.sort(pool[15:]))).mean())
    similarity = 120 / 150
    assert abs(np.mean(agreement) - similarity) < 0.01
    assert np.var(agreement) < similarity * (1 - similarity) / minhash.POSITIONS


@pytest.mark.parametrize("size", [1, 2, 40, 240, 241, 500, 5000])
def test_stopping_early_changes_nothing(size):
    elements = np.sort(np.random.default_rng(size).integers(0, 2**63, size, dtype=np.uint64))
    prime = np.uint64(minhash.POSITIONS)
    step = minhash.mixed(elements) % (prime - np.uint64(1)) + np.uint64(1)
    best = np.full(minhash.POSITIONS, minhash.UNSET)
    for rank in np.arange(minhash.POSITIONS, dtype=np.uint64):
        offers = (rank << minhash.RANK_SHIFT) | (minhash.mixed(elements + rank * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(8))
        np.minimum.at(best, ((elements % prime + step * rank) % prime).astype(int), offers)
    assert (signature(elements) == best).all()


def test_stage_keeps_one_row_of_each_group(spark, odd_folder, odd_rows):
    docs = spark.read.parquet(f"{odd_folder}/documents.parquet")
    kept = rows_of(distinct_documents(docs))
    assert list(kept[0]) == docs.columns
    judged = {r["doc_id"] for r in rows_of(near_duplicates(docs)) if r["kept"]}
    wanted = {(row[0], row[1]) for row in odd_rows if row[0] is None or row[0] in judged}
    got = [(row["doc_id"], row["text"]) for row in kept]
    assert len(got) == len(set(got)) and set(got) == wanted


@pytest.mark.parametrize("small", [0, 1000])
def test_leftovers_by_pairs_and_in_blocks(spark, monkeypatch, small):
    """Without rounds of common members, everything apart is compared by pairs or in blocks of a few."""
    monkeypatch.setattr(minhash, "HUB_ROUNDS", 0)
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "BLOCK", 5)
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    rows = []
    for number in range(45):
        copy = list(base)
        for place in rng.sample(range(100), rng.choice([0, 3, 6, 9, 12, 20, 30])):
            copy[place] = f"w{rng.randrange(10**6)}"
        rows.append((number, " ".join(copy)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, rows_of(near_duplicates(frame, 2)), 2)


def test_intersections_by_products():
    rng = np.random.default_rng(6)
    sides = [[np.unique(rng.integers(-3000, 3000, rng.integers(0, 900))) for _ in range(n)] for n in (7, 11)]
    wanted = [[len(np.intersect1d(a, b)) for b in sides[1]] for a in sides[0]]
    assert minhash._common(*sides).tolist() == wanted
    assert minhash._common(sides[0], []).shape == (7, 0)
    assert minhash._common([np.array([1])], [np.array([2])]).tolist() == [[0]]
