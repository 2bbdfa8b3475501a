"""Fingerprints against the definition in plain Python, and likeness against exact set similarity."""

import hashlib
import random
import re

import numpy as np
import pytest
from corpus_tables import rows_of
from test_minhash import shingle_set

from planloom.llm import fingerprints as fp
from planloom.llm.queries import QUERIES

QUERY = "op13_document_fingerprints"


def plain_bins(hashes):
    """The least value of each bin; empty bins look for a full one in their own order."""
    bits = fp.BINS.bit_length() - 1
    found = {}
    for value in hashes:
        place, rest = value >> (64 - bits), value & ((1 << (64 - bits)) - 1)
        found[place] = min(found.get(place, rest), rest)
    return [found[next(int(j) for j in [n, *fp._order[n]] if int(j) in found)] for n in range(fp.BINS)] if found else None


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", text.lower())
    _, hashes = fp.shingle_hashes([text])
    assert len(hashes) == (max(len(words) - 4, 1) if words else 0)
    bins = plain_bins(hashes.tolist())
    return "" if bins is None else "".join(f"{value % 16:x}" for value in bins)


def jaccard(a, b):
    a, b = shingle_set(a, 5), shingle_set(b, 5)
    return len(a & b) / len(a | b) if a | b else 1.0


def some_texts(seed, count):
    rng = random.Random(seed)
    return [" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.choice([0, 1, 4, 5, 6, 12, 60, 400, 3000]))) for _ in range(count)]


def test_fingerprints_by_definition(monkeypatch):
    texts = [text.encode() for text in some_texts(1, 60)] + [b"", b" \n\t ", b"One two", b"one  TWO", "é É x".encode(), b"a " * 5000]
    wanted = [plain_fingerprint(text) for text in texts]
    assert fp.fingerprints(texts) == wanted and fp.BITS == 4
    assert wanted[-6] == wanted[-5] == "" and wanted[-4] == wanted[-3] != wanted[-2]
    assert {len(f) for f in wanted} == {0, fp.BINS}
    monkeypatch.setattr(fp, "CHUNK", 100)
    monkeypatch.setattr(fp, "ROUNDS", 0)
    assert fp.fingerprints(texts) == wanted and fp.fingerprints([]) == []


def test_shingles_are_those_of_words():
    texts = [text.encode() for text in some_texts(2, 40)]
    owner, hashes = fp.shingle_hashes(texts)
    for number, text in enumerate(texts):
        assert len(set(hashes[owner == number].tolist())) == len(shingle_set(text.decode(), 5))


@pytest.mark.parametrize("share", [0.0, 0.2, 0.5, 0.8, 0.95])
@pytest.mark.parametrize("size", [30, 1000])
def test_likeness_has_no_bias(share, size):
    """The mean error over many pairs is far below that of one pair, also for texts with fewer shingles than bins."""
    rng = random.Random(size)
    errors, spread = [], []
    for _ in range(150):
        words = [f"w{rng.getrandbits(40)}" for _ in range(size)]
        keep = int(size * share)
        other = words[:keep] + [f"v{rng.getrandbits(40)}" for _ in range(size - keep)]
        a, b = " ".join(words), " ".join(other)
        estimate = fp.likeness(fp.fingerprints([a.encode()]), fp.fingerprints([b.encode()]))[0]
        errors.append(estimate - jaccard(a, b))
        spread.append(abs(errors[-1]))
    assert abs(np.mean(errors)) < 0.015 and max(spread) < (0.16 if size > 100 else 0.35)


def test_likeness_of_odd_pairs():
    some, other = fp.fingerprints([b"one two three", b"four five six"])
    assert fp.likeness(["", "", some, some, some], ["", some, "", some, other]).tolist()[:4] == [1, 0, 0, 1]
    assert fp.likeness([], []).tolist() == [] and 0 <= fp.likeness([some], [other])[0] < 0.1


def expected(rows):
    """(doc_id, n_chars, sha of the edited text) with rows by doc_id; texts that share one in any order are tried by the caller."""
    rows = [(doc_id, text or "") for doc_id, text in rows]
    result = []
    for (doc_id, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        own, new, after = (fp.fingerprints([t.encode()])[0] for t in (text, changed, following))
        result.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), own, new,
                       fp.likeness([own], [new])[0], fp.likeness([own], [after])[0]))
    return result


def in_order(spark, rows):
    """Rows by doc_id, null first, then by the hash that Spark gives their texts."""
    frame = spark.createDataFrame(list(enumerate(text or "" for _, text in rows)), "n long, text string")
    hashes = {row.n: row.h for row in frame.selectExpr("n", "xxhash64(text) as h").collect()}
    order = sorted(range(len(rows)), key=lambda n: (rows[n][0] is not None, rows[n][0] or 0, hashes[n]))
    return [rows[n] for n in order]


def as_rows(frame):
    return sorted((tuple(row.values())[:7] for row in rows_of(frame)), key=repr)


@pytest.mark.parametrize("piece_bytes", [1 << 24, 2000, 1])
def test_query_on_odd_rows(spark, odd_folder, odd_rows, monkeypatch, piece_bytes):
    monkeypatch.setattr(fp, "PIECE_BYTES", piece_bytes)
    rows = in_order(spark, [(row[0], row[1]) for row in odd_rows])
    assert as_rows(QUERIES[QUERY](spark, odd_folder)) == sorted(expected(rows), key=repr)


def test_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(fp, "PIECE_BYTES", 100)
    rows = [(7, "the same text in many rows of one id")] * 500 + [(n, f"text {n}") for n in range(20)] + [(7, "another")] * 3
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    assert as_rows(fp.edited_fingerprints(frame)) == sorted(expected(in_order(spark, rows)), key=repr)


def test_a_single_row_follows_itself(spark):
    frame = spark.createDataFrame([(3, "abcde f")], "doc_id long, text string")
    assert as_rows(fp.edited_fingerprints(frame)) == expected([(3, "abcde f")])


def test_plain_fingerprints(spark, odd_folder, odd_rows):
    docs = spark.read.parquet(f"{odd_folder}/documents.parquet")
    found = sorted(((r["doc_id"], r["fingerprint"]) for r in rows_of(fp.document_fingerprints(docs))), key=repr)
    assert found == sorted(((row[0], fp.fingerprints([(row[1] or "").encode()])[0]) for row in odd_rows), key=repr)


def test_empty_table(spark, empty_folder):
    assert rows_of(QUERIES[QUERY](spark, empty_folder)) == []
