"""Collocations against plain counting in Python."""

import random
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from corpus_tables import rows_of

from planloom.llm import phrases
from planloom.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_force(rows, least=30, longest=4, covered=80, factor=2_000_000, top=2000):
    found, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        counts = found.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, longest + 1):
                counts.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    result = []
    for lang, counts in found.items():
        candidates = {phrase: a for phrase, a in counts.items() if a >= least and len(phrase) > 1}
        scored = []
        for phrase, a in candidates.items():
            cuts = [(factor * a // (counts[phrase[:k]] + counts[phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            within = (
                100 * other >= covered * a
                for long, other in candidates.items()
                if len(long) > len(phrase) and any(long[i : i + len(phrase)] == phrase for i in range(len(long)))
            )
            if not any(within):
                scored.append((-score, -a, " ".join(phrase).encode(), counts[phrase[:k]], counts[phrase[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            result.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return result


def texts(seed, count=300):
    rng = random.Random(seed)
    vocabulary = [f"w{n}" for n in range(12)] + ["É", "naïve", "new", "York", "\x0e", " ", "漢字"]
    fixed = ["New York", "rare one", "w1 w2 w3 w4 w5", "a\tb  c", "x.y"]
    rows = []
    for _ in range(count):
        words = [rng.choice(vocabulary) if rng.random() < 0.7 else rng.choice(fixed) for _ in range(rng.randrange(0, 40))]
        text = "".join(word + rng.choice([" ", " ", " ", "\t", ", ", ".\n", "\x0b", "! "]) for word in words)
        rows.append((rng.choice(["en", "de", None, "und"]), text))
    return rows + [("en", None), (None, ""), ("fr", " \t."), ("fr", None)]


def frame_of(spark, rows):
    full = [(lang, text, "own", "own", 1) for lang, text in rows]
    return spark.createDataFrame(full, "lang string, text string, phrase string, word string, n int").repartition(5)


def as_rows(frame):
    return sorted(tuple(row.values()) for row in rows_of(frame))


@pytest.mark.parametrize("settings", [{}, {"least": 3, "top": 40}, {"least": 2, "longest": 6, "covered": 50}, {"longest": 2}])
def test_equals_brute_force(spark, settings):
    rows = texts(1) + texts(2) * 2
    found = as_rows(phrases.collocations(frame_of(spark, rows), **settings))
    assert found == sorted(brute_force(rows, **settings)) and found


def test_small_tables_change_nothing(spark, monkeypatch):
    """More entries than ranks, full buffers, arrays for tiles and a crowded bitmap."""
    rows = texts(3)
    wanted = sorted(brute_force(rows, least=3))
    texts_ = [(lang or "und", text or "") for lang, text in rows]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*texts_, strict=True)], ["lang", "text"])
    for ranks, dense, buffer in ((8, 1, 10), (8, 5, 1 << 21), (1 << 10, 100, 50), (64, 1 << 30, 1)):
        for name, value in (("RANKS", ranks), ("TILE", 4), ("TILES", ranks // 4), ("DENSE", dense), ("BUFFER", buffer), ("KEPT", buffer), ("CHUNK", 64)):
            monkeypatch.setattr(phrases, name, value)
        levels, counts = [], count_batches(phrases._word_counts([batch]), ("lang", "word", "id"))
        frequent = [(n, key[2]) for key, n in counts.items() if n >= 3 and key[1] is not None]
        for size in (2, 3, 4):
            levels.append(frequent_of(frequent, ranks))
            pairs = count_batches(phrases._pair_counts([batch], [SimpleNamespace(value=level) for level in levels]), ("head", "last"))
            frequent = []
            for (head, last), n in pairs.items():
                if n >= 3:
                    both = np.array([[head], [last]], dtype=np.int64).view(np.uint64)
                    frequent.append((n, int(phrases.joined(both[0], both[1]).view(np.int64)[0])))
            sizes = sorted(n for n, _ in frequent)
            assert sizes == sorted(plain_counts(rows, size, 3))
    monkeypatch.undo()
    assert as_rows(phrases.collocations(frame_of(spark, rows), least=3)) == wanted


def count_batches(batches, names):
    counts = Counter()
    for batch in batches:
        for row in batch.to_pylist():
            counts[tuple(row[name] for name in names)] += row["n"]
    return counts


def frequent_of(entries, ranks):
    ids = np.array([key for _, key in sorted(entries, reverse=True)], dtype=np.int64).view(np.uint64)
    bits = np.zeros(1 << (phrases.MAP_BITS - 3), dtype=np.uint8)
    for place in (ids >> np.uint64(64 - phrases.MAP_BITS)).tolist():
        bits[place >> 3] |= 1 << (place & 7)
    return phrases.Frequent(ids[:ranks], bits)


def plain_counts(rows, size, least):
    counts = Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            counts.update((lang or "und", *words[i : i + size]) for i in range(len(words) - size + 1))
    return [n for n in counts.values() if n >= least]


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 16)
    text = b"one two. three four five six seven eight nine ten! eleven twelve"
    parts = list(phrases._cut(text))
    assert b"".join(parts) == text and len(parts) > 1
    assert all(part[-1:] in b".!" for part in parts[:-1])


def test_scores_beyond_64_bits(spark):
    """The product of a factor and a count passes 64 bits before it is divided."""
    rows = [("en", "a b")] * 40
    factor = 900_000_000_000_000_000
    found = as_rows(phrases.collocations(frame_of(spark, rows), factor=factor))
    assert found == [("en", 1, "a b", 40, 40, 40, 80, factor // 2)]


def test_query_on_odd_rows(spark, odd_folder, odd_rows):
    found = as_rows(QUERIES["op11_phrase_collocations"](spark, odd_folder))
    assert found == sorted(brute_force([(row[2], row[1]) for row in odd_rows])) and found


def test_empty_table(spark, empty_folder):
    assert rows_of(QUERIES["op11_phrase_collocations"](spark, empty_folder)) == []
