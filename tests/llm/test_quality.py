"""Statistics against plain Python, learned rules, boosted trees, and accuracy on held-out labels."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from corpus_tables import folder, held_out, rows_of

from planloom.llm import quality, rules
from planloom.llm.queries import QUERIES
from planloom.llm.statistics import NAMES, labelled_sample, statistics

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    words = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[n : n + 5]) for n in range(len(words) - 4)]
    found, repeated = Counter(windows), set()
    for n, window in enumerate(windows):
        if found[window] > 1:
            repeated.update(range(n, n + 5))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


def test_counts_on_odd_texts(odd_rows):
    for row in odd_rows:
        text = row[1] or ""
        found = statistics(np.frombuffer(text.encode(), np.uint8))
        wanted = plain_counts(text)
        if wanted[0] == 0:
            wanted = (0,) * 5
        assert found[:5] == wanted
        assert len(found) == len(NAMES) and np.isfinite(found).all()


def test_rules_query_on_odd_rows(spark, odd_folder, odd_rows):
    found = rows_of(QUERIES["op4_quality_rules"](spark, odd_folder))
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    wanted = []
    for row in odd_rows:
        counts = plain_counts(row[1] or "")
        counts = counts if counts[0] else (0,) * 5
        wanted.append((row[0], *counts, counts[0] < 10 or 100 * counts[4] > 20 * counts[0]))
    assert sorted((tuple(r[n] for n in names) for r in found), key=repr) == sorted(wanted, key=repr)
    assert all(r["kept"] == (not r["base_failed"] and r["rule"] == 0) for r in found)


def test_verdicts_are_the_first_rule_that_covers(spark):
    data = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    learned = rules.quality_rules(docs, labels)
    assert learned
    texts = dict(zip(*(pq.read_table(f"{data}/documents.parquet").column(n).to_pylist() for n in ("doc_id", "text")), strict=True))
    for row in rows_of(QUERIES["op4_quality_rules"](spark, data)):
        values = np.array([statistics(np.frombuffer((texts[row["doc_id"]] or "").encode(), np.uint8))])
        assert row["rule"] == next((n for n, rule in enumerate(learned, 1) if rules.covered(rule, values)[0]), 0)


def test_covering_finds_a_conjunction_and_spares_the_rest():
    rng = np.random.default_rng(3)
    features = rng.random((4000, len(NAMES)))
    one, two = NAMES.index("upper_share"), NAMES.index("n_words")
    bad = ((features[:, one] > 0.7) & (features[:, two] <= 0.4)) | (features[:, NAMES.index("digit_share")] > 0.9)
    learned = rules.learned_rules(features, np.where(bad, 0, 1))
    rejected = np.any([rules.covered(rule, features) for rule in learned], axis=0)
    assert (rejected & ~bad).mean() < 0.01 and (rejected & bad).sum() > 0.9 * bad.sum()
    assert rules.learned_rules(features, np.ones(4000, dtype=int)) == []
    assert rules.learned_rules(features[:0], np.ones(0, dtype=int)) == []
    # Labels by chance give no rule that would hold elsewhere.
    noise = rules.learned_rules(features, rng.integers(0, 2, 4000))
    assert sum(rules.covered(rule, features).sum() for rule in noise) < 200


def test_trees_learn_an_interaction_and_walk_as_they_were_grown():
    rng = np.random.default_rng(1)
    rows = rng.random((3000, 6))
    labels = ((rows[:, 0] > 0.5) ^ (rows[:, 3] > 0.3)).astype(int)
    trees = quality.fitted(rows[:2000], labels[:2000])
    assert ((trees.scores(rows[2000:]) >= 0.5) == labels[2000:]).mean() > 0.97
    for row, score in zip(rows[:40], trees.scores(rows[:40]), strict=True):
        total = trees.start
        for tree in range(len(trees.features)):
            node = 0
            while node < 2**quality.DEPTH - 1:
                node = 2 * node + 1 + int(row[trees.features[tree, node]] > trees.thresholds[tree, node])
            total += trees.values[tree, node - (2**quality.DEPTH - 1)]
        assert score == pytest.approx(1 / (1 + np.exp(-total)))


def test_held_out_accuracy(spark):
    data = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{data}/labels.parquet").to_pylist()}
    rows = [r for r in rows_of(QUERIES["op2_quality_classifier"](spark, data)) if r["held_out"] and r["doc_id"] in labels]
    assert len(rows) > 80
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in rows]) > 0.95
    good, bad = ([r["score"] for r in rows if labels[r["doc_id"]] == n] for n in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.97


def test_rules_on_held_out_labels(spark):
    """Rejects poor documents that the base passes, and no good ones."""
    data = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{data}/labels.parquet").to_pylist()}
    rows = [r for r in rows_of(QUERIES["op4_quality_rules"](spark, data)) if held_out(r["doc_id"]) and not r["base_failed"]]
    good, poor = ([r for r in rows if labels.get(r["doc_id"]) == n] for n in (1, 0))
    assert len(good) > 1000 and np.mean([r["kept"] for r in good]) > 0.998
    assert len(poor) > 20 and np.mean([r["kept"] for r in poor]) < 0.05


def test_scores_on_odd_rows(spark, odd_folder, odd_rows):
    found = rows_of(QUERIES["op2_quality_classifier"](spark, odd_folder))
    assert sorted(((r["doc_id"], r["held_out"]) for r in found), key=repr) == sorted(
        ((row[0], held_out(row[0])) for row in odd_rows), key=repr
    )
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)


def test_held_out_labels_change_nothing(spark, tmp_path, odd_rows):
    """Flipping every label of the held-out third leaves scores and verdicts as they are."""
    rng = random.Random(2)
    labels = [(row[0], rng.randrange(2), 0) for row in odd_rows if row[0] is not None]
    results = []
    for name, flip in (("a", 0), ("b", 1)):
        (tmp_path / name).mkdir()
        own = [(i, q ^ flip if held_out(i) else q, 0) for i, q, _ in labels]
        place = folder(tmp_path / name, odd_rows, own)
        results.append([
            sorted(map(repr, rows_of(QUERIES[query](spark, place)))) for query in ("op2_quality_classifier", "op4_quality_rules")
        ])
    assert results[0] == results[1]


def test_sample_has_one_row_for_each_document(spark):
    ids = [n for n in range(30) if not held_out(n)]
    texts = [(n, f"text of {n}") for n in ids] + [(ids[0], "again " * (n % 7)) for n in range(500)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(n, n % 2) for n in range(30)], "doc_id long, quality int")
    features, quality = labelled_sample(docs, labels, "quality", 30)
    assert features.shape == (len(ids), len(NAMES)) and quality.tolist() == [n % 2 for n in ids]
    assert len(labelled_sample(docs, labels, "quality", 5)[1]) == 5


def test_empty_tables_and_no_labels(spark, empty_folder, tmp_path, odd_rows):
    for query in ("op2_quality_classifier", "op4_quality_rules"):
        assert rows_of(QUERIES[query](spark, empty_folder)) == []
    place = folder(tmp_path, odd_rows)
    assert {r["score"] for r in rows_of(QUERIES["op2_quality_classifier"](spark, place))} == {0.5}
    assert {r["rule"] for r in rows_of(QUERIES["op4_quality_rules"](spark, place))} == {0}


def test_stage_keeps_rows_and_columns(spark, odd_folder, odd_rows):
    docs, labels = (spark.read.parquet(f"{odd_folder}/{name}.parquet") for name in ("documents", "labels"))
    kept = rows_of(rules.kept_documents(docs, labels))
    judged = rows_of(rules.judged(docs, labels))
    assert list(kept[0]) == docs.columns
    assert Counter(r["doc_id"] for r in kept) == Counter(r["doc_id"] for r in judged if r["kept"])
    whole = Counter(map(repr, rows_of(docs)))
    assert not Counter(map(repr, kept)) - whole
