"""Token counts against the libraries, on whole texts and in chunks."""

import random
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from corpus_tables import rows_of
from tokenizers import Tokenizer

from planloom.llm.queries import QUERIES
from planloom.llm import tokens
from planloom.llm.tokens import TokenCounter, token_counts

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
PARTS = [
    "a", "b", "the", " the", "  ", "\n", "\t", "'", "'s", "'ll", " 's", "1", "23", "é", "漢", "\U0001f642", " ", " ", "\x1c", "\x85",
    " ", "​", "　", ".", "!!", "\r\n", "__", "<|endoftext|>", "<|endof", "\x00",
]


@pytest.fixture(scope="module")
def library():
    model = Tokenizer.from_file(PATH)
    return lambda text: len(model.encode(text or "", add_special_tokens=False).ids)


def odd_texts():
    rng = random.Random(3)
    for number in range(1500):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 300)))
        if number % 5 == 0:
            text = "".join(rng.choice("ab") for _ in range(300)) + text
        if number % 7 == 0:
            text += " " * 200 + "x"
        yield text


def counter_of(**settings):
    return TokenCounter(PATH, Path(PATH).read_bytes(), **settings)


def test_every_way_of_counting_agrees(library):
    counter = counter_of(chunk=64, overlap=4, huge=80)
    for text in odd_texts():
        assert counter.count(text) == library(text)
        text = text.replace("<|endoftext|>", "")
        assert counter._spliced(text) == counter._by_words(text) == library(text)
    assert counter.widened > 0


MARKS = [
    *PARTS, "abc", "Éa", "naïve", "×", "÷", "ÿ", " ", " ", "\n", "\n\n", "\n \n", "\r", ",", ".", "(", "\"", "'t", "can't", "''", "'", "1a", "a1",
    "«", "…", "“", "ª", "\u0301", "\u00a0", "\u0085", "\u200b", "\u3000", "한", "カナ", "ß", "\U0001d7d8", "_", "~", "\x7f", "\xad",
]


def test_spans_begin_where_pieces_do(library):
    """Many texts at once, of marks, letters and white space in all orders; counts also come out of a table that is emptied again and again."""
    rng = random.Random(7)
    texts = ["".join(rng.choice(MARKS) for _ in range(rng.randrange(0, 40))) for _ in range(4000)]
    counter = counter_of()
    wanted = [library(text) for text in texts]
    assert counter.counts([text.encode() for text in texts]).tolist() == wanted
    assert counter.counts([text.encode() for text in texts]).tolist() == wanted


def test_known_spans_are_bounded(library, monkeypatch):
    monkeypatch.setattr(tokens, "KNOWN_SPANS", 50)
    monkeypatch.setattr(tokens, "TOGETHER", 2000)
    monkeypatch.setattr(tokens, "KNOWN_BYTES", 12)
    counter, rng = counter_of(), random.Random(8)
    for _ in range(30):
        texts = [" ".join(f"w{rng.randrange(300)}" + "é" * rng.randrange(9) for _ in range(60)) for _ in range(10)]
        assert counter.counts([text.encode() for text in texts]).tolist() == [library(text) for text in texts]
        assert len(counter.known) == len(counter.known_counts) <= 50
        assert np.all(np.diff(counter.known.astype(np.float64)) >= 0)


def test_texts_without_spaces_leave_nothing_behind(library):
    counter = counter_of()
    texts = ["漢字仮名" * 2000 + str(n) for n in range(6)] + ["QUJD" * 3000]
    assert counter.counts([text.encode() for text in texts]).tolist() == [library(text) for text in texts]
    assert len(counter.known) < 20


def test_huge_texts_with_special_strings_are_cut_there(library):
    counter = counter_of(chunk=100, overlap=10, huge=150)
    text = "<|endoftext|>" + "some words, and more.\n" * 50 + " <|endoftext|><|endoftext|> x" + "y z " * 100
    assert counter.count(text) == library(text) and counter.count("<|endoftext|>") == 1


def test_whole_table_against_the_library(library):
    import pyarrow.parquet as pq

    texts = [text or "" for text in pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()]
    assert counter_of().counts([text.encode() for text in texts]).tolist() == [library(text) for text in texts]


def test_one_endless_word(library):
    counter = counter_of(chunk=100, overlap=10, huge=150)
    text = "xyz" * 700
    assert counter.count(text) == library(text)


def test_query_on_odd_rows(spark, odd_folder, odd_rows, library):
    found = rows_of(QUERIES["op3_token_counts"](spark, odd_folder))
    counts = [(row[0], len((row[1] or "").encode()), library(row[1])) for row in odd_rows]
    wanted = sorted(((i, size, n, n > 1024) for i, size, n in counts), key=repr)
    assert sorted((tuple(row.values()) for row in found), key=repr) == wanted
    assert any(row["over_limit"] for row in found)


def test_empty_table(spark, empty_folder):
    assert rows_of(QUERIES["op3_token_counts"](spark, empty_folder)) == []


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_encode_whole_texts(spark, name):
    path = str(public_tokenizers.path(name))
    texts = ["Hello  World", "", "a" * 100 + " b", None]
    if name.endswith(".json"):
        model = Tokenizer.from_file(path)
        wanted = [len(model.encode(t or "", add_special_tokens=False).ids) for t in texts]
    else:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        wanted = [len(model.encode(t or "")) for t in texts]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["n_tokens"] for r in sorted(rows_of(token_counts(frame, path)), key=lambda r: r["doc_id"])] == wanted
