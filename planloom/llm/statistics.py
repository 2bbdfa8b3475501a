"""Numbers that describe a text: counts for rules and ratios for models. Texts only: no label, id, source or language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from planloom.llm.words import BASE, SPACE, byte_rows, mixed, parts, prefix_hashes, span_hashes, word_spans

# Words of the windows in which repetition is looked for.
WINDOW = 5


def _table(characters: str) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[ord(c) for c in characters]] = True
    return table


SYMBOL = _table("#*$%&|<>")
UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LOWER = _table("abcdefghijklmnopqrstuvwxyz")
DIGIT = _table("0123456789")
PUNCTUATION = _table("!\"'(),-./:;?[\\]^_`{}~+=@")
SENTENCE_END = _table(".!?")
WIDE = np.zeros(256, dtype=bool)
WIDE[0x80:] = True
CONTINUATION = np.zeros(256, dtype=bool)
CONTINUATION[0x80:0xC0] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = (
    "n_lines",
    "mean_word_chars",
    "max_word_bytes",
    "words_per_line",
    "symbols_per_word",
    "dup_line_share",
    "repeat_word_share",
    "same_word_share",
    "distinct_word_share",
    "short_word_share",
    "upper_share",
    "digit_share",
    "punctuation_share",
    "sentence_end_share",
    "wide_share",
    "letterless_word_share",
)
NAMES = COUNTS + RATIOS


def statistics(data: np.ndarray) -> tuple[float, ...]:
    """The values of NAMES for the UTF-8 bytes of one text; ratios are 0 where there is nothing to divide by."""
    starts, ends = word_spans(data)
    words = len(starts)
    if words == 0:
        return (0.0,) * len(NAMES)
    inside = ~SPACE[data]
    prefixes = prefix_hashes(data)
    hashes = span_hashes(prefixes, starts, ends)
    sizes = ends - starts
    word_bytes = int(sizes.sum())
    chars = word_bytes - int(np.count_nonzero(CONTINUATION[data]))
    symbols = int(np.count_nonzero(SYMBOL[data]))

    breaks = np.flatnonzero(data == 10)
    line_starts, line_ends = np.append(0, breaks + 1), np.append(breaks, len(data))
    before = np.concatenate([[0], np.cumsum(inside)])
    worded = before[line_ends] > before[line_starts]
    lines = span_hashes(prefixes, line_starts[worded], line_ends[worded])
    dup_lines = len(lines) - len(np.unique(lines))

    repeated = _repeated_words(hashes)
    counts = np.bincount(data, minlength=256)
    letters = max(1, int(counts[UPPER | LOWER].sum()))
    lettered = np.concatenate([[0], np.cumsum((UPPER | LOWER | WIDE)[data])])
    return (
        words, chars, symbols, dup_lines, repeated,
        len(lines),
        chars / words,
        int(sizes.max()),
        words / len(lines),
        symbols / words,
        dup_lines / len(lines),
        repeated / words,
        int(np.count_nonzero(hashes[1:] == hashes[:-1])) / words,
        len(np.unique(hashes)) / words,
        int(np.count_nonzero(sizes <= 2)) / words,
        int(counts[UPPER].sum()) / letters,
        int(counts[DIGIT].sum()) / word_bytes,
        int(counts[PUNCTUATION].sum()) / word_bytes,
        int(counts[SENTENCE_END].sum()) / words,
        int(counts[WIDE].sum()) / word_bytes,
        int(np.count_nonzero(lettered[ends] == lettered[starts])) / words,
    )


def _repeated_words(hashes: np.ndarray) -> int:
    """Words inside WINDOW-word windows that are found twice or more."""
    windows = len(hashes) - WINDOW + 1
    if windows < 2:
        return 0
    total = np.zeros(windows, dtype=np.uint64)
    for place in range(WINDOW):
        total *= np.uint64(BASE)
        total += hashes[place : place + windows]
    _, which, counts = np.unique(mixed(total), return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[which] > 1)
    steps = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(steps[:-1])))


def _text(batch: pa.RecordBatch, within: int | None) -> pa.Array:
    """The column `text`, or the field of `doc` with that number: null where either is."""
    return batch.column("text") if within is None else pa.compute.struct_field(batch.column("doc"), [within])


def _described(batches: Iterator[pa.RecordBatch], kept: tuple[str, ...], within: int | None = None) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches):
        values = [statistics(data) for data in byte_rows(_text(batch, within))]
        table = np.array(values, dtype=np.float64).reshape(len(values), len(NAMES))
        columns = [pa.array(table[:, n]) for n in range(len(NAMES))]
        yield pa.RecordBatch.from_arrays([batch.column(name) for name in kept] + columns, list(kept + NAMES))


def described(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns named in `keep` and the statistics of `text`, as doubles. A null text has no words."""
    rows = docs.select(*keep, F.col("text").cast("string"))
    kinds = StructType([rows.schema[name] for name in keep] + [StructField(name, DoubleType()) for name in NAMES])
    return rows.mapInArrow(lambda batches: _described(batches, keep), kinds)


def described_documents(docs: DataFrame) -> DataFrame:
    """`doc`, the whole row of `docs`, and the statistics of its `text`. The text travels once, in its row."""
    if dict(docs.select("text").dtypes)["text"] != "string":
        return described(docs.select(F.struct("*").alias("doc"), "text"), "doc")
    within = [name.lower() for name in docs.columns].index("text")
    rows = docs.select(F.struct("*").alias("doc"))
    kinds = StructType([rows.schema["doc"]] + [StructField(name, DoubleType()) for name in NAMES])
    return rows.mapInArrow(lambda batches: _described(batches, ("doc",), within), kinds)


def held_out(doc_id: str) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and 0/1 labels of at most `size` documents: those whose ids hash lowest, none of them held out.

    Rows with null or other labels are ignored; a document labelled twice counts by its lowest label. The ids, at most `size`, are broadcast.
    Of several rows with the same id the one whose text hashes lowest counts, so `size` bounds what the driver gets.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("labelled"), F.col(label).cast("int").alias("label"))
    known = known.where("labelled is not null and label in (0, 1)").where(~held_out("labelled"))
    chosen = known.groupBy("labelled").agg(F.min("label").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("labelled"), "labelled").limit(size)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled"))
    texts = rows.withColumn("text_hash", F.xxhash64(F.col("text").cast("string")))
    one = F.min(F.struct("text_hash", *NAMES)).alias("one")
    sample = described(texts, "labelled", "label", "text_hash").groupBy("labelled", "label").agg(one)
    table = sample.select("labelled", "label", "one.*").toArrow().sort_by("labelled")
    features = np.column_stack([table.column(name).to_numpy() for name in NAMES]) if table.num_rows else np.zeros((0, len(NAMES)))
    return features, np.asarray(table.column("label").to_pylist(), dtype=np.int64)
