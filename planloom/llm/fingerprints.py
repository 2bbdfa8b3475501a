"""Fingerprints of documents by one-permutation MinHash.

Each shingle is hashed once: the high bits choose one of BINS bins, and each bin keeps the least of the other bits of its shingles. A bin that
stays empty copies a bin that isn't, which it finds by looking through all bins in an order of its own (optimal densification): each full bin
is as likely as any other, and independently for each empty one, while two equal sets always copy alike. Of each bin
the lowest BITS bits are stored.

Two fingerprints agree in a bin with the likeness (Jaccard similarity) of their sets, or else by chance, once in 2**BITS bins. likeness() takes
the chance agreements off.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.llm.words import BASE, LOWER, mixed, prefix_hashes, span_hashes, word_spans

# Bins of a fingerprint, a power of two, and bits stored of each.
BINS = 256
BITS = 4
# Words of a shingle.
WIDTH = 5
# Bytes of text worked on at a time.
CHUNK = 1 << 22
# Rounds in which all empty bins of all documents look for a full one at once.
ROUNDS = 6
# Bytes of text in a piece of the order of documents, and the largest number of pieces: tasks get the first document of each.
PIECE_BYTES = 1 << 24
MOST_PIECES = 1 << 16

RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)

_shift = np.uint64(64 - (BINS.bit_length() - 1))
_empty = np.uint64(0xFFFFFFFFFFFFFFFF)
# _order[i]: the order in which bin i looks through the bins; _place[i, j]: when it looks at bin j.
_order = np.argsort(np.random.default_rng(20240229).random((BINS, BINS)), axis=1)
_place = np.argsort(_order, axis=1).astype(np.int16)


def shingle_hashes(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, hash) of each run of `width` words, lower-cased; of all words of a text that has fewer."""
    data = LOWER[np.frombuffer(b"\n".join(texts), dtype=np.uint8)]
    starts, ends = word_spans(data)
    words = span_hashes(prefix_hashes(data), starts, ends)
    owner = np.searchsorted(np.cumsum([len(text) + 1 for text in texts]), starts, side="right")
    counts = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(counts) - counts
    runs = np.maximum(counts - width + 1, counts > 0)
    text = np.repeat(np.arange(len(texts)), runs)
    at = first[text] + np.arange(len(text)) - np.repeat(np.cumsum(runs) - runs, runs)
    size = np.minimum(counts, width)[text]
    total = size.astype(np.uint64)
    padded = np.append(words, np.zeros(width, dtype=np.uint64))
    for place in range(width):
        longer = total * np.uint64(BASE) + padded[at + place]
        total = np.where(place < size, longer, total)
    return text, mixed(total)


def bins_of(texts: list[bytes], width: int = WIDTH) -> np.ndarray:
    """The least hash of each bin of each text, densified; all bins are empty where a text has no word."""
    text, hashes = shingle_hashes(texts, width)
    cell = text * BINS + (hashes >> _shift).astype(np.int64)
    values = hashes & ((np.uint64(1) << _shift) - np.uint64(1))
    order = np.argsort(cell, kind="stable")
    cell, values = cell[order], values[order]
    bins = np.full(len(texts) * BINS, _empty)
    if len(cell):
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        bins[cell[first]] = np.minimum.reduceat(values, first)
    return densified(bins.reshape(len(texts), BINS))


def densified(bins: np.ndarray) -> np.ndarray:
    """Empty bins with the values of the full ones that they find first."""
    full = bins != _empty
    result = bins.copy()
    row, bin_ = np.nonzero(~full & full.any(axis=1)[:, None])
    for turn in range(ROUNDS):
        other = _order[bin_, turn]
        found = full[row, other]
        result[row[found], bin_[found]] = bins[row[found], other[found]]
        row, bin_ = row[~found], bin_[~found]
    # What is left belongs to texts with few full bins: the nearest of these in each bin's order.
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    for start, end in itertools.pairwise([*starts, len(row)]):
        choices = np.flatnonzero(full[row[start]])
        nearest = choices[_place[bin_[start:end]][:, choices].argmin(axis=1)]
        result[row[start], bin_[start:end]] = bins[row[start], nearest]
    return result


def packed(bins: np.ndarray) -> list[str]:
    """Fingerprints as hexadecimal digits: the lowest BITS bits of each bin, packed; of a text without words, nothing."""
    low = (bins & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    bits = (low[:, :, None] >> np.arange(BITS - 1, -1, -1, dtype=np.uint8)) & 1
    rows = np.packbits(bits.reshape(len(bins), -1), axis=1)
    there = (bins != _empty).any(axis=1)
    return [row.tobytes().hex() if some else "" for row, some in zip(rows, there, strict=True)]


def fingerprints(texts: list[bytes], width: int = WIDTH) -> list[str]:
    """Fingerprints of texts as UTF-8 bytes, about CHUNK bytes at a time."""
    result, start = [], 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size + len(texts[end]) <= CHUNK):
            size += len(texts[end])
            end += 1
        result += packed(bins_of(texts[start:end], width))
        start = end
    return result


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """The estimated likeness, 0 to 1, of the texts of pairs of fingerprints: 1 for two texts without words, 0 for only one such.

    Bins of unlike shingles agree once in 2**BITS times; that share is taken off.
    """
    result = np.array([float(x == y) for x, y in zip(a, b, strict=True)])
    some = np.array([n for n, (x, y) in enumerate(zip(a, b, strict=True)) if x and y and x != y], dtype=np.int64)
    if len(some):
        values = [np.frombuffer(bytes.fromhex("".join(side[n] for n in some)), np.uint8).reshape(len(some), -1) for side in (a, b)]
        bits = np.unpackbits(values[0] ^ values[1], axis=1).reshape(len(some), BINS, BITS)
        agree = (~bits.any(axis=2)).mean(axis=1)
        chance = 0.5**BITS
        result[some] = np.clip((agree - chance) / (1 - chance), 0, 1)
    return result


def _fingerprinted(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [text or b"" for text in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(fingerprints(texts, width), pa.string())], ["doc_id", "fingerprint"]
        )


def document_fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, fingerprint for each row of `docs` (doc_id, text): words are as in op1, A-Z lower-cased, in runs of `width`.

    A text with fewer words is one run, a null text or one without words has the empty fingerprint. Equal texts have equal
    fingerprints. Each text is worked on where it is read; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: _fingerprinted(batches, width), "doc_id long, fingerprint string")


def _key(doc_id: int | None, text_hash: int) -> tuple[bool, int, int]:
    """A document's place in the order: nulls first."""
    return doc_id is not None, doc_id or 0, text_hash


def _dealt(batches: Iterator[pa.RecordBatch], heads: list[tuple[bool, int, int]]) -> Iterator[pa.RecordBatch]:
    """(piece, after, doc_id, text_hash, copies, n_bytes, packed): documents by piece, and behind each piece the first one of the next.

    Rows of a batch that are alike in doc_id and text become one with their number.
    """
    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in ("doc_id", "text_hash")]
        copies: dict[tuple[bool, int, int], list[int]] = {}
        for row, key in enumerate(map(_key, *columns)):
            copies.setdefault(key, []).append(row)
        rows = []
        texts = batch.column("text").cast(pa.binary())
        for key, found in copies.items():
            text = texts[found[0]].as_py()
            piece = bisect.bisect_right(heads, key) - 1
            row = (key[1] if key[0] else None, key[2], len(found), len(text), pa.compress(text, codec="zstd", asbytes=True) if text else b"")
            rows.append((piece, False, *row))
            if heads[piece] == key:
                rows.append((piece - 1 if piece else len(heads) - 1, True, *row))
        if rows:
            kinds = (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = ["piece", "after", "doc_id", "text_hash", "copies", "n_bytes", "packed"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """[place, doc_id, copies, text] of sorted rows, with equal neighbours as one; place has piece and after."""
    last, key = None, None
    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in ("piece", "after", "doc_id", "text_hash", "copies", "n_bytes")]
        for row, (piece, after, doc_id, text_hash, copies, size) in enumerate(zip(*columns, strict=True)):
            if last is not None and key == (piece, after, doc_id, text_hash):
                last[2] += copies
                continue
            if last is not None:
                yield last
            packed_text = batch.column("packed")[row].as_buffer()
            text = pa.decompress(packed_text, size, codec="zstd", asbytes=True) if size else b""
            last, key = [(piece, after), doc_id, copies, text], (piece, after, doc_id, text_hash)
    if last is not None:
        yield last


def edited(text: str, following: str) -> str:
    """The text with the last half of its characters replaced by the first as many, or all, of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The rows of RESULT for documents that lie next to one another, about CHUNK bytes of text at a time."""
    block, size = [], 0
    for entry in _entries(batches):
        block.append(entry)
        size += len(entry[3])
        if size >= CHUNK and len(block) > 1:
            yield from _block(block, width)
            block, size = block[-1:], len(entry[3])
    if len(block) > 1:
        yield from _block(block, width)


def _block(block: list[list], width: int) -> Iterator[pa.RecordBatch]:
    """Each entry but the last against the one behind it; entries of the next piece's first document come last in theirs."""
    texts = [entry[3] for entry in block]
    own = fingerprints(texts, width)
    pairs = []
    for n, ((place, _, copies, _), (other, _, _, _)) in enumerate(itertools.pairwise(block)):
        if not place[1]:
            if place[0] != other[0]:
                raise RuntimeError("a piece ends without the document behind it")
            pairs += [(n, n + 1, 1)] + ([(n, n, copies - 1)] if copies > 1 else [])
    if not pairs:
        return
    decoded = [text.decode() for text in texts]
    changed = [edited(decoded[n], decoded[other]).encode() for n, other, _ in pairs]
    fingers = fingerprints(changed, width)
    first, following, copies = zip(*pairs, strict=True)
    kept = [own[n] for n in first]
    columns = [
        pa.array([block[n][1] for n in first], pa.int64()),
        pa.array([len(decoded[n]) for n in first], pa.int64()),
        pa.array([hashlib.sha256(text).hexdigest() for text in changed]),
        pa.array(kept),
        pa.array(fingers),
        pa.array(likeness(kept, fingers)),
        pa.array(likeness(kept, [own[n] for n in following])),
    ]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    batch = pa.RecordBatch.from_arrays(columns, names)
    if max(copies) == 1:
        yield batch
        return
    # Rows that were alike, a few thousand at a time.
    ends = np.cumsum(copies)
    for start in range(0, int(ends[-1]), 4096):
        places = np.arange(start, min(start + 4096, int(ends[-1])))
        yield batch.take(pa.array(np.searchsorted(ends, places, side="right")))


def edited_fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of `docs` (doc_id, text).

    The edited text is the row's text with its last floor(n_chars / 2) characters replaced by the first as many, or all, of the next row's. Rows are in the
    order of doc_id, null first, those that share one in the order of a hash of the text; the last one's next is the first, so a
    single row follows itself. near_edited and near_next are the estimated likeness of the text to the edited and to the next text.
    A null text is an empty one; it has no characters to replace. Other columns are ignored.

    Rows are dealt by ranges of their order, as many as their bytes need; each piece also gets the first row of the piece behind it. So
    texts are shuffled once, and a task meets its documents one after another.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    keys = rows.select("doc_id", "text_hash", F.octet_length("text").alias("n_bytes"))
    total = keys.agg(F.sum("n_bytes")).first()[0]
    if total is None:
        return docs.sparkSession.createDataFrame([], RESULT)
    pieces = min(MOST_PIECES, total // PIECE_BYTES + 1)
    order = keys.select("doc_id", "text_hash").repartitionByRange(pieces, "doc_id", "text_hash")
    # Equal keys share a partition, so each key heads one piece at most.
    firsts = order.groupBy(F.spark_partition_id().alias("piece")).agg(F.min(F.struct("doc_id", "text_hash")).alias("head"))
    heads = sorted(_key(row.head.doc_id, row.head.text_hash) for row in firsts.collect())
    dealt = rows.mapInArrow(
        lambda batches: _dealt(batches, heads),
        "piece int, after boolean, doc_id long, text_hash long, copies long, n_bytes long, packed binary",
    )
    sorted_rows = dealt.repartition("piece").sortWithinPartitions("piece", "after", "doc_id", "text_hash")
    return sorted_rows.mapInArrow(lambda batches: _compared(batches, width), RESULT)
