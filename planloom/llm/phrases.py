"""Collocations: phrases whose words come together more often than their parts would.

Phrases are counted level by level. Words that are frequent enough get ids by falling frequency; then pairs of a word and the next one,
then pairs of a frequent pair, ranked anew, and the next word, and so on. A longer phrase can only be frequent if both
phrases one word shorter in it are, so each level looks at those alone.

*Tiles*: the ids of both sides of a pair are its address. The square of all addresses is cut into tiles of TILE by TILE counters. Low ids are
frequent words, so few tiles near the origin hold most pairs: each such tile is an array that np.bincount fills without looking
anything up. Pairs of all other tiles are sorted, and runs of equal ones counted (coordinate lists).

*Bounded tables*: only the RANKS most frequent entries of a level have ids. Pairs with any other entry are counted by the entries'
64-bit hashes, as coordinate lists too. Which hashes are frequent at all every task reads from a bitmap of fixed size; a place that two hashes share
costs counting a pair in vain, no more. What tasks count is summed by Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planloom.llm.storage import saved
from planloom.llm.words import BASE, LOWER, mixed, prefix_hashes, span_hashes

# Entries of a level that have ids, by falling frequency.
RANKS = 1 << 17
# Rows and columns of a tile.
TILE = 512
TILES = RANKS // TILE
# A tile with this many pairs in a buffer gets an array of counters, as long as a task has fewer than MOST_ARRAYS.
DENSE = 1 << 13
MOST_ARRAYS = 16
# Pairs that are gathered before they are counted, and counted coordinates that a task keeps.
BUFFER = 1 << 18
KEPT = 1 << 19
# Bits of the map of frequent hashes.
MAP_BITS = 26
# Bytes of text worked on at a time.
CHUNK = 1 << 20
# Rows of a record batch that a task sends.
ROWS = 1 << 15
# Pieces of a language for the first round of its top list.
PIECES = 64

GAP, BREAK = 1, 2
KINDS = np.zeros(256, dtype=np.uint8)
KINDS[[0x20, 0x09]] = GAP
KINDS[list(b".,;:!?\n\x0b\x0c\r")] = BREAK


class Words:
    """The words of some texts: their places, texts, pieces and hashes. A hash tells language and word."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        self.langs = langs
        self.data = LOWER[np.frombuffer(b"\n".join(texts), dtype=np.uint8)]
        kinds = KINDS[self.data]
        inside = np.zeros(len(kinds) + 2, dtype=np.int8)
        inside[1:-1] = kinds == 0
        edges = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        self.pieces = np.cumsum(kinds == BREAK, dtype=np.int32)[self.starts]
        self.texts = np.searchsorted(np.cumsum([len(text) + 1 for text in texts]), self.starts, side="right")
        seeds = np.array([_seed(lang) for lang in langs], dtype=np.uint64)
        self.hashes = mixed(span_hashes(prefix_hashes(self.data), self.starts, self.ends) + seeds[self.texts])


_seeds: dict[str, int] = {}


def _seed(lang: str) -> int:
    if lang not in _seeds:
        if len(_seeds) > 10_000:
            _seeds.clear()
        _seeds[lang] = int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")
    return _seeds[lang]


def _cut(text: bytes) -> Iterator[bytes]:
    """A text in parts of about CHUNK bytes, cut behind the end of a piece: a piece stays whole."""
    start = 0
    while len(text) - start > CHUNK:
        breaks = np.flatnonzero(KINDS[np.frombuffer(text, np.uint8, CHUNK, start)] == BREAK)
        if len(breaks):
            end = start + int(breaks[-1]) + 1
        else:
            end = next((n + 1 for n in range(start + CHUNK, len(text)) if KINDS[text[n]] == BREAK), len(text))
        yield text[start:end]
        start = end
    yield text[start:]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """The words of about CHUNK bytes of texts at a time."""
    texts, langs, size = [], [], 0
    for batch in batches:
        for value, lang in zip(batch.column("text").cast(pa.binary()), batch.column("lang").to_pylist(), strict=True):
            for part in _cut(value.as_py() or b""):
                if texts and size + len(part) > CHUNK:
                    yield Words(texts, langs)
                    texts, langs, size = [], [], 0
                texts.append(part)
                langs.append(lang)
                size += len(part)
    if texts:
        yield Words(texts, langs)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, id, n) of the words, and of each language's words together with a null word."""
    for words in _chunks(batches):
        _, first, counts = np.unique(words.hashes, return_index=True, return_counts=True)
        spans = zip(words.starts[first].tolist(), words.ends[first].tolist(), strict=True)
        names = [words.data[start:end].tobytes() for start, end in spans]
        langs = [words.langs[text] for text in words.texts[first]]
        totals: dict[str, int] = {}
        for lang, count in zip(words.langs, np.bincount(words.texts, minlength=len(words.langs)).tolist(), strict=True):
            totals[lang] = totals.get(lang, 0) + count
        yield from _sliced(
            [
                pa.array([*langs, *totals], pa.string()),
                pa.array([*names, *(None for _ in totals)], pa.binary()).cast(pa.string()),
                _longs(np.concatenate([words.hashes[first], np.zeros(len(totals), dtype=np.uint64)])),
                pa.array([*counts.tolist(), *totals.values()], pa.int64()),
            ],
            ["lang", "word", "id", "n"],
        )


def _sliced(columns: list[pa.Array], names: list[str]) -> Iterator[pa.RecordBatch]:
    batch = pa.RecordBatch.from_arrays(columns, names)
    for start in range(0, len(batch), ROWS):
        yield batch.slice(start, ROWS)


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def joined(phrases: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The hash of each phrase with a word behind it."""
    return mixed(phrases * np.uint64(BASE) + words)


class Frequent:
    """A level's frequent entries: hashes of the most frequent ones in order of rank, and a bitmap of the hashes of all."""

    def __init__(self, by_rank: np.ndarray, bits: np.ndarray):
        self.by_rank, self.bits = by_rank, bits
        self.order = np.argsort(by_rank)
        self.sorted = by_rank[self.order]

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        """Whether hashes may be frequent: never false for one that is."""
        place = hashes >> np.uint64(64 - MAP_BITS)
        return (self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        """The rank of each hash, -1 for those without one."""
        if not len(self.sorted):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.order[at], -1)


class TileCounter:
    """Counts pairs of a phrase and the word behind it."""

    def __init__(self, phrases: Frequent, words: Frequent):
        self.phrases, self.words = phrases, words
        self.arrays: dict[int, np.ndarray] = {}
        self.keys, self.counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def add(self, phrases: np.ndarray, words: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Counts pairs of hashes; yields those counts that the task doesn't keep."""
        rows, columns = self.phrases.ranks(phrases), self.words.ranks(words)
        ranked = (rows >= 0) & (columns >= 0)
        yield from self._by_hash(phrases[~ranked], words[~ranked])
        rows, columns = rows[ranked], columns[ranked]
        tiles, cells = rows // TILE * TILES + columns // TILE, rows % TILE * TILE + columns % TILE
        load = np.bincount(tiles, minlength=TILES * TILES)
        for tile in np.flatnonzero(load >= DENSE)[: MOST_ARRAYS - len(self.arrays)].tolist():
            self.arrays.setdefault(tile, np.zeros(TILE * TILE, dtype=np.int64))
        dense = np.zeros(TILES * TILES, dtype=bool)
        dense[list(self.arrays)] = True
        dense = dense[tiles]
        # Sorted by tile, so that each one's pairs lie together.
        order = np.argsort(tiles[dense].astype(np.uint16), kind="stable")
        sorted_cells = cells[dense][order]
        start = 0
        for tile in sorted(self.arrays):
            end = start + int(load[tile])
            self.arrays[tile] += np.bincount(sorted_cells[start:end], minlength=TILE * TILE)
            start = end
        keys, counts = np.unique(tiles[~dense] * (TILE * TILE) + cells[~dense], return_counts=True)
        self.keys, self.counts = _summed(np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts]))
        if len(self.keys) > KEPT:
            yield from self._kept(self.keys, self.counts)
            self.keys, self.counts = self.keys[:0], self.counts[:0]

    def _by_hash(self, phrases: np.ndarray, words: np.ndarray) -> Iterator[pa.RecordBatch]:
        _, first, counts = np.unique(joined(phrases, words), return_index=True, return_counts=True)
        yield from _pairs(phrases[first], words[first], counts)

    def _kept(self, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        tiles, cells = keys // (TILE * TILE), keys % (TILE * TILE)
        rows, columns = tiles // TILES * TILE + cells // TILE, tiles % TILES * TILE + cells % TILE
        yield from _pairs(self.phrases.by_rank[rows], self.words.by_rank[columns], counts)

    def rest(self) -> Iterator[pa.RecordBatch]:
        yield from self._kept(self.keys, self.counts)
        for tile, counts in self.arrays.items():
            cells = np.flatnonzero(counts)
            yield from self._kept(tile * (TILE * TILE) + cells, counts[cells])


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with their counts added up."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
    return keys[first], np.add.reduceat(counts[order], first)


def _pairs(phrases: np.ndarray, words: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    return _sliced([_longs(phrases), _longs(words), pa.array(counts, pa.int64())], ["head", "last", "n"])


def pairs_of(words: Words, levels: list[Frequent]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of a phrase of len(levels) words, hash of the word behind it), where both phrases that are a word shorter may be frequent."""
    size = len(levels)
    phrases = words.hashes
    open_ = levels[0].may_hold(phrases)
    for length in range(2, size + 1):
        # Of `length` words from here on: both phrases of a word less are open, and the words are in one piece.
        count = max(len(words.hashes) - length + 1, 0)
        whole = words.pieces[:count] == words.pieces[length - 1 :]
        at = np.flatnonzero(open_[:count] & open_[1 : count + 1] & whole)
        longer = joined(phrases[at], words.hashes[at + length - 1])
        phrases = np.zeros(count, dtype=np.uint64)
        phrases[at] = longer
        open_ = np.zeros(count, dtype=bool)
        open_[at] = levels[length - 1].may_hold(longer)
    count = max(len(words.hashes) - size, 0)
    at = np.flatnonzero(open_[:count] & open_[1 : count + 1] & (words.pieces[:count] == words.pieces[size:]))
    return phrases[at], words.hashes[at + size]


def _pair_counts(batches: Iterator[pa.RecordBatch], shared: list[Broadcast]) -> Iterator[pa.RecordBatch]:
    """(head, last, n): phrases of one more word than there are levels."""
    levels = [level.value for level in shared]
    counter, gathered, size = TileCounter(levels[-1], levels[0]), [], 0
    for words in _chunks(batches):
        gathered.append(pairs_of(words, levels))
        size += len(gathered[-1][0])
        if size >= BUFFER:
            yield from counter.add(*map(np.concatenate, zip(*gathered, strict=True)))
            gathered, size = [], 0
    if gathered:
        yield from counter.add(*map(np.concatenate, zip(*gathered, strict=True)))
    yield from counter.rest()


def _with_id(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        head, last = (batch.column(name).to_numpy(zero_copy_only=False).view(np.uint64) for name in ("head", "last"))
        yield pa.RecordBatch.from_arrays([_longs(joined(head, last)), *batch.columns], ["id", *batch.schema.names])


def _frequent(entries: DataFrame) -> Frequent:
    """What tasks need of a level's frequent entries (id, n): RANKS hashes and a bitmap of 2**MAP_BITS bits, whatever their number."""
    top = entries.orderBy(F.desc("n"), "id").limit(RANKS).select("id").toArrow()
    place = F.shiftrightunsigned("id", 64 - MAP_BITS) + 1
    maps = (
        entries.groupBy(F.bitmap_bucket_number(place).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
        .toArrow()
    )
    bits = np.zeros(1 << (MAP_BITS - 3), dtype=np.uint8)
    for bucket, part in zip(maps.column("bucket").to_pylist(), maps.column("bits").to_pylist(), strict=True):
        bits[(bucket - 1) * len(part) : bucket * len(part)] = np.frombuffer(part, dtype=np.uint8)
    return Frequent(top.column("id").to_numpy().astype(np.int64).view(np.uint64), bits)


def frequent_phrases(docs: DataFrame, least: int = 30, longest: int = 4) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, n) of the phrases of 1 to `longest` words found at least `least` times, and (lang, total) of all words.

    `docs` has lang and text; see collocations. Both results are written tables.
    """
    if least < 1 or longest < 2:
        raise ValueError("least must be 1 or more and longest 2 or more")
    texts = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    counts = texts.mapInArrow(_word_counts, "lang string, word string, id long, n long")
    counts = counts.groupBy("lang", "word").agg(F.first("id").alias("id"), F.sum("n").alias("n"))
    words = saved(counts.where(f"n >= {least} or word is null"), "phrase-words")
    totals = words.where("word is null").select("lang", F.col("n").alias("total"))
    words = words.where("word is not null")
    level = words.select("id", "lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), "n")
    found, shared = level, []
    for size in range(2, longest + 1):
        shared.append(docs.sparkSession.sparkContext.broadcast(_frequent(level)))
        known = list(shared)
        pairs = texts.mapInArrow(lambda batches, known=known: _pair_counts(batches, known), "head long, last long, n long")
        pairs = pairs.groupBy("head", "last").agg(F.sum("n").alias("n")).where(f"n >= {least}")
        pairs = pairs.mapInArrow(_with_id, "id long, head long, last long, n long")
        heads = level.select(F.col("id").alias("head"), "lang", F.col("phrase").alias("first"))
        lasts = words.select(F.col("id").alias("last"), "word")
        named = pairs.join(heads, "head").join(lasts, "last")
        level = saved(
            named.select("id", "lang", F.concat_ws(" ", "first", "word").alias("phrase"), F.lit(size).alias("size"), "n"),
            "phrase-level",
        )
        found = found.union(level)
    # All levels are written: nothing asks for these again, and workers would keep them.
    for level in shared:
        level.destroy()
    return found.drop("id"), totals


def collocations(
    docs: DataFrame, least: int = 30, longest: int = 4, covered: int = 80, factor: int = 2_000_000, top: int = 2000
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases of 2 to `longest` words by score.

    `docs` has lang and text; other columns are ignored. A-Z become lower case; the characters .,;:!? and those numbered 10 to 13 end
    a piece, spaces and tabs end a word, phrases lie within a piece. A null lang is `und`, a null or empty text has no words. Repeated
    rows count each time.

    A candidate is found `a` >= `least` times. Cut in two, its parts are found `l` and `r` times, and it scores floor(factor * a / (l + r)); the cut
    with the lowest score counts, of equal ones the first. A candidate that is part of a longer one with 100 * a of that >= `covered` * a of
    its own is dropped. Ties in score go to the larger a, then to the phrase that is first in the order of UTF-8 bytes. `n` counts the
    language's words. All counts and scores are exact but for words that share a 64-bit hash.
    """
    found, totals = frequent_phrases(docs, least, longest)
    parts = F.split("phrase", " ")
    candidates = found.where("size > 1").withColumn("words", parts)
    cuts = candidates.select("lang", "phrase", "size", "n", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut")).select(
        "lang",
        "phrase",
        "n",
        "cut",
        F.array_join(F.slice("words", 1, F.col("cut")), " ").alias("first"),
        F.array_join(F.slice("words", F.col("cut") + 1, F.col("size") - F.col("cut")), " ").alias("rest"),
    )
    firsts = found.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    rests = found.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    # Decimals: the product may pass 64 bits.
    wide = "decimal(19, 0)"
    score = F.expr(f"(cast({factor} as {wide}) * cast(n as {wide})) div (cast(l as {wide}) + cast(r as {wide}))")
    scored = (
        cuts.join(firsts, ["lang", "first"])
        .join(rests, ["lang", "rest"])
        .groupBy("lang", "phrase", "n")
        .agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))
    )
    inner = F.explode(
        F.expr("""
            flatten(transform(sequence(2, size - 1), width -> transform(
                sequence(1, size - width + 1), start -> array_join(slice(words, start, width), ' '))))
        """)
    )
    longer = candidates.where("size > 2").select("lang", inner.alias("phrase"), "n")
    longer = longer.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(
        f"longer is null or cast(longer as {wide}) * 100 < cast(n as {wide}) * {covered}"
    )
    by_score = (F.desc("best.score"), F.desc("n"), F.asc("phrase"))
    # First within pieces of a language, so that no task sorts all of its phrases.
    piece = F.pmod(F.xxhash64("phrase"), F.lit(PIECES))
    within = Window.partitionBy("lang", "piece").orderBy(*by_score)
    near = kept.withColumn("piece", piece).withColumn("place", F.row_number().over(within)).where(f"place <= {top}")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by_score))).where(f"rank <= {top}")
    return ranked.join(totals, "lang").select(
        "lang",
        F.col("rank").cast("long").alias("rank"),
        "phrase",
        F.col("n").alias("a"),
        F.col("best.l").alias("l"),
        F.col("best.r").alias("r"),
        F.col("total").alias("n"),
        F.col("best.score").alias("score"),
    )
