"""Repeated byte strings across documents, by prefix-free parsing.

Removed is every byte covered by a string of LENGTH bytes that also starts anywhere else. Trigger
strings, chosen by a rolling hash, cut each text into overlapping phrases. Equal strings of
LENGTH bytes hold the same trigger at the same place, so suffixes need to be compared within
one trigger's phrases only, and equal phrases (most of highly repetitive text) once only.

1. *Triggers*: of the rolling hashes of GRAM bytes, those that are the least in some string of
   LENGTH bytes. Each string belongs to its least hash; the strings of a trigger start
   next to one another, and their union is the trigger's phrase.
2. *Parse*: counts of triggers and of phrases. A trigger found once settles its strings: none
   repeats. A phrase found twice settles them too: all repeat.
3. *Dictionary*: the distinct phrases of all other triggers, each once with its count. Phrases of a trigger meet in a
   task, which sorts their suffixes by prefix doubling: from the ranks of all suffixes by their first 8 bytes follow those by 16, and so on up to LENGTH.
   Neighbours of equal rank have LENGTH bytes in common: they repeat. A suffix that is alone with its first bytes can't, nor can one that
   holds such a place, so few are left after the first rounds.
4. *Heavy triggers*, whose distinct phrases are too much for a task, are never gathered. Blocks of neighbouring suffixes are
   compared by hash first: if the bytes that they have in common
   occur in one block only, none of its strings repeats; if the whole block occurs twice, all
   do. Only what is left is compared string by string. These are counts over hash keys, summed before they are shuffled, so that neither
   copies nor a passage found in a third of all documents meet in one task.
5. The phrases' repeated strings are carried back to the texts through the parse.

Triggers, phrases and the strings of heavy triggers are told apart by 64-bit hashes, the latter by two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from planloom.llm.storage import saved
from planloom.llm.words import BASE, INVERSE, byte_rows, mixed, parts, powers, prefix_hashes, span_hashes

# The longest trigger, in bytes.
GRAM = 32
# Suffixes of a block.
BLOCK = 8
# Bytes of texts, and of dictionary phrases, that are worked on together.
TOGETHER = 1 << 18
# Triggers with distinct phrases of more bytes are heavy.
HEAVY = 1 << 20
PLACE_MASK = np.uint64(0xFFFFFFFF)
# Stands for all starts of a run in place of the bits of a block.
ALL = -1


class Phrases:
    """The triggers of some texts that lie one behind another.

    For each: its hash and place, the first and last start of its strings, the hash of its phrase, and the number of its text.
    """

    def __init__(self, data: np.ndarray, length: int, sizes: np.ndarray | None = None):
        self.data, self.length = data, length
        sizes = np.array([len(data)]) if sizes is None else sizes
        ends = np.cumsum(sizes)
        if len(data) < length or sizes.max() < length:
            self.places = self.first = self.last = self.text = np.zeros(0, dtype=np.int64)
            self.triggers = self.ids = np.zeros(0, dtype=np.uint64)
            return
        gram = min(GRAM, (length + 1) // 2)
        prefixes = prefix_hashes(data)
        # Rolling hashes of all places; their high halves are random enough to choose by.
        keys = prefixes[gram:] - prefixes[:-gram]
        keys *= powers(INVERSE, len(keys))
        keys &= ~PLACE_MASK
        keys |= np.arange(len(keys), dtype=np.uint64)
        least = _sliding_least(keys, length - gram + 1) & PLACE_MASK
        # Strings that would reach into the next text are none.
        cut = np.zeros(len(data) + 1, dtype=np.int32)
        np.add.at(cut, np.maximum(ends - sizes, ends - length + 1), 1)
        np.add.at(cut, ends, -1)
        inside = (np.cumsum(cut) <= 0)[: len(least)]
        change = np.append(True, least[1:] != least[:-1])
        opens = inside & (change | ~np.append(False, inside[:-1]))
        closes = inside & (np.append(change[1:], True) | ~np.append(inside[1:], False))
        self.first, self.last = np.flatnonzero(opens), np.flatnonzero(closes)
        self.places = least[self.first].astype(np.int64)
        self.text = np.searchsorted(ends, self.first, side="right")
        self.triggers = span_hashes(prefixes, self.places, self.places + gram)
        self.ids = span_hashes(prefixes, self.first, self.last + length)


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbouring keys."""
    size = 1
    while 2 * size <= width:
        keys = np.minimum(keys[:-size], keys[size:])
        size *= 2
    rest = width - size
    return np.minimum(keys[:-rest], keys[rest:]) if rest else keys


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _together(texts: Iterator[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, bytes, sizes) of some texts at a time."""
    rows, start, size = [], 0, 0
    for text in texts:
        if rows and size + len(text) > TOGETHER:
            yield start, np.concatenate(rows), np.array([len(row) for row in rows])
            rows, start, size = [], start + len(rows), 0
        rows.append(text)
        size += len(text)
    if rows:
        yield start, np.concatenate(rows), np.array([len(row) for row in rows])


def _counted(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(trigger, phrase) of each phrase."""
    for batch in batches:
        for _, data, sizes in _together(byte_rows(batch.column("text"))):
            phrases = Phrases(data, length, sizes)
            yield pa.RecordBatch.from_arrays([_signed(phrases.triggers), _signed(phrases.ids)], ["trigger", "phrase"])


def _placed(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(key, trigger) of the distinct triggers of each text."""
    for batch in batches:
        keys = batch.column("key").to_numpy(zero_copy_only=False)
        for start, data, sizes in _together(byte_rows(batch.column("text"))):
            phrases = Phrases(data, length, sizes)
            at = np.unique(_of_text(phrases.text, phrases.triggers), return_index=True)[1]
            yield pa.RecordBatch.from_arrays([pa.array(keys[start + phrases.text[at]]), _signed(phrases.triggers[at])], ["key", "trigger"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the shuffles: (doc, key, n_bytes, packed)."""
    for batch in parts(batches):
        texts = [data.tobytes() for data in byte_rows(batch.column("text"))]
        there = batch.column("text").is_valid().to_pylist()
        packed = [pa.compress(text, codec="zstd", asbytes=True) if text else b"" if known else None
                  for text, known in zip(texts, there, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), batch.column("key"), pa.array(map(len, texts), pa.int64()),
             pa.array(packed, pa.binary())],
            ["doc", "key", "n_bytes", "packed"],
        )


def _unpacked(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for packed, size in zip(batch.column("packed"), batch.column("n_bytes").to_pylist(), strict=True):
        text = pa.decompress(packed.as_buffer(), size, codec="zstd") if size else b""
        yield np.frombuffer(text, dtype=np.uint8)


def _slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes [start, end) of each span, as a binary column."""
    sizes = ends - starts
    bounds = np.append(0, np.cumsum(sizes))
    at = np.arange(bounds[-1]) + np.repeat(starts - bounds[:-1], sizes)
    buffers = [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data[at])]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), buffers).cast(pa.binary())


class _Lists:
    """A column of lists of longs, or of structs of longs, for parts of its rows; null is an empty list."""

    def __init__(self, column: pa.Array, names: tuple[str, ...] = ()):
        values = column.flatten()
        columns = [values.field(name) for name in names] if names else [values]
        self.fields = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in columns]
        self.bounds = np.append(0, np.cumsum(pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)))

    def part(self, start: int, count: int) -> tuple[np.ndarray, ...]:
        """(row from `start` on, fields...) of all items of `count` rows."""
        bounds = self.bounds[start : start + count + 1]
        rows = np.repeat(np.arange(count), np.diff(bounds))
        return rows, *(field[bounds[0] : bounds[-1]] for field in self.fields)


def _of_text(texts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """One hash for a text's number and a hash found in it."""
    return mixed(hashes.view(np.uint64) + texts.astype(np.uint64) * np.uint64(BASE))


def _open_phrases(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(key, trigger, phrase, place, bytes): the phrases of the triggers that counts leave open. A phrase's bytes come once a block."""
    for batch in batches:
        keys, wanted = batch.column("key").to_numpy(zero_copy_only=False), _Lists(batch.column("open"))
        for start, data, sizes in _together(_unpacked(batch)):
            phrases = Phrases(data, length, sizes)
            at = np.flatnonzero(np.isin(_of_text(phrases.text, phrases.triggers), _of_text(*wanted.part(start, len(sizes)))))
            first, ids = phrases.first[at], phrases.ids[at]
            ends = phrases.last[at] + length
            new = np.zeros(len(at), dtype=bool)
            new[np.unique(ids, return_index=True)[1]] = True
            found = _slices(data, first, np.where(new, ends, first))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys[start + phrases.text[at]]), _signed(phrases.triggers[at]), _signed(ids),
                    pa.array(phrases.places[at] - first), pa.compute.if_else(pa.array(new), found, pa.scalar(None, pa.binary())),
                ],
                ["key", "trigger", "phrase", "place", "bytes"],
            )


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Places of keys among the distinct ones."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    ranks = np.empty(len(keys), dtype=np.int64)
    ranks[order] = np.append(0, np.cumsum(ordered[1:] != ordered[:-1]))
    return ranks


def repeated_starts(data: np.ndarray, inside: np.ndarray, length: int) -> np.ndarray:
    """A flag for each place: whether `length` bytes from there on are found from another place on too.

    `inside` flags the places that count. The suffixes that begin there are sorted by prefix doubling.
    """
    size = len(data)
    padded = np.append(data, np.zeros(length, dtype=np.uint8)).astype(np.uint64)
    keys = np.zeros(size, dtype=np.uint64)
    for place in range(8):
        keys = (keys << np.uint64(8)) | padded[place : place + size]
    # Of all places that lie in a string: ranks of their first `width` bytes, 8 now.
    width, strings = min(8, length), inside
    keys >>= np.uint64(8 * (8 - width))
    while True:
        # Places whose first `width` bytes are needed: all that lie in an open string at least that far from its end.
        reach = np.zeros(size + 1, dtype=np.int32)
        starts = np.flatnonzero(strings)
        np.add.at(reach, starts, 1)
        np.add.at(reach, np.minimum(starts + length - width + 1, size), -1)
        needed = np.flatnonzero(np.cumsum(reach[:-1]) > 0)
        ranks = np.full(size + 1, -1, dtype=np.int64)
        ranks[needed] = _ranks(keys[needed])
        counts = np.bincount(ranks[needed], minlength=1)
        # A string that holds a place alone with its bytes repeats nowhere.
        alone = np.append(0, np.cumsum((ranks[:-1] >= 0) & (counts[ranks[:-1]] == 1)))
        last = np.minimum(np.arange(size) + length - width + 1, size)
        strings = strings & (alone[last] == alone[:-1])
        if width == length or not strings.any():
            break
        step = min(width, length - width)
        after = ranks[np.minimum(np.arange(size) + step, size)]
        keys = (ranks[:-1].astype(np.uint64) << np.uint64(32)) | (after & 0xFFFFFFFF).astype(np.uint64)
        width += step
    if width < length:
        return strings
    # Only strings that count are partners, and those left out above have none.
    partners = np.bincount(ranks[:-1][strings], minlength=len(counts))
    return strings & (partners[np.maximum(ranks[:-1], 0)] > 1)


def _ordered(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(trigger, phrase, found): the repeated strings of each phrase, as runs. Rows come sorted by trigger."""
    rows, size = [], 0
    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in ("trigger", "phrase", "place", "occurrences", "bytes")]
        for row in zip(*columns, strict=True):
            if size > TOGETHER and row[0] != rows[-1][0]:
                yield _runs(rows, length)
                rows, size = [], 0
            rows.append(row)
            size += len(row[4])
    if rows:
        yield _runs(rows, length)


def _runs(rows: list[tuple], length: int) -> pa.RecordBatch:
    triggers, phrases, places, occurrences, texts = zip(*rows, strict=True)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    sizes = np.array([len(text) for text in texts])
    starts = np.cumsum(sizes) - sizes
    # The strings of a phrase begin at its first bytes.
    edges = np.zeros(len(data) + 1, dtype=np.int32)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + sizes - length + 1, -1)
    inside = np.cumsum(edges[:-1]) > 0
    repeated = repeated_starts(data, inside, length)
    often = np.repeat(np.array(occurrences) > 1, sizes)
    repeated |= inside & often
    # Runs within a phrase: strings of two phrases never lie next to each other.
    borders = np.flatnonzero(np.diff(repeated.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
    owner = np.searchsorted(starts, borders[:, 0], side="right") - 1
    trigger_places = (starts + np.array(places))[owner]
    high, low = trigger_places - borders[:, 0], trigger_places - borders[:, 1] + 1
    items = pa.StructArray.from_arrays(
        [pa.array(np.array(phrases)[owner]), pa.array(low), pa.array(high), pa.array(np.full(len(owner), ALL))],
        ["phrase", "low", "high", "mask"],
    )
    with_runs, counts = np.unique(owner, return_counts=True)
    found = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), items)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.array(triggers)[with_runs]), pa.array(np.array(phrases)[with_runs]), found], ["trigger", "phrase", "found"]
    )


def _block_bounds(place: int, size: int, length: int, number: int) -> tuple[int, int]:
    """First and last start of a block's strings within its phrase. Blocks count back from the trigger."""
    return max(0, place - number * BLOCK - BLOCK + 1), min(size - length, place - number * BLOCK)


def _blocks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(trigger, phrase, block, core, whole, occurrences): hashes of the bytes that all strings of a full block share, and of all its bytes."""
    width = BLOCK
    for batch in batches:
        out = []
        columns = [batch.column(name).to_pylist() for name in ("trigger", "phrase", "place", "occurrences")]
        for trigger, phrase, place, count, data in zip(*columns, byte_rows(batch.column("bytes")), strict=True):
            lowest, highest = place - (len(data) - length), place
            numbers = np.arange(max(0, lowest) // width, highest // width + 1)
            first = np.maximum(0, place - numbers * width - width + 1)
            last = np.minimum(len(data) - length, place - numbers * width)
            prefixes = prefix_hashes(data)
            start = place - numbers * width
            seed = np.uint64(trigger & 0xFFFFFFFFFFFFFFFF) + numbers.astype(np.uint64) * np.uint64(BASE)
            core = mixed(span_hashes(prefixes, start, start + length - width + 1) + mixed(seed))
            # The bounds are part of the hash: a block cut short differs from a whole one.
            bounds = (place - first).astype(np.uint64) * np.uint64(4 * width) + (last - first).astype(np.uint64)
            whole = mixed(span_hashes(prefixes, first, last + length) + mixed(bounds))
            out.append((np.full(len(numbers), trigger), np.full(len(numbers), phrase), numbers, core.view(np.int64),
                        whole.view(np.int64), np.full(len(numbers), count)))
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)],
                ["trigger", "phrase", "block", "core", "whole", "occurrences"],
            )


def _strings(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(core, string, whole, bit) of each string of the blocks asked for."""
    for batch in batches:
        out = []
        columns = [batch.column(name).to_pylist() for name in ("place", "blocks")]
        for place, blocks, data in zip(*columns, byte_rows(batch.column("bytes")), strict=True):
            prefixes = prefix_hashes(data)
            for block in blocks:
                first, last = _block_bounds(place, len(data), length, block["block"])
                starts = np.arange(first, last + 1)
                bits = place - starts - block["block"] * BLOCK
                hashes = span_hashes(prefixes, starts, starts + length) + bits.astype(np.uint64)
                out.append((np.full(len(starts), block["core"]), hashes.view(np.int64),
                            np.full(len(starts), block["whole"]), bits))
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)],
                ["core", "string", "whole", "bit"],
            )


def _covered(phrases: Phrases, settled: np.ndarray, found: tuple[np.ndarray, ...]) -> np.ndarray:
    """A flag for each byte: whether a repeated string covers it. `settled` and `found` begin with numbers of texts."""
    size, length = len(phrases.data), phrases.length
    steps = np.zeros(size + 1, dtype=np.int32)
    all_repeat = np.isin(_of_text(phrases.text, phrases.triggers), settled)
    np.add.at(steps, phrases.first[all_repeat], 1)
    np.add.at(steps, phrases.last[all_repeat] + length, -1)
    text, phrase, low, high, mask = found
    if len(text):
        # Every occurrence of a phrase with each of its runs and blocks.
        known, ids = _of_text(text, phrase), _of_text(phrases.text, phrases.ids)
        order = np.argsort(known, kind="stable")
        known = known[order]
        begin = np.searchsorted(known, ids, side="left")
        counts = np.searchsorted(known, ids, side="right") - begin
        at = np.repeat(np.arange(len(ids)), counts)
        item = order[np.arange(len(at)) + np.repeat(begin - (np.cumsum(counts) - counts), counts)]
        run = mask[item] == ALL
        np.add.at(steps, phrases.places[at[run]] - high[item[run]], 1)
        np.add.at(steps, phrases.places[at[run]] - low[item[run]] + length, -1)
        at, item = at[~run], item[~run]
        bits = np.arange(BLOCK)
        starts = (phrases.places[at] - low[item])[:, None] - bits
        repeated = (mask[item][:, None] >> bits & 1) == 1
        repeated &= (starts >= phrases.first[at][:, None]) & (starts <= phrases.last[at][:, None])
        starts = np.unique(starts[repeated])
        steps[starts] += 1
        steps[starts + length] -= 1
    return np.cumsum(steps[:-1]) > 0


def _finished(batches: Iterator[pa.RecordBatch], length: int, as_text: bool = False) -> Iterator[pa.RecordBatch]:
    """The columns of FINISHED; with `as_text` doc and text alone, without characters that lost some of their bytes."""
    for batch in batches:
        settled, found = _Lists(batch.column("settled")), _Lists(batch.column("found"), ("phrase", "low", "high", "mask"))
        for start, data, sizes in _together(_unpacked(batch)):
            count = len(sizes)
            own_settled, own_found = _of_text(*settled.part(start, count)), found.part(start, count)
            covered = np.zeros(len(data), dtype=bool)
            if len(own_settled) or len(own_found[0]):
                covered = _covered(Phrases(data, length, sizes), own_settled, own_found)
            ends = np.cumsum(sizes)
            begins = ends - sizes
            # Spans end with their text, also where the next one is covered from its first byte on.
            opens, closes = covered.copy(), covered.copy()
            opens[1:] &= ~covered[:-1] | np.isin(np.arange(1, len(data)), begins)
            closes[:-1] &= ~covered[1:] | np.isin(np.arange(1, len(data)), ends)
            first, last = np.flatnonzero(opens), np.flatnonzero(closes) + 1
            owner = np.searchsorted(ends, first, side="right")
            spans = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(owner, np.arange(count + 1)), pa.int32()),
                pa.StructArray.from_arrays([pa.array(first - begins[owner]), pa.array(last - begins[owner])], ["start", "end"]),
            )
            total = np.append(0, np.cumsum(covered))
            removed = total[ends] - total[begins]
            kept_bounds = np.append(0, np.cumsum(sizes - removed)).astype(np.int64)
            buffers = [None, pa.py_buffer(kept_bounds), pa.py_buffer(data[~covered])]
            kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), count, buffers).cast(pa.binary())
            part = batch.slice(start, count)
            if as_text:
                there = zip(kept.to_pylist(), part.column("packed").is_valid().to_pylist(), strict=True)
                texts = pa.array([data.decode(errors="ignore") if known else None for data, known in there], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc"), texts], ["doc", "text"])
                continue
            yield pa.RecordBatch.from_arrays(
                [part.column("doc"), part.column("packed").is_null(), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), spans, kept],
                ["doc", "no_text", "n_bytes", "n_removed", "spans", "kept_bytes"],
            )


FINISHED = "no_text boolean, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept_bytes binary"
FOUND = "array<struct<phrase: long, low: long, high: long, mask: long>>"


def without_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc (the row as it came in, without its text), no_text (null), n_bytes, n_removed, spans (removed [start, end) byte ranges), kept_bytes.

    `docs` has doc_id and text; other columns travel in `doc`. Texts are judged as they come in, as UTF-8 bytes; a null text
    is an empty one. Texts shorter than `length` bytes keep all. Repeated rows count as two places each, so
    texts of copies of at least `length` bytes go altogether. doc_id may be null or repeated: rows are told apart by a hash of doc_id and
    text, and what holds for a string holds wherever it is, so rows that share it can't take one another's strings.
    """
    marked = _marked(docs, length)
    return marked.mapInArrow(lambda x: _finished(x, length), _with_doc(marked, FINISHED))


def _marked(docs: DataFrame, length: int) -> DataFrame:
    """doc, n_bytes, packed (the compressed text), settled, found: what `_finished` takes the repeated strings out with."""
    if length < 2 * BLOCK:
        raise ValueError(f"length must be at least {2 * BLOCK}")
    text, doc_id = F.col("text").cast("string"), F.col("doc_id").cast("long")
    rest = [F.col(f"doc.`{name}`").alias(name) for name in docs.columns if name != "text"]
    docs = docs.select(F.struct("*").alias("doc"), F.xxhash64(doc_id, text).alias("key"), text.alias("text"))
    docs = docs.select(F.struct(*rest).alias("doc"), "key", "text")
    phrases = docs.select("text").mapInArrow(lambda x: _counted(x, length), "trigger long, phrase long")
    triggers = (
        phrases.groupBy("trigger", "phrase")
        .agg(F.count("*").alias("n"))
        .groupBy("trigger")
        .agg(F.sum("n").alias("total"), F.count("*").alias("phrases"), F.min("n").alias("least"))
        .where("total > 1")
        .select("trigger", F.expr("phrases > 1 and least = 1").alias("open"))
    )
    # Written, so that the join below reads plain shuffles, whose heavy keys adaptive execution splits.
    triggers = saved(triggers, "suffix-triggers")
    places = docs.select("key", "text").mapInArrow(lambda x: _placed(x, length), "key long, trigger long")
    marks = saved(
        places.join(triggers, "trigger")
        .groupBy("key")
        .agg(
            F.collect_set(F.expr("if(open, null, trigger)")).alias("settled"),
            F.collect_set(F.expr("if(open, trigger, null)")).alias("open"),
        ),
        "suffix-marks",
    )
    texts = docs.mapInArrow(_packed, _with_doc(docs, "key long, n_bytes long, packed binary"))
    found = _found(texts.drop("doc"), marks, length)
    return (
        texts.join(marks.select("key", "settled"), "key", "left")
        .join(found, "key", "left")
        .select("doc", "n_bytes", "packed", "settled", "found")
    )


def cleaned_documents(docs: DataFrame, length: int = 200) -> DataFrame:
    """The rows and columns of `docs` with repeated strings cut out of `text`, and n_chars, if there is one, counted anew.

    Characters that lose some of their bytes go altogether. Null texts stay null, and so does their n_chars' value.
    """
    marked = _marked(docs, length)
    texts = marked.mapInArrow(lambda x: _finished(x, length, as_text=True), _with_doc(marked, "text string"))
    chars = F.when(F.col("text").isNull(), F.col("doc.n_chars")).otherwise(F.length("text")) if "n_chars" in docs.columns else None
    return texts.select(
        *(
            F.col("text") if name == "text" else chars.cast(docs.schema[name].dataType).alias(name) if name == "n_chars" else F.col(f"doc.`{name}`")
            for name in docs.columns
        )
    )


def _with_doc(frame: DataFrame, others: str) -> StructType:
    """A schema of the column `doc` of `frame` and others."""
    return StructType([frame.schema["doc"], *StructType.fromDDL(others).fields])


def _found(texts: DataFrame, marks: DataFrame, length: int) -> DataFrame:
    """(key, found): for the open phrases of each text, the repeated strings as runs or as bits of blocks."""
    wanted = marks.where("size(open) > 0").select("key", "open")
    parse = saved(
        texts.join(wanted, "key").select("key", "n_bytes", "packed", "open").mapInArrow(
            lambda x: _open_phrases(x, length), "key long, trigger long, phrase long, place long, bytes binary"
        ),
        "suffix-parse",
    )
    dictionary = saved(
        parse.groupBy("trigger", "phrase").agg(
            F.count("*").alias("occurrences"), F.first("place").alias("place"), F.first("bytes", ignorenulls=True).alias("bytes")
        ),
        "suffix-dictionary",
    )
    heavy = saved(dictionary.groupBy("trigger").agg(F.sum(F.length("bytes")).alias("size")).where(F.col("size") > HEAVY), "suffix-heavy")
    per_phrase = (
        dictionary.join(heavy, "trigger", "left_anti")
        .repartition("trigger")
        .sortWithinPartitions("trigger")
        .mapInArrow(lambda x: _ordered(x, length), f"trigger long, phrase long, found {FOUND}")
    )
    if not heavy.isEmpty():
        per_phrase = per_phrase.union(_by_blocks(dictionary.join(heavy, "trigger", "left_semi"), length))
    return (
        parse.select("key", "trigger", "phrase")
        .distinct()
        .join(per_phrase, ["trigger", "phrase"])
        .groupBy("key")
        .agg(F.flatten(F.collect_list("found")).alias("found"))
    )


def _by_blocks(dictionary: DataFrame, length: int) -> DataFrame:
    """(trigger, phrase, found) of phrases whose strings are compared by blocks."""
    dictionary = saved(dictionary, "suffix-heavy-phrases")
    blocks = saved(
        dictionary.mapInArrow(
            lambda x: _blocks(x, length),
            "trigger long, phrase long, block long, core long, whole long, occurrences long",
        ),
        "suffix-blocks",
    )
    wholes = saved(
        blocks.groupBy("core", "whole").agg(
            F.sum("occurrences").alias("n"), F.min(F.struct("trigger", "phrase", "block")).alias("at")
        ),
        "suffix-wholes",
    )
    contested = wholes.groupBy("core").agg(F.count("*").alias("wholes"), F.min("n").alias("least")).where(
        "wholes > 1 and least = 1"
    )
    asked = (
        wholes.join(contested, "core", "left_semi")
        .groupBy("at.trigger", "at.phrase")
        .agg(F.collect_list(F.struct("at.block", "core", "whole")).alias("blocks"))
    )
    strings = dictionary.join(asked, ["trigger", "phrase"]).select("place", "bytes", "blocks").mapInArrow(
        lambda x: _strings(x, length), "core long, string long, whole long, bit long"
    )
    strings = saved(strings, "suffix-strings")
    repeated = strings.groupBy("core", "string").agg(F.min("whole").alias("a"), F.max("whole").alias("b")).where("a <> b")
    masks = (
        strings.join(repeated.select("core", "string"), ["core", "string"], "left_semi")
        .groupBy("core", "whole")
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit as int))")).alias("mask"))
        .union(wholes.where("n > 1").select("core", "whole", F.lit((1 << BLOCK) - 1).cast("long")))
        .groupBy("core", "whole")
        .agg(F.bit_or("mask").alias("mask"))
    )
    low = F.col("block") * BLOCK
    item = F.struct("phrase", low.alias("low"), (low + BLOCK - 1).alias("high"), "mask")
    return (
        blocks.join(masks, ["core", "whole"])
        .groupBy("trigger", "phrase")
        .agg(F.collect_list(item).alias("found"))
        .select("trigger", "phrase", F.col("found").cast(FOUND).alias("found"))
    )
