"""Token counts of whole texts, with huge texts encoded in overlapping chunks.

A byte-level tokenizer first splits a text into pieces, from left to right, and then merges bytes within each
piece only. Its pattern looks ahead, never behind: where a piece begins, the rest of the split depends
on the text from there on alone. So if two chunks that overlap both begin a piece at the same character,
they agree from there on, up to the last piece of the earlier chunk, which its end may have cut.
Such a place is a proven boundary: tokens before it are counted in the earlier chunk, tokens from it on in
the later one. Where the overlap holds no such place, it is widened and the later chunk
encoded again, in the end with the whole earlier chunk.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from planloom.llm.words import parts, prefix_hashes, span_hashes

# Characters of a chunk and, at first, of its overlap with the one before.
CHUNK = 16384
OVERLAP = 256
# Texts of more characters are encoded in chunks.
HUGE = 2 * CHUNK
# Bytes of smaller texts that are worked on at a time.
TOGETHER = 1 << 20
# Spans of up to KNOWN_BYTES are counted once; each Python worker keeps the counts of KNOWN_SPANS, 12 bytes each, at most.
KNOWN_BYTES = 64
KNOWN_SPANS = 1 << 21


def _flags(*values: int) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(values)] = True
    return table


# Kinds of bytes. Characters that some definition counts as white space begin with the bytes C2, E1, E2, E3 and EF or are
# control characters; such characters are never taken for solid.
VISIBLE = _flags(*range(0x21, 0x7F))
LETTER = _flags(*range(0x41, 0x5B), *range(0x61, 0x7B))
DIGIT = _flags(*range(0x30, 0x3A))
PUNCTUATION = VISIBLE & ~LETTER & ~DIGIT
TAIL = _flags(*range(0x80, 0xC0))
LEADS_TWO = _flags(*range(0xC3, 0xE0))
LEADS_THREE = _flags(*range(0xE4, 0xEE))
LEADS = VISIBLE | LEADS_TWO | LEADS_THREE | _flags(*range(0xF0, 0xF5))
# Behind the byte C3 all characters are letters but these two, the signs of multiplication and division.
NO_LETTER = _flags(0x97, 0xB7)


def _before(values: np.ndarray, by: int = 1) -> np.ndarray:
    """What each place has `by` places before it."""
    return np.concatenate([np.zeros(by, dtype=values.dtype), values[:-by]])[: len(values)]


def piece_starts(data: np.ndarray) -> np.ndarray:
    """A flag for each byte of UTF-8 text: whether a piece of the usual pre-split certainly begins there.

    That is so of a single space between solid characters, a line feed behind one, what follows a single line feed between two, punctuation
    behind a letter, and a letter behind punctuation that can't begin a contraction. Each of these places can be told from the bytes around it,
    and the split of what follows depends on nothing before it.
    """
    tail, previous = TAIL[data], _before(data)
    ends = VISIBLE[data] | (tail & LEADS_TWO[previous]) | (tail & TAIL[previous] & LEADS_THREE[_before(data, 2)])
    begins = LEADS[data]
    latin = (previous == 0xC3) & tail & ~NO_LETTER[data]
    letter_ends = LETTER[data] | latin
    # A letter of two bytes begins one place before it ends.
    letter_begins = LETTER[data] | np.append(latin[1:], False)[: len(data)]
    behind = _before(ends)
    feed = data == 0x0A
    space = (data == 0x20) & behind & np.append(begins[1:], False)[: len(data)]
    line = begins & _before(feed & behind)
    mark = PUNCTUATION[data] & _before(letter_ends)
    word = letter_begins & _before(PUNCTUATION[data] & (data != 0x27))
    return space | (feed & behind) | line | mark | word


class TokenCounter:
    """Counts tokens as the library for a tokenizer file does, without added special tokens.

    `content` is the file, `name` tells by .json (tokenizers library) or .model (sentencepiece) what it is. Strings of special tokens inside texts
    are handled as the library does by default. Chunks and known spans are used where the tokenizer is byte-level with
    the usual pattern; texts are cut at special strings first. All other tokenizers encode texts whole.
    """

    def __init__(self, name: str, content: bytes, chunk: int = CHUNK, overlap: int = OVERLAP, huge: int = HUGE):
        self.chunk, self.overlap, self.huge = chunk, overlap, huge
        # Hashes of known spans, ascending, and their counts.
        self.known, self.known_counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)
        self.widened = 0
        self.splits = False
        if name.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=content)
            self.whole = lambda text: len(model.encode(text))
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(content.decode())
        self.model.no_truncation()
        self.model.no_padding()
        self.whole = lambda text: len(self.model.encode(text, add_special_tokens=False))
        rules = str(self.model.pre_tokenizer)
        added = self.model.get_added_tokens_decoder().values()
        self.splits = (
            self.model.normalizer is None
            and rules.startswith("ByteLevel(")
            and "add_prefix_space=False" in rules
            and "use_regex=True" in rules
            and not any(token.single_word or token.lstrip or token.rstrip for token in added)
        )
        # The longest of those that begin at a place is found.
        strings = sorted((str(token.content) for token in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, strings)).encode()) if strings else None

    def count(self, text: str) -> int:
        return int(self.counts([text.encode()])[0])

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """Tokens of UTF-8 texts."""
        result = np.zeros(len(texts), dtype=np.int64)
        together, size = [], 0
        for number, text in enumerate(texts):
            if not self.splits:
                result[number] = self.whole(text.decode())
            elif self.special is not None and (found := self.special.findall(text)):
                # A special string is one token, and texts are split on either side of it.
                result[number] = len(found) + self.counts(self.special.split(text)).sum()
            elif len(text) > self.huge and len(whole := text.decode()) > self.huge:
                result[number] = self._spliced(whole)
            else:
                if together and size + len(text) > TOGETHER:
                    result[together] = self._by_spans([texts[n] for n in together])
                    together, size = [], 0
                together.append(number)
                size += len(text)
        if together:
            result[together] = self._by_spans([texts[n] for n in together])
        return result

    def _by_words(self, text: str) -> int:
        return int(self._by_spans([text.encode()])[0])

    def _by_spans(self, texts: list[bytes]) -> np.ndarray:
        """Sums over spans that begin where pieces certainly do; equal ones are counted once."""
        joined = b"\n".join([*texts, b""])
        data = np.frombuffer(joined, dtype=np.uint8)
        after = np.cumsum([len(text) + 1 for text in texts]) - 1
        begin = np.append(0, after[:-1] + 1)
        flags = piece_starts(data)
        flags[begin] = True
        flags[after] = False
        starts = np.flatnonzero(flags)
        ends = np.append(starts[1:], len(data))
        first, last = np.searchsorted(starts, begin), np.searchsorted(starts, after)
        there = last > first
        ends[last[there] - 1] = after[there]
        counts = np.zeros(len(starts), dtype=np.int64)
        long = np.flatnonzero(ends - starts > KNOWN_BYTES)
        counts[long] = self._encoded_spans(joined, starts[long], ends[long])
        short = np.flatnonzero(ends - starts <= KNOWN_BYTES)
        if len(short):
            hashes = span_hashes(prefix_hashes(data), starts[short], ends[short])
            distinct, example, place = np.unique(hashes, return_index=True, return_inverse=True)
            counts[short] = self._known(joined, distinct, starts[short][example], ends[short][example])[place]
        total = np.append(0, np.cumsum(counts))
        return total[last] - total[first]

    def _encoded_spans(self, joined: bytes, starts: np.ndarray, ends: np.ndarray) -> list[int]:
        spans = [joined[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        counts = []
        for start in range(0, len(spans), 4096):
            counts += map(len, self.model.encode_batch_fast(spans[start : start + 4096], add_special_tokens=False))
        return counts

    def _known(self, joined: bytes, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Counts of distinct spans, given by ascending hashes; those not known yet are encoded and remembered."""
        counts = np.zeros(len(hashes), dtype=np.int64)
        new = np.ones(len(hashes), dtype=bool)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
            new = self.known[at] != hashes
            counts = np.where(new, 0, self.known_counts[at]).astype(np.int64)
        counts[new] = self._encoded_spans(joined, starts[new], ends[new])
        if len(self.known) + int(new.sum()) > KNOWN_SPANS:
            self.known, self.known_counts = self.known[:0], self.known_counts[:0]
        if new.any():
            known = np.concatenate([self.known, hashes[new]])
            order = np.argsort(known, kind="stable")[:KNOWN_SPANS]
            self.known = known[order]
            self.known_counts = np.concatenate([self.known_counts, counts[new].astype(np.int32)])[order]
        return counts

    def _encoded(self, text: str, start: int, end: int) -> tuple[list[int], list[int]]:
        """(place of the first character, number of tokens before) of each piece of text[start:end]."""
        encoding = self.model.encode(text[start:end], add_special_tokens=False)
        places, before, last = [], [], None
        for number, (piece, (first, _)) in enumerate(zip(encoding.word_ids, encoding.offsets, strict=True)):
            if piece != last:
                places.append(start + first)
                before.append(number)
                last = piece
        before.append(len(encoding.ids))
        return places, before

    def _spliced(self, text: str) -> int:
        total, start, end = 0, 0, min(len(text), self.chunk)
        places, before = self._encoded(text, start, end)
        # Tokens of the current chunk are counted from this piece on.
        first = 0
        while end < len(text):
            overlap = self.overlap
            new_end = min(len(text), end + self.chunk)
            while True:
                new_start = max(start, end - overlap)
                new_places, new_before = self._encoded(text, new_start, new_end)
                shared = set(new_places)
                found = next((n for n in range(first, len(places)) if places[n] >= new_start and places[n] in shared), None)
                if found is not None:
                    break
                # From `start` on the chunks agree at once, as both begin a piece there.
                self.widened += 1
                overlap *= 4
            total += before[found] - before[first]
            boundary = places[found]
            places, before, start, end = new_places, new_before, new_start, new_end
            first = places.index(boundary)
        return total + before[-1] - before[first]


_counters: dict[str, TokenCounter] = {}


def _count(batches: Iterator[pa.RecordBatch], name: str, content: Broadcast, names: list[str]) -> Iterator[pa.RecordBatch]:
    key = f"{name}:{hashlib.sha256(content.value).hexdigest()}"
    if key not in _counters:
        _counters[key] = TokenCounter(name, content.value)
    for batch in parts(batches):
        texts = [text or b"" for text in batch.column("text").cast(pa.binary()).to_pylist()]
        columns = [batch.column(name) for name in names]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(_counters[key].counts(texts), pa.int64())], [*names, "n_tokens"])


def counted(docs: DataFrame, tokenizer_path: str, *keep: str) -> DataFrame:
    """The columns of `docs` named in `keep`, and n_tokens, the tokens of its column text. A null text has none.

    The tokenizer's file is read here and its bytes are sent to the executors.
    """
    names = list(keep)
    rows = docs.select(*{name: None for name in [*names, "text"]}).withColumn("text", F.col("text").cast("string"))
    kinds = StructType([rows.schema[name] for name in names] + [StructField("n_tokens", LongType())])
    file = Path(tokenizer_path)
    content = docs.sparkSession.sparkContext.broadcast(file.read_bytes())
    return rows.mapInArrow(lambda batches: _count(batches, file.name, content, names), kinds)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens) for each row of `docs` (doc_id, text).

    The file must be at `tokenizer_path` on the driver. A null text counts as empty: no bytes, no tokens. Repeated
    rows and null doc_ids are rows as any other. Other columns are ignored. No shuffle: each text is counted where it is read.
    """
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long"), text.alias("text"), F.coalesce(F.octet_length(text).cast("long"), F.lit(0)).alias("n_bytes")
    )
    return counted(rows, tokenizer_path, "doc_id", "n_bytes").withColumn("over_limit", F.col("n_tokens") > limit)
