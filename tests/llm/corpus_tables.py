"""Small tables with every odd case, and readers for results."""

from __future__ import annotations

import random
import zlib

import pyarrow as pa
import pyarrow.parquet as pq

# Names that the operators use themselves.
CLASHING = ("component_id", "kept", "key", "doc", "rule", "slot", "stream", "n_tokens", "bucket", "label", "labelled", "text_hash")


def words(rng: random.Random, count: int, kinds: int = 400) -> list[str]:
    return [f"w{rng.randrange(kinds)}" + rng.choice(["", "é", ".", "x" * rng.randrange(9)]) for _ in range(count)]


def document_rows(seed: int = 1) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): unrelated, near and exact copies, shared passages, repeats, junk, nulls, empties."""
    rng = random.Random(seed)
    texts: list[str | None] = []
    for _ in range(25):
        texts.append(" ".join(words(rng, rng.randrange(5, 220))))
    base = words(rng, 150)
    for _ in range(20):
        copy = list(base)
        for _ in range(rng.randrange(0, 12)):
            copy[rng.randrange(len(copy))] = rng.choice(words(rng, 3))
        texts.append(" ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    passage = " ".join(words(rng, 70))
    for _ in range(10):
        texts.append(" ".join(words(rng, rng.randrange(0, 60))) + " " + passage + "\n" + " ".join(words(rng, 20)))
    texts += [texts[3]] * 4
    line = " ".join(words(rng, 12))
    texts.append("\n".join([line] * 30))
    texts.append("a" * 900)
    texts.append("ab" * 300 + "é" * 200)
    texts.append(" ".join(f"{w}$$$ ###" for w in words(rng, 60)))
    texts.append(" | ".join(words(rng, 60)))
    texts.append("\n\n".join(" ".join(words(rng, 30)) for _ in range(400)))
    texts += [None, "", " \t\n\x0b ", "one", "One", "two words", "x\x00y \U0001f642 漢字 z", "tie", "tie"]
    rows = [
        (n, text, "en", None if n % 17 == 5 else f"s{0 if n % 3 == 0 else n % 7}", None if text is None else len(text))
        for n, text in enumerate(texts)
    ]
    rows.append(rows[2])
    rows.append(rows[2])
    rows += [(None, texts[7], None, None, None), (None, None, None, None, None), (None, texts[7], None, "s1", 3)]
    rng.shuffle(rows)
    return rows


DOCUMENTS = pa.schema([
    ("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())
])
LABELS = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())])


def documents_table(rows: list[tuple], clashing: bool = True) -> pa.Table:
    table = pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, DOCUMENTS, strict=True)], DOCUMENTS)
    for name in CLASHING if clashing else ():
        table = table.append_column(name, pa.array(["own"] * len(rows), pa.string()))
    return table


def folder(path, rows: list[tuple], labels: list[tuple] = (), clashing: bool = True) -> str:
    pq.write_table(documents_table(rows, clashing), path / "documents.parquet")
    columns = list(zip(*labels, strict=True)) if labels else [[], [], []]
    table = pa.table([pa.array(c, f.type) for c, f in zip(columns, LABELS, strict=True)], LABELS)
    pq.write_table(table.append_column("text", pa.array(["own"] * len(labels), pa.string())), path / "labels.parquet")
    return str(path)


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def rows_of(frame) -> list[dict]:
    return frame.toArrow().to_pylist()


def library_counts(texts):
    """Tokens of each text as the tokenizer's own library counts them."""
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    return [len(model.encode(text or "", add_special_tokens=False).ids) for text in texts]
