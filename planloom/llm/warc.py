"""WARC derivatives: metadata and plain-text conversion records for archived responses.

Each response gives a conversion record, which holds the page's text, and a metadata record, which holds its title, language, links and the HTTP headers and
digest of the source. Both refer to the response by WARC-Refers-To and to one another by WARC-Concurrent-To.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
END = "\r\n\r\n"

# Elements whose content isn't shown, and those that begin a line.
HIDDEN = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "noscript", "template", "svg", "iframe")}
BLOCKS = frozenset(
    "address article aside blockquote body br dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol"
    " option p pre section table tbody td tfoot th thead title tr ul".split()
)
NAME = re.compile(r"/?([a-z][a-z0-9]*)(?![\w-])", re.I)
TITLE_END = re.compile(r"</title", re.I)
LANG = re.compile(r"\blang\s*=\s*[\"']?([\w-]+)", re.I)
HREF = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
SPACE = re.compile(r"\s+")
CONTROL = re.compile(r"[\x00-\x1f\x7f]+")


@dataclass
class Page:
    """What a page shows and says: its text, a line for each block, its title, language and link targets as written."""

    text: str
    title: str | None
    language: str | None
    targets: list[str]


def read_page(page: str) -> Page:
    """One pass over a page's tags, whose time grows with its length however malformed it is.

    A tag is `<`, a letter or `/` and a letter, and all up to the next `>`; without one there are no more tags. Comments and hidden elements that
    never end go to the end of the page. The title is that of the first element of this name, the language that of the first that tells it.
    """
    shown, targets, title, language = [], [], None, None
    place, size, titled = 0, len(page), False
    while place < size:
        start = page.find("<", place)
        if start < 0:
            break
        shown.append(page[place:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            shown.append(" ")
            place = size if end < 0 else end + 3
            continue
        following = page[start + 1 : start + 3]
        letter = following[-1:] if following.startswith("/") else following[:1]
        if following[:1] not in ("!", "?") and not (letter.isascii() and letter.isalpha()):
            shown.append("<")
            place = start + 1
            continue
        end = page.find(">", start)
        if end < 0:
            # No more tags; only a comment can hide what is left.
            comment = page.find("<!--", start)
            shown.append(page[start:] if comment < 0 else page[start:comment])
            place = size
            break
        place = end + 1
        if following[:1] in ("!", "?"):
            shown.append(" ")
            continue
        named = NAME.match(page, start + 1, end)
        name, opens = named[1].lower() if named else "", following[0] != "/"
        if opens and name in HIDDEN:
            close = HIDDEN[name].search(page, place)
            place = close.end() if close else size
            shown.append(" ")
            continue
        if name in BLOCKS:
            shown.append("\0")
        if opens and name == "a" and (found := HREF.search(page, named.end(), end)):
            targets.append(found[1] or found[2] or found[3] or "")
        elif opens and name == "html" and language is None and (found := LANG.search(page, named.end(), end)):
            language = found[1]
        elif opens and name == "title" and not titled:
            # If this one has no end, later ones have none.
            titled, close = True, TITLE_END.search(page, place)
            title = page[place : close.start()] if close else None
    shown.append(page[place:])
    # White space of the source is one space, only blocks break lines. The mark for these is no character of a page.
    text = "".join(part if part == "\0" else SPACE.sub(" ", part.replace("\0", " ")) for part in shown)
    lines = (" ".join(line.split()) for line in html.unescape(text.replace("\0", "\n")).split("\n"))
    return Page("\n".join(line for line in lines if line), title, language, targets)


def page_text(page: str) -> str:
    """The visible text of an HTML page: a line for each block, white space collapsed, entities resolved."""
    return read_page(page).text


def page_links(page: str, base: str) -> list[str]:
    """Targets of the page's links in order, each once, resolved against its address."""
    return _resolved(read_page(page).targets, base)


def _resolved(targets: list[str], base: str) -> list[str]:
    found: dict[str, None] = {}
    for target in targets:
        target = _field(html.unescape(target))
        try:
            target = urljoin(base, target)
        except ValueError:
            pass
        if target:
            found[target] = None
    return list(found)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _field(value: str) -> str:
    """A value without control characters, so that it stays on its line."""
    return CONTROL.sub(" ", value).strip()


def _record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5('\0'.join(parts).encode(errors='replace')).digest())}>"


def responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records (page_id, record_id, target_uri, date, http_headers, payload) for the rows of `pages` (page_id, url, html).

    The record's id comes from all three columns, so it's the same in every run; repeated rows have one id.
    Null urls and pages are empty.
    """
    url, page = F.coalesce(F.col("url").cast("string"), F.lit("")), F.coalesce(F.col("html").cast("string"), F.lit(""))
    name = F.md5(F.to_json(F.struct(F.col("page_id").cast("string").alias("i"), url.alias("u"), page.alias("h"))))
    parts = [F.substring(name, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    headers = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(page).cast("string")
    )
    return pages.select(
        F.col("page_id").cast("long"),
        F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">")).alias("record_id"),
        url.alias("target_uri"),
        F.lit(date).alias("date"),
        headers.alias("http_headers"),
        page.alias("payload"),
    )


RECORDS = (
    "page_id long, warc_type string, record_id string, refers_to string, concurrent_to string, target_uri string, date string,"
    " source_digest string, block_digest string, content_length long, headers string, block string"
)


def _derived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [part.split()[0] for part in RECORDS.split(",")]
    kinds = [pa.int64() if part.split()[1] == "long" else pa.string() for part in RECORDS.split(",")]
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            rows += _records(**row)
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names
            )


def _records(page_id, record_id, target_uri, date, http_headers, payload) -> list[tuple]:
    target, date, page = _field(target_uri or ""), _field(date or ""), payload or ""
    record_id, source = _field(record_id or ""), digest(page.encode())
    conversion_id, metadata_id = _record_id("conversion", record_id, source), _record_id("metadata", record_id, source)
    read = read_page(page)
    fields = []
    if read.title is not None:
        fields.append(("title", page_text(read.title).replace("\n", " ")))
    if read.language is not None:
        fields.append(("language", read.language))
    fields.append(("source-payload-digest", source))
    fields += [("source-http-header", _field(line)) for line in (http_headers or "").split("\r\n") if line.strip()]
    fields += [("outlink", link) for link in _resolved(read.targets, target)]
    blocks = (
        ("conversion", conversion_id, metadata_id, "text/plain; charset=utf-8", read.text),
        ("metadata", metadata_id, conversion_id, "application/warc-fields",
         "".join(f"{name}: {_field(value)}\r\n" for name, value in fields)),
    )
    out = []
    for kind, own, other, content, block in blocks:
        data = block.encode()
        headers = [
            ("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", record_id), ("WARC-Concurrent-To", other),
            ("WARC-Target-URI", target), ("WARC-Date", date), ("WARC-Block-Digest", digest(data)),
            ("Content-Type", content), ("Content-Length", str(len(data))),
        ]
        text = VERSION + "".join(f"\r\n{name}: {value}" for name, value in headers if value)
        out.append((page_id, kind, own, record_id, other, target, date, source, digest(data), len(data), text, block))
    return out


def derivatives(archive: DataFrame) -> DataFrame:
    """A conversion and a metadata record for each row of `archive`, the columns of RECORDS.

    `archive` has page_id, record_id, target_uri, date, http_headers (lines ended by CR LF) and payload; other columns are ignored.
    Null values are empty; empty headers are left out of the record. An empty page gives a conversion
    record of length 0. Control characters in addresses and header values become spaces. Repeated rows
    give records with the same ids. No shuffle: each response is converted where it is read.
    """
    columns = ("record_id", "target_uri", "date", "http_headers", "payload")
    rows = archive.select(F.col("page_id").cast("long"), *(F.col(name).cast("string") for name in columns))
    return rows.mapInArrow(_derived, RECORDS)


def write_warc(records: DataFrame, path: str) -> None:
    """Writes `records` as gzipped WARC files, one for each partition, wherever Spark can write.

    Each file is one gzip stream, to be read from its beginning: there is no random access to records.
    """
    record = F.concat("headers", F.lit(END), "block")
    records.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)
