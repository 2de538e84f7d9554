"""WARC derivatives: metadata and plain-text conversion records from responses.

Each response gives two records.  The metadata record (application/warc-fields) keeps the source's HTTP header, its
record id, digests and length, and lists the page's title, declared language and links.  The conversion record
(text/plain) holds the readable text.  Both name the response in WARC-Refers-To (the metadata record in
WARC-Concurrent-To too), its target URI and date, and carry digests of their own blocks.  Identifiers are derived
from the response's identifier, so that a second run, or a task that runs again, gives the same ones.

Defined cases.  A response without payload (null) is taken as an empty one: an empty text, no title.  Without a
target URI the header is left out.  A response without date takes ``DATE``.  Repeated responses give repeated,
equal records.  Very long pages are read whole, in linear time whatever their markup (:func:`read_page`).  An empty
table gives no rows.  Only the columns named are read, whatever the others are called.  Digests, charset and bytes of
responses that are read from WARC files (:func:`responses`) are those of the source.  A task holds a batch of pages, or a
file and its records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DATE = "1970-01-01T00:00:00Z"
_SPACE_ID = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space
#: Elements whose text is not shown.  Without their end the first two take the rest of the page, as in a browser; of
#: the others only the tag goes.
_RAW, _UNSEEN = ("script", "style"), ("noscript", "template", "svg")
_END = {x: re.compile(rf"</{x}\s*+>", re.I) for x in (*_RAW, *_UNSEEN, "title")}
_BLOCKS = frozenset("address article aside blockquote br dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)|<(?=[!?])|<(?=/[a-zA-Z])")
#: What follows a tag's name, up to its ``>``; quoted values may hold one.  Possessive, so that nothing is tried twice.
_REST = re.compile(r"""((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")
_LANG = re.compile(r"[\w-]+")

FIELDS = "page_id long, record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, content_length long, block_digest string, source_payload_digest string, source_header string, block string"


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def one_line(text: str) -> str:
    return " ".join(html.unescape(text).split())


def _attribute(tag: str, name: str) -> str | None:
    """The first value of ``name`` among a tag's attributes."""
    for m in _ATTRIBUTE.finditer(tag):
        if m[1].lower() == name:
            return next((x for x in m.groups()[1:] if x is not None), None)
    return None


def read_page(page: str) -> tuple[str, str | None, str | None, list[str]]:
    """(text, title, language, links) of a page, read once from left to right.

    The text has a line for each block element, without comments and elements that show no text.  A head that is not
    closed ends at ``<body>`` or the first block element; what is not its title stays.  A tag that never ends is text,
    with all that follows.  The work is linear in the page: an end that was missing once is not looked for again.
    """
    out: list[str] = []
    head: list[str] | None = None  # what an open head holds beside its title
    title = lang = None
    links: list[str] = []
    endless: set[str] = set()
    at, n = 0, len(page)
    while at < n:
        m = _OPEN.search(page, at)
        if m is None:
            break
        (out if head is None else head).append(page[at : m.start()])
        name = (m[2] or "").lower()
        if page.startswith("!--", m.start() + 1):
            end = page.find("-->", m.start() + 4)
            at = n if end < 0 else end + 3
            (out if head is None else head).append(" ")
            continue
        rest = _REST.match(page, m.end())
        if rest is None:
            if name in _RAW and not m[1]:
                at = n
                break
            at = m.start()
            break
        at = rest.end()
        if m[1]:
            if name == "head" and head is not None:
                head = None
                out.append(" ")
            elif name in _BLOCKS:
                if head is not None:
                    out.extend(head)
                    head = None
                out.append("\n")
            continue
        if name == "a":
            href = _attribute(rest[1], "href")
            if href is not None:
                links.append(href)
        elif name == "html" and lang is None:
            found = _LANG.match(_attribute(rest[1], "lang") or "")
            lang = found[0] if found else None
        elif name in _END:
            end = None if name in endless or rest[1].endswith("/") and name == "svg" else _END[name].search(page, at)
            if end is None and not (name == "svg" and rest[1].endswith("/")):
                endless.add(name)
            if name == "title":
                if end is not None:
                    title = page[at : end.start()] if title is None else title
                    if head is None:
                        out.append(page[at : end.start()])
                    at = end.end()
            else:
                (out if head is None else head).append(" ")
                if end is not None and name in _UNSEEN:  # its links count; it holds no end of its own, so this goes three deep at most
                    links += read_page(page[at : end.start()])[3]
                at = end.end() if end is not None else n if name in _RAW else at
        elif name == "head" and head is None:
            head = []
        elif name == "body" or name in _BLOCKS:
            if head is not None:
                out.extend(head)
                head = None
            if name != "body":
                out.append("\n")
    if head is not None:
        out.extend(head)
    text = "".join([*out, page[at:]])
    if "&" in text:
        text = html.unescape(text)
    return "\n".join(x for x in (" ".join(line.split()) for line in text.split("\n")) if x), title, lang, links


def plain_text(page: str) -> str:
    """The readable text of a page, a line for each block element."""
    return read_page(page)[0]


def page_responses(pages: DataFrame, header: str = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n") -> DataFrame:
    """Response rows (page_id, record_id, target_uri, warc_date, http_header, payload) of raw pages."""
    url, body = F.col("url").cast("string"), F.col("html").cast("string")
    own = F.md5(F.concat_ws("\n", F.col("page_id").cast("string"), F.coalesce(url, F.lit("")), F.sha1(F.coalesce(body, F.lit("")))))
    dashed = F.regexp_replace(own, "^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-3$3-8$4-$5")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">")).alias("record_id"), url.alias("target_uri"), F.lit(DATE).alias("warc_date"), F.lit(header).alias("http_header"), body.alias("payload"))


_CHARSET = re.compile(r"^content-type\s*:[^\r\n]*?charset\s*=\s*[\"']?([\w.:-]+)", re.I | re.M)


def decoded(payload: bytes, http_header: str | None) -> str:
    """The payload's text, in the charset that its header names, else in UTF-8; what that doesn't read, in Latin-1."""
    named = _CHARSET.search(http_header or "")
    for charset in (named.group(1) if named else "utf-8", "utf-8"):
        try:
            return payload.decode(charset)
        except (LookupError, ValueError):
            continue
    return payload.decode("latin-1")


def derive_one(record_id: str, target_uri: str | None, payload: str | bytes | None, http_header: str | None, payload_digest: str | None = None, block_digest: str | None = None) -> tuple[str, str, str]:
    """Of one response: its payload's digest, the metadata block and the conversion block.

    Digests that the source gives are kept as they are; missing ones are computed from its bytes.
    """
    head = http_header or ""
    page = decoded(payload, head) if isinstance(payload, bytes) else payload or ""
    body = payload if isinstance(payload, bytes) else page.encode("utf-8", "surrogatepass")
    payload_digest = payload_digest or digest(body)
    text, title, lang, links = read_page(page)
    fields = [("source-record-id", record_id), ("source-payload-digest", payload_digest), ("source-block-digest", block_digest or digest(head.encode() + b"\r\n" + body)), ("source-payload-length", str(len(body)))]
    fields += [("source-header", line) for line in head.split("\r\n") if line]
    fields += [("title", one_line(title))] if title is not None else []
    fields += [("language", lang)] if lang else []
    fields += [("outlink", one_line(x)) for x in links]
    return payload_digest, "".join(f"{k}: {v}\r\n" for k, v in fields), text


_READ = ("page_id", "record_id", "target_uri", "warc_date", "http_header", "payload")
_GIVEN = ("payload_digest", "block_digest")


def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(12)]
        for page_id, rid, uri, date, head, payload, *given in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            payload_digest, meta, text = derive_one(rid, uri, payload, head, *given)
            for kind, block, mime in (("metadata", meta, "application/warc-fields"), ("conversion", text, "text/plain; charset=utf-8")):
                raw = block.encode("utf-8", "surrogatepass")
                new = f"<urn:uuid:{uuid.uuid5(_SPACE_ID, f'{kind} of {rid}')}>"
                for col, v in zip(out, (page_id, kind, new, rid, uri, date or DATE, mime, len(raw), digest(raw), payload_digest, head, block), strict=True):
                    col.append(v)
        ints = (0, 7)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i in ints else pa.string()) for i, c in enumerate(out)], [f.split()[0] for f in FIELDS.split(", ")])


def derive(responses: DataFrame) -> DataFrame:
    """Two rows a response, with the columns of ``FIELDS``; payloads are strings or, as :func:`responses` gives them, bytes."""
    given = _GIVEN if {*_GIVEN} <= {*responses.columns} and responses.schema["payload"].dataType.simpleString() == "binary" else ()
    return responses.select(*_READ, *given).mapInArrow(_derive, FIELDS)


def record_bytes(row: dict) -> bytes:
    """The WARC/1.1 record of one row of :func:`derive`, as a gzip member."""
    block = row["block"].encode("utf-8", "surrogatepass")
    head = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", row["warc_date"]), ("WARC-Refers-To", row["refers_to"])]
    head += [("WARC-Concurrent-To", row["refers_to"])] if row["record_type"] == "metadata" else []
    head += [("WARC-Target-URI", row["target_uri"].replace("\r", "%0D").replace("\n", "%0A"))] if row["target_uri"] is not None else []
    head += [("WARC-Block-Digest", row["block_digest"]), ("WARC-Source-Payload-Digest", row["source_payload_digest"]), ("Content-Type", row["content_type"]), ("Content-Length", str(len(block)))]
    return gzip.compress(b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n", mtime=0)


def serialize(derived: DataFrame) -> DataFrame:
    """(page_id, record_type, record): each record as bytes, which files hold one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("record_type"), pa.array([record_bytes(r) for r in rows], pa.binary())], ["page_id", "record_type", "record"])

    return derived.mapInArrow(run, "page_id long, record_type string, record binary")


def responses(files: DataFrame) -> DataFrame:
    """Response rows, as :func:`derive` takes them, of the WARC files in ``files`` (path, content: as ``binaryFile`` reads).

    Payloads stay bytes, and the records' own digests come along.  A file's records are numbered from 0 in ``page_id``.
    Records of other types are passed over.  A task holds a file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*_READ, *_GIVEN]
        kinds = [pa.int64(), *[pa.string()] * 4, pa.binary(), pa.string(), pa.string()]
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for i, (fields, block) in enumerate(parse(content.as_py()) if content.is_valid else []):
                    named = {k.lower(): v for k, v in fields.items()}
                    if named.get("warc-type") == "response":
                        head, gap, body = block.partition(b"\r\n\r\n")
                        text = (head + b"\r\n" if gap else head).decode("utf-8", "replace")
                        rows.append((i, named.get("warc-record-id"), named.get("warc-target-uri"), named.get("warc-date"), text, body, named.get("warc-payload-digest"), named.get("warc-block-digest") or digest(block)))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    schema = "page_id long, record_id string, target_uri string, warc_date string, http_header string, payload binary, payload_digest string, block_digest string"
    return files.select("content").mapInArrow(run, schema)


def parse(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """Headers and block of each record in the bytes of a WARC file (1.0 or 1.1, gzipped or not), in linear time."""
    raw, out, at = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data, [], 0
    while at < len(raw):
        gap = raw.find(b"\r\n\r\n", at)
        lines = raw[at : gap if gap >= 0 else len(raw)].decode("utf-8", "replace").split("\r\n")
        if gap < 0 or lines[0] not in ("WARC/1.0", "WARC/1.1"):
            raise ValueError("not a WARC/1.0 or WARC/1.1 record")
        fields: dict[str, str] = {}
        last = ""
        for line in lines[1:]:
            if line[:1] in " \t" and last:  # a folded line goes on with the one before
                fields[last] += " " + line.strip()
            elif ":" in line:
                last, _, value = line.partition(":")
                fields[last] = value.strip()
        n = int(next(v for k, v in fields.items() if k.lower() == "content-length"))
        at = gap + 4 + n
        if raw[at : at + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        out.append((fields, raw[gap + 4 : at]))
        at += 4
    return out
