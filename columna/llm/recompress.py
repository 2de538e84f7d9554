"""Substring deduplication by recompression.

Every document's words are a string of symbols that is compressed in rounds.  A round names maximal runs of a symbol
(``a a a`` becomes one symbol) and then pairs: a bit of each symbol's fingerprint says left or right, and a left one
with a right one behind it becomes one symbol.  Names are fingerprints of the round and of what is named, so all tasks
of Spark give the same run or pair the same name, and equal substrings get the same symbols but for a few at their ends
(numbers dealt by a join a round would shuffle every symbol in every round).  A symbol carries the words that it covers
and the words on which its making depended.

Symbols are then looked up over the whole corpus: each task sends each name that it saw once, with a second
fingerprint of the covered words, which verifies the first, and the first document that has it.  What comes back to a
document is which of its symbols it is the first to have, and which nobody else has.

* A symbol of ``window`` words or more that occurs earlier: every window inside repeats.
* A symbol that occurs once in the corpus: no window that holds it, and all on which its making depended, repeats.
* The windows left (ends of repeats, mostly) are looked up in the same way, by fingerprints of their words.

What bounds a task's memory: names are pre-aggregated in runs of ``RUN`` records, so that a name that a third of all
documents have is sent once a run; lookups and documents are dealt to buckets by hash, so many that each holds
``bucket_bytes`` of text or what comes of it.  What a task has freed it gives back to the system, as Spark keeps its
Python workers, and beside them the next tasks may run in others.  Documents are read in pieces of 1 MB; a longer text is a piece of its
own.  Nothing but three numbers comes to the driver.

Defined cases.  A null text has no words.  Documents are ordered by doc_id (null last), then by a hash of the text:
of two texts with the same doc_id the one with the smaller hash is the earlier.  Rows equal in doc_id and text are one
document given several times: they repeat nothing of each other, and each gives its row.  They are counted where they lie and
made again at the end, so that a third of the table being one row meets in no task.  A text of fewer than ``window`` words keeps all of
them.  An empty table gives no rows.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import each_copy, give_back, giving_back, hashes_of, keep, mix, pieces, release, word_bounds

_U = np.uint64
_FAR = 1 << 30
#: Symbols of so many words or more, made of smaller ones, are looked up to rule windows out.
LEAST = 4
#: Runs are named in the first round and from this round on; between them pairs alone keep what a symbol depends on short.
RUNS_FROM = 6
#: Records that a task holds before it aggregates and sends them.
RUN = 1 << 20
_LEFT, _RIGHT, _BASE = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), 0xD6E8FEB86659FD93
_BACK = pow(_BASE, -1, 1 << 64)


class Symbols:
    """Symbols made in a piece: name, first word and end, the words it depends on, and whether it is ``window`` words or longer."""

    def __init__(self, words: np.ndarray, row: np.ndarray, window: int) -> None:
        self.window = window
        self._made: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.uint64), *[np.zeros(0, np.int32)] * 4)]
        with np.errstate(over="ignore"):
            self._compress(words, row.astype(np.int32))
        self.name, self.start, self.end, self.low, self.high = (np.concatenate(c) for c in zip(*self._made, strict=True))
        self.long = self.end - self.start >= window

    def _found(self, at, name, start, end, low, high, parts) -> None:
        size = end[at] - start[at]
        use = at[(size >= self.window) | ((size >= LEAST) & (parts < LEAST) & (high[at] - low[at] <= self.window))]
        if len(use):
            self._made.append((name[use], start[use], end[use], low[use], high[use]))

    def _compress(self, name: np.ndarray, d: np.ndarray) -> None:
        start = np.arange(len(name), dtype=np.int32)
        end, low, high = start + np.int32(1), start, start + np.int32(1)
        for r in range(96):
            if len(name) < 2:
                return
            near = d[1:] == d[:-1]  # neighbours of one document
            before, after = np.full(len(name), -_FAR, np.int32), np.full(len(name), _FAR, np.int32)
            before[1:][near], after[:-1][near] = low[:-1][near], high[1:][near]
            if r == 0 or r >= RUNS_FROM:
                # Whether a symbol is a run, and how long, depends on what stands on both sides.
                low, high = before, after
                same = near & (name[1:] == name[:-1])
                if same.any():
                    first = np.flatnonzero(np.concatenate(([True], ~same)))
                    many = np.diff(np.append(first, len(name)))
                    last, run = first + many - 1, np.flatnonzero(many > 1)
                    one = (end - start)[first[run]]
                    name, d, start, end, low, high = name[first], d[first], start[first], end[last], low[first], high[last]
                    name[run] = mix(name[run] * _RIGHT + many[run].astype(np.uint64) + _U(2 * r + 1))
                    self._found(run, name, start, end, low, high, one)
                    near = d[1:] == d[:-1]
                before, after = np.full(len(name), -_FAR, np.int32), np.full(len(name), _FAR, np.int32)
                before[1:][near], after[:-1][near] = low[:-1][near], high[1:][near]
            # A name is a mixed fingerprint, so each round takes another bit of it.
            right = (name >> _U(r & 63)).astype(np.uint8) & 1 == 1
            pair = near & right[1:]
            pair &= ~right[:-1]
            a = np.flatnonzero(pair)
            first, second = np.zeros(len(name), bool), np.zeros(len(name), bool)
            first[a], second[a + 1] = True, True
            # A left symbol stays alone because of what follows it, a right one because of what precedes it.
            high = np.where(right | first, high, after)
            low = np.where(right & ~second, before, low)
            if len(a):
                b = a + 1
                name = name.copy() if r == 0 else name
                name[a] = mix(name[a] * _LEFT + name[b] + _U(2 * r + 2))
                parts = np.maximum(end[a] - start[a], end[b] - start[b])
                end[a], high[a] = end[b], high[b]
                self._found(a, name, start, end, low, high, parts)
            stay = ~second
            if r % 4 == 3:  # documents that have become one symbol are done
                kept = np.flatnonzero(stay)
                e = d[kept]
                lone = np.ones(len(e), bool)
                lone[1:] &= e[1:] != e[:-1]
                lone[:-1] &= e[1:] != e[:-1]
                stay[kept[lone]] = False
            name, d, start, end, low, high = name[stay], d[stay], start[stay], end[stay], low[stay], high[stay]


class Prints:
    """Fingerprints of any run of a piece's words, from running sums."""

    def __init__(self, words: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            power = np.full(len(words) + 1, _U(_BASE))
            power[0] = 1
            power = np.multiply.accumulate(power)
            back = np.full(len(words) + 1, _U(_BACK))
            back[0] = 1
            self.back = np.multiply.accumulate(back)
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(words + _RIGHT) * power[:-1])))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64) * _LEFT)


_RECORD = np.dtype([("name", "<u8"), ("check", "<u4"), ("doc", "<i8"), ("mark", "<u4"), ("more", "u1")])


def _first(records: np.ndarray) -> np.ndarray:
    """Of each name the record of the first document, with ``more`` set if there are several occurrences."""
    records = records[np.argsort(records["name"])]
    same = records["name"][1:] == records["name"][:-1]
    if (records["mark"].any() or (records["check"][1:] != records["check"][:-1])[same].any()) and same.any():
        records = records[np.lexsort((records["mark"], records["doc"], records["check"], records["name"]))]
        same = (records["name"][1:] == records["name"][:-1]) & (records["check"][1:] == records["check"][:-1])
    first = np.flatnonzero(np.concatenate(([len(records) > 0], ~same)))
    if not len(first):
        return records
    out = records[first]
    if not records["mark"].any():
        out["doc"] = np.minimum.reduceat(records["doc"], first)
    out["more"] = np.maximum(np.maximum.reduceat(records["more"], first), np.diff(np.append(first, len(records))) > 1)
    return out


def _pack(records: np.ndarray) -> bytes:
    """Byte by byte of all records, as the high bytes of numbers, mostly alike, then compress well."""
    return records.view(np.uint8).reshape(len(records), -1).T.tobytes()


def _unpack(blobs: pa.ChunkedArray, kind: np.dtype) -> np.ndarray:
    got = [np.ascontiguousarray(np.frombuffer(b.as_buffer(), np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel() for b in blobs]
    return np.concatenate(got) if got else np.zeros(0, kind)


def _dealt(bucket: np.ndarray, records: np.ndarray, size: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """(b, data): the records of each bucket."""
    by = np.argsort(bucket, kind="stable")
    bucket, records = bucket[by], records[by]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(cuts[1:], len(bucket))
    for at in range(0, len(cuts), size):
        some = slice(at, at + size)
        data = [_pack(records[a:b]) for a, b in zip(cuts[some].tolist(), ends[some].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[some]], pa.int64()), pa.array(data, pa.binary())], ["b", "data"])


def _home(doc: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """A document's key, by which it meets what is found out about it."""
    with np.errstate(over="ignore"):
        return mix(mix(doc.astype(np.uint64) * _LEFT) + mark.astype(np.uint64))


def _token(name: np.ndarray, check: np.ndarray, home: np.ndarray) -> np.ndarray:
    """A name within a document."""
    with np.errstate(over="ignore"):
        return mix(mix(name + check.astype(np.uint64) * _RIGHT) ^ home)


class _Looked:
    """Which (doc, name) are first, or alone, as sent back to a bucket of documents."""

    KIND = np.dtype([("token", "<u8"), ("more", "u1")])

    def __init__(self, table: pa.Table) -> None:
        got = _unpack(table.column("data"), self.KIND)
        self.tokens = np.sort(got["token"])
        self.alone = np.sort(got["token"][got["more"] == 0])

    @staticmethod
    def _has(known: np.ndarray, asked: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.zeros(len(asked), bool)
        return known[np.minimum(np.searchsorted(known, asked), len(known) - 1)] == asked

    def first(self, tokens: np.ndarray) -> np.ndarray:
        return self._has(self.tokens, tokens)

    def lone(self, tokens: np.ndarray) -> np.ndarray:
        return self._has(self.alone, tokens)


def _records(name: np.ndarray, check: np.ndarray, doc: np.ndarray, mark: np.ndarray) -> np.ndarray:
    out = np.zeros(len(name), _RECORD)
    out["name"], out["check"], out["doc"], out["mark"] = name, check, doc, mark
    return out


def _check(prints: np.ndarray) -> np.ndarray:
    """32 bits of a second fingerprint, never 0."""
    return (prints >> _U(32)).astype(np.uint32) | np.uint32(1)


def _sent(found: Iterator[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """Records in runs, each aggregated, by buckets of names."""
    held: list[np.ndarray] = []

    def joined() -> np.ndarray:
        out = np.concatenate(held)
        held.clear()  # before they are sorted, as they are as large again
        return out

    def run() -> Iterator[pa.RecordBatch]:
        some = _first(joined())
        yield from _dealt((mix(some["name"]) % _U(buckets)).astype(np.int64), some)

    for records in found:
        held.append(records)
        del records
        if sum(map(len, held)) >= RUN:
            yield from run()
    if held:
        yield from run()
    give_back()


def _looked_up(names: DataFrame, buckets: int) -> DataFrame:
    """(b, data): to each bucket of documents the names that they are the first to have."""

    def owners(table: pa.Table) -> pa.Table:
        got = _first(_unpack(table.column("data"), _RECORD))
        got = got[(got["more"] == 0) | (got["check"] > 0)]  # of a small symbol only that nobody else has it matters
        home = _home(got["doc"], got["mark"])
        back = np.zeros(len(got), _Looked.KIND)
        back["token"], back["more"] = _token(got["name"], got["check"], home), got["more"]
        return pa.Table.from_batches(_dealt((home % _U(buckets)).astype(np.int64), back), pa.schema([("b", pa.int64()), ("data", pa.binary())]))

    return names.groupBy("b").applyInArrow(lambda t: giving_back(owners, t), "b long, data binary")


class _Piece:
    """A piece of documents: words, and for each symbol or window its document."""

    def __init__(self, texts: pa.Array, doc: np.ndarray, mark: np.ndarray) -> None:
        self.chars, self.starts, self.lengths, self.row = word_bounds(texts, lower=False)
        self.words = hashes_of(self.chars, self.starts, self.lengths)
        self.ends = np.searchsorted(self.row, np.arange(len(texts) + 1))
        self.doc, self.mark, self.home = doc, mark, _home(doc, mark)
        self.prints = Prints(self.words)

    def inside(self, window: int) -> np.ndarray:
        """Where windows begin: their last word is of the same document."""
        n = len(self.words)
        fits = np.zeros(n, bool)
        if n >= window:
            fits[: n - window + 1] = self.row[: n - window + 1] == self.row[window - 1 :]
        return fits

    def symbols(self, window: int) -> tuple[Symbols, np.ndarray, np.ndarray]:
        """Symbols, their checks (0 for small ones, which can't remove anything), and the documents where they are."""
        s = Symbols(self.words, self.row, window)
        check = np.zeros(len(s.name), np.uint32)
        check[s.long] = _check(self.prints.of(s.start[s.long], s.end[s.long]))
        return s, check, self.row[s.start]

    def windows(self, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Names and checks of the windows that begin there."""
        check = _check(self.prints.of(at, at + window))
        with np.errstate(over="ignore"):
            name = np.zeros(len(at), np.uint64)
            for j in range(window):
                name = (name + self.words[at + j]) * _LEFT
                name ^= name >> _U(29)
        return mix(name), check

    def kept(self, gone: np.ndarray) -> list[bytes]:
        """Each document's words that stay, joined by a blank."""
        out, size = np.full(len(self.chars) + len(self.starts), 32, np.uint8), self.lengths + 1
        word = np.repeat(np.arange(len(self.starts)), self.lengths)
        out[np.arange(len(self.chars)) + word] = self.chars
        size = np.where(gone, 0, size)
        out = out[np.repeat(~gone, self.lengths + 1)]
        cuts = np.concatenate(([0], np.cumsum(size)))[self.ends]
        return [out[a : b - 1].tobytes() if b > a else b"" for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def _spread(begins: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Places that lie in any of the ranges [begin, end)."""
    some = begins < ends
    change = np.bincount(begins[some], minlength=n + 1) - np.bincount(ends[some], minlength=n + 1)
    return np.cumsum(change[:-1]) > 0


def _pieces_of(table: pa.Table | pa.RecordBatch) -> Iterator[tuple[int, int, _Piece]]:
    texts = table.column("text")
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    doc, mark = np.asarray(table.column("doc")), np.asarray(table.column("mark")).astype(np.uint32)
    for at, part in pieces(texts):
        to = at + len(part)
        yield at, to, _Piece(part, doc[at:to], mark[at:to])


#: Bytes of documents that a task holds before it compresses and sends them.
HELD = 24_000_000
_DOC = pa.schema([("doc", pa.int64()), ("mark", pa.int64()), ("missing", pa.bool_()), ("text", pa.large_string()), ("copies", pa.int64())])
_BITS = pa.schema([("settled", pa.binary()), ("open", pa.binary())])
_OUT = {"doc": pa.int64(), "mark": pa.int64(), "missing": pa.bool_(), "copies": pa.int64(), "n_words": pa.int64(), "removed": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "kept": pa.string()}
_OUT_SQL = "doc long, mark long, missing boolean, copies long, n_words long, removed array<struct<start:long,end:long>>, kept string"


def _result(piece: _Piece, gone: np.ndarray, texts: bool) -> tuple[list[int], list[list[dict]], list[str]]:
    """For each document its number of words, the ranges of words removed, and what is kept (or its SHA-256)."""
    kept = piece.kept(gone)
    edge = np.diff(np.concatenate(([False], gone, [False])).astype(np.int8))
    spans: list[list[dict]] = [[] for _ in kept]
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        while a < b:  # a range of two documents' words is cut between them
            d = piece.row[a]
            to = min(b, int(piece.ends[d + 1]))
            spans[d].append({"start": a - int(piece.ends[d]), "end": to - int(piece.ends[d])})
            a = to
    return np.diff(piece.ends).tolist(), spans, [k.decode() if texts else hashlib.sha256(k).hexdigest() for k in kept]


def substring_dedup(docs: DataFrame, window: int = 20, texts: bool = True, bucket_bytes: int = 16_000_000) -> DataFrame:
    """doc_id, n_words, n_removed, removed (ranges of words), kept (words joined by a blank; without ``texts`` its SHA-256).

    A word is removed if a run of ``window`` words that holds it also starts earlier: in an earlier document, or
    earlier in its own.
    """
    text, missing = F.col("text").cast("string"), F.col("doc_id").isNull()
    known = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc")
    rows = docs.select(known, F.shiftrightunsigned(F.xxhash64(text, missing, text.isNull()), 32).alias("mark"), missing.alias("missing"), text.alias("text"))
    ids = rows.groupBy("doc").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 64).alias("size"))
    size, most = ids.agg(F.sum("size"), F.max("n")).first()
    size = size or 0
    if (most or 0) < 2:  # no two rows share a doc_id
        rows = rows.withColumn("mark", F.lit(0).cast("long"))
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    homes, names = max(least, -(-size // bucket_bytes)), max(least, -(-size // (2 * bucket_bytes)))

    def symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[np.ndarray]:
            for batch in batches:
                for _, _, piece in _pieces_of(batch):
                    s, check, of = piece.symbols(window)
                    yield _records(s.name, check, piece.doc[of], piece.mark[of])

        return _sent(found(), names)

    looked = _looked_up(rows.select("doc", "mark", "text").mapInArrow(symbols, "b long, data binary"), homes)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each different document that the task has, once, with its number of rows, compressed, by buckets."""

        def placed(t: pa.Table) -> Iterator[pa.RecordBatch]:
            b = (_home(np.asarray(t.column("doc")), np.asarray(t.column("mark")).astype(np.uint32)) % _U(homes)).astype(np.int64)
            by = np.argsort(b, kind="stable")
            t, b = t.take(pa.array(by)), b[by]
            cuts = np.flatnonzero(np.diff(b, prepend=-1)).tolist()
            for x, y in zip(cuts, [*cuts[1:], len(b)][: len(cuts)], strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(b[x : x + 1]), pa.array([_squeezed(t.slice(x, y - x))], pa.binary())], ["b", "data"])

        seen: dict[tuple, int] = {}
        held: list[pa.Table] = []
        for batch in batches:
            new = []
            for k in zip(*(batch.column(c).to_pylist() for c in ("doc", "mark", "missing")), strict=True):
                new.append(k not in seen)
                seen[k] = seen.get(k, 0) + 1
            held.append(pa.Table.from_arrays([*batch.columns[:3], batch.column("text").cast(pa.large_string()), pa.array(np.ones(len(new), np.int64))], schema=_DOC).filter(pa.array(new)))
            if sum(t.nbytes for t in held) > HELD:
                yield from placed(pa.concat_tables(held))
                held = []
        more = [(*k, None, n - 1) for k, n in seen.items() if n > 1]
        held.append(pa.Table.from_arrays([pa.array([m[i] for m in more], f.type) for i, f in enumerate(_DOC)], schema=_DOC))
        yield from placed(pa.concat_tables(held))
        held, seen = [], {}
        give_back()

    placed = rows.mapInArrow(home, "b long, data binary")

    def judge(sent: pa.Table, names_back: pa.Table) -> pa.Table:
        """Each document's result, or, where windows are open, what is known of them."""
        table, known = _once(_loose(sent)), _Looked(names_back)
        out: dict[str, list] = {k: [] for k in ("n_words", "removed", "kept")}
        waits, settled_bits, open_bits = np.zeros(table.num_rows, bool), [], []
        for at, to, piece in _pieces_of(table):
            n = len(piece.words)
            s, check, of = piece.symbols(window)
            tokens = _token(s.name, check, piece.home[of])
            # Of a name that a document is the first to have, its first place there is the first of all.
            settles = s.long & (~known.first(tokens) | _again(s.name, of, s.start))
            never = ~s.long & known.lone(tokens)
            fits = piece.inside(window)
            settled = _spread(s.start[settles], s.end[settles] - window + 1, n) & fits
            ruled = _spread(np.maximum(s.high[never] - window, 0), s.low[never] + 1, n)
            undecided = fits & ~settled & ~ruled
            begins = np.flatnonzero(settled)
            for k, v in zip(out, _result(piece, _spread(begins, begins + window, n), texts), strict=True):
                out[k] += v
            waits[at + piece.row[undecided]] = True
            for i in np.flatnonzero(waits[at:to]).tolist():
                a, e = int(piece.ends[i]), int(piece.ends[i + 1])
                settled_bits.append(np.packbits(settled[a:e]).tobytes())
                open_bits.append(np.packbits(undecided[a:e]).tobytes())
        done = pa.array(~waits)
        ended = pa.table({**{c: table.column(c) for c in ("doc", "mark", "missing", "copies")}, **{k: pa.array(v, _OUT[k]) for k, v in out.items()}}).select(list(_OUT)).filter(done)
        if not waits.any():
            return _with_bucket(ended, sent, [])
        later = table.filter(pa.array(waits)).append_column("settled", pa.array(settled_bits, pa.binary())).append_column("open", pa.array(open_bits, pa.binary()))
        return _with_bucket(ended, sent, [_squeezed(later)])

    judged = keep(placed.groupBy("b").cogroup(looked.groupBy("b")).applyInArrow(lambda a, b: giving_back(judge, a, b), f"b long, {_OUT_SQL}, data binary"), "judged")
    waiting = judged.where("data is not null").select("b", "data")

    def window_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[np.ndarray]:
            for batch in batches:
                for blob in batch.column("data"):
                    table = _loose(pa.table({"data": [blob]}))
                    opened = table.column("open").to_pylist()
                    for at, to, piece in _pieces_of(table):
                        where = np.flatnonzero(_bits(opened[at:to], piece.ends))
                        of = piece.row[where]
                        yield _records(*piece.windows(where, window), piece.doc[of], piece.mark[of])

        return _sent(found(), names)

    looked = _looked_up(waiting.select("data").mapInArrow(window_names, "b long, data binary"), homes)

    def finish(sent: pa.Table, names_back: pa.Table) -> pa.Table:
        table, known = _loose(sent), _Looked(names_back)
        out: dict[str, list] = {k: [] for k in ("n_words", "removed", "kept")}
        opened, settled = table.column("open").to_pylist(), table.column("settled").to_pylist()
        for at, to, piece in _pieces_of(table):
            where = np.flatnonzero(_bits(opened[at:to], piece.ends))
            name, check = piece.windows(where, window)
            of = piece.row[where]
            first = known.first(_token(name, check, piece.home[of]))
            begins = np.concatenate((where[~first | _again(name, of, where)], np.flatnonzero(_bits(settled[at:to], piece.ends))))
            for k, v in zip(out, _result(piece, _spread(begins, begins + window, len(piece.words)), texts), strict=True):
                out[k] += v
        return pa.table({**{c: table.column(c) for c in ("doc", "mark", "missing", "copies")}, **{k: pa.array(v, _OUT[k]) for k, v in out.items()}}).select(list(_OUT))

    columns = list(_OUT)
    ended = waiting.groupBy("b").cogroup(looked.groupBy("b")).applyInArrow(lambda a, b: giving_back(finish, a, b), _OUT_SQL)
    done = keep(judged.where("data is null").select(*columns).unionAll(ended.select(*columns)), "deduplicated")
    release(judged)
    most = done.agg(F.max("copies")).first()[0] or 0
    each = done if most < 2 else each_copy(done, "copies", "_copy", most)
    size = lambda x: x["end"] - x["start"]
    removed = F.aggregate(F.transform("removed", size), F.lit(0).cast("long"), lambda a, x: a + x)
    return each.select(F.when(~F.col("missing"), F.col("doc")).alias("doc_id"), "n_words", removed.alias("n_removed"), "removed", "kept")


def _squeezed(table: pa.Table) -> bytes:
    """The table as compressed bytes: less to shuffle than rows of text."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table.combine_chunks())
    return out.getvalue().to_pybytes()


def _loose(sent: pa.Table) -> pa.Table:
    got = [pa.ipc.open_stream(b.as_buffer()).read_all() for b in sent.column("data")]
    return pa.concat_tables(got).combine_chunks() if got else pa.table({f.name: pa.array([], f.type) for f in [*_DOC, *_BITS]})


def _with_bucket(ended: pa.Table, sent: pa.Table, blobs: list[bytes]) -> pa.Table:
    """Results, and a row for the documents that wait."""
    b = sent.column("b")[0].as_py() if sent.num_rows else 0
    rows = {"b": pa.array([b] * ended.num_rows, pa.int64()), **{c: ended.column(c) for c in _OUT}, "data": pa.nulls(ended.num_rows, pa.binary())}
    wait = {"b": pa.array([b] * len(blobs), pa.int64()), **{c: pa.nulls(len(blobs), k) for c, k in _OUT.items()}, "data": pa.array(blobs, pa.binary())}
    return pa.concat_tables([pa.table(rows), pa.table(wait)])


def _again(name: np.ndarray, of: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of these names stand at an earlier place of the same document, too."""
    order = np.lexsort((at, name, of))
    out = np.zeros(len(order), bool)
    out[order[1:]] = (name[order[1:]] == name[order[:-1]]) & (of[order[1:]] == of[order[:-1]])
    return out


def _once(table: pa.Table) -> pa.Table:
    """Documents that several tasks sent, once, with the rows of all."""
    keys = list(zip(table.column("doc").to_pylist(), table.column("mark").to_pylist(), table.column("missing").to_pylist(), strict=True))
    if len(set(keys)) == len(keys):
        return table
    total: dict[tuple, int] = {}
    at: dict[tuple, int] = {}
    live = table.column("text").is_valid().to_pylist()
    for i, (k, n) in enumerate(zip(keys, table.column("copies").to_pylist(), strict=True)):
        total[k] = total.get(k, 0) + n
        if k not in at or (live[i] and not live[at[k]]):
            at[k] = i
    some = table.take(pa.array(list(at.values()), pa.int64()))
    return some.set_column(some.column_names.index("copies"), "copies", pa.array([total[k] for k in at], pa.int64()))


def _bits(packed: list[bytes], ends: np.ndarray) -> np.ndarray:
    """The documents' bits, as many as words, one after another."""
    got = [np.unpackbits(np.frombuffer(p, np.uint8), count=n).astype(bool) for p, n in zip(packed, np.diff(ends).tolist(), strict=True)]
    return np.concatenate(got) if got else np.zeros(0, bool)
