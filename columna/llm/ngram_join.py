"""N-gram Jaccard join by a prefix tree.

Sets.  A document's set holds its distinct n-word shingles (hashed to 64 bits), globally ordered.  Equal
sets are one class with a number of its own, found by a grouping that is pre-aggregated, so exact copies cost
nothing further.  The text that stands for a class is named by doc_id and the text's 64-bit checksum, so that
rows of one doc_id with different texts stay apart.

Routing.  A whole trie fits no machine, so its upper levels say which sets can meet.  Of each set a sketch
of its first ``s - ceil(t s) + l`` n-grams is kept (t: the threshold): linked sets share at least ``l``
sketch n-grams.  The n-grams of all sketches are counted exactly over all documents (each batch sends every
n-gram once with its count, so a frequent one is as cheap as a rare one), sketches are reordered rarest
first, and linked sets must share an n-gram among the first ``|sketch| - l_min + 1`` of these.  N-grams
that only one set has lead nowhere and are not posted; texts without near copies end here.

Joining.  Sets that share a posted n-gram, directly or by others, form a block.  In a block the sets are
stored in a trie, whose nodes know the smallest and largest set below them.  Each set walks it, carries the
overlap of a shared path to all sets below it, and leaves a subtree when what is missed so far, or what of the
set itself lies behind, rules out every length that the subtree holds; sets already connected are not walked
to.  Blocks of more than ``chunk`` sets, or ``chunk_chars`` characters, are cut by size and hash: chunks meet
the first of their size band, then every set outside the largest component found so meets all chunks whose
sizes can link with it.

Memory.  A task holds a run of texts of a megabyte (or one longer text) with its sets, a batch of sketches of
``PACK_BYTES``, a part of the n-grams, or a group of blocks of about ``group_chars`` characters.

Defined cases.  A null or wordless text has an empty set (n_shingles 0) and is linked with nothing; a row
without doc_id is returned with a null component.  Repeated rows are returned as often as they come; rows of
one doc_id with different texts are documents of their own that share a name.  Ties in size or in n-grams
change no result.  Very long texts are whole sets.  An empty table gives no rows.  Only doc_id and text are
read; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Union, components, keep, pieces, release, shingle_sets


#: Sketches hold so many n-grams beyond those a linked set may lack, if the set has them.
SKETCH_LEAST = 64
#: Up to so many rows of five numbers (about 100 MB) are broadcast; their count is taken first.
BROADCAST_ROWS = 2_000_000


def least_overlap(s: int, t: int, num: int, den: int) -> int:
    """The smallest intersection with ``den * intersection >= num * union``."""
    return -(-num * (s + t) // (num + den))


def sketch_extra(s: int, num: int, den: int) -> int:
    """l: n-grams that a sketch holds beyond those a linked set may lack; it never falls as ``s`` grows.

    Short sets are kept whole: few shared n-grams would otherwise be enough to bring them together.
    """
    overlap = -(-num * s // den)
    return min(overlap, max(SKETCH_LEAST, 1 + (3 * (s - overlap)) // 4))


class Trie:
    """Sorted sets in a radix tree: a node's edge is a run of n-grams, its children differ in the first of theirs.

    ``begin``/``end``: the depths of a node's edge; ``sample``: a set below it, whose n-grams the edge has;
    ``least``/``most``: the sizes below it; ``here``: sets that end at it; ``below``: how many sets it holds.
    """

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sets = sets
        self.begin, self.end, self.sample, self.least, self.most = [0], [0], [0], [0], [0]
        self.children: list[list[int]] = [[]]
        self.here: list[list[int]] = [[]]
        self.below: list[list[int]] = [[]]
        path = [0]
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        for k, i in enumerate(order):
            shared = _common(sets[order[k - 1]], sets[i]) if k else 0
            while self.begin[path[-1]] >= shared and len(path) > 1:
                path.pop()
            node = path[-1]
            if self.end[node] > shared:  # the edge parts in its middle: the new node takes its upper half
                upper = self._node(self.begin[node], shared, self.sample[node])
                siblings = self.children[path[-2]]
                siblings[siblings.index(node)] = upper
                self.begin[node], self.children[upper] = shared, [node]
                path[-1] = node = upper
            if len(sets[i]) > shared or not k:
                leaf = self._node(shared, len(sets[i]), i)
                self.children[node].append(leaf)
                path.append(leaf)
                node = leaf
            self.here[node].append(i)
        self._measure()

    def _node(self, begin: int, end: int, sample: int) -> int:
        for x, v in ((self.begin, begin), (self.end, end), (self.sample, sample), (self.least, 0), (self.most, 0)):
            x.append(v)
        for y in (self.children, self.here, self.below):
            y.append([])
        return len(self.begin) - 1

    def _measure(self) -> None:
        order, at = [0], 0
        while at < len(order):
            order.extend(self.children[order[at]])
            at += 1
        for v in reversed(order):
            kids = self.children[v]
            self.below[v] = self.here[v] + [i for c in kids for i in self.below[c]]
            own = [len(self.sets[i]) for i in self.here[v]]
            self.least[v] = min(own + [self.least[c] for c in kids], default=0)
            self.most[v] = max(own + [self.most[c] for c in kids], default=0)

    def links(self, probe: np.ndarray, num: int, den: int, skip) -> Iterator[int]:
        """Numbers of the stored sets that ``probe`` links with; ``skip(i)``: i need not be looked at."""
        s = len(probe)
        if not s:
            return
        shortest, longest = -(-num * s // den), s * den // num
        stack = [(c, 0) for c in self.children[0]]
        while stack:
            v, overlap = stack.pop()
            low, high = max(self.least[v], shortest), min(self.most[v], longest)
            if low > high or all(skip(i) for i in self.below[v]):
                continue
            a, b = self.begin[v], self.end[v]
            # Misses on the path grow with the depth: the longest set below may miss most.
            allowed = high - least_overlap(s, high, num, den) - (a - overlap)
            if allowed < 0:
                continue
            edge = self.sets[self.sample[v]][a:b]
            at = np.searchsorted(probe, edge)
            hits = int(np.count_nonzero(probe[np.minimum(at, s - 1)] == edge))
            if b - a - hits > allowed:
                continue
            overlap += hits
            # What of the probe lies behind the path can't be met any more: the shortest set below needs least.
            passed = int(np.searchsorted(probe, edge[-1], "right")) if b > a else 0
            if overlap + s - passed < least_overlap(s, low, num, den):
                continue
            for i in self.here[v]:
                if shortest <= b <= longest and overlap >= least_overlap(s, b, num, den) and not skip(i):
                    yield i
            stack.extend((c, overlap) for c in self.children[v])


def _common(a: np.ndarray, b: np.ndarray) -> int:
    k = min(len(a), len(b))
    off = np.flatnonzero(a[:k] != b[:k])
    return int(off[0]) if len(off) else k


def spanning_links(sets: list[np.ndarray], stored: list[int], probing: list[int], num: int, den: int, known: list[int] | None = None) -> list[tuple[int, int]]:
    """Links between ``probing`` and ``stored`` that connect what isn't connected yet (``known``: components so far)."""
    trie, groups = Trie([sets[i] for i in stored]), Union(len(sets))
    if known:
        firsts: dict[int, int] = {}
        for i, c in enumerate(known):
            groups.join(firsts.setdefault(c, i), i)
    out = []
    for p in probing:
        if groups.sets == 1:
            break
        for k in trie.links(sets[p], num, den, lambda k, p=p: groups.find(stored[k]) == groups.find(p)):
            if groups.join(p, stored[k]):
                out.append((p, stored[k]))
    return out


def _sketches(n: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column("doc_id").cast(pa.int64()), batch.column("mark")
            for at, part in pieces(batch.column("text")):
                sets = shingle_sets(part, n)
                sigs = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
                short = [s[: len(s) - -(-num * len(s) // den) + sketch_extra(len(s), num, den)].tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(part)), marks.slice(at, len(part)), pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs[:, 0]), pa.array(sigs[:, 1]), pa.array(short, pa.binary())], ["doc_id", "mark", "n_shingles", "sig1", "sig2", "sketch"])

    return run


#: A row of sketches holds so many bytes of them, or one larger sketch.
PACK_BYTES = 1 << 17
_PACKED = "batch long, cls array<long>, sig1 array<long>, sig2 array<long>, doc_id array<long>, mark array<long>, n array<long>, lengths array<int>, grams binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes, numbered, with their sketches run together."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 36
    for batch in batches:
        sizes = np.diff(np.frombuffer(batch.column("sketch").cast(pa.large_binary()).buffers()[1], np.int64)[batch.column("sketch").offset :][: batch.num_rows + 1]) if batch.num_rows else np.zeros(0, np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PACK_BYTES, "right")))
            b = batch.slice(at, to - at)
            one = lambda x: pa.array([x])
            lists = [pa.array([np.asarray(b.column(c))], pa.list_(pa.int64())) for c in ("sig1", "sig2", "doc_id", "mark", "n")]
            cls = pa.array([np.arange(number, number + to - at)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([one(number), cls, *lists, pa.array([(sizes[at:to] // 8).astype(np.int32)], pa.list_(pa.int32())), one(b"".join(b.column("sketch").to_pylist()))], [f.split()[0] for f in _PACKED.split(", ")])
            number += to - at
            at = to


def _send(parts: int):
    """Every batch's distinct n-grams with their counts, by part of the n-gram's range."""
    shift = 64 - int(math.log2(parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                grams, counts = np.unique(np.frombuffer(row["grams"], np.uint64), return_counts=True)
                # sketches hold the smallest hashes, so parts go by mixed bits
                part = ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(shift)).astype(np.int64) if parts > 1 else np.zeros(len(grams), np.int64)
                by = np.argsort(part, kind="stable")
                cuts = np.flatnonzero(np.diff(part[by])) + 1
                rows = [(int(part[i[0]]), grams[i].tobytes(), counts[i].astype(np.uint32).tobytes()) for i in np.split(by, cuts) if len(i)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([row["batch"]] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["part", "batch", "grams", "counts"])

    return run


def _count(table: pa.Table) -> pa.Table:
    """For each batch the counts of its n-grams over all batches, up to 255."""
    grams = [np.frombuffer(x, np.uint64) for x in table.column("grams").to_pylist()]
    counts = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("counts").to_pylist()])
    _, back = np.unique(np.concatenate(grams), return_inverse=True)
    total = np.minimum(np.bincount(back, counts)[back], 255).astype(np.uint8)
    ends = np.cumsum([len(g) for g in grams])[:-1]
    return pa.table({"batch": table.column("batch"), "part": table.column("part"), "totals": pa.array([x.tobytes() for x in np.split(total, ends)], pa.binary())})


def _post(parts: int, num: int, den: int):
    """(gram, n, cls): the shared n-grams that can lead a set to a linked one."""
    shift = 64 - int(math.log2(parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                grams = np.frombuffer(row["grams"], np.uint64)
                uniq, back = np.unique(grams, return_inverse=True)
                part = ((uniq * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(shift)).astype(np.int64) if parts > 1 else np.zeros(len(uniq), np.int64)
                total = np.zeros(len(uniq), np.uint8)
                got = b"".join(x["totals"] for x in sorted(row["got"], key=lambda x: x["part"]))
                total[np.argsort(part, kind="stable")] = np.frombuffer(got, np.uint8)
                total = total[back]
                g, n, r, at = [], [], [], 0
                for cls, s, k in zip(row["cls"], row["n"], row["lengths"], strict=True):
                    own, seen = grams[at : at + k], total[at : at + k]
                    at += k
                    fewest = sketch_extra(max(1, -(-num * s // den)), num, den)
                    lead = np.lexsort((own, seen))[: k - fewest + 1]
                    lead = lead[seen[lead] > 1]
                    g.append(own[lead].view(np.int64))
                    n.append(np.full(len(lead), s))
                    r.append(np.full(len(lead), cls))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (g, n, r)], ["gram", "n", "cls"])

    return run


def _join_block(n: int, num: int, den: int):
    """Spanning links of the blocks in one group; side 0 is stored, side 1 probes, side 2 does both."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        sets = shingle_sets(table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string()), n)
        block, side = np.asarray(table.column("block")), np.asarray(table.column("side"))
        cls, known = np.asarray(table.column("cls")), np.asarray(table.column("known"))
        a, b = [], []
        by = np.lexsort((cls, block))
        for rows in np.split(by, np.flatnonzero(np.diff(block[by])) + 1):
            local = [sets[i] for i in rows]
            for p, q in spanning_links(local, [k for k, i in enumerate(rows) if side[i] != 1], [k for k, i in enumerate(rows) if side[i] != 0], num, den, known[rows].tolist()):
                a.append(int(cls[rows[p]]))
                b.append(int(cls[rows[q]]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def ngram_jaccard_join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, chunk: int = 256, chunk_chars: int = 8_000_000, group_chars: int = 2_000_000) -> DataFrame:
    """(doc_id, n_shingles, component_id, mark, kept) for every row of ``docs``: see the module's text.

    ``mark``: the text's 64-bit checksum.  ``kept``: whether the row is, by doc_id and mark, the first of its
    component; true for rows that link with nothing.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    sets = keep(source.mapInArrow(_sketches(n, num, den), "doc_id long, mark long, n_shingles long, sig1 long, sig2 long, sketch binary"), "sets")
    ids = sets.drop("sketch")
    first = F.min(F.struct("doc_id", "mark")).alias("rep")
    distinct = sets.where("n_shingles > 0 and doc_id is not null").groupBy("sig1", "sig2").agg(first, F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    packed = keep(distinct.select("sig1", "sig2", "rep.doc_id", "rep.mark", "n", "sketch").mapInArrow(_pack, _PACKED), "classes")
    classes = packed.select(F.inline(F.arrays_zip("cls", "sig1", "sig2", "doc_id", "mark", "n")))
    total = packed.agg(F.sum(F.octet_length("grams"))).first()[0] or 0
    parts = 1 << max(0, math.ceil(math.log2(total / 4_000_000 + 1e-9)))
    sent = packed.select("batch", "grams").mapInArrow(_send(parts), "part long, batch long, grams binary, counts binary")
    totals = sent.groupBy("part").applyInArrow(_count, "batch long, part long, totals binary")
    back = totals.groupBy("batch").agg(F.collect_list(F.struct("part", "totals")).alias("got"))
    posted = packed.select("batch", "cls", "n", "lengths", "grams").join(back, "batch")
    posted = keep(posted.mapInArrow(_post(parts, num, den), "gram long, n long, cls long"), "posted")

    # Chains through each posted n-gram and size band (linked sets lie in one band or in neighbours; a set is
    # posted in its own and the next): within salted parts of it, then through what heads these parts.
    band = F.floor(F.log("n") / F.lit(math.log(den / num)))
    salted = posted.withColumns({"band": F.explode(F.array(band, band + 1)), "salt": F.pmod(F.xxhash64("cls"), F.lit(32))})
    w = Window.partitionBy("gram", "band", "salt").orderBy("n", "cls")
    chained = salted.withColumn("to", F.when(F.lag("n").over(w) * den >= F.col("n") * num, F.lag("cls").over(w)))
    heads = chained.where("to is null").withColumn("to", F.lag("cls").over(Window.partitionBy("gram", "band").orderBy("n", "cls")))
    edges = chained.where("to is not null").select(F.col("cls").alias("a"), F.col("to").alias("b")).unionAll(heads.where("to is not null").select(F.col("cls").alias("a"), F.col("to").alias("b")))
    # Two sets that share many n-grams are chained by each of them; one edge says as much.
    members = components(edges.distinct()).select(F.col("node").alias("_cls"), F.col("component").alias("block"))
    # A class is met once more for its size and for the text that stands for it.
    members = classes.select("cls", "doc_id", "mark", "n").join(members, F.col("cls") == F.col("_cls")).drop("_cls")
    members = keep(members.withColumn("band", F.floor(F.log("n") / F.lit(math.log(den / num)))).drop("n"), "members")
    release(posted)
    many = members.count()
    # Few members go to where the texts are; more of them, and all texts meet by doc_id and checksum.
    texts = source.join(F.broadcast(members) if many <= BROADCAST_ROWS else members, ["doc_id", "mark"]).drop("doc_id", "mark")
    texts = keep(texts, "texts")
    if texts.count() > many:  # rows that come more than once
        once = keep(texts.dropDuplicates(["cls"]), "texts")
        release(texts)
        texts = once
    release(members)
    sizes = keep(texts.groupBy("block").agg(F.count("*").alias("of"), F.sum(F.length("text")).alias("chars")), "blocks")
    chars, large = sizes.agg(F.sum("chars"), F.count_if((F.col("of") > chunk) | (F.col("chars") > chunk_chars))).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # By number, as AQE would gather small groups, which are much work, in one task.
    join = lambda t: t.repartition(tasks, "group").groupBy("group").applyInArrow(_join_block(n, num, den), "a long, b long")
    cols = ["group", "block", "cls", "side", "known", "text"]
    groups = max(tasks, (chars or 0) // group_chars)
    cut = sizes.where((F.col("of") > chunk) | (F.col("chars") > chunk_chars)).select("block")
    small = texts.join(cut, "block", "left_anti") if large else texts
    small = small.withColumns({"group": F.pmod(F.xxhash64("block"), F.lit(groups)).cast("string"), "side": F.lit(2), "known": F.col("cls")})
    links = join(small.select(cols))
    if large:
        links = links.unionAll(_large(texts.join(cut, "block", "left_semi"), join, cols, chunk, chunk_chars))
    labels = components(links)
    release(texts, sizes)
    # Components take the name of their first row.
    linked = keep(classes.select("cls", F.struct("doc_id", "mark").alias("own")).join(labels, F.col("cls") == labels["node"]).select("cls", "own", "component"), "labels")
    heads = linked.groupBy("component").agg(F.min("own").alias("head"))
    named = linked.join(heads, "component").select(F.col("cls").alias("_cls"), "head")
    own = classes.join(named, F.col("cls") == F.col("_cls"), "left").select("sig1", "sig2", F.coalesce("head", F.struct("doc_id", "mark")).alias("head"))
    out = ids.where("n_shingles > 0 and doc_id is not null").join(own, ["sig1", "sig2"])
    out = out.select("doc_id", "n_shingles", F.col("head.doc_id").alias("component_id"), "mark", ((F.col("doc_id") == F.col("head.doc_id")) & (F.col("mark") == F.col("head.mark"))).alias("kept"))
    rest = ids.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "mark", F.lit(True).alias("kept"))
    return out.unionAll(rest)


def _large(texts: DataFrame, join, cols: list[str], chunk: int, chunk_chars: int) -> DataFrame:
    """Links of the blocks with more than ``chunk`` sets or ``chunk_chars`` characters, cut by size band and hash into chunks."""
    pieces_of = F.greatest(F.ceil(F.count("*") / chunk), F.ceil(F.sum(F.length("text")) / chunk_chars)).cast("long")
    bands = texts.groupBy("block", "band").agg(pieces_of.alias("chunks"))
    cut = texts.join(bands, ["block", "band"]).withColumn("mine", F.pmod(F.xxhash64("cls", F.lit(7)), F.col("chunks")))
    # Each chunk meets the first one of its band, and first chunks meet those of the next band.
    others = F.when(F.col("mine") > 0, F.array("mine")).otherwise(F.concat(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), F.array(F.lit(-1).cast("long"))))
    first = cut.withColumn("other", F.explode(others))
    up = cut.where("mine = 0").withColumns({"other": F.lit(-1).cast("long"), "band": F.col("band") + 1})
    first = first.unionByName(up).withColumns({"group": F.concat_ws(":", F.lit("a"), "block", "band", "other"), "known": F.col("cls"), "side": F.when((F.col("other") == F.col("mine")) | (F.col("other") < 0), 2).otherwise(0)})
    links = keep(join(first.select(cols)), "links")
    found = components(links)
    now = cut.join(found, F.col("cls") == found["node"], "left").withColumn("known", F.coalesce("component", "cls")).drop("node", "component")
    sizes = now.groupBy("block", "known").count()
    main = sizes.groupBy("block").agg(F.max_by("known", F.struct("count", "known")).alias("main"))
    now = keep(now.join(main, "block"), "known")
    # What lies outside the block's largest component meets all chunks of its own and the neighbouring bands.
    near = F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))
    asked = now.where("known <> main").select("block", "band", "mine").distinct().withColumn("to", near)
    asked = asked.join(bands.select("block", F.col("band").alias("to"), F.col("chunks").alias("m")), ["block", "to"])
    asked = asked.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    asked = keep(asked.withColumns({"group": F.concat_ws(":", F.lit("b"), "block", "band", "mine", "to", "other"), "self": (F.col("band") == F.col("to")) & (F.col("mine") == F.col("other"))}), "asked")
    probes = now.where("known <> main").join(asked.select("block", "band", "mine", "group", "self"), ["block", "band", "mine"])
    probes = probes.withColumn("side", F.when(F.col("self"), 2).otherwise(1))
    stored = now.join(asked.select("block", F.col("to").alias("band"), F.col("other").alias("mine"), "group", "self"), ["block", "band", "mine"])
    stored = stored.where(~F.col("self") | (F.col("known") == F.col("main"))).withColumn("side", F.lit(0))
    return links.unionAll(join(probes.select(cols).unionAll(stored.select(cols))))
