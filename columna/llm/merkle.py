"""Merkle manifest of a dataset: a digest of every row, a tree of each group, a tree of all groups, proofs, and their check.

A leaf is the SHA-256 of a row's fields.  Leaves of a group ascend by key, and every two consecutive nodes become the
SHA-256 of their hex digests (a last odd one that of its own) until one is left, the group's subroot; the subroots, in
the order of their groups, become the root in the same way.

Leaves, which are narrow, are written once and then range-sorted by group and key into parts of about ``PART_ROWS``; the rows
of each part and group are counted, and running sums of these counts give every part the place of its leaves in their tree.
So each part builds, alone, all subtrees that lie wholly in it: the aligned blocks of 2, 4, 8, ... leaves.  What is left over
at its edges, at most two nodes a level, is shuffled by coordinate (group, and place at a higher level): blocks of ``2 ** high``
leaves are finished first, then blocks of ``2 ** STEP`` of these, up to the subroot.  On the way back each node gets the
siblings above it, and each part hands them down to its rows.  The groups' tree is made by the same steps over subroots.

(The range-sorted parts are rows of a table that carries part and place, not an RDD's partitions, so that they survive
executors that are lost between the steps.)

What bounds a task's memory: a part's rows, and the nodes of a block, at most about two a level and part below it or ``2 ** STEP``.
A group's counts, one row a part, meet in one window task.  A hot group, or rows that are all equal, are cut into parts like
others: rows are sorted by their place in the written table in the end.  Only counts come to the driver.

Defined cases.  Null fields are part of the digest.  Keys that are null come first, and null is a group, the first.  Rows of
one key ascend by leaf; rows equal in all are leaves of their own next to each other.  Texts of any length are hashed
where they lie and never travel.  An empty table gives no rows.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import keep, release

#: Rows of a part.
PART_ROWS = 50_000
#: Levels that are finished at a time above the first blocks.
STEP = 12


def field(value: Column) -> Column:
    """A field as it is hashed: ``-`` for null, else the UTF-8 bytes' number, a colon, and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """The SHA-256 (binary) of the fields, one after another."""
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def _node(*children: bytes) -> bytes:
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def _up(size: int) -> int:
    return (size + 1) // 2


def _top(size: int) -> int:
    """The level at which a tree of ``size`` leaves has one node."""
    return (size - 1).bit_length()


class Part:
    """Consecutive nodes from ``start`` on of a tree of ``size`` leaves, and all nodes above them that need no others."""

    def __init__(self, leaves: list[bytes], start: int, size: int) -> None:
        self.levels: list[tuple[int, int, list[bytes]]] = [(start, size, leaves)]
        while size > 1:
            first, _, nodes = self.levels[-1]
            end = first + len(nodes)
            a, b = _up(first), _up(end) if end == size else end // 2
            if a >= b:
                break
            above = [_node(*nodes[2 * p - first : 2 * p + 2 - first]) for p in range(a, b)]
            size = _up(size)
            self.levels.append((a, size, above))

    def edges(self) -> Iterator[tuple[int, int, bytes]]:
        """(level, place, digest) of the nodes whose parent needs another part, and of the subroot."""
        for level, (first, size, nodes) in enumerate(self.levels):
            end = first + len(nodes)
            if size == 1 or (first % 2 and nodes):
                yield level, first, nodes[0]
            if size > 1 and end % 2 and end < size:
                yield level, end - 1, nodes[-1]

    def paths(self, known: dict[tuple[int, int], bytes]) -> list[bytes]:
        """Each leaf's siblings up to the subroot; ``known``: those of the edges."""
        above: dict[int, bytes] = {}
        for level in range(len(self.levels) - 1, -1, -1):
            first, size, nodes = self.levels[level]
            here = {}
            for i, _ in enumerate(nodes, first):
                path = known.get((level, i))
                if path is None:
                    twin = i ^ 1
                    path = (nodes[twin - first] if twin < size else b"") + above[i // 2]
                here[i] = path
            above = here
        return list(above.values())


def fold(digest: bytes, path: bytes, place: int, size: int) -> tuple[bytes, bytes]:
    """The subroot that a leaf and its siblings give, and what is left of the siblings."""
    while size > 1:
        if place ^ 1 < size:
            twin, path = path[:32], path[32:]
            digest = _node(twin, digest) if place & 1 else _node(digest, twin)
        else:
            digest = _node(digest)
        place, size = place // 2, _up(size)
    return digest, path


def _block(high: int):
    """Finishes the nodes of one block: the block's root, and each node's siblings below it."""

    def run(table: pa.Table) -> pa.Table:
        given = list(zip(*(table.column(c).to_pylist() for c in ("level", "place", "digest", "size")), strict=True))
        total = given[0][3]
        stop = min(high, _top(total))
        known = {(level, i): d for level, i, d, _ in given}
        by_level: dict[int, set[int]] = {}
        for level, i in known:
            by_level.setdefault(level, set()).add(i)
        for level in range(min(by_level), stop):
            size = -(-total >> level)
            for p in {i // 2 for i in by_level.get(level, ())}:
                twins = [known[level, i] for i in (2 * p, 2 * p + 1) if i < size]
                known[level + 1, p] = _node(*twins)
                by_level.setdefault(level + 1, set()).add(p)
        (root_place,) = by_level[stop]
        paths = []
        for level, i, _, _ in given:
            path = []
            while level < stop:
                if (i ^ 1) < -(-total >> level):
                    path.append(known[level, i ^ 1])
                level, i = level + 1, i // 2
            paths.append(b"".join(path))
        n = len(given)
        return pa.table({**{c: table.column(c) for c in ("g", "part", "level", "place", "size")}, "path": pa.array(paths, pa.binary()), "stop": pa.array([stop] * n, pa.int32()), "stop_place": pa.array([root_place] * n, pa.int64()), "stop_digest": pa.array([known[stop, root_place]] * n, pa.binary())})

    return run


def _finished(edges: DataFrame, kind: str, high: int, top: int) -> DataFrame:
    """(g, part, level, place, size, path, subroot): of each edge the siblings up to its subroot."""
    schema = f"g {kind}, part long, level int, place long, size long, path binary, stop int, stop_place long, stop_digest binary"
    rounds, nodes = [], edges
    while True:
        block = F.expr(f"shiftright(place, greatest(0, {high} - level))").alias("block")
        # A last odd node may have come up further than that by itself.
        later = nodes.where(f"level > {high}").select("g", "part", "level", "place", "size", F.lit(b"").alias("path"), F.col("level").alias("stop"), F.col("place").alias("stop_place"), F.col("digest").alias("stop_digest"))
        done = nodes.where(f"level <= {high}").withColumn("block", block).groupBy("g", "block").applyInArrow(_block(high), schema)
        done = keep(done.unionAll(later), "blocks")
        rounds.append(done)
        if high >= top:
            break
        # One row a block goes on.
        nodes = done.groupBy("g", F.col("stop").alias("level"), F.col("stop_place").alias("place")).agg(F.first("stop_digest").alias("digest"), F.first("size").alias("size")).withColumn("part", F.lit(-1).cast("long"))
        high += STEP
    out = rounds.pop()
    while rounds:
        below = rounds.pop()
        upper = out.select(F.col("g").alias("_g"), F.col("level").alias("_level"), F.col("place").alias("_place"), F.col("path").alias("_path"), F.col("stop_digest").alias("_digest"))
        met = below["g"].eqNullSafe(F.col("_g")) & (below["stop"] == F.col("_level")) & (below["stop_place"] == F.col("_place"))
        out = below.join(upper, met).select("g", "part", "level", "place", "size", F.concat("path", "_path").alias("path"), F.col("_digest").alias("stop_digest"))
    return out.select("g", "part", "level", "place", "size", "path", F.col("stop_digest").alias("subroot"))


def _forest(rows: DataFrame, part_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For ``rows`` (g, k, leaf and others): the sorted rows, each part's place in the trees with its edges' paths, the groups."""
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}["g"]
    parts = max(1, -(-rows.count() // part_rows))
    order = ["g", "k", "leaf", "_given"]
    # The place in the written table tells equal rows apart; a scan gives it again after a loss.
    cut = rows.withColumn("_given", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_given")
    ranged = keep(cut.withColumns({"part": F.spark_partition_id().cast("long"), "at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "sorted")
    counts = ranged.groupBy("g", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before, whole = Window.partitionBy("g").orderBy("part"), Window.partitionBy("g")
    offsets = keep(counts.withColumns({"start": F.sum("n").over(before) - F.col("n"), "size": F.sum("n").over(whole)}), "offsets")
    longest, top = offsets.agg(F.max("n"), F.max("size")).first()

    def edges(mine: pa.Table, where: pa.Table) -> pa.Table:
        leaves = mine.sort_by("at").column("leaf").to_pylist()
        low = min(mine.column("at").to_pylist(), default=0)
        out: dict[str, list] = {c: [] for c in ("g", "part", "level", "place", "digest", "size")}
        for w in where.to_pylist():
            for level, place, digest in Part(leaves[w["first"] - low : w["first"] - low + w["n"]], w["start"], w["size"]).edges():
                for c, v in zip(out, (w["g"], w["part"], level, place, digest, w["size"]), strict=True):
                    out[c].append(v)
        kinds = {"g": where.schema.field("g").type, "part": pa.int64(), "level": pa.int32(), "place": pa.int64(), "digest": pa.binary(), "size": pa.int64()}
        return pa.table({c: pa.array(v, kinds[c]) for c, v in out.items()})

    schema = f"g {kind}, part long, level int, place long, digest binary, size long"
    ragged = ranged.select("part", "at", "leaf").groupBy("part").cogroup(offsets.groupBy("part")).applyInArrow(edges, schema)
    high = int(longest or 1).bit_length() + 10
    paths = keep(_finished(ragged, kind, high, _top(int(top or 1))), "paths")
    groups = paths.groupBy("g").agg(F.first("subroot").alias("subroot"), F.first("size").alias("size"))
    known = paths.groupBy(F.col("g").alias("_g"), F.col("part").alias("_part")).agg(F.collect_list(F.struct("level", "place", "path")).alias("edges"), F.first("subroot").alias("subroot"))
    met = offsets["g"].eqNullSafe(F.col("_g")) & (offsets["part"] == F.col("_part"))
    return ranged, offsets.join(known, met).drop("_g", "_part"), groups


def _with_paths(ranged: DataFrame, where: DataFrame, more: list[str], root: bool) -> DataFrame:
    """``ranged`` with place, size, subroot and path of each row; with ``root`` its group's place, groups, and root too."""
    kinds = {f.name: f.dataType.simpleString() for f in ranged.schema.fields}
    names = ["g", "k", "leaf", *more]
    added = {"place": (pa.int64(), "long"), "size": (pa.int64(), "long"), "path": (pa.binary(), "binary"), "subroot": (pa.binary(), "binary")}
    if root:
        added |= {"group_place": (pa.int64(), "long"), "groups": (pa.int64(), "long"), "root": (pa.binary(), "binary")}

    def run(mine: pa.Table, known: pa.Table) -> pa.Table:
        mine = mine.sort_by("at")
        leaves, n = mine.column("leaf").to_pylist(), mine.num_rows
        low = min(mine.column("at").to_pylist(), default=0)
        out: dict[str, list] = {c: [None] * n for c in added}
        for w in known.to_pylist():
            a = w["first"] - low
            b = a + w["n"]
            edge = {(e["level"], e["place"]): e["path"] for e in w["edges"]}
            tail = w["group_path"] if root else b""
            out["path"][a:b] = [p + tail for p in Part(leaves[a:b], w["start"], w["size"]).paths(edge)]
            out["place"][a:b] = range(w["start"], w["start"] + w["n"])
            for c in added:
                if c not in ("path", "place"):
                    out[c][a:b] = [w[c]] * w["n"]
        return pa.table({**{c: mine.column(c) for c in names}, **{c: pa.array(v, added[c][0]) for c, v in out.items()}})

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in names] + [f"{c} {k}" for c, (_, k) in added.items()])
    return ranged.groupBy("part").cogroup(where.groupBy("part")).applyInArrow(run, schema)


def manifest(rows: DataFrame, key: Column, group: Column, digest: Column, also: dict[str, Column] | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """A row each: g (its group), k (its key), leaf, those of ``also``, place, size, subroot, group_place, groups, root, path.

    ``path`` holds the siblings' digests, 32 bytes each, from the leaf to the subroot and on to the root.
    """
    also = also or {}
    leaves = keep(rows.select(group.alias("g"), key.alias("k"), digest.alias("leaf"), *[c.alias(n) for n, c in also.items()]), "leaves")
    ranged, where, groups = _forest(leaves, part_rows)
    tops = keep(groups.select(F.lit(0).alias("g"), F.col("g").alias("k"), F.col("subroot").alias("leaf")), "subroots")
    above = keep(_with_paths(*_forest(tops, part_rows)[:2], [], False), "groups")
    tops = above.select(F.col("k").alias("_g"), F.col("place").alias("group_place"), F.col("size").alias("groups"), F.col("path").alias("group_path"), F.col("subroot").alias("root"))
    where = keep(where.join(tops, where["g"].eqNullSafe(F.col("_g"))).drop("_g"), "places")
    release(leaves)
    return _with_paths(ranged, where, list(also), True)


def verified(proofs: DataFrame, digest: str, keep_columns: list[str]) -> DataFrame:
    """``keep_columns`` with ``folded``: the root that the digest in that column and the row's siblings give."""
    kinds = {f.name: f.dataType.simpleString() for f in proofs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            given = zip(*(b.column(c).to_pylist() for c in (digest, "path", "place", "size", "group_place", "groups")), strict=True)
            roots = []
            for d, path, place, size, group_place, groups in given:
                subroot, path = fold(d, path, place, size)
                roots.append(fold(subroot, path, group_place, groups)[0])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep_columns), pa.array(roots, pa.binary())], [*keep_columns, "folded"])

    return proofs.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep_columns) + ", folded binary")


def document_manifest(docs: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """:func:`manifest` of documents by language, with ``altered``: the leaf as it is after tampering.

    Where 7 divides the CRC-32 of the decimal doc_id, tampering adds 1 to n_chars, unless that is null.
    """
    c = {n: F.col(n) for n in ("doc_id", "source", "lang", "n_chars", "text")}
    more = F.when(F.crc32(c["doc_id"].cast("string")) % 7 == 0, F.lit(1)).otherwise(F.lit(0))
    longer = c["n_chars"].cast("decimal(20,0)") + more
    fields = lambda n: leaf(c["doc_id"], c["source"], c["lang"], n, c["text"])
    return manifest(docs, c["doc_id"].cast("long"), c["lang"].cast("string"), fields(c["n_chars"]), {"altered": fields(longer)}, part_rows)


def check_documents(docs: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: each document's proof held against the altered table."""
    proofs = document_manifest(docs, part_rows)
    text = lambda c: F.lower(F.hex(c))
    folded = verified(proofs.withColumn("siblings", F.sha2(F.encode(text(F.col("path")), "UTF-8"), 256)), "altered", ["k", "leaf", "subroot", "root", "siblings"])
    return folded.select(F.col("k").alias("doc_id"), text(F.col("leaf")).alias("leaf"), text(F.col("subroot")).alias("subroot"), text(F.col("root")).alias("root"), F.col("siblings").alias("proof_sha256"), text(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


