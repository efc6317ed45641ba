"""Merkle manifest of a dataset: a tree per group of rows, a tree over the groups, and a proof per row.

Nodes are events. A task keeps partial parents (a slot per child, by the child's index), and as the
number of rows of a tree gives the number of children of every parent, it knows when one is whole:
then the parent is an event itself. What is left at the end of a task, the frontier, is shuffled by an ancestor and goes
on in the next round; rows arrive in order, so a task leaves a few nodes a level. A whole parent
keeps its children as a reverse link, and proofs are read down these links: the children of a
node's parent, then those of the parent's parent, to the root.

Digests are written as lowercase hex where they are hashed or returned, and as bytes in between.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

ARITY, _BITS = 16, 4
#: Levels that a round of the frontier climbs: a key has the open nodes below one ancestor, at most 16 ** 2 of the lowest.
_CLIMB = 2

_NODES = "tree string, size long, level int, index long, digest binary, children binary"
_EVENTS = ["tree", "size", "level", "index", "digest"]


def field(c: Column) -> Column:
    """A value as it is hashed: ``-`` for null, else its bytes in UTF-8, ``:`` and itself."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*columns: Column) -> Column:
    """Digest of a row by its columns in order, in hex."""
    return F.sha2(F.concat(*map(field, columns)).cast("binary"), 256)


def levels(size: int) -> int:
    """Levels above the leaves of a tree of so many leaves."""
    n = 0
    while size > 1:
        size, n = (size + ARITY - 1) >> _BITS, n + 1
    return n


def indexed(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``index`` (from 0, by ``order``) and ``size`` within their ``tree``.

    A range of rows goes to a task, whatever their tree; a row's index is its place in its range
    and the rows of its tree in the ranges before. Rows equal in all of ``order`` stand in any order.
    """
    ranges = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    # an id's low 33 bits count the rows of its partition
    placed = cut(ranges.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), name)
    runs = placed.groupBy("tree", "part").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    within = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(within.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(within).alias("size"))
    return placed.join(runs, ["tree", "part"]).withColumn("index", F.col("row") + F.col("shift")).drop("part", "row", "shift")


def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole parents of the events of a task, with their children; in the end the children of those that are not whole, without."""
    partial: dict[tuple[str, int, int], tuple[int, dict[int, bytes]]] = {}

    def rows(found: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], [*_EVENTS, "children"])

    for batch in batches:
        whole: list[tuple] = []
        for tree, size, level, index, digest in zip(*(batch.column(c).to_pylist() for c in _EVENTS), strict=True):
            nodes = (size - 1 >> _BITS * level) + 1
            while nodes > 1:
                above = index >> _BITS
                key = (tree, level + 1, above)
                slots = partial.setdefault(key, (size, {}))[1]
                slots[index & ARITY - 1] = digest
                arity = min(ARITY, nodes - (above << _BITS))
                if len(slots) < arity:
                    break
                del partial[key]
                children = b"".join([slots[i] for i in range(arity)])
                digest = hashlib.sha256(children.hex().encode()).digest()
                level, index, nodes = level + 1, above, (nodes + ARITY - 1) >> _BITS
                whole.append((tree, size, level, index, digest, children))
        if whole:
            yield rows(whole)
    left = [(tree, size, level - 1, above << _BITS | i, digest, None) for (tree, level, above), (size, slots) in partial.items() for i, digest in slots.items()]
    for i in range(0, len(left), 10_000):
        yield rows(left[i : i + 10_000])


def grow(leaves: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Links of the trees over (tree, size, index, digest): a row per parent with its children; and the levels of the highest tree."""
    top = levels(leaves.agg(F.max("size")).first()[0] or 0)
    events = leaves.select("tree", "size", F.lit(0).alias("level"), "index", "digest").sortWithinPartitions("tree", "index")
    links: DataFrame | None = None
    for climbed in range(0, top + _CLIMB, _CLIMB):
        if climbed:
            # an open node goes where all open nodes below the same ancestor go
            up = F.greatest(climbed - F.col("level"), F.lit(0))
            events = events.repartition("tree", F.greatest("level", F.lit(climbed)), F.call_function("shiftright", F.col("index"), up * _BITS))
        found = cut(events.mapInArrow(combine, _NODES), f"{name}-{climbed}")
        whole = found.where("children is not null")
        links = whole if links is None else links.unionByName(whole)
        events = found.where("children is null").select(_EVENTS)
    return links, top


def paths(links: DataFrame, top: int, above: DataFrame) -> DataFrame:
    """(tree, index, path, place) for the parents of leaves: ``path`` holds the children of each ancestor, up to the root.

    ``above`` has (tree, size, path, place): a row per tree with the path from its subroot on.
    Every step joins nodes with their parents, of which each has 16 at most.
    """
    height = sum(((F.lit(1 << _BITS * n) < F.col("size")).cast("int") for n in range(top)), F.lit(0))
    above = above.withColumn("height", height)

    def begins(level: int) -> DataFrame:
        return above.where(F.col("height") == level).select("tree", F.lit(0).cast("long").alias("index"), "path", "place")

    found = begins(top)
    for level in range(top, 0, -1):
        nodes = links.where(F.col("level") == level).select("tree", F.col("index").alias("own"), F.shiftright("index", _BITS).alias("index"), "children")
        found = nodes.join(found, ["tree", "index"]).select("tree", F.col("own").alias("index"), F.concat("children", "path").alias("path"), "place")
        found = found.unionByName(begins(level - 1))
    return found


def fold(leaf: bytes, path: bytes, spots: tuple[tuple[int, int], ...]) -> tuple[bytes, bytes]:
    """The root over a leaf and its siblings on a path, and these siblings; ``spots`` are (index, size) in each tree on the way."""
    at, siblings = 0, []
    for index, size in spots:
        while size > 1:
            children = path[at : at + 32 * min(ARITY, size - (index & -ARITY))]
            at += len(children)
            k = 32 * (index & ARITY - 1)
            siblings += (children[:k], children[k + 32 :])
            leaf = hashlib.sha256((children[:k] + leaf + children[k + 32 :]).hex().encode()).digest()
            index, size = index >> _BITS, (size + ARITY - 1) >> _BITS
    return leaf, b"".join(siblings)


def manifest(rows: DataFrame, original: Column, claimed: Column, group_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) per row.

    ``original`` is the digest of a row in the manifest and ``claimed`` that of the row as it is
    found now (null: as it was), both in hex. Leaves of a group ascend by id, null first, equal ids
    by digest; groups ascend bytewise, the null group first. Every run of 16 nodes, the last one of
    fewer, becomes their digest until one node is left. proof_sha256 digests the siblings on the way
    to the root, the empty text where there are none; folded_root is made from ``claimed`` and these.

    Repeated rows are leaves of their own; a null id is ``-`` in its leaf and comes first; texts of
    any length are hashed whole where they are; an empty table gives an empty result. Other columns are ignored.
    """
    tree = F.coalesce(F.concat(F.lit("s"), F.col(group_col).cast("string")), F.lit("-"))
    digests = cut(rows.select(F.col(id_col).cast("long").alias("doc_id"), tree.alias("tree"), F.unhex(original).alias("digest"), F.unhex(claimed).alias("claimed")), "leaves")
    leaves = cut(indexed(digests, ["doc_id", "digest"], "ordered"), "indexed")
    links, top = grow(leaves, "links")
    # subroots are the leaves of the tree over the groups
    single = leaves.where("size = 1").select("tree", "size", "digest")
    subroots = links.where((F.col("index") == 0) & (F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level") * _BITS) >= F.col("size"))).select("tree", "size", "digest")
    groups = single.unionByName(subroots).select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("size").alias("leaves"), "digest")
    groups = cut(indexed(groups, ["of"], "groups"), "subroots")
    upper, peak = grow(groups, "upper")
    ends = groups.where("size = 1").select("digest", "size").unionByName(upper.where(F.col("level") == max(peak, 1)).select("digest", "size")).head(2)
    root, n_groups = (bytes(ends[0].digest), ends[0].size) if ends else (b"", 0)
    start = groups.where("index = 0").select("tree", "size", F.lit(b"").alias("path"), F.col("index").alias("place"))
    over = paths(upper, peak, start)
    above = groups.withColumn("up", F.shiftright("index", _BITS)).join(over.select("tree", F.col("index").alias("up"), "path"), ["tree", "up"])
    above = above.select(F.col("of").alias("tree"), F.col("leaves").alias("size"), "path", F.col("index").alias("place"))
    found = paths(links, top, above).withColumnRenamed("index", "up")
    proved = leaves.withColumn("up", F.shiftright("index", _BITS)).join(found, ["tree", "up"]).select("doc_id", "digest", "claimed", "index", "size", "place", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, own, now, index, size, place, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                folded, siblings = fold(own if now is None else now, path, ((index, size), (place, n_groups)))
                # the children of the lowest parent over groups begin where the levels of the own tree end
                at = len(path) - sum(32 * min(ARITY, n - (i & -ARITY)) for i, n in climb(place, n_groups))
                k = at + 32 * (place & ARITY - 1)
                subroot = path[k : k + 32] if n_groups > 1 else root
                out.append((doc_id, own.hex(), subroot.hex(), root.hex(), hashlib.sha256(siblings.hex().encode()).hexdigest(), folded.hex(), folded == root))
            if out:
                kinds = (pa.int64(), *[pa.string()] * 5, pa.bool_())
                names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return proved.mapInArrow(run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def climb(index: int, size: int) -> Iterator[tuple[int, int]]:
    """(index, nodes) of a leaf's ancestors from itself on, as long as they have a parent."""
    while size > 1:
        yield index, size
        index, size = index >> _BITS, (size + ARITY - 1) >> _BITS


DOCUMENT = ("doc_id", "source", "lang", "n_chars", "text")


def documents_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of documents, checked against rows of which those whose id's crc32 is divisible by 5 have their capitals lower-cased."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = F.translate("text", capitals, capitals.lower())
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return manifest(docs, leaf(*map(F.col, DOCUMENT)), F.when(changed, leaf(*map(F.col, DOCUMENT[:-1]), lowered)))


def sql(table: str = "documents", depth: int = 8) -> str:
    """The query of op12 as DuckDB SQL, for trees of up to 16 ** depth leaves."""

    def field_(c: str) -> str:
        return f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"

    def climb_(name: str, leaves: str) -> str:
        """Nodes of each level, of which a lone one stays what it is, and the runs of 16 below each parent."""
        out = f"{name}0 as ({leaves})"
        for k in range(depth):
            out += f""",
{name}r{k} as (select tree, i // 16 as j, n, list(h order by i) as hs from {name}{k} group by all),
{name}{k + 1} as (select tree, j as i, (n + 15) // 16 as n, case when n = 1 then hs[1] else sha256(array_to_string(hs, '')) end as h from {name}r{k})"""
        return out

    def fold_(name: str, runs: str, rows: str) -> str:
        out = f"{name}0 as ({rows})"
        for k in range(depth):
            own = "list_concat(hs[1:(i % 16)], [own], hs[(i % 16 + 2):])"
            out += f""",
{name}{k + 1} as (select f.* replace (i // 16 as i, case when r.n = 1 then own else sha256(array_to_string({own}, '')) end as own,
    case when r.n = 1 then proof else proof || array_to_string(list_concat(hs[1:(i % 16)], hs[(i % 16 + 2):]), '') end as proof)
    from {name}{k} f join {runs}r{k} r on r.tree = f.tree and r.j = f.i // 16)"""
        return out

    head = " || ".join(map(field_, DOCUMENT[:-1]))
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # crc32 over the digits' bytes, bit by bit
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = f"xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)), lambda c, b: {bits}), 4294967295)"
    return f"""
with leaves as (select doc_id, coalesce('s' || source, '-') as tree, sha256({head} || {field_('text')}) as leaf,
    case when doc_id is not null and {crc} % 5 = 0 then sha256({head} || {field_(low)}) end as now from {table}),
placed as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by tree) as n from leaves),
{climb_('a', 'select tree, i, n, leaf as h from placed')},
subs as (select tree as of, row_number() over (order by tree) - 1 as i, count(*) over () as n, h from a{depth}),
{climb_('b', "select '' as tree, i, n, h from subs")},
{fold_('f', 'a', "select doc_id, tree, i, leaf, coalesce(now, leaf) as own, '' as proof from placed")},
{fold_('g', 'b', f"select doc_id, '' as tree, subs.i, leaf, subs.h as subroot, own, proof from f{depth} f join subs on f.tree = subs.of")}
select doc_id, leaf, subroot, b{depth}.h as root, sha256(proof) as proof_sha256, own as folded_root, own = b{depth}.h as verified from g{depth} g, b{depth}
"""
