"""Merkle manifest of a dataset, stored as aligned subtrees in van Emde Boas layout.

Every row is a leaf: the hash of its fields, each with its byte count. Rows of one
key (null is a key of its own) ascend by id; every two consecutive nodes become the
hash of their digests, and a last single one the hash of its own, until one is
left. The keys' subroots, null first and then bytewise, form the tree above.

Leaves are ranked by a range shuffle and the counts of its partitions, so a key's
rows may lie in many tasks. ``2 ** levels`` aligned leaves form a block, built by one
task; block roots are the leaves of the next tier, and so on to one block. A block's
nodes lie in van Emde Boas order: the upper half of its levels first, then each
subtree below, both laid out the same way. The address of a node follows from its
level and number alone, and serves building and looking up siblings. A proof is the
sibling path inside a block and the path of the block's root, so paths go down from the
highest tier, one row for each block.

Null fields are ``-``. Null ids come first; rows of one id are ordered by their leaf,
and repeated rows are leaves of their own. Empty texts have a byte count of 0. Empty
table: empty result. Other columns are not part of a leaf.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from flowlens.llm.common import settle, table
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEVELS = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DIGEST = 32


def addresses(height: int, depth: int, number: np.ndarray) -> np.ndarray:
    """Places of the nodes ``number`` of one depth in a complete tree of ``height`` levels."""
    if height == 1:
        return np.zeros_like(number)
    upper = height // 2
    if depth < upper:
        return addresses(upper, depth, number)
    lower, below = height - upper, depth - upper
    subtree, inside = number >> below, number & (1 << below) - 1
    return (1 << upper) - 1 + subtree * ((1 << lower) - 1) + addresses(lower, below, inside)


@functools.cache
def places(levels: int) -> list[list[int]]:
    """For each level above the leaves, the places of its nodes from left to right."""
    return [addresses(levels + 1, levels - level, np.arange(1 << levels - level)).tolist() for level in range(levels + 1)]


def parent(left: str, right: str = "") -> str:
    return hashlib.sha256((left + right).encode()).hexdigest()


class Block:
    """An aligned subtree of up to ``2 ** levels`` leaves; ``height`` levels of it are in use."""

    def __init__(self, levels: int, size: int, height: int, nodes: list[str] | None = None):
        self.places, self.size, self.height = places(levels), size, height
        self.nodes: list[str] = nodes if nodes is not None else [""] * ((2 << levels) - 1)

    @classmethod
    def build(cls, levels: int, leaves: list[str], alone: bool) -> Block:
        """``alone``: the block is the whole tree and ends where one node is left; others end at ``levels``."""
        block = cls(levels, len(leaves), (len(leaves) - 1).bit_length() if alone else levels)
        nodes, rows = block.nodes, block.places
        for at, leaf in zip(rows[0], leaves, strict=False):
            nodes[at] = leaf
        count = len(leaves)
        for level in range(block.height):
            below, above = rows[level], rows[level + 1]
            for i in range(count // 2):
                nodes[above[i]] = parent(nodes[below[2 * i]], nodes[below[2 * i + 1]])
            if count % 2:
                nodes[above[count // 2]] = parent(nodes[below[count - 1]])
            count = (count + 1) // 2
        return block

    @property
    def root(self) -> str:
        return self.nodes[self.places[self.height][0]]

    def path(self, leaf: int) -> str:
        """``L`` or ``R`` and the sibling on that side, or ``-``, for each level."""
        out, count = [], self.size
        for level in range(self.height):
            sibling = leaf ^ 1
            out.append("-" if sibling >= count else "LR"[sibling > leaf] + self.nodes[self.places[level][sibling]])
            leaf, count = leaf >> 1, (count + 1) // 2
        return "".join(out)

    def pack(self) -> bytes:
        return b"".join(bytes.fromhex(n) if n else bytes(DIGEST) for n in self.nodes)

    @classmethod
    def unpack(cls, levels: int, size: int, height: int, packed: bytes) -> Block:
        text = packed.hex()
        return cls(levels, size, height, [text[i:i + 2 * DIGEST] for i in range(0, len(text), 2 * DIGEST)])


def fold(digest: str, path: str) -> str:
    """The root that a leaf and its path lead to."""
    at = 0
    while at < len(path):
        side, at = path[at], at + 1
        if side == "-":
            digest = parent(digest)
        else:
            sibling, at = path[at:at + 2 * DIGEST], at + 2 * DIGEST
            digest = parent(sibling, digest) if side == "L" else parent(digest, sibling)
    return digest


def siblings(path: str) -> str:
    return path.replace("-", "").replace("L", "").replace("R", "")


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, columns)).cast("binary"), 256)


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (key and more) with rank, from 0 in each key, and total, the key's rows; written to the shared folder."""
    names = rows.columns
    salted = rows.withColumn("salt_", F.monotonically_increasing_id())  # equal rows may go to different tasks
    by = [F.asc_nulls_first(c) for c in ("key", *order, "salt_")]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = pc.run_end_encode(batch.column("key"))
            places, start = [], 0
            for key, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                count = count if key == last else 0
                places.append(np.arange(count, count + end - start))
                last, count, start = key, count + end - start, end
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array([part] * batch.num_rows, pa.int64()), pa.array(np.concatenate(places), pa.int64())],
                                             names=[*names, "part_", "place_"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    numbered = settle(salted.repartitionByRange(*by).sortWithinPartitions(*by).select(*names).mapInArrow(number, f"{kinds}, part_ long, place_ long"))
    # at most one row for each key and each partition, as partitions are ranges
    counts = numbered.groupBy("key", "part_").agg(F.count("*").alias("n_"))
    ahead = Window.partitionBy("key").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"before_": F.coalesce(F.sum("n_").over(ahead), F.lit(0)), "total": F.sum("n_").over(Window.partitionBy("key"))}).drop("n_")
    return settle(numbered.join(counts, ["key", "part_"]).select(*names, (F.col("before_") + F.col("place_")).alias("rank"), "total"))


def blocks_of(nodes: DataFrame, levels: int) -> DataFrame:
    """One tier: ``nodes`` (key, rank, digest, total) as (key, block, size, height, total, nodes, root)."""
    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rank")
        total = rows.column("total")[0].as_py()
        block = Block.build(levels, rows.column("digest").to_pylist(), total <= 1 << levels)
        return pa.table({"key": rows.column("key").slice(0, 1), "block": rows.column("block").slice(0, 1), "size": pa.array([block.size]), "height": pa.array([block.height]),
                         "total": pa.array([total]), "nodes": pa.array([block.pack()], pa.binary()), "root": pa.array([block.root])})

    dealt = nodes.select("key", F.shiftright("rank", levels).alias("block"), "rank", "digest", "total")
    return settle(dealt.groupBy("key", "block").applyInArrow(build, "key binary, block long, size long, height long, total long, nodes binary, root string"))


def tiers_of(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """Blocks of every tier; the last holds one block of the largest key."""
    largest = nodes.agg(F.max("total")).first()[0] or 0
    tiers = [blocks_of(nodes, levels)]
    while (largest := -(-largest >> levels)) > 1:  # rounds up
        above = tiers[-1].filter(F.col("total") > 1 << levels)
        tiers.append(blocks_of(above.select("key", F.col("block").alias("rank"), F.col("root").alias("digest"), F.ceil(F.col("total") / (1 << levels)).alias("total")), levels))
    return tiers


def roots_of(tiers: list[DataFrame], levels: int) -> DataFrame:
    """(key, root): the blocks that are alone in their tier."""
    return functools.reduce(DataFrame.unionByName, [t.filter(F.col("total") <= 1 << levels).select("key", "root") for t in tiers])


def with_paths(blocks: DataFrame, levels: int) -> DataFrame:
    """(key, rank, path) of every leaf of ``blocks`` (with path, that of the block's root)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.unpack(levels, row["size"], row["height"], row["nodes"])
                ranks = [(row["block"] << levels) + i for i in range(block.size)]
                yield pa.RecordBatch.from_arrays([pa.array([row["key"]] * block.size, pa.binary()), pa.array(ranks, pa.int64()), pa.array([block.path(i) + row["path"] for i in range(block.size)])],
                                                 names=["key", "rank", "path"])

    return blocks.select("key", "block", "size", "height", "nodes", "path").mapInArrow(run, "key binary, rank long, path string")


def block_paths(tiers: list[DataFrame], above: DataFrame, levels: int) -> DataFrame:
    """Blocks of the lowest tier with path, that of their root; ``above`` (key, path) are those of the keys' subroots."""
    below = None
    for tier in reversed(tiers):
        own = tier.filter(F.col("total") <= 1 << levels).join(above, "key")
        if below is not None:
            own = own.unionByName(tier.join(below.withColumnRenamed("rank", "block"), ["key", "block"]))
        below = with_paths(own, levels) if tier is not tiers[0] else own
    return below


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every document.

    Where 7 divides the crc32 of the decimal doc_id, the folded leaf has 1 added to its
    n_chars; verified tells whether the leaf leads to the root all the same.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = {c: F.col(c) for c in FIELDS}
    changed = columns | {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    leaves = docs.select(
        # a key's bytes order null before '' before all others
        F.coalesce(F.concat(F.lit(b"\x01"), F.col("lang").cast("binary")), F.lit(b"")).alias("key"), "doc_id",
        leaf(list(columns.values())).alias("leaf"), F.when(tampered, leaf(list(changed.values()))).alias("altered"))
    leaves = ranked(leaves, ["doc_id", "leaf"])
    tiers = tiers_of(leaves.withColumnRenamed("leaf", "digest"), levels)
    subroots = roots_of(tiers, levels)
    tops = ranked(subroots.select(F.lit(b"").alias("key"), F.col("key").alias("name"), F.col("root").alias("digest")), ["name"])
    top_tiers = tiers_of(tops, levels)
    top = roots_of(top_tiers, levels)  # one row
    top_paths = with_paths(block_paths(top_tiers, top.select("key", F.lit("").alias("path")), levels), levels)
    named = tops.join(top_paths, ["key", "rank"]).join(F.broadcast(top), "key").select(F.col("name").alias("key"), F.col("digest").alias("subroot"), F.col("root").alias("top"), "path")
    lowest = block_paths(tiers, named.select("key", "path"), levels).join(named.select("key", "subroot", "top"), "key")

    def prove(own: pa.Table, blocks: pa.Table) -> pa.Table:
        row = blocks.select(["size", "height", "nodes", "path", "subroot", "top"]).to_pylist()[0]
        block, root, upper = Block.unpack(levels, row["size"], row["height"], row["nodes"]), row["top"], row["path"]
        proofs, folded = [], []
        for rank, digest, altered in zip(*(own.column(c).to_pylist() for c in ("rank", "leaf", "altered")), strict=True):
            path = block.path(rank & (1 << levels) - 1) + upper
            proofs.append(parent(siblings(path)))
            folded.append(fold(altered or digest, path))
        count = own.num_rows
        return pa.table({"doc_id": own.column("doc_id"), "leaf": own.column("leaf"), "subroot": pa.array([row["subroot"]] * count), "root": pa.array([root] * count),
                         "proof_sha256": pa.array(proofs), "folded_root": pa.array(folded), "verified": pa.array([f == root for f in folded])})

    own = leaves.withColumn("block", F.shiftright("rank", levels)).groupBy("key", "block")
    return own.cogroup(lowest.groupBy("key", "block")).applyInArrow(
        prove, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}


def _field(c: str) -> str:
    return f"coalesce(strlen(({c})::varchar) || ':' || ({c})::varchar, '-')"


def _tree(name: str, base: str, by: str) -> str:
    """Nodes of every level, from leaves (``by``, level, idx, digest, n)."""
    return f"""{name} as (select {by}, 0 as level, idx, digest, n from {base}
  union all select {by}, level + 1, idx // 2, sha256(string_agg(digest, '' order by idx)), (n + 1) // 2 from {name} where n > 1 group by {by}, level, idx // 2, n)"""


def _fold(name: str, base: str, tree: str, same: str) -> str:
    """Leaves led to the root by the siblings of ``tree``; the siblings' digests gather in path."""
    return f"""{name} as (select id, lang, 0 as level, idx, n, digest, path from {base}
  union all select f.id, f.lang, f.level + 1, f.idx // 2, (f.n + 1) // 2,
    sha256(case when s.digest is null then f.digest when f.idx % 2 = 0 then f.digest || s.digest else s.digest || f.digest end), f.path || coalesce(s.digest, '')
  from {name} f left join {tree} s on {same} and s.level = f.level and s.idx = xor(f.idx, 1) where f.n > 1)"""


def _sql() -> str:
    from flowlens.llm.variants import CRC32, CRC_ROWS

    def whole(chars: str) -> str:
        return "sha256(" + " || ".join(_field(chars if c == "n_chars" else c) for c in FIELDS) + ")"

    return f"""
with recursive crc as ({CRC_ROWS}),
docs as (select row_number() over () as id, doc_id, lang, {whole('n_chars')} as leaf, {whole('n_chars::hugeint + 1')} as altered, n_chars, encode(doc_id::varchar) as bytes from documents),
ranked as (select docs.*, xor({CRC32.format('bytes')}, 4294967295) % 7 = 0 and n_chars is not null as tampered,
  row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by lang) as n from docs, crc),
leaves as (select lang, idx, leaf as digest, n from ranked),
{_tree('tree', 'leaves', 'lang')},
tops as (select lang, digest, row_number() over (order by lang nulls first) - 1 as idx, count(*) over () as n from tree where n = 1),
above as (select 0 as one, idx, digest, n from tops),
{_tree('top', 'above', 'one')},
start as (select id, lang, idx, n, case when tampered then altered else leaf end as digest, '' as path from ranked),
{_fold('low', 'start', 'tree', 's.lang is not distinct from f.lang')},
middle as (select w.id, w.lang, t.idx, t.n, w.digest, w.path from low w join tops t on w.lang is not distinct from t.lang where w.n = 1),
{_fold('high', 'middle', 'top', 's.one = 0')},
ends as (select * from high where n = 1)
select r.doc_id, r.leaf, t.digest as subroot, g.digest as root, sha256(e.path) as proof_sha256, e.digest as folded_root, e.digest = g.digest as verified
from ranked r join ends e on e.id = r.id join tops t on t.lang is not distinct from r.lang, (select digest from top where n = 1) g"""


SQL = {"op12_merkle_manifest": _sql()}
