"""Prefix trie of conversations: every distinct beginning is a node with what its subtree holds.

A turn is a 128-bit digest of role and text and the words of its text; a conversation is the path of its turns.  The digest
of a beginning is chained over its turns, so a beginning is known by one digest.

1. Paths are sorted by range over all tasks, so that a subtree's conversations are neighbours, whatever
   their number; equal paths may be spread over many tasks.
2. A task inserts batches of distinct paths into a z-fast trie.  A compacted node, whose edge from its
   parent's end ``start`` to its own ``end`` has no branch, lies in a hash table under the digest of its
   path's beginning of two-fattest length in (start, end].  A fat binary search on a path's own digests
   finds the node where it leaves the trie in about log2(length) look-ups; there the edge is split.
3. Edges are expanded to one node per depth.  Nodes off the batch's first and last path are complete.  The nodes on
   these two stay open; they are merged with the next batch's, then, ``MERGE`` tasks at a time, with those of other
   tasks, until all are complete.  So a task holds a batch and two paths, and no node is shuffled to be counted.
4. Ids of conversations that end at a node are digested in their order.  Where equal paths cross a batch's
   border, their ids become one row of text per batch, and these are digested one after another.

Nodes whose parent was completed later get its conversation by a join with the few such parents, salted.

Defined cases: a null role or text is empty; a null turn comes first; ties go by role, then digest; repeated rows are
turns of their own; a null conv_id is a conversation that counts as member, but is neither a smallest member nor
listed; a conversation without turns is a member of the root only; no conversations have no nodes.  Other columns are
ignored.  A conversation's digests (24 bytes a turn, not its texts) must fit in a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranklake.sources.storage import stored

#: Turns of a batch.
BATCH = 50_000
#: Tasks whose open nodes one merging task takes.
MERGE = 256
#: Copies of a parent that is completed late, each for a share of its children.
SALTS = 16

PATH = "array<struct<digest:binary,words:long>>"
_FIRST = bytes(16)


def turn_digest(role: Column, text: Column) -> Column:
    """128 bits of a turn's role and text."""
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.unhex(F.sha2(whole, 256)), 1, 16)


def paths(turns: DataFrame) -> DataFrame:
    """conv_id and path: the turns of each conversation of ``turns`` (conv_id, turn, role, text) in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), turn_digest(role, text).alias("digest"), words.alias("words")).alias("t"),
    )
    bare = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words")))
    return rows.groupBy("conv_id").agg(bare.cast(PATH).alias("path"))


# -- the trie of a batch -----------------------------------------------------


def chained(digests: Iterable[bytes], known: list[bytes] = (), same: int = 0) -> list[bytes]:
    """Digest of each beginning of a path, the empty one first; ``known`` is that of a path with ``same`` equal turns."""
    out = list(known[: same + 1]) if known else [_FIRST]
    last = out[-1]
    for digest in digests:
        last = hashlib.blake2b(last + digest, digest_size=16).digest()
        out.append(last)
    return out


def two_fattest(a: int, b: int) -> int:
    """The number in (a, b] that the highest power of two divides."""
    return b & -1 << (a ^ b).bit_length() - 1


class Compacted:
    """A branching or ending node: its path is the first ``end`` turns of ``chain``, its edge begins at ``start``."""

    __slots__ = ("start", "end", "chain", "words", "parent", "children", "count", "least", "ends")

    def __init__(self, start: int, end: int, chain: list[bytes], words: list[int], parent: Compacted | None):
        self.start, self.end, self.chain, self.words, self.parent = start, end, chain, words, parent
        self.children: dict[bytes, Compacted] = {}
        self.count, self.least, self.ends = 0, None, None

    def handle(self) -> bytes:
        return self.chain[two_fattest(self.start, self.end)]


class ZFastTrie:
    def __init__(self):
        self.root = Compacted(0, 0, [_FIRST], [], None)
        self.handles: dict[bytes, Compacted] = {}

    def exit_node(self, chain: list[bytes]) -> Compacted:
        """The node on whose edge, or at whose end, a path leaves the trie."""
        inner, a, b = self.root, 0, len(chain) - 1
        while a < b:
            f = two_fattest(a, b)
            found = self.handles.get(chain[f])
            if found is None:
                b = f - 1
            elif found.end < len(chain) and found.chain[found.end] == chain[found.end]:
                inner, a = found, found.end
            else:
                return found
        if inner.end + 1 < len(chain):
            return inner.children.get(chain[inner.end + 1], inner)
        return inner

    def insert(self, chain: list[bytes], words: list[int]) -> Compacted:
        """The node at the end of a path."""
        node, length = self.exit_node(chain), len(chain) - 1
        if node.end > length or node.chain[node.end] != chain[node.end]:
            node = self._split(node, self._shared(node, chain))
        if node.end == length:
            return node
        leaf = Compacted(node.end, length, chain, words, node)
        node.children[chain[node.end + 1]] = leaf
        self.handles[leaf.handle()] = leaf
        return leaf

    def insert_batch(self, batch: Iterable[tuple]) -> None:
        """Distinct paths, each with its conversations: (chain, words, count, least id, ends)."""
        for chain, words, count, least, ends in batch:
            node = self.insert(chain, words)
            node.count, node.least, node.ends = count, least, ends

    @staticmethod
    def _shared(node: Compacted, chain: list[bytes]) -> int:
        """Turns that a path has in common with the edge it leaves."""
        low, high = node.start, min(node.end, len(chain) - 1)
        while low < high:
            middle = (low + high + 1) // 2
            if node.chain[middle] == chain[middle]:
                low = middle
            else:
                high = middle - 1
        return low

    def _split(self, node: Compacted, at: int) -> Compacted:
        upper = Compacted(node.start, at, node.chain, node.words, node.parent)
        del self.handles[node.handle()]
        node.parent.children[node.chain[node.start + 1]] = upper
        upper.children[node.chain[at + 1]] = node
        node.start, node.parent = at, upper
        self.handles[node.handle()] = node
        self.handles[upper.handle()] = upper
        return upper

    def expand(self) -> dict[bytes, Node]:
        """One node per depth of each edge, with the members that the trie has seen."""
        order, seen = [], [self.root]
        while seen:
            node = seen.pop()
            order.append(node)
            seen.extend(node.children.values())
        out: dict[bytes, Node] = {}
        for node in reversed(order):
            count, least = node.count, node.least
            for child in node.children.values():
                # A child's totals are those of the node below it.
                below = out[child.chain[child.start + 1]]
                count += below.n_convs
                least = _least(least, below.conv_id)
            lowest = node.start + 1 if node.parent else 0
            for depth in range(node.end, lowest - 1, -1):
                made = out[node.chain[depth]] = Node(node.chain[depth], depth, node.chain[depth - 1] if depth else None, node.words[depth - 1] if depth else 0)
                made.n_convs, made.conv_id = count, least
            out[node.chain[node.end]].ends = node.ends
        return out


# -- nodes, complete and open ------------------------------------------------

#: Of a node's ends: their ids lie in several rows of text.
SPREAD = "spread"
NONE = hashlib.sha256(b"").hexdigest()


def _least(a: int | None, b: int | None) -> int | None:
    return a if b is None else b if a is None else min(a, b)


@dataclass
class Node:
    """A beginning of conversations; the last three numbers are those of its complete children until it is complete."""

    key: bytes
    depth: int
    parent: bytes | None
    words: int
    n_convs: int = 0
    conv_id: int | None = None
    ends: str | None = None
    n_children: int = 0
    n_leaves: int = 0
    saved_tokens: int = 0

    def take(self, other: Node) -> None:
        """Adds what another batch or task saw of this beginning."""
        self.n_convs += other.n_convs
        self.conv_id = _least(self.conv_id, other.conv_id)
        self.ends = other.ends if self.ends is None else self.ends
        self.n_children += other.n_children
        self.n_leaves += other.n_leaves
        self.saved_tokens += other.saved_tokens


@dataclass
class Open:
    """The open nodes of neighbouring conversations: those of their first and last path."""

    nodes: dict[bytes, Node] = field(default_factory=dict)
    first: set[bytes] = field(default_factory=set)
    last: set[bytes] = field(default_factory=set)

    def join(self, nodes: dict[bytes, Node], first: set[bytes], last: set[bytes]) -> None:
        """Adds the nodes of what follows."""
        for key, node in nodes.items():
            if key in self.nodes:
                self.nodes[key].take(node)
            else:
                self.nodes[key] = node
        self.first = self.first or first
        self.last = last

    def settle(self, end: bool = False) -> list[tuple[Node, Node | None]]:
        """Takes out the nodes that are complete (at the ``end`` all), each with its parent if that is complete too.

        What follows can only have members of the first path's nodes (what came before) and the last's.
        """
        done = {}
        for node in sorted(self.nodes.values(), key=lambda n: -n.depth):
            if not end and (node.key in self.first or node.key in self.last):
                continue
            done[node.key] = node
            node.n_leaves = node.n_leaves or 1
            node.saved_tokens += (node.n_convs - 1) * node.words
            above = self.nodes.get(node.parent)
            if above:
                above.n_children += 1
                above.n_leaves += node.n_leaves
                above.saved_tokens += node.saved_tokens
        for key in done:
            del self.nodes[key]
        return [(node, done.get(node.parent)) for node in done.values()]


# -- tasks -------------------------------------------------------------------

_NODE, _OPEN, _IDS = 0, 1, 2
_ROWS = (
    "kind int, part long, number long, key binary, depth long, parent binary, words long, n_convs long, conv_id long, ends string, n_children long, "
    "n_leaves long, saved_tokens long, known boolean, parent_conv_id long, late boolean, is_first boolean, is_last boolean, ids string"
)
_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
_SCHEMA = pa.schema([(name, _TYPES[kind]) for name, kind in (x.split() for x in _ROWS.split(", "))])


def _node_row(part: int, node: Node) -> dict:
    return {"part": part} | {k: getattr(node, k) for k in ("key", "depth", "parent", "words", "n_convs", "conv_id", "ends", "n_children", "n_leaves", "saved_tokens")}


def _done_rows(part: int, done: list[tuple[Node, Node | None]], waited: set[bytes]) -> list[dict]:
    """Complete nodes; ``waited``: those that were open before, whose children may not know them."""
    return [
        _node_row(part, node)
        | {"kind": _NODE, "late": node.key in waited, "known": node.parent is None or above is not None, "parent_conv_id": above.conv_id if above else None}
        for node, above in done
    ]


def _open_rows(part: int, held: Open) -> list[dict]:
    return [_node_row(part, n) | {"kind": _OPEN, "is_first": n.key in held.first, "is_last": n.key in held.last} for n in held.nodes.values()]


def _runs(batches: Iterator[pa.RecordBatch], most_ids: int) -> Iterator[tuple]:
    """(chain, words, ids) for each run of equal paths, in pieces of at most so many ids."""
    chain, words, ids, digests = [_FIRST], [], [], None
    for batch in batches:
        column, convs = batch.column("path"), batch.column("conv_id").to_pylist()
        turns = column.flatten()
        every, counts = turns.field("digest").to_pylist(), turns.field("words").to_pylist()
        at = 0
        for conv, length in zip(convs, column.value_lengths().to_pylist()):
            own = every[at : at + length]
            if own != digests or len(ids) >= most_ids:
                if ids:
                    yield chain, words, ids
                if own != digests:
                    same, most = 0, min(len(own), len(digests or ()))
                    while same < most and own[same] == digests[same]:
                        same += 1
                    chain, words, digests = chained(own[same:], chain, same), counts[at : at + length], own
                ids = []
            ids.append(conv)
            at += length
    if ids:
        yield chain, words, ids


def _grouped(runs: Iterator[tuple], turns: int) -> Iterator[list[tuple]]:
    batch, size = [], 0
    for run in runs:
        batch.append(run)
        size += len(run[0]) + len(run[2])
        if size >= turns:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


def _decimal(ids: list[int | None]) -> str:
    """Ids as text, each after a comma."""
    return "".join(f",{i}" for i in ids if i is not None)


def _digest(ids: str) -> str:
    return hashlib.sha256(ids[1:].encode()).hexdigest()


def _builder(turns: int):
    """Tries of a sorted range of conversations, batch by batch."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, number = TaskContext.get().partitionId(), Open(), 0
        for batch in _grouped(_runs(batches, turns), turns):
            rows, trie = [], ZFastTrie()
            first, last = batch[0][0], batch[-1][0]
            distinct = []
            for chain, words, ids in batch:
                text = _decimal(ids)
                spread = chain is first or chain is last  # this run may go on in another batch
                if spread and text:
                    rows.append({"kind": _IDS, "part": part, "number": number, "key": chain[-1], "ids": text})
                    number += 1
                least = min((i for i in ids if i is not None), default=None)
                if distinct and distinct[-1][0] is chain:
                    distinct[-1] = (chain, words, distinct[-1][2] + len(ids), _least(distinct[-1][3], least), SPREAD)
                else:
                    distinct.append((chain, words, len(ids), least, _digest(text) if not spread else SPREAD if text else None))
            trie.insert_batch(distinct)
            waited = set(held.nodes)
            held.join(trie.expand(), set(first), set(last))
            rows += _done_rows(part, held.settle(), waited)
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
        if held.nodes:
            yield pa.RecordBatch.from_pylist(_open_rows(part, held), schema=_SCHEMA)

    return build


def _merger(end: bool, tasks: int):
    def merge(table: pa.Table) -> pa.Table:
        """The open nodes of neighbouring tasks as one, and what that completes."""
        held, parts = Open(), {}
        for row in table.to_pylist():
            parts.setdefault(row["part"], []).append(row)
        for part in sorted(parts):
            nodes = {}
            for r in parts[part]:
                nodes[r["key"]] = Node(*(r[k] for k in ("key", "depth", "parent", "words", "n_convs", "conv_id", "ends", "n_children", "n_leaves", "saved_tokens")))
            held.join(nodes, {r["key"] for r in parts[part] if r["is_first"]}, {r["key"] for r in parts[part] if r["is_last"]})
        group, waited = min(parts) // tasks, set(held.nodes)
        rows = _done_rows(group, held.settle(end), waited) + _open_rows(group, held)
        return pa.Table.from_pylist(rows, schema=_SCHEMA)

    return merge


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each key's ids, from rows sorted by key and place; texts are not gathered."""
    schema = pa.schema([("key", pa.binary()), ("ends", pa.string())])
    key, state = None, None
    for batch in batches:
        rows = []
        for own, text in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if own != key:
                if state:
                    rows.append({"key": key, "ends": state.hexdigest()})
                key, state = own, hashlib.sha256(text[1:].encode())
            else:
                state.update(text.encode())
        yield pa.RecordBatch.from_pylist(rows, schema=schema)
    if state:
        yield pa.RecordBatch.from_pylist([{"key": key, "ends": state.hexdigest()}], schema=schema)


def nodes(conversations: DataFrame, batch: int = BATCH, merge: int = MERGE) -> DataFrame:
    """One row per node of the trie of ``conversations`` (conv_id, path as :func:`paths` gives it).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (words that
    sharing the subtree's beginnings saves) and ends_sha256 (of the ids of conversations that end here).
    ``batch`` turns are inserted at a time, ``merge`` tasks' open nodes are merged by one.
    """
    source = stored(conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce("path", F.array().cast(PATH)).cast(PATH).alias("path")), "paths")
    ordered = source.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    built = stored(ordered.select("path", "conv_id").mapInArrow(_builder(batch), _ROWS), "built")
    rounds, parts = [built], (built.filter(F.col("kind") == _OPEN).agg(F.max("part")).first()[0] or 0) + 1
    while True:
        end = parts <= merge
        held = rounds[-1].filter(F.col("kind") == _OPEN).withColumn("group", F.expr(f"part div {merge}"))
        rounds.append(stored(held.groupBy("group").applyInArrow(_merger(end, merge), _ROWS), "merged"))
        if end:
            break
        parts = -(-parts // merge)
    ids = built.filter(F.col("kind") == _IDS).select("key", "part", "number", "ids")
    spread = ids.repartition("key").sortWithinPartitions("key", "part", "number").select("key", "ids").mapInArrow(_digests, "key binary, ends string")
    done = rounds[0]
    for other in rounds[1:]:
        done = done.unionByName(other)
    done = done.filter(F.col("kind") == _NODE)
    ended = done.filter(~F.col("ends").eqNullSafe(F.lit(SPREAD))).unionByName(done.filter(F.col("ends") == SPREAD).drop("ends").join(spread, "key"))
    parents = done.filter("late").select(F.col("key").alias("parent"), F.col("conv_id").alias("_of"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    orphans = ended.filter(~F.col("known")).withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    found = orphans.join(parents, ["parent", "salt"]).withColumn("parent_conv_id", F.col("_of")).drop("_of", "salt")
    return ended.filter("known").unionByName(found).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NONE)).alias("ends_sha256")
    )
