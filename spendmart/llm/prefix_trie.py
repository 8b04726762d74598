"""The prefix trie of conversations, from adaptive radix trees.

A turn becomes a fixed-width id: 16 bytes, big-endian, the fingerprint of its role and text. A conversation is the
string of its ids. Every task inserts the strings it holds into adaptive radix trees: nodes grow through layouts of 4,
16, 48 and 256 children, and a path without a branch is one compressed edge. Byte depths that are a multiple of 16 are
turns; only those emit trie nodes, those inside a compressed edge included. A node's identity is a running fingerprint
of its prefix, so the partial trees of all tasks meet in one aggregation, and it does not matter which task held which
conversation: a first turn shared by a third of all conversations is one row a task.

Sums over subtrees take a second pass. A node belongs to the smallest conversation through it, so a conversation owns
the lower end of its path; it carries what its own nodes are worth to all nodes above them. Nodes that only one
conversation reaches need no sums, so the second pass inserts only the shared beginnings.

Nothing is gathered by conversation as a whole: sequences are held in parts of at most PART turns, each a string of its
own below the fingerprint of all before it, and only one short row a part is chained along a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spendmart.llm import textbytes as tb
from spendmart.llm.shared import materialize

PART = 1024  # turns of one conversation in a row, at most
WIDTH = 16  # bytes of a turn id
INSERTED = 1 << 18  # turns in the trees of a task at one time
END_BITS = 16  # conversation ids that share all but so many bits are listed in one row

_TURN = "struct<hi: bigint, lo: bigint, size: int>"
_LANES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd bases of the two running fingerprints
_MASK = (1 << 64) - 1


class Node:
    """A node of an adaptive radix tree: `path` is the compressed edge below its branching byte."""

    __slots__ = ("path", "layout", "keys", "kids", "ends")

    def __init__(self, path: bytes) -> None:
        self.path, self.layout, self.keys, self.kids, self.ends = path, 4, bytearray(), [], []

    def child(self, byte: int) -> Node | None:
        if self.layout == 256:
            return self.kids[byte]
        if self.layout == 48:
            at = self.keys[byte]
            return None if at == 255 else self.kids[at]
        at = self.keys.find(byte)
        return None if at < 0 else self.kids[at]

    def add(self, byte: int, node: Node) -> None:
        """A child for a byte that has none; a full layout grows to the next."""
        if len(self.kids) == self.layout < 256:
            if self.layout == 4:
                self.layout = 16
            elif self.layout == 16:
                index = bytearray(b"\xff") * 256
                for at, key in enumerate(self.keys):
                    index[key] = at
                self.layout, self.keys = 48, index
            else:
                kids: list[Node | None] = [None] * 256
                for key, at in enumerate(self.keys):
                    if at != 255:
                        kids[key] = self.kids[at]
                self.layout, self.keys, self.kids = 256, bytearray(), kids
        if self.layout == 256:
            self.kids[byte] = node
        else:
            if self.layout == 48:
                self.keys[byte] = len(self.kids)
            else:
                self.keys.append(byte)
            self.kids.append(node)

    def replace(self, byte: int, node: Node) -> None:
        if self.layout == 256:
            self.kids[byte] = node
        else:
            self.kids[self.keys[byte] if self.layout == 48 else self.keys.find(byte)] = node

    def children(self) -> Iterator[Node]:
        return (k for k in self.kids if k is not None)


def insert(root: Node, key: bytes, item: int) -> None:
    """The root's own path stays empty."""
    parent, branch, node, at = None, 0, root, 0
    while True:
        path = node.path
        if path and not key.startswith(path, at):
            rest = key[at : at + len(path)]
            common = next((i for i, (a, b) in enumerate(zip(path, rest)) if a != b), len(rest))  # noqa: B905
            upper = Node(path[:common])
            node.path = path[common + 1 :]
            upper.add(path[common], node)
            parent.replace(branch, upper)
            node, path = upper, upper.path
        at += len(path)
        if at == len(key):
            node.ends.append(item)
            return
        parent, branch, node = node, key[at], node.child(key[at])
        at += 1
        if node is None:
            leaf = Node(key[at:])
            leaf.ends.append(item)
            parent.add(branch, leaf)
            return


def edges(root: Node, first: bool, order: list[int], last: list[bool], leaves: list[int], below: list[int], worth) -> Iterator[tuple]:
    """(rep, from, to, n, ended, leaves, saved) of every edge that crosses turn-aligned depths from..to.

    Items are numbers into the lists. rep: the item of smallest `order` beneath; n: items beneath; ended: those whose
    conversation ends at depth `to`; leaves: their sum; saved: `below` of the items plus what the owned nodes beneath
    depth `to` are worth, where worth(rep, from, to) sums the nodes of an edge. `first`: the root is a node as well.
    """
    nodes, above, depth = [root], [-1], [0]
    for i, node in enumerate(nodes):
        for kid in node.children():
            nodes.append(kid)
            above.append(i)
            depth.append(depth[i] + 1 + len(kid.path))
    rep = [-1] * len(nodes)
    n, many, saved = [0] * len(nodes), [0] * len(nodes), [0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        ends, best = nodes[i].ends, rep[i]
        for item in ends:
            if best < 0 or order[item] < order[best]:
                best = item
            many[i] += leaves[item]
            saved[i] += below[item]
        n[i] += len(ends)
        up, to = above[i], depth[i] // WIDTH
        since = depth[up] // WIDTH + 1 if up >= 0 else 0 if first else 1
        total = saved[i]
        if since <= to:
            yield best, since, to, n[i], sum(last[item] for item in ends), many[i], total
            total += worth(best, since, to)
        if up >= 0:
            n[up] += n[i]
            many[up] += many[i]
            saved[up] += total
            if rep[up] < 0 or order[best] < order[rep[up]]:
                rep[up] = best


def _fingerprints(turns: pa.Array, part: np.ndarray, before: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(offsets, ids as big-endian bytes, per lane the running sums at the part's depths 0..len, end to end)."""
    offsets = turns.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    flat = turns.flatten()
    lanes = [flat.field(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in (0, 1)]
    ids = np.stack(lanes, axis=1).astype(">u8")
    size = np.diff(offsets)
    inner = tb.ragged(np.zeros(len(size), np.int64), size)
    sums = []
    for lane, base, prior in zip(lanes, _LANES, before, strict=True):
        powers = np.full(PART + 1, base, np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers)
        shift = np.ones(len(size), np.uint64)
        for p in np.flatnonzero(part):
            shift[p] = pow(base, int(part[p]) * PART, 1 << 64)
        terms = tb.mix(lane + np.uint64(1)) * powers[inner] * np.repeat(shift, size)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])
        at = tb.ragged(offsets[:-1], size + 1)
        sums.append(total[at] - np.repeat(total[offsets[:-1]], size + 1) + np.repeat(prior, size + 1))
    return offsets, ids, sums


def _node_ids(sums: list[np.ndarray], depth: np.ndarray) -> list[np.ndarray]:
    d = tb.mix(depth.astype(np.uint64) + np.uint64(1))
    return [tb.signed(tb.mix(s ^ (d * np.uint64(base)))) for s, base in zip(sums, _LANES, strict=True)]


def _cut(batches) -> Iterator[pa.RecordBatch]:
    """Batches whose turns fit into the trees at one time."""
    for batch in batches:
        ends = np.concatenate([[0], np.cumsum(batch.column("turns").value_lengths().to_numpy())])
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + INSERTED, side="right")) - 1)
            yield batch.slice(first, last - first)
            first = last


def _trees(batch: pa.RecordBatch, counted: bool):
    """Inserts a batch of parts and lists what their nodes hold. counted: the second pass, with sums."""
    numbers = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
    part = numbers("part")
    before = [numbers(c).view(np.uint64) for c in ("s1", "s2")]
    turns = batch.column("turns")
    offsets, ids, sums = _fingerprints(turns, part, before)
    n = batch.num_rows
    size = np.diff(offsets)
    conv = numbers("conv_id")
    if counted:
        length = np.clip(numbers("shared") - part * PART, 0, size)
        leaves, below = numbers("leaves").tolist(), numbers("below").tolist()
        # worth[k + offset of the part]: own nodes at depths >= k of the part, k from 0
        own = np.zeros(len(sums[0]), object)
        start = offsets[:-1] + np.arange(n)
        values = batch.column("own")
        spots = np.diff(values.offsets.to_numpy())
        flat = values.flatten()
        row = np.repeat(np.arange(n), spots)
        depth = flat.field(0).to_numpy(zero_copy_only=False) - part[row] * PART
        own[start[row] + depth] = flat.field(1).to_numpy(zero_copy_only=False).astype(object)
        suffix = np.append(np.cumsum(own[::-1])[::-1], 0) if len(own) else np.zeros(1, object)
        worth = lambda r, a, b: suffix[start[r] + a] - suffix[start[r] + b + 1]
        last = [False] * n
    else:
        length, leaves, below, worth, last = size, [0] * n, [0] * n, lambda r, a, b: 0, numbers("last").tolist()
    raw = ids.tobytes()
    roots: dict[tuple, Node] = {}
    for i, key in enumerate(zip(before[0].tolist(), before[1].tolist(), part.tolist(), strict=True)):
        root = roots.get(key)
        if root is None:
            root = roots[key] = Node(b"")
        at = offsets[i] * WIDTH
        insert(root, raw[at : at + length[i] * WIDTH], i)
    order = conv.tolist()
    found = [e for key, root in roots.items() for e in edges(root, key[2] == 0, order, last, leaves, below, worth)]
    if not found:
        return None
    rep, since, to, count, ended, many, saved = (list(x) for x in zip(*found, strict=True))
    rep, since, to = (np.array(x, np.int64) for x in (rep, since, to))
    span = to - since + 1
    edge = np.repeat(np.arange(len(rep)), span)
    k = tb.ragged(since, span)
    at = offsets[rep[edge]] + rep[edge] + k
    depth = k + part[rep[edge]] * PART
    hi, lo = _node_ids([s[at] for s in sums], depth)
    out = {"hi": hi, "lo": lo}
    if counted:
        out["leaves"] = np.array(many, np.int64)[edge]
        out["saved"] = [saved[e] + worth(r, a, b) for e, r, a, b in zip(edge.tolist(), rep[edge].tolist(), k.tolist(), to[edge].tolist(), strict=True)]
        return out
    up = k > 0
    parent = _node_ids([s[at - up] for s in sums], depth - up)
    chars = np.zeros(len(k), np.int64)
    chars[up] = turns.flatten().field(2).to_numpy(zero_copy_only=False)[offsets[rep[edge]][up] + k[up] - 1]
    out |= {"depth": depth, "phi": pa.array(parent[0], mask=~up), "plo": pa.array(parent[1], mask=~up), "size": chars}
    out |= {"n": np.array(count, np.int64)[edge], "ended": np.where(k == to[edge], np.array(ended, np.int64)[edge], 0), "conv_id": conv[rep[edge]]}
    # where conversations end
    done = np.flatnonzero(np.array(last, bool))
    spot = offsets[1:][done] + done
    hi, lo = _node_ids([s[spot] for s in sums], size[done] + part[done] * PART)
    return out, {"hi": hi, "lo": lo, "end_of": conv[done]}


_FIRST = ["hi", "lo", "depth", "phi", "plo", "size", "n", "ended", "conv_id", "end_of"]


def _first_pass(batches):
    for batch in _cut(batches):
        for rows in _trees(batch, counted=False) or ():
            size = len(rows["hi"])
            columns = [pa.array(rows[c]) if c in rows else pa.nulls(size, pa.int64()) for c in _FIRST]
            yield pa.RecordBatch.from_arrays(columns, names=_FIRST)


def _second_pass(batches):
    for batch in _cut(batches):
        rows = _trees(batch, counted=True)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(rows["hi"]), pa.array(rows["lo"]), pa.array(rows["leaves"]), pa.array(rows["saved"], pa.int64())], names=list(rows))


def _part_sums(batches):
    """The part's term of either running fingerprint, in halves of 32 bits whose sums do not overflow."""
    for batch in _cut(batches):
        zero = np.zeros(batch.num_rows, np.uint64)
        offsets, _, sums = _fingerprints(batch.column("turns"), batch.column("part").to_numpy(), [zero, zero])
        ends = offsets[1:] + np.arange(batch.num_rows)
        halves = [h for s in sums for h in (s[ends] >> np.uint64(32), s[ends] & np.uint64(0xFFFFFFFF))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("part"), *(pa.array(h.astype(np.int64)) for h in halves)], names=["conv_id", "part", "h1", "l1", "h2", "l2"]
        )


def _joined(high: str, low: str):
    """(high * 2**32 + low) modulo 2**64 as a long, from sums of halves."""
    carried = F.expr(f"({high} + shiftright({low}, 32)) & 4294967295")
    return F.shiftleft(carried, 32).bitwiseOR(F.expr(f"{low} & 4294967295"))


def turn_blocks(conversations: DataFrame) -> DataFrame:
    """(conv_id, before, turns, whole): the turns of a conversation in order, in blocks of 1,024 turn numbers.

    conversations: conv_id, turn, role, text. Turns are ordered by number, null first, ties by fingerprint; null roles
    and texts are empty; rows without conv_id belong to no conversation. before: turns in earlier blocks; whole: the
    block is the whole conversation. Repeated rows are turns of their own. Texts stay where they are; 28 bytes a turn move.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    narrow = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.xxhash64(F.lit(1), role, text).alias("hi"), F.xxhash64(F.lit(2), text, role).alias("lo"), F.length(text).alias("size"),
    )
    block = F.expr("coalesce(shiftright(turn, 10), -9223372036854775808)")
    within = F.expr("CASE WHEN turn IS NULL THEN shiftright(hi, 52) ELSE 0L END")  # rows without a number are in order of fingerprint
    listed = narrow.groupBy("conv_id", block.alias("block"), within.alias("within")).agg(F.array_sort(F.collect_list(F.struct("turn", "hi", "lo", "size"))).alias("turns"))
    along = W.partitionBy("conv_id").orderBy("block", "within").rowsBetween(W.unboundedPreceding, -1)
    bare = F.transform("turns", lambda t: F.struct(t["hi"].alias("hi"), t["lo"].alias("lo"), t["size"].alias("size")))
    return listed.select(
        "conv_id", F.coalesce(F.sum(F.size("turns").cast("long")).over(along), F.lit(0)).cast("long").alias("before"), bare.alias("turns"),
        (F.count(F.lit(1)).over(W.partitionBy("conv_id")) == 1).alias("whole"),
    )


def _parts(sequences: DataFrame) -> DataFrame:
    """(conv_id, part, turns, last, whole, s1, s2): parts of PART turns, with the fingerprint of all turns before."""
    short = F.col("whole") & (F.size("turns") <= PART)
    zero = F.lit(0).cast("long")
    single = sequences.filter(short).select("conv_id", zero.alias("part"), "turns", F.lit(True).alias("last"), F.lit(True).alias("whole"), zero.alias("s1"), zero.alias("s2"))
    long = sequences.filter(~short).select("conv_id", "start", F.posexplode_outer("turns").alias("i", "turn"))
    long = long.withColumn("at", F.col("start") + F.coalesce("i", F.lit(0)))
    cut = long.groupBy("conv_id", F.expr(f"at DIV {PART}").alias("part")).agg(
        F.array_sort(F.collect_list(F.when(F.col("turn").isNotNull(), F.struct("at", "turn")))).alias("turns")
    )
    cut = materialize(cut.select("conv_id", "part", F.col("turns.turn").alias("turns")), "trie-long")
    sums = cut.mapInArrow(_part_sums, "conv_id long, part long, h1 long, l1 long, h2 long, l2 long")
    earlier = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    halves = {c: F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in ("h1", "l1", "h2", "l2")}
    final = F.max("part").over(W.partitionBy("conv_id")) == F.col("part")
    sums = sums.select("conv_id", "part", final.alias("last"), *(x.alias(c) for c, x in halves.items()))
    chained = cut.join(sums, ["conv_id", "part"]).filter("last OR size(turns) > 0")
    chained = chained.select("conv_id", "part", "turns", "last", F.lit(False).alias("whole"), _joined("h1", "l1").alias("s1"), _joined("h2", "l2").alias("s2"))
    return single.unionByName(chained)


def _digests(batches):
    """Streams the ids of each node, in order, through one hash."""
    names, key, state = ["hi", "lo", "ends_sha256"], None, None
    for batch in batches:
        out = []
        for hi, lo, ids in zip(*(batch.column(c).to_pylist() for c in ("hi", "lo", "ids")), strict=True):
            if (hi, lo) != key:
                if key:
                    out.append((*key, state.hexdigest()))
                key, state = (hi, lo), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=names)
    if key:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], names=names)


def prefix_nodes(sequences: DataFrame) -> DataFrame:
    """The trie of all sequences: one row per distinct prefix, the empty one included.

    sequences: conv_id long (not null), start long, turns array<struct<hi, lo, size>>, whole boolean. The turns of a
    conversation are the arrays of its rows by start, which is the number of turns before the row; whole: the row is
    all of its conversation. An empty array is allowed; a conversation without turns ends at the root.
    Result, long but for the last: conv_id (smallest member), depth, parent_conv_id (parent's conv_id; root: null),
    n_convs, n_children, n_leaves (childless nodes of the subtree), saved_tokens (sum over the subtree of
    (n_convs - 1) * size of the last turn), ends_sha256 (digest of the ids, in order and comma-joined, of conversations
    that end here). An empty table has no rows.
    """
    parts = materialize(_parts(sequences), "trie-parts")
    schema = ", ".join(f"{c} long" for c in _FIRST)
    found = materialize(parts.select("conv_id", "part", "turns", "last", "s1", "s2").mapInArrow(_first_pass, schema), "trie-found")
    nodes = found.filter("end_of IS NULL").groupBy("hi", "lo").agg(
        *(F.max(c).alias(c) for c in ("depth", "phi", "plo", "size")), F.sum("n").alias("n"), F.sum("ended").alias("ended"), F.min("conv_id").alias("conv_id")
    )
    nodes = materialize(nodes, "trie-nodes")

    # What each conversation owns, by part, and how far down it is shared
    worth = F.when(F.col("n") > 1, (F.col("n") - 1) * F.col("size"))
    own = nodes.groupBy("conv_id", F.expr(f"greatest(depth - 1, 0) DIV {PART}").alias("part")).agg(
        F.min("depth").alias("top"), F.max(F.when(F.col("n") > 1, F.col("depth"))).alias("deep"), F.max((F.col("ended") == F.col("n")).cast("long")).alias("leaves"),
        F.collect_list(F.when(worth > 0, F.struct("depth", worth.alias("value")))).alias("own"), F.coalesce(F.sum(worth), F.lit(0)).alias("value"),
    )
    held = parts.select("conv_id", "part", "turns", "whole", "s1", "s2")
    shared = F.greatest(F.col("top") - 1, F.coalesce("deep", F.lit(0))).alias("shared")
    columns = ["conv_id", "part", "turns", "s1", "s2", "own"]
    single = held.filter("whole").join(own.filter("part = 0"), ["conv_id", "part"])
    single = single.select(*columns, shared, "leaves", F.lit(0).cast("long").alias("below"))
    every, later = W.partitionBy("conv_id"), W.partitionBy("conv_id").orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, -1)
    several = held.filter("NOT whole").join(own, ["conv_id", "part"], "left")
    several = several.select(
        "conv_id", "part", "turns", "s1", "s2", F.coalesce("own", F.array().cast("array<struct<depth: bigint, value: bigint>>")).alias("own"),
        F.min("top").over(every).alias("top"), F.max("deep").over(every).alias("deep"), F.max("leaves").over(every).alias("leaves"),
        F.coalesce(F.sum("value").over(later), F.lit(0)).alias("below"),
    )
    several = several.filter("top IS NOT NULL").select(*columns, shared, "leaves", "below").filter(f"part = 0 OR shared > part * {PART}")
    sums = single.unionByName(several).mapInArrow(_second_pass, "hi long, lo long, leaves long, saved long")

    # Ids that end at a node, listed in ranges of ids and hashed in order
    listed = found.filter("end_of IS NOT NULL").groupBy("hi", "lo", F.shiftright("end_of", END_BITS).alias("range"))
    listed = listed.agg(F.array_join(F.array_sort(F.collect_list("end_of")).cast("array<string>"), ",").alias("ids"))
    ends = listed.repartition("hi", "lo").sortWithinPartitions("hi", "lo", "range").mapInArrow(_digests, "hi long, lo long, ends_sha256 string")

    # One aggregation brings everything about a node together
    facts = ["depth", "phi", "plo", "n", "conv_id", "children", "leaves", "saved", "ends_sha256"]
    sides = [
        nodes.drop("size", "ended"),
        nodes.filter("phi IS NOT NULL").groupBy(F.col("phi").alias("hi"), F.col("plo").alias("lo")).agg(F.count(F.lit(1)).alias("children")),
        sums.groupBy("hi", "lo").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")),
        ends,
    ]
    table = sides[0]
    for side in sides[1:]:
        table = table.unionByName(side, allowMissingColumns=True)
    table = materialize(table.groupBy("hi", "lo").agg(*(F.max(c).alias(c) for c in facts)), "trie-table")

    # Parents with a hundredth of all nodes or more, a hundred at most, are broadcast; the others are joined by key
    parents = table.filter("children IS NOT NULL").select(F.col("hi").alias("phi"), F.col("lo").alias("plo"), F.col("conv_id").alias("parent_conv_id"), "children")
    bound = table.agg(F.greatest(F.lit(1), F.count(F.lit(1)) / 100)).first()[0]
    hot = parents.filter(F.col("children") >= bound).drop("children").withColumnRenamed("parent_conv_id", "hot_conv_id")
    joined = table.join(F.broadcast(hot.limit(100)), ["phi", "plo"], "left")
    rare = joined.filter("phi IS NOT NULL AND hot_conv_id IS NULL").join(parents.filter(F.col("children") < bound).drop("children"), ["phi", "plo"], "left")
    joined = joined.filter("phi IS NULL OR hot_conv_id IS NOT NULL").withColumn("parent_conv_id", F.col("hot_conv_id")).unionByName(rare)
    return joined.select(
        "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.coalesce("children", F.lit(0)).cast("long").alias("n_children"),
        F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
