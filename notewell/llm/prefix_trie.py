"""Prefix trie of conversations, built of ternary search trees over ranges of sorted sequences.

1. Every conversation becomes a sequence of turn keys: a digest of role and text and the length of the
   text. Sequences are sorted and cut into ranges by (sequence, conversation), so that all
   conversations below a node stand together and a range may begin or end inside a large group.
2. A block of a range encodes its turns by a dictionary of its own and puts its different sequences into a
   ternary search tree, the middle one first, then the middles of both halves, so that the branches are
   balanced. One traversal without recursion sums up members, leaves, children and saved bytes.
3. Nodes off the paths of a block's first and last sequence are finished there. Those on the paths stay
   open: other blocks may hold them too. Their figures are sums over the blocks; what two neighbouring blocks
   both counted (a node, a child, a leaf that goes on) is taken off by a row of corrections, which
   only needs the last sequence of one block and the first of the next. Open nodes are merged by the
   digest of their path.
4. Digests of members that end at a node go over their ids in numerical order, which is the order of
   the blocks. For an open node the blocks' lists of ids are read one by one.

Defined results: a null role or text is empty; turns with equal or no numbers are ordered by their
digests; repeated rows are turns of their own; rows with a null ``conv_id`` belong to no
conversation; an empty table gives no rows, other columns are ignored. A conversation's keys, 20 bytes
a turn, are one value of a row; texts are never gathered. Turns are compared by 128-bit digests.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewell.llm.tables import bounded_batches, settle, with_hot

KEY = 20  # bytes of a turn's key: 16 of a digest, 4 of the text's length
RANGE_BYTES = 16 << 20  # of sequences in one range
FIGURES = ("n_convs", "n_children", "n_leaves", "saved_tokens")
NODE = {
    "conv_id": "long", "depth": "int", "parent_conv_id": "long", "parent_key": "binary", "key": "binary", **dict.fromkeys(FIGURES, "long"),
    "ends_sha256": "string", "ends": "binary", "part": "int", "block": "int", "first": "binary", "last": "binary",
}
ROW = ", ".join(f"{name} {kind}" for name, kind in NODE.items())
KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
TYPES = pa.schema([(name, KINDS[kind]) for name, kind in NODE.items()])
NOTHING = hashlib.sha256(b"").hexdigest()


def turn_key() -> Column:
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.unhex(F.md5(whole.cast("binary"))), F.unhex(F.lpad(F.hex(F.octet_length(text).cast("long")), 8, "0")))


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id`` and the keys of its turns in order, as ``keys``."""
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", turn_key().alias("key")).alias("at"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("at")).getField("key").alias("keys"))  # 28 bytes a turn of one conversation


def rebuilt(conversations: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """Every conversation with the first ``h`` turns of its group's first one in place of its own: ``h`` is its id's CRC32 modulo ``most``."""
    own = settle(turns(conversations), "turns")
    base = own.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("keys", 1, most - 1).alias("first"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    joined = own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % group, "h": h}).join(base, "base", "left")
    empty = F.array().cast("array<binary>")
    shared = F.coalesce(F.when(F.col("h") > 0, F.slice("first", F.lit(1), F.greatest("h", F.lit(1)))), empty)
    return joined.select("conv_id", F.concat(shared, F.slice("keys", F.col("h") + 1, F.greatest(F.size("keys"), F.lit(1)))).alias("keys"))


def sequences(conversations: DataFrame) -> DataFrame:
    """``conv_id`` and ``keys`` as they stand."""
    return turns(conversations)


def _joined():
    """The keys of a sequence one after the other, as one binary value."""

    def run(batches):
        for batch in batches:
            keys = batch.column(1)
            inner = keys.values.cast(pa.large_binary())
            border = np.asarray(inner.buffers()[1]).view(np.int64)[inner.offset : inner.offset + len(inner) + 1]
            at = border[np.asarray(keys.offsets)]
            data = inner.buffers()[2]
            offsets = pa.py_buffer((at - at[0]).astype(np.int32).tobytes())
            body = data.slice(int(at[0]), int(at[-1] - at[0])) if data is not None else pa.py_buffer(b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.Array.from_buffers(pa.binary(), len(batch), [None, offsets, body])], ["conv_id", "sequence"])

    return run


def shared_keys(a: bytes, b: bytes) -> int:
    """How many turns two sequences have in common from the start."""
    lo, hi = 0, min(len(a), len(b)) // KEY
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[: mid * KEY] == b[: mid * KEY] else (lo, mid - 1)
    return lo


class SearchTree:
    """Ternary search tree over sequences of encoded turns; node 0 is the root's level entry."""

    def __init__(self):
        self.turn, self.low, self.high, self.down, self.row = [], [], [], [], []

    def _node(self, turn: int) -> int:
        self.turn.append(turn)
        for links in (self.low, self.high, self.down, self.row):
            links.append(-1)
        return len(self.turn) - 1

    def insert(self, sequence: list[int], row: int) -> None:
        """Put a sequence of one turn or more in; ``row`` is kept at its last node."""
        links, at = self.down, -1  # where the next node hangs; -1 is the root
        here = 0 if self.turn else -1
        for k, turn in enumerate(sequence):
            while here >= 0 and self.turn[here] != turn:
                links, at = (self.low, here) if turn < self.turn[here] else (self.high, here)
                here = links[here]
            if here < 0:
                here = self._node(turn)
                if at >= 0:
                    links[at] = here
            if k == len(sequence) - 1:
                self.row[here] = row
            else:
                links, at, here = self.down, here, self.down[here]

    def walk(self):
        """(node, its parent in the trie, depth) in such an order that parents come before their children."""
        stack = [(0, -1, 1)] if self.turn else []
        while stack:
            node, parent, depth = stack.pop()
            yield node, parent, depth
            for nxt, above, deep in ((self.low[node], parent, depth), (self.high[node], parent, depth), (self.down[node], node, depth + 1)):
                if nxt >= 0:
                    stack.append((nxt, above, deep))


def medians(n: int):
    """0 to n-1, the middle first, then the middles of both halves, and so on."""
    todo = [(0, n)]
    for lo, hi in todo:
        if lo < hi:
            mid = (lo + hi) // 2
            yield mid
            todo += [(lo, mid), (mid + 1, hi)]


def summarise(rows: list[bytes], ids: list[int]) -> list[dict]:
    """The nodes of a block of sorted sequences, parents first. Those on the paths of the first and the last sequence have a ``key``: they are open."""
    new = [k for k in range(len(rows)) if k == 0 or rows[k] != rows[k - 1]]
    different, ends = [rows[k] for k in new], [*new[1:], len(rows)]
    members = [ids[a:b] for a, b in zip(new, ends, strict=True)]
    keys = sorted({s[i : i + KEY] for s in different for i in range(0, len(s), KEY)})
    dictionary = {key: k for k, key in enumerate(keys)}
    encoded = [[dictionary[s[i : i + KEY]] for i in range(0, len(s), KEY)] for s in different]
    tree = SearchTree()
    for k in medians(len(different)):
        if encoded[k]:
            tree.insert(encoded[k], k)
    root = n = len(tree.turn)  # the root takes the place behind all others
    parent, depth, order = [root] * n + [-1], [0] * (n + 1), []
    for node, above, deep in tree.walk():
        parent[node], depth[node] = above if above >= 0 else root, deep
        order.append(node)
    row = [*tree.row, 0 if not encoded[0] else -1]
    size = [int.from_bytes(keys[t][16:], "big") for t in tree.turn] + [0]
    figures = {name: [0] * (n + 1) for name in FIGURES}
    count, children, leaves, saved = figures.values()
    least: list = [None] * (n + 1)
    for node in [*reversed(order), root]:  # children before their parents
        if row[node] >= 0:
            own = members[row[node]]
            count[node] += len(own)
            least[node] = own[0] if least[node] is None else min(least[node], own[0])
        leaves[node] += not children[node]
        saved[node] += (count[node] - 1) * size[node]
        above = parent[node]
        if above >= 0:
            count[above] += count[node]
            children[above] += 1
            leaves[above] += leaves[node]
            saved[above] += saved[node]
            least[above] = least[node] if least[above] is None else min(least[above], least[node])
    open_keys = {root: b""}
    for sequence in (encoded[0], encoded[-1]):
        above, here = root, 0
        for turn in sequence:
            while tree.turn[here] != turn:
                here = tree.low[here] if turn < tree.turn[here] else tree.high[here]
            open_keys[here] = path_key(open_keys[above], keys[turn])
            above, here = here, tree.down[here]
    out = []
    for node in [root, *order]:
        above, key = parent[node], open_keys.get(node)
        own = ",".join(map(str, members[row[node]])).encode() if row[node] >= 0 else None
        digest = None if key is not None else hashlib.sha256(own).hexdigest() if own else NOTHING
        out.append({
            "conv_id": least[node], "depth": depth[node], "parent_conv_id": least[above] if above >= 0 and above not in open_keys else None, "parent_key": open_keys.get(above), "key": key,
            "ends_sha256": digest, "ends": own if key is not None else None, **{name: values[node] for name, values in figures.items()},
        })
    return out


def path_key(above: bytes, key: bytes) -> bytes:
    """The digest of a path from that of its parent and the last turn's key."""
    return hashlib.md5(above + key).digest()


def corrections(last: bytes, first: bytes) -> list[dict]:
    """What two neighbouring blocks, the one up to ``last`` and the other from ``first``, both counted."""
    shared = shared_keys(last, first)
    goes_on = shared == len(last) // KEY  # so the last node of the first block is no leaf, or one that both have
    keys = [first[k * KEY : (k + 1) * KEY] for k in range(shared)]
    path = [b""]
    for key in keys:
        path.append(path_key(path[-1], key))
    out, size = [], 0
    for depth in range(shared, -1, -1):
        size += int.from_bytes(keys[depth - 1][16:], "big") if depth else 0
        out.append({"depth": depth, "key": path[depth], "parent_key": path[depth - 1] if depth else None, "n_convs": 0, "n_children": -int(depth < shared), "n_leaves": -int(goes_on), "saved_tokens": size})
    return out


def _nodes():
    """Node rows of sorted sequences, a block per Arrow batch, and one row with the part's first and last sequence."""

    def run(batches):
        part = TaskContext.get().partitionId()
        start = last = None
        for block, batch in enumerate(b for b in batches if len(b)):
            rows, ids = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            found = summarise(rows, ids)
            if last is not None:
                found += corrections(last, rows[0])
            start, last = rows[0] if start is None else start, rows[-1]
            yield pa.RecordBatch.from_pylist([{"part": part, "block": block, **r} for r in found], schema=TYPES)
        if last is not None:
            yield pa.RecordBatch.from_pylist([{"part": part, "depth": -1, "first": start, "last": last}], schema=TYPES)

    return run


def _seams(batches):
    for batch in batches:
        rows = [r for last, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in corrections(last, first)]
        yield pa.RecordBatch.from_pylist(rows, schema=TYPES)


def _digests(batches):
    """SHA-256 over the lists of ids of each key, which come one after the other in order."""
    key = state = None
    for batch in batches:
        keys, shas = [], []
        for here, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if here != key:
                if state is not None:
                    keys.append(key)
                    shas.append(state.hexdigest())
                key, state = here, hashlib.sha256(ends)
            else:
                state.update(b"," + ends)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(shas, pa.string())], ["key", "sha"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["key", "sha"])


def trie(rows: DataFrame) -> DataFrame:
    """The nodes of the trie of ``rows`` (``conv_id`` and ``keys``, see ``rebuilt`` and ``sequences``).

    Returns ``conv_id`` (the smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` and ``ends_sha256`` of each node.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    whole = settle(rows.mapInArrow(_joined(), "conv_id long, sequence binary"), "sequences")
    ranges = max(1, -(-(whole.agg(F.sum(F.octet_length("sequence") + 16)).first()[0] or 0) // RANGE_BYTES))
    ordered = whole.repartitionByRange(ranges, "sequence", "conv_id").sortWithinPartitions("sequence", "conv_id").select("conv_id", "sequence")
    found = settle(ordered.mapInArrow(_nodes(), ROW), "trie-blocks")

    parts = found.where("depth = -1").select("part", "first", "last")
    numbers = sorted(r["part"] for r in parts.select("part").collect())  # a number per range
    follow = spark.createDataFrame(list(zip(numbers[:-1], numbers[1:], strict=True)), "part int, next int")
    seams = parts.join(follow, "part").select("last", "next").join(parts.select(F.col("part").alias("next"), "first"), "next").select("last", "first").mapInArrow(_seams, ROW)

    pieces = found.where("depth >= 0 AND key IS NOT NULL").unionByName(seams)
    sums = pieces.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.max("parent_key").alias("parent_key"), *[F.sum(f).alias(f) for f in FIGURES])
    lists = found.where("ends IS NOT NULL").select("key", "part", "block", "ends")
    shas = lists.repartition("key").sortWithinPartitions("key", "part", "block").select("key", "ends").mapInArrow(_digests, "key binary, sha string")
    open_nodes = settle(sums.join(shas, "key", "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(NOTHING))).drop("sha"), "open-nodes")

    columns = ["conv_id", "depth", "parent_conv_id", *FIGURES, "ends_sha256"]
    above = open_nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    below = found.where("depth > 0 AND key IS NULL")
    children = below.where("parent_key IS NOT NULL").drop("parent_conv_id").select("parent_key", *[c for c in columns if c != "parent_conv_id"])
    children = children.unionByName(open_nodes.where("depth > 0").select(*children.columns))
    times = open_nodes.select(F.col("key").alias("parent_key"), F.col("n_children").alias("times"))
    root = open_nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    out = [below.where("parent_key IS NULL"), with_hot(children, above, times, "parent_key"), root]
    return out[0].select(*columns).unionByName(out[1].select(*columns)).unionByName(out[2].select(*columns))
