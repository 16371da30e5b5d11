"""Prefix trie of conversations.

Every distinct turn has a fixed-width id, and a conversation's key is its turns' ids laid end to end, big-endian. The keys
are sorted over the cluster. Each task cuts its range into parts and builds an adaptive radix tree of each: nodes of
four sizes that grow with their children, and paths without branches kept as one string. Ids share bytes, so a tree also
branches inside an id; only depths that end a turn are nodes of the trie.

All of a part's nodes are complete but those on the way to its first and its last key, which other parts may share. These
edge nodes, two paths a part at most, are merged by grouping. Sums over subtrees are then sums over edge keys: of the edge
keys that pass a node the least owns it, and what a key owns is the lower end of its path.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, n_words_of

WIDTH = 16  # bytes of a turn id
PART = 1 << 22  # bytes of keys in a tree, about; one key at least
PART_KEYS = 50_000


class Node:
    """A node of the radix tree: the path that leads to it, its children, the rows that end here, and its first and last row.

    Up to 4, then up to 16 children: sorted first bytes beside the children. Up to 48: a table of 256 places into the list
    of children. Beyond: a list of 256 children.
    """

    __slots__ = ("ends", "first", "keys", "kids", "last", "path", "places")

    def __init__(self, path: bytes, row: int):
        self.path, self.keys, self.kids, self.places, self.ends, self.first, self.last = path, bytearray(), [], None, [], row, row

    def child(self, byte: int):
        if self.keys is not None:
            at = self.keys.find(byte)
            return self.kids[at] if at >= 0 else None
        if self.places is not None:
            at = self.places[byte]
            return self.kids[at - 1] if at else None
        return self.kids[byte]

    def put(self, byte: int, kid: Node) -> None:
        """Add a child, or put another in its place."""
        if self.keys is not None:
            at = bisect_left(self.keys, byte)
            if at < len(self.keys) and self.keys[at] == byte:
                self.kids[at] = kid
            elif len(self.keys) < 16:
                self.keys.insert(at, byte)
                self.kids.insert(at, kid)
            else:
                self.places = bytearray(256)
                for n, b in enumerate(self.keys, 1):
                    self.places[b] = n
                self.keys = None
                self.put(byte, kid)
        elif self.places is not None:
            if at := self.places[byte]:
                self.kids[at - 1] = kid
            elif len(self.kids) < 48:
                self.kids.append(kid)
                self.places[byte] = len(self.kids)
            else:
                self.kids = [self.kids[n - 1] if n else None for n in self.places]
                self.places = None
                self.put(byte, kid)
        else:
            self.kids[byte] = kid

    def children(self) -> list:
        return [k for k in self.kids if k is not None]


def _shared(a: bytes, key: bytes, at: int) -> int:
    """How many bytes of a stand in key from at on."""
    if key.startswith(a, at):
        return len(a)
    lo, hi = 0, len(a)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if key.startswith(a[:mid], at) else (lo, mid - 1)
    return lo


def insert(root: Node, key: bytes, row: int) -> None:
    """Put a row under its key; rows come in order."""
    node, at = root, 0
    while True:
        node.last = row
        if at == len(key):
            node.ends.append(row)
            return
        kid = node.child(key[at])
        if kid is None:
            kid = Node(key[at:], row)
            node.put(key[at], kid)
            node, at = kid, len(key)
            continue
        n = _shared(kid.path, key, at)
        if n < len(kid.path):
            fork = Node(kid.path[:n], kid.first)
            kid.path = kid.path[n:]
            fork.put(kid.path[0], kid)
            node.put(fork.path[0], fork)
            kid = fork
        node, at = kid, at + n


def _joined(ids) -> bytes:
    return ",".join(map(str, ids)).encode()


def trie_of(keys: list[bytes], convs: list[int], words: list, width: int = WIDTH):
    """Nodes of sorted keys: (depth, first row, last row, smallest conversation, members, children, leaves, saved, ends, parent).

    Nodes stand below their parents' places: parent is a place in the list, -1 for the root, which is the last. A node
    that the first or last row passes has sums over its complete descendants only: children, leaves and saved leave out
    nodes on the two edges, and the node itself.
    """
    root = Node(b"", 0)
    for row, key in enumerate(keys):
        insert(root, key, row)
    out: list[list] = []
    final = len(keys) - 1
    # each tree node after its children; below: places of the nearest trie nodes under it
    done: dict[int, tuple] = {}
    todo = [(root, 0, False)]
    while todo:
        node, start, ready = todo.pop()
        end = start + len(node.path)
        if not ready:
            todo.append((node, start, True))
            todo += [(kid, end, False) for kid in node.children()]
            continue
        n, least, below, leaves, saved = len(node.ends), min((convs[r] for r in node.ends), default=None), [], 0, 0
        for kid in node.children():
            kn, kleast, kbelow, kleaves, ksaved = done.pop(id(kid))
            n, least, leaves, saved = n + kn, kleast if least is None or kleast < least else least, leaves + kleaves, saved + ksaved
            below += kbelow
        lowest = start // width * width + width if node is not root else 0
        for at in range(end // width * width, lowest - 1, -width):
            depth = at // width
            edge = node.first == 0 or node.last == final
            closed = [p for p in below if not out[p][-1]]
            own = (n - 1) * words[node.first][depth - 1] if depth else 0
            ends = node.ends if at == end else []
            place = len(out)
            if edge:
                out.append([depth, node.first, node.last, least, n, len(closed), leaves, saved, ends, None, True])
            else:
                leaves, saved = leaves if below else 1, saved + own
                out.append([depth, node.first, node.last, least, n, len(below), leaves, saved, ends, None, False])
            for p in below:
                out[p][9] = place
            below = [place]
        done[id(node)] = (n, least, below, leaves, saved)
    for x in out:
        x[9] = -1 if x[9] is None else x[9]
    return out


_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: edge: the part and side of the edge key that a row belongs to, or that its parent lies on at depth - 1.
#: kind: node, complete; child, complete but for the parent's smallest member; edge, a part's share of an edge node; path,
#: an edge key's passing of a node that its part's other edge key counts; ends, conversations that end at an edge node.
_ROW = f"kind string, edge string, path binary, words long, ends binary, {_NODE}"


def _rows(part: str, keys: list, convs: list, words: list):
    """Rows of _ROW for one part."""
    found = trie_of(keys, convs, words)
    empty = hashlib.sha256(b"").hexdigest()
    for depth, first, _, least, n, children, leaves, saved, ends, parent, edge in found:
        if edge:
            continue
        sha = hashlib.sha256(_joined(convs[r] for r in ends)).hexdigest() if ends else empty
        over = found[parent]
        side = "a" if over[1] == 0 else "b"
        yield ("child", f"{part}{side}", None, None, None, least, depth, None, n, children, leaves, saved, sha) if over[10] else ("node", None, None, None, None, least, depth, over[3], n, children, leaves, saved, sha)
    edges = {(x[1] == 0, x[2] == len(keys) - 1, x[0]): x for x in found if x[10]}
    for side, row in (("a", 0), ("b", len(keys) - 1)):
        h = hashlib.sha256()
        for depth in range(len(keys[row]) // WIDTH + 1):
            h.update(keys[row][(depth - 1) * WIDTH : depth * WIDTH] if depth else b"")
            path, both = h.digest(), edges.get((True, True, depth))
            own = both or edges[(side == "a", side == "b", depth)]
            weight = words[row][depth - 1] if depth else 0
            if both and side == "b":  # counted for the first key
                yield "path", f"{part}{side}", path, weight, None, None, depth, None, None, None, None, None, None
                continue
            _, _, _, least, n, children, leaves, saved, ends, _, _ = own
            yield "edge", f"{part}{side}", path, weight, None, least, depth, None, n, children, leaves, saved, None
            if ends:
                yield "ends", None, path, None, _joined(convs[r] for r in ends), convs[ends[0]], depth, None, None, None, None, None, None


def _build(batches):
    """(conv_id, key, words) in order of key and conv_id, to rows of _ROW: a tree for each part of the task's rows."""
    import pyarrow as pa
    from pyspark import TaskContext

    task, n = TaskContext.get().partitionId(), 0
    names = [c.split()[0] for c in _ROW.split(", ")]
    types = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64()}
    kinds = [types[c.split()[1]] for c in _ROW.split(", ")]

    def show(keys, convs, words):
        held = []
        for row in _rows(f"{task:08d}-{n:08d}", keys, convs, words):
            held.append(row)
            if len(held) == 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    keys, convs, words, size = [], [], [], 0
    for b in batches:
        for conv, key, ws in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            keys.append(key)
            convs.append(conv)
            words.append(ws)
            size += len(key)
            if size >= PART or len(keys) >= PART_KEYS:
                yield from show(keys, convs, words)
                n, size = n + 1, 0
                keys, convs, words = [], [], []
    if keys:
        yield from show(keys, convs, words)


def _digest(batches):
    """(path, first, ends) in order to (path, ends_sha256): the digest of a path's pieces, as they come, with commas between."""
    import pyarrow as pa

    path, h, out = None, None, []
    for b in batches:
        for p, piece in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            if p != path:
                if h is not None:
                    out.append((path, h.hexdigest()))
                path, h = p, hashlib.sha256(piece)
            else:
                h.update(b"," + piece)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], names=["path", "ends_sha256"])
            out = []
    if h is not None:
        yield pa.RecordBatch.from_arrays([pa.array([path], pa.binary()), pa.array([h.hexdigest()], pa.string())], names=["path", "ends_sha256"])


def rebuilt(conversations: DataFrame, step: int, head: Column) -> DataFrame:
    """(conv_id, key, words) of conversations(conv_id, turn, role, text): the first `head` turns of conversation
    conv_id - conv_id % step, then the conversation's own turns after its first `head`. head is a column over conv_id.

    Turns stand by turn, null first, equal ones by their ids; repeated rows stay. Null role or text is empty. Of a text, of
    any length, only its digest and its number of words travel. Rows without conv_id take no part; other columns, of
    whatever name, are left out; an empty table gives no rows.
    """
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    turn_id = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_id.alias("turn_id"), n_words_of(text).alias("n"))
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "turn_id", "n"))).alias("turns")).withColumn("h", head.cast("int"))
    heads = own.where(F.col("conv_id") % step == 0).select(F.col("conv_id").alias("base"), F.col("turns").alias("heads"))
    met = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % step).join(heads.select("base", F.slice("heads", 1, step).alias("heads")), "base", "left")
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    turns = F.concat(F.slice(F.coalesce("heads", F.slice("turns", 1, 0)), F.lit(1), F.col("h")), rest)
    return met.select("conv_id", turns.alias("t")).select("conv_id", F.unhex(F.array_join("t.turn_id", "")).alias("key"), F.col("t.n").alias("words"))


def prefix_trie(keys: DataFrame) -> DataFrame:
    """Nodes of the trie of (conv_id long, key binary: ids of WIDTH bytes a turn, words array<long>: one a turn).

    Returns conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves (childless
    nodes in the subtree, itself included), saved_tokens (over the subtree, (n_convs - 1) times the words of each node's
    last turn), ends_sha256 (of the ids, in order, of the conversations that end here). A conversation without turns is a
    member of the root; an empty table has no root. Equal conversations, repeated rows included, end at one node.

    Keys are dealt by ranges of (key, conv_id), so a first turn or a whole conversation that a third of all rows share is
    spread over tasks; a task holds the keys of one part, and of one conversation however long.
    """
    scratch = Scratch(keys.sparkSession)
    keys = scratch.keep(keys, "keys")
    ordered = keys.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").select("conv_id", "key", "words")
    rows = scratch.keep(ordered.mapInArrow(_build, _ROW), "rows")
    whole = rows.where("kind = 'node'")

    # edge nodes: their parts' shares together
    shares = rows.where("kind = 'edge'")
    path = Window.partitionBy("edge").orderBy("depth")
    passing = rows.where("kind IN ('edge', 'path')").select("edge", "depth", "path", "words").withColumn("over", F.lag("path").over(path))
    known = passing.groupBy("path").agg(F.min("edge").alias("owner"), F.max("over").alias("over"), F.max("words").alias("words"))
    sums = shares.groupBy("path").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")))
    nodes = sums.join(known, "path")
    nodes = scratch.keep(nodes.join(nodes.where("over IS NOT NULL").groupBy(F.col("over").alias("path")).agg(F.count("*").alias("edge_children")), "path", "left").na.fill(0, ["edge_children"]), "edges")
    owned = F.col("owner") == F.col("edge")
    leaf = F.when(owned & (F.col("n_children") + F.col("edge_children") == 0), 1).otherwise(0)
    saved = F.when(owned, (F.col("n_convs") - 1) * F.col("words")).otherwise(0)
    under = Window.partitionBy("edge").orderBy(F.desc("depth"))
    # what complete nodes add to a node also belongs to the edge nodes above it only through the node's own part
    along = passing.select("edge", "path").join(nodes.select("path", "depth", "owner", "n_convs", "n_children", "edge_children", "words"), "path")
    along = along.select("path", F.sum(leaf).over(under).alias("leaves"), F.sum(saved).over(under).alias("saved")).groupBy("path").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    pieces = rows.where("kind = 'ends'").select("path", F.col("conv_id").alias("first"), "ends").repartition("path").sortWithinPartitions("path", "first")
    ends = pieces.mapInArrow(_digest, "path binary, ends_sha256 string")
    above = nodes.select(F.col("path").alias("over"), F.col("conv_id").alias("parent_conv_id"))
    edges = nodes.join(along, "path").join(ends, "path", "left").join(above, "over", "left")
    edges = edges.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", (F.col("n_children") + F.col("edge_children")).alias("n_children"), (F.col("n_leaves") + F.col("leaves")).alias("n_leaves"), (F.col("saved_tokens") + F.col("saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )

    # complete nodes under an edge node: its smallest member, looked up by part, side and depth
    over = passing.join(nodes.select("path", "conv_id"), "path").select("edge", (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("least"))
    child = rows.where("kind = 'child'").join(over, ["edge", "depth"]).withColumn("parent_conv_id", F.col("least"))
    names = [c.split()[0] for c in _NODE.split(", ")]
    return whole.select(*names).unionByName(child.select(*names)).unionByName(edges.select(*names))
