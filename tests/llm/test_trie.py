import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from eventloom.llm import queries, trie

from . import brute

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes_of(convs):
    """{conversation: [(turn, words)]} to rows of COLUMNS."""
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = sum(saved[k] for k in children[p]) + ((len(members[p]) - 1) * p[-1][1] if p else 0)
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return sorted((m[0], len(p), members[p[:-1]][0] if p else -1, len(m), len(children[p]), leaves[p], saved[p], sha([c for c in m if len(convs[c]) == len(p)])) for p, m in members.items())


def rebuild(rows, step=20):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, key, len(brute.WORD.findall(text))))
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = [(t[2], t[3]) for t in sorted(own.get(c - c % step, []))[:h] + sorted(own[c])[h:]]
    return out


def got(df):
    assert df.columns == COLUMNS
    return sorted(tuple(-1 if k == 2 and x is None else x for k, x in enumerate(r)) for r in df.collect())


@pytest.mark.parametrize("part_keys", [3, 50_000])
def test_trie_of_conversations(spark, monkeypatch, part_keys):
    """Shared first turns, copies, conversations that begin others, a long one, nulls, ties and repeated rows."""
    monkeypatch.setattr(trie, "PART_KEYS", part_keys)
    rng = random.Random(part_keys)
    rows = []
    for c in range(130):
        n = 150 if c == 77 else rng.randrange(1, 7)
        for t in range(n):
            hot = t == 0 and rng.random() < 0.5
            rows.append((c, t, rng.choice(["user", "assistant", None]), "the same opening" if hot else rng.choice(["a b", "b c d", "e", "", None, "f  g\n"])))
    rows += [(200 + c, t, "user", "copy of one") for c in range(40) for t in range(3)] + [(300, None, "x", "y"), (300, None, "x", "z"), (300, 1, "x", "y"), (300, 1, "x", "y"), (None, 1, "a", "b"), (441, 0, "u", "v")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"key": F.lit(1), "h": F.lit(2), "a.b": F.lit(3), "words": F.lit(1)}).repartition(3)
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    assert got(trie.prefix_trie(trie.rebuilt(df, 20, head))) == nodes_of(rebuild(rows))
    assert trie.prefix_trie(trie.rebuilt(df.limit(0), 20, head)).count() == 0


def test_trie_of_repeated_rows_and_no_turns(spark):
    rows = [(4, b"", []), (2, b"", []), (2, b"a" * 16, [3]), (2, b"a" * 16, [3]), (9, b"a" * 15 + b"b" + b"c" * 16, [1, 1])]
    found = got(trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, key binary, words array<long>")))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert found == sorted([(2, 0, -1, 5, 2, 2, 3, sha("2,4")), (2, 1, 2, 2, 0, 1, 3, sha("2,2")), (9, 1, 2, 1, 1, 1, 0, sha("")), (9, 2, 9, 1, 0, 1, 0, sha("9"))])


def test_radix_tree_layouts():
    """Ids that share bytes, and nodes of each size."""
    keys = sorted({bytes([a, b]) + bytes(14) for a in range(256) for b in (0, 7)} | {bytes(16) + bytes([a]) + bytes(15) for a in range(40)} | {bytes(16), bytes(32) + bytes([9]) * 16})
    root = trie.Node(b"", 0)
    for row, k in enumerate(keys):
        trie.insert(root, k, row)
    assert root.places is None and root.keys is None and len(root.children()) == 256
    convs = list(range(len(keys)))
    words = [[1] * (len(k) // 16) for k in keys]
    found = trie.trie_of(keys, convs, words)
    want = {k[: 16 * d] for k in keys for d in range(len(k) // 16 + 1)}
    assert len(found) == len(want) and found[-1][9] == -1 and found[-1][4] == len(keys)
    assert all(found[x[9]][0] == x[0] - 1 for x in found[:-1])


def test_registered_query_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{sf}/conversations.parquet')")
    want = con.execute(f"select {', '.join(COLUMNS)} from ({queries.OP11_SQL})").fetchall()
    assert got(queries.op11_conversation_trie(spark, sf)) == sorted(tuple(-1 if k == 2 and x is None else x for k, x in enumerate(r)) for r in want)
