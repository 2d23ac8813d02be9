"""The trie of conversations against plain dictionaries, the radix tree against a dictionary."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from marketspark.llm import prefix_trie
from marketspark.llm.radix_tree import Direct, Indexed, RadixTree, Small

SCHEMA = "conv_id long, turn long, role string, text string, range string, prefix int"


def brute(rows):
    """Rows of the contract from (conv_id, turn, role, text, ...) with distinct turns."""
    turns = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    original = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in turns.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c in sorted(original):
        h = zlib.crc32(str(c).encode()) % 9
        seq = tuple(original.get(c - c % 5, [])[:h] + original[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def below(node):
        yield node
        for child in children[node]:
            yield from below(child)

    out = []
    for node, convs in members.items():
        sub = list(below(node))
        out.append((
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children[node]), sum(not children[s] for s in sub),
            sum((len(members[s]) - 1) * len(s[-1][1].encode()) for s in sub if s), hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in prefix_trie.RESULT) for r in df.collect()), key=str)


def conversations(seed, n, width=3, hot=0):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for turn in range(rng.randrange(1, 12)):
            text = "same" if c < hot else rng.choice(["a", "é", "", None, "long " * 9][:width])
            rows.append((c * rng.choice([1, 1, 3]) if not turn else rows[-1][0], turn, rng.choice(["user", "", None]) if c >= hot else "user", text, "x", 1))
    return list({(r[0], r[1]): r for r in rows}.values())


@pytest.mark.parametrize("seed,n,width,hot", [(1, 40, 3, 0), (2, 200, 2, 70), (3, 150, 5, 0)])
def test_nodes(spark, seed, n, width, hot):
    rows = conversations(seed, n, width, hot)
    assert got(prefix_trie.query(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_odd_rows(spark):
    """Null ids, null turns, turnless and prefix conversations, ids far apart and below zero's edge."""
    rows = [(1, 0, "u", "only", "", 0), (10, None, "u", "z", "", 0), (10, 1, "u", "a", "", 0), (10, 2, None, None, "", 0), (None, 1, "u", "lost", "", 0)]
    rows += [(c, t, "u", f"t{t}", "", 0) for c in (15, 20, 1_000_000, 7_000_005) for t in range(12)]
    rows += [(25, t, "u", f"t{t}", "", 0) for t in range(6)]
    rows += [(1_000_001, 0, "user", "x" * 300_000, "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(prefix_trie.query(df)) == brute(rows)
    assert prefix_trie.query(df.where("conv_id < 0")).collect() == []


def test_repeated_rows_are_turns(spark):
    rows = [(5, 1, "u", "a", "", 0)] * 2 + [(10, 1, "u", "a", "", 0)]
    assert {(r["depth"], r["n_convs"], r["n_leaves"]) for r in prefix_trie.query(spark.createDataFrame(rows, SCHEMA)).collect()} == {(0, 2, 1), (1, 2, 1), (2, 1, 1)}


def test_radix_tree_layouts():
    rng = random.Random(4)
    tree, kinds = RadixTree(), set()
    keys = {bytes(rng.randrange(256) if rng.random() < 0.5 else 7 for _ in range(rng.randrange(6))) for _ in range(6000)}
    for key in keys:
        tree.insert(key, key)
    found, stack = [], [(tree.root, b"")]
    while stack:
        node, at = stack.pop()
        at += node.path
        if node.value is not None:
            assert node.value == at
            found.append(at)
        kinds.add(type(node.layout))
        children = node.children()
        assert node.value is not None or len(children) > 1 or node is tree.root
        assert [c.path[0] for c in children] == sorted({c.path[0] for c in children})
        stack += [(child, at) for child in reversed(children)]
    assert found == sorted(keys)
    assert kinds == {type(None), Small, Indexed, Direct}
