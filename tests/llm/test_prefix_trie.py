"""The conversation trie against plain Python."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from ranklake.llm import prefix_trie

TURNS = "conv_id long, turn long, role string, text string, path string, parent string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(conversations):
    """Rows of the trie of (conv_id, [(role, text), ...])."""
    members, ends = defaultdict(list), defaultdict(list)
    for conv, turns in conversations:
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
        ends[tuple(turns)].append(conv)
    least = {k: min((c for c in v if c is not None), default=None) for k, v in members.items()}
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    for k, v in members.items():
        own = (len(v) - 1) * len(WORD.findall(k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += own
    out = []
    for k, v in members.items():
        ids = ",".join(map(str, sorted(c for c in ends[k] if c is not None)))
        out.append((least[k], len(k), least[k[:-1]] if k else None, len(v), kids[k], leaves[k], saved[k], hashlib.sha256(ids.encode()).hexdigest()))
    return out


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def random_conversations(r, n, names="ab", longest=9):
    return [(c, [(r.choice(["user", "assistant"]), r.choice(names) * r.randint(1, 2) + " x" * r.randint(0, 1)) for _ in range(r.randint(0, longest))]) for c in range(n)]


def turn_rows(conversations):
    return [(c, i, role, text, "clash", "clash") for c, turns in conversations for i, (role, text) in enumerate(turns)]


def with_paths(spark, conversations):
    own = prefix_trie.paths(spark.createDataFrame(turn_rows(conversations), TURNS))
    bare = [(c,) for c, turns in conversations if not turns]
    if bare:
        own = own.unionByName(spark.createDataFrame(bare, "conv_id long"), allowMissingColumns=True)
    return own


def test_two_fattest():
    for a in range(40):
        for b in range(a + 1, 41):
            got = prefix_trie.two_fattest(a, b)
            assert got == max(range(a + 1, b + 1), key=lambda x: x & -x)


def test_exit_nodes_and_edges_equal_a_plain_trie():
    r = random.Random(1)
    for _ in range(120):
        trie, known = prefix_trie.ZFastTrie(), {}
        for k in range(r.randint(1, 40)):
            path = [r.choice([b"a", b"b"]) if r.random() < 0.5 else b"a" for _ in range(r.randint(0, 20))]
            if tuple(path) in known:
                continue
            known[tuple(path)] = k
            trie.insert_batch([(prefix_trie.chained(path), [1] * len(path), 1, k, None)])
        got = trie.expand()
        want = defaultdict(list)
        for path, k in known.items():
            for d in range(len(path) + 1):
                want[prefix_trie.chained(path[:d])[-1]].append(k)
        assert {key: (n.n_convs, n.conv_id) for key, n in got.items()} == {key: (len(v), min(v)) for key, v in want.items()}
        # Compacted: an inner node branches, or a path ends there.
        seen = [trie.root]
        while seen:
            node = seen.pop()
            seen.extend(node.children.values())
            assert node is trie.root or len(node.children) > 1 or node.count
            assert node is trie.root or trie.handles[node.handle()] is node


def test_fat_binary_search_is_logarithmic():
    path = [str(i).encode() for i in range(4000)]
    trie, chain = prefix_trie.ZFastTrie(), prefix_trie.chained(path)
    for end in range(0, 4001, 5):
        trie.insert(chain[: end + 1], [1] * end)

    class Counted(dict):
        asked = 0

        def get(self, key):
            Counted.asked += 1
            return dict.get(self, key)

    trie.handles = Counted(trie.handles)
    assert trie.exit_node(chain).end == 4000 and Counted.asked <= 13


@pytest.mark.parametrize("batch, merge", [(50_000, 256), (7, 2), (1, 2), (40, 3)])
def test_nodes(spark, batch, merge):
    r = random.Random(batch)
    conversations = random_conversations(r, 150) + [(None, [("user", "a")]), (200, []), (201, [])]
    # A hot conversation, a long one, and one whose beginning is another's whole.
    conversations += [(300 + k, [("user", "hot"), ("assistant", "")]) for k in range(120)]
    conversations += [(500, [("user", str(i)) for i in range(700)]), (501, [("user", str(i)) for i in range(350)])]
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = prefix_trie.nodes(with_paths(spark, conversations), batch, merge).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert in_order(got) == in_order(brute(conversations))


def test_edges(spark):
    rows = [
        (1, 1, None, None, "p", "p"), (1, None, "user", "first", "p", "p"), (1, 1, "a", "z", "p", "p"), (1, 1, "a", "z", "p", "p"),
        (2, 0, "user", "first", "p", "p"), (2, 5, "", "", "p", "p"), (3, 0, "user", " \t" + "w " * 30_000, "p", "p"), (None, None, None, None, "p", "p"),
    ]
    want = brute([(1, [("user", "first"), ("", ""), ("a", "z"), ("a", "z")]), (2, [("user", "first"), ("", "")]), (3, [("user", " \t" + "w " * 30_000)]), (None, [("", "")])])
    turns = spark.createDataFrame(rows, TURNS)
    assert in_order(prefix_trie.nodes(prefix_trie.paths(turns)).collect()) == in_order(want)
    assert prefix_trie.nodes(prefix_trie.paths(turns.limit(0))).count() == 0
    # The role's end is not the text's beginning.
    pair = spark.createDataFrame([(1, 0, "ab", "c", "", ""), (2, 0, "a", "bc", "", "")], TURNS)
    assert prefix_trie.nodes(prefix_trie.paths(pair)).filter("depth = 1").count() == 2
