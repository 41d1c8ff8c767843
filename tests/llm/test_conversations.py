"""The prefix trie of conversations against brute force, on small tables with the odd cases."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from spanwarden.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def brute(rows):
    turns = defaultdict(list)
    for c, t, r, x, _ in rows:
        if c is not None:
            digest = hashlib.sha256(f"{len((r or '').encode())}:{r or ''}{x or ''}".encode()).hexdigest()[:32]
            turns[c].append(((t is not None, t or 0, digest), (r or "", x or "")))
    own = {c: [x for _, x in sorted(v, key=lambda p: p[0])] for c, v in turns.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
    members = defaultdict(set)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].add(c)
    children = defaultdict(set)
    for n in members:
        if n:
            children[n[:-1]].add(n)
    out = []
    for n, m in members.items():
        under = [x for x in members if x[: len(n)] == n]
        ends = ",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(n))
        out.append((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), sum(not children[x] for x in under), sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in under if x), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows(seed, n=80):
    rng = random.Random(seed)
    out = []
    common = [("user", f"hello {i} é") for i in range(14)]
    for c in rng.sample(range(3 * n), n):
        length = rng.choice([1, 2, 3, 5, 8, 13])
        kind = rng.random()
        for t in range(length):
            if kind < 0.4:
                r, x = common[t]
            else:
                r, x = rng.choice(["user", None]), rng.choice(["a", "b", "", None, "long " * 9])
            out.append((c, t, r, x, "clash"))
    out += [(1, None, "user", "first", "x"), (None, 0, "user", "lost", "x"), out[3], out[3]]
    out += [(c, t, "user", f"t{t}", None) for c in (1000, 1005, 1010) for t in range(23)] + [(1015, t, "user", f"u{t}", None) for t in range(31)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed,band,shard", [(1, 1024, 200_000), (2, 4, 12), (3, 3, 5), (4, 1, 40), (5, 7, 1)])
def test_prefix_trie_brute_force(spark, seed, band, shard):
    data = rows(seed)
    got = conversations.prefix_trie(spark.createDataFrame(data, SCHEMA), band=band, shard=shard).collect()
    assert sorted(map(tuple, got), key=repr) == brute(data)


def test_prefix_trie_of_copies_spreads_over_shards(spark):
    data = [(5 * c, t, "user", f"same {t}", None) for c in range(60) for t in range(12)]
    got = conversations.prefix_trie(spark.createDataFrame(data, SCHEMA), band=1024, shard=40).collect()
    assert sorted(map(tuple, got), key=repr) == brute(data)


def test_prefix_trie_of_no_rows(spark):
    assert conversations.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert conversations.prefix_trie(spark.createDataFrame([(None, 1, "a", "b", "c")], SCHEMA)).collect() == []


def test_turnless_conversations_are_members_of_the_root(spark):
    lone = next(c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 3)
    data = [(lone, t, "user", "x", None) for t in range(3)]
    got = conversations.prefix_trie(spark.createDataFrame(data, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(data) and len(got) == 1


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 3000])
def test_find_close(n):
    rng = random.Random(n)
    bits, depth = [], 0
    for _ in range(n):
        bits.append(1)
        depth += 1
        while depth and rng.random() < 0.5:
            bits.append(0)
            depth -= 1
    bits += [0] * depth
    want, stack = {}, []
    for i, b in enumerate(bits):
        if b:
            stack.append(i)
        else:
            want[stack.pop()] = i
    tree = conversations.Parentheses(np.array(bits))
    assert tree.close().tolist() == [want[p] for p in tree.opens.tolist()]
