"""The prefix trie against a dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

from llm_fixtures import with_clashes
from piisieve.llm.prefix_trie import (decomposition, end_digests, ordered_turns, prefix_trie, prefixes, trie_nodes,
                                      with_shared_heads)
from piisieve.llm.tables import stored
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append(((t is not None, t or 0, digest), (role, text)))
    turns = {c: [x for _, x in sorted(v, key=lambda r: r[0])] for c, v in own.items()}
    out = {}
    for c, v in turns.items():
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = turns.get(base, [])[:h] + v[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node, m in members.items():
        if node:
            kids[node[:-1]] += 1
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in kids
            saved[node[:d]] += (len(m) - 1) * len(node[-1][1]) if node else 0
    return sorted((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), kids[node], leaves[node], saved[node],
                   hashlib.sha256(",".join(map(str, sorted(c for c in m if len(convs[c]) == len(node)))).encode()).hexdigest())
                  for node, m in members.items())


def odd_conversations():
    rng = random.Random(4)
    rows = []
    for c in [*range(0, 60), *range(100, 130), *range(205, 215), -3, -105]:
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["hi", "ok", "é👍", "", None, "long " * 40])))
    rows += [(c, t, "user", "same") for c in range(300, 330) for t in range(7)]  # copies
    rows += [(400, t, "user", str(t % 3)) for t in range(400)] + [(401, t, "user", str(t % 3)) for t in range(1100)]  # deep
    rows += [(500, None, None, None), (500, None, "user", None), (500, 3, "a", "x"), (500, 3, "a", "x"), (500, 3, "b", "x")]
    rows += [(None, 1, "user", "lost"), (650, 0, "user", "y" * 50_000)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_nodes_of_odd_conversations(spark):
    rows = odd_conversations()
    turns = with_shared_heads(ordered_turns(with_clashes(frame(spark, rows))))
    got = sorted(map(tuple, prefix_trie(turns).collect()))
    assert got == brute(rebuilt(rows))
    assert any(not t for t in rebuilt(rows).values()) or min(map(len, rebuilt(rows).values())) == 0


def test_rounds_are_logarithmic(spark):
    rows = [(1000 + c, t, "user", f"{c if t >= 100 else 0} {t}") for c in range(3) for t in range(300)]
    turns = ordered_turns(frame(spark, rows)).select("conv_id", (F.col("idx") + 1).alias("pos"), "digest", "chars")
    nodes, members = trie_nodes(stored(prefixes(turns), "p"))
    rounds = decomposition(nodes.withColumn("one", F.lit(1).cast("long")), members, ["one"])
    assert len(rounds) <= 11  # 903 prefix rows
    sizes = [r.count() for r in rounds]
    assert sizes[0] == 1 + 100 + 3 * 200 and sizes == sorted(sizes, reverse=True)


def test_end_digests_over_many_ids(spark):
    ends = spark.range(20_000).select(F.lit(7).cast("long").alias("owner"), F.lit(2).cast("long").alias("depth"), (F.col("id") - 50).alias("conv_id"))
    got = end_digests(ends.unionByName(spark.createDataFrame([(8, 2, 5)], ends.schema)).repartition(5)).collect()
    want = hashlib.sha256(",".join(map(str, range(-50, 19_950))).encode()).hexdigest()
    assert {tuple(r) for r in got} == {(7, 2, want), (8, 2, hashlib.sha256(b"5").hexdigest())}


def test_empty_table(spark):
    got = prefix_trie(with_shared_heads(ordered_turns(frame(spark, []))))
    assert got.collect() == [] and got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                                                   "saved_tokens", "ends_sha256"]
