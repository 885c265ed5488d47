"""The prefix trie of conversations against SQL and a trie of Python dicts."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from hydrostrata.llm import conversation_trie, oracle

SCHEMA = "conv_id long, turn long, role string, text string, depth int, chain long, h1 long, n int"


def frame(spark, rows):
    """Turns with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(*r, 5, 6, 7, 8) for r in rows], SCHEMA)


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        whole = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        saved[k] = sum(saved[x] for x in children[k]) + (len(members[k]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0)
    return sorted((members[k][0], len(k), members[k[:-1]][0] if k else None, len(members[k]), len(children[k]), leaves[k], saved[k], hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest()) for k in members)


def found(df):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert df.columns == columns and {t for _, t in df.dtypes} == {"bigint", "string"}
    return sorted(tuple(r) for r in df.collect())


def test_query_equals_sql(spark, sf_dir):
    got = conversation_trie.op13_prefix_trie(spark, sf_dir)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    rel = con.sql(oracle.PREFIX_TRIE)
    rows = sorted(tuple(r) for r in got.select(*rel.columns).collect())
    assert rows == sorted(rel.fetchall()) and len(rows) > 50
    assert rows == brute([tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])


def _random(seed, convs, texts, most):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", None]), rng.choice(texts)) for c in rng.sample(range(convs * 3), convs) for t in range(rng.randrange(1, most))]


@pytest.mark.parametrize("seed", [1, 2])
def test_nested_branches(spark, seed):
    rows = _random(seed, 150, ["a", "b c"], 9)
    random.Random(seed).shuffle(rows)
    assert found(conversation_trie.prefix_trie(frame(spark, rows).repartition(5))) == brute(rows)


def test_odd_rows(spark):
    long = "word " * 60_000
    rows = [(1, None, None, None), (1, 2, "user", ""), (1, 2, "user", ""), (1, 1, "", None), (2, 1, "a", "b:c"), (2, 2, "a:", "bc"), (None, 1, "user", "lost"), (None, None, None, None)]
    rows += [(20, k, "user", long if k == 1 else "x") for k in range(5)] + [(21, k, "user", long) for k in range(2)] + [(22, 0, "u", " \t\x0b ")]
    rows += [(c, k, "user", "same text here") for c in range(40, 100) for k in range(6)]  # copies
    rows += [(500, k, "user", f"t {k}") for k in range(300)] + [(501, k, "user", f"t {k}") for k in range(200)]  # many turns
    rows += [(1000 + c, 0, "user", f"own {c}") for c in range(0, 19)]  # their base has one turn
    rows += [(10**15 + 7, 0, "user", "far"), (3000, 0, "a", "x y"), (3001, 0, "a", "x y")]
    got = found(conversation_trie.prefix_trie(frame(spark, rows)))
    assert got == brute(rows)
    assert sum(r[1] == 0 for r in got) == 1
    ties = [(7, 1, r, t) for r in ("u", "v") for t in ("p", "q")]
    assert len(found(conversation_trie.prefix_trie(frame(spark, ties)))) in (2, 3, 4, 5)


def test_empty(spark):
    assert found(conversation_trie.prefix_trie(frame(spark, []))) == []
    assert found(conversation_trie.prefix_trie(frame(spark, [(None, 1, "a", "b")]))) == []


def test_rounds_follow_nesting_not_length(spark, monkeypatch):
    rounds, keep = [], conversation_trie.stored

    def counted(df, name):
        rounds.append(name)
        return keep(df, name)

    monkeypatch.setattr(conversation_trie, "stored", counted)
    rows = [(c, k, "u", f"{k}") for c in (500, 503) for k in range(150)]
    assert found(conversation_trie.prefix_trie(frame(spark, rows))) == brute(rows)
    assert rounds.count("chains") <= 3


def test_ids_of_a_large_node_in_pieces(spark):
    ids = random.Random(4).sample(range(10**9), 3000)
    ends = spark.createDataFrame([(1, 5, 6, i) for i in ids] + [(2, 5, 6, 3), (1, 5, 7, 4), (1, 5, 7, 11)], "depth int, h1 long, h2 long, conv_id long").repartition(6)
    got = {tuple(r)[:3]: r["ends_sha256"] for r in conversation_trie.joined_ids(ends, 500).collect()}
    want = {(1, 5, 6): sorted(ids), (2, 5, 6): [3], (1, 5, 7): [4, 11]}
    assert got == {k: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for k, v in want.items()}
