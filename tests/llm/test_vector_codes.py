"""Codes by integer codebooks against SQL and a plain loop in whole numbers."""

import hashlib
import math
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from hydrostrata.llm import oracle, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, n long, slot int"


def frame(spark, rows):
    """Vectors with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(*r, "c", 1, 2) for r in rows], SCHEMA)


def brute(rows, parts, entries, rounds):
    kept = [(i, [math.floor(np.float32(x).item() * 256) for x in v], g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    cut = lambda v: [v[p * len(v) // parts : (p + 1) * len(v) // parts] for p in range(parts)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v)[p] for _, v, _ in first] for p in range(parts)]

    def best(v):
        out = []
        for p, x in enumerate(cut(v)):
            d = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in books[p]]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        members = defaultdict(list)
        for _, v, _ in kept:
            for p, (e, _) in enumerate(best(v)):
                members[p, e].append(cut(v)[p])
        for (p, e), own in members.items():
            books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    total = defaultdict(int)
    for _, v, g in kept:
        total[g] += sum(d for _, d in best(v))
    digest = hashlib.sha256(",".join(str(x) for p in books for c in p for x in c).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for e, _ in best(v)), sum(d for _, d in best(v)), total[g]) for i, v, g in kept), key=str), digest


def result(spark, rows, parts=16, entries=64, rounds=2):
    codes, books = vector_codes.compress(frame(spark, rows).repartition(3), parts=parts, entries=entries, rounds=rounds)
    got = codes.collect()
    total = defaultdict(int)
    for r in got:
        total[r["label"]] += r["error"]
    return sorted(((r["vec_id"], r["code"], r["error"], total[r["label"]]) for r in got), key=str), vector_codes.books_digest(books)


def test_query_equals_sql(spark, sf_dir):
    got = vector_codes.op12_integer_codebooks(spark, sf_dir)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    rel = con.sql(oracle.VECTOR_CODES)
    assert sorted(map(tuple, got.select(*rel.columns).collect())) == sorted(rel.fetchall())
    assert dict(got.dtypes) == {"vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint", "codebooks_sha256": "string"}


def test_odd_rows_against_brute_force(spark):
    rng = random.Random(3)
    draw = lambda: [rng.choice([-1.0, -0.25, 0.0, 0.5, 0.00390625, -0.001, rng.uniform(-3, 3)]) for _ in range(32)]
    rows = [(i, draw(), rng.choice([None, 0, 1])) for i in range(300)]
    rows += [(i, rows[5][1], 7) for i in range(300, 420)]  # many copies
    rows += [(None, draw(), None), (None, draw(), 1), (9, draw(), 2), (9, rows[9][1], rows[9][2]), (-4, draw(), 0)]
    rows += [(500, None, 1), (501, [None] + [1.0] * 31, 1), (502, [math.nan] * 32, 1), (503, [math.inf] + [0.0] * 31, None), (504, [0.0] * 31 + [-math.inf], 1)]
    for parts, entries, rounds in ((16, 64, 2), (4, 5, 3), (32, 2, 1), (16, 64, 0)):
        assert result(spark, rows, parts, entries, rounds) == brute(rows, parts, entries, rounds)
    assert result(spark, rows[:20]) == brute(rows[:20], 16, 64, 2)  # fewer vectors than entries
    equal = [(i, [0.5] * 16, None) for i in range(70)]  # every entry is equally near
    assert result(spark, equal) == brute(equal, 16, 64, 2)
    assert {r[1] for r in result(spark, equal)[0]} == {"00" * 16}


def test_large_components_and_bounds(spark):
    rows = [(i, [65536.0 * (-1) ** (i + k) for k in range(16)], 1) for i in range(4)] + [(9, [-65536.0] * 16, 1)]
    assert result(spark, rows, entries=1) == brute(rows, 16, 1, 2)
    for bad in ([(1, [1.0] * 16, 0), (2, [1.0] * 32, 0)], [(1, [1.0] * 15, 0)], [(1, [1.0] * 8192, 0)]):
        with pytest.raises(ValueError, match="one length"):
            vector_codes.compress(frame(spark, bad))
    with pytest.raises(Exception, match="beyond"):
        vector_codes.compress(frame(spark, [(1, [70000.0] * 16, 0)]))


def test_empty(spark):
    for rows in ([], [(1, None, 3)]):
        codes, books = vector_codes.compress(frame(spark, rows))
        assert codes.count() == 0 and books.size == 0
    assert [tuple(r) for r in vector_codes.compress(frame(spark, [(1, [], 3)]))[0].collect()] == [(1, 3, "00" * 16, 0)]


def test_decompress(spark):
    rows = [(i, [(i * 7 + k) % 13 / 16 for k in range(32)], 0) for i in range(40)]
    codes, books = vector_codes.compress(frame(spark, rows))
    for r in vector_codes.decompress(codes, books).collect():
        assert np.allclose(r["vector"], rows[r["vec_id"]][1], atol=1 / 256)  # as many entries as vectors: each has its own
