"""Near-duplicates and repeated passages against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from hydrostrata.llm import minhash, run_index
from hydrostrata.llm.graph import components

from .helpers import frame, odd_rows

LOWER = {i: i + 32 for i in range(65, 91)}


def brute_components(rows, k, percent=80):
    sets = {}
    for n, (i, t) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[n] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a in sets:
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None or not sets[a] or not sets[b]:
                continue
            common = len(sets[a] & sets[b])
            if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(rows[a][0]), find(rows[b][0])
                parent[max(x, y)] = min(x, y)
    return sorted((str(i), len(sets[n]), str(None if i is None else find(i) if sets[n] else i)) for n, (i, t) in enumerate(rows))


def planted(seed=1, n=40):
    """Groups of copies and near copies, a chain, and short texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice("ab cd ef gh ij kl mn op".split()) + str(rng.randrange(300))
    rows, i = [], 100
    for _ in range(n):
        base = [word() for _ in range(rng.choice([3, 12, 60, 150]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((i, " ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy)))
            i += 1
            base = copy if rng.random() < 0.5 else base
    rng.shuffle(rows)
    return rows


def same(spark, rows, k):
    got = minhash.near_duplicates(frame(spark, rows), k).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == brute_components(rows, k)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates(spark, sf_dir):
    same(spark, planted(), 4)
    same(spark, odd_rows(), 5)
    docs = [(r["doc_id"], r["text"]) for r in minhash.documents(spark, sf_dir).collect()]
    same(spark, docs, 4)
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def test_large_group_of_near_copies(spark):
    rng = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(150):
        copy = list(base)
        for _ in range(rng.randrange(6)):
            copy[rng.randrange(120)] = f"x{rng.randrange(9999)}"
        rows.append((i, " ".join(copy)))
    same(spark, rows, 4)


def test_repeated_ids_keep_every_link(spark):
    """Rows of one doc_id with different texts are each linked by their own text."""
    rng = random.Random(8)
    a, b, c = (" ".join(f"{x}{rng.randrange(900)}" for _ in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, c), (5, c + " more"), (5, ""), (6, ""), (6, c), (None, a), (None, "")]
    same(spark, rows, 5)
    got = {r["component_id"] for r in minhash.near_duplicates(frame(spark, rows), 5).collect() if r["doc_id"] in (1, 2, 3)}
    assert got == {1}


def test_groups_split(spark, monkeypatch):
    """Stars, members and shingles beyond their bounds are dealt into several tasks and blocks."""
    monkeypatch.setattr(minhash, "GROUP", 7)
    monkeypatch.setattr(minhash, "GROUP_SHINGLES", 900)
    monkeypatch.setattr(minhash, "STAR", 3)
    same(spark, planted(4, 30), 4)
    test_large_group_of_near_copies(spark)


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(0, 60)] + [(1000, k) for k in range(1001, 1100)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(70)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_spans(rows):
    first = {}
    for i, t in rows:
        b, d = (t or "").encode(), -(1 << 63) if i is None else i
        for s in range(len(b) - 49):
            k = b[s : s + 50]
            first[k] = min(first.get(k, d), d)
    out = []
    for i, t in rows:
        b, d = (t or "").encode(), -(1 << 63) if i is None else i
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < d:
                gone[s : s + 50] = b"\1" * 50
        left = bytes(x for x, g in zip(b, gone) if not g)
        out.append((str(i), len(b), len(b) - len(left), sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(left).hexdigest()))
    return sorted(out)


def repetitive(seed, alphabet, n=60):
    rng = random.Random(seed)
    pieces = ["".join(rng.choice(alphabet) for _ in range(rng.choice([20, 49, 50, 51, 80, 200]))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(pieces)[rng.randrange(5) :] for _ in range(rng.randrange(8)))) for i in range(n)]
    rng.shuffle(rows)
    return rows


def test_repeated_spans(spark, sf_dir):
    cases = [repetitive(1, "ab"), repetitive(2, "abcdefghij é"), odd_rows() + [(5, "repeated id " * 9), (6, "repeated id " * 9)], [(r["doc_id"], r["text"]) for r in run_index.documents(spark, sf_dir).collect()]]
    for rows in cases:
        for hot in (run_index.HOT, 1):
            got = sorted((str(r["doc_id"]), *tuple(r)[1:]) for r in run_index.removal_digest(frame(spark, rows), hot).collect())
            assert got == brute_spans(rows)
    assert run_index.removal_digest(frame(spark, [])).count() == 0


def test_null_id_among_other_batches(spark):
    """The null id and ids far apart share a batch; their matches lie in another partition."""
    rng = random.Random(3)
    passages = ["".join(rng.choice("abcdefghij ") for _ in range(200)) for _ in range(6)]
    rows = [(None, passages[0] + "x" + passages[1]), (300, passages[2]), (-(1 << 62), passages[5]), ((1 << 63) - 1, passages[4])]
    rows += [(2, passages[2] + "y" + passages[0]), (400, passages[2] + passages[4]), (5, passages[1]), (-7, passages[5])]
    docs = frame(spark, rows)
    assert docs.rdd.getNumPartitions() == 4  # of two rows each
    got = sorted((str(r["doc_id"]), *tuple(r)[1:]) for r in run_index.removal_digest(docs).collect())
    assert got == brute_spans(rows)


def test_without_repeats(spark):
    rows = repetitive(2, "abcdefghij é")
    docs = frame(spark, rows)
    out = run_index.without_repeats(docs)
    assert out.columns == docs.columns
    digest = {r["doc_id"]: r for r in run_index.removal_digest(docs).collect()}
    for r in out.collect():
        assert len(r["text"].encode()) <= digest[r["doc_id"]]["n_bytes"] - digest[r["doc_id"]]["n_removed"]
        if not digest[r["doc_id"]]["n_removed"]:
            assert r["text"] == dict(rows)[r["doc_id"]]


def test_index_runs():
    import numpy as np

    rng = random.Random(9)
    line = "".join(rng.choice("abcdef ") for _ in range(300)).encode()
    phrases = [b"x" * 60, b"y" + b"x" * 59, b"abc" * 30, bytes(range(256)), bytes(70), b"\0" + bytes(60)]
    phrases += [line[a : a + 50 + rng.randrange(60)] for a in (rng.randrange(180) for _ in range(80))]
    docs = np.array([rng.randrange(-40, 40) for _ in phrases])
    first = defaultdict(lambda: 99)
    for p, d in zip(phrases, docs.tolist()):
        for s in range(len(p) - 49):
            first[p[s : s + 50]] = min(first[p[s : s + 50]], d)
    want = [first[p[s : s + 50]] for p in phrases for s in range(len(p) - 49)]

    def index():
        return run_index.RunLengthIndex(phrases, docs)

    built = index()
    assert built.earliest().tolist() == want
    assert built.of_phrase.tolist() == [k for k, p in enumerate(phrases) for s in range(len(p) - 49)]
    assert len(built.first) == len(built.heads) == len(built.to) == len(built.samples) < built.n_rows / 3  # runs, not rows
    for broken in ("samples", "lead", "to"):  # the answers come from the runs
        other = index()
        setattr(other, broken, np.zeros_like(getattr(other, broken)))
        try:
            assert other.earliest().tolist() != want
        except ValueError:
            pass
    other = index()
    other.heads = np.full_like(other.heads, 1)
    with pytest.raises(ValueError):
        other.earliest()


def test_index_joins_wide_ranks():
    """Ranks beyond 21 bits are joined in two sorts."""
    import numpy as np

    r = np.random.default_rng(1)
    a, b, c = (r.integers(0, 1 << 23, 3000).astype(np.uint32) // (1 << 21) for _ in range(3))
    a[0] = 1 << 22
    got = run_index.RunLengthIndex._joined(a, b, c)
    assert np.argsort(got, kind="stable").tolist() == np.lexsort((c, b, a)).tolist()


def test_one_common_string_in_very_many_texts(spark):
    """Texts around one common string shorter than WIDTH: its key is hot by phrases, whatever the number of batches."""
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    common = "the one and only stem ...."[:24]
    around = lambda: "".join(rng.choices(letters, k=25))
    rows = [(k, around() + common + around()) for k in range(30_000)]
    rows += [(40_000, "xx" + rows[17][1]), (40_001, rows[17][1][3:70])]
    asked = run_index.send_keys(frame(spark, rows), 4)
    weights = [w for r in asked.where("doc_part is null").collect() for w in run_index.unpack(r["blob"])[4].tolist()]
    assert max(weights) > run_index.HOT  # one batch alone holds that many
    sent = run_index.keys_by_document(run_index.answer_keys(asked, 4))
    phrases = run_index.send_phrases(run_index.packed_rows(frame(spark, rows)).join(sent, "doc_id"), 4)
    per_key = {}
    for r in phrases.where("doc_part is null").collect():
        for own in run_index.unpack(r["blob"])[0].tolist():
            per_key[own] = per_key.get(own, 0) + 1
    assert max(per_key.values()) <= run_index.HOT
    got = {r["doc_id"]: r["n_removed"] for r in run_index.removal_digest(frame(spark, rows)).where("n_removed > 0").collect()}
    assert got == {40_000: 74, 40_001: 67}


def test_phrases_sent_in_pieces(spark, monkeypatch):
    rows = repetitive(3, "ab")
    want = brute_spans(rows)
    monkeypatch.setattr(run_index, "FLUSH", 5)
    got = sorted((str(r["doc_id"]), *tuple(r)[1:]) for r in run_index.removal_digest(frame(spark, rows), 1).collect())
    assert got == sorted(want)
