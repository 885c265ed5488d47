"""Decontamination and the pipeline."""

import random
import re
import time

import numpy as np

import corpus_pipeline
from hydrostrata.llm import decontaminate, merge_replay, minhash, run_index, toxicity

from .helpers import frame, odd_rows
from .test_duplicates import brute_components, brute_spans

SCHEMA = "item_id long, text string"


def plain(text):
    return re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", " ", (text or "").lower()).strip().encode()


def edits(item, text):
    """Least edits of the item against any part of the text."""
    row = np.zeros(len(text) + 1, int)
    t = np.frombuffer(text, np.uint8)
    for c in item:
        new = np.empty_like(row)
        new[0] = row[0] + 1
        new[1:] = np.minimum(row[:-1] + (t != c), row[1:] + 1)
        new = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
        row = new
    return int(row.min())


def test_matches(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeéo") for _ in range(rng.randrange(2, 8)))
    items = [(k, " ".join(word() for _ in range(rng.choice([2, 3, 5, 8, 20, 40])))) for k in range(12)] + [(90, "tiny"), (91, None), (92, " "), (93, "  ")]
    items.append((94, items[0][1]))
    docs = list(odd_rows())
    for k in range(60):
        item = list(rng.choice(items[:12])[1])
        for _ in range(int(len(item) * rng.choice([0, 0.03, 0.08, 0.15, 0.3]))):
            p, kind = rng.randrange(len(item)), rng.random()
            if kind < 0.4:
                item[p] = rng.choice("xyz")
            elif kind < 0.7:
                item.insert(p, "q")
            elif len(item) > 1:
                item.pop(p)
        around = [" ".join(word() for _ in range(rng.randrange(30))) for _ in range(2)]
        docs.append((1000 + k, f"{around[0]} {''.join(item).upper() if k % 3 == 0 else ''.join(item)}!! {around[1]}"))
    docs.append((2000, "a tiny one"))
    docs.append((2001, "atiny one"))
    table = spark.createDataFrame(items, SCHEMA)
    block = decontaminate.Items([i for i, t in items[:12]], [t for _, t in items[:12]])
    want = set()
    assert min(map(len, block.items)) < 40 < max(map(len, block.items))
    for i, t in docs:
        for k, item in enumerate(block.items):
            e = len(item) // 10  # the stated budget, whatever the length
            if len(plain(t)) and edits(item, plain(t)) <= e:
                want.add((i, k))
    want |= {(i, 94) for i, k in want if k == 0} | {(2000, 90)}
    for size in (decontaminate.BLOCK_BYTES, 300):
        got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(frame(spark, docs), table, block_bytes=size).collect()}
        assert got == want
    clean = decontaminate.clean_documents(frame(spark, docs), table)
    assert clean.columns == frame(spark, []).columns
    leaked = {i for i, _ in want}
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(i) for i, _ in docs if i not in leaked)
    assert decontaminate.matches(frame(spark, []), table).count() == 0
    assert decontaminate.matches(frame(spark, docs), table.limit(0)).count() == 0
    assert decontaminate.clean_documents(frame(spark, docs), table.limit(0)).count() == len(docs)


def test_common_beginnings(monkeypatch):
    """Very many items with one beginning: quick, and with every match that plain alignment finds."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 9)))
    words = lambda n: " ".join(word() for _ in range(n))
    stem = words(14)
    items = [f"{stem} {words(4)}" for _ in range(20_000)]
    picked = [rng.randrange(len(items)) for _ in range(20)]
    texts = [f"{words(40)} {items[k][:60]}z{items[k][61:]} {words(40)}" for k in picked]
    began = time.time()
    found = {(t, k): e for t, k, e, _ in decontaminate.Items(list(range(len(items))), items).search(texts)}
    assert time.time() - began < 40  # about 5 s; one band at a time took minutes
    assert all(found[t, k] <= 1 for t, k in enumerate(picked))
    few = sorted({*picked, *range(0, 20_000, 1000)})
    want = {(t, k): e for t, x in enumerate(texts) for k in few if (e := edits(items[k].encode(), x.encode())) <= len(items[k]) // 10}
    assert {x: e for x, e in found.items() if x[1] in few} == want
    block = decontaminate.Items(few, [items[k] for k in few])
    whole = block.search(texts)
    monkeypatch.setattr(decontaminate, "PAIRS", 500)  # texts in groups, and items in groups of a text
    monkeypatch.setattr(decontaminate, "CELLS", 3000)
    assert block.search(texts) == whole and {(t, few[k]): e for t, k, e, _ in whole} == want


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    pair = lambda d: [(r["doc_id"], r["text"]) for r in d.collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = pair(docs)
        out = minhash.stored(stage(spark, docs, sf_dir), f"stage{k}")
        if k == 0:
            labels = toxicity.clean_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic").where(toxicity.crc_mod("doc_id", 5) != 0)
            scores = {r["doc_id"]: r["score"] for r in toxicity.with_toxicity(docs, toxicity.fit(docs, labels)).collect()}
            assert sorted(i for i, _ in pair(out)) == sorted(i for i, s in scores.items() if s < 0.5)
        elif k == 1:
            keep = sorted(int(i) for i, _, c in brute_components(before, 5) if i == c)
            assert sorted(i for i, _ in pair(out)) == keep and len(keep) < len(before)
        elif k == 2:
            removed = {int(i): n for i, _, n, _, _ in brute_spans(before)}
            after = dict(pair(out))
            assert sum(removed.values()) > 0
            for i, t in before:
                assert 0 <= len(t.encode()) - removed[i] - len(after[i].encode()) <= 6 * 50
                assert removed[i] or after[i] == t
            assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
        elif k == 3:
            items = [plain(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            after = dict(pair(out))
            held = {i for i, t in before if any(x in plain(t) for x in items)}
            assert not held & after.keys() and len(after) >= 0.9 * (len(before) - len(held))
        else:
            assert len(before) == out.count() and out.columns[0] == "doc_id"
            import hashlib

            want = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in before}
            assert {r["doc_id"]: r["decoded_sha256"] for r in out.collect()} == want
            break
        assert out.columns == columns
        docs = out
    assert corpus_pipeline.run(spark, sf_dir).count() == len(want)


def test_pipeline_odd(spark, sf_dir):
    """Stages on odd rows and on an empty table keep their columns."""
    for rows in (odd_rows(), []):
        docs = frame(spark, rows)
        columns = docs.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = minhash.stored(stage(spark, docs, sf_dir), f"odd{k}")
            assert k == 4 or docs.columns == columns
        if rows:
            ids = [r["doc_id"] for r in docs.collect()]
            assert {1, 2, 3, 5} <= set(ids) and 6 not in ids and 7 not in ids and 9 not in ids
