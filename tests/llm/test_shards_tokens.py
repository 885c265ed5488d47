"""Sharding, token ORC and merge replay against brute force and the tokenizer libraries."""

import base64
import hashlib
import struct
import zlib

import public_tokenizers as P
import pytest

from hydrostrata.llm import merge_replay, sharding, token_orc

from .helpers import frame, odd_rows


def test_bytes_law(spark, sf_dir):
    docs = sharding.documents(spark, sf_dir)
    rows = sharding.shard_by_bytes(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(rows) == len(texts)
    load, slots = [0] * 16, [[] for _ in range(16)]
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    assert max(load) - min(load) <= 0.02 * sum(load) / 16


def test_odd_and_empty_shards(spark):
    rows = sharding.shard_by_bytes(frame(spark, odd_rows())).collect()
    assert len(rows) == len(odd_rows())
    assert [r["size"] for r in rows if r["doc_id"] == 1] == [1] and [r["text_crc32"] for r in rows if r["doc_id"] == 1] == [0]
    assert len({(r["shard"], r["slot"]) for r in rows}) == len(rows)
    assert sharding.shard_by_bytes(frame(spark, [])).count() == 0


def test_slot_map_versions(spark, tmp_path):
    m = sharding.SlotMap(64, 4)
    before = m.shards
    assert m.rebalance({s: (s % 7 + 1) * 10 for s in range(64)}) >= 0
    balanced = m.shards
    m.grow()
    assert m.version == 2 and all(a == b or b == 4 for a, b in zip(balanced, m.shards)) and m.shards.count(4) >= 10
    m.write(spark, f"file://{tmp_path}/map")
    back = sharding.SlotMap.read(spark, f"file://{tmp_path}/map")
    assert back.versions == m.versions and back.versions[0] == before


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def test_token_orc(spark, sf_dir, library, tmp_path):
    shared = [(7, "first text of three"), (7, "x <|endoftext|> y"), (7, "third"), (None, "null id")]
    for docs in (token_orc.documents(spark, sf_dir), frame(spark, odd_rows() + shared)):
        out = token_orc.scratch(spark, "t")
        token_orc.write_token_orc(docs, out, P.path("byte_bpe_50k.json"))
        got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_orc.token_digest(token_orc.read_token_orc(spark, out)).collect())
        want = []
        for r in docs.collect():
            ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [0]
            want.append((r["doc_id"] is not None, r["doc_id"] or 0, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        assert sorted(g[:2] + g[3:] for g in got) == sorted(want)
        in_files = sorted(token_orc.read_token_orc(spark, out).collect(), key=lambda r: (r["file_no"], r["row_no"]))
        at, starts = 0, {}
        for r in in_files:  # start follows the rows of the files, also where a doc_id repeats
            starts.setdefault((r["doc_id"], zlib.crc32(struct.pack(f"<{len(r['ids'])}I", *r["ids"]))), []).append(at)
            at += len(r["ids"])
        assert all(g[2] in starts[g[1] if g[0] else None, g[4]] for g in got)
        at = 0
        for g in sorted(got, key=lambda g: (g[0], g[1], g[2])):
            assert g[2] == at
            at += g[3]
        one = token_orc.read_token_orc(spark, out, [5]).collect()
        assert [r["doc_id"] for r in one] == [5]
    empty = token_orc.scratch(spark, "t")
    token_orc.write_token_orc(frame(spark, []), empty, P.path("byte_bpe_50k.json"))
    assert token_orc.token_digest(spark.read.schema("doc_id long, ids array<int>, file_no int, row_no long").orc(empty)).count() == 0


def test_token_orc_added_token(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["plain text", "a <|endoftext|> b", "", "<|endoftext|>", "x<|endoftext|><|endoftext|>y  z", "<|endoftext|", "last one"]
    out = token_orc.scratch(spark, "t")
    token_orc.write_token_orc(frame(spark, list(enumerate(texts))), out, P.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r["ids"] for r in token_orc.read_token_orc(spark, out).collect()}
    assert got == {k: own.encode(x, add_special_tokens=False).ids + [0] for k, x in enumerate(texts)}
    assert 50256 in got[1]


def test_merge_replay(spark, sf_dir):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for docs in (merge_replay.documents(spark, sf_dir), frame(spark, odd_rows())):
        got = sorted(map(str, (tuple(r) for r in merge_replay.round_trip(docs, path).collect())))
        want = []
        for r in docs.collect():
            ids = own.encode_ordinary(r["text"] or "")
            want.append(str((r["doc_id"], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())))
        assert got == sorted(want)
    docs = frame(spark, odd_rows())
    back = merge_replay.decode(merge_replay.encode(docs, path), path).collect()
    assert sorted((str(r["doc_id"]), bytes(r["data"])) for r in back) == sorted((str(i), (t or "").encode()) for i, t in odd_rows())
    assert merge_replay.round_trip(frame(spark, []), path).count() == 0


def test_merge_replay_many_blocks(spark, sf_dir):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    docs = merge_replay.documents(spark, sf_dir)
    whole, cut = (sorted(map(str, merge_replay.round_trip(docs, path, *sizes).collect())) for sizes in ((8 << 20, 32 << 20), (20_000, 50_000)))
    assert whole == cut
    rows = merge_replay.word_blocks(docs, 7, 20_000).select("asked").collect()
    asked = [(a["part"], w) for r in rows for a in r["asked"] for w in merge_replay.unpacked_words(a["words"])]
    assert len(rows) > 3 and {p for p, _ in asked} == set(range(7))
    assert len(set(asked)) == len({w for _, w in asked}) < len(asked)  # equal words of all blocks meet in one part
    blank = frame(spark, [(1, None), (2, ""), (None, "")])
    assert {tuple(r)[1:] for r in merge_replay.round_trip(blank, path).collect()} == {(0, hashlib.sha256().hexdigest(), hashlib.sha256().hexdigest())}
    assert [r["ids"] for r in merge_replay.encode(blank, path).collect()] == [[], [], []]
