import hashlib
import json
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from watchloom.llm import packing, sharding


def brute(rows, limit):
    """Splits a bucket on its next bit while it is too large and holds two hashes."""
    hashed = [(k, int(hashlib.md5(("\\N" if k is None else str(k)).encode()).hexdigest()[:15], 16), len((t or "").encode())) for k, t in rows]
    out = []

    def split(part, depth):
        if sum(x[2] for x in part) > limit and len({x[1] for x in part}) > 1:
            bit = 59 - depth
            split([x for x in part if not x[1] >> bit & 1], depth + 1)
            split([x for x in part if x[1] >> bit & 1], depth + 1)
        else:
            out.extend((k, f"{h:060b}"[:depth], sum(x[2] for x in part)) for k, h, _ in part)

    split(hashed, 0)
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [20_000, 3_000, 10])
def test_shards_equal_brute_force(docs, limit):
    got = sorted(((r.doc_id, r["shard"], r.shard_bytes) for r in sharding.shard(docs, limit=limit).collect()), key=repr)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], limit)


def test_shard_odd_rows(odd_docs, no_docs, spark, tmp_path):
    rows = sharding.shard(odd_docs, limit=100).collect()
    assert len(rows) == 10
    assert all(r.fits == (r.shard_bytes <= 100) for r in rows)
    assert len({r["shard"] for r in rows if r.doc_id == 3}) == 1
    assert sharding.shard(no_docs).count() == 0
    clash = odd_docs.withColumn("shard", sharding.F.lit("mine"))
    sharding.write_shards(clash, str(tmp_path / "out"), limit=1000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(repr, back.drop("shard_").select(*clash.columns).collect())) == sorted(map(repr, clash.collect()))
    assert {f"b{r['shard']}" for r in sharding.shard(odd_docs, limit=1000).collect()} == {r.shard_ for r in back.collect()}


def test_deep_split_below_the_cells(spark):
    rows = spark.createDataFrame([(i, "x" * 10) for i in range(3000)], "doc_id bigint, text string")
    hashed = rows.select(sharding.key_hash(rows.doc_id).alias("__h"), sharding.F.lit(10).cast("bigint").alias("__bytes"))
    got = {(r.depth, r.bucket): r.bytes for r in sharding.directory(hashed, 30, slack_bits=-4).collect()}
    assert sum(got.values()) == 30_000 and all(b <= 30 for b in got.values())


def test_cells_over_the_limit_are_split_by_whole_hashes(spark, monkeypatch):
    """Few bits for cells, and a key that a third of the rows share."""
    rows = spark.createDataFrame([(i if i % 3 else 0, "x" * (i % 50)) for i in range(900)], "doc_id bigint, text string")
    plain = sharding.entries
    monkeypatch.setattr(sharding, "entries", lambda slim, limit: plain(slim, limit, -3))
    got = sorted(((r.doc_id, r["shard"], r.shard_bytes) for r in sharding.shard(rows, limit=100).collect()), key=repr)
    assert got == brute([(r.doc_id, r.text) for r in rows.collect()], 100)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def made_encoder(path):
    return packing.encoder(path, packing.ranks_of(path))


def test_encoder_equals_the_library(tokenizer, docs):
    encode = made_encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert encode.any is not None
    texts = [r.text for r in docs.collect()] + ["", " ", "  a  b", "a\n\n b\t", "it's <|endoftext|> 12", "　x   y", "é日本\U0001f600 '''ll"]
    for t in texts:
        assert encode(t) == np.asarray(tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
    other = made_encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert other("Some Text") == np.asarray(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode("Some Text", add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_ranks_are_refused_unless_they_tell_the_merges(tmp_path):
    """abc is listed as a + bc, but its ranks give ab + c; then options that change merging."""

    def made(merges, **options):
        chars = sorted(packing._byte_chars())
        vocab = {c: k for k, c in enumerate([*chars, *("".join(m) for m in merges)])}
        model = {"type": "BPE", "vocab": vocab, "merges": merges, "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False} | options
        path = tmp_path / f"{len(list(tmp_path.iterdir()))}.json"
        pre = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        path.write_text(json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": pre, "post_processor": None, "decoder": None, "model": model}))
        return str(path)

    good = made([["a", "b"], ["ab", "c"], ["b", "c"]])
    assert packing.ranks_of(good) is not None
    bad = made([["a", "b"], ["b", "c"], ["a", "bc"]])
    assert packing.ranks_of(bad) is None
    assert packing.ranks_of(made([["a", "b"]], dropout=0.5)) is None and packing.ranks_of(made([["a", "b"]], ignore_merges=True)) is None
    for path in (good, bad):
        library = Tokenizer.from_file(path)
        for text in ("abc", "aabcbc", "bcabc ab"):
            assert made_encoder(path)(text) == np.asarray(library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_pieces_round_trip(tokenizer, docs):
    parts = defaultdict(list)
    rows = packing.pack(docs, with_ids=True).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.offset == 0 for r in rows)
    for r in rows:
        assert r.length <= 2048 and r.length & (r.length - 1) == 0 and 1 << r.bucket == r.length
        assert zlib.crc32(np.asarray(r.ids, dtype="<u4").tobytes()) == r.ids_crc32
        parts[r.doc_id].append(r)
    for d in docs.collect():
        own = sorted(parts[d.doc_id], key=lambda r: r.start)
        ids = [x for r in own for x in r.ids]
        assert ids == [*tokenizer.encode(d.text, add_special_tokens=False).ids, 1]
        assert own[0].start == 0 and all(a.start + a.length == b.start for a, b in zip(own, own[1:])) and own[0].doc_tokens == len(ids)


def test_pack_odd_rows(odd_docs, no_docs):
    rows = packing.pack(odd_docs).collect()
    assert [(r.length, r.doc_tokens) for r in rows if r.doc_id == 2] == [(1, 1)]
    assert sum(r.length for r in rows if r.doc_id == 3) == 2 * next(r.doc_tokens for r in rows if r.doc_id == 3)
    assert packing.pack(no_docs).count() == 0
    with pytest.raises(ValueError):
        packing.pack(odd_docs, longest=3)
