import hashlib
import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from watchloom.llm import exact_dedup, golay, near_dedup, substring_dedup
from watchloom.llm.components import components

# exact -----------------------------------------------------------------------------------------


def exact_brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    out = []
    for r in rows:
        ids = groups[r.text or ""]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((r.doc_id, keep, len(ids), r.doc_id == keep, hashlib.sha256((r.text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("historical", [None, True, False])
def test_exact_equals_brute_force(docs, odd_docs, historical):
    historical = None if historical is None else F.lit(historical)
    for rows in (docs, odd_docs):
        got = sorted((tuple(r) for r in exact_dedup.exact_dedup(rows, historical).collect()), key=repr)
        assert got == exact_brute(rows.collect())


@pytest.mark.parametrize("historical", [True, False, None])
def test_exact_winners_over_many_shards(docs, historical):
    past = F.col("doc_id") % 3 == 0 if historical is None else F.lit(historical)
    got = {r.keep_id: r.group_size for r in exact_dedup.winners(docs, past, shard_rows=9).collect()}
    assert got == {x[1]: x[2] for x in exact_brute(docs.collect())}


def test_probe_tells_members_from_others(docs):
    history = exact_dedup.groups_of(docs.filter("doc_id % 2 = 0"))
    new = exact_dedup.groups_of(docs.filter("doc_id % 2 = 1"))
    old = {bytes(r.digest) for r in history.collect()}
    out = exact_dedup.probe(exact_dedup.build_index(history, 5), new, 5).collect()
    assert len(out) == len(old) + new.count() and all(r.member == (bytes(r.digest) in old) for r in out)


def test_minimal_perfect_hash():
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    bits = exact_dedup.build_hash(b"".join(digests))
    slots = exact_dedup.slots(bits, b"".join(digests))
    assert sorted(slots) == list(range(5000))
    held = b"".join(digests[i] for i in np.argsort(slots))
    others = [hashlib.sha256(str(i).encode()).digest() for i in range(5000, 9000)]
    assert (exact_dedup.lookup(bits, held, b"".join(others)) == -1).all()
    assert (exact_dedup.lookup(bits, held, b"".join(digests)) == slots).all()


def test_keep_exact(docs, odd_docs, no_docs):
    kept = exact_dedup.keep_exact(docs).collect()
    assert {r.doc_id for r in kept} == {x[0] for x in exact_brute(docs.collect()) if x[3]} and len(kept) == len({r.text for r in docs.collect()})
    assert exact_dedup.keep_exact(odd_docs).columns == odd_docs.columns
    assert exact_dedup.exact_dedup(no_docs).count() == 0 and exact_dedup.keep_exact(no_docs).count() == 0


# near ------------------------------------------------------------------------------------------


def test_golay_keys_meet_within_two_errors():
    parity, errors = golay.tables()
    assert {int((row >= 0).sum()) for row in errors} == {1, 6}
    sets = [set(row[row >= 0].tolist()) for row in errors]
    for n in (1, 2):
        for bits in itertools.combinations(range(23), n):
            e = sum(1 << b for b in bits)
            s = (e & 2047) ^ int(parity[e >> 11])
            # by linearity it is enough to look at syndromes: x has errors a, x ^ e has errors b, the codeword is common if a = b ^ e
            assert all(any((b ^ e) in sets[k] for b in sets[k ^ s]) for k in range(2048))


def test_keys_miss_no_pair():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    for n in range(5):
        flips = np.array([sum(1 << b for b in rng.choice(64, n, replace=False).tolist()) for _ in a], dtype=np.uint64)
        (ra, ka), (rb, kb) = near_dedup.keys(a), near_dedup.keys(a ^ flips)
        assert {r for r, _ in set(zip(ra.tolist(), ka.tolist())) & set(zip(rb.tolist(), kb.tolist()))} == set(range(len(a)))


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_brute(rows):
    fps = np.array([plain_fingerprint(r.text) for r in rows], dtype=np.uint64)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in np.nonzero(np.bitwise_count(fps[i:] ^ fps[i]) <= 4)[0]:
            parent[find(i)] = find(i + int(j))
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(r.doc_id)
    return sorted(((r.doc_id, f"{int(fps[i]):016x}", min((x for x in least[find(i)] if x is not None), default=None)) for i, r in enumerate(rows)), key=repr)


@pytest.mark.parametrize("split", [4096, 12])
def test_near_equals_brute_force(docs, split):
    got = sorted((tuple(r) for r in near_dedup.near_dedup(docs, split=split).collect()), key=repr)
    assert got == near_brute(docs.collect())


def test_near_dense_cluster(spark):
    """Many distinct fingerprints about one centre, in buckets that are split."""
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 1 << 63))
    values = {centre ^ sum(1 << b for b in rng.choice(63, int(rng.integers(0, 6)), replace=False).tolist()) for _ in range(700)} | {int(x) for x in rng.integers(0, 1 << 63, 300)}
    fps = sorted(values)
    rows = spark.createDataFrame([(v,) for v in fps], "fp bigint")
    for split in (4096, 150):
        edges = near_dedup.links(rows, split)
        roots = {r.node: r.root for r in components(edges).collect()}
        arr = np.array(fps, dtype=np.uint64)
        seen, comp = set(), {}
        for i in range(len(fps)):
            if i in seen:
                continue
            todo, own = [i], []
            seen.add(i)
            while todo:
                x = todo.pop()
                own.append(x)
                for j in np.nonzero(np.bitwise_count(arr ^ arr[x]) <= 4)[0].tolist():
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            for x in own:
                comp[fps[x]] = min(fps[y] for y in own)
        assert all(roots.get(f, f) == comp[f] for f in fps)
        assert edges.count() < (60 if split == 4096 else 600) * len(fps)


def test_cuts_lose_no_pair():
    """Any two fingerprints within four bits that share a bucket share one below it, at every level."""
    rng = np.random.default_rng(8)
    import pandas as pd

    for level in range(4):
        paths = near_dedup._paths(level)
        for _ in range(40):
            p = int(rng.integers(len(paths)))
            free = near_dedup.free_bits(paths[p])
            a = int(rng.integers(0, 1 << 63))
            b = a ^ sum(1 << x for x in rng.choice(free, min(4, len(free)), replace=False).tolist())
            key = p << 27 if level == 0 else p << near_dedup.HASH_BITS | 12345
            rows = pd.DataFrame({"key": [key, key], "fp": np.array([a, b], dtype=np.uint64).view(np.int64)})
            out = pd.concat(near_dedup._cutter(level)(iter([rows])))
            keys = [set(out["key"][out["fp"].to_numpy().view(np.uint64) == np.uint64(x)]) for x in (a, b)]
            assert keys[0] & keys[1] and all(k >> near_dedup.HASH_BITS in range(5 * p, 5 * p + 5) for k in keys[0])


def test_near_odd_rows(odd_docs, no_docs):
    rows = {r.doc_id: r for r in near_dedup.near_dedup(odd_docs).collect()}
    assert rows[1].fingerprint == "0" * 16 and rows[1].component_id == rows[2].component_id == rows[6].component_id == 1
    assert rows[5].component_id == 4 and rows[None].component_id == 3
    assert near_dedup.near_dedup(no_docs).count() == 0 and near_dedup.keep_near(no_docs).count() == 0
    assert near_dedup.keep_near(odd_docs).columns == odd_docs.columns


def test_components_of_a_path(spark):
    n = 60
    order = random.Random(1).sample(range(n), n)
    edges = spark.createDataFrame([*zip(order, order[1:]), (5, 5), (100, 101)], "a bigint, b bigint")
    roots = {r.node: r.root for r in components(edges).collect()}
    assert roots == {**{i: 0 for i in range(n)}, 100: 100, 101: 100}
    assert components(edges.limit(0)).count() == 0


# substrings ------------------------------------------------------------------------------------


def substring_brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(hashlib.md5(d[p : p + length]).digest() for _, d in texts for p in range(len(d) - length + 1))
    out = []
    for i, d in texts:
        gone = np.zeros(len(d), dtype=bool)
        for p in range(len(d) - length + 1):
            if seen[hashlib.md5(d[p : p + length]).digest()] > 1:
                gone[p : p + length] = True
        rest = bytes(b for b, g in zip(d, gone) if not g)
        runs = int(((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(d) else 0)
        out.append((i, len(d), int(gone.sum()), runs, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=repr)


def test_substrings_equal_brute_force_on_documents(docs):
    got = sorted((tuple(r) for r in substring_dedup.substring_dedup(docs).collect()), key=repr)
    assert got == substring_brute([(r.doc_id, r.text) for r in docs.collect()], 200)


@pytest.mark.parametrize(("length", "gram", "crowd"), [(200, 64, 1024), (40, 8, 1024), (40, 8, 3), (200, 64, 2), (40, 8, 1)])
def test_substrings_with_null_and_repeated_ids(spark, length, gram, crowd):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcé\n") for _ in range(rng.randint(0, 400))) for _ in range(12)]
    rows = [(rng.choice([i, i, None, 7]), "".join(rng.choice(base)[rng.randint(0, 60) :][: rng.randint(0, 300)] for _ in range(rng.randint(0, 4)))) for i in range(120)]
    rows += [(1000, "a" * 700), (1001, "ab" * 300), (1002, None), (1003, "")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((tuple(r) for r in substring_dedup.substring_dedup(frame, length, gram, crowd=crowd).collect()), key=repr)
    assert got == substring_brute(rows, length)


def test_substrings_survive_forged_context_collisions(spark):
    """Contexts get a hash of three bits, so nearly all of an anchor's look like copies: the proofs fail and a second try decides."""
    rng = random.Random(9)
    line = "".join(rng.choice("abcdefgh") for _ in range(90))
    tails = ["".join(rng.choice("abcdefgh") for _ in range(300)) for _ in range(20)]
    rows = [(i, rng.choice(tails) + line + rng.choice(tails)) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((tuple(r) for r in substring_dedup.substring_dedup(frame, 120, 32, crowd=8, hash_bits=(3, 64)).collect()), key=repr)
    assert got == substring_brute(rows, 120)
    # tries go on until the copies are proved
    got = sorted((tuple(r) for r in substring_dedup.substring_dedup(frame, 120, 32, hash_bits=(1, 1)).collect()), key=repr)
    assert got == substring_brute(rows, 120)


@pytest.mark.parametrize(("length", "gram"), [(5000, 64), (1200, 64), (20, 30), (20, 0)])
def test_substring_lengths_out_of_range(docs, length, gram):
    with pytest.raises(ValueError):
        substring_dedup.substring_dedup(docs, length, gram)


def test_a_line_that_most_documents_share(spark):
    """Its anchors have hundreds of contexts, which are dealt anew until a few are left."""
    rng = random.Random(6)
    line = "".join(rng.choice("abcdefghijkl ") for _ in range(260))
    own = lambda n: "".join(rng.choice("abcdefghijkl ") for _ in range(n))
    rows = [(i, own(150) + line + own(150 if i % 3 else 0)) for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((tuple(r) for r in substring_dedup.substring_dedup(frame, crowd=20).collect()), key=repr)
    assert got == substring_brute(rows, 200)


def test_extension_survives_collisions():
    a, b = b"abcdefgh", b"abcxefgh"
    same = [0] * 9
    assert substring_dedup.extension(a, b, same, same) == 3
    assert substring_dedup.extension(a, a + b"i", list(range(9)), list(range(10))) == 8


def test_suffix_order():
    rng = random.Random(2)
    parts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30))) for _ in range(80)]
    order, lcp = substring_dedup.suffix_order(parts)
    assert [parts[i] for i in order] == sorted(parts)
    for k in range(1, len(order)):
        x, y = parts[order[k - 1]], parts[order[k]]
        n = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        assert lcp[k] == n


def test_chunks_of_a_long_text(monkeypatch):
    rng = random.Random(4)
    data = bytes(rng.choice(b"abcd ") for _ in range(20_000))
    monkeypatch.setattr(substring_dedup, "CHUNK", 1000)
    _, at, first, last = substring_dedup.anchors(data)
    covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last)])
    assert (covered == np.arange(len(data) - 199)).all()
    assert ((at >= first - 0) | (at >= first)).all() and ((at + 64) <= last + 200).all()


def test_substring_odd_rows(odd_docs, no_docs):
    rows = {r.doc_id: r for r in substring_dedup.substring_dedup(odd_docs).collect()}
    assert rows[4].n_removed == rows[4].n_bytes and rows[4].n_spans == 1 and rows[2].n_bytes == 0
    assert substring_dedup.substring_dedup(no_docs).count() == 0


def test_arrivals_without_history_are_sharded(spark, monkeypatch):
    shards, probe = [], exact_dedup.probe
    monkeypatch.setattr(exact_dedup, "probe", lambda index, new, n: shards.append(n) or probe(index, new, n))
    docs = spark.createDataFrame([(i, f"text {i % 40}") for i in range(60)], "doc_id long, text string")
    got = {r["keep_id"]: r["group_size"] for r in exact_dedup.winners(docs, F.lit(False), shard_rows=10).collect()}
    assert shards == [6]  # 60 arrivals at most; two copies are combined only if their ids share one of 64 parts
    assert got == {i: 2 if i >= 40 else 1 for i in range(20, 60)}
