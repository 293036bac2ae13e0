"""SimHash groups against fingerprints and links found pair by pair."""

import itertools
import random

import numpy as np
import xxhash

from sheafline.llm import components, queries, simhash


def plain_print(text, k=3):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = lower.encode().split()
    shingles = [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(pairs, nodes):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_any_two_changed_bits_meet_in_a_table():
    for radius in (1, 2, 3):
        masks = simhash.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for bits in itertools.combinations(range(64), radius) if radius < 3 else [random.Random(i).sample(range(64), 3) for i in range(4000)]:
            assert any(not any(m >> b & 1 for b in bits) for m in masks)


def test_fingerprints_match_the_plain_ones():
    rnd = random.Random(1)
    texts = ["", " ", "One", "one TWO", "a b c", "É é É é", "İ ı K", "a\x0bb\x0cc\x1cd e"] + [
        " ".join(rnd.choice(["the", "of", "É", "x1", "Long"]) for _ in range(rnd.randint(1, 80))) for _ in range(100)]
    for t in texts:
        assert simhash.fingerprint_of(t) == plain_print(t), t


def test_links_connect_all_pairs_within_two_bits(spark):
    rnd = random.Random(3)
    values = set()
    for _ in range(12):
        seed = rnd.getrandbits(64)
        for _ in range(25):  # dense clusters, chains and near misses
            x = seed
            for b in rnd.sample(range(64), rnd.randint(0, 5)):
                x ^= 1 << b
            values.add(x)
            if rnd.random() < 0.2:
                seed = x
    values |= {0, 2**64 - 1, 1, 3, 7}
    signed = [simhash._signed(v) for v in values]
    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fingerprint long")).collect()
    mask = 2**64 - 1
    assert all(bin((r["a"] ^ r["b"]) & mask).count("1") <= 2 for r in links)
    near = [(a, b) for a, b in itertools.combinations(signed, 2) if bin((a ^ b) & mask).count("1") <= 2]
    assert groups([(r["a"], r["b"]) for r in links], signed) == groups(near, signed)


def test_components_of_chains_stars_and_rings(spark):
    rnd = random.Random(5)
    links = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(i, 2000 + (i - 1999) % 50) for i in range(2000, 2050)]
    links += [(rnd.randint(3000, 3200), rnd.randint(3000, 3200)) for _ in range(120)] + [(7, 7), (None, 3), (5000, 5000)]
    rnd.shuffle(links)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == groups(real, {x for p in real for x in p})
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_operator_on_nulls_repeats_and_copies(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(300))
    rows = [(9, text), (4, text), (4, text), (None, text), (2, None), (3, ""), (8, " \n"), (None, None), (11, "alone here now")]
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, component_id int").repartition(2)
    got = sorted(((r["doc_id"] or -1, r["component_id"]) for r in simhash.near_duplicates(docs).collect()))
    assert got == [(-1, 2), (-1, 4), (2, 2), (3, 2), (4, 4), (4, 4), (8, 2), (9, 4), (11, 11)]
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    shown = {r["doc_id"]: r["fingerprint"] for r in queries.QUERIES["op6_simhash"](spark, str(tmp_path)).collect()}
    assert shown[3] == "0" * 16 and shown[9] == f"{plain_print(text):016x}"
    only = spark.createDataFrame([(None, "a"), (None, "a")], "doc_id long, text string")
    assert [r["component_id"] for r in simhash.near_duplicates(only).collect()] == [None, None]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_similar_documents_leave_one(spark):
    rnd = random.Random(8)
    body = lambda: [f"w{rnd.randint(0, 3000)}" for _ in range(250)]
    rows, group = [], {}
    for g in range(30):
        words = body()
        for c in range(rnd.choice([1, 2, 4])):
            copy = list(words)
            for _ in range(rnd.randint(0, 3) if c else 0):
                copy[rnd.randrange(250)] = "changed"
            group[len(rows) + 100] = g
            rows.append((len(rows) + 100, " ".join(copy), g))
    rows += [(None, rows[0][1], 0), (5, None, 90), (6, "", 90), (None, None, 90), (7, "only me", 91), (7, "only me", 91)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _hash int").repartition(3)
    out = simhash.keep_one_of_each(docs)
    assert out.columns == docs.columns
    kept = sorted((r["doc_id"], r["_hash"]) for r in out.collect())
    first = {}
    for i, g in group.items():
        first.setdefault(g, i)
    assert kept == sorted([(i, g) for g, i in first.items()] + [(5, 90), (7, 91)])
    assert simhash.keep_one_of_each(docs.limit(0)).count() == 0


def kept_ids(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return sorted(r["doc_id"] for r in simhash.keep_one_of_each(docs).collect())


def test_copies_unlike_the_first_of_their_bucket_leave_one(spark):
    rnd, bag, texts = random.Random(12), [f"f{i}" for i in range(220)], []
    for _ in range(15):  # forms: the same words in another order
        words = rnd.sample(bag, len(bag))
        texts += [" ".join(words), " ".join(words[:70] + ["odd"] + words[71:])]
    assert kept_ids(spark, texts) == list(range(0, 30, 2))


def shingle_set(text):
    words = text.split()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def alike(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b)


def test_blocks_of_new_or_missing_words_are_found(spark):
    rnd, texts = random.Random(21), []
    for i in range(40):
        words = [f"d{i}x{rnd.randrange(10**6)}" for _ in range(200)]
        n = 25 + i % 16
        block, at = [f"n{i}x{k}" for k in range(n)], rnd.choice([0, 100, 200])
        texts += [" ".join(words), " ".join(words[:at] + block + words[at:]) if i % 2 else " ".join(words[n:])]
    pairs = [alike(texts[i], texts[i + 1]) for i in range(0, 80, 2)]
    kept, near = kept_ids(spark, texts), [i + 1 for i in range(0, 80, 2) if pairs[i // 2] >= 0.85]
    assert len(near) > 5 and not set(near) & set(kept)


def test_links_are_exactly_the_pairs_at_the_limit(spark):
    rnd, texts = random.Random(34), []
    for i in range(120):
        words = [f"e{i}x{rnd.randrange(10**6)}" for _ in range(150)]
        n = 28 + i % 25  # similarities about 0.74 to 0.84
        texts += [" ".join(words), " ".join(words + [f"m{i}x{k}" for k in range(n)])]
    far = {i + 1 for i in range(0, 240, 2) if alike(texts[i], texts[i + 1]) < 0.8}
    assert 30 < len(far) < 90
    assert kept_ids(spark, texts) == sorted(set(range(0, 240, 2)) | far)


def test_odd_sketches_never_differ_in_more_bits_than_the_sets_in_shingles():
    rng = np.random.default_rng(5)
    ruled_out = 0
    for n in (1, 2, 4, 5, 9, 30, 100, 700, 5000):
        for share in (0.0, 0.1, 0.2, 0.5):
            both = rng.integers(0, 2**64, n, dtype=np.uint64)
            own = [np.unique(np.concatenate([both, rng.integers(0, 2**64, int(n * share), dtype=np.uint64)])) for _ in range(2)]
            sketches = [np.array(simhash.odd_sketch(h), dtype=np.int64) for h in own]
            bits = sum(int(x).bit_count() for x in (sketches[0] ^ sketches[1]).view(np.uint64))
            apart = len(np.setxor1d(*own))
            assert bits <= apart and bits % 2 == apart % 2
            together = sum(map(len, own))
            if len(np.intersect1d(*own)) / len(np.union1d(*own)) >= 0.8:
                assert bits <= together * simhash.differing(0.8) + 1e-9
            else:
                ruled_out += bits > together * simhash.differing(0.8) + 1e-9
    assert ruled_out >= 9


def test_similar_short_texts_are_always_linked(spark):
    rnd, rows, wanted = random.Random(6), [], set()
    for k in range(300):  # five shingles and four of them: exactly the limit
        words = [f"w{rnd.randint(0, 10**6)}" for _ in range(9)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:-1]))]
        if set(simhash.bands_of(simhash.shingle_hashes(rows[-2][1]))) & set(simhash.bands_of(simhash.shingle_hashes(rows[-1][1]))):
            wanted.add(2 * k + 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = {r["doc_id"] for r in simhash.keep_one_of_each(docs).select("doc_id").collect()}
    assert len(wanted) > 290 and kept == set(range(600)) - wanted


def test_fingerprints_within_two_bits_are_candidates_without_a_common_band(spark):
    rnd, rows, sets = random.Random(4), [], {}
    for k in range(40):  # pairs that differ in up to two bits of 64, and in all bands
        base, shared = rnd.getrandbits(64), [rnd.getrandbits(62) for _ in range(40)]
        for c in range(2):
            node, first = 2 * k + c, base
            for b in rnd.sample(range(64), k % 3) if c else []:
                first ^= 1 << b
            wide = [simhash._signed(first), 0, 0, 0]
            rows.append((node, [rnd.getrandbits(62) for _ in range(simhash.BANDS)], wide, [0] * (simhash.ODD // 64), 40))
            sets[node] = shared if k % 4 else [rnd.getrandbits(62) for _ in range(40)]  # every fourth pair is not alike
    table = spark.createDataFrame(rows, "node long, bands array<long>, wide array<long>, odd array<long>, size long")
    held = spark.createDataFrame(list(sets.items()), "node long, hashes array<long>")
    found = simhash.similar_groups(table, lambda needed: held.join(needed, "node"), 0.8)
    got = {r["node"]: r["group"] for r in found.collect()}
    assert got == {2 * k + c: 2 * k for k in range(40) if k % 4 for c in range(2)}
    empty = spark.createDataFrame([(1, [], [0] * 4, [0] * 8, 0)], table.schema)
    assert simhash.buckets_of(empty).count() == 0


def test_only_what_is_certainly_unlike_is_ruled_out(spark):
    rnd, rows, sets = random.Random(9), [], {}
    for k in range(12):  # pairs that share a band and nearly all shingles, whose fingerprints differ in half of their bits
        band, shared = rnd.getrandbits(62), [rnd.getrandbits(62) for _ in range(200)]
        for c in range(2):
            node = 2 * k + c
            wide = [simhash._signed(rnd.getrandbits(64)) for _ in range(4)]
            own = [rnd.getrandbits(62) for _ in range(10 if k % 3 else 60)]  # similarities 0.91 and 0.63
            rows.append((node, [band] + [rnd.getrandbits(62) for _ in range(simhash.BANDS - 1)], wide,
                         simhash.odd_sketch(np.array(shared + own, dtype=np.uint64)), 200 + len(own)))
            sets[node] = shared + own
    table = spark.createDataFrame(rows, "node long, bands array<long>, wide array<long>, odd array<long>, size long")
    held = spark.createDataFrame(list(sets.items()), "node long, hashes array<long>")
    got = {r["node"]: r["group"] for r in simhash.similar_groups(table, lambda needed: held.join(needed, "node"), 0.8).collect()}
    assert got == {2 * k + c: 2 * k for k in range(12) if k % 3 for c in range(2)}


def test_bands_miss_no_more_than_hashes_fall_together():
    for similarity in (0.8, 0.85, 0.9, 0.99):
        assert (1 - similarity**simhash.BAND) ** simhash.BANDS < 2e-12
    hashes = np.unique(np.random.default_rng(1).integers(0, 2**64, 400, dtype=np.uint64))
    assert len(set(simhash.bands_of(hashes))) == simhash.BANDS == len(simhash._ORDERS[0]) // simhash.BAND
