"""Near-duplicate documents by 64-bit SimHash and covering locality-sensitive hashing.

For a radius ``r``, bit ``i`` of a fingerprint gets a nonzero vector ``phi(i)`` of ``r + 1`` bits, and each of the
``2^(r+1) - 1`` nonzero vectors ``v`` gives a mask of the bits with an odd ``phi(i) . v``. For any ``r`` bits some ``v``
is orthogonal to all their vectors, so two fingerprints that differ in at most ``r`` bits agree under that mask: the pair meets
in that table, always. With ``r = 2`` these are seven tables of 36 or 37 bits.

Buckets are not expanded into pairs. Two members within two bits have a midpoint within one bit of both, and any
two that share such a midpoint are within two bits; so each member of a bucket sends itself to its midpoints (the
differences lie outside the mask), and all that meet at a midpoint are linked to the smallest of them. That is exact, and linear in
the members however many of them a bucket holds.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.llm.common import give_back, stored, texts
from sheafline.llm.components import connected_components

BITS, RADIUS = 64, 2
NO_ID = 2**63 - 1
SEED = 42
# Shingle hashes whose bits are unpacked at once.
BLOCK = 1 << 16
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint_of(text: str, words_per_shingle: int = 3) -> int:
    """SimHash as an unsigned 64-bit number; 0 for a text without words."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()  # bytes.split: space and 09-0D
    if not words:
        return 0
    if len(words) <= words_per_shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(words_per_shingle))))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        block = hashes[at:at + BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: Column, words_per_shingle: int = 3) -> Column:
    """SimHash of a text as a signed bigint."""

    @F.pandas_udf("long")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            values = np.array([fingerprint_of(t, words_per_shingle) for t in batch], dtype=np.uint64)
            yield pd.Series(values.view(np.int64))

    return made(F.coalesce(text.cast("string"), F.lit("")))


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The masks, as unsigned numbers; vectors are dealt to the bits in turn, or spread out where there are more of them."""
    vectors = 2 ** (radius + 1) - 1
    step = 1 if vectors <= bits else next(s for s in range(vectors * 5 // 8, vectors) if math.gcd(s, vectors) == 1)
    return [sum(1 << i for i in range(bits) if bin((i * step % vectors + 1) & v).count("1") % 2) for v in range(1, vectors + 1)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def covering_tables() -> Column:
    """The covering masks as an array of ``t, mask``."""
    return F.array(*[F.struct(F.lit(t).alias("t"), F.lit(_signed(m)).alias("mask")) for t, m in enumerate(covering_masks())])


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints (column ``fingerprint``) that join all pairs within two bits.

    Every pair within two bits is connected through the links, and no link is longer than two bits.
    """
    masks = covering_masks()
    dealt = prints.select("fingerprint", F.explode(covering_tables()).alias("x")).select(
        "fingerprint", "x.t", F.col("fingerprint").bitwiseAND(F.col("x.mask")).alias("bucket"))
    met = dealt.groupBy("t", "bucket").agg(F.count("*").alias("n")).where("n > 1").select("t", "bucket")
    steps = F.array(*[F.array(*[F.lit(x) for x in [0] + [_signed(1 << i) for i in range(BITS) if not m >> i & 1]]) for m in masks])
    spread = dealt.join(met, ["t", "bucket"]).select("fingerprint", "t", F.explode(F.element_at(steps, F.col("t") + 1)).alias("step")).select(
        "fingerprint", "t", F.col("fingerprint").bitwiseXOR(F.col("step")).alias("midpoint"))
    least = spread.groupBy("t", "midpoint").agg(F.min("fingerprint").alias("a"), F.max("fingerprint").alias("z")).where("a < z")
    return spread.join(least.drop("z"), ["t", "midpoint"]).where("fingerprint > a").select("a", F.col("fingerprint").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words_per_shingle: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` (bigint) and ``component_id``, the smallest id linked to it over any number of steps.

    A null or empty text has fingerprint zero and is linked like any other. Repeated rows each come back; rows of one id
    with other texts keep their own fingerprints. A null id counts as larger than all others, and a component of nulls
    only has a null component. An empty table gives no rows; other columns are not looked at; texts are taken whole.
    """
    rows = texts(docs, id_column, text_column).select("doc_id", fingerprint(F.col("text"), words_per_shingle).alias("fingerprint"))
    rows = stored(rows, "fingerprints")
    prints = stored(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct-fingerprints")
    found = connected_components(fingerprint_links(prints.select("fingerprint")))
    named = prints.join(found.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn(
        "component", F.coalesce("component", "fingerprint"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"), F.sum("n").alias("rows"))
    shared = named.join(least.where("rows > 1"), "component").select("fingerprint", "component_id")
    return rows.join(shared, "fingerprint", "left").select("doc_id", "fingerprint", F.coalesce("component_id", "doc_id").alias("component_id"))


# --- groups of similar documents: similarity of five-word shingles --------------------------------------


# Words of a shingle. Candidates differ in at most ``RADIUS`` bits of their SimHashes, which the covering tables always find, or agree in
# one of ``BANDS`` bands of ``BAND`` least hashes of their shingles each: of pairs with Jaccard similarity 0.8 all but
# (1 - 0.8^4)^52 = 1.3 in 10^12 do, wherever their words differ, and fewer of more similar ones. That is in the range in which hashes of
# 64 bits fall together, which name the shingles and the sets.
SHINGLE, BANDS, BAND = 5, 52, 4
# Shingle hashes that all least hashes are taken over at once.
LEAST_BLOCK = 1 << 11
# All candidates of at least this Jaccard similarity are links. Only what is certainly below is ruled out without comparing the shingles.
SIMILARITY = 0.8
# Bits of a sketch that says for each part of all shingles whether a set holds an odd number of them: two sets differ in at least
# as many shingles as their sketches do in bits.
ODD = 512
# Members of a bucket that are compared with all others of it in the first round.
LEADERS = 6
# What the hashes are mixed with before the SimHash and the sketch.
_TURN, _ODD_TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x27D4EB2F165667C5)
# What the hashes are mixed with, an odd number for each order.
_ORDERS = np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * BAND), dtype=np.uint64) | np.uint64(1)


def _majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed number."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[at:at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def _turned(hashes: np.ndarray, turn: np.uint64) -> np.ndarray:
    mixed = (hashes ^ turn) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return mixed ^ (mixed >> np.uint64(31))


def shingle_hashes(text: str) -> np.ndarray:
    """Sorted hashes of the distinct five-word shingles; of the whole, where there are fewer words; none without words."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, dtype="<u8")
    shingles = set(map(b" ".join, zip(*(words[k:] for k in range(SHINGLE))))) or {b" ".join(words)}
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype="<u8"))


def bands_of(hashes: np.ndarray) -> list[int]:
    """A number for each band: equal where the least hashes of two sets under the band's ``BAND`` orders are equal."""
    least = np.full(BANDS * BAND, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(hashes), LEAST_BLOCK):
        turned = (hashes[at:at + LEAST_BLOCK, None] ^ _ORDERS[0]) * _ORDERS[1]
        np.minimum(least, turned.min(axis=0), out=least)
    return [xxhash.xxh64_intdigest(b.tobytes(), SEED) - 2**63 for b in least.reshape(BANDS, BAND)]


def odd_sketch(hashes: np.ndarray) -> list[int]:
    """``ODD`` bits, as signed numbers: whether an odd number of the hashes falls in each part."""
    part = (hashes ^ _ODD_TURN) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - (ODD - 1).bit_length())
    odd = np.bincount(part.astype(np.int64), minlength=ODD) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8").tolist()


def differing(similarity: float) -> float:
    """The largest share of both sets' shingles together that sets of this Jaccard similarity differ in."""
    return (1 - similarity) / (1 + similarity)


def prints_of(text: str) -> tuple[int, list[int], list[int], list[int], int]:
    """Of the set of a text's distinct five-word shingles: a number of its own, its bands, its SimHash (in a list of one), its odd sketch,
    and its size. A text without words has no bands."""
    hashes = shingle_hashes(text)
    node = xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - 2**63
    if not len(hashes):
        return node, [], [0], [0] * (ODD // 64), 0
    return node, bands_of(hashes), [_majority(_turned(hashes, _TURN))], odd_sketch(hashes), len(hashes)


def _prints(text: Column) -> Column:
    @F.pandas_udf("node long, bands array<long>, wide array<long>, odd array<long>, size long")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made_of = [prints_of(t) for t in batch]
            kinds = {"node": "int64", "bands": object, "wide": object, "odd": object, "size": "int64"}
            yield pd.DataFrame({name: pd.Series([p[k] for p in made_of], dtype=kind) for k, (name, kind) in enumerate(kinds.items())})
            del made_of
        give_back()

    return made(F.coalesce(text.cast("string"), F.lit("")))


def linked_in_buckets(buckets: DataFrame, verified: Callable[[DataFrame], DataFrame], sketches: DataFrame | None = None,
                      may_link: Callable[[str, str], Column] | None = None) -> DataFrame:
    """``node, component`` for the nodes linked to others: any two nodes of a bucket (``t, bucket, node``) that ``verified`` (pairs
    ``a, b`` in, those that are links out) keeps are in one component.

    In each round some members of each bucket are compared with all members of other components, linked, and then leave it. They
    are drawn from outside the bucket's largest component; a bucket whose members are all in one component is done. Buckets
    of up to ``LEADERS + 1`` members are compared whole at once, a group of near copies falls together in the first round whatever its
    size, and only members that stay unlinked though they meet are compared one with another: four times as many a round.
    With ``sketches`` (``node, sketch``), pairs that ``may_link`` rules out by the names of both sketches are not made at all.
    """
    if sketches is None:
        sketches, may_link = buckets.select("node", F.lit(None).alias("sketch")).distinct(), lambda x, y: F.lit(True)
    held, names, links, leaders = stored(buckets.withColumn("component", F.col("node")), "buckets"), None, None, LEADERS
    while True:
        counted = held.groupBy("t", "bucket", "component").agg(F.count("*").alias("n"))
        met = counted.groupBy("t", "bucket").agg(
            F.count("*").alias("parts"), F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("most")).where("parts > 1")
        met = met.select("t", "bucket", F.col("most.component").alias("main"), (F.col("n") - F.col("most.n")).alias("others"))
        # The same nodes lead in all buckets of like size, so that pairs repeat there and are judged once.
        drawn = F.pmod(F.xxhash64("node", F.lit(leaders)), F.lit(1 << 30)) / (1 << 30) * F.col("others") < leaders
        held = stored(held.join(met, ["t", "bucket"]).select(
            "t", "bucket", "node", "component", ((F.col("component") != F.col("main")) & drawn).alias("leads")), "members")
        if held.isEmpty():
            break
        known = held.join(sketches, "node")
        first = known.where("leads").select("t", "bucket", F.col("node").alias("x"), F.col("component").alias("_of"), F.col("sketch").alias("_sketch"))
        pairs = first.join(known, ["t", "bucket"]).where((F.col("component") != F.col("_of")) & may_link("_sketch", "sketch")).select(
            F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()
        found = stored(verified(pairs), "similar")
        links = found if links is None else links.unionAll(found)
        names = stored(connected_components(links), "components")
        held = held.where("NOT leads").select("t", "bucket", "node").join(names, "node", "left").withColumn(
            "component", F.coalesce("component", "node"))
        leaders *= 4
    return names if names is not None else buckets.select("node", F.col("node").alias("component")).limit(0)


def _hashes(text: Column) -> Column:
    @F.pandas_udf("array<long>")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([shingle_hashes(t).view("<i8") for t in batch], dtype=object)
        give_back()

    return made(text)


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those ``a, b`` of ``pairs`` whose sets (``node, hashes``) have this Jaccard similarity or more."""
    first = sets.select(F.col("node").alias("a"), F.col("hashes").alias("hashes_a"))
    second = sets.select(F.col("node").alias("b"), F.col("hashes").alias("hashes_b"))
    both = F.size(F.array_intersect("hashes_a", "hashes_b"))
    counted = pairs.join(first, "a").join(second, "b").select("a", "b", both.alias("n"), (F.size("hashes_a") + F.size("hashes_b") - both).alias("of"))
    return counted.where(F.col("n") >= F.col("of") * similarity - 1e-9).select("a", "b")


def buckets_of(rows: DataFrame) -> DataFrame:
    """``node, t, bucket``: where the nodes of ``rows`` (``node, bands, wide, size``) meet.

    The first number of ``wide`` is the SimHash of the five-word shingles, and any two of them within ``RADIUS`` bits agree under one of the
    covering masks. The bands are for sets that are similar but whose fingerprints are farther apart. A text without
    words meets nothing.
    """
    covered = F.transform(covering_tables(), lambda x: F.element_at("wide", 1).bitwiseAND(x["mask"]))
    keys = F.when(F.col("size") > 0, F.concat("bands", covered)).otherwise(F.array().cast("array<long>"))
    return rows.select("node", F.posexplode(keys).alias("t", "bucket"))


def similar_groups(rows: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """``node, group`` for those nodes of ``rows`` (``node, bands, wide, odd, size``, distinct) that are linked to others.

    Nodes whose SimHashes agree under a covering mask, or that agree in a band, meet in a bucket. Any two that meet, and whose sizes and odd
    sketches do not rule it out for certain, are compared by all their shingles (``sets_of`` makes ``node, hashes`` of a table of nodes) and
    linked at ``similarity`` or more."""
    dealt = buckets_of(rows)

    def may_link(x: str, y: str) -> Column:
        one, other = F.col(f"{x}.size"), F.col(f"{y}.size")
        apart = F.aggregate(F.zip_with(f"{x}.odd", f"{y}.odd", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, n: s + n)
        return (F.least(one, other) >= F.greatest(one, other) * similarity - 1e-9) & (apart <= (one + other) * differing(similarity) + 1e-9)

    def verified(pairs: DataFrame) -> DataFrame:
        near = stored(pairs, "candidates")
        needed = near.select(F.col("a").alias("node")).unionAll(near.select(F.col("b").alias("node"))).distinct()
        return alike(near, stored(sets_of(needed), "sets"), similarity)

    sketches = rows.select("node", F.struct("odd", "size").alias("sketch"))
    return linked_in_buckets(dealt, verified, sketches, may_link).withColumnRenamed("component", "group")


def keep_one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of documents with similar five-word shingles, the one with the smallest id; all columns
    as they are.

    Equal texts are one group, null and empty texts too. A null id counts as larger than all others; of several rows equal in
    id and text one stays. An empty table stays empty; texts are taken whole.
    """
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    hash_ = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(id_.alias("id"), hash_.alias("hash"), _prints(F.col("text")).alias("p")).select(
        "id", "hash", "p.node", "p.bands", "p.wide", "p.odd", "p.size")
    rows = stored(rows, "prints")
    nodes = stored(rows.select("node", "bands", "wide", "odd", "size").dropDuplicates(["node"]), "nodes")
    # Copies meet in their node before anything is joined, so no key of the join has more than one row.
    firsts = rows.groupBy("node").agg(F.min(F.struct("id", "hash")).alias("k"))
    held = docs.select(id_.alias("id"), hash_.alias("hash"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def sets_of(needed: DataFrame) -> DataFrame:
        chosen = held.join(firsts.join(needed, "node").select("node", "k.id", "k.hash"), ["id", "hash"])
        return chosen.select("node", _hashes(F.col("text")).alias("hashes")).dropDuplicates(["node"])

    found = similar_groups(nodes, sets_of, similarity)
    grouped = firsts.join(found, "node", "left").withColumn("group", F.coalesce("group", "node"))
    first = grouped.groupBy("group").agg(F.min("k").alias("k")).select(F.col("k.id").alias("_id"), F.col("k.hash").alias("_hash"))
    # The frame's own columns move into one struct, so that no name of theirs can clash.
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), id_.alias("_id"), hash_.alias("_hash"))
    return whole.join(first, ["_id", "_hash"]).dropDuplicates(["_id", "_hash"]).select("row.*")


def as_hex(column: str) -> Column:
    """A bigint as 16 lowercase hexadecimal digits."""
    return F.lpad(F.lower(F.hex(column)), 16, "0")
