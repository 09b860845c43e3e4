"""MinHash near-dedup with tensored banding, links confirmed on full shingle sets, and connected components.

Two small collections of half-keys, each of a few minhashes, are made for every set; a table's key joins one half-key of each. So
``HALVES`` squared tables cost only twice ``HALVES`` half-keys' minhashes. Sets that are equal are one class from the start.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batch_of, body, dropped, map_batches, written
from .components import components

#: Half-keys in each collection and minhashes in each: 100 tables from 60 minhashes. A pair at similarity 0.8 shares a table with probability 0.998, one at 0.3 with 0.05.
HALVES, DEPTH = 10, 3
#: 64-bit numbers in a set's bitmap.
BITMAP = 16
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_arrays(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of all texts, one text after the other and sorted within each, and how many each has. Words are runs of bytes other than ASCII white space, with A-Z in lower case."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = lists.flatten().dictionary_encode()  # an empty text's one empty word has no bytes and goes
    known = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    real = np.fromiter(map(bool, known), bool, len(known))[codes]
    if not real.all():
        counts = np.diff(np.append(0, np.cumsum(real))[np.append(0, np.cumsum(counts))])
        codes = codes[real]
    words, ends = hashes[codes], np.cumsum(counts)
    starts = ends - counts
    powers = [np.uint64(pow(int(MIX), i, 1 << 64)) for i in range(width)]
    total = np.zeros(len(words), np.uint64)  # at each word, of the shingle that starts there
    for i, power in enumerate(powers):
        total[: max(len(words) - i, 0)] += words[i:] * power
    found = mixed(total + np.uint64(width))
    sizes = np.maximum(counts - (width - 1), np.minimum(counts, 1))
    for d in np.flatnonzero((counts > 0) & (counts < width)).tolist():
        n = int(counts[d])
        own = words[starts[d] : ends[d]] * np.array(powers[:n])
        found[starts[d]] = mixed(own.sum(dtype=np.uint64, keepdims=True) + np.uint64(n))[0]
    new = np.zeros(len(found), bool)
    for start, n in zip(starts.tolist(), sizes.tolist(), strict=True):
        found[start : start + n].sort()
        new[start : start + n] = True
    new[1:] &= found[1:] != found[:-1]
    new[starts[sizes > 0]] = True
    before = np.append(0, np.cumsum(new))
    return found[new], before[ends] - before[starts]


def table_keys(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row a set, which starts at each of ``starts``: one key a table, each half-key of the first collection joined with each of the second. Half-keys are of the minima of seeded permutations of the set's hashes."""
    minima = np.empty((len(starts), len(SEEDS)), np.uint64)
    for i, seed in enumerate(SEEDS):
        minima[:, i] = np.minimum.reduceat((shingles ^ seed) * MIX, starts) >> np.uint64(8)
    own = mixed(minima + np.arange(len(SEEDS), dtype=np.uint64)).reshape(-1, 2, HALVES, DEPTH)
    halves = np.bitwise_xor.reduce(own * (np.arange(DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)), axis=3)
    tables = np.arange(HALVES * HALVES, dtype=np.uint64).reshape(HALVES, HALVES)
    return mixed(halves[:, 0, :, None] * MIX + halves[:, 1, None, :] + tables).reshape(-1, HALVES * HALVES).view(np.int64)


def keys_of(shingles: np.ndarray, sizes: np.ndarray, most: int = 1 << 15) -> np.ndarray:
    """The table keys of all sets that are not empty, made for about ``most`` hashes at a time, which stay in a core's cache."""
    sizes = sizes[sizes > 0]
    ends = np.cumsum(sizes)
    out, low = [np.zeros((0, HALVES * HALVES), np.int64)], 0
    while low < len(sizes):
        begin = int(ends[low] - sizes[low])
        high = max(int(np.searchsorted(ends, begin + most, "right")), low + 1)
        out.append(table_keys(shingles[begin : ends[high - 1]], ends[low:high] - sizes[low:high] - begin))
        low = high
    return np.concatenate(out)


SEEDS = mixed(np.arange(1, 2 * HALVES * DEPTH + 1, dtype=np.uint64) * MIX)
#: Bytes of texts whose words and shingles a worker holds at once.
TEXT_BYTES = 4 << 20


def digests(shingles: np.ndarray, sizes: np.ndarray) -> list[bytes | None]:
    """Each set's class; none for an empty set."""
    return [xxhash.xxh3_128_digest(shingles[end - n : end]) if n else None for end, n in zip(np.cumsum(sizes).tolist(), sizes.tolist(), strict=True)]


def lists_of(sizes: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values.view(np.int64)))


def text_key() -> Column:
    """SHA-256 of the text; of a null text, no bytes."""
    return F.coalesce(F.unhex(F.sha2("text", 256)), F.lit(b""))


def signatures(texts: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, class, keys) of (doc_id, text, text_key): class is a digest of the whole set, keys one a table, none for an empty set."""
    types = {"doc_id": pa.int64(), "text_key": pa.binary(), "n_shingles": pa.int64(), "class": pa.binary(), "keys": pa.list_(pa.int64())}

    def work(batch):
        shingles, sizes = shingle_arrays(batch.column(1), width)
        keys = lists_of((sizes > 0) * HALVES * HALVES, keys_of(shingles, sizes).ravel())
        return batch_of(types, {"doc_id": batch.column(0), "text_key": batch.column(2), "n_shingles": sizes, "class": digests(shingles, sizes), "keys": keys})

    return map_batches(texts, lambda: work, "doc_id long, text_key binary, n_shingles long, class binary, keys array<long>", TEXT_BYTES)


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of (node, text)."""
    types = {"node": pa.int64(), "shingles": pa.list_(pa.int64())}

    def work(batch):
        shingles, sizes = shingle_arrays(batch.column(1), width)
        return batch_of(types, {"node": batch.column(0), "shingles": lists_of(sizes, shingles)})

    return map_batches(texts, lambda: work, "node long, shingles array<long>", TEXT_BYTES)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union. Joins are by sort-merge, so one node in very many pairs is split."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    both = pairs.hint("merge").join(one, "a").hint("merge").join(two, "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(100 * common >= percent * (F.size("set_a") + F.size("set_b") - common)).select("a", "b")


def near_links(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """One row a row of ``docs`` (doc_id, text): row, doc_id, text_key, n_shingles, component_id, keep_row; see :func:`near_dedup`."""
    source = docs.select(F.col("doc_id").cast("long"), body().alias("text"), text_key().alias("text_key"))
    rows = written(signatures(source, width).withColumn("row", F.monotonically_increasing_id()), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "text_key"))
    classes = rows.where("class is not null").groupBy("class").agg(first.alias("first"), F.min(F.struct("row", "keys")).alias("any"))
    classes = written(classes.select("class", F.col("any.row").alias("node"), F.col("first.row").alias("keep_row"), F.col("first.doc_id").alias("least_id"), F.col("first.text_key").alias("text_key"), F.col("any.keys").alias("keys")), "classes")
    keys = classes.select("node", F.explode("keys").alias("key"))
    buckets = written(keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    members = written(keys.hint("merge").join(buckets, "key").select("key", "node", "size"), "bucket-members")
    pairs = written(hub_pairs(members), "pairs")
    wanted = members.select("node").distinct()
    wanted = written(classes.select("node", F.col("least_id").alias("wanted_id"), F.col("text_key").alias("wanted_key")).hint("merge").join(wanted, "node"), "wanted-classes")
    own = (F.col("text_key") == F.col("wanted_key")) & F.col("doc_id").eqNullSafe(F.col("wanted_id"))
    texts = source.hint("merge").join(wanted, own).select("node", "text")
    sets = written(shingle_sets(texts, width).dropDuplicates(["node"]), "shingle-sets")  # of repeated rows one
    roots = written(components(confirmed(pairs, sets, percent)), "roots")
    left = written(mixed_members(members, roots), "mixed-members")
    found = written(confirmed(cross_component_pairs(left, sets, percent), sets, percent), "cross-links")
    if not found.isEmpty():
        stars = roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = written(components(stars.union(found)), "roots")
    dropped(buckets, members, pairs, wanted, sets, left, found)
    labels = classes.select("class", "node", "keep_row", "least_id").hint("merge").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    labels = written(labels, "class-roots")
    heads = labels.groupBy("root").agg(F.min(F.struct(F.col("least_id").isNull().alias("none"), "least_id", "keep_row")).alias("head"))
    labels = labels.select("class", "root").hint("merge").join(heads, "root").select("class", F.col("head.least_id").alias("component_id"), F.col("head.keep_row").alias("keep_row"))
    grouped = rows.where("class is not null").select("row", "doc_id", "text_key", "n_shingles", "class").hint("merge").join(labels, "class").select("row", "doc_id", "text_key", "n_shingles", "component_id", "keep_row")
    return grouped.union(rows.where("class is null").select("row", "doc_id", "text_key", "n_shingles", F.col("doc_id"), F.col("row")))


def bitmaps(sets: DataFrame, words: int = BITMAP) -> DataFrame:
    """(node, root, n, bits) of (node, root, shingles): how many shingles a set has, and at each place whether an odd number of them have it by their hash.

    Where two sets' bits differ, at least one shingle of one set alone has that place. Shingles that both sets hold do not change that, however many they are.
    """
    types = {"node": pa.int64(), "root": pa.int64(), "n": pa.int64(), "bits": pa.list_(pa.int64())}

    def work(batch):
        out: dict[str, list] = {"n": [], "bits": []}
        for shingles in batch.column(2):
            own = shingles.values.to_numpy().view(np.uint64)
            places = np.bincount((own % np.uint64(64 * words)).astype(np.int64), minlength=64 * words)
            out["n"].append(len(own))
            out["bits"].append(np.packbits((places & 1).astype(np.uint8)).view(np.int64))
        return batch_of(types, {"node": batch.column(0), "root": batch.column(1), **out})

    return map_batches(sets, lambda: work, "node long, root long, n long, bits array<long>")


def hub_pairs(members: DataFrame) -> DataFrame:
    """(a, b), a < b, once: in each bucket (key, node, size) its hub with each other member, as many pairs as members.

    The hub is the member that shares the most places in buckets with others, over all its buckets. Where many texts are copies of one, that
    is the one, and nearly all links are made through it.
    """
    degree = written(members.groupBy("node").agg(F.sum("size").alias("degree")), "degrees")
    ranked = members.hint("merge").join(degree, "node")
    hubs = written(ranked.groupBy("key").agg(F.max_by("node", F.struct("degree", -F.col("node"))).alias("hub")), "hubs")
    met = members.hint("merge").join(hubs, "key").where("node <> hub")
    return met.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def mixed_members(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, root), once, of members of buckets that hold more than one component: only they may still have links."""
    at = written(members.select("key", "node").hint("merge").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "member-roots")
    several = written(at.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key"), "mixed-buckets")
    return at.hint("merge").join(several, "key").select("node", "root").distinct()


def cross_component_pairs(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b, once: all pairs of nodes (node, root) of different components that may be similar, by an exact prefix-filter join.

    Shingles are ordered: those of one component alone first, then by frequency. Two similar sets share one of the first few of each, and
    those of one component alone meet none of another, so an outlier beside a large component meets little of it. At each shingle only
    members of other components than the one with the most members there meet the rest, so a large component never meets itself. Sizes, places in the order and
    bitmaps (two sets differ in at least as many shingles as their bitmaps do in bits) are compared in the join. A similar pair comes out where it
    first meets: all that it shares is from there on, so a place with too few shingles from there on in either set makes no row.
    """
    held = written(sets.hint("merge").join(left, "node").select("node", "root", "shingles"), "mixed-sets")
    tokens = held.select("node", "root", F.explode("shingles").alias("token"))
    by_root = tokens.groupBy("token", "root").agg(F.count("*").alias("often"))
    shared = by_root.groupBy("token").agg(F.sum("often").alias("often"), F.count("*").alias("roots"), F.max_by("root", F.struct("often", "root")).alias("major"))
    shared = written(shared.where("roots > 1").select("token", "often", "major"), "shared-shingles")
    ordered = tokens.select("node", "token").hint("merge").join(shared, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("often", "token", "major"))).alias("own"))
    n, own = F.col("n"), F.col("own")
    alone = n - F.size(own)
    first = F.greatest(n - F.ceil(n * percent / 100) + 1 - alone, F.lit(0)).cast("int")
    bits = [f"bits{i}" for i in range(BITMAP)]  # columns, not an array, so that Spark compares them in compiled code
    rich = ordered.hint("merge").join(bitmaps(held), "node").select("node", "root", "n", *(F.get("bits", F.lit(i)).alias(c) for i, c in enumerate(bits)), alone.alias("alone"), F.slice(own, F.lit(1), first).alias("prefix"))
    rich = rich.where(F.size("prefix") > 0).select("node", "root", "n", *bits, "alone", F.posexplode("prefix").alias("pos", "shared"))
    one, two = sides(written(rich.select("node", "root", "n", *bits, (F.col("alone") + F.col("pos")).alias("at"), "shared.token", "shared.major"), "prefixes"))
    least = F.ceil((F.col("n_a") + F.col("n_b")) * percent / (100 + percent))
    most = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    apart = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in bits), F.lit(0))
    near = (
        (F.col("root_a") != F.col("root_b")) & ((F.col("node_a") < F.col("node_b")) | (F.col("root_b") == F.col("major_a"))) & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        & (most >= least) & (apart <= F.col("n_a") + F.col("n_b") - 2 * least))
    met = one.hint("merge").join(two, (F.col("token_a") == F.col("token_b")) & near)
    return met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two sides that meet by token, with _a and _b after their names: rows of other components than the token's major one, and all rows."""
    one, two = (rows.select(*(F.col(c).alias(f"{c}_{side}") for c in rows.columns)) for side in "ab")
    return one.where("root_a <> major_a"), two.drop("major_b")


def near_dedup(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Links of near copies over all texts: doc_id, n_shingles, component_id, kept.

    A text's set is its distinct shingles of ``width`` words; with fewer words, the whole sequence as one; without any (or a null text), empty
    and linked with nothing. Sets are linked at a Jaccard similarity of ``percent`` in a hundred. component_id is the least doc_id
    reachable, null only if all ids are; kept is doc_id = component_id (nulls equal). One row a row, repeats
    included; an empty table gives an empty result; further columns are ignored.
    """
    linked = near_links(docs, width, percent)
    return linked.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near copies, the one with the least doc_id; all columns stay.

    Of repeated rows, which agree in doc_id and text, one stays. Documents without an id, or with another's, are told apart by their texts.
    Null, empty and wordless texts are near to nothing and stay; a very long text is compared whole; an empty table stays empty.
    """
    kept = near_links(docs, width, percent).where("row = keep_row").select("doc_id", "text_key").distinct()
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), text_key().alias("key"))  # no name of docs can clash
    paired = own.hint("merge").join(kept, (F.col("key") == F.col("text_key")) & F.col("id").eqNullSafe(F.col("doc_id")), "left_semi")
    once = W.partitionBy("id", "key").orderBy(F.lit(0))
    return paired.withColumn("copy", F.row_number().over(once)).where("copy = 1").select("row.*")
