"""SimHash near-dedup with covering locality-sensitive hashing.

A fingerprint bit is 1 if it is set in over half of the XXH64 hashes of the text's
word shingles, repeats included. Fingerprints link at radius or fewer differing
bits. Candidates come from a covering code: bit i has a nonzero vector phi(i) of
radius + 1 bits, and table v (each nonzero vector) keeps the bits i with an odd
overlap of phi(i) and v. Any radius differing bits span at most radius dimensions,
so some v is orthogonal to all of them: that table drops every differing bit and
the pair meets there, whatever the bits are. Every candidate is then compared.

Copies collapse to one fingerprint before any table is built. Within a bucket no
pairs are emitted, only links to a spanning root: small buckets compare neighbours
directly; larger ones meet at hubs (a fingerprint or one bit off it: two within
distance 2 share a hub); buckets beyond GIANT hand their hubs to a shuffle, so no
bucket has to fit into memory. For other radii than 1 or 2 all buckets compare
directly, in blocks.

Defined results: null text is empty; no words give fingerprint zero, linked like
any other. Fewer words than a shingle are one shingle. Rows sharing a doc_id are
rows of their own with that id; null doc_ids are never a component_id unless a
component has no other. An empty table gives no rows.

keep_one, the pipeline's stage, links sets of five-word shingles of a Jaccard
similarity of 0.8 or more. Its first candidates are the components of the sets'
SimHash fingerprints under the covering code. At that similarity fingerprints differ
in about 10 of 64 bits, for which a code would need 2^11 tables, so bands of minimum
hashes add the candidates beyond the code's radius. All are then compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.workers import kept, resting
from tessera.operators.components import connected_components
from tessera.runtime import partitions, settle, ship, small, table

BITS, SMALL, GIANT = 64, 48, 32_768
#: Minimum hashes of similar_groups: at similarity 0.8, all bands miss a pair 7 times in 100,000 (0.672 ^ 24).
BANDS, ROWS = 24, 5
#: Shingles of a block of sets that a task holds two of.
BLOCK_GRAMS = 500_000


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the word shingles of text with A-Z lower-cased."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and white space only
    if not w:
        return 0
    parts = zip(*(w[i:] for i in range(words)), strict=False) if len(w) >= words else [w]
    return majority(np.array(list(map(xxhash.xxh64_intdigest, map(b" ".join, parts), repeat(seed))), np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(BITS, np.int64)
    for lo in range(0, len(hashes), 1 << 15):
        part = hashes[lo : lo + (1 << 15)]
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = np.flatnonzero(2 * counts > len(hashes))
    return sum(1 << int(b) for b in set_bits)


def fingerprints(docs: DataFrame, words: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number."""
    sent = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("doc_id", sent.schema["doc_id"].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.fromiter((fingerprint(x.as_py(), words) for x in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    ship(docs.sparkSession)
    return sent.mapInArrow(resting(run), schema)


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """The kept bits of each of the 2^(radius+1) - 1 tables."""
    top = 1 << (radius + 1)
    return [sum(1 << i for i in range(bits) if ((i % (top - 1) + 1) & v).bit_count() % 2) for v in range(1, top)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _roots(pairs: np.ndarray) -> dict[int, int]:
    """Union-find over pairs of numbers: member -> smallest member, roots left out."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    for a, b in pairs.tolist():
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


def _near(fps: np.ndarray, group: np.ndarray, radius: int) -> list[np.ndarray]:
    """Linked pairs within groups of sorted rows, compared lag by lag."""
    found, lag = [], 1
    while lag < len(fps) and (same := group[lag:] == group[:-lag]).any():
        i = np.flatnonzero(same)
        d = np.bitwise_count(fps[i].view(np.uint64) ^ fps[i + lag].view(np.uint64))
        i = i[d <= radius]
        if len(i):
            found.append(np.stack([fps[i], fps[i + lag]], 1))
        lag += 1
    return found


def _hubs(fps: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """(hub, fingerprint) rows: itself and each one-bit change outside of the mask."""
    flips = np.array([0] + [1 << i for i in range(BITS) if not mask >> i & 1], np.uint64)
    hubs = fps.view(np.uint64)[:, None] ^ flips[None, :]
    return hubs.ravel().view(np.int64), np.repeat(fps, len(flips))


def _bucket_links(fps: np.ndarray, mask: int, radius: int) -> dict[int, int]:
    if len(fps) <= SMALL or radius > 2:
        pairs = _near(fps, np.zeros(len(fps), np.int8), radius)
        return _roots(np.concatenate(pairs)) if pairs else {}
    hub, who = _hubs(fps, mask)
    order = np.argsort(hub, kind="stable")
    hub, who = hub[order], who[order]
    same = hub[1:] == hub[:-1]
    pairs = np.stack([who[:-1][same], who[1:][same]], 1)
    if radius == 1:
        pairs = pairs[np.bitwise_count(pairs[:, 0].view(np.uint64) ^ pairs[:, 1].view(np.uint64)) <= 1]
        more = _near(fps, np.zeros(len(fps), np.int8), 1)
        pairs = np.concatenate([pairs, *more])
    return _roots(pairs)


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """(u, v) spanning links between distinct fingerprints (column fp) within radius bits."""
    spark, masks = distinct.sparkSession, covering_masks(radius)
    keys = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)))
    rows = distinct.select("fp", F.explode(keys).alias("k")).select("k.t", "k.key", "fp")
    rows = rows.repartition(partitions(spark), "t", "key").sortWithinPartitions("t", "key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the bucket that may go on in the next batch
        at, giant = None, False

        def out(kind: int, a, b) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64))], names=["kind", "a", "b"])

        def end() -> Iterator[pa.RecordBatch]:
            if at is not None and not giant and sum(map(len, held)) > 1:
                up = _bucket_links(np.concatenate(held), masks[at[0]], radius)
                yield out(0, list(up), list(up.values()))

        for b in batches:
            t, key, fp = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cut = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
            for lo, hi in zip([0, *cut], [*cut, len(fp)], strict=True):
                if hi == lo:
                    continue
                if (now := (int(t[lo]), int(key[lo]))) != at:
                    yield from end()
                    held, at, giant = [], now, False
                held.append(fp[lo:hi])
                if radius == 2 and (giant or sum(map(len, held)) > GIANT):
                    giant = True
                    for part in held:
                        for i in range(0, len(part), 4096):
                            yield out(1, *_hubs(part[i : i + 4096], masks[now[0]]))
                    held = []
        yield from end()

    ship(spark)
    found = settle(rows.mapInArrow(resting(run), "kind tinyint, a bigint, b bigint"), "simhash-links")
    met = found.where("kind = 1").select(F.col("a").alias("hub"), F.col("b").alias("fp"))
    root = met.groupBy("hub").agg(F.min("fp").alias("v"))
    more = met.join(root, "hub").where("fp <> v").select(F.col("fp").alias("u"), "v")
    return found.where("kind = 0").select(F.col("a").alias("u"), F.col("b").alias("v")).union(more)


def near_groups(docs: DataFrame, words: int = 3, radius: int = 2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id): a row for each document, with the smallest doc_id it is linked to."""
    marked = settle(fingerprints(docs, words, text, doc_id), "simhash")
    distinct = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    parts = connected_components(links(distinct, radius))
    rooted = distinct.join(parts, distinct["fp"] == parts["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of text; empty without words."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    parts = zip(*(w[i:] for i in range(words)), strict=False) if len(w) >= words else [w] if w else []
    return np.unique(np.array(list(map(xxhash.xxh64_intdigest, map(b" ".join, parts), repeat(42))), np.uint64))


def _constants() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of the minimum hashes, and the multipliers that mix a band."""
    import xxhash

    a, b, c = (np.array([xxhash.xxh64_intdigest(f"{k}{i}") for i in range(BANDS * ROWS)], np.uint64) for k in "abc")
    return a | np.uint64(1), b, c.reshape(BANDS, ROWS) | np.uint64(1)


def marks(docs: DataFrame, words: int = 5, text: str = "text") -> DataFrame:
    """(doc_id, tid, fp, code, keys): tid hashes the text, fp its set of shingles, code is the set's SimHash fingerprint.

    keys has one for each band of minimum hashes. Only the first row of a set in a task has a code and keys, so copies
    do not pile up on them.
    """
    sent = docs.select("doc_id", F.xxhash64(F.col(f"`{text}`")).alias("tid"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([T.StructField("doc_id", sent.schema["doc_id"].dataType), T.StructField("tid", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("code", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        kept("simhash")  # nothing, but the codec of a pipeline's last stage goes
        mul, add, mix = _constants()
        seen: set[int] = set()
        work = np.empty((BANDS * ROWS, 256), np.uint64)
        for b in batches:
            fps, codes, keys = np.zeros(b.num_rows, np.uint64), [None] * b.num_rows, []
            for r, x in enumerate(b.column(2)):
                found = shingle_set(x.as_py(), words)
                fps[r] = fp = xxhash.xxh64_intdigest(found.tobytes())
                if fp in seen or not len(found):
                    keys.append(np.zeros(0, np.int64))
                    continue
                seen.add(fp)
                codes[r] = _signed(majority(found))
                least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
                for lo in range(0, len(found), 256):
                    part = found[lo : lo + 256]
                    hashed = np.multiply(part, mul[:, None], out=work[:, : len(part)])
                    hashed += add[:, None]
                    np.minimum(least, hashed.min(axis=1), out=least)
                keys.append((least.reshape(BANDS, ROWS) * mix).sum(axis=1, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64)), pa.array(codes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "tid", "fp", "code", "keys"])

    ship(docs.sparkSession)
    return sent.mapInArrow(resting(run), schema)


def met(marked: DataFrame) -> DataFrame:
    """(key, fp, pivot): the sets that share a key with others, each with the smallest of its key or of its range's part of it.

    Keys are spread over sorted ranges together with the sets, so one that very many sets share is dealt over
    several tasks, which stream it. The first and last key of a range may go on in the next one: their smallest
    sets are told with fp = pivot, and then linked to the smallest of all.
    """
    rows = marked.select(F.explode("keys").alias("key"), "fp")
    rows = rows.repartitionByRange(partitions(marked.sparkSession), "key", "fp").sortWithinPartitions("key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, head, last, begun = 0, 0, 0, False  # the key that may go on in the next batch, its smallest and its latest set

        def out(key, fp, pivot) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (key, fp, pivot)], names=["key", "fp", "pivot"])

        for b in batches:
            if not b.num_rows:
                continue
            key, fp = (b.column(i).to_numpy() for i in range(2))
            new = np.concatenate([[not begun or key[0] != at], key[1:] != key[:-1]])
            again = np.concatenate([[not new[0] and fp[0] == last], ~new[1:] & (fp[1:] == fp[:-1])])
            if not begun:
                yield out(key[:1], fp[:1], fp[:1])
            first = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            pivot = np.where(first < 0, head, fp[first])
            own = ~new & ~again
            yield out(key[own], fp[own], pivot[own])
            at, head, last, begun = key[-1], pivot[-1], fp[-1], True
        if begun:
            yield out([at], [head], [head])

    ship(marked.sparkSession)
    held = settle(rows.mapInArrow(resting(run), "key bigint, fp bigint, pivot bigint"), "bands")
    heads = held.where("fp = pivot").groupBy("key").agg(F.min("pivot").alias("head"))  # two rows a range at most
    over = held.where("fp = pivot").join(heads, "key").where("fp <> head").select("key", "fp", F.col("head").alias("pivot"))
    return held.where("fp <> pivot").unionByName(over)


def coded(marked: DataFrame, radius: int = 2) -> DataFrame:
    """(key, fp, pivot): the sets whose fingerprints the covering code links, each with the smallest set of its component."""
    sets = settle(marked.where("code is not null").select("fp", "code").distinct(), "codes")
    parts = connected_components(links(sets.select(F.col("code").alias("fp")).distinct(), radius))
    rooted = sets.join(parts, sets["code"] == parts["node"], "left").select("fp", F.coalesce("component", "code").alias("root"))
    rooted = settle(rooted, "coded")
    heads = rooted.groupBy("root").agg(F.min("fp").alias("pivot"), F.max("fp").alias("last")).where("pivot <> last").select("root", "pivot")
    return rooted.join(heads, "root").where("fp <> pivot").select(F.xxhash64(F.lit("code"), "root").alias("key"), "fp", "pivot")


def shingle_table(docs: DataFrame, asked: DataFrame, words: int, text: str) -> DataFrame:
    """(fp, grams): the shingle set of each asked row (fp, __d, __t), read from its text."""
    t = F.col(f"`{text}`")
    d = docs.select("doc_id", F.xxhash64(t).alias("tid"), t.alias("text"))
    texts = d.join(small(asked), d["doc_id"].eqNullSafe(asked["__d"]) & (d["tid"] == asked["__t"])).select("fp", "text").dropDuplicates(["fp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                grams = [shingle_set(x.as_py(), words).view(np.int64) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(grams, pa.list_(pa.int64()))], names=["fp", "grams"])

    return settle(texts.mapInArrow(resting(run), "fp bigint, grams array<bigint>"), "shingle-sets")


def similar_roots(sets: list[np.ndarray], similarity: float, label: np.ndarray | None = None, block: np.ndarray | None = None) -> np.ndarray:
    """The smallest index linked to each set, where sets of that Jaccard similarity or more link.

    label: sets known to be linked share one. block: if given, sets of one block are not compared with each other.
    Common shingles are counted along an inverted index. What is in the component of the most frequent label
    need not be asked, as each link that is left has an end outside of it.
    """
    n, sizes = len(sets), np.array([len(x) for x in sets], np.int64)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)[np.argsort(code, kind="stable")]
    count = np.bincount(code)
    start = np.concatenate([[0], np.cumsum(count)])
    at = np.concatenate([[0], np.cumsum(sizes)])
    up = np.arange(n) if label is None else np.unique(label, return_index=True)[1][np.unique(label, return_inverse=True)[1]]

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    hub = int(np.bincount(up, minlength=n).argmax())
    order = np.argsort([-int(count[code[at[x] : at[x + 1]]].sum()) for x in range(n)], kind="stable").tolist()
    if up[hub] == hub and (up == hub).sum() == 1:
        hub = order[0]
    for x in order:
        if x != hub and find(x) == find(hub):
            continue
        own = code[at[x] : at[x + 1]]
        met_ = np.repeat(start[own] - np.concatenate([[0], np.cumsum(count[own])[:-1]]), count[own]) + np.arange(count[own].sum())
        common = np.bincount(owner[met_], minlength=n)
        if block is not None:
            common[block == block[x]] = 0
        for y in np.flatnonzero((common > 0) & (common * (1 + similarity) >= similarity * (sizes[x] + sizes) - 1e-9)).tolist():
            a, b = find(x), find(y)
            up[max(a, b)] = min(a, b)
    return np.array([find(x) for x in range(n)])


def unsettled(held: DataFrame, sets: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """(u, v): links between sets of one key whose labels differ still.

    Only keys that hold several labels are looked at. Their connected parts are cut into blocks of about
    BLOCK_GRAMS shingles, and each pair of blocks is a task of its own, which compares its sets exactly.
    """
    of = lambda c, name: labels.select(F.col("node").alias(c), F.col("component").alias(name))
    told = held.join(of("fp", "a"), "fp", "left").join(of("pivot", "b"), "pivot", "left").select("key", "fp", "pivot", F.coalesce("a", "fp").alias("a"), F.coalesce("b", "pivot").alias("b"))
    told = settle(told, "labelled-bands")
    part = told.join(told.where("a <> b").select("key").distinct(), "key", "left_semi")
    whose = part.select("fp", F.col("a").alias("label")).union(part.select("pivot", "b")).distinct()
    groups = connected_components(part.select("fp", "pivot"), "fp", "pivot")
    rows = whose.join(groups, whose["fp"] == groups["node"]).select("component", "fp", "label").join(sets, "fp")
    rows = settle(rows, "unsettled")
    blocks = rows.groupBy("component").agg(F.ceil(F.sum(F.size("grams")) / BLOCK_GRAMS).cast("int").alias("blocks"))
    dealt = rows.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("fp"), F.greatest("blocks", F.lit(1))).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.greatest("blocks", F.lit(1)) - 1)))
    dealt = dealt.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp", "label", "block", "grams")
    dealt = dealt.repartition(partitions(held.sparkSession), "component", "i", "j")  # else all pairs of a component would follow each other in one task

    def solve(rows_: pa.Table) -> pa.Table:
        fps, label, block, i, j = (rows_[c].to_numpy() for c in ("fp", "label", "block", "i", "j"))
        order = np.argsort(fps)
        grams = [np.asarray(rows_["grams"][int(x)].values) for x in order]
        fps = fps[order]
        roots = similar_roots(grams, similarity, label[order], block[order] if i[0] != j[0] else None)
        return pa.table({"u": pa.array(fps), "v": pa.array(fps[roots])})

    return settle(dealt.groupBy("component", "i", "j").applyInArrow(solve, "u bigint, v bigint").where("u <> v"), "similar")


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, text: str = "text") -> DataFrame:
    """(doc_id, tid, keep_id, keep_tid): a row for each document, with the row that stands for its group.

    Equal sets collapse first. Sets whose SimHash fingerprints the covering code links are candidates, and so are those
    that share a band of minimum hashes. Each is compared with the smallest set of its component or band, which settles
    most; those that hold several groups after that are compared in blocks. So a group of any size is spread over
    tasks, and no link between candidates is lost.
    """
    marked = settle(marks(docs, words, text), "shingles")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tid"))
    distinct = settle(marked.groupBy("fp").agg(least.alias("least")), "shingles-distinct")
    held = settle(coded(marked).unionByName(met(marked)), "candidates")
    pairs = held.select(F.col("fp").alias("u"), F.col("pivot").alias("v")).distinct()
    asked = pairs.select(F.col("u").alias("fp")).union(pairs.select("v")).distinct()
    asked = settle(distinct.join(asked, "fp").select("fp", F.col("least.doc_id").alias("__d"), F.col("least.tid").alias("__t")), "candidate-rows")
    sets = shingle_table(docs, asked, words, text)
    both = pairs.join(sets.select(F.col("fp").alias("u"), F.col("grams").alias("a")), "u").join(sets.select(F.col("fp").alias("v"), F.col("grams").alias("b")), "v")
    alike = F.size(F.array_intersect("a", "b")) * (1 + similarity) >= F.lit(similarity) * (F.size("a") + F.size("b")) - 1e-9
    linked = settle(both.where(alike).select("u", "v"), "alike")
    labels = connected_components(linked)
    more = unsettled(held, sets, labels, similarity)
    parts = connected_components(linked.union(more)) if more.take(1) else labels
    rooted = distinct.join(parts, distinct["fp"] == parts["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    keep = rooted.groupBy("root").agg(F.min("least").alias("keep"))
    named = rooted.select("fp", "root").join(keep, "root").select("fp", F.col("keep.doc_id").alias("keep_id"), F.col("keep.tid").alias("keep_tid"))
    return marked.join(named, "fp").select("doc_id", "tid", "keep_id", "keep_tid")


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, text: str = "text") -> DataFrame:
    """docs with one row of each group of similar texts: the smallest by (doc_id, hash of text), null ids last.

    Rows are told apart by both, so rows that only share an id, or have none, do not stand for each other; of
    repeated rows that share both, one stays. What goes or repeats is less than what stays: while it is counted
    to be little, the texts are not shuffled.
    """
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("tid") == F.col("keep_tid"))
    fate = similar_groups(docs, words, similarity, text).groupBy("doc_id", "tid").agg(F.sum(kept.cast("int")).alias("n"))
    fate = settle(fate.where("n <> 1").select(F.col("doc_id").alias("__d"), F.col("tid").alias("__t"), "n"), "fate")
    odd, twice = small(fate), small(fate.where("n > 1"))
    d = docs.withColumn("__tid", F.xxhash64(F.col(f"`{text}`")))
    same = lambda other: d["doc_id"].eqNullSafe(other["__d"]) & (d["__tid"] == other["__t"])
    once = d.join(odd, same(odd), "left_anti")
    return once.unionByName(d.join(twice, same(twice), "left_semi").dropDuplicates(["doc_id", "__tid"])).drop("__tid")
