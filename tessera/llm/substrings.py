"""Exact substring dedup with a blockwise suffix array and a difference cover.

A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a
smaller document, or further left in the same one. Strings are judged on the input.

1. Every LENGTH-byte window holds an anchor, its K-gram of least hash. An anchor's
   context is all that windows around it can hold. Anchors meet by K-gram hash; all
   but the first with one context are repeats with all their windows.
2. Where one K-gram has several contexts, the first of each is a suffix bucket's
   member. Buckets are sorted one alignment at a time: by a prefix of a few bytes,
   and where that ties by the ranks of the difference-cover sample (positions mod 13
   in {0, 1, 3, 9}) precomputed for the block, so no tie is compared byte by byte.
   Neighbours in suffix order that agree in LENGTH bytes are one string; all its
   places but the first are repeats.
3. Documents, in blocks of about BLOCK bytes, drop the bytes of repeated windows.

Memory is bounded by a block of text, a bucket of anchors and a chunk of CHUNK
contexts. Copies collapse within each batch before they are shuffled. A K-gram that
a sample of documents shows in more than HOT contexts overall is dealt by context
instead, and its suffix buckets by the 80 bytes that the windows of SEGMENT alignments
have in common; this choice only spreads the work and never changes the result.

Defined results: null text is empty. Rows that share doc_id and text are one document
(each keeps what the first keeps); other rows that share a doc_id are ordered by a
hash of their text. Null doc_ids come before all. Extra columns are left out. Hashes
of 128 bits (K-gram and context) stand for contexts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.runtime import settle, ship, table

LENGTH, K = 100, 20
BEFORE = LENGTH - K  # context bytes before an anchor; a window starts at most so far left of it
CONTEXT = BEFORE + LENGTH
STRIDE, MOD, COVER = 182, 13, (0, 1, 3, 9)  # STRIDE: a multiple of MOD that holds a context
SEGMENT = 21  # alignments whose windows of a hot K-gram are dealt together
PIECE, BLOCK, BUCKET, CHUNK, HOT, SAMPLE_BYTES = 1 << 21, 16 << 20, 32 << 20, 40_000, 60_000, 64 << 20
ROWS = "key int, kind string, n int, blob binary"
U8, I8, I4, U1 = np.dtype("<u8"), np.dtype("<i8"), np.dtype("<i4"), np.dtype("u1")
FORMS = {"a": (U8, U8, I8, I8, I4), "g": (U8, U8, I8, I8, I4), "r": (U8, I8, I8, I4), "q": (U8, I8, I8, I4), "f": (I8, I8, I4), "d": (I8, I8, I4)}
M64 = (1 << 64) - 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Hashes:
    """Hashes of substrings by prefix sums: (P[e] - P[s]) / B^s in arithmetic mod 2^64."""

    def __init__(self, seed: int, size: int):
        r = np.random.default_rng(seed)
        self.table = r.integers(1, M64, 256, np.uint64, endpoint=True)
        base = int(r.integers(1, M64, dtype=np.uint64, endpoint=True)) | 1
        self.up = self._powers(base, size + 1)
        self.down = self._powers(pow(base, -1, 1 << 64), size + 1)

    @staticmethod
    def _powers(base: int, size: int) -> np.ndarray:
        p = np.full(size, base, np.uint64)
        p[0] = 1
        return np.cumprod(p)

    def sums(self, b: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.table[b] * self.up[: len(b)])])

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((sums[end] - sums[start]) * self.down[start])


_HASHES: dict[int, Hashes] = {}


def _hashes(seed: int, size: int) -> Hashes:
    if seed not in _HASHES or len(_HASHES[seed].up) <= size:
        _HASHES[seed] = Hashes(seed, max(size, PIECE + CONTEXT))
    return _HASHES[seed]


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over x[i : i + width]."""
    done = 1
    while 2 * done <= width:
        x = pick(x[:-done], x[done:])
        done *= 2
    return pick(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def anchors(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(position, hash, context hash, document number) of the anchors of documents laid end to end."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64))
    if len(b) < LENGTH:
        return none
    one, two = _hashes(1, len(b)), _hashes(2, len(b))
    sums = one.sums(b)
    grams = _mix((sums[K:] - sums[:-K]) * one.down[: len(b) - K + 1])
    low = _slide(grams, BEFORE + 1, np.minimum)  # of the window that starts here
    valid = np.zeros(len(low) + 1, np.int32)
    fits = ends - starts >= LENGTH
    np.add.at(valid, starts[fits], 1)
    np.add.at(valid, ends[fits] - LENGTH + 1, -1)
    low[np.cumsum(valid[:-1]) == 0] = 0
    pad = np.zeros(BEFORE, np.uint64)
    at = np.flatnonzero((_slide(np.concatenate([pad, low, pad]), BEFORE + 1, np.maximum)[: len(grams)] == grams))
    if not len(at):
        return none
    doc = np.searchsorted(starts, at, "right") - 1
    lo, hi = np.maximum(at - BEFORE, starts[doc]), np.minimum(at + LENGTH, ends[doc])
    context = two.of(two.sums(b), lo, hi) ^ _mix(((at - lo) * 256 + (hi - at)).astype(np.uint64))
    return at, grams[at], context, doc


def pack(*arrays: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpack(blob: bytes, n: int, forms) -> list[np.ndarray]:
    import zstandard

    raw, out, at = zstandard.ZstdDecompressor().decompress(blob), [], 0
    for f in forms:
        out.append(np.frombuffer(raw, f, n, at))
        at += n * f.itemsize
    return [*out, np.frombuffer(raw, np.uint8, offset=at)]


class _Out:
    """Collects rows of ROWS."""

    def __init__(self):
        self.rows: list[tuple] = []

    def deal(self, kind: str, key: np.ndarray, *cols: np.ndarray) -> None:
        """A row for each key, with its part of the columns."""
        if not len(key):
            return
        order = np.argsort(key, kind="stable")
        key = key[order]
        cut = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        cols = tuple(c[order] for c in cols)
        for lo, hi in zip(cut, cut[1:], strict=False):
            self.rows.append((int(key[lo]), kind, hi - lo, pack(*(c[lo:hi] for c in cols))))

    def batch(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows, strict=True)) if self.rows else [[], [], [], []]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.binary())], names=["key", "kind", "n", "blob"])

    def table(self) -> pa.Table:
        return pa.Table.from_batches([self.batch()])


def _place(doc: np.ndarray, tid: np.ndarray, blocks: int) -> np.ndarray:
    return (_mix(doc.astype(np.int64).view(np.uint64) ^ _mix(tid.astype(np.int64).view(np.uint64))) % np.uint64(blocks)).astype(np.int64)


def _later(first_of: tuple[np.ndarray, ...], doc, tid, pos) -> tuple[np.ndarray, np.ndarray]:
    """Order by the given keys, then place; (order, repeats: rows after the first place of their keys)."""
    order = np.lexsort((pos, tid, doc, *reversed(first_of)))
    same = np.ones(len(order), bool)
    same[:1] = False
    for k in first_of:
        same[1:] &= k[order][1:] == k[order][:-1]
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))  # of the run
    o, h = order, order[head]
    other = (doc[o] != doc[h]) | (tid[o] != tid[h]) | (pos[o] != pos[h])
    return order, same & other


def _pieces(docs: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(bytes, starts, ends, doc, tid, offset, whether another part follows) of about PIECE bytes; long documents in overlapping parts."""
    ids, tids, texts, offs, more, size = [], [], [], [], [], 0

    def out():
        ends = np.cumsum([len(t) for t in texts])
        return np.frombuffer(b"".join(texts), np.uint8), np.r_[0, ends[:-1]].astype(np.int64), ends.astype(np.int64), np.array(ids, np.int64), np.array(tids, np.int64), np.array(offs, np.int64), np.array(more, bool)

    for b in docs:
        for d, t, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            x = x.as_buffer().to_pybytes() if x.is_valid else b""
            step = PIECE - 2 * CONTEXT
            for lo in range(0, max(len(x) - 2 * CONTEXT, 1), step):
                part = x[lo : lo + PIECE]
                if size + len(part) > PIECE and texts:
                    yield out()
                    ids, tids, texts, offs, more, size = [], [], [], [], [], 0
                ids.append(d)
                tids.append(t)
                texts.append(part)
                offs.append(lo)
                more.append(lo + PIECE < len(x))
                size += len(part)
    if texts:
        yield out()


def _found(piece: tuple) -> tuple[np.ndarray, ...]:
    """(h, c, doc, tid, pos) of a piece's anchors; those whose context a part's edge cuts are its neighbour's."""
    b, starts, ends, ids, tids, offs, more = piece
    at, h, c, doc = anchors(b, starts, ends)
    pos = at - starts[doc]
    keep = ((offs[doc] == 0) | (pos >= CONTEXT)) & (~more[doc] | (pos < PIECE - CONTEXT))
    doc, pos = doc[keep], pos[keep]
    return h[keep], c[keep], ids[doc], tids[doc], (pos + offs[doc]).astype(np.int32)


def suffix_repeats(h: np.ndarray, text: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """(context, BEFORE + 1) flags: the window o bytes left of the anchor occurs in an earlier context.

    Contexts are in order of bucket h, then place; text: (contexts, CONTEXT) bytes. Windows that are alike hold the
    same K-gram at the same place, so they are of one bucket without being sorted by it. Contexts that share no core
    with another (see by_core) have no window in common with it and are not sorted.
    """
    out = np.zeros((len(h), BEFORE + 1), bool)
    ok = _shared(h, text, left, right)
    some = np.flatnonzero(ok.any(1))
    if len(some):
        out[some] = _sorted_repeats(text[some], ok[some])
    return out


def _shared(h: np.ndarray, text: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """(context, BEFORE + 1) flags: whether there is such a window whose core some other context of the bucket has too."""
    ok = np.zeros((len(h), BEFORE + 1), bool)
    parts = [by_core(*(x[lo : lo + 4096] for x in (h, text, left, right))) for lo in range(0, len(h), 4096)]
    if not parts:
        return ok
    row = np.concatenate([p[0] + lo for p, lo in zip(parts, range(0, len(h), 4096), strict=True)])
    key, to, since = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
    order = np.argsort(key, kind="stable")
    again = np.r_[False, key[order][1:] == key[order][:-1]]
    again |= np.r_[again[1:], False]
    at = order[again]
    begin, size = LENGTH - since[at].astype(np.int64), to[at].astype(np.int64) + since[at] - LENGTH + 1
    nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    ok[np.repeat(row[at], size), np.repeat(begin, size) + nth] = True
    return ok


def _sorted_repeats(text: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """suffix_repeats of the windows that ok flags, by their suffix order."""
    n = len(text)
    t = np.zeros((n, STRIDE + 2 * MOD), np.uint8)
    t[:, :CONTEXT] = text
    eight = lambda p: np.ascontiguousarray(t[:, p : p + 8]).view(">u8").ravel().astype(np.uint64)
    sample = np.array([p for p in range(STRIDE) if p % MOD in COVER])
    # ranks of the sample suffixes: 13 bytes at first, then twice as many in each round
    head, rest = (np.stack([eight(p) for p in at.tolist()], 1) for at in (sample, sample + 8))
    low = np.uint64(8 * (MOD - 8))
    rank = _ranks((_ranks(head) << low) | (rest >> (np.uint64(64) - low)))
    for step in (MOD, 2 * MOD, 4 * MOD):
        half, after, ahead = rank, np.zeros_like(rank), step // MOD * len(COVER)
        after[:, :-ahead] = rank[:, ahead:]
        need = int(np.searchsorted(sample, BEFORE + MOD)) if step == 4 * MOD else len(sample)  # windows start in the first bytes
        rank = _ranks((rank[:, :need] << np.uint64(32)) | after[:, :need])
    bits = np.uint64(int(rank.max(initial=0)).bit_length())
    out = np.zeros((n, BEFORE + 1), bool)
    for o in range(BEFORE + 1):
        i = BEFORE - o
        rows = np.flatnonzero(ok[:, o])
        if len(rows) < 2:
            continue
        j = int(np.searchsorted(sample, i))  # the first sample suffix of the window, at most 5 bytes in
        k = int(np.searchsorted(sample, i + LENGTH - 4 * MOD, "right")) - 1  # the last one whose half rank ends in it, at most 5 bytes from its end
        delta = np.uint64(8 * (int(sample[j]) - i))
        prefix = eight(i)[rows] >> (np.uint64(64) - delta) if delta else np.zeros(len(rows), np.uint64)
        order = np.argsort((prefix << bits) | rank[rows, j], kind="stable") if delta + bits <= 64 else np.lexsort((rank[rows, j], prefix))
        rows = rows[order]
        same = np.zeros(len(rows), bool)
        same[1:] = True
        for part in (prefix[order], half[rows, j], half[rows, k], eight(i + LENGTH - 8)[rows]):  # these overlap and hold all bytes of the window
            same[1:] &= part[1:] == part[:-1]
        run = np.flatnonzero(~same)
        first = np.repeat(np.minimum.reduceat(rows, run), np.diff(np.r_[run, len(rows)]))
        out[rows[rows != first], o] = True
    return out


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Dense ranks of keys, in their shape. Copies collapse before they are sorted."""
    found = pa.array(np.ascontiguousarray(keys).ravel()).dictionary_encode()
    distinct = found.dictionary.to_numpy()
    rank = np.empty(len(distinct), np.uint64)
    rank[np.argsort(distinct)] = np.arange(len(distinct), dtype=np.uint64)
    return rank[found.indices.to_numpy()].reshape(keys.shape)


def by_core(h: np.ndarray, text: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, key, left, right): contexts dealt by a hash of the bytes that all windows of a segment of alignments hold.

    The windows that start a to b bytes left of the anchor share LENGTH - (b - a) bytes, so those that are alike get
    one key. left and right are narrowed to the segment: each window is in one of a context's SEGMENT-wide rows.
    """
    hs = _hashes(3, text.size)
    sums = hs.sums(np.ascontiguousarray(text).reshape(-1))
    base, out = np.arange(len(h)) * CONTEXT + BEFORE, []
    for a in range(0, BEFORE + 1, SEGMENT):
        b = min(a + SEGMENT - 1, BEFORE)
        to, since = np.minimum(left, b), np.minimum(right, LENGTH - a)
        at = np.flatnonzero((left >= a) & (right >= LENGTH - b) & (to.astype(int) + since >= LENGTH))
        key = _mix(hs.of(sums, base[at] - a, base[at] + LENGTH - b) ^ _mix(h[at] + np.uint64(a)))
        out.append((at, key, to[at], since[at]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def deal_contexts(out: _Out, got: list[tuple], buckets: int) -> None:
    """Rows of (h, doc, tid, pos, left, right, context) by bucket."""
    h, doc, tid, pos, left, right, m = (np.concatenate(x) for x in zip(*got, strict=True))
    key = (h % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((h, key))
    out.deal("x", key[order], *(x[order] for x in (h, doc, tid, pos, left, right, m)))


def deal_hot(out: _Out, got: list[tuple], buckets: int) -> None:
    """The same of contexts of hot K-grams, by core; all texts of a block together, so that a row holds many."""
    held, size = [], 0
    for i, g in enumerate(got):
        held.append(g)
        size += len(g[0])
        if size >= CHUNK or i == len(got) - 1:
            h, doc, tid, pos, left, right, m = (np.concatenate(x) for x in zip(*held, strict=True))
            parts = []
            for lo in range(0, len(h), 4096):
                at, key, to, since = by_core(*(x[lo : lo + 4096] for x in (h, m, left, right)))
                at += lo
                parts.append((key, doc[at], tid[at], pos[at], to, since, m[at]))
            deal_contexts(out, parts, buckets)
            held, size = [], 0


def _group(t: pa.Table) -> Iterator[tuple[str, int, bytes]]:
    for b in t.to_batches():
        yield from zip(b.column("kind").to_pylist(), b.column("n").to_pylist(), (x.as_buffer().to_pybytes() for x in b.column("blob")), strict=True)


def _join(parts: list[list[np.ndarray]], forms) -> list[np.ndarray]:
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, f) for i, f in enumerate(forms)]


def _texts(rows: list[tuple[int, bytes]]) -> Iterator[tuple[int, int, bytes]]:
    for n, blob in rows:
        doc, tid, size, raw = unpack(blob, n, (I8, I8, I8))
        raw, at = raw.tobytes(), 0
        for d, t, s in zip(doc.tolist(), tid.tolist(), size.tolist(), strict=True):
            yield d, t, raw[at : at + s]
            at += s


def dedup_substrings(docs: DataFrame, text: str = "text", hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept): spans are the maximal removed (start, length) runs of bytes."""
    spark = docs.sparkSession
    ship(spark)
    t = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"), F.xxhash64(t).alias("tid"), t.alias("text"))
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, buckets = max(1, -(-total // BLOCK)), max(1, -(-total // BUCKET))
    heavy = _hot_grams(d, total, hot)
    sent = spark.sparkContext.broadcast(np.array(sorted(heavy), np.uint64))  # at most the sample's anchors / its share of hot

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, many = _Out(), sent.value
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            h, c, doc, tid, pos = _join(held, FORMS["a"])
            order, again = _later((h, c), doc, tid, pos)
            late = order[again]
            out.deal("f", buckets + _place(doc[late], tid[late], blocks), doc[late], tid[late], pos[late])
            once = np.sort(order[~again])  # in order of document and position, which packs well
            h, c, doc, tid, pos = (x[once] for x in (h, c, doc, tid, pos))
            is_hot = np.isin(h, many) if len(many) else np.zeros(len(h), bool)
            for kind, at in (("a", ~is_hot), ("g", is_hot)):
                key = h[at] if kind == "a" else _mix(h[at] ^ c[at])
                out.deal(kind, (key % np.uint64(buckets)).astype(np.int64), h[at], c[at], doc[at], tid[at], pos[at])
            return out.batch()

        for piece in _pieces(batches):
            held.append(_found(piece))
            size += len(piece[0])
            if size >= 8 * PIECE:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def meet(table_: pa.Table) -> pa.Table:
        out, kinds = _Out(), {"a": [], "g": []}
        for kind, n, blob in _group(table_):
            if kind == "f":
                out.rows.append((table_["key"][0].as_py() - buckets, "f", n, blob))
            else:
                kinds[kind].append(unpack(blob, n, FORMS[kind])[:5])
        for kind, parts in kinds.items():
            h, c, doc, tid, pos = _join(parts, FORMS[kind])
            order, again = _later((h, c), doc, tid, pos)
            late = order[again]
            out.deal("f", _place(doc[late], tid[late], blocks), doc[late], tid[late], pos[late])
            order = order[np.r_[True, (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1])]] if len(order) else order
            h, doc, tid, pos = h[order], doc[order], tid[order], pos[order]
            if kind == "a" and len(h):  # only K-grams with several contexts
                more = np.r_[False, h[1:] == h[:-1]]
                more |= np.r_[more[1:], False]
                h, doc, tid, pos = h[more], doc[more], tid[more], pos[more]
            out.deal("r" if kind == "a" else "q", _place(doc, tid, blocks), h, doc, tid, pos)
        return out.table()

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                doc, tid = (part.column(i).to_numpy() for i in (0, 1))
                key = _place(doc, tid, blocks)
                order = np.argsort(key, kind="stable")
                cut = [0, *(np.flatnonzero(np.diff(key[order])) + 1).tolist(), len(order)]
                rows = []
                for a, z in zip(cut, cut[1:], strict=False):
                    at = order[a:z]
                    texts = [part.column(2)[int(i)].as_buffer().to_pybytes() for i in at]
                    raw = b"".join([doc[at].tobytes(), tid[at].tobytes(), np.array([len(x) for x in texts], I8).tobytes(), *texts])
                    rows.append((int(key[at[0]]), "t", len(at), zstandard.ZstdCompressor(level=1).compress(raw)))
                out = _Out()
                out.rows = rows
                yield out.batch()

    def contexts(table_: pa.Table) -> pa.Table:
        out, asked, texts = _Out(), {"r": [], "q": []}, []
        for kind, n, blob in _group(table_):
            if kind == "t":
                texts.append((n, blob))
            elif kind in asked:
                asked[kind].append(unpack(blob, n, FORMS[kind])[:4])
        wanted = {}
        for kind, parts in asked.items():
            h, doc, tid, pos = _join(parts, FORMS[kind])
            order = np.lexsort((tid, doc))
            cut = [0, *(np.flatnonzero((np.diff(doc[order]) != 0) | (np.diff(tid[order]) != 0)) + 1).tolist(), len(order)] if len(order) else [0]
            for lo, hi in zip(cut, cut[1:], strict=False):
                at = order[lo:hi]
                wanted.setdefault((int(doc[at[0]]), int(tid[at[0]])), {})[kind] = (h[at], pos[at])
        got = {"r": [], "q": []}
        for d_, t_, x in _texts(texts):
            for kind, (h, pos) in wanted.pop((d_, t_), {}).items():  # pop: once for rows that are alike
                b = np.concatenate([np.zeros(BEFORE, np.uint8), np.frombuffer(x, np.uint8), np.zeros(LENGTH, np.uint8)])
                left, right = np.minimum(pos, BEFORE), np.minimum(len(x) - pos, LENGTH)
                got[kind].append((h, np.full(len(h), d_, I8), np.full(len(h), t_, I8), pos, left.astype(U1), right.astype(U1), b[pos[:, None].astype(np.int64) + np.arange(CONTEXT)[None, :]]))
        if got["r"]:
            deal_contexts(out, got["r"], buckets)
        if got["q"]:
            deal_hot(out, got["q"], buckets)
        return out.table()

    def sort_buckets(table_: pa.Table) -> pa.Table:
        out, parts = _Out(), []
        for kind, n, blob in _group(table_):
            if kind == "x":
                *cols, raw = unpack(blob, n, (U8, I8, I8, I4, U1, U1))
                parts.append([*cols, raw.reshape(n, CONTEXT)])
        if parts:
            h, doc, tid, pos, left, right, m = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((pos, tid, doc, h))
            ends = np.r_[np.flatnonzero(np.diff(h[order])) + 1, len(order)]  # of suffix buckets
            lo = 0
            while lo < len(order):
                fit = ends[(ends > lo) & (ends <= lo + CHUNK)]
                hi = int(fit[-1] if len(fit) else ends[ends > lo][0])
                at = order[lo:hi]
                row, o = np.nonzero(suffix_repeats(h[at], m[at], left[at], right[at]))
                at = at[row]
                out.deal("d", _place(doc[at], tid[at], blocks), doc[at], tid[at], (pos[at] - o).astype(I4))
                lo = hi
        return out.table()

    result = "doc bigint, n_bytes bigint, n_removed bigint, spans array<struct<start: bigint, length: bigint>>, kept binary"

    def cut_out(table_: pa.Table) -> pa.Table:
        texts, marks = [], {"f": [], "d": []}
        for kind, n, blob in _group(table_):
            if kind == "t":
                texts.append((n, blob))
            elif kind in marks:
                marks[kind].append(unpack(blob, n, FORMS[kind])[:3])
        of: dict = {}
        for kind, parts in marks.items():
            doc, tid, pos = _join(parts, FORMS[kind])
            order = np.lexsort((pos, tid, doc))
            cut = [0, *(np.flatnonzero((np.diff(doc[order]) != 0) | (np.diff(tid[order]) != 0)) + 1).tolist(), len(order)] if len(order) else [0]
            for lo, hi in zip(cut, cut[1:], strict=False):
                at = order[lo:hi]
                of.setdefault((int(doc[at[0]]), int(tid[at[0]])), {})[kind] = pos[at]
        cols: list[list] = [[], [], [], [], []]
        for d_, t_, x in _texts(texts):
            n, edge = len(x), np.zeros(len(x) + 1, np.int32)
            own = of.get((d_, t_), {})
            if "f" in own:  # all windows around these anchors
                a, z = np.maximum(own["f"] - BEFORE, 0), np.minimum(own["f"] + LENGTH, n)
                np.add.at(edge, a, 1)
                np.add.at(edge, z, -1)
            if "d" in own:
                np.add.at(edge, own["d"], 1)
                np.add.at(edge, own["d"] + LENGTH, -1)
            gone = np.cumsum(edge[:-1]) > 0
            change = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
            b = np.frombuffer(x, np.uint8)
            for c, v in zip(cols, (d_, n, int(gone.sum()), [{"start": int(s), "length": int(e - s)} for s, e in change.reshape(-1, 2)], b[~gone].tobytes()), strict=True):
                c.append(v)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])), pa.binary())
        return pa.table({k: pa.array(c, ty) for k, c, ty in zip(("doc", "n_bytes", "n_removed", "spans", "kept"), cols, types, strict=True)})

    met = settle(d.mapInArrow(scatter, ROWS).groupBy("key").applyInArrow(meet, ROWS), "anchors")
    packed = d.mapInArrow(load, ROWS)
    asked = packed.unionByName(met.where("kind in ('r', 'q')")).groupBy("key").applyInArrow(contexts, ROWS)
    dups = settle(asked.groupBy("key").applyInArrow(sort_buckets, ROWS), "repeats")
    done = packed.unionByName(met.where("kind = 'f'")).unionByName(dups).groupBy("key").applyInArrow(cut_out, result)
    return done.select(F.nullif("doc", F.lit(-(2**63))).alias("doc_id"), "n_bytes", "n_removed", "spans", "kept")


def _hot_grams(d: DataFrame, total: int, hot: int) -> set[int]:
    """K-grams that, by a sample of about SAMPLE_BYTES, have more than hot contexts: a matter of load alone."""
    share = min(1.0, SAMPLE_BYTES / max(total, 1))
    need = max(8, int(hot * share / 2))
    part = d if share == 1.0 else d.where(F.pmod(F.xxhash64("tid"), F.lit(1_000_003)) < int(share * 1_000_003))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            h, c = _found(piece)[:2]
            h = np.unique(np.stack([h, c], 1), axis=0)[:, 0] if len(h) else h
            v, n = np.unique(h, return_counts=True)
            some = n >= 3  # of one piece; thinner ones cannot fill a bucket
            yield pa.RecordBatch.from_arrays([pa.array(v[some].view(np.int64)), pa.array(n[some].astype(np.int64))], names=["h", "n"])

    seen = part.mapInArrow(count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= need)
    return {r["h"] & M64 for r in seen.orderBy(F.desc("n"), "h").limit(100_000).collect()}


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
