"""N-gram Jaccard join: documents whose sets of word 5-grams have a Jaccard similarity of at least 3/4, and their groups.

1. Sets: one scan gives each row the size and a hash of its set. Equal sets are one class, and only the document of its
   smallest id is looked at further, so copies cost nothing but that scan.
2. Count: the distinct shingles (64-bit hashes) of these documents are counted, packed by hash range, each chunk
   pre-aggregated. A bitmap of all that repeat and a map of how often, both of bounded size, go to all tasks. They make
   the global order, rarest first: a bit set by chance costs a little order, never a result. Were the bitmap full, every
   shingle would count as repeated, and only more candidates would be looked at.
3. Prefixes: two sets that qualify share one of their first ``n - ceil(3n/4) + 1`` shingles in any global order. What is
   not in the bitmap is in no other set, so only prefix shingles that repeat are sent; most documents have none. Those
   that share one are candidate groups, which hold every pair that could qualify; only their sets are stored.
4. Trie join within candidate groups, in blocks of bounded size: sets are stored in a trie of globally ordered shingles
   (most frequent first, so that near copies share their paths); a probe walks it once, sharing partial overlaps, and
   leaves a subtree when the lengths that remain cannot reach the threshold. Groups of more than one block are dealt
   anew at random a few times and joined. Then only prefix shingles that sets of different parts share can hide a link:
   the sets that have one form new groups, in which all outside the largest part are compared with the whole group.

Tables of a step are deleted as soon as nothing reads them.

Joins on a key that much of the rows may share (a shingle, a group, a set of copies) deal hot keys over many tasks.

No pairs within a group are emitted: only links that join two parts not joined before. Shingle hashes are taken as the
shingles, 60 bits of them for the prefixes. Defined results: fewer than five words: the whole sequence is one shingle; no
words, or null or empty text: an empty set, linked with nothing; a null id keeps its row, with no component; rows of
equal id are one node; an empty table gives an empty table; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SHARE, components, cut, dropped, hot_join, parallelism, texts_of, utf8_buffer

WORDS, CHUNK_BYTES = 5, 2 << 20
BITMAP_BITS = 27
LEAST_BITS, MOST_BITS, OFTEN_BITS, LEVEL = 24, 29, 24, 60
BLOCK, CELL, DEALS, BROADCAST_IDS = 64, 1 << 19, 3, 1_000_000

_tables: dict = {}


def _hash_tables():
    """(byte -> 64-bit code with A-Z as a-z and white space as 0, is white space, powers of an odd number)."""
    import numpy as np

    if not _tables:
        code = np.random.default_rng(20240607).integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        code[65:91] = code[97:123]
        space = np.zeros(256, bool)
        space[[32, *range(9, 14)]] = True
        code[space] = 0
        power = np.ones(1 << 16, np.uint64)
        np.multiply.accumulate(np.full((1 << 16) - 1, 0x9E3779B97F4A7C15, np.uint64), out=power[1:])
        _tables["t"] = code, space, power
    return _tables["t"]


def _mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(data, offsets, n: int = WORDS):
    """(hashes, bounds): shingle hashes of each text one after the other, repeated ones too; text k has bounds[k:k+2]."""
    import numpy as np

    code, is_space, power = _hash_tables()
    texts = len(offsets) - 1
    space = is_space[data]
    inside = ~space
    start, end = inside.copy(), inside.copy()
    start[1:] &= space[:-1]
    end[:-1] &= space[1:]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    start[edges] = inside[edges]
    edges = offsets[1:][offsets[1:] > 0] - 1
    end[edges] = inside[edges]
    ws, we = np.flatnonzero(start), np.flatnonzero(end) + 1
    if not len(ws):
        return np.zeros(0, np.uint64), np.zeros(texts + 1, np.int64)
    place = np.arange(ws[0], len(data), dtype=np.int64) - np.repeat(ws, np.diff(np.append(ws, len(data))))
    scaled = power[place & 0xFFFF]
    if int(place.max()) > 0xFFFF:
        far = power[0xFFFF] * power[1]
        for k in range(1, (int(place.max()) >> 16) + 1):
            own = place >> 16 == k
            scaled[own] *= np.power(far, np.uint64(k), dtype=np.uint64)
    words = _mix(np.add.reduceat(code[data[ws[0] :]] * scaled, ws - ws[0]) + (we - ws).astype(np.uint64))
    first = np.searchsorted(ws, offsets)  # text k has the words first[k] to first[k + 1]
    count = np.diff(first)
    made = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(made)])
    out = np.zeros(bounds[-1], np.uint64)
    at = np.repeat(first[:-1] - bounds[:-1], made) + np.arange(bounds[-1])  # first word of each shingle
    length = np.repeat(np.minimum(count, n), made)
    out[:] = length.astype(np.uint64)
    for j in range(n):
        own = slice(None) if j == 0 else length > j
        out[own] = _mix(out[own] * np.uint64(0x9E3779B97F4A7C15) + words[at[own] + j])
    return out, bounds


def chunks(batches: Iterator[pa.RecordBatch]):
    """(ids, shingle hashes, bounds) of a few MB of text at a time; a longer text is a chunk of its own."""
    for batch in batches:
        data, offsets = utf8_buffer(batch.column(1))
        ids, k = batch.column(0).to_pylist(), 0
        while k < len(ids):
            m = k + 1
            while m < len(ids) and offsets[m + 1] - offsets[k] <= CHUNK_BYTES:
                m += 1
            yield (ids[k:m], *shingles(data[offsets[k] : offsets[m]], offsets[k : m + 1] - offsets[k]))
            k = m


def sets_of(hashes, bounds):
    """The sorted distinct values of each text."""
    import numpy as np

    return [np.unique(hashes[s:e]) for s, e in zip(bounds[:-1], bounds[1:], strict=True)]


def _by_shard(h, bits: int):
    """(shard, start, end) of sorted hashes; a shard is a value of the upper ``bits`` bits."""
    import numpy as np

    at = np.append(np.searchsorted(h, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(h))
    return [(int(k), int(at[k]), int(at[k + 1])) for k in np.flatnonzero(np.diff(at))]


def _within(h, bits: int):
    """The 32 bits of a hash below its shard's: with the shard the short key of a shingle."""
    import numpy as np

    return ((h >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _squeezed(low) -> bytes:
    """Sorted 32-bit integers as differences, a plane for each byte: the upper planes compress well."""
    import numpy as np

    return np.diff(low, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes()


def _unsqueezed(packed: bytes):
    import numpy as np

    return np.cumsum(np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(4, -1).T).view(np.uint32).ravel(), dtype=np.uint32)


def named_sets(df: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, node`` of every row: the size of its set and a 64-bit hash of it, null if it is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, hashes, bounds in chunks(batches):
            own = sets_of(hashes, bounds)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(x) for x in own], pa.int64()), pa.array([_node(x) if len(x) else None for x in own], pa.int64())], names=["doc_id", "n_shingles", "node"])

    return texts_of(df).mapInArrow(run, "doc_id long, n_shingles long, node long")


def _node(own) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)


def _of_ids(batches: Iterator[pa.RecordBatch], ids: bytearray) -> Iterator[pa.RecordBatch]:
    """The rows whose id has its bit in ``ids``; a bit set for another id only adds a row."""
    import numpy as np

    bits = np.frombuffer(ids, np.uint8)
    for batch in batches:
        batch = batch.filter(batch.column(0).is_valid())
        slot = _slot(batch.column(0).to_numpy())
        batch = batch.filter(pa.array((bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1))
        if batch.num_rows:
            yield batch


def frequencies(df: DataFrame, ids: bytearray, shard_bits: int) -> tuple[bytes, bytes]:
    """Which shingles repeat, and how often, of the documents whose bit is set in ``ids``.

    The first map has a bit for each range of hashes, set where a shingle occurs in several texts: none is left out. It has
    about four times as many bits as there are such shingles, ``2 ** MOST_BITS`` (64 MB) at most. The second has a byte for
    each of 2 ** OFTEN_BITS ranges (16 MB): the whole binary logarithm of the document frequency, from 4 on or, so that it
    does not fill up, from where half as many shingles are left.
    """
    import numpy as np

    shared = df.sparkSession.sparkContext.broadcast(ids)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, hashes, bounds in chunks(_of_ids(batches, shared.value)):
            keys, n = np.unique(np.concatenate([*sets_of(hashes, bounds), np.zeros(0, np.uint64)]), return_counts=True)
            low, n = _within(keys, shard_bits), np.minimum(n, 255).astype(np.uint8)
            parts = [(k, _squeezed(low[s:e]), n[s:e].tobytes()) for k, s, e in _by_shard(keys, shard_bits)]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary()), pa.array([p[2] for p in parts], pa.binary())], names=["shard", "low", "n"])

    def total(part: pa.Table) -> pa.Table:
        low = np.concatenate([_unsqueezed(x.as_py()) for x in part["low"]])
        n = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in part["n"]])
        order = np.argsort(low, kind="stable")
        low, n = low[order], n[order].astype(np.int64)
        first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        n = np.minimum(np.add.reduceat(n, first), 4096)
        keep = n > 1
        return pa.table({"shard": pa.array([part["shard"][0].as_py()], pa.int32()), "low": pa.array([low[first][keep].tobytes()], pa.binary()), "n": pa.array([n[keep].astype(np.uint16).tobytes()], pa.binary())})

    spread = cut(texts_of(df).mapInArrow(count, "shard int, low binary, n binary").groupBy("shard").applyInArrow(total, "shard int, low binary, n binary"))
    shared.destroy()  # the table has what it was for

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_n = np.zeros(4097, np.int64)
        for batch in batches:
            for x in batch.column(2):
                all_n += np.bincount(np.frombuffer(x.as_py(), np.uint16), minlength=4097)
        at = np.flatnonzero(all_n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(all_n[at])], names=["df", "n"])

    found = {r["df"]: r["n"] for r in spread.mapInArrow(histogram, "df int, n long").groupBy("df").agg(F.sum("n").alias("n")).collect()}  # at most 4097 rows
    bits = max(LEAST_BITS, min(MOST_BITS, (4 * sum(found.values())).bit_length()))
    least, kept = 4097, 0
    for v in sorted((v for v in found if v >= 4), reverse=True):
        if kept + found[v] > 1 << (OFTEN_BITS - 1):
            break
        least, kept = v, kept + found[v]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, low, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                low, n = np.frombuffer(low, np.uint32), np.frombuffer(n, np.uint16)
                own, levels = np.zeros(1 << (bits - shard_bits), bool), np.zeros(1 << (OFTEN_BITS - shard_bits), np.uint8)
                own[low >> np.uint32(32 - bits + shard_bits)] = True
                low, n = low[n >= least], n[n >= least]
                np.maximum.at(levels, low >> np.uint32(32 - OFTEN_BITS + shard_bits), (np.frexp(n.astype(np.float64))[1] - 1).astype(np.uint8))
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([np.packbits(own).tobytes()], pa.binary()), pa.array([levels.tobytes()], pa.binary())], names=["shard", "bits", "levels"])

    size, wide = 1 << (bits - shard_bits - 3), 1 << (OFTEN_BITS - shard_bits)
    common, often = bytearray(1 << (bits - 3)), bytearray(1 << OFTEN_BITS)
    for r in spread.mapInArrow(mapped, "shard int, bits binary, levels binary").toLocalIterator():  # the maps' size in all
        common[r["shard"] * size : (r["shard"] + 1) * size] = r["bits"]
        often[r["shard"] * wide : (r["shard"] + 1) * wide] = r["levels"]
    dropped(spread)
    return bytes(common), bytes(often)


def ordered(hashes, common, often):
    """Shingle hashes below their level: 0 for those in one text only, else 1 or the logarithm of their frequency."""
    import numpy as np

    bits, wide = (8 * len(common) - 1).bit_length(), (len(often) - 1).bit_length()
    slot = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    late = (common[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1
    level = np.zeros(len(hashes), np.uint64)
    level[late] = np.maximum(often[(hashes[late] >> np.uint64(64 - wide)).astype(np.int64)], 1)
    return (level << np.uint64(LEVEL)) | (hashes >> np.uint64(64 - LEVEL))


def prefix_length(n):
    return n - -(-3 * n // 4) + 1


def repeated_prefixes(df: DataFrame, ids: bytearray, maps: tuple[bytes, bytes]) -> DataFrame:
    """``token, doc_id``: the prefix shingles, rarest first, that other sets may hold too; ``doc_id`` is the set's hash.

    Of the documents whose bit is set in ``ids``. A row that another one's bit brings in is a copy, under the same hash.
    """
    import numpy as np

    shared = df.sparkSession.sparkContext.broadcast((bytes(ids), *maps))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_ids, common, often = shared.value
        common, often, single = np.frombuffer(common, np.uint8), np.frombuffer(often, np.uint8), np.uint64(1 << LEVEL)
        for _, hashes, bounds in chunks(_of_ids(batches, own_ids)):
            keys, tokens, owner = ordered(hashes, common, often), [], []
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                own = np.unique(keys[s:e])
                own = own[: prefix_length(len(own))] if s < e else own
                own = own[np.searchsorted(own, single) :]
                if len(own):
                    tokens.append(own)
                    owner.append(np.full(len(own), _node(np.unique(hashes[s:e])), np.int64))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(owner))], names=["token", "doc_id"])

    out = cut(texts_of(df).mapInArrow(run, "token long, doc_id long"))
    shared.destroy()  # the table has what it was for
    return out


def by_ids(df: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join on the columns of ``ids``, rows of 64-bit integers: broadcast if their size allows, else both sides
    are shuffled; the result is the same."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, ids.columns, how)


def _slot(ids):
    """The bit of each id in a bitmap of ``2 ** BITMAP_BITS`` bits."""
    import numpy as np

    return (_mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


def id_bitmap(ids: DataFrame) -> bytearray:
    """The bits of all ``doc_id``; of the same size for every corpus. Ids that are not there may share a bit."""
    import numpy as np

    page_bits = 17

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = np.unique(_slot(batch.column(0).to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array((slot >> page_bits).astype(np.int32)), pa.array((slot & ((1 << page_bits) - 1)).astype(np.int32))], names=["page", "slot"])

    def page(part: pa.Table) -> pa.Table:
        own = np.zeros(1 << page_bits, bool)
        own[part["slot"].to_numpy()] = True
        return pa.table({"page": pa.array([part["page"][0].as_py()], pa.int32()), "bits": pa.array([np.packbits(own).tobytes()], pa.binary())})

    size, out = 1 << (page_bits - 3), bytearray(1 << (BITMAP_BITS - 3))  # 16 MB
    pages = ids.select("doc_id").mapInArrow(slots, "page int, slot int").distinct().groupBy("page").applyInArrow(page, "page int, bits binary")
    for r in pages.toLocalIterator():  # the bitmap's size in all
        out[r["page"] * size : (r["page"] + 1) * size] = r["bits"]
    return out


def members_of(df: DataFrame, groups: DataFrame, repeated: bool) -> DataFrame:
    """``doc_id, n, cand, blocks, tokens``: the sets of ``groups(node, doc_id, n, cand, blocks)`` as packed 64-bit integers.

    ``doc_id`` is the set's hash. ``repeated``: rows of equal id and text may occur.
    """
    shared = df.sparkSession.sparkContext.broadcast(id_bitmap(groups))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, hashes, bounds in chunks(_of_ids(batches, shared.value)):
            rows = [(i, _node(own), own.tobytes()) for i, own in zip(ids, sets_of(hashes, bounds), strict=True) if len(own)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "node", "tokens"])

    few = groups.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    sets = texts_of(df).mapInArrow(run, "doc_id long, node long, tokens binary")
    sets = sets.join(F.broadcast(groups) if few else groups, ["node", "doc_id"])
    if repeated:
        sets = sets.dropDuplicates(["node"])
    out = cut(sets.select(F.col("node").alias("doc_id"), "n", "cand", "blocks", "tokens"))
    shared.destroy()  # the table has what it was for
    return out


def candidate_groups(prefixes: DataFrame, documents: int) -> DataFrame:
    """``doc_id, cand, blocks`` of the documents that share a token with another: components over shared tokens."""
    firsts = prefixes.groupBy("token").agg(F.min("doc_id").alias("b"), F.count("*").alias("held")).where("held > 1")
    edges = hot_join(prefixes, firsts, "token", "held", "doc_id", limit=max(1000, documents // SHARE))
    groups = components(edges.select(F.col("doc_id").alias("a"), "b"))
    groups = cut(groups.unionByName(groups.select(F.col("component").alias("node"), "component").distinct()))
    sized = groups.groupBy("component").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("blocks"), F.count("*").alias("held"))
    return hot_join(groups, sized, "component", "held", "node").select(F.col("node").alias("doc_id"), F.col("component").alias("cand"), "blocks")


class Trie:
    """Sets of small integers in a trie, unary paths as one node; the integers ascend from the most frequent."""

    def __init__(self, sets: list) -> None:
        self.sets = sets
        self.order = sorted(range(len(sets)), key=lambda k: tuple(sets[k]))
        self.root = self._node(0, len(sets), 0)

    def _node(self, lo: int, hi: int, depth: int):
        """(tokens of the path, depth after it, smallest and largest size below, sets that end here, children)."""
        import numpy as np

        first, last = self.sets[self.order[lo]], self.sets[self.order[hi - 1]]
        m = min(len(first), len(last))
        differ = np.flatnonzero(first[depth:m] != last[depth:m])
        to = depth + int(differ[0]) if len(differ) else m
        k, ends = lo, []
        while k < hi and len(self.sets[self.order[k]]) == to:
            ends.append(self.order[k])
            k += 1
        children = []
        while k < hi:
            j, token = k + 1, self.sets[self.order[k]][to]
            while j < hi and self.sets[self.order[j]][to] == token:
                j += 1
            children.append((k, j))
            k = j
        sizes = [len(self.sets[self.order[j]]) for j in range(lo, hi)]
        return first[depth:to], to, min(sizes), max(sizes), ends, [self._node(a, b, to) for a, b in children]

    def search(self, own, mask) -> list[int]:
        """The sets whose Jaccard similarity with ``own`` is at least 3/4; ``mask`` marks the integers of ``own``."""
        n, out, todo = len(own), [], [(self.root, 0)]
        while todo:
            (path, depth, low, high, ends, children), shared = todo.pop()
            shared += int(mask[path].sum())
            if 7 * (shared + min(n - shared, high - depth)) < 3 * (n + low):
                continue
            out += [k for k in ends if 7 * shared >= 3 * (n + depth)]
            todo += [(c, shared) for c in children]
        return out


def links_within(ids: list[int], sets: list, probes: range | None = None, labels: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that join parts not joined before: a spanning forest of the qualifying pairs.

    With ``probes``, only those positions are searched for, against all others; ``labels``: parts joined before.
    """
    import numpy as np

    values, n = np.unique(np.concatenate(sets), return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((values, -n))] = np.arange(len(values))  # most frequent first
    small = [np.sort(rank[np.searchsorted(values, s)]) for s in sets]
    trie, mask, out = Trie(small), np.zeros(len(values), bool), []
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    node = labels if labels is not None else list(range(len(ids)))
    for k in range(len(ids)) if probes is None else probes:
        mask[small[k]] = True
        for j in trie.search(small[k], mask):
            a, b = top(node[k]), top(node[j])
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((ids[k], ids[j]))
        mask[small[k]] = False
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: int):
    """Rows of equal first columns, as lists, from sorted rows."""
    held, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != held:
                if rows:
                    yield rows
                held, rows = row[:keys], []
            rows.append(row)
    if rows:
        yield rows


def block_links(members: DataFrame, deal: int) -> DataFrame:
    """One deal of each candidate group into blocks of about ``BLOCK``, joined within: ``a, b``."""
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 2):
            if len(rows) > 1:
                found = links_within([r[2] for r in rows], [np.frombuffer(r[3], np.uint64) for r in rows])
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    dealt = members.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(deal)), F.col("blocks"))).select("cand", "block", "doc_id", "tokens")
    n = parallelism(members.sparkSession)
    return dealt.repartition(n, "cand", "block").sortWithinPartitions("cand", "block", "doc_id").mapInArrow(run, "a long, b long")


def rest_links(prefixes: DataFrame, members: DataFrame, labels: DataFrame, documents: int) -> DataFrame:
    """Links that the deals did not see: ``a, b``.

    Two sets that qualify share a prefix token. So only tokens whose sets, in groups of several blocks, have different labels
    are left: their sets form new, smaller groups. In each, all outside the group's largest label are compared with the
    whole group, in cells of sets of about ``CELL`` by ``CELL`` shingles (4 MB): a set goes to each cell of its row or
    column, so that small cells would multiply what is shuffled.
    """
    import numpy as np

    own = cut(members.where("blocks > 1").select("doc_id", "n").join(labels, "doc_id", "left").select("doc_id", "n", F.coalesce("label", "doc_id").alias("label")))
    placed = prefixes.join(own, "doc_id")
    mixed = placed.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("held")).where("x <> y").select("token", "held")
    left = cut(hot_join(prefixes, mixed, "token", "held", "doc_id", limit=max(1000, documents // SHARE)).join(own.select("doc_id"), "doc_id", "left_semi"))
    if left.isEmpty():
        dropped(own, left)
        return members.sparkSession.createDataFrame([], "a long, b long")
    groups = cut(candidate_groups(left, documents).select("doc_id", "cand").join(own, "doc_id"))
    labelled = groups.groupBy("cand", "label").agg(F.count("*").alias("size"), F.sum("n").alias("n"))
    per = labelled.groupBy("cand").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("n"), F.sum("size").alias("held"))
    count = lambda n: F.ceil(n / F.lit(CELL)).cast("int")
    per = per.where("n > most").select("cand", "main", "held", count(F.col("n")).alias("blocks"), count(F.col("n") - F.col("most")).alias("parts"))
    dealt = cut(hot_join(groups, per, "cand", "held", "doc_id").join(members.select("doc_id", "tokens"), "doc_id"))
    part, block = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"), F.pmod(F.xxhash64("doc_id", F.lit(-1)), F.col("blocks")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    probes = dealt.where("label <> main").select("cand", part.alias("part"), every("blocks").alias("block"), F.lit(True).alias("probe"), "doc_id", "label", "tokens")
    held = dealt.select("cand", every("parts").alias("part"), block.alias("block"), F.lit(False).alias("probe"), "doc_id", "label", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 3):
            first = next((k for k, r in enumerate(rows) if r[3]), len(rows))
            if 0 < first < len(rows):
                found = links_within([r[4] for r in rows], [np.frombuffer(r[6], np.uint64) for r in rows], range(first, len(rows)), [r[5] for r in rows])
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    n = parallelism(members.sparkSession)
    found = cut(held.unionByName(probes).repartition(n, "cand", "part", "block").sortWithinPartitions("cand", "part", "block", "probe", "doc_id").mapInArrow(run, "a long, b long"))
    dropped(own, left, groups, dealt)
    return found


def near_groups(df: DataFrame, rows: DataFrame) -> DataFrame:
    """``node, component`` of every document whose group has a smaller id; component = the group's smallest id.

    ``rows``: what ``named_sets`` gives for ``df``.
    """
    named = rows.where("doc_id is not null and node is not null")
    first = named.groupBy("node", "doc_id").agg(F.count("*").alias("rows"), F.max("n_shingles").alias("n"))
    first = cut(first.groupBy("node").agg(F.min(F.struct("doc_id", "rows", "n")).alias("x"), F.sum("rows").alias("held")).select("node", "x.*", "held"))
    seen = first.agg(F.sum("n"), F.max("rows")).first()
    # about a million shingles a shard, however few the partitions
    shard_bits = min(16, max(2 * parallelism(df.sparkSession) - 1, (seen[0] or 0) >> 20).bit_length())
    ids = id_bitmap(first)
    prefixes = repeated_prefixes(df, ids, frequencies(df, ids, shard_bits))
    documents = prefixes.select("doc_id").distinct().count()
    groups = cut(candidate_groups(prefixes, documents).withColumnRenamed("doc_id", "node").join(first.select("node", "doc_id", "n"), "node"))
    members = members_of(df, groups, (seen[1] or 0) > 1)
    links = cut(block_links(members, 0))
    if not groups.where("blocks > 1").isEmpty():
        for deal in range(1, DEALS):  # one after the other: the disk holds one deal's shuffle
            links = links.unionByName(cut(block_links(members.where("blocks > 1"), deal)))
    links = cut(links.distinct())
    labels = cut(components(links)).select(F.col("node").alias("doc_id"), F.col("component").alias("label"))
    more = rest_links(prefixes, members, labels, documents)
    if not more.isEmpty():
        labels = cut(components(links.unionByName(more))).select(F.col("node").alias("doc_id"), F.col("component").alias("label"))
    dropped(prefixes, groups, members)
    labels = labels.withColumnRenamed("doc_id", "node")
    labels = labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())  # a group's smallest node too
    per_node = first.select("node", "held").join(labels, "node", "left").where("held > 1 or label is not null")
    per_node = per_node.select("node", "held", F.coalesce("label", "node").alias("label"))
    named = cut(hot_join(named.select("doc_id", "node"), per_node, "node", "held", "doc_id").select("doc_id", "label"))
    least = named.groupBy("label").agg(F.min("doc_id").alias("b"), F.count("*").alias("held"))
    stars = cut(hot_join(named, least, "label", "held", "doc_id").select(F.col("doc_id").alias("node"), F.col("b").alias("component")).distinct())
    dropped(first, named)
    if stars.groupBy("node").count().where("count > 1").isEmpty():
        return stars.where("node <> component")
    return components(stars.select(F.col("node").alias("a"), F.col("component").alias("b")))  # an id of several rows joins groups


def join_groups(df: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row."""
    rows = cut(named_sets(df))
    groups = near_groups(df, rows).withColumnRenamed("node", "doc_id")
    return rows.select("doc_id", "n_shingles").join(groups, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(df: DataFrame) -> DataFrame:
    """The rows of ``df``, all columns, without those whose group has a smaller id; of rows of equal id one stays."""
    rows = cut(named_sets(df))
    kept = by_ids(df, near_groups(df, rows).select(F.col("node").alias("doc_id")), "left_anti")
    repeated = cut(rows.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"))
    dropped(rows)
    if repeated.isEmpty():
        return kept
    return by_ids(kept, repeated, "left_anti").unionByName(by_ids(kept, repeated, "left_semi").dropDuplicates(["doc_id"]))
