"""N-gram Jaccard join by prefix trees.

A text's set has the distinct hashes (64 bits) of its 5-word shingles, of its whole sequence if that is shorter. Texts of equal sets are one
class (told by 64 bits over the set, so that among n classes a false one has odds of about n * n / 2 ** 65); classes link where their
Jaccard similarity reaches the threshold.

1. Global order. Shingles go from the rare to the frequent, by a sketch of their counts over all texts (SKETCH_BITS bits of
   hash, fixed size; ties by hash). Any order gives the same links; this one puts shared passages last.
2. Runs. Two linked sets share one of their first n - ceil(t n) + 1 shingles. A run has the classes with one shingle among these. A shingle
   that the sketch says to be in very many texts is dealt over slices, of which each has the same few guests.
3. Blocks. Each class goes to the block of the head (the run's least member by hash) with which it shares most runs, if these are half as
   many as linked sets must share; blocks over
   CHUNK shingles are cut into chunks, each with the head. A chunk's sets become a prefix tree from the most frequent shingle on. A member
   walks it level by level: the overlap of a shared prefix is counted once for all sets below, and subtrees go where overlap and remaining
   length can't reach the threshold. Members of the chunk's largest component need not walk: all others have met them. What
   comes out is a spanning forest of the links, never a row for each pair.
4. The rest. Pairs of one run that no block has compared and whose components differ are made where the run's shingle can be the first that
   the two share (the shingles before it differ, and enough is left of both sets), so once a pair, and walk trees again: the first one the
   tree of all it is to meet. Each candidate pair has then been compared, or is in one component.

Handling: texts without words (null, empty) have an empty set, link with nothing and are their own component. Ids are integers; a null id
sorts last and comes out as null. Rows that repeat an id count once in a component's minimum, and each row is returned with what its own
text says. An empty table gives an empty result. A very long text is one set, and a chunk of its own if it is over CHUNK. Of other columns none is
read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs
from .components import components
from .storage import discard, materialize, parts_for, salted_join
from .words import MULTIPLIER, PRINTED, Block, blocks, grams, mix

SHINGLE = 5
THRESHOLD = 75
SKETCH_BITS, SKETCH_BLOCK = 22, 1 << 14
#: Bits of a posting that hold its place in the set; the others tell the shingle before it.
PLACE = np.uint64(0xFF)
#: Texts of a shingle by the sketch, over the noise, from which its run is sliced; guests of each slice.
HOT, GUESTS = 1 << 15, 32
#: Shingles of a chunk's sets: 8 MB.
CHUNK = 1 << 20
#: Of the table that tells which texts are wanted: 4 MB.
TABLE_BITS = 1 << 25
#: Pairs that a task holds before it sends them.
HELD = 500_000


def sets_of(b: Block, h: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Each row's set, sorted by hash."""
    g = grams(h, k)
    for i in range(b.n):
        lo, hi = int(b.bounds[i]), int(b.bounds[i + 1])
        if hi - lo >= k:
            yield np.unique(g[lo : hi - k + 1])
        elif hi > lo:
            yield mix(grams(h[lo:hi], hi - lo) + np.uint64(hi - lo))
        else:
            yield np.zeros(0, np.uint64)


def signature(s: np.ndarray) -> int:
    """64 bits that tell a set from others, as a signed number."""
    return int(mix(np.array([np.add.reduce(mix(s)) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def need(n: np.ndarray | int, m: np.ndarray | int, percent: int):
    """Least overlap of linked sets of n and m: 100 * o >= percent * (n + m - o)."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def ordered(s: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """A set by the global order, the rarest first."""
    level = levels[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    return s[np.argsort(level, kind="stable")] if level.any() else s


def _classes(k: int):
    """Rows (id, tid, n, sig) of the texts and (block, counts) of the sketch."""
    names = ["id", "tid", "n", "sig", "block", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            for b in blocks(batch.column(1), PRINTED, lower=True):
                found = list(sets_of(b, b.hashes(), k))
                np.add.at(counts, (np.concatenate(found) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), np.uint32(1))
                none = pa.nulls(b.n)
                own = [batch.column(c).slice(b.first, b.n) for c in (0, 2)]
                yield pa.RecordBatch.from_arrays([*own, pa.array([len(s) for s in found], pa.int32()), pa.array([signature(s) for s in found], pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())], names)
        if counts.any():
            cells = counts.reshape(-1, SKETCH_BLOCK)
            most = [next(t for t in (np.uint8, np.uint16, np.uint32, np.int64) if c.max() <= np.iinfo(t).max) for c in cells]
            packed = [bytes([np.dtype(t).itemsize]) + zlib.compress(c.astype(t).tobytes(), 1) for c, t in zip(cells, most)]
            none = pa.nulls(len(cells))
            yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.int64()), pa.array(range(len(cells)), pa.int32()), pa.array(packed, pa.binary())], names)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the sketch's blocks, of which a task has all cells."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, x in zip(batch.column(0).to_pylist(), batch.column(1)):
            x = x.as_buffer().to_pybytes()
            cells = np.frombuffer(zlib.decompress(x[1:]), {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[x[0]])
            total[block] = total.get(block, 0) + cells.astype(np.int64)
    if total:
        packed = [zlib.compress(np.minimum(x, 0xFFFFFFFF).astype(np.uint32).tobytes(), 1) for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(packed, pa.binary())], ["block", "counts"])


def levels_of(sketch: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Level of each cell of the sketch, by how many deviations its count lies over the mean: four levels a deviation up to eight, then
    four a power of 2. A shingle of few texts has level 0 as a rule; one that a passage brings to m texts rises as soon as m
    exceeds the noise of a cell. 4 MB, whatever the corpus. And in how many slices the runs of each level are dealt."""
    packed = {r.block: bytes(r.counts) for r in sketch.repartition("block").mapInArrow(_added, "block int, counts binary").collect()}
    cells = lambda x: np.frombuffer(zlib.decompress(x), np.uint32)  # noqa: E731  one block at a time, so that the driver holds little
    mean = sum(int(cells(x).sum(dtype=np.int64)) for x in packed.values()) / (1 << SKETCH_BITS)
    levels, deviation = np.zeros(1 << SKETCH_BITS, np.uint8), np.sqrt(max(mean, 1))
    for i, x in packed.items():
        over = np.maximum(cells(x) - mean, 0) / deviation
        levels[i * SKETCH_BLOCK : (i + 1) * SKETCH_BLOCK] = np.minimum(np.where(over < 8, 4 * over, 32 + 4 * np.log2(np.maximum(over, 8) / 8)), 255)
    at = np.arange(256)
    texts = np.where(at < 32, 0, 8 * 2.0 ** ((at - 32) / 4)) * deviation
    return levels, np.clip(np.ceil(texts / HOT), 1, 1 << 14).astype(np.int64)


def alone(sig: np.ndarray) -> np.ndarray:
    """What stands for a shingle before, where a class has none: another number for each class."""
    return mix(sig.view(np.uint64) + np.uint64(MULTIPLIER)) & ~PLACE


def placed(own: np.ndarray, sig: int, n: int) -> np.ndarray:
    """For each of a set's first shingles 56 bits that tell the shingle before it, and its place in 256ths of n, rounded down."""
    before = np.concatenate((alone(np.array([sig], np.int64)), mix(own[:-1]) & ~PLACE))
    return before | (np.arange(len(own)) * 256 // n).astype(np.uint64)


def meets(n, p, m, q, percent: int):
    """Whether classes of n and m shingles, with `placed` p and q, can have a run's shingle as the first that they share."""
    fits = (p ^ q) & ~PLACE != 0
    if percent:
        left_n, left_m = n - ((p & PLACE).astype(np.int64) * n >> 8), m - ((q & PLACE).astype(np.int64) * m >> 8)
        fits &= np.minimum(left_n, left_m) >= need(n, m, percent)
    return fits


def rank(sig: np.ndarray) -> np.ndarray:
    """The order of classes in a run: by hash."""
    return mix(sig.view(np.uint64) + np.uint64(MULTIPLIER))


def sliced(key: np.ndarray, sig: np.ndarray, slices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which record, its slice) for records of sliced runs: one for each, and of a run's guests one for each slice."""
    own = (rank(sig) % slices.astype(np.uint64)).astype(np.int64)
    guest = np.flatnonzero(rank(sig) < np.uint64((1 << 64) - 1) // (slices * (HOT // GUESTS)).astype(np.uint64))
    again = np.repeat(guest, slices[guest])
    every = np.concatenate([np.arange(n) for n in slices[guest]]) if len(guest) else np.zeros(0, np.int64)
    other = every != own[again]
    return np.concatenate((np.arange(len(sig)), again[other])), np.concatenate((own, every[other]))


def _postings(k: int, percent: int, levels, parts: int):
    """Each class's prefix shingles, once a task. A record's kind has the slice and how many slices its run has."""

    def send(found: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        if not found:
            return
        key, sig, size, prev = (np.concatenate(x) for x in zip(*found))
        slices = levels.value[1][levels.value[0][(key >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]]
        hot = slices > 1
        # within a part, the low half of the shingle's hash; what meets wrongly is compared, and found not to link
        low = lambda x: (x & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        order = np.flatnonzero(~hot)
        order = order[np.argsort(key[order], kind="stable")]
        yield from blobs.rows(blobs.part_of_key(key[order], parts), 1, low=low(key[order]), id=sig[order], pos=size[order], key=prev[order])
        if hot.any():
            which, own = sliced(key[hot], sig[hot], slices[hot])
            at, n = np.flatnonzero(hot)[which], slices[hot][which]
            for s, m in np.unique(np.stack((own, n), 1), axis=0).tolist():
                x = at[(own == s) & (n == m)]
                yield from blobs.rows((blobs.part_of_key(key[x], parts) + s) % parts, s << 15 | m, low=low(key[x]), id=sig[x], pos=size[x], key=prev[x])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held, seen, table = [], 0, set(), levels.value[0]
        for batch in batches:
            for b in blocks(batch.column(1), PRINTED, lower=True):
                for s in sets_of(b, b.hashes(), k):
                    sig = signature(s) if len(s) else None
                    if sig is None or sig in seen:
                        continue
                    seen.add(sig)
                    own = ordered(s, table)[: prefix_length(len(s), percent)].copy()
                    found.append((own, np.full(len(own), sig, np.int64), np.full(len(own), len(s), np.int32), placed(own, sig, len(s))))
                    held += len(own)
                if held > HELD:
                    yield from send(found)
                    found, held = [], 0
        yield from send(found)

    return run


RUNS = "kind int, a long, b long, n_a int, n_b int, part int, low long, slice int, slices int, prev long"
_RUNS = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("n_a", pa.int32()), ("n_b", pa.int32()), ("part", pa.int32()), ("low", pa.int64()), ("slice", pa.int32()), ("slices", pa.int32()), ("prev", pa.int64())])


def _batch(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(columns[f.name]).astype(f.type.to_pandas_dtype())) if f.name in columns else pa.nulls(n, f.type) for f in _RUNS], schema=_RUNS)


def _pairs_batch(a, b, n_a, n_b, weight) -> pa.RecordBatch:
    return _batch(len(a), kind=np.zeros(len(a)), a=a, b=b, n_a=n_a, n_b=n_b, low=weight)


def summed(a, b, n_a, n_b) -> tuple[np.ndarray, ...]:
    """Distinct pairs and how often each is there."""
    order = np.lexsort((b, a))
    starts, n = blobs.runs(a[order], b[order])
    at = order[starts]
    return a[at], b[at], n_a[at], n_b[at], n


def close(n, m, percent: int):
    return 100 * np.minimum(n, m).astype(np.int64) >= percent * np.maximum(n, m).astype(np.int64)


def once(low, sig, size, prev) -> tuple[np.ndarray, ...]:
    """Each class once in a run, of rows in order of run and class. Where half a hash brings two of its shingles into one run, the
    earlier place counts, and no shingle before."""
    starts, n = blobs.runs(low, sig)
    if len(starts) < len(low):
        least, most = np.minimum.reduceat(prev, starts), np.maximum.reduceat(prev, starts)
        place = np.minimum.reduceat(prev & PLACE, starts)
        prev = np.where(least == most, least, alone(sig[starts]) | place)
    return low[starts], sig[starts], size[starts], prev


def _runs(percent: int, parts: int):
    """Kind 1: members (a, n_a) of runs in which pairs can meet first; kind 0: pairs (head, member), how many runs of the task have them in `low`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list] = {}
        for batch in batches:
            for part, kind, *cells in zip(*(batch.column(c) for c in ("part", "kind", "low", "id", "pos", "key"))):
                found.setdefault((part.as_py(), kind.as_py()), []).append([np.frombuffer(x.as_buffer(), t) for x, t in zip(cells, (np.uint32, np.int64, np.int32, np.uint64))])
        pairs, held = [], 0
        for (part, kind), cells in found.items():
            low, sig, size, prev = (np.concatenate(x) for x in zip(*cells))
            cells.clear()
            order = np.lexsort((rank(sig), low))
            low, sig, size, prev = once(low[order], sig[order], size[order], prev[order])
            starts, n = blobs.runs(low)
            first = np.repeat(starts, n)
            own = (np.arange(len(low)) != first) & close(size[first], size, percent)
            pairs.append((sig[first][own], sig[own], size[first][own], size[own]))
            held += int(own.sum())
            # a run of two is one pair; one whose members have the same shingle before has no pair that meets here first
            two = starts[n == 2]
            good = close(size[two], size[two + 1], percent) & meets(size[two].astype(np.int64), prev[two], size[two + 1].astype(np.int64), prev[two + 1], percent)
            before = prev & ~PLACE
            same = np.minimum.reduceat(before, starts) == np.maximum.reduceat(before, starts) if len(starts) else np.zeros(0, bool)
            keep = (n > 2) & ~same
            keep[np.flatnonzero(n == 2)[good]] = True
            m = kind & 0x7FFF
            keep |= m > 1  # members of other slices are not known here
            at = np.flatnonzero(np.repeat(keep, n))
            for i in range(0, len(at), 100_000):
                x = at[i : i + 100_000]
                yield _batch(len(x), kind=np.ones(len(x)), a=sig[x], n_a=size[x], part=np.full(len(x), (part - (kind >> 15)) % parts), low=low[x], slice=np.full(len(x), kind >> 15), slices=np.full(len(x), m), prev=prev[x].view(np.int64))
            if held > HELD:
                yield _pairs_batch(*summed(*(np.concatenate(x) for x in zip(*pairs))))
                pairs, held = [], 0
        if pairs:
            yield _pairs_batch(*summed(*(np.concatenate(x) for x in zip(*pairs))))

    return run


def _meetings(percent: int):
    """From members (a, n_a, prev, home, label, head, chunk) of whole runs (part, low, slice): pairs that can meet here first, are of two
    components and were not in one block. Of pairs in a slice, one at least is at home there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        t = pa.Table.from_batches(got)
        del got
        part, low, piece, sig, size, prev, home, label, head, chunk = (t.column(c).to_numpy() for c in ("part", "low", "slice", "a", "n_a", "prev", "home", "label", "head", "chunk"))
        del t
        order = np.lexsort((sig, low, piece, part))
        part, low, piece, sig, prev, home, label, head, chunk = (x[order] for x in (part, low, piece, sig, prev, home, label, head, chunk))
        prev, size = prev.view(np.uint64), size[order].astype(np.int64)
        starts, n = blobs.runs(part, piece, low)
        mixed = np.minimum.reduceat(label, starts) != np.maximum.reduceat(label, starts)
        starts, n = starts[mixed], n[mixed]

        def good(i, j):
            """Which of the members i meet j (arrays that go together)."""
            apart = (label[i] != label[j]) & (sig[i] != sig[j]) & (home[i] | home[j]) & ((head[i] != head[j]) | (chunk[i] != chunk[j])) & (head[i] != sig[j]) & (head[j] != sig[i])
            return apart & close(size[i], size[j], percent) & meets(size[i], prev[i], size[j], prev[j], percent)

        pairs, held = [], 0

        def gathered(i, j):
            a, b = np.where(sig[i] < sig[j], i, j), np.where(sig[i] < sig[j], j, i)
            pairs.append((sig[a], sig[b], size[a], size[b]))
            return len(a)

        two = starts[n == 2]
        x = two[good(two, two + 1)]
        held += gathered(x, x + 1)
        for s, m in zip(starts[n > 2].tolist(), n[n > 2].tolist()):
            wide = max(1, 1_000_000 // m)
            for c in range(0, m - 1, wide):
                i, j = np.triu_indices(min(wide, m - c), 1, m - c)  # rows from c on, each with all later ones
                i, j = s + c + i, s + c + j
                x = good(i, j)
                held += gathered(i[x], j[x])
                if held > HELD:
                    yield _pairs_batch(*summed(*(np.concatenate(x) for x in zip(*pairs))))
                    pairs.clear()
                    held = 0
        if held:
            yield _pairs_batch(*summed(*(np.concatenate(x) for x in zip(*pairs))))

    return run


def _some(bits):
    """Of the texts (id, text, tid), those whose hash the fixed bit table has: all that are wanted, and a few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy() & (TABLE_BITS - 1)
            yield batch.filter(pa.array((bits.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))

    return run


def _bits_of(tids: DataFrame) -> np.ndarray:
    """The bit table of hashes: 4 MB, whatever their number."""
    at = F.col("tid").bitwiseAND(F.lit(TABLE_BITS - 1)) + 1
    rows = tids.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    table = np.zeros(TABLE_BITS // 8, np.uint8)
    for r in rows:
        own = np.frombuffer(bytes(r["bits"]), np.uint8)
        table[(r["n"] - 1) * len(own) : r["n"] * len(own)] = own
    return table


def _sets(k: int, levels):
    """(sig, path, to): a set from its most frequent shingle to its rarest, in bytes that sort like the numbers, and the chunks it goes to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = levels.value[0], set()
        for batch in batches:
            for b in blocks(batch.column(1), PRINTED, lower=True):
                sigs, found, at = batch.column(0).slice(b.first, b.n).to_pylist(), [], []
                for i, (sig, s) in enumerate(zip(sigs, sets_of(b, b.hashes(), k))):
                    # the signature tells the text of the class from another that has its id; a repeated row is sent once
                    if len(s) and sig not in seen and signature(s) == sig:
                        seen.add(sig)
                        found.append((sig, ordered(s, table)[::-1].astype(">u8").tobytes()))
                        at.append(b.first + i)
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary()), batch.column(2).take(pa.array(at, pa.int64()))], ["sig", "path", "to"])

    return run


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers of [lo, hi) in turn, where each range begins among them)"""
    n = hi - lo
    begin = np.cumsum(n) - n
    return np.arange(int(n.sum())) + np.repeat(lo - begin, n), begin


class Trie:
    """A prefix tree of sets in path order. A node holds the shingles in which its sets go on together; below a node are those that part there."""

    def __init__(self, paths: list[np.ndarray]):
        parent, lo, hi, depth, leaf, flat, total = [-1], [0], [0], [0], [], [], 0
        stack, before = [0], paths[0][:0]
        for p in paths:
            both = min(len(p), len(before))
            other = np.flatnonzero(p[:both] != before[:both])
            shared = int(other[0]) if len(other) else both
            last = None
            while depth[stack[-1]] > shared:
                last = stack.pop()
            if depth[stack[-1]] < shared:  # the last one's shingles are cut where this set parts from it
                cut = shared - depth[stack[-1]]
                parent.append(stack[-1])
                lo.append(lo[last])
                hi.append(lo[last] + cut)
                depth.append(shared)
                parent[last], lo[last] = len(parent) - 1, lo[last] + cut
                stack.append(len(parent) - 1)
            if len(p) > shared:
                parent.append(stack[-1])
                flat.append(p[shared:])
                lo.append(total)
                total += len(p) - shared
                hi.append(total)
                depth.append(len(p))
                stack.append(len(parent) - 1)
            leaf.append(stack[-1])
            before = p
        self.lo, self.hi, self.depth, self.leaf = (np.array(x, np.int64) for x in (lo, hi, depth, leaf))
        up = np.array(parent, np.int64)
        self.words, self.at = np.unique(np.concatenate(flat), return_inverse=True)
        self.least, self.most = np.full(len(up), 1 << 60, np.int64), np.zeros(len(up), np.int64)
        self.least[self.leaf] = self.most[self.leaf] = self.depth[self.leaf]
        for x in np.argsort(-self.depth, kind="stable").tolist():  # the deepest first: a parent after all its children
            if up[x] >= 0:
                self.least[up[x]] = min(self.least[up[x]], self.least[x])
                self.most[up[x]] = max(self.most[up[x]], self.most[x])
        self.child = np.argsort(up, kind="stable")[1:]  # without the root, which is its own first
        bounds = np.searchsorted(up[self.child], np.arange(len(up) + 1))
        self.first, self.last = bounds[:-1], bounds[1:]
        self.mark = np.zeros(len(self.words), bool)

    def linked(self, p: np.ndarray, percent: int) -> np.ndarray:
        """Which of the sets link with p, as a mask over them."""
        at = np.minimum(np.searchsorted(self.words, p), len(self.words) - 1)
        at = at[self.words[at] == p]
        self.mark[at] = True
        n, overlap, met = len(p), np.zeros(len(self.lo), np.int64), np.zeros(len(self.lo), bool)
        above, level = np.zeros(self.last[0] - self.first[0], np.int64), self.child[self.first[0] : self.last[0]]
        while len(level):
            here, begin = _ranges(self.lo[level], self.hi[level])
            now = overlap[above] + np.add.reduceat(self.mark[self.at[here]].astype(np.int64), begin)
            overlap[level] = now
            # the length below at which most can be shared
            size = np.clip(n - now + self.depth[level], self.least[level], self.most[level])
            alive = now + np.minimum(size - self.depth[level], n - now) >= need(n, size, percent)
            met[level] = now >= need(n, self.depth[level], percent)
            some = level[alive]
            children, _ = _ranges(self.first[some], self.last[some])
            above, level = np.repeat(some, self.last[some] - self.first[some]), self.child[children]
        self.mark[at] = False
        return met[self.leaf]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[np.ndarray]]]:
    """(head, members, paths) of each group of rows (head, chunk, sig, path) that come in order of group and path, each member once."""
    now, sigs, paths = None, [], []
    for batch in batches:
        for head, chunk, sig, path in zip(*(batch.column(c) for c in ("head", "chunk", "sig", "path"))):
            key, own = (head.as_py(), chunk.as_py()), sig.as_py()
            if key != now:
                if now is not None:
                    yield now[0], sigs, paths
                now, sigs, paths = key, [], []
            if not sigs or sigs[-1] != own:
                sigs.append(own)
                paths.append(np.frombuffer(path.as_buffer(), ">u8").astype(np.uint64))
    if now is not None:
        yield now[0], sigs, paths


def forest(paths: list[np.ndarray], first: int, percent: int) -> list[tuple[int, int]]:
    """Links that join the sets' components: the first set walks the tree, then each one outside of the largest component."""
    tree, label, walked, links = Trie(paths), np.arange(len(paths)), np.zeros(len(paths), bool), []
    at = first
    while at is not None:
        walked[at] = True
        met = tree.linked(paths[at], percent)
        others, one = np.unique(np.where(met, label, label[at]), return_index=True)
        links += [(at, int(i)) for x, i in zip(others.tolist(), one.tolist()) if x != label[at]]
        label[np.isin(label, others)] = label[at]
        rest = np.flatnonzero(~walked & (label != np.bincount(label).argmax()))
        at = int(rest[0]) if len(rest) else None
    return links


def _walk(percent: int, full: bool):
    """Links (a, b) within each group; full: of all its members, as a forest; else of the head with members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links: list[tuple[int, int]] = []
        for head, sigs, paths in _groups(batches):
            if head not in sigs or len(sigs) < 2:
                continue
            own = sigs.index(head)
            if full:
                links += [(sigs[a], sigs[b]) for a, b in forest(paths, own, percent)]
            else:
                met = Trie(paths).linked(paths[own], percent)
                links += [(head, sigs[i]) for i in np.flatnonzero(met).tolist() if i != own]
            if len(links) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], ["a", "b"])
                links = []
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], ["a", "b"])

    return run


def _chunked(groups: DataFrame) -> DataFrame:
    """(head, b, chunk, chunks) of groups (head, b, n_b): so many chunks that one has about CHUNK shingles."""
    size = groups.groupBy("head").agg(F.ceil(F.sum(F.col("n_b").cast("long")) / F.lit(CHUNK)).cast("int").alias("chunks"))
    return salted_join(groups, size, "head", "b").select("head", "b", "chunks", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("chunk"))


def _links(groups: DataFrame, texts: DataFrame, first_of: DataFrame, k: int, percent: int, levels, full: bool, name: str) -> DataFrame:
    """Stored links in the chunks of groups (head, b, chunk, chunks), by trees of their sets. Of the texts only those of the groups' classes are
    shuffled; a set is made from its text in the task that sends it to its chunks, the head's to all of them."""
    heads = groups.groupBy("head").agg(F.max("chunks").alias("chunks")).select(F.col("head").alias("sig"), "head", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    places = groups.select(F.col("b").alias("sig"), "head", "chunk").unionByName(heads)
    chosen = materialize(first_of.join(places.groupBy("sig").agg(F.collect_list(F.struct("head", "chunk")).alias("to")), "sig"), "chosen")
    bits = groups.sparkSession.sparkContext.broadcast(_bits_of(chosen))
    # merged in any case, so that no task runs two Python steps at once
    few = texts.mapInArrow(_some(bits), "id long, text string, tid long").join(chosen.hint("merge"), ["id", "tid"])
    sets = few.select("sig", "text", "to").mapInArrow(_sets(k, levels), "sig long, path binary, to array<struct<head:bigint,chunk:int>>")
    rows = sets.select("sig", "path", F.explode("to").alias("at")).select("at.head", "at.chunk", "sig", "path")
    links = materialize(rows.repartition("head", "chunk").sortWithinPartitions("head", "chunk", "path", "sig").mapInArrow(_walk(percent, full), "a long, b long"), name)
    discard(chosen)
    bits.destroy()
    return links


def _spread(members: DataFrame) -> DataFrame:
    """Members with `home`. In a sliced run, those that are not of its largest component go to every slice, to meet all that are there."""
    whole = members.withColumn("home", F.lit(True))
    hot = members.where("slices > 1").dropDuplicates(["part", "low", "a"])
    largest = hot.groupBy("part", "low", "label").count().groupBy("part", "low").agg(F.max_by("label", F.struct("count", "label")).alias("largest"))
    own = hot.join(largest, ["part", "low"]).withColumn("at", F.when(F.col("label") == F.col("largest"), F.array("slice")).otherwise(F.sequence(F.lit(0), F.col("slices") - 1)))
    every = own.withColumn("to", F.explode("at")).withColumn("home", F.col("to") == F.col("slice")).withColumn("slice", F.col("to"))
    return whole.where("slices = 1").unionByName(every.select(whole.columns))


def _classified(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): (id, tid, n, sig) of every row, tid a hash of the text; (sig, class_id, tid, component_id, head_tid) of every class: the
    first row of the class, and that of its component."""
    spark = docs.sparkSession
    texts = blobs.texts_of(docs, id_col, text_col).withColumn("tid", F.xxhash64("text"))
    parts = parts_for(docs)
    made = materialize(texts.mapInArrow(_classes(k), "id long, tid long, n int, sig long, block int, counts binary"), "classes")
    rows = made.where("block IS NULL").select("id", "tid", "n", "sig")
    levels = spark.sparkContext.broadcast(levels_of(made.where("block IS NOT NULL").select("block", "counts")))
    first_of = rows.where("n > 0").groupBy("sig").agg(F.min(F.struct("id", "tid")).alias("first")).select("sig", "first.id", "first.tid")
    sent = texts.mapInArrow(_postings(k, percent, levels, parts), blobs.SCHEMA)
    runs = materialize(blobs.dealt(sent, parts).mapInArrow(_runs(percent, parts), RUNS), "runs")
    votes = runs.where("kind = 0").groupBy("a", "b").agg(F.sum("low").alias("shared"), F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"))
    # of the prefix that ends first no more are unshared than of the whole set, so linked sets share many runs; one or two are chance. The head
    # may not be the head in all of them, hence half; a class that goes to no block meets others below
    least = F.expr(f"ceil({percent} * (n_a + n_b) / {100.0 + percent}) + 1 - ceil(greatest(n_a, n_b) * {percent} / 100.0)")
    heads = votes.where(2 * F.col("shared") >= least).groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("head"), F.max("n_b").alias("n_b"))
    groups = materialize(_chunked(heads), "blocks")
    members = runs.where("kind = 1").select("a", "n_a", "part", "low", "slice", "slices", "prev")
    links = _links(groups, texts, first_of, k, percent, levels, True, "links")
    labels = components(links, "a", "b")
    told = groups.select(F.col("b").alias("a"), "head", "chunk").join(labels.select(F.col("node").alias("a"), "component"), "a", "full")
    now = members.join(told, "a", "left").withColumn("label", F.coalesce("component", "a")).withColumn("head", F.coalesce("head", "a")).withColumn("chunk", F.coalesce("chunk", F.lit(0))).drop("component")
    met = _spread(now).repartition(parts, "part", "low", "slice").mapInArrow(_meetings(percent), RUNS)
    pairs = materialize(met.groupBy("a", "b").agg(F.max("n_b").alias("n_b")).withColumnRenamed("a", "head"), "pairs")
    if not pairs.isEmpty():
        more = _links(materialize(_chunked(pairs), "rest"), texts, first_of, k, percent, levels, False, "more")
        if not more.isEmpty():
            # what the blocks have joined stands: only its labels and the new links are joined
            labels = components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more), "a", "b")
    levels.destroy()
    discard(runs, groups, pairs, links)
    # most classes have no link and are told without a join by component
    named = first_of.join(labels.withColumnRenamed("node", "sig"), "sig").select("sig", "component", F.struct("id", "tid").alias("own"))
    least = named.groupBy("component").agg(F.min("own").alias("least"))
    linked = salted_join(named, least, "component", "sig").select("sig", "least")
    classes = first_of.join(linked, "sig", "left").select("sig", F.col("id").alias("class_id"), "tid", F.coalesce("least.id", "id").alias("component_id"), F.coalesce("least.tid", "tid").alias("head_tid"))
    return rows, classes


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = THRESHOLD) -> DataFrame:
    """One row a document: its id, n_shingles, component_id (the smallest id that links lead to) and class_id, the smallest id with an
    equal set."""
    rows, classes = _classified(docs, id_col, text_col, k, percent)
    found = rows.join(classes.select("sig", "class_id", "component_id"), "sig", "left")  # a class of very many rows is a skew that Spark splits
    hide = lambda c: F.nullif(c, F.lit(int(blobs.NO_ID)))
    return found.select(hide(F.col("id")).alias(id_col), F.col("n").cast("long").alias("n_shingles"), hide(F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))).alias("component_id"), hide(F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("id"))).alias("class_id"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = THRESHOLD) -> DataFrame:
    """The rows of docs without all but one of each group: the one with the smallest id, of equal ids that with the smallest hash of its text,
    and of rows that repeat both any one. Rows without words are in no group, and all stay."""
    rows, classes = _classified(docs, id_col, text_col, k, percent)
    first = classes.where("class_id = component_id AND tid = head_tid").select("class_id", "tid").distinct()
    stays = materialize(rows.where("n > 0").select("id", "tid").distinct().join(first.withColumnRenamed("class_id", "id"), ["id", "tid"], "left_semi"), "stays")
    own, tid = F.coalesce(F.col(id_col).cast("long"), F.lit(int(blobs.NO_ID))), F.xxhash64(text_col)
    empty = ~F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), own.alias("id"), tid.alias("tid"), empty.alias("empty"))
    kept = keyed.where("NOT empty").join(stays, ["id", "tid"]).dropDuplicates(["id", "tid"])
    return kept.select("row.*").unionAll(keyed.where("empty").select("row.*"))
