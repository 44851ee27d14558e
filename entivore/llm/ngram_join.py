"""Similarity join on word n-grams by prefix trees, reduced to its components.

A document's set holds its distinct n-word shingles as 64-bit hashes; equal sets are one
class. All shingles have one global order: by hash, but the TABLE_SIZE most frequent ones
last, by ascending frequency (which count as frequent decides about speed only).

1. Candidates. A set and a larger one that reach the threshold share a shingle among the
   first size - need(size, size) + 1 of the smaller and the first size - least overlap + 1 of
   the larger. Shingles that no two classes share so are dropped before ids move, and of
   shingles with the same members one is kept. Members of a cell (such a shingle) are
   compared by a sketch: the parity of the number of shingles in each of a few hundred
   buckets. The number of buckets of unlike parity never exceeds the number of shingles in
   which two sets differ, so no link is lost; nearly all that lie well below the threshold
   are told apart. A cell gives a spanning forest of its compatible members, never its pairs.
2. Links. Components of those forests are blocks, so every full set moves once, to its block.
   There the sets form one prefix tree in the global order, path-compressed; each query set
   goes down it, counts an overlap with a shared beginning once, and leaves a subtree as soon
   as the shingles that remain can't reach the overlap which its shortest set needs. Sets
   already linked aren't asked for again, and a block gives a spanning forest of its links.
3. A component of more than BLOCK shingles is cut into chunks, each joined with the member
   that shares most cells; then members outside the largest group so far are compared with
   all chunks. All pairs of different groups are covered: no link between different texts is
   lost, and n near copies give about n rows.

Skew: texts never leave their partition, but for candidates; classes and shingles are summed
before they are shuffled; cells of more than CELL members are dealt out by pairs of chunks.

Cases: null text counts as empty; documents without words have n_shingles 0 and are their
own component. A null doc_id joins like any other and is the component's id only if all are
null. Repeated rows are one class. An empty table gives an empty result. Very long texts are
read whole. Other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from entivore.llm.common import components, discard, small, stored, table, with_rows

N, PERCENT = 4, 85
TASK_TOP, TABLE_SIZE, BATCH_SHINGLES = 5_000, 100_000, 1_000_000
#: Members of a cell, rows of cells in a task, shingles of a block, shingles in a task.
CELL, CELL_ROWS, BLOCK, GROUP = 20_000, 60_000, 1_000_000, 1_000_000
#: Texts in work at a time.
SLICE = 256
#: Bits of the smallest and the largest sketch.
SKETCH = 64, 4096
#: Ids of up to so many candidates (about 20 MB) are broadcast; beyond, an ordinary join is used.
BROADCAST_ROWS = 1_000_000
#: Queries of a block before those of its largest group are left out.
FIRST_QUERIES = 3
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's n-word shingles; of all its words if they are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)
    n = min(n, len(h))
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out = out * _ODD[0] + h[i : len(h) - n + 1 + i]
    out ^= out >> np.uint64(29)
    out *= _ODD[1]
    out ^= out >> np.uint64(32)
    out += np.uint64(n)
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def least_overlap(size: int, percent: int) -> int:
    """With a set of any size that reaches the threshold."""
    return -(-percent * size // 100)


def need(size, other, percent: int):
    """The least i with 100 * i >= percent * (size + other - i)."""
    return -(-percent * (size + other) // (100 + percent))


def frequent(docs: DataFrame, n: int) -> np.ndarray:
    """The most frequent shingles of all documents, rarer ones first: at most TABLE_SIZE."""

    def top(batches):
        keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        held, size = [], 0

        def add():
            new, times = np.unique(np.concatenate(held), return_counts=True)
            new, times = new[times > 1], times[times > 1]
            every, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
            total = np.bincount(at, np.concatenate([counts, times]), len(every)).astype(np.int64)
            best = np.argsort(-total, kind="stable")[: 10 * TASK_TOP]
            return every[best], total[best]

        for text in _texts(batches, 0):
            held.append(shingles(text, n))
            size += len(held[-1])
            if size >= BATCH_SHINGLES:
                keys, counts = add()
                held, size = [], 0
        if held:
            keys, counts = add()
        yield pa.RecordBatch.from_arrays([pa.array(keys[:TASK_TOP].view(np.int64)), pa.array(counts[:TASK_TOP])], names=["shingle", "n"])

    rows = docs.select("text").mapInArrow(top, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "shingle").limit(TABLE_SIZE).collect()
    return np.array([r.shingle for r in reversed(rows)], np.int64).view(np.uint64)


def _texts(batches, column: int):
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield from batch.column(column).slice(at, SLICE).to_pylist()


class Order:
    """The global order of shingles: by hash, frequent ones last, as they stand in often."""

    def __init__(self, often: np.ndarray):
        self.place = np.argsort(often)
        self.keys = often[self.place]

    def late(self, s: np.ndarray) -> np.ndarray:
        """0 for shingles that aren't frequent, else 1 + their place among those that are."""
        if not len(self.keys):
            return np.zeros(len(s), np.int64)
        at = np.minimum(np.searchsorted(self.keys, s), len(self.keys) - 1)
        return np.where(self.keys[at] == s, self.place[at] + 1, 0)

    def first(self, s: np.ndarray, length: int) -> np.ndarray:
        """The first so many of s, which is sorted by hash."""
        late = self.late(s)
        own = s[late == 0]
        if len(own) >= length:
            return own[:length]
        rest = late > 0
        return np.concatenate([own, s[rest][np.argsort(late[rest])]])[:length]


def sketch(s: np.ndarray, percent: int) -> bytes:
    """The parity of the number of shingles per bucket; buckets: a power of two, at least three for each difference allowed."""
    differ = 2 * len(s) - 2 * need(len(s), len(s), percent)
    bits = min(SKETCH[1], max(SKETCH[0], 1 << (3 * differ - 1).bit_length() if differ else 0))
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1 == 1).tobytes()


def _sets(docs: DataFrame, n: int, percent: int, often, prefix: bool) -> DataFrame:
    """doc_id, the 128-bit key of the set (k1, k2), its size n, and all of it, or its first shingles and its sketch;
    as: how many of those matter where it is the smaller set."""
    kind = docs.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int64()), ("own", pa.int32()), ("sketch", pa.binary()), ("shingles", pa.list_(pa.int64()))])

    def run(batches):
        order = Order(often.value) if prefix else None
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                keys, sizes, own, sketches, lists = [], [], [], [], []
                for text in batch.column(1).to_pylist():
                    s = shingles(text, n)
                    keys.append(np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64))
                    sizes.append(len(s))
                    own.append(len(s) - need(len(s), len(s), percent) + 1)
                    sketches.append(sketch(s, percent) if prefix else b"")
                    if prefix and len(s):
                        s = order.first(s, len(s) - least_overlap(len(s), percent) + 1)
                    lists.append(s.view(np.int64))
                flat = np.concatenate([np.empty(0, np.int64), *lists])
                ends = np.cumsum([0, *map(len, lists)])
                k = np.array(keys, np.int64).reshape(len(keys), 2)
                columns = [batch.column(0), pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(sizes, pa.int64()), pa.array(own, pa.int32()), pa.array(sketches, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, k1 long, k2 long, n long, own int, sketch binary, shingles array<long>")


class Groups:
    """Union-find over 0 .. n - 1 that keeps the links that joined two groups."""

    def __init__(self, n: int):
        self.up, self.links = list(range(n)), []

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, x: int, y: int, keep: bool = True) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            if keep:
                self.links.append((x, y))

    def roots(self) -> np.ndarray:
        return np.array([self.find(x) for x in range(len(self.up))], np.int64)


class Sketches:
    """Compares sets by their sizes and sketches; of two sketches the longer is folded."""

    def __init__(self, sizes: np.ndarray, sketches: list[bytes], percent: int):
        self.sizes, self.percent = sizes, percent
        self.bytes = np.array([len(x) for x in sketches])
        self.folded: dict[int, np.ndarray] = {}
        self.row: dict[int, np.ndarray] = {}
        for c in sorted(set(self.bytes.tolist()), reverse=True):
            here = np.flatnonzero(self.bytes == c)
            data = np.frombuffer(b"".join(sketches[i] for i in here), np.uint64).reshape(len(here), c // 8)
            up = np.zeros((0, c // 8), np.uint64)
            rows = np.full(len(sizes), -1)
            if self.folded:
                c0 = min(self.folded)
                up, ids = self.folded[c0], np.flatnonzero(self.row[c0] >= 0)
                up = up[self.row[c0][ids]]
                while up.shape[1] > c // 8:
                    up = up[:, : up.shape[1] // 2] ^ up[:, up.shape[1] // 2 :]
                rows[ids] = np.arange(len(ids))
            rows[here] = len(up) + np.arange(len(here))
            self.folded[c], self.row[c] = np.concatenate([up, data]), rows

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether a[i] and b[i] may be linked."""
        na, nb = self.sizes[a], self.sizes[b]
        ok = 100 * np.minimum(na, nb) >= self.percent * np.maximum(na, nb)
        most = na + nb - 2 * need(na, nb, self.percent)
        at = np.flatnonzero(ok)
        c = np.minimum(self.bytes[a[at]], self.bytes[b[at]])
        for size in set(c.tolist()):
            i = at[c == size]
            data, row = self.folded[size], self.row[size]
            ok[i] = np.bitwise_count(data[row[a[i]]] ^ data[row[b[i]]]).sum(axis=1, dtype=np.int64) <= most[i]
        return ok


def forest(cells: np.ndarray, ids: np.ndarray, sketches: Sketches) -> list[tuple[int, int]]:
    """Links that join the compatible members of each cell: at most one less than there are ids. cells: sorted, one
    for each row; ids: 0 .. n - 1."""
    groups = Groups(len(sketches.sizes))
    cuts = np.concatenate([[0], np.flatnonzero(cells[1:] != cells[:-1]) + 1, [len(cells)]]) if len(cells) else np.zeros(1, np.int64)
    sizes = np.diff(cuts)
    few = np.repeat(sizes <= 8, sizes)
    for step in range(1, 8):
        i = np.flatnonzero(few[: max(len(cells) - step, 0)] & (cells[: max(len(cells) - step, 0)] == cells[step:]))
        for at in range(0, len(i), 50_000):
            a, b = ids[i[at : at + 50_000]], ids[i[at : at + 50_000] + step]
            ok = sketches.compatible(a, b)
            for x, y in zip(a[ok].tolist(), b[ok].tolist(), strict=True):
                groups.join(x, y)
    for k in np.flatnonzero(sizes > 8).tolist():
        left = ids[cuts[k] : cuts[k + 1]]
        if len({groups.find(x) for x in left.tolist()}) == 1:
            continue
        while len(left) > 1:
            queue, left = [int(left[0])], left[1:]
            while queue and len(left):
                q = queue.pop()
                ok = sketches.compatible(np.full(len(left), q), left)
                if ok.any():
                    near = left[ok].tolist()
                    for x in near:
                        groups.join(q, x)
                    queue += near
                    left = left[~ok]
    return groups.links


class PrefixTree:
    """Sets of ranks as the paths of a compressed tree.

    Node v is labelled with flat[start[v]:end[v]], which are the ranks depth - length .. depth of the sets below, and
    knows the sizes of the shortest and the longest of them."""

    def __init__(self, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        self.sizes = np.array([len(s) for s in sets], np.int64)
        offset = np.concatenate([[0], np.cumsum(self.sizes)])
        self.flat = np.concatenate([np.empty(0, np.int64), *sets])
        start, depth, parent, leaf = [0], [0], [-1], [-1] * len(sets)
        length = [0]
        path, before = [0], np.empty(0, np.int64)
        for i in order:
            s = sets[i]
            m = min(len(s), len(before))
            unlike = np.flatnonzero(s[:m] != before[:m])
            shared = int(unlike[0]) if len(unlike) else m
            last = -1
            while depth[path[-1]] > shared:
                last = path.pop()
            if depth[path[-1]] < shared:  # the last node left is cut in two
                new, cut = len(start), shared - depth[path[-1]]
                start.append(start[last])
                length.append(cut)
                depth.append(shared)
                parent.append(path[-1])
                start[last], length[last], parent[last] = start[last] + cut, length[last] - cut, new
                path.append(new)
            if len(s) > shared:
                start.append(int(offset[i]) + shared)
                length.append(len(s) - shared)
                depth.append(len(s))
                parent.append(path[-1])
                path.append(len(start) - 1)
            leaf[i], before = path[-1], s
        self.start, self.depth = np.array(start), np.array(depth)
        self.end = self.start + np.array(length)
        shortest, longest = [1 << 60] * len(start), [0] * len(start)
        for i, v in enumerate(leaf):
            shortest[v], longest[v] = min(shortest[v], len(sets[i])), max(longest[v], len(sets[i]))
        for v in np.argsort(-self.depth, kind="stable").tolist():
            if (u := parent[v]) >= 0:
                shortest[u], longest[u] = min(shortest[u], shortest[v]), max(longest[u], longest[v])
        self.shortest, self.longest = np.array(shortest), np.array(longest)
        self.parent = np.array(parent)
        self.below, self.first_below = _by(self.parent + 1, len(start) + 1)
        self.ending, self.first_ending = _by(np.array(leaf, np.int64), len(start))

    def walk(self, has: np.ndarray, percent: int) -> list[tuple[int, int]]:
        """(number, overlap) of the sets that reach the threshold with the set of all ranks r where has[r]; its size
        counts ranks that no set of the tree has as well, so has may be longer than the ranks."""
        size = int(has.sum())
        left = size - np.cumsum(has)
        common = np.concatenate([[0], np.cumsum(has[self.flat])])
        found = []
        nodes, shared, rest = np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, size)
        while len(nodes):
            ok = shared + np.minimum(rest, self.longest[nodes] - self.depth[nodes]) >= need(size, self.shortest[nodes], percent)
            nodes, shared = nodes[ok], shared[ok]
            here, at = _members(self.ending, self.first_ending, nodes)
            enough = shared[at] >= need(size, self.sizes[here], percent)
            found += zip(here[enough].tolist(), shared[at][enough].tolist(), strict=True)
            nodes, at = _members(self.below, self.first_below, nodes + 1)
            shared = shared[at] + common[self.end[nodes]] - common[self.start[nodes]]
            rest = left[self.flat[self.end[nodes] - 1]] if len(nodes) else nodes
        return found


def _by(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers ordered by their key, and where each key's begin."""
    return np.argsort(keys, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(keys, minlength=n))])


def _members(ordered: np.ndarray, first: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all keys, and for each the place of its key."""
    n = first[keys + 1] - first[keys]
    at = np.repeat(np.arange(len(keys)), n)
    return ordered[first[keys][at] + np.arange(len(at)) - (np.cumsum(n) - n)[at]], at


def block_links(sets: list[np.ndarray], order: Order, percent: int, groups: Groups | None = None, asks: np.ndarray | None = None, asked: np.ndarray | None = None, head: int = -1) -> Groups:
    """The groups of sets (shingles, sorted by hash) that links join. groups: those known before; asks, asked: which
    sets go down the tree, and which form it (all of them, unless given); head: a set whose group needn't ask."""
    m = len(sets)
    groups = groups or Groups(m)
    whole = asks is None or (asks.all() and asked.all())
    asks, asked = (np.ones(m, bool) if x is None else x for x in (asks, asked))
    if m < 2 or len(set(groups.roots().tolist())) == 1:
        return groups
    vocabulary, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(vocabulary), np.int64)
    rank[np.lexsort((vocabulary, order.late(vocabulary)))] = np.arange(len(vocabulary))
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    ranks = [np.sort(r) for r in np.split(rank[inverse], ends[:-1])]
    targets = np.flatnonzero(asked)
    tree = PrefixTree([ranks[i] for i in targets])
    # sets first that hold most of what the others hold: an original comes before its edited copies
    central = np.argsort(-np.add.reduceat(counts[inverse], ends - sizes), kind="stable")
    has = np.zeros(len(vocabulary), bool)
    for k, i in enumerate(central[asks[central]].tolist()):
        if k == FIRST_QUERIES and whole and head < 0:
            # from here on one group is enough to leave out: of sets in different groups, one asks
            head = int(np.bincount(groups.roots()).argmax())
        if head >= 0 and groups.find(i) == groups.find(head):
            continue
        has[ranks[i]] = True
        for t, _ in tree.walk(has, percent):
            groups.join(i, int(targets[t]))
        has[ranks[i]] = False
    return groups


def _parts(df: DataFrame, *sums) -> list:
    return [x or 0 for x in df.agg(*sums).first()]


def _candidates(cells: DataFrame, sketches: DataFrame, percent: int, cell_rows: int) -> DataFrame:
    """Edges (a, b) of forests of the compatible members of cells (cell, id, c: their number)."""
    chunks = F.ceil(F.col("c") / cell_rows).cast("int")
    rows = cells.join(sketches, "id").withColumn("own", F.pmod(F.xxhash64("id"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    n = _parts(cells, F.sum(F.ceil(F.col("c") / cell_rows)))[0]
    rows = rows.select("cell", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "id", "n", "sketch")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("cell", "x", "y"), F.lit(1 + n // CELL_ROWS)))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([("cell", "ascending"), ("x", "ascending"), ("y", "ascending"), ("id", "ascending")])
        cell, x, y, ids = (part.column(c).to_numpy() for c in ("cell", "x", "y", "id"))
        if not len(cell):
            return schema.empty_table()
        new = (cell[1:] != cell[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        every, first, at = np.unique(ids, return_index=True, return_inverse=True)
        compare = Sketches(part.column("n").to_numpy()[first], part.column("sketch").take(pa.array(first)).to_pylist(), percent)
        links = np.array(forest(np.concatenate([[0], np.cumsum(new)]), at, compare), np.int64).reshape(-1, 2)
        return pa.Table.from_arrays([pa.array(every[links[:, 0]]), pa.array(every[links[:, 1]])], schema=schema)

    return rows.groupBy("part").applyInArrow(run, "a long, b long")


def _links(members: DataFrame, sets: DataFrame, often, percent: int) -> DataFrame:
    """Edges (a, b) of forests of the links in each block. members: label, x, y (the block), id, known (its group so
    far), asks, asked, head (see block_links), n and the key of the set (w_low, w1, w2); sets: doc_id, k1, k2, shingles."""
    n = _parts(members, F.sum("n"))[0]
    here = (F.col("k1") == F.col("w1")) & (F.col("k2") == F.col("w2")) & F.col("doc_id").eqNullSafe(F.col("w_low"))
    rows = sets.select("doc_id", "k1", "k2", "shingles").join(small(members.drop("n"), BROADCAST_ROWS), here)
    rows = rows.select("label", "x", "y", "id", "known", "asks", "asked", "head", "shingles", F.pmod(F.xxhash64("label", "x", "y"), F.lit(1 + n // GROUP)).alias("part"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(part: pa.Table) -> pa.Table:
        order = Order(often.value)
        part = part.sort_by([("label", "ascending"), ("x", "ascending"), ("y", "ascending"), ("id", "ascending")])
        label, x, y, ids, known, asks, asked, heads = (part.column(c).to_numpy() for c in ("label", "x", "y", "id", "known", "asks", "asked", "head"))
        lists = part.column("shingles").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        flat, offsets = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
        new = (label[1:] != label[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(label)] if len(label) else [0]
        found = [np.empty((0, 2), np.int64)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            every, first, at = np.unique(ids[lo:hi], return_index=True, return_inverse=True)
            groups = Groups(len(every))
            by = np.argsort(known[lo:hi], kind="stable")
            for i, j in zip(by.tolist(), by[1:].tolist(), strict=False):
                if known[lo + i] == known[lo + j]:
                    groups.join(int(at[i]), int(at[j]), keep=False)
            one, two = np.zeros(len(every), bool), np.zeros(len(every), bool)
            np.logical_or.at(one, at, asks[lo:hi])
            np.logical_or.at(two, at, asked[lo:hi])
            top = at[np.flatnonzero(heads[lo:hi])[:1]]
            sets = [flat[offsets[lo + i] : offsets[lo + i + 1]] for i in first]
            links = block_links(sets, order, percent, groups, one, two, int(top[0]) if len(top) else -1).links
            found.append(every[np.array(links, np.int64).reshape(-1, 2)])
        links = np.concatenate(found)
        return pa.Table.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], schema=schema)

    return rows.groupBy("part").applyInArrow(run, "a long, b long")


def _joined(blocks: DataFrame, cells: DataFrame, sets: DataFrame, often, percent: int, block: int) -> DataFrame:
    """node and label of what links join; blocks: id, label (a component of candidates), n, w_low, w1, w2."""
    key = ("n", "w_low", "w1", "w2")
    sizes = blocks.groupBy("label").agg(F.ceil(F.sum("n") / block).cast("int").alias("chunks"))
    of = stored(blocks.join(sizes, "label"), "join-blocks")
    yes, no = F.lit(True), F.lit(False)
    both = [yes.alias("asks"), yes.alias("asked"), no.alias("head")]
    chunk = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    members = of.select("label", chunk.alias("x"), F.lit(0).alias("y"), "id", F.col("id").alias("known"), *both, *key)
    large = of.where("chunks > 1")
    split = not large.isEmpty()
    if split:
        rank = cells.groupBy("id").agg(F.sum("c").alias("rank"))
        hubs = large.join(rank, "id").groupBy("label", "chunks").agg(F.max(F.struct("rank", "id", *key)).alias("hub"))
        hubs = hubs.select("label", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("x"), F.lit(0).alias("y"), "hub.*")
        members = members.unionByName(hubs.select("label", "x", "y", "id", F.col("id").alias("known"), *both, *key))
    links = stored(_links(stored(members, "join-members"), sets, often, percent), "join-links")
    labels = components(links)
    if not split:
        return labels
    now = stored(large.join(labels.select(F.col("node").alias("id"), F.col("label").alias("known")), "id", "left").withColumn("known", F.coalesce("known", "id")), "join-large")
    groups = now.groupBy("label", "known").agg(F.sum("n").alias("n"))
    heads = groups.groupBy("label").agg(F.max(F.struct("n", "known")).alias("top"), F.sum("n").alias("all")).where("top.n < all")
    now = now.join(heads.select("label", F.col("top.known").alias("top"), F.ceil((F.col("all") - F.col("top.n")) / block).cast("int").alias("outside")), "label")
    whole, part = F.sequence(F.lit(0), F.col("chunks") - 1), F.sequence(F.lit(0), F.col("outside") - 1)
    asked = now.select("label", chunk.alias("x"), F.explode(part).alias("y"), "id", "known", no.alias("asks"), yes.alias("asked"), (F.col("known") == F.col("top")).alias("head"), *key)
    asks = now.where("known != top").select("label", F.explode(whole).alias("x"), F.pmod(F.xxhash64("id"), F.col("outside")).cast("int").alias("y"), "id", "known", yes.alias("asks"), no.alias("asked"), no.alias("head"), *key)
    more = stored(_links(stored(asked.unionByName(asks), "join-outside"), sets, often, percent), "join-more")
    return components(links.unionByName(more))


def join_components(docs: DataFrame, *, n: int = N, percent: int = PERCENT, cell_rows: int = CELL, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text): the smallest doc_id that links lead to.
    cell_rows, block: sizes beyond which cells and blocks are split; results are the same for any."""
    spark = docs.sparkSession
    often = spark.sparkContext.broadcast(frequent(docs, n))
    rows = stored(_sets(docs, n, percent, often, True).withColumn("row", F.monotonically_increasing_id()), "join-sets")
    classes = rows.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("low"), F.min("row").alias("id"), F.count("*").alias("copies"))
    classes = stored(classes, "join-classes")
    again = classes.where("copies > 1").select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "id")
    again = rows.select("k1", "k2", "row").join(small(again, BROADCAST_ROWS), (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & (F.col("row") != F.col("id")))
    again = stored(again.select(F.col("row").alias("again")), "join-again")
    one = rows.where("n > 0").join(small(again, BROADCAST_ROWS), F.col("row") == F.col("again"), "left_anti")
    first = one.select(F.col("row").alias("id"), "own", F.posexplode("shingles").alias("at", "cell"))
    shared = first.groupBy("cell").agg(F.count("*").alias("c"), F.max(F.col("at") < F.col("own")).alias("smaller")).where("c > 1 AND smaller")
    shared = stored(shared.select("cell", "c"), "join-shared")
    every = stored(first.select("cell", "id").join(small(shared, BROADCAST_ROWS), "cell"), "join-every")
    alike = every.groupBy("cell").agg(F.min("c").alias("c"), F.bit_xor(F.xxhash64("id")).alias("sum"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    kept = stored(alike.groupBy("c", "sum", "lo", "hi").agg(F.min("cell").alias("cell")).select("cell"), "join-kept")
    cells = stored(every.join(small(kept, BROADCAST_ROWS), "cell"), "join-cells")
    sketches = one.select(F.col("row").alias("id"), "n", "sketch")
    edges = stored(_candidates(cells, sketches, percent, cell_rows), "join-candidates")
    blocks = components(edges)

    wanted = classes.select("id", "n", F.col("k1").alias("w1"), F.col("k2").alias("w2"), F.col("low").alias("w_low"))
    wanted = stored(blocks.select(F.col("node").alias("id"), "label").join(wanted, "id"), "join-wanted")
    near = docs.select("doc_id", "text").join(small(wanted.select("w_low").distinct(), BROADCAST_ROWS), F.col("doc_id").eqNullSafe(F.col("w_low")), "left_semi")
    labels = _joined(wanted, cells, _sets(near, n, percent, often, False), often, percent, block)
    discard(every, cells, kept, shared, again, edges, wanted)
    named = classes.select("id", "k1", "k2", "low").join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    least = named.groupBy("label").agg(F.min("low").alias("component_id"))
    named = stored(named.join(least, "label").select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "component_id"), "join-named")
    out = rows.select("doc_id", "k1", "k2", "n").join(named, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that are the first of their component; those without words all stay. The columns of docs."""
    held, row = with_rows(docs)
    found = join_components(held.select(F.col(row).alias("doc_id"), "text"), **options)
    gone = stored(found.where("n_shingles > 0 AND doc_id != component_id").select(F.col("doc_id").alias(f"{row}gone")), "join-gone")
    return held.join(small(gone, BROADCAST_ROWS), F.col(row) == F.col(f"{row}gone"), "left_anti").drop(row)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents"))
