"""N-gram Jaccard join by prefix trees.

A text's set holds the 64-bit hashes of its distinct word n-grams. Rows with equal sets are one class from the first
pass on, which gives every row its set's size and 128-bit digest.

1. The global order of n-grams is (number of classes that hold it, at most 255; hash). Classes are dealt into buckets with
   their texts, once each. A bucket counts its n-grams and deals 32 bits and the count of each out by hash; the totals, a byte
   each, go back to it. N-grams whose 32 bits meet share a total, which may then be too high: the order stays the same for
   all sets, and only a total of 1 leaves an n-gram out.
2. Two linked sets share at least ceil(num / den * size) n-grams of either, so the first n-gram that they share
   is among the first size - ceil(num / den * size) + 1 of each. N-grams of one class come first in the order; a class with too
   many of them can have no link and goes. The others keep their shared n-grams and that prefix of them.
3. Classes that share an n-gram of their prefixes and whose sizes allow a link form families, by components of chains: one chain
   for each n-gram, in order of size.
4. Within a family and size class the sets form a trie. Each set walks it level by level:
   nodes carry the overlap so far, shared by all sets below, and a subtree goes when
   the n-grams left on either side cannot reach the overlap a link needs. Large
   families are dealt out as pairs of blocks of bounded size.
5. Components over the links found give the result.

No link between different sets is lost and none is added, but for collisions
of 64-bit hashes. Sub-trees whose sets are all in one component with the query are passed
over, as their links cannot change a component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import wordscan as ws
from lodestone.llm.common import Mapper, cut, even_labels, grouped, join_hot, text_chunks
from lodestone.llm.components import components

#: Ratio of the largest to the smallest set of a size class.
CLASS_RATIO = 1.5
#: n-grams of one block of a large family: what one task holds at a time is twice that.
BLOCK_NGRAMS = 500_000
#: n-grams that one bucket holds, about.
BUCKET_NGRAMS = 1_500_000
#: Longest run of n-grams in a node of a trie.
LABEL = 48
U64 = np.uint64


def _size_classes() -> np.ndarray:
    tops = [1]
    while tops[-1] < 1 << 34:
        tops.append(max(tops[-1] + 1, int(tops[-1] * CLASS_RATIO)))
    return np.array(tops, np.int64)


#: The largest size of each class; there are fewer than 64.
TOPS = _size_classes()


def sets_of(data: np.ndarray, offs: np.ndarray, n: int, fold_case: bool) -> tuple[np.ndarray, np.ndarray]:
    """The sorted sets of all rows, one after another, and their n + 1 bounds.

    A set holds the row's n-grams, or its whole word sequence if that is shorter; without words it is empty.
    """
    starts, ends, first = ws.words(data, offs)
    h = ws.hashes(ws.LOWER[data] if fold_case else data, starts, ends)
    count = np.diff(first)
    grams = ws.shingles(h, n)
    owner = np.repeat(np.arange(len(count)), count)
    left = first[owner + 1] - np.arange(len(h))
    at = np.flatnonzero(left >= n)
    short = np.flatnonzero((count > 0) & (count < n))
    value = np.concatenate((grams[at], np.array([ws.sequence_hash(h[first[i] : first[i + 1]]) for i in short], U64)))
    row = np.concatenate((owner[at], short))
    by = np.argsort(value)
    by = by[np.argsort(row[by].astype(np.uint16 if len(count) < 1 << 16 else np.int64), kind="stable")]
    value, row = value[by], row[by]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[new], row[new]
    return value, np.searchsorted(row, np.arange(len(count) + 1))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, U64), np.cumsum(values, dtype=U64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def digests(x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, as two arrays of longs."""
    return _sums(ws.mix(x + U64(0xA0761D6478BD642F)), bounds).view(np.int64), _sums(ws.mix(x ^ U64(0xE7037ED1A0B428DB)), bounds).view(np.int64)


def _describe(n: int, fold_case: bool) -> Mapper:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in text_chunks(batch, "__text"):
                x, bounds = sets_of(data, offs, n, fold_case)
                one, two = digests(x, bounds)
                kept = [batch.column(c).slice(lo, hi - lo) for c in ("__id", "__row")]
                yield pa.record_batch([*kept, pa.array(np.diff(bounds)), pa.array(one), pa.array(two)], names=["__id", "__row", "__size", "__h1", "__h2"])

    return run


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Places where any of the columns changes."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _unpacked(rows: pa.Table, **kinds: type) -> list[np.ndarray]:
    return [np.concatenate([np.zeros(0, kind), *(np.frombuffer(v.as_buffer(), kind) for c in rows.column(name).chunks for v in c if v.is_valid)]) for name, kind in kinds.items()]


def _place(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by the low 32 bits, so that the high ones still tell n-grams of a bucket apart."""
    return ((hashes.view(U64) & U64(0xFFFFFFFF)) % U64(buckets)).astype(np.int32)


def _texts(n: int, fold_case: bool, buckets: int) -> Mapper:
    """The texts of every class, once a task, packed by bucket of the class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, seen = even_labels(buckets), set()
        for batch in batches:
            for lo, hi, data, offs in text_chunks(batch, "__text"):
                x, bounds = sets_of(data, offs, n, fold_case)
                key = digests(x, bounds)[0]
                fresh = np.array([i for i, (k, s) in enumerate(zip(key.tolist(), np.diff(bounds).tolist())) if s and not (k in seen or seen.add(k))], np.int64)
                if len(fresh):
                    home = _place(key[fresh], buckets)
                    by = np.argsort(home, kind="stable")
                    home, fresh = home[by], fresh[by]
                    at, raw = _heads(home), data.tobytes()
                    blocks = [[raw[offs[i] : offs[i + 1]] for i in part] for part in np.split(fresh, at[1:])]
                    sizes = [np.array([len(t) for t in b], np.int64).tobytes() for b in blocks]
                    packed = [pa.compress(b"".join(b), codec="zstd", asbytes=True) for b in blocks]
                    yield pa.record_batch([pa.array(labels[home[at]], pa.int32()), pa.array(home[at], pa.int32()), pa.array(sizes, pa.binary()), pa.array(packed, pa.binary())], names=["bucket", "home", "sizes", "text"])

    return run


def _classes_in(rows: pa.Table, n: int, fold_case: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, n-grams and their bounds of the different classes of a bucket, in order of key."""
    keys, sizes, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, U64)]
    for lengths, packed in zip(rows.column("sizes").to_pylist(), rows.column("text").to_pylist()):
        offs = np.concatenate(([0], np.cumsum(np.frombuffer(lengths, np.int64))))
        data = np.frombuffer(pa.decompress(packed, decompressed_size=int(offs[-1]), codec="zstd", asbytes=True), np.uint8)
        x, bounds = sets_of(data, offs, n, fold_case)
        keys.append(digests(x, bounds)[0])
        sizes.append(np.diff(bounds))
        held.append(x)
    key, size, x = np.concatenate(keys), np.concatenate(sizes), np.concatenate(held)
    begin = np.cumsum(size) - size
    key, first = np.unique(key, return_index=True)
    size, begin = size[first], begin[first]
    bounds = np.concatenate(([0], np.cumsum(size)))
    return key, x[np.repeat(begin - bounds[:-1], size) + np.arange(bounds[-1])], bounds


def _dealt_order(x: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order in which different n-grams are dealt, and their buckets in that order."""
    bucket = _place(x, buckets)
    by = np.argsort(bucket, kind="stable")
    return by, bucket[by]


def _deal(n: int, fold_case: bool, buckets: int) -> Mapper:
    """32 bits and the count of each n-gram of a bucket of classes, by bucket of the n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = even_labels(buckets)
        for rows in grouped(batches, ["bucket"]):
            _, x, _ = _classes_in(rows, n, fold_case)
            x, times = np.unique(x, return_counts=True)
            by, bucket = _dealt_order(x, buckets)
            at = _heads(bucket)
            ends = np.append(at[1:], len(x))
            high, times = (x[by] >> U64(32)).astype(np.uint32), np.minimum(times[by], 255).astype(np.uint8)
            packed = [[v[a:b].tobytes() for a, b in zip(at, ends)] for v in (high, times)]
            home = np.full(len(at), rows.column("home")[0].as_py(), np.int32)
            yield pa.record_batch([pa.array(labels[bucket[at]], pa.int32()), pa.array(home), pa.array(bucket[at]), *(pa.array(v, pa.binary()) for v in packed)], names=["bucket", "home", "src", "x", "times"])

    return run


def _count(buckets: int) -> Mapper:
    """The total of each n-gram, at most 255, by the bucket of classes that asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = even_labels(buckets)
        for rows in grouped(batches, ["bucket"]):
            x, times = _unpacked(rows, x=np.uint32, times=np.uint8)
            which = np.unique(x, return_inverse=True)[1]
            total = np.minimum(np.bincount(which, times), 255).astype(np.uint8)[which]
            home, src = rows.column("home").to_numpy(), rows.column("src").to_numpy()
            n = np.array([len(v.as_buffer()) for c in rows.column("times").chunks for v in c])
            ends = np.cumsum(n)
            yield pa.record_batch([pa.array(labels[home], pa.int32()), pa.array(src), pa.array([total[b - k : b].tobytes() for b, k in zip(ends, n)], pa.binary())], names=["bucket", "src", "times"])

    return run


def _gather(n: int, fold_case: bool, num: int, den: int, buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """(key, size, shared, set, prefix) of the classes of a bucket that can have a link: their shared n-grams by hash, and the first of them in the global order."""

    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        key, x, bounds = _classes_in(texts, n, fold_case)
        different, which = np.unique(x, return_inverse=True)
        totals = np.empty(len(different), np.uint8)
        totals[_dealt_order(different, buckets)[0]] = _unpacked(told.sort_by("src"), times=np.uint8)[0]
        total = totals[which]
        size = np.diff(bounds)
        shared = np.add.reduceat((total > 1).astype(np.int64), bounds[:-1]) if len(size) else size
        first = shared - -(-num * size // den) + 1  # n-grams of this class alone come before all of these
        able = np.flatnonzero(first > 0)
        sets, prefixes = [], []
        for i in able:
            own, held = x[bounds[i] : bounds[i + 1]], total[bounds[i] : bounds[i + 1]]
            own, held = own[held > 1], held[held > 1]
            sets.append(own.tobytes())
            prefixes.append(own[np.argsort(held, kind="stable")[: first[i]]].tobytes())
        return pa.table([pa.array(key[able]), pa.array(size[able]), pa.array(shared[able]), pa.array(sets, pa.binary()), pa.array(prefixes, pa.binary())], names=["key", "size", "shared", "set", "prefix"])

    return run


def _post(buckets: int) -> Mapper:
    """The prefixes by bucket of the n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = even_labels(buckets)
        for batch in batches:
            if not batch.num_rows:
                continue
            prefixes = [np.frombuffer(v.as_buffer(), U64) for v in batch.column("prefix")]
            n = np.array([len(p) for p in prefixes])
            x, row = np.concatenate(prefixes), np.repeat(np.arange(len(n)), n)
            by, bucket = _dealt_order(x, buckets)
            at = _heads(bucket)
            ends = np.append(at[1:], len(x))
            key, size = batch.column("key").to_numpy()[row[by]], batch.column("size").to_numpy()[row[by]]
            packed = [[v[a:b].tobytes() for a, b in zip(at, ends)] for v in (x[by], key, size)]
            yield pa.record_batch([pa.array(labels[bucket[at]], pa.int32()), *(pa.array(v, pa.binary()) for v in packed)], names=["bucket", "x", "key", "size"])

    return run


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges that join what the edges (a, b) join, each vertex to the least of its component."""
    up: dict[int, int] = {}

    def root(v: int) -> int:
        top = v
        while (above := up.get(top, top)) != top:
            top = above
        while v != top:
            up[v], v = top, up[v]
        return top

    pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0)
    for v, w in pairs.tolist():
        v, w = root(v), root(w)
        up.setdefault(v, v)
        up.setdefault(w, w)
        up[max(v, w)] = min(v, w)
    edges = [(root(v), v) for v in up if root(v) != v]
    return [r for r, _ in edges], [v for _, v in edges]


def _chains(num: int, den: int) -> Mapper:
    """(a, b): classes next to each other in size among those that share an n-gram of their prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, ["bucket"]):
            x, key, size = _unpacked(rows, x=U64, key=np.int64, size=np.int64)
            by = np.lexsort((key, size, x))
            x, key, size = x[by], key[by], size[by]
            at = np.flatnonzero((x[1:] == x[:-1]) & (den * size[:-1] >= num * size[1:]))
            if len(at):
                a, b = _forest(key[at], key[at + 1])
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


class Trie:
    """A path-compressed trie over sorted sets, walked one level at a time."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray | None = None):
        """sizes are those of the whole sets, where sets hold only the n-grams that others may share."""
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.lens = np.array([len(sets[i]) for i in self.order])
        self.sizes = self.lens if sizes is None else np.asarray(sizes)[self.order]
        # a node: rows a..b of the order, whose paths agree from depth to stop
        nodes: list[tuple[int, int, int, int]] = []
        first_kid, n_kids = [], []
        pending = [(a, b, 0) for a, b in self._split(sets, 0, len(sets), 0)]
        self.roots = np.arange(len(pending))
        i = 0
        while i < len(pending):
            a, b, depth = pending[i]
            one, other = sets[self.order[a]], sets[self.order[b - 1]]
            n = min(len(one), len(other))
            apart = np.flatnonzero(one[depth:n] != other[depth:n])
            stop = min(depth + LABEL, depth + int(apart[0]) if len(apart) else n)
            kids = self._split(sets, a, b, stop) if b - a > 1 else [(a, b)] if stop < n else []
            first_kid.append(len(pending))
            n_kids.append(len(kids))
            pending.extend((p, q, stop) for p, q in kids)
            nodes.append((a, b, depth, stop))
            i += 1
        self.lo, self.hi, self.depth, self.stop = np.array(nodes).T if nodes else np.zeros((4, 0), int)
        self.first_kid, self.n_kids = np.array(first_kid, int), np.array(n_kids, int)
        labels = [sets[self.order[a]][d:s] for a, _, d, s in nodes]
        self.label_at = np.concatenate(([0], np.cumsum([len(x) for x in labels]))).astype(int)
        self.labels = np.concatenate(labels) if labels else np.zeros(0, U64)
        self.least = np.array([self.sizes[a:b].min() for a, b, _, _ in nodes])
        self.most = np.array([self.sizes[a:b].max() for a, b, _, _ in nodes])
        self.short = np.array([self.lens[a:b].min() for a, b, _, _ in nodes])
        self.long = np.array([self.lens[a:b].max() for a, b, _, _ in nodes])

    def _split(self, sets: list[np.ndarray], a: int, b: int, depth: int) -> list[tuple[int, int]]:
        """Runs of rows a..b by their n-gram at depth; rows that end there are no run."""
        key = [int(sets[self.order[r]][depth]) if len(sets[self.order[r]]) > depth else -1 for r in range(a, b)]
        cuts = [0, *(j for j in range(1, len(key)) if key[j] != key[j - 1]), len(key)]
        return [(a + p, a + q) for p, q in zip(cuts, cuts[1:]) if key[p] >= 0]


def walk(trie: Trie, x: np.ndarray, num: int, den: int, settled: np.ndarray | None = None, size: int | None = None) -> np.ndarray:
    """Ordinals (in the trie's order) of the sets linked with x, whose whole set has size n-grams.

    settled marks sets that need no look: a subtree of nothing else is passed over.
    """
    hits = []
    node, so_far = trie.roots, np.zeros(len(trie.roots), int)
    open_sets = None if settled is None else np.concatenate(([0], np.cumsum(~settled)))
    n_x, size = len(x), len(x) if size is None else size
    while len(node):
        if open_sets is not None:
            live = open_sets[trie.hi[node]] > open_sets[trie.lo[node]]
            node, so_far = node[live], so_far[live]
        # sizes: no set below may be in the ratio of a link
        live = (trie.most[node] * den >= num * size) & (trie.least[node] * num <= den * size)
        node, so_far = node[live], so_far[live]
        if not len(node):
            break
        at, n = trie.label_at[node], trie.label_at[node + 1] - trie.label_at[node]
        before = np.cumsum(n) - n
        labels = trie.labels[np.repeat(at - before, n) + np.arange(n.sum())]
        where = np.searchsorted(x, labels)
        where[where == n_x] = n_x - 1
        same = np.concatenate(([0], np.cumsum(x[where] == labels)))
        so_far = so_far + same[before + n] - same[before]
        # what is left of x after the label's last n-gram, and of the longest path below
        x_left = n_x - np.searchsorted(x, trie.labels[at + n - 1], "right")
        ends = trie.stop[node]
        for j in np.flatnonzero(ends == trie.short[node]):
            o, lo, hi = int(so_far[j]), int(trie.lo[node[j]]), int(trie.hi[node[j]])
            done = lo + np.flatnonzero((trie.lens[lo:hi] == ends[j]) & (den * o >= num * (size + trie.sizes[lo:hi] - o)))
            if len(done):
                hits.append(done)
        best = so_far + np.minimum(x_left, trie.long[node] - ends)
        live = (best * (num + den) >= num * (size + trie.least[node])) & (trie.n_kids[node] > 0)
        node, so_far = node[live], so_far[live]
        n = trie.n_kids[node]
        before = np.cumsum(n) - n
        so_far = np.repeat(so_far, n)
        node = np.repeat(trie.first_kid[node] - before, n) + np.arange(n.sum())
    return np.sort(np.concatenate(hits)) if hits else np.zeros(0, int)


def _links(num: int, den: int) -> Mapper:
    """(a, b) of a spanning set of the links within one block, or between two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, ["family", "cls", "bi", "bj"]):
            ids, sizes = rows.column("key").to_numpy(), rows.column("size").to_numpy()
            blocks = rows.column("block").to_numpy()
            sets = [np.frombuffer(v.as_buffer(), U64) for v in rows.column("set").combine_chunks()]
            self_join = rows.column("bi")[0].as_py() == rows.column("bj")[0].as_py()
            left = np.arange(len(ids)) if self_join else np.flatnonzero(blocks == rows.column("bi")[0].as_py())
            right = left if self_join else np.flatnonzero(blocks == rows.column("bj")[0].as_py())
            if not len(left) or not len(right):
                continue
            trie = Trie([sets[i] for i in left], sizes[left])
            local = left[np.array(trie.order)]
            group, out = np.arange(len(ids)), []
            for q in local if self_join else right:
                settled = group[local] == group[q]
                if settled.all():
                    continue
                for t in local[walk(trie, sets[q], num, den, settled, int(sizes[q]))]:
                    if group[t] != group[q]:
                        group[group == group[t]] = group[q]
                        out.append((int(ids[q]), int(ids[t])))
            if out:
                a, b = zip(*out)
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _linked(docs: DataFrame, id_col: str, text_col: str, n: int, num: int, den: int, fold_case: bool) -> DataFrame:
    """(__id, __row, __size, __h1, __h2, kin, least) of every row: __row is a hash of all its columns, kin names its component, least is the component's least id."""
    spark = docs.sparkSession
    spark_n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    slim = docs.select(F.col(id_col).cast("long").alias("__id"), F.xxhash64(*docs.columns).alias("__row"), F.col(text_col).cast("string").alias("__text"))
    described = cut(slim.mapInArrow(_describe(n, fold_case), "__id long, __row long, __size long, __h1 long, __h2 long"))
    classes = cut(described.where("__id is not null and __size > 0").groupBy("__h1", "__h2").agg(F.min("__id").alias("rep"), F.min("__size").alias("size"), F.count("*").alias("rows")))
    total = classes.agg(F.sum("size")).first()[0] or 0
    buckets = max(spark_n, -(-total // BUCKET_NGRAMS))
    by_bucket = lambda df: df.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    texts = by_bucket(slim.where("__id is not null").select("__text").mapInArrow(_texts(n, fold_case, buckets), "bucket int, home int, sizes binary, text binary"))
    dealt = by_bucket(texts.mapInArrow(_deal(n, fold_case, buckets), "bucket int, home int, src int, x binary, times binary"))
    totals = dealt.mapInArrow(_count(buckets), "bucket int, src int, times binary").repartition(buckets, "bucket")
    # both sides lie by bucket already, so the texts' one shuffle serves their counting and their gathering
    gathered = texts.groupBy("bucket").cogroup(totals.groupBy("bucket")).applyInArrow(_gather(n, fold_case, num, den, buckets), "key long, size long, shared long, set binary, prefix binary")
    able = cut(gathered)
    chains = by_bucket(able.select("key", "size", "prefix").mapInArrow(_post(buckets), "bucket int, x binary, key binary, size binary")).mapInArrow(_chains(num, den), "a long, b long")
    families = components(chains)
    tops = F.array(*[F.lit(int(t)) for t in TOPS])
    first = F.size(F.filter(tops, lambda t: t < F.col("size")))
    last = F.size(F.filter(tops, lambda t: t < F.floor(F.col("size") * den / num)))
    # linked sets meet in the size class of the larger one
    placed = able.select("key", "size", "shared").join(families, F.col("key") == families["v"]).select("key", "shared", F.col("component").alias("family"), F.explode(F.sequence(first, F.greatest(first, last))).alias("cls"))
    placed = cut(placed)
    weight = cut(placed.groupBy("family", "cls").agg(F.sum("shared").alias("w"), F.count("*").alias("k")).where("k > 1").select("family", "cls", F.greatest(F.lit(1), F.ceil(F.col("w") / BLOCK_NGRAMS)).cast("int").alias("blocks"), "k"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    wanted = join_hot(placed, weight, ["family", "cls"], "k").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).select("key", "family", "cls", "block", other.alias("o"))
    asked = wanted.select("key", "family", "cls", "block", F.least("block", "o").alias("bi"), F.greatest("block", "o").alias("bj"))
    sets = asked.join(able.select("key", "size", "set"), "key").repartition(spark_n, "family", "cls", "bi", "bj").sortWithinPartitions("family", "cls", "bi", "bj")
    links = sets.select("key", "size", "family", "cls", "block", "bi", "bj", "set").mapInArrow(_links(num, den), "a long, b long")
    found = components(links)
    kin = cut(classes.join(found, classes["__h1"] == found["v"]).select("__h1", "__h2", "rep", "rows", F.col("component").alias("kin")))
    least = kin.groupBy("kin").agg(F.min("rep").alias("least"))
    one = classes.join(kin.select("__h1", "__h2"), ["__h1", "__h2"], "left_anti").select("__h1", "__h2", F.col("rep").alias("least"), "rows", F.col("__h1").alias("kin"))
    best = cut(kin.join(least, "kin").select("__h1", "__h2", "least", "rows", "kin").unionByName(one))
    whole = F.col("__id").isNotNull() & (F.col("__size") > 0)
    joined = join_hot(described.where(whole), best, ["__h1", "__h2"], "rows")
    alone = described.where(~whole).select(*described.columns, F.col("__id").alias("least"), F.lit(None).cast("long").alias("kin"))
    return joined.select(*alone.columns).unionByName(alone)


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100, fold_case: bool = False) -> DataFrame:
    """(id_col, n_shingles, component_id) for every row of docs.

    Links join texts whose n-gram sets have den * |intersection| >= num * |union|. component_id
    is the smallest id that links reach, the row's own included. A null, empty or
    blank text has an empty set and no link: its component is its own id. Rows with equal sets
    are linked, repeated rows too, and each gives a row. A null id stays null in the result and
    takes no part in links. Rows with one id and different texts are judged text by text. An empty table gives none.
    """
    found = _linked(docs.select(id_col, text_col), id_col, text_col, n, num, den, fold_case)
    return found.select(F.col("__id").alias(id_col), F.col("__size").alias("n_shingles"), F.col("least").alias("component_id"))


def near_duplicates_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near copies (five words, 0.8): that of the smallest id.

    Of several rows of a group with that id, the one whose set and columns have the least hashes stays; rows equal in all columns are one.
    Different texts under one id are different documents. Rows without words and rows with a null id are kept, all of them.
    """
    found = _linked(docs, id_col, text_col, 5, 80, 100, False)
    stays = found.where("kin is not null").groupBy("kin").agg(F.min(F.struct("__id", "__h1", "__h2", "__row")).alias("s")).select(F.col("s.__id").alias("__id"), F.col("s.__row").alias("__row")).distinct()
    told = docs.withColumns({"__id": F.col(id_col).cast("long"), "__row": F.xxhash64(*docs.columns)})
    blank = F.col(id_col).isNull() | F.col(text_col).isNull() | ~F.col(text_col).rlike(r"[^ \t-\r]")
    rest = told.where(~blank).join(stays, ["__id", "__row"], "left_semi").dropDuplicates(["__id", "__row"])
    return rest.select(*docs.columns).unionByName(docs.where(blank))
