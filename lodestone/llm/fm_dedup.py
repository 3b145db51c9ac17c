"""Removal of passages that repeat across documents, by FM-indexes of shards.

A window is 50 words of one document. It goes if its words also start in a document
with a smaller id; a word goes if a window over it goes.

1. Sharding. The least 8-word hash inside a window names its shard, so equal windows meet.
   Neighbouring windows with the same name form a run of at most 43. A name that one document
   alone has needs no look. Equal runs are one from here on, with the least id that has it,
   so copies in any number cost one run. A name that very many different runs carry is dealt
   out anew, window by window, under two hashes of the window; windows of one run alone are not indexed.
2. Each shard holds a compressed FM-index of its runs' words: a wavelet matrix over the
   Burrows-Wheeler transform and bit vectors of the places where 49 and 50 words agree.
   Every run is streamed against it from its last word: backward steps extend the match, a step over
   the bit vector shortens it again to 49 words, so the matching statistics, held to the
   threshold, need one search step for each word. A match of 50 words reports the least id in its interval.
3. The reports go back to all documents that hold the run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import wordscan as ws
from lodestone.llm.common import Mapper, cut, grouped, join_hot, list_array, text_chunks

#: Words of the hashes that name shards.
ANCHOR = 8
#: Different runs from which on a name is dealt out by window.
CROWDED = 256
#: Words of a shard that one index holds, about.
SHARD_WORDS = 400_000
U64 = np.uint64


class WaveletMatrix:
    """Rank of a symbol in a sequence; one packed bit vector for each bit of the symbols."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels = max(1, int(n_symbols - 1).bit_length())
        self.blocks, self.before, self.zeros = [], [], []
        now = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = (now >> level & 1).astype(np.uint8)
            packed = np.zeros(len(bit) // 64 + 1, U64)
            raw = np.packbits(bit, bitorder="little")
            packed.view(np.uint8)[: len(raw)] = raw
            self.blocks.append(packed)
            self.before.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed))))[:-1].astype(np.int64))
            self.zeros.append(len(bit) - int(bit.sum()))
            now = np.concatenate((now[bit == 0], now[bit == 1]))
        self.start = np.searchsorted(_reversed_bits(now, self.levels), _reversed_bits(np.arange(n_symbols), self.levels))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol stands before at."""
        for i, level in enumerate(range(self.levels - 1, -1, -1)):
            block, inner = at >> 6, (at & 63).astype(U64)
            ones = self.before[i][block] + np.bitwise_count(self.blocks[i][block] & ((U64(1) << inner) - U64(1)))
            at = np.where(symbol >> level & 1, self.zeros[i] + ones, at - ones)
        return at - self.start[symbol]


def _reversed_bits(x: np.ndarray, levels: int) -> np.ndarray:
    out = np.zeros_like(x)
    for level in range(levels):
        out |= (x >> level & 1) << (levels - 1 - level)
    return out


class FMIndex:
    """Words of sequences, each with an id; finds the least id of the sequences that hold a window."""

    def __init__(self, sequences: list[np.ndarray], ids: np.ndarray, n_words: int, window: int):
        n_seq, lens = len(sequences), np.array([len(s) for s in sequences])
        self.window, self.n_words = window, n_words
        text = np.empty(int(lens.sum()) + n_seq, np.int64)
        ends = np.cumsum(lens + 1) - 1
        inner = np.ones(len(text), bool)
        inner[ends] = False
        text[inner] = np.concatenate(sequences) + n_seq  # each end is a symbol of its own, below all words
        text[ends] = np.arange(n_seq)
        n = len(text)
        rank, step, held = np.unique(text, return_inverse=True)[1], 1, {}
        while True:
            held[step] = rank
            ahead = np.zeros(n, np.int64)
            ahead[: n - step] = rank[step:] + 1
            key = rank * (n + 1) + ahead
            order = np.argsort(key, kind="stable")
            new = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
            rank = np.empty(n, np.int64)
            rank[order] = new
            step *= 2
            if new[-1] == n - 1 and step >= window:
                break
        held[step] = rank
        order = np.empty(n, np.int64)
        order[rank] = np.arange(n)
        self.first = {}
        for depth in (window - 1, window):
            half = max(k for k in held if k <= depth)
            shift = np.minimum(order + depth - half, n - 1)
            one, two = held[half][order], held[half][shift]
            new = np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
            at = np.flatnonzero(new)
            self.first[depth] = (np.cumsum(new) - 1, np.append(at, n))
        owner = np.repeat(np.arange(n_seq), lens + 1)[order]
        self.least = np.minimum.reduceat(ids[owner], self.first[window][1][:-1])
        previous = text[order - 1]
        self.bwt = WaveletMatrix(np.where(previous < n_seq, 0, previous - n_seq + 1), n_words + 1)
        self.below = n_seq + np.concatenate(([0], np.cumsum(np.bincount(text[inner] - n_seq, minlength=n_words))))
        self.size = n

    def step(self, lo: np.ndarray, hi: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the matches that word extends to the left."""
        return self.below[word] + self.bwt.rank(word + 1, lo), self.below[word] + self.bwt.rank(word + 1, hi)

    def least_ids(self, queries: list[np.ndarray]) -> list[np.ndarray]:
        """For each window of each query the least id of the sequences that hold it, or the largest long."""
        w, none = self.window, np.iinfo(np.int64).max
        lens = np.array([len(q) for q in queries])
        flat = np.concatenate(queries)
        start = np.cumsum(lens) - lens
        out = np.full(int(np.maximum(lens - w + 1, 0).sum()), none)
        out_start = np.cumsum(np.maximum(lens - w + 1, 0)) - np.maximum(lens - w + 1, 0)
        todo = np.flatnonzero(lens >= w)
        lo, hi = np.zeros(len(lens), np.int64), np.zeros(len(lens), np.int64)
        fresh = np.ones(len(lens), bool)
        for back in range(int(lens.max(initial=0)) - w + 1):
            q = todo[lens[todo] - w - back >= 0]
            at = lens[q] - w - back  # the window's first word
            again = q[fresh[q]]
            if len(again):
                lo[again], hi[again] = 0, self.size
                base = start[again] + lens[again] - w - back
                for j in range(w - 1, -1, -1):
                    lo[again], hi[again] = self.step(lo[again], hi[again], flat[base + j])
            going = ~fresh[q]
            if going.any():
                g = q[going]
                name, edge = self.first[w - 1]
                c = name[lo[g]]
                lo[g], hi[g] = self.step(edge[c], edge[c + 1], flat[start[g] + at[going]])
            found = hi[q] > lo[q]
            fresh[q] = ~found
            out[out_start[q[found]] + at[found]] = self.least[self.first[w][0][lo[q[found]]]]
        return [out[a : a + max(0, n - w + 1)] for a, n in zip(out_start, lens)]


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each width neighbours."""
    have, now = 1, x
    while have * 2 <= width:
        now = np.minimum(now[:-have], now[have:]) if len(now) > have else now[:0]
        have *= 2
    rest = width - have
    return np.minimum(now[: len(now) - rest], now[rest:]) if rest and len(now) > rest else now if not rest else now[:0]


def _segment_hashes(h: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    if not len(start):
        return np.zeros(0, U64)
    before = np.cumsum(n) - n
    place = np.arange(int(n.sum())) - np.repeat(before, n)
    return ws.mix(np.add.reduceat(h[np.repeat(start, n) + place] * ws._PLACE[place], before) + n.astype(U64))


def _runs(window: int) -> Mapper:
    span = window - ANCHOR + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in text_chunks(batch, "__text"):
                starts, ends, first = ws.words(data, offs)
                if len(starts) < window:
                    continue
                h = ws.hashes(data, starts, ends)
                name = _sliding_min(ws.shingles(h, ANCHOR), span)
                owner = np.repeat(np.arange(hi - lo), np.diff(first))
                at = np.flatnonzero(first[owner + 1] - np.arange(len(h)) >= window)
                if not len(at):
                    continue
                name, row = name[at], owner[at]
                new = np.concatenate(([True], (name[1:] != name[:-1]) | (row[1:] != row[:-1])))
                head = np.flatnonzero(new)
                new |= (np.arange(len(at)) - head[np.cumsum(new) - 1]) % span == 0
                head = np.flatnonzero(new)
                n = np.diff(np.append(head, len(at)))
                row, begin = row[head], at[head]
                content = _segment_hashes(h, begin, n + window - 1)
                ids, keys = batch.column("__id").slice(lo, hi - lo).to_numpy(), batch.column("__key").slice(lo, hi - lo).to_numpy()
                yield pa.record_batch([pa.array(name[head].view(np.int64)), pa.array(content.view(np.int64)), pa.array(ids[row]), pa.array(keys[row]), pa.array((begin - first[row]).astype(np.int32)), pa.array(n.astype(np.int32))], names=["m", "c", "id", "k", "at", "n"])

    return run


def _cut_out(window: int) -> Mapper:
    """The words of each wanted run, or of each of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in text_chunks(batch, "__text", 1 << 19):
                starts, ends, first = ws.words(data, offs)
                h = ws.hashes(data, starts, ends)
                at, width = np.arange(max(0, len(h) - window + 1)), np.full(max(0, len(h) - window + 1), window)
                one, two = (_segment_hashes(x, at, width).view(np.int64) for x in (h, ws.mix(h + ws.SHINGLE[17]))) if any(batch.column("crowded")[lo:hi].to_pylist()) else (None, None)
                raw, out = data.tobytes(), []
                for i, (asked, doc) in enumerate(zip(batch.column("asked").slice(lo, hi - lo).to_pylist(), batch.column("__id").slice(lo, hi - lo).to_pylist())):
                    for r in asked:
                        a = int(first[i]) + r["at"]
                        if r["crowded"]:
                            for j in range(r["n"]):
                                out.append((int(one[a + j]), int(two[a + j]), doc, raw[starts[a + j] : ends[a + j + window - 1]], r["m"], r["c"], j))
                        else:
                            out.append((r["m"], r["c"], doc, raw[starts[a] : ends[a + r["n"] + window - 2]], 0, 0, -1))
                if out:
                    yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32()))], names=["m", "c", "id", "words", "of_m", "of_c", "nth"])

    return run


def _search(window: int) -> Mapper:
    """Streams every run of a shard against the shard's index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, ["shard"]):
            m, c, ids = (rows.column(x).to_numpy() for x in ("m", "c", "id"))
            keep = np.unique(np.stack((m, c)), axis=1, return_index=True)[1]
            codes: dict[bytes, int] = {}
            words = rows.column("words").take(pa.array(keep)).to_pylist()
            seqs = [np.array([codes.setdefault(w, len(codes)) for w in text.split()], np.int64) for text in words]
            index = FMIndex(seqs, ids[keep], len(codes), window)
            found = index.least_ids(seqs)
            yield pa.record_batch([pa.array(m[keep]), pa.array(c[keep]), list_array(np.concatenate(found), np.array([len(x) for x in found]), pa.int64())], names=["m", "c", "least"])

    return run


def _keep(window: int) -> Mapper:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in text_chunks(batch, "__text"):
                starts, ends, first = ws.words(data, offs)
                raw = data.tobytes()
                texts, total, gone = [], [], []
                for i, (hits, doc) in enumerate(zip(batch.column("hits").slice(lo, hi - lo).to_pylist(), batch.column("__id").slice(lo, hi - lo).to_pylist())):
                    a, b = int(first[i]), int(first[i + 1])
                    mark = np.zeros(b - a + 1, np.int64)
                    for hit in hits or ():
                        at = hit["at"] + np.flatnonzero(np.array(hit["least"], np.int64) < doc)
                        np.add.at(mark, at, 1)
                        np.add.at(mark, at + window, -1)
                    stays = np.cumsum(mark)[:-1] == 0
                    text = b" ".join([raw[s:e] for s, e in zip(starts[a:b][stays].tolist(), ends[a:b][stays].tolist())])
                    texts.append(text)
                    total.append(b - a)
                    gone.append(b - a - int(stays.sum()))
                yield pa.record_batch([batch.column(c).slice(lo, hi - lo) for c in batch.schema.names if c not in ("__text", "hits")] + [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array(texts, pa.binary()).cast(pa.string())], names=[c for c in batch.schema.names if c not in ("__text", "hits")] + ["n_words", "n_removed", "kept_sha256", "kept"])

    return run


def repeated_windows(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(k, hits) of rows that lose windows; k is the row's hash, hits hold a first window and the least ids from there on."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"), F.xxhash64(id_col, text_col).alias("__key"))
    with_id = rows.where("__id is not null and __text is not null")
    runs = cut(with_id.mapInArrow(_runs(window), "m long, c long, id long, k long, at int, n int"))
    common = cut(runs.groupBy("m").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("rows")).where("lo < hi").select("m", "rows"))
    held = cut(join_hot(runs, common, ["m"], "rows"))
    distinct = cut(held.groupBy("m", "c").agg(F.min(F.struct("id", "k", "at", "n")).alias("s"), F.count("*").alias("rows")).select("m", "c", "s.id", "s.k", "s.at", "s.n", "rows"))
    crowd = cut(distinct.groupBy("m").agg(F.count("*").alias("runs")).withColumn("crowded", F.col("runs") > CROWDED))
    asked = join_hot(distinct.drop("rows"), crowd, ["m"], "runs").groupBy("k").agg(F.collect_list(F.struct("m", "c", "at", "n", "crowded")).alias("asked"), F.max("crowded").alias("crowded"))
    pieces = cut(with_id.join(asked, with_id["__key"] == asked["k"]).select("__id", "__text", "asked", "crowded").mapInArrow(_cut_out(window), "m long, c long, id long, words binary, of_m long, of_c long, nth int"))
    alone = cut(pieces.where("nth >= 0").groupBy("m", "c").agg(F.min(F.struct("id", "words")).alias("s"), F.count("*").alias("times")).where("times > 1").select("m", "c", "s.id", "s.words", "times"))
    entries = pieces.where("nth < 0").select("m", "c", "id", "words").unionByName(alone.drop("times"))
    total = pieces.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    spark_n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(spark_n, -(-total // (6 * SHARD_WORDS)))
    sharded = entries.withColumn("shard", F.pmod(F.xxhash64("m"), F.lit(shards))).repartition(spark_n, "shard").sortWithinPartitions("shard")
    found = cut(sharded.mapInArrow(_search(window), "m long, c long, least array<long>"))
    back = pieces.where("nth >= 0").select("of_m", "of_c", "nth", "m", "c")
    single = found.select("m", "c", F.element_at("least", 1).alias("one"))
    # a window that no other run has is first in the first text with this run
    spots = join_hot(back, single, ["m", "c"], "times", counts=alone.select("m", "c", "times")).groupBy("of_m", "of_c").agg(F.map_from_entries(F.collect_set(F.struct("nth", "one"))).alias("spots")).select(F.col("of_m").alias("sm"), F.col("of_c").alias("sc"), "spots")
    whole = pieces.where("nth >= 0").groupBy("of_m", "of_c").agg(F.min("id").alias("own"), F.max("nth").alias("last"))
    places = F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.coalesce(F.try_element_at(F.col("spots"), i), F.col("own")))
    crowded = whole.join(spots, (whole["of_m"] == spots["sm"]) & (whole["of_c"] == spots["sc"]), "left").select(F.col("of_m").alias("m"), F.col("of_c").alias("c"), places.alias("least"))
    least = found.select("m", "c", "least").unionByName(crowded)
    hit = join_hot(held, least, ["m", "c"], "rows", counts=distinct.select("m", "c", "rows")).where("array_min(least) < id")
    return hit.groupBy("k").agg(F.collect_list(F.struct("at", "least")).alias("hits"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """Every row of docs with n_words, n_removed, kept_sha256 and kept, the words that stay, joined by a space.

    Windows are judged on the input. A null text counts as empty: no words, nothing kept.
    Rows with a null id keep all and take nothing from others. Rows with the same id take nothing from
    each other; equal rows get equal results. Texts shorter than a window stay whole. Columns of docs that
    bear a result's name are replaced by it.
    """
    made = ["n_words", "n_removed", "kept_sha256", "kept", "__text", "__id", "__key", "hits", "k"]
    hits = repeated_windows(docs, id_col, text_col, window)
    rows = docs.select(*[c for c in docs.columns if c not in made], F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"), F.xxhash64(id_col, text_col).alias("__key"))
    joined = rows.join(hits, rows["__key"] == hits["k"], "left").drop("k", "__key")
    others = [f for f in joined.schema.fields if f.name not in ("__text", "hits")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others) + ", n_words long, n_removed long, kept_sha256 string, kept string"
    return joined.mapInArrow(_keep(window), schema).drop("__id")
