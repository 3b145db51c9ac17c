"""SentencePiece models run by the tokenizers library.

The model protobuf is parsed here. From it come the normaliser, the metaspace marker, byte
fallback and the model: unigram scores, or for a BPE model the merges that its scores imply. Where no
piece holds a marker behind another character, words are encoded one by one, which gives the same ids sooner and lets long
texts go through in sections. Batches are encoded by the library's threads.
"""

from __future__ import annotations

import hashlib
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import Mapper, list_array

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Characters encoded at a time.
SECTION = 1 << 18
#: Different words whose ids are kept, about: a worker's memory of words stays below some 60 MB.
CACHED_WORDS = 200_000
#: Different words that the library encodes at a time.
WORDS_AT_ONCE = 4_000


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            x = b[i]
            i += 1
            value |= (x & 127) << shift
            shift += 7
            if x < 128:
                return value

    while i < len(b):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        n = {1: 8, 5: 4}[kind] if kind != 2 else varint()
        yield tag >> 3, b[i : i + n]
        i += n


class Model:
    """What a serialised SentencePiece model says."""

    def __init__(self, raw: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict[int, int | bytes] = {}
        rules: dict[int, int | bytes] = {}
        for number, value in _fields(raw):
            if number == 1:
                p = dict(_fields(value))
                self.pieces.append((p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                rules = dict(_fields(value))
        self.kind = {1: "unigram", 2: "bpe"}.get(trainer.get(3, 1))
        if self.kind is None:
            raise ValueError("only unigram and BPE models are supported")
        self.byte_fallback = bool(trainer.get(35, 0))
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        self.charsmap = rules.get(2, b"")
        self.dummy_prefix = bool(rules.get(3, 1))
        self.squeeze = bool(rules.get(4, 1))
        self.by_word = not any(MARK in p[1:].lstrip(MARK) or (MARK in p[1:] and p.strip(MARK)) for p, _, kind in self.pieces if kind in (NORMAL, USER))


def build(model: Model):
    """The tokenizer of a model; its input is text in which blanks are already markers if the model has no character map."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if model.kind == "unigram":
        tok = Tokenizer(models.Unigram([(p, s) for p, s, _ in model.pieces], model.unknown, model.byte_fallback))
    else:
        ids = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER, BYTE, UNKNOWN, CONTROL)}
        usable = {p: s for p, s, kind in model.pieces if kind in (NORMAL, USER)}
        merges = []
        for p, score in usable.items():
            local = [(p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable]
            merges.extend((-score, ids[p], ids[a], ids[b], (a, b)) for a, b in local)
        merges.sort()
        tok = Tokenizer(models.BPE({p: i for i, (p, _, _) in enumerate(model.pieces)}, [m[-1] for m in merges], unk_token=model.pieces[model.unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback, cache_capacity=0))
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if steps:
        tok.normalizer = normalizers.Sequence(steps)
    if model.by_word:
        tok.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
    tok.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    return tok


class Pieces:
    """Encodes and decodes whole texts."""

    def __init__(self, raw: bytes):
        self.model = Model(raw)
        self.tok = build(self.model)
        self._forget()

    def _forget(self) -> None:
        """Empty the memory of words: ids of word i stand in known from ends[i] to ends[i + 1]."""
        self.place: dict[bytes, int] = {}
        self.known, self.ends = array("i"), array("q", [0])
        self.sound = bytearray()  # whether word i decodes to itself
        self.met = bytearray()  # whether word i came again since words were last dropped

    def _thin(self) -> None:
        """Drop the words that did not come again; all of them, if that leaves the memory near full."""
        keep = np.flatnonzero(np.frombuffer(bytes(self.met), np.uint8))
        words, known, ends, sound = list(self.place), np.array(self.known, np.int32), np.array(self.ends), self.sound
        self._forget()
        if len(keep) <= 0.75 * CACHED_WORDS:
            self.place = {words[i]: n for n, i in enumerate(keep.tolist())}
            begin, times = ends[keep], ends[keep + 1] - ends[keep]
            before = np.concatenate(([0], np.cumsum(times)))
            self.known = array("i", known[np.repeat(begin - before[:-1], times) + np.arange(before[-1])].astype(np.int32).tobytes())
            self.ends = array("q", before.astype(np.int64).tobytes())
            self.sound = bytearray(np.frombuffer(bytes(sound), np.uint8)[keep].tobytes())
            self.met = bytearray(len(keep))

    def _bare_word(self, word: str) -> str:
        """A word as the decoder gives it: without the blank that stands for the start of a text."""
        return word[1:] if self.model.dummy_prefix and word[:1] == " " else word

    def normalised(self, text: str) -> str:
        """The text as the model sees it, markers for blanks."""
        if self.tok.normalizer:
            text = self.tok.normalizer.normalize_str(text)
        if not text:
            return ""
        return (MARK if self.model.dummy_prefix else "") + text.replace(" ", MARK)

    def _sections(self, text: str) -> list[str]:
        if not self.model.by_word or len(text) <= SECTION:
            return [text] if text else []
        out, a = [], 0
        while len(text) - a > SECTION:
            b = a + SECTION
            while b > a and not (text[b] == MARK and text[b - 1] != MARK):
                b -= 1
            if b == a:  # one word longer than a section
                b = a + SECTION
                while b < len(text) and not (text[b] == MARK and text[b - 1] != MARK):
                    b += 1
            out.append(text[a:b])
            a = b
        return [*out, text[a:]] if a < len(text) else out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null gives none."""
        return self.checked(texts)[0]

    def checked(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[bool]]:
        """Ids of each text, and whether the library decodes them to the normalised text.

        Where pieces keep within words, so do encoding and decoding: each different word is encoded and decoded once.
        """
        whole = [self.normalised(t or "") for t in texts]
        if self.model.by_word:
            return self._encode_words(whole)
        ids = self._encode_flat(whole)
        return ids, [a == b for a, b in zip(self.decode(ids), map(self.plain, texts))]

    def _encode_words(self, whole: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        raw = [t.replace(MARK, " ").encode() for t in whole]
        edge = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
        data = np.frombuffer(b"".join(raw), np.uint8)
        blank = data == 32
        start = blank.copy()
        start[1:] &= ~blank[:-1]
        start[edge[:-1][edge[:-1] < len(data)]] = True
        at = np.flatnonzero(start)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(data))), pa.py_buffer(data)]).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        if len(self.place) > CACHED_WORDS:
            self._thin()
        old = len(self.place)
        new = [w for w in distinct if w not in self.place]
        bare = self._bare()
        for a in range(0, len(new), WORDS_AT_ONCE):
            part = new[a : a + WORDS_AT_ONCE]
            plain = [w.decode() for w in part]
            found = [e.ids for e in bare.encode_batch_fast([w.replace(" ", MARK) for w in plain], add_special_tokens=False)]
            self.place.update(zip(part, range(len(self.place), len(self.place) + len(part))))
            self.known.extend(chain.from_iterable(found))
            self.sound.extend(a == b for a, b in zip(self.tok.decode_batch(found, skip_special_tokens=False), map(self._bare_word, plain)))
            self.ends.extend(accumulate(map(len, found), initial=self.ends.pop()))
        known, ends = np.frombuffer(self.known, np.int32), np.frombuffer(self.ends, np.int64)
        entry = np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct))
        self.met.extend(bytes(len(self.place) - old))
        np.frombuffer(self.met, np.uint8)[entry[entry < old]] = 1
        which = entry[words.indices.to_numpy()]
        begin = ends[which]
        times = ends[which + 1] - begin
        failed = np.concatenate(([0], np.cumsum(np.frombuffer(bytes(self.sound), np.uint8)[which] == 0)))
        before = np.concatenate(([0], np.cumsum(times)))
        ids = known[np.repeat(begin - before[:-1], times) + np.arange(before[-1])]
        del known, ends  # views of arrays that grow
        places = np.searchsorted(at, edge)
        cuts, wrong = before[places], failed[places]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])], (wrong[1:] == wrong[:-1]).tolist()

    def _encode_flat(self, whole: list[str]) -> list[np.ndarray]:
        """Ids of normalised texts, by the library's threads, in batches of bounded size."""
        sections = [self._sections(t) for t in whole]
        flat = [s for x in sections for s in x]
        done: list[np.ndarray] = []
        bare = self._bare()
        batch: list[str] = []
        held = 0
        for s in [*flat, None]:
            if batch and (s is None or held + len(s) > 4 * SECTION):
                done.extend(np.array(e.ids, np.int32) for e in bare.encode_batch_fast(batch, add_special_tokens=False))
                batch, held = [], 0
            if s is not None:
                batch.append(s)
                held += len(s)
        at, out = 0, []
        for x in sections:
            out.append(np.concatenate(done[at : at + len(x)]) if x else np.zeros(0, np.int32))
            at += len(x)
        return out

    @lru_cache(maxsize=1)
    def _bare(self):
        """The tokenizer without the normaliser, whose work normalised() has done."""
        if not self.tok.normalizer:
            return self.tok
        from tokenizers import Tokenizer, normalizers

        tok = Tokenizer.from_str(self.tok.to_str())
        tok.normalizer = normalizers.Sequence([])
        return tok

    def plain(self, text: str | None) -> str:
        """What decoding the text's ids should give: the normalised text with blanks."""
        whole = self.normalised(text or "").replace(MARK, " ")
        return whole[1:] if self.model.dummy_prefix else whole

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """The texts of ids, by the library's decoder."""
        return self.tok.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)


def parity(raw: bytes, texts: list[str]) -> list[int]:
    """Places of texts whose ids differ from those of the sentencepiece library."""
    import sentencepiece

    theirs = sentencepiece.SentencePieceProcessor(model_proto=raw).encode(texts, num_threads=1)
    return [i for i, (a, b) in enumerate(zip(Pieces(raw).encode(texts), theirs)) if a.tolist() != b]


# fixed values: strings that try every branch of the normaliser, the marker and byte fallback
PROBES = ["", " ", "a", " a", "a  b   c", "Hello, world!\nNew\tline \r\n", "ÄÖÜ ß éèê ñ ¿qué?", "日本語 テスト", "▁mark", "emoji \U0001f600\U0001f468‍\U0001f469", "<s> </s> <unk> <0x41>", "\x00\x07 control", "x" * 300, "é combining", "1234567890 3.14159", "　wide space"]


def read_model(spark: SparkSession, path: str) -> bytes:
    """The bytes of a model file, read on the driver: a vocabulary file, a few MB at most."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    with open(path, "rb") as f:
        return f.read()


_made: dict[bytes, Pieces] = {}


def _encode(raw: bytes, with_ids: bool) -> Mapper:
    key = hashlib.sha256(raw).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _made.get(key) or _made.setdefault(key, Pieces(raw))
        for batch in batches:
            at = batch.schema.get_field_index("__text")
            n, size = batch.num_rows, 0
            lo = 0
            lengths = [len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(at)]
            for hi in range(1, n + 1):
                size += lengths[hi - 1]
                if hi < n and size + lengths[hi] <= 4 * SECTION:
                    continue
                part = batch.slice(lo, hi - lo)
                texts = part.column(at).to_pylist()
                ids, right = pieces.checked(texts)
                out = part.remove_column(at).append_column("n_tokens", pa.array([len(x) for x in ids], pa.int64()))
                out = out.append_column("ids_sha256", pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids])).append_column("round_trip", pa.array(right, pa.bool_()))
                yield out.append_column("ids", list_array(np.concatenate(ids), np.array([len(x) for x in ids]), pa.int32())) if with_ids else out
                lo, size = hi, 0

    return run


def sentencepiece_encode(docs: DataFrame, model_path: str, text_col: str = "text", with_ids: bool = True, verify: bool = True) -> DataFrame:
    """docs without text_col, with n_tokens, ids_sha256 (of the ids as 32-bit little-endian), round_trip and ids.

    round_trip says whether decoding the ids gives back the normalised text. Null and empty texts have no ids. Columns of docs
    that bear a result's name are replaced. verify compares ids with the sentencepiece library on
    fixed probes before anything runs, and fails on a difference.
    """
    raw = read_model(docs.sparkSession, model_path)
    if verify and (bad := parity(raw, PROBES)):
        raise ValueError(f"ids differ from sentencepiece's for probes {bad}")
    made = ("n_tokens", "ids_sha256", "round_trip", "ids", "__text", text_col)
    kept = docs.select(*[c for c in docs.columns if c not in made], F.col(text_col).cast("string").alias("__text"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema.fields if f.name != "__text")
    return kept.mapInArrow(_encode(raw, with_ids), schema + "n_tokens long, ids_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids)
