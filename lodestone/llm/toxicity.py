"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lowers case, maps homoglyphs to Latin letters, undoes digit and sign substitutions inside
words and turns all else into single blanks. The lexicon (whole words and word beginnings), the
weights, the exception phrases (longer words or word pairs that clear a match inside them) and
the logistic curve over the length-normalised sum are learnt from labelled rows outside the held-out fold.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Mapper, crc_fold

# fixed values: letters that look alike, and characters that stand for letters
HOMOGLYPHS = dict(zip("аеорсухкмтвніјѕԁɡαοερτυνικ", "aeopcyxkmtbhijsdgaoeptuvik"))
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}

_GLYPH = re.compile("[" + "".join(HOMOGLYPHS) + "Ａ-ｚ]")
_MIXED = re.compile(r"(?<![^\W_])(?<![@$!])[^\W_0134578]*+[0134578@$!](?:[^\W_]|[@$!])*")
_LETTER = re.compile(r"[^\W\d_]")
_SIGN = re.compile(r"[0134578@$!]")
_REST = re.compile(r"[\W_]+")
_ASCII_REST = {i: " " for i in range(128) if not chr(i).isalnum()}
_GLYPH_TABLE = {ord(k): v for k, v in HOMOGLYPHS.items()} | {0xFF21 + i: chr(97 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)}
_SUB_TABLE = {ord(k): v for k, v in SUBSTITUTES.items()}


def _letters(m: re.Match) -> str:
    """A word with its substitutes undone; '!' at its end is a mark, and words without a letter stay."""
    word = m[0].rstrip("!")
    return word.translate(_SUB_TABLE) + " " if _LETTER.search(word) else m[0]


def _lower(text: str | None) -> str:
    s = (text or "").lower()
    return s.translate(_GLYPH_TABLE) if not s.isascii() and _GLYPH.search(s) else s


def _fold(s: str) -> str:
    if _SIGN.search(s):
        s = _MIXED.sub(_letters, s)
    words = " ".join((s.translate(_ASCII_REST) if s.isascii() else _REST.sub(" ", s)).split())
    return f" {words} " if words else " "


def fold(text: str | None) -> str:
    """' word word ' in folded letters; ' ' for a null, empty or blank text."""
    return _fold(_lower(text))


def apart(text: str | None) -> str:
    """The other reading of words with '!' before or between letters: '!' as a mark between words, folded."""
    s = _lower(text)
    return _fold(" ".join(m[0].replace("!", " ") for m in _MIXED.finditer(s) if "!" in m[0].rstrip("!"))) if "!" in s else " "


@dataclass
class Lexicon:
    """Patterns carry their blanks: ' word ' is a whole word, ' begin' a word's beginning."""

    weights: dict[str, float]
    exceptions: list[str]
    curve: list[float] = field(default_factory=lambda: [0.0] * 5)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for i, p in enumerate(self.weights):
            found.add_word(p, (len(p), i))
        for p in self.exceptions:
            found.add_word(p, (len(p), -1))
        found.make_automaton()
        return found

    def features(self, text: str | None, automaton, weights: list[float]) -> list[float]:
        folded = fold(text)
        hits, cleared = [], []
        for end, (n, i) in automaton.iter(folded + apart(text)) if weights or self.exceptions else ():
            (cleared if i < 0 else hits).append((end - n + 1, end, i))
        if cleared and hits:
            hits = [h for h in hits if not any(a <= h[0] and h[1] <= b for a, b, _ in cleared)]
        total, n = sum(weights[i] for _, _, i in hits), folded.count(" ") - 1
        return [1.0, np.log1p(total), total / (10 + n) ** 0.5, float(min(8, len({i for _, _, i in hits}))), np.log1p(n)]


def _beginnings(folded: str) -> set[str]:
    found = set()
    for w in set(folded.split()):
        found.add(f" {w} ")
        found.update(f" {w[:k]}" for k in range(4, min(8, len(w))))
    return found


def learn(rows: list[tuple[str | None, int]], size: int = 96) -> Lexicon:
    """A lexicon from (text, label) rows; without rows of both labels every score is the share of label 1."""
    folded = [fold(t) for t, _ in rows]
    y = np.array([int(label) for _, label in rows])
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    if not n1 or not n0:
        return Lexicon({}, [], [4.0 if n1 else -4.0, 0, 0, 0, 0])
    seen1: Counter[str] = Counter()
    for f, label in zip(folded, y):
        if label:
            seen1.update(_beginnings(f))
    likely = {p: n for p, n in seen1.items() if n >= max(2, 0.01 * n1)}
    seen0: Counter[str] = Counter()
    for f, label in zip(folded, y):
        if not label:
            seen0.update(p for p in _beginnings(f) if p in likely)
    odds = {p: float(np.log((n + 0.5) / (n1 + 1)) - np.log((seen0[p] + 0.5) / (n0 + 1))) for p, n in likely.items()}
    strong = sorted((p for p in likely if odds[p] > 2.5), key=lambda p: (-likely[p] * odds[p] * (1.15 if p[-1] == " " else 1.0), -len(p), p))
    chosen: dict[str, float] = {}
    for p in strong:
        if not any(p.startswith(q) for q in chosen):
            for q in [q for q in chosen if q.startswith(p)]:
                del chosen[q]
            chosen[p] = odds[p]
        if len(chosen) >= size:
            break
    # longer words over a chosen beginning that clean texts hold as often as toxic ones
    around1, around0 = Counter(), Counter()
    for f, label in zip(folded, y):
        words = f.split()
        near = {f" {w} " for w in words for k in range(4, min(8, len(w))) if w[:k] and f" {w[:k]}" in chosen}
        near |= {f" {a} {b} " for a, b in zip(words, words[1:]) if f" {a} " in chosen or f" {b} " in chosen}
        (around1 if label else around0).update(near)
    exceptions = sorted(p for p, n in around0.items() if n >= 3 and n / n0 >= 2 * around1[p] / n1)
    lexicon = Lexicon(chosen, exceptions)
    automaton, weights = lexicon.automaton() if chosen else None, list(chosen.values())
    if not chosen:
        return Lexicon({}, [], [float(np.log(n1 / n0)), 0, 0, 0, 0])
    x = np.array([lexicon.features(t, automaton, weights) for t, _ in rows])
    scale = np.abs(x).max(axis=0).clip(1e-9)
    z, b = x / scale, np.zeros(x.shape[1])
    for _ in range(30):  # Newton steps of a ridged logistic fit
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        w = p * (1 - p) + 1e-6
        ridge = np.diag([1e-6, *[1e-2] * (len(b) - 1)])
        b = b + np.linalg.solve((z * w[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ b)
    lexicon.curve = (b / scale).tolist()
    return lexicon


def _score(lexicon: Lexicon) -> Mapper:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, weights, curve = lexicon.automaton() if lexicon.weights else None, list(lexicon.weights.values()), np.array(lexicon.curve)
        for batch in batches:
            at = batch.schema.get_field_index("__text")
            x = np.array([lexicon.features(t.as_py(), automaton, weights) for t in batch.column(at)]).reshape(-1, 5)
            p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
            out = batch.remove_column(at)
            yield out.append_column("score", pa.array(p, pa.float64())).append_column("predicted", pa.array((p >= 0.5).astype(np.int32)))

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 3000) -> Lexicon:
    """The lexicon learnt from at most sample labelled rows outside the held-out fold, chosen by a hash of the id.

    Null ids and null labels are left out; of rows that repeat an id the least text counts, so sample bounds the texts that reach the driver.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & F.expr(f"{crc_fold(id_col)} <> 0")).select(F.col(id_col).alias("__l"), F.col(label_col).cast("int").alias("__y"))
    picked = known.groupBy("__l").agg(F.max("__y").alias("__y")).orderBy(F.xxhash64("__l"), "__l").limit(sample)
    rows = docs.select(F.col(id_col).alias("__d"), F.col(text_col).alias("__t")).join(picked, F.col("__d") == F.col("__l")).groupBy("__d").agg(F.min("__t").alias("__t"), F.max("__y").alias("__y")).select("__t", "__y", "__d")
    return learn([(t, y) for t, y, _ in sorted(rows.collect(), key=lambda r: (r[2], r[0] or ""))])


def toxicity(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1, higher: likelier toxic) and predicted (1 from 0.5 on).

    Only the text counts. Null, empty and blank texts get the score of a text without matches. Columns
    of docs named score, predicted or __text are replaced. Every row gives a row, repeated ones too.
    """
    kept = docs.select(*[c for c in docs.columns if c not in ("score", "predicted", "__text")], F.col(text_col).cast("string").alias("__text"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema.fields if f.name != "__text")
    return kept.mapInArrow(_score(lexicon), schema + "score double, predicted int")
