"""Personal data by fixed patterns and a character-level bidirectional LSTM with CRF transitions.

The network reads character classes and is trained in numpy on labelled spans that a generator
writes: the four kinds in many spellings among look-alikes that are none. Texts are read in
overlapping windows; where windows overlap, their scores are averaged, nearer centres weighing
more, and each covered stretch is decoded at once, so no span is cut at a window's edge. A span of any
of the kinds holds a digit or an '@', so a window without either cannot hold one and isn't read.
Spans of the network are added to the patterns' where they meet a kind's form and overlap none of them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Mapper

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match can only begin where a run of digits does, and its runs need not be given back
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ANCHOR = re.compile(r"[0-9@]")
WINDOW, STRIDE = 96, 48
HIDDEN = 12

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def email_spans(text: str) -> list[Span]:
    """Leftmost addresses, found from each '@' outwards: every stretch between two '@' is read once."""
    found: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        m = DOMAIN.match(text, at)
        if m:
            begin = end + len(text[end:at].rstrip(LOCAL))
            if begin < at:
                found.append((0, begin, m.end()))
                end = m.end()
        following = text.find("@", at + 1)
        end, at = max(end, at + 1) if following >= 0 else end, following
    return found


def _octet(part: str) -> bool:
    rest = part.lstrip("0")
    return len(rest) <= 3 and int(rest or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the fixed patterns: leftmost, not overlapping within a kind, by kind and start. Linear in the text."""
    found = email_spans(text)
    if ANCHOR.search(text):
        found += [(1, *m.span()) for m in IP.finditer(text) if all(map(_octet, m[0].split(".")))]
        found += [(2, *m.span()) for m in CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        found += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15] if "+" in text else []
    return found


# --- character classes -------------------------------------------------------------------------

_MARKS = "@.-_+()/:,%#\"'="


def _class_table() -> np.ndarray:
    table = np.full(128, 3, np.int64)
    for i in range(128):
        c = chr(i)
        table[i] = 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 4 if c == " " else 5 if c.isspace() else 6 + _MARKS.index(c) if c in _MARKS else 3
    return table


_TABLE = _class_table()
CLASSES = 6 + len(_MARKS) + 1


def classes(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(code < 128, _TABLE[np.minimum(code, 127)], CLASSES - 1)


# --- the network -------------------------------------------------------------------------------

TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _lstm(x: np.ndarray, w: np.ndarray, u: np.ndarray, keep: bool = False):
    """Hidden states over time of class rows x (batch, time); w holds a row of gate inputs for each class."""
    n, t = x.shape
    h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
    out, saved = np.empty((t, n, HIDDEN)), []
    for i in range(t):
        z = w[x[:, i]] + h @ u
        g = _sigmoid(z[:, : 3 * HIDDEN])
        a = np.tanh(z[:, 3 * HIDDEN :])
        c0 = c
        c = g[:, HIDDEN : 2 * HIDDEN] * c0 + g[:, :HIDDEN] * a
        tc = np.tanh(c)
        if keep:
            saved.append((h, c0, g, a, tc))
        h = g[:, 2 * HIDDEN :] * tc
        out[i] = h
    return out, saved


def _lstm_back(x: np.ndarray, u: np.ndarray, saved: list, dout: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dw, du = np.zeros((CLASSES, 4 * HIDDEN)), np.zeros_like(u)
    dh, dc = np.zeros(dout[0].shape), np.zeros(dout[0].shape)
    for i in range(len(saved) - 1, -1, -1):
        h0, c0, g, a, tc = saved[i]
        dh = dh + dout[i]
        gi, gf, go = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :]
        dc = dc + dh * go * (1 - tc * tc)
        dz = np.concatenate((dc * a * gi * (1 - gi), dc * c0 * gf * (1 - gf), dh * tc * go * (1 - go), dc * gi * (1 - a * a)), axis=1)
        du += h0.T @ dz
        np.add.at(dw, x[:, i], dz)
        dh, dc = dz @ u.T, dc * gf
    return dw, du


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def _crf(emit: np.ndarray, trans: np.ndarray, tags: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood of tags (batch, time), and its gradients."""
    t, n, k = emit.shape
    alpha, beta = np.empty_like(emit), np.zeros_like(emit)
    alpha[0] = emit[0]
    for i in range(1, t):
        alpha[i] = emit[i] + _lse(alpha[i - 1][:, :, None] + trans[None], 1)
    for i in range(t - 2, -1, -1):
        beta[i] = _lse(trans[None] + (emit[i + 1] + beta[i + 1])[:, None, :], 2)
    z = _lse(alpha[-1], 1)
    demit = np.exp(alpha + beta - z[None, :, None])
    dtrans = np.zeros_like(trans)
    rows = np.arange(n)
    score = emit[0, rows, tags[:, 0]].copy()
    for i in range(1, t):
        pair = np.exp(alpha[i - 1][:, :, None] + trans[None] + (emit[i] + beta[i])[:, None, :] - z[:, None, None])
        dtrans += pair.sum(axis=0)
        np.add.at(dtrans, (tags[:, i - 1], tags[:, i]), -1)
        score += emit[i, rows, tags[:, i]] + trans[tags[:, i - 1], tags[:, i]]
    for i in range(t):
        demit[i, rows, tags[:, i]] -= 1
    return float((z - score).mean()), demit / n, dtrans / n


class Tagger:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {k: rng.normal(0, 0.3, s) for k, s in {"wf": (CLASSES, 4 * HIDDEN), "uf": (HIDDEN, 4 * HIDDEN), "wb": (CLASSES, 4 * HIDDEN), "ub": (HIDDEN, 4 * HIDDEN), "o": (2 * HIDDEN, TAGS), "b": (TAGS,), "t": (TAGS, TAGS)}.items()}
        self.m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        self.steps = 0

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Scores (batch, time, tags) of class rows."""
        f, _ = _lstm(x, self.p["wf"], self.p["uf"])
        b, _ = _lstm(x[:, ::-1], self.p["wb"], self.p["ub"])
        return (np.concatenate((f, b[::-1]), axis=2) @ self.p["o"] + self.p["b"]).transpose(1, 0, 2)

    def train(self, x: np.ndarray, tags: np.ndarray, rate: float) -> float:
        f, sf = _lstm(x, self.p["wf"], self.p["uf"], True)
        b, sb = _lstm(x[:, ::-1], self.p["wb"], self.p["ub"], True)
        h = np.concatenate((f, b[::-1]), axis=2)
        loss, demit, dt = _crf(h @ self.p["o"] + self.p["b"], self.p["t"], tags)
        dh = demit @ self.p["o"].T
        grads = {"o": np.einsum("tnh,tnk->hk", h, demit), "b": demit.sum(axis=(0, 1)), "t": dt}
        grads["wf"], grads["uf"] = _lstm_back(x, self.p["uf"], sf, dh[:, :, :HIDDEN])
        grads["wb"], grads["ub"] = _lstm_back(x[:, ::-1], self.p["ub"], sb, dh[::-1, :, HIDDEN:])
        self.steps += 1
        size = np.sqrt(sum((g * g).sum() for g in grads.values()))
        for k, g in grads.items():  # Adam
            g = g * min(1.0, 5.0 / size)
            a, s = self.m[k]
            a += 0.1 * (g - a)
            s += 0.01 * (g * g - s)
            self.p[k] -= rate * (a / (1 - 0.9**self.steps)) / (np.sqrt(s / (1 - 0.99**self.steps)) + 1e-8)
        return loss


def viterbi(emit: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best tags of one stretch (time, tags); an inside tag follows only its own begin or inside."""
    t, k = emit.shape
    step = trans + _ALLOWED
    score, back = emit[0] + np.where(np.arange(k) % 2 == 0, np.where(np.arange(k) > 0, -1e9, 0), 0), np.empty((t, k), np.int8)
    for i in range(1, t):
        s = score[:, None] + step
        back[i] = s.argmax(axis=0)
        score = s[back[i], np.arange(k)] + emit[i]
    out = np.empty(t, np.int64)
    out[-1] = score.argmax()
    for i in range(t - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


_ALLOWED = np.zeros((TAGS, TAGS))
for _k in range(len(KINDS)):
    for _from in range(TAGS):
        if _from not in (1 + 2 * _k, 2 + 2 * _k):
            _ALLOWED[_from, 2 + 2 * _k] = -1e9


# --- labelled spans ----------------------------------------------------------------------------


def _luhn_number(rng: np.random.Generator, n: int) -> str:
    body = "".join(map(str, rng.integers(0, 10, n - 1)))
    return next(body + str(d) for d in range(10) if luhn(body + str(d)))


def _word(rng: np.random.Generator) -> str:
    w = "".join(rng.choice(list("etaoinshrdlucmé"), rng.integers(2, 9)))
    return w.capitalize() if rng.random() < 0.15 else w.upper() if rng.random() < 0.1 else w


def _make(kind: int, rng: np.random.Generator) -> str:
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    pick = lambda *x: x[int(rng.integers(len(x)))]
    if kind == 0:
        name = pick(_word(rng), f"{_word(rng)}.{d(2)}", f"{_word(rng)}.{_word(rng)}", f"{_word(rng)}_{_word(rng)}{d(2)}").lower()
        return f"{name}{pick('@', '@', '@', ' @ ')}{_word(rng).lower()}{pick('', d(1))}.{pick('com', 'org', 'example.com', 'co.uk')}"
    if kind == 1:
        return pick(".", ".", ".", " . ").join(str(x) for x in rng.integers(0, 256, 4))
    if kind == 2:
        n = _luhn_number(rng, int(pick(16, 16, 15, 13)))
        sep = pick("", "", " ", "-", ".")
        return sep.join(n[i : i + 4] for i in range(0, len(n), 4))
    return pick(f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(7)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"00{d(2)} {d(3)} {d(3)} {d(4)}", f"+{d(2)}.{d(3)}.{d(3)}.{d(3)}")


def _look_alike(rng: np.random.Generator) -> str:
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    made = [f"version {d(1)}.{d(1)}", f"{d(1)}.{d(1)}.", f"(c) {d(4)}", f'token = "{"".join(rng.choice(list("0123456789abcdef"), 40))}"', f"{d(2)}:{d(2)}", f"{d(4)}-{d(2)}-{d(2)}", f"{d(3)},{d(3)}.{d(2)}", f"@{_word(rng)}", f"{d(2)}%", f"#{d(5)}", f"page {d(3)}", f"{d(6)}"]
    return made[int(rng.integers(len(made)))]


def labelled(rng: np.random.Generator, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Class rows and tags of n windows."""
    xs, ys = [], []
    for _ in range(n):
        text, tags = "", []
        while len(text) < WINDOW + 40:
            r = rng.random()
            if r < 0.72:
                piece, kind = _word(rng), -1
            elif r < 0.86:
                piece, kind = _look_alike(rng), -1
            else:
                kind = int(rng.integers(4))
                piece = _make(kind, rng)
            tail = str(rng.choice([" ", " ", " ", ". ", ", ", "\n", "!! ", "### "]))
            text += piece + tail
            tags += ([0] * len(piece) if kind < 0 else [1 + 2 * kind] + [2 + 2 * kind] * (len(piece) - 1)) + [0] * len(tail)
        a = int(rng.integers(0, len(text) - WINDOW))
        xs.append(classes(text[a : a + WINDOW]))
        ys.append(tags[a : a + WINDOW])
    return np.array(xs), np.array(ys)


@lru_cache(maxsize=2)
def tagger(batches: int = 100, size: int = 48, seed: int = 7) -> Tagger:
    """The trained network; batches * size labelled windows, the same for the same arguments."""
    rng, net = np.random.default_rng(seed), Tagger(seed)
    for i in range(batches):
        net.train(*labelled(rng, size), 0.03 * (1 - i / batches) + 0.001)
    return net


# --- spans of texts ----------------------------------------------------------------------------


def window_starts(text: str) -> list[int]:
    """Starts of the windows that hold a digit or an '@', on a grid of STRIDE."""
    last = max(0, -(-(len(text) - WINDOW) // STRIDE))
    cells = np.unique(np.array([m.start() // STRIDE for m in ANCHOR.finditer(text)], np.int64))
    # a cell lies in the window that begins with it and in those before it that reach it
    starts = np.unique((cells[:, None] - np.arange(WINDOW // STRIDE)).clip(0, last))
    return (starts * STRIDE).tolist()


_WEIGHT = 1.0 + np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])


def network_spans(texts: list[str], net: Tagger, batch: int = 256) -> list[list[Span]]:
    """Raw (kind, start, end) of each text by the network alone."""
    jobs = [(i, s) for i, t in enumerate(texts) for s in window_starts(t)]
    codes = {i: classes(texts[i]) for i in {i for i, _ in jobs}}
    sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    out: list[list[Span]] = [[] for _ in texts]

    def finish(i: int) -> None:
        total, weight = sums.pop(i)
        codes.pop(i)
        at = np.flatnonzero(weight > 0)
        for part in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
            tags = viterbi(total[part] / weight[part][:, None], net.p["t"])
            for j in np.flatnonzero(tags % 2 == 1):
                e = j + 1
                while e < len(tags) and tags[e] == tags[j] + 1:
                    e += 1
                out[i].append(((int(tags[j]) - 1) // 2, int(part[0] + j), int(part[0] + e)))

    open_now = None
    for a in range(0, len(jobs), batch):
        group = jobs[a : a + batch]
        x = np.full((len(group), WINDOW), 4)
        for r, (i, s) in enumerate(group):
            piece = codes[i][s : s + WINDOW]
            x[r, : len(piece)] = piece
        emit = net.emissions(x)
        for r, (i, s) in enumerate(group):
            if open_now is not None and i != open_now:
                finish(open_now)
            open_now = i
            n = min(WINDOW, len(codes[i]) - s)
            total, weight = sums.setdefault(i, (np.zeros((len(codes[i]), TAGS)), np.zeros(len(codes[i]))))
            total[s : s + n] += emit[r, :n] * _WEIGHT[:n, None]
            weight[s : s + n] += _WEIGHT[:n]
    if open_now is not None:
        finish(open_now)
    return out


# forms that a span of the network must have, whole
_FORMS = (
    re.compile(r"[\w.%+-]+ ?@ ?[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    re.compile(r"[0-9]{1,3}( ?\. ?[0-9]{1,3}){3}"),
    re.compile(r"[0-9]+([ .-][0-9]+)*"),
    re.compile(r"(\+|00)?[0-9]*[ .-]?(\([0-9]{2,5}\))?[0-9]*([ .-][0-9]+)+"),
)

#: No number of 19 digits, blanks and marks between them included, is longer.
LONGEST = 48


def sound(text: str, span: Span) -> bool:
    kind, a, b = span
    if kind and b - a > LONGEST:
        return False
    s = text[a:b]
    if not _FORMS[kind].fullmatch(s) or (a and text[a - 1].isalnum() and text[a].isalnum()) or (b < len(text) and text[b].isalnum()):
        return False
    d = _digits(s)
    if kind == 1:
        return all(int(p) <= 255 for p in re.split(r"[ .]+", s))
    if kind == 2:
        return 13 <= len(d) <= 19 and luhn(d)
    return kind == 0 or 9 <= len(d) <= 15


def all_spans(texts: list[str], net: Tagger) -> tuple[list[list[Span]], list[list[Span]]]:
    """Base spans and all spans of each text, by kind and start."""
    base = [base_spans(t) for t in texts]
    whole = []
    for text, mine, more in zip(texts, base, network_spans(texts, net)):
        taken, held = list(mine), sorted((a, b) for _, a, b in mine)
        reach = np.maximum.accumulate([b for _, b in held]) if held else np.zeros(0, int)
        begins, last = np.array([a for a, _ in held], int), 0
        for span in more:
            a, b = span[1], span[2]
            while a < b and text[a] in " .,;:\n-":
                a += 1
            while a < b and text[b - 1] in " .,;:\n-":
                b -= 1
            span = (span[0], a, b)
            before = int(np.searchsorted(begins, b)) - 1  # spans that begin before this one's end
            if a < b and a >= last and (before < 0 or reach[before] <= a) and sound(text, span):
                taken.append(span)
                last = b
        whole.append(sorted(taken))
    return base, whole


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _find(net: Tagger, mask: bool) -> Mapper:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                at = batch.schema.get_field_index("__text")
                texts = [t or "" for t in batch.column(at).to_pylist()]
                live = [i for i, t in enumerate(texts) if ANCHOR.search(t)]
                base, every = [[] for _ in texts], [[] for _ in texts]
                for i, b, e in zip(live, *all_spans([texts[i] for i in live], net)):
                    base[i], every[i] = b, e
                out = batch.remove_column(at)
                for k, name in enumerate(KINDS):
                    out = out.append_column(f"n_{name}", pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()))
                out = out.append_column("base_sha256", pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b in base])).append_column("spans", pa.array([_joined(e) for e in every], pa.string()))
                yield out.append_column("masked", pa.array([masked(t, e) if e else t for t, e in zip(texts, every)], pa.string())) if mask else out

    return run


def personal_data(docs: DataFrame, text_col: str = "text", mask: bool = True) -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone and base_sha256 of the patterns' spans, spans (all), and masked, the text without them.

    Offsets count code points, ends are exclusive. A null or empty text has no spans and gives an empty masked text. Columns of docs
    that bear a result's name are replaced; every row gives a row.
    """
    made = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "masked", "__text")
    kept = docs.select(*[c for c in docs.columns if c not in made], F.col(text_col).cast("string").alias("__text"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema.fields if f.name != "__text")
    net = tagger()
    return kept.mapInArrow(_find(net, mask), schema + "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string" + ", masked string" * mask)
