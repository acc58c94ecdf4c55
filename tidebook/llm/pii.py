"""Personal data: exact patterns, and a linear-chain conditional random field beside them.

The field reads stretches of whole words around every word with a digit, an @ or a cue (a spelled-out dot, a word like
password). Its features are word shapes; it is trained on a small labelled table (``pii_examples``) by
gradient steps on the log-likelihood (forward-backward), and decoded by Viterbi,
both in numpy over batches of stretches.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import no_clash, small_batches

KINDS = ["email", "ip", "card", "phone"]
Span = tuple[str, int, int]

# Each pattern finds what the plain one finds from the left; borders and possessive runs only avoid repeated scans.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str | None) -> list[Span]:
    """(kind, start, end) in code points, by start and then by kind as listed."""
    text, found = text or "", []
    at = text.find("@")
    done = 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m and m.end() > at:
            found.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(done, at + 1))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = "".join(_DIGITS.findall(m.group()))
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(len, _DIGITS.findall(m.group()))) <= 15:
                found.append(("phone", m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


#: What the field labels words with; a secret (a password, a token, an access key) is no pattern's.
LABELS = ["", *KINDS, "secret"]
_TRIGGER = re.compile(r"[0-9@]\S*+")
#: Beside words with a digit or an @, words with one of these may be or announce personal data.
CUES = ("passw", "pwd", "secret", "token", "api", "access_key", "dot", "(at)", "[at]")
_CUE = re.compile(r"(?i:[0-9@]|passw|\bpwd|secret|token|\bapi|access_key|\bdot\b|\(at\)|\[at\])\S*+")
_WORD = re.compile(r"\S++")
_BUCKETS = 1 << 14
#: Whole words taken in on both sides of such a word.
REACH = 4
#: Words of a stretch from which on it is decoded by itself, a part of its features at a time.
LONG, PART = 2048, 1024


def stretches(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of words (start, end) around the words that can be personal data; all other words are outside the field."""
    low = text.lower()
    words: list[tuple[int, int]] = []
    done = 0  # where the last word taken in ends
    for m in (_CUE if any(c in low for c in CUES) else _TRIGGER).finditer(text):
        a, b = m.span()
        if a >= done:
            while a > done and not text[a - 1].isspace():
                a -= 1
            left, at = [(a, b)], a
            while len(left) <= REACH:
                while at > done and text[at - 1].isspace():
                    at -= 1
                end = at
                while at > done and not text[at - 1].isspace():
                    at -= 1
                if at == end:
                    break
                left.append((at, end))
            if words and len(left) > REACH and not text[done : left[-1][0]].isspace():
                yield words
                words = []
            words += left[::-1]
            done = b
        after = 0
        while after < REACH and words[-1 - after][0] >= b:
            after += 1
        while after < REACH and (w := _WORD.search(text, done)):
            words.append(w.span())
            done, after = w.end(), after + 1
    if words:
        yield words


#: Classes of letters in a word's shape; other characters stand for themselves.
_CLASS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "abcdefghijklmnopqrstuvwxyz" + "0123456789", "A" * 26 + "a" * 26 + "d" * 10)
_RUN = re.compile(r"(.)\1{2,}", re.S)


def _shape(word: str) -> str:
    """Letters as A or a, digits as d, runs of three or more as two."""
    word = word.translate(_CLASS)
    if not word.isascii():
        word = "".join("d" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in word)
    return _RUN.sub(r"\1\1", word)


def _mixture(core: str) -> str:
    """How a long word mixes letters and digits: what tells a code from a number or a plain word."""
    if len(core) < 10:
        return "short"
    kinds = ("d" * any("0" <= c <= "9" for c in core) + "a" * any("a" <= c <= "z" for c in core) + "A" * any("A" <= c <= "Z" for c in core)
             + "-" * (not core.isalnum()) + "h" * all(c in "0123456789abcdef" for c in core))
    return f"{kinds}{sum(a.isdigit() != b.isdigit() for a, b in zip(core, core[1:])) * 4 // len(core)}"


def _facts(word: str) -> list[str]:
    digits = "".join(_DIGITS.findall(word))
    core = word.strip(".,;:!?$%&*#\"'()[]")
    parts = core.replace("[.]", ".").split(".")
    plain = _DIGITS.sub("", core).lower()
    return [
        "s" + _shape(word), "c" + _shape(core), f"n{min(len(digits), 20)}", f"l{min(len(word), 20)}", "f" + word[:1] * (not word[:1].isalnum()),
        f"@{'@' in word}{'.' in core}", f"u{12 <= len(digits) <= 19 and luhn(digits)}",
        f"q{len(parts) == 4 and all(p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts)}", f"x{all(c in '0123456789abcdef' for c in core)}",
        "w" + (plain if len(plain) < 20 else plain[:4] + "~"), "m" + _mixture(core), "p" + core[:4] * (len(core) > 15), f"={core.partition('=')[0].lower() if 0 < core.find('=') < 20 else ''}",
        f":{core.count(':') > 1}{'=' in core}"]


def features(text: str, words: list[tuple[int, int]]) -> np.ndarray:
    """Hashed features of each word: its own facts, and the shapes of its neighbours."""
    facts = [_facts(text[a:b]) for a, b in words]
    blank = [""] * len(_facts(""))
    out = []
    for k, own in enumerate(facts):
        before, after = (facts[k - 1] if k else blank), (facts[k + 1] if k + 1 < len(facts) else blank)
        names = [*own, "<" + before[0], ">" + after[0], "<" + before[0] + own[1], ">" + after[0] + own[1], "<" + before[9], ">" + after[9],
                 "<" + before[9] + own[10], "<<" + (facts[k - 2][9] if k > 1 else "") + own[10], "b"]
        out.append([zlib.crc32(n.encode("utf-8", "replace")) % _BUCKETS for n in names])
    return np.array(out, dtype=np.int32).reshape(len(words), -1)


def _pad(seqs: list[np.ndarray], fill: int) -> tuple[np.ndarray, np.ndarray]:
    lens = np.array([len(s) for s in seqs])
    out = np.full((len(seqs), lens.max(), *seqs[0].shape[1:]), fill, dtype=seqs[0].dtype)
    for k, s in enumerate(seqs):
        out[k, : len(s)] = s
    return out, lens


@dataclass
class Field:
    """Weights of the field: one row a feature (the last for padding), and label-to-label weights."""

    emit: np.ndarray
    move: np.ndarray

    def viterbi(self, seqs: list[np.ndarray]) -> list[np.ndarray]:
        """The best labels of each stretch, computed for all stretches together."""
        ids, lens = _pad(seqs, _BUCKETS)
        e = self.emit[ids].sum(axis=2)
        n, steps, k = e.shape
        best, back = e[:, 0], np.zeros((n, steps, k), np.int8)
        for t in range(1, steps):
            via = best[:, :, None] + self.move
            back[:, t] = via.argmax(axis=1)
            best = np.where((t < lens)[:, None], via.max(axis=1) + e[:, t], best)
        out, cur = np.zeros((n, steps), np.int8), best.argmax(axis=1)
        rows = np.arange(n)
        for t in range(steps - 1, -1, -1):
            out[:, t] = cur
            cur = np.where((t < lens) & (t > 0), back[rows, t, cur], cur)
        return [out[r, : lens[r]] for r in range(n)]


    def decode_long(self, text: str, words: list[tuple[int, int]]) -> np.ndarray:
        """The best labels of one stretch of any length; only one byte a word and label is kept of it."""
        k = len(LABELS)
        back, best = np.zeros((len(words), k), np.int8), np.zeros(k)
        for lo in range(0, len(words), PART):
            hi, from_ = min(lo + PART, len(words)), max(0, lo - 2)
            e = self.emit[features(text, words[from_ : hi + 1])[lo - from_ : hi - from_]].sum(axis=1)
            for t in range(lo, hi):
                if t:
                    via = best[:, None] + self.move
                    back[t] = via.argmax(axis=0)
                    best = via.max(axis=0) + e[t - lo]
                else:
                    best = e[0]
        out, cur = np.zeros(len(words), np.int8), int(best.argmax())
        for t in range(len(words) - 1, -1, -1):
            out[t] = cur
            cur = int(back[t, cur])
        return out


def fit_field(seqs: list[np.ndarray], labels: list[np.ndarray], epochs: int = 12, rate: float = 0.3, batch: int = 64, l2: float = 1e-4) -> Field:
    """Gradient steps (scaled by each weight's past gradients) on the log-likelihood; labels everything as nothing without rows."""
    k = len(LABELS)
    field = Field(np.zeros((_BUCKETS + 1, k)), np.zeros((k, k)))
    past_e, past_m = np.full((_BUCKETS + 1, k), 1e-6), np.full((k, k), 1e-6)
    order = sorted(range(len(seqs)), key=lambda r: len(seqs[r]))
    groups = [order[lo : lo + batch] for lo in range(0, len(order), batch)]
    turn = np.random.default_rng(5)
    for _ in range(epochs):
        for g in turn.permutation(len(groups)):
            ids, lens = _pad([seqs[r] for r in groups[g]], _BUCKETS)
            gold, _ = _pad([labels[r].astype(np.int64) for r in groups[g]], 0)
            e = field.emit[ids].sum(axis=2)
            n, steps, _ = e.shape
            live = np.arange(steps) < lens[:, None]
            fwd, bwd = np.zeros_like(e), np.zeros_like(e)
            fwd[:, 0] = e[:, 0]
            for t in range(1, steps):
                new = np.logaddexp.reduce(fwd[:, t - 1, :, None] + field.move, axis=1) + e[:, t]
                fwd[:, t] = np.where(live[:, t, None], new, fwd[:, t - 1])
            for t in range(steps - 2, -1, -1):
                new = np.logaddexp.reduce(field.move + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], axis=2)
                bwd[:, t] = np.where(live[:, t + 1, None], new, 0)
            z = np.logaddexp.reduce(fwd[:, -1], axis=1)
            p = np.exp(fwd + bwd - z[:, None, None]) * live[:, :, None]
            p[np.arange(n)[:, None], np.arange(steps), gold] -= live
            ge, gm = np.zeros_like(field.emit), np.zeros_like(field.move)
            np.add.at(ge, ids.reshape(-1, ids.shape[2]), p.reshape(-1, 1, k))
            for t in range(1, steps):
                pair = np.exp(fwd[:, t - 1, :, None] + field.move + (e[:, t] + bwd[:, t])[:, None, :] - z[:, None, None])
                gm += (pair * live[:, t, None, None]).sum(axis=0)
                np.subtract.at(gm, (gold[live[:, t], t - 1], gold[live[:, t], t]), 1)
            ge, gm = ge / n + l2 * field.emit, gm / n + l2 * field.move
            past_e += ge**2
            past_m += gm**2
            field.emit -= rate * ge / np.sqrt(past_e)
            field.move -= rate * gm / np.sqrt(past_m)
            field.emit[_BUCKETS] = 0
    return field


def train(labelled: list[tuple[str, list[Span]]]) -> Field:
    """A field from a small labelled table: texts and their spans. The same table gives the same field."""
    seqs, labels = [], []
    for x, known in labelled:
        for words in stretches(x):
            lab = np.zeros(len(words), np.int8)
            for kind, a, b in known:
                for k, (lo, hi) in enumerate(words):
                    if lo < b and a < hi:
                        lab[k] = LABELS.index(kind)
            seqs.append(features(x, words))
            labels.append(lab)
    return fit_field(seqs, labels)


def _trim(text: str, a: int, b: int, kind: str) -> tuple[int, int]:
    """Punctuation at the ends of a span's words is not part of it."""
    while a < b and not (text[a].isalnum() or (kind == "phone" and text[a] in "+(")):
        a += 1
    while b > a and not text[b - 1].isalnum():
        b -= 1
    return a, b


def added_spans(texts: list[str], base: list[list[Span]], field: Field) -> list[list[Span]]:
    """What the field finds and no base span overlaps."""
    found, seqs, places = [[] for _ in texts], [], []

    def take(row: int, words: list[tuple[int, int]], lab: np.ndarray) -> None:
        starts = np.flatnonzero(np.append(True, lab[1:] != lab[:-1]))
        for k, end in zip(starts.tolist(), [*starts[1:].tolist(), len(lab)]):
            if lab[k]:
                kind = LABELS[lab[k]]
                a, b = _trim(texts[row], words[k][0], words[end - 1][1], kind)
                if a < b:
                    found[row].append((kind, a, b))

    def decode() -> None:
        for (row, words), lab in zip(places, field.viterbi(seqs)):
            take(row, words, lab)
        seqs.clear(), places.clear()

    size = 0
    for row, text in enumerate(texts):
        for words in stretches(text):
            if len(words) >= LONG:
                take(row, words, field.decode_long(text, words))
                continue
            seqs.append(features(text, words))
            places.append((row, words))
            size = max(size, len(words))
            if size * len(seqs) > 20_000:
                decode()
                size = 0
    if seqs:
        decode()
    return [_apart(sorted(x, key=lambda s: s[1]), b) for x, b in zip(found, base)]


def _apart(more: list[Span], base: list[Span]) -> list[Span]:
    """Those of more, which do not overlap each other, that overlap none of base; both by start."""
    out, k, reach = [], 0, 0
    for s in more:
        while k < len(base) and base[k][1] < s[2]:
            reach = max(reach, base[k][2])
            k += 1
        if reach <= s[1]:
            out.append(s)
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(df: DataFrame, field: Field, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, base and spans (arrays of kind, start, end) of every whole text, one output row an input row.

    base has what the patterns find; spans adds what only the field finds, where no base span is: other forms of
    the four kinds, and secrets. Null and empty texts have none. Offsets are code points, ends exclusive. keep may hold
    nulls; rows may repeat.
    """
    def batches(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for lo in range(0, max(1, len(pdf)), 100):
                part = pdf.iloc[lo : lo + 100].reset_index(drop=True)
                out = part[[f"k{i}" for i in range(len(keep))]].set_axis(list(keep), axis=1)
                texts = [t or "" for t in part["x"]]
                base = [base_spans(t) for t in texts]
                more = added_spans(texts, base, field)
                as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
                out["base"] = [as_rows(b) for b in base]
                out["spans"] = [as_rows(sorted(b + m, key=lambda s: (s[1], LABELS.index(s[0])))) for b, m in zip(base, more)]
                yield out

    no_clash(keep, "base", "spans")
    small_batches(df.sparkSession)
    kinds = dict(df.dtypes)
    src = df.select(*[df[c].alias(f"k{i}") for i, c in enumerate(keep)], df[text].alias("x"))
    one = "array<struct<kind:string,start:bigint,end:bigint>>"
    return src.mapInPandas(batches, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"base {one}, spans {one}"]))
