"""Byte-level BPE as a streaming transducer with bounded lookahead.

Text goes in by chunks. A pre-token is cut off as soon as no later character can
change it, and its bytes pass through a window: merges run inside the window, and
a token leaves once it ends ``Merges.lookahead`` bytes before the window's end,
because no byte further to the right can change it. Memory is constant however long a text or
a pre-token is. Decoding is an incremental machine from bytes to text.
"""

from __future__ import annotations

import codecs
import heapq
import json
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame

from .common import no_clash, small_batches

#: The pre-token pattern of byte-level vocabularies, and the four kinds of run it is made of.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RUNS = {"L": r"\p{L}*", "N": r"\p{N}*", "O": r"[^\s\p{L}\p{N}]*", "S": r"\s*"}

_PIECE = regex.compile(PATTERN)
_RUN = {k: regex.compile(v) for k, v in RUNS.items()}
#: Characters that may still join the last pre-tokens: a contraction has three.
_HELD = 3


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte: itself if it is printable, else the next letter from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merges:
    """A vocabulary file's merge list, with the lookahead that makes its tokens final."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        self.id_of_byte = [0] * 256
        for letter, b in letters.items():
            self.id_of_byte[b] = vocab[letter]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        #: (left, right) -> rank, and what the merge of each rank makes.
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]
        self.lookahead = self._sufficient_lookahead()
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}

    def _sufficient_lookahead(self) -> int:
        """Bytes right of a token that can decide whether it stays.

        A merge of (u, v) can be undone from the right only by a merge of higher
        priority that takes v, or a symbol on v's right edge before v takes it,
        together with some z. That needs z's bytes and, in turn, whatever decides
        about z. Ranks fall along such a chain, so one pass in rank order adds up
        the longest: ``edge`` for what can break a symbol's right edge from within,
        ``reach`` for what later merges may take the symbol itself.
        """
        edge: dict[int, int] = {}
        reach: dict[int, int] = {}
        for (u, v), r in self.rank.items():
            w = self.made[r]
            look = max(edge.get(v, 0), reach.get(v, 0))
            edge[w] = max(edge.get(w, 0), look)
            reach[u] = max(reach.get(u, 0), len(self.bytes_of[v]) + look)
        return max([0, *edge.values(), *reach.values()])

    def merge(self, ids: list[int]) -> list[int]:
        """All merges of one window, in rank order, from the left within a rank."""
        if len(ids) > 48:
            return self._merge_long(ids)
        get, made, none = self.rank.get, self.made, len(self.made)
        ranks = [get(p, none) for p in zip(ids, ids[1:])]
        while ranks and (r := min(ranks)) < none:
            k = ranks.index(r)
            del ranks[k]
            ids[k : k + 2] = [made[r]]
            if k:
                ranks[k - 1] = get((ids[k - 1], ids[k]), none)
            if k < len(ranks):
                ranks[k] = get((ids[k], ids[k + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of adjacent pairs."""
        get, n = self.rank.get, len(ids)
        ids, right, left = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, *p) for k, p in enumerate(zip(ids, ids[1:])) if (r := get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            r, k, a, b = heapq.heappop(heap)
            j = right[k]
            if ids[k] != a or j >= n or ids[j] != b:
                continue
            ids[k], ids[j], right[k] = self.made[r], -1, right[j]
            if right[k] < n:
                left[right[k]] = k
                if (q := get((ids[k], ids[right[k]]))) is not None:
                    heapq.heappush(heap, (q, k, ids[k], ids[right[k]]))
            if left[k] >= 0 and (q := get((ids[left[k]], ids[k]))) is not None:
                heapq.heappush(heap, (q, left[k], ids[left[k]], ids[k]))
        return [i for i in ids if i >= 0]


class Window:
    """The transducer of one pre-token: bytes in, final token ids out, bounded memory."""

    def __init__(self, merges: Merges, size: int | None = None):
        self.m, self.held = merges, b""
        self.size = size or 4 * (merges.lookahead + 64)

    def feed(self, data: bytes) -> Iterator[int]:
        for at in range(0, len(data), self.size):
            self.held += data[at : at + self.size]
            while len(self.held) > self.size:
                yield from self._emit(len(self.held) - self.m.lookahead)

    def _emit(self, final: int) -> Iterator[int]:
        done = 0
        for t in self.m.merge([self.m.id_of_byte[b] for b in self.held]):
            end = done + len(self.m.bytes_of[t])
            if end > final:
                break
            yield t
            done = end
        self.held = self.held[done:]

    def finish(self) -> Iterator[int]:
        yield from self._emit(len(self.held))


class _Loose(Exception):
    """A word has white space at an end, so what it splits into depends on its neighbours."""


class _Memo(dict):
    """What short keys were coded to before: two generations, so frequent keys stay and memory is bounded."""

    def __init__(self, code: Callable[[str], bytes], entries: int):
        super().__init__()
        self.code, self.entries, self.old = code, entries, {}

    def __missing__(self, key: str) -> bytes:
        ids = self.old.get(key) or self.code(key)
        if len(key) <= 40:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[key] = ids
        return ids


class Encoder:
    """feed(chunk) returns the ids that are final by then; finish() returns the rest."""

    LONG = 4096

    def __init__(self, merges: Merges, memo_entries: int = 100_000):
        self.m = merges
        self.memo = _Memo(self._piece, memo_entries)
        self.words = _Memo(self._word, 3 * memo_entries // 2)
        self.split = regex.compile("|".join(map(regex.escape, sorted(merges.special, key=len, reverse=True))) or r"(?!)")
        self._reset()

    def _piece(self, piece: str) -> bytes:
        data = piece.encode("utf-8", "replace")
        if len(data) <= 48:  # fits in a window as it is
            return array("I", self.m.merge(list(map(self.m.id_of_byte.__getitem__, data)))).tobytes()
        window = Window(self.m)
        return array("I", [*window.feed(data), *window.finish()]).tobytes()

    def _word(self, word: str) -> bytes:
        """A word that stands after a single space and before another, or at the end."""
        if not word or word != word.strip():
            raise _Loose
        first, *rest = _PIECE.findall(" " + word)
        if not rest:
            return self._piece(first)
        return self.memo[first] + b"".join(map(self.memo.__getitem__, rest))

    def _whole(self, text: str) -> bytes:
        """Text that no earlier or later character can split differently."""
        first, *words = text.split(" ")
        try:
            if words and first and first[-1].isspace():
                raise _Loose
            head = b"".join(map(self.memo.__getitem__, _PIECE.findall(first)))
            return head + b"".join(map(self.words.__getitem__, words))
        except _Loose:
            return b"".join(map(self.memo.__getitem__, _PIECE.findall(text)))

    def _reset(self) -> None:
        self.raw, self.text, self.run, self.window = "", "", "", None

    def feed(self, chunk: str) -> bytes:
        """Ids that are final by now, as native unsigned 32-bit integers."""
        raw, out = self.raw + chunk, []
        while found := self.split.search(raw):
            out.append(self._segment(raw[: found.start()], True))
            out.append(array("I", [self.m.special[found.group()]]).tobytes())
            raw = raw[found.end() :]
        keep = self._partial_special(raw)
        self.raw = raw[len(raw) - keep :]
        out.append(self._segment(raw[: len(raw) - keep], False))
        return b"".join(out)

    def finish(self) -> bytes:
        out = self._segment(self.raw, True)
        self._reset()
        return out

    def _partial_special(self, raw: str) -> int:
        """Length of the longest end of raw that may grow into a special token."""
        return max((k for t in self.m.special for k in range(1, min(len(t), len(raw) + 1)) if raw.endswith(t[:k])), default=0)

    def _segment(self, new: str, last: bool) -> bytes:
        text, out = self.text + new, b""
        self.text = ""
        if self.run:
            end = _RUN[self.run].match(text).end()
            if self.run == "S" and (end < len(text) or not last):
                end -= end > 0  # the last white space of a run may belong to what follows
            out = self._stream(text[:end])
            text = text[end:]
            if not last and len(text) == (self.run == "S"):
                self.text = text
                return out
            out += array("I", self.window.finish()).tobytes()
            self.run = ""
        if last:
            return out + self._whole(text)
        cut = text.rfind(" ", max(1, len(text) - self.LONG), len(text) - 1)
        if cut > 0 and not text[cut - 1].isspace() and not text[cut + 1].isspace():
            self.text = text[cut:]
            return out + self._whole(text[:cut])
        pieces, held = _PIECE.findall(text), 0
        while pieces and held < _HELD:
            held += len(pieces.pop())
        self.text = text[len(text) - held :]
        out += b"".join(map(self.memo.__getitem__, pieces))
        return out + self._open_run() if held > self.LONG else out

    def _stream(self, text: str) -> bytes:
        return array("I", self.window.feed(text.encode("utf-8", "replace"))).tobytes()

    def _open_run(self) -> bytes:
        """What is held is one very long pre-token, at least up to its last characters: stream it."""
        text, out = self.text, b""
        while len(first := _PIECE.match(text).group()) < self.LONG // 2:
            out += self.memo[first]
            text = text[len(first) :]
        self.run = "S" if first.isspace() else next(k for k in "LNO" if _RUN[k].fullmatch(first[1:]))
        self.window = Window(self.m)
        lead = 0 if self.run == "S" else 1
        out += self._stream(text[:lead])
        self.text = text[lead:]
        return out + self._segment("", False)

    def encode(self, text: str, chunk: int = 1 << 16) -> array:
        ids = array("I")
        try:
            for at in range(0, len(text), chunk):
                ids.frombytes(self.feed(text[at : at + chunk]))
            ids.frombytes(self.finish())
        except BaseException:  # the encoder is kept for other texts
            self._reset()
            raise
        return ids


class Decoder:
    """feed(ids) returns the text complete by then; a broken sequence becomes U+FFFD."""

    def __init__(self, merges: Merges):
        self.bytes_of = merges.bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self.bytes_of.__getitem__, ids)))

    def finish(self) -> str:
        out = self.state.decode(b"", True)
        self.state.reset()
        return out

    def decode(self, ids: array, step: int = 1 << 15) -> str:
        parts = [self.feed(ids[k : k + step]) for k in range(0, len(ids), step)]
        return "".join([*parts, self.finish()])


@lru_cache(maxsize=4)
def coder(path: str) -> tuple[Encoder, Decoder]:
    """One encoder and decoder a worker and vocabulary file."""
    merges = Merges(path)
    return Encoder(merges), Decoder(merges)


def tokenize(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = (), decode: bool = False,
             finish: Callable[[pd.DataFrame], pd.DataFrame] | None = None, schema: str | None = None) -> DataFrame:
    """Token ids of every whole text, one output row an input row, in no order.

    keep: columns passed through; path: the vocabulary file, readable on every
    executor. Returns keep, ``ids array<bigint>`` and, with decode, ``decoded``.
    finish: a last step on each batch of those columns (digests, counts), so that
    ids need not travel back to the JVM; schema is then its result's schema.
    A null text counts as empty, an empty one has no ids, rows may repeat and keep
    may hold nulls; any other column is ignored. Very long texts are streamed.
    """
    def batches(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, decoder = coder(path)
        for pdf in pdfs:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                out = part[[f"k{i}" for i in range(len(keep))]].set_axis(list(keep), axis=1).reset_index(drop=True)
                ids = [encoder.encode(t or "") for t in part["t"]]
                out["ids"] = ids
                if decode:
                    out["decoded"] = [decoder.decode(i) for i in ids]
                yield finish(out) if finish else out

    no_clash(keep, "ids", *["decoded"] * decode)
    small_batches(df.sparkSession)
    src = df.select(*[df[c].alias(f"k{i}") for i, c in enumerate(keep)], df[text].alias("t"))
    kinds = dict(df.dtypes)
    schema = schema or ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "ids array<bigint>", *["decoded string"] * decode])
    return src.mapInPandas(batches, schema)
