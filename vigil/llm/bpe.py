"""Byte-level BPE encoding and decoding by a lazily determinised transducer.

Encoding. For merges in order of rank, a token sequence is the encoding of its
bytes exactly if every neighbouring pair ``(s, t)`` is *stable*: the merges turn
the bytes of ``s + t`` into ``[s, t]``. So each prefix of a piece has one last
token, and reading left to right one needs the last tokens of only those earlier
places at which a longer vocabulary entry may still begin. A state of the
transducer is that pending stretch: the token before it, its bytes, the last token
of each of its prefixes and the places still open. Where all places at which a later token can begin
lead back to one place, the tokens before it are sure and are emitted: the
lookahead is bounded by the longest entry. States and transitions are made when
first met (:class:`Encoder`) and dropped together beyond ``max_states``.

Decoding. Token bytes go through a state machine over UTF-8 lead and
continuation bytes (:class:`Utf8Stream`), which passes on characters as soon as
they are whole, whatever the chunks.

Work is per row, in Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

import base64
import contextlib
import gc
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import extended
from .wordspans import parts, released

#: States that a worker keeps from task to task where encoding is all it does, and within a task as a stage among others.
MAX_STATES, STAGE_STATES = 300_000, 120_000
#: Pieces whose encodings a worker remembers.
MAX_PIECES = 400_000
#: Texts up to so many characters are split into pieces at once.
AT_ONCE = 1 << 20


def read_ranks(lines) -> dict[bytes, int]:
    """Ranks from the lines of a rank file: base64 of the token, its rank."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class _State:
    """One state: the token before the pending bytes, these bytes, the last token of each of their prefixes, and the
    places among them at which a later token may still begin; ``moves`` are the transitions made so far."""

    __slots__ = ("before", "pending", "lasts", "live", "moves")

    def __init__(self, before, pending, lasts, live):
        self.before, self.pending, self.lasts, self.live, self.moves = before, pending, lasts, live, {}


class Encoder:
    """The transducer of one vocabulary. ``encode`` takes the bytes of one piece."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.length = {v: len(k) for k, v in ranks.items()}
        self.prefixes = {t[:i] for t in ranks for i in range(1, len(t))}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.stable_pairs: dict[tuple[int | None, int], bool] = {}
        self._forget()

    def forget(self):
        """Drop all states and pairs, as at the end of a task: a worker that lives on keeps the vocabulary only."""
        self.stable_pairs.clear()
        self._forget()

    def _forget(self):
        """Drop all states; moves still held lead to states that are no longer shared, which is harmless."""
        self.states: dict[tuple, _State] = {}
        self.start = _State(None, b"", (), (0,))
        gc.collect()  # states lead back to one another

    def halved(self, t: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``t``, None for a single byte (or a token that merges never make)."""
        if t not in self.halves:
            whole = self.bytes_of[t]
            parts = [whole[i:i + 1] for i in range(len(whole))]
            while len(parts) > 2:
                found = [(self.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.ranks]
                if not found or min(found)[0] >= t:
                    break
                _, i = min(found)
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
            self.halves[t] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[t]

    def stable(self, s: int | None, t: int) -> bool:
        """Whether merges leave the neighbours ``s`` and ``t`` apart.

        Taking the two tokens' last merges back, the latest first, shows the tokens that met at the border at each
        moment. The pair falls if at some moment those two would have merged before the next merge that took place;
        of equal ranks the left place goes first.
        """
        if s is None:
            return self.length[t] == 1 or self.halved(t) is not None
        known = self.stable_pairs.get((s, t))
        if known is not None:
            return known
        left, right, before = s, t, None  # before: (rank, side) of the merge just taken back; the left side goes first
        known = True
        while True:
            meeting = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if meeting is not None and (before is None or (meeting, 1) < before):
                known = False
                break
            undo_left, undo_right = self.halved(left), self.halved(right)
            if undo_left and (not undo_right or left > right):
                before, left = (left, 0), undo_left[1]
            elif undo_right:
                before, right = (right, 2), undo_right[0]
            else:
                break
        if len(self.stable_pairs) > self.max_states:
            self.stable_pairs.clear()
        self.stable_pairs[s, t] = known
        return known

    def step(self, state: _State, byte: int) -> tuple[_State, tuple[int, ...]]:
        """The state after one more byte, and the tokens that are sure by then."""
        pending, lasts, before = state.pending + bytes((byte,)), state.lasts, state.before
        last, live = None, []
        for start in state.live:  # a token that ends here began where one could
            tail = pending[start:]
            if last is None:
                t = self.ranks.get(tail)
                if t is not None and self.stable(lasts[start - 1] if start else before, t):
                    last = t
            if tail in self.prefixes:
                live.append(start)
        lasts += (last,)
        n = len(pending)
        if last is not None:
            live.append(n)
        sure, out, length = live[0], [], self.length
        for place in live[1:]:  # the farthest place that all places in `live` lead back to
            while place != sure:
                if place > sure:
                    place -= length[lasts[place - 1]]
                else:
                    sure -= length[lasts[sure - 1]]
        if sure:
            at = sure
            while at:
                out.append(lasts[at - 1])
                at -= length[lasts[at - 1]]
            before, pending = lasts[sure - 1], pending[sure:]
            lasts = tuple([t if t is not None and length[t] <= i else None for i, t in enumerate(lasts[sure:], 1)])
            live = [x - sure for x in live]
        if live[0]:
            before = None  # no later token begins where it would matter
        key = (before, pending, lasts)
        found = self.states.get(key)
        if found is None:
            if len(self.states) > self.max_states:
                self._forget()
            found = self.states[key] = _State(before, pending, lasts, tuple(live))
        return found, tuple(reversed(out))

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if not piece:
            return []
        out, state = [], self.start
        for byte in piece[:-1]:
            move = state.moves.get(byte)
            if move is None:
                move = state.moves[byte] = self.step(state, byte)
            state, sure = move
            if sure:
                out += sure
        out += self.final(state, piece[-1])
        return out

    def final(self, state: _State, byte: int) -> list[int]:
        """The tokens of the pending bytes and the last byte of a piece; the state after it is not made."""
        pending, lasts, length = state.pending + bytes((byte,)), state.lasts, self.length
        for at in state.live:
            t = self.ranks.get(pending[at:])
            if t is not None and self.stable(lasts[at - 1] if at else state.before, t):
                rest = [t]
                while at:
                    rest.append(lasts[at - 1])
                    at -= length[rest[-1]]
                return rest[::-1]
        raise ValueError(f"no token ends with byte {byte}")


@contextlib.contextmanager
def uncollected():
    """Without the cyclic collector, which would go through all states again and again; ``_forget`` calls it."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


class Utf8Stream:
    """Incremental UTF-8: ``feed`` returns the characters that are whole by now, ``close`` what is left.

    A byte that can't continue the character begun is replaced (U+FFFD), as is a cut character at the end.
    """

    def __init__(self):
        self.need = self.low = self.high = 0
        self.held = b""

    def feed(self, data: bytes) -> str:
        if not self.need and data.isascii():
            return data.decode("ascii")
        out = []
        for b in data:
            if self.need:
                if self.low <= b <= self.high:
                    self.held, self.need, self.low, self.high = self.held + bytes((b,)), self.need - 1, 0x80, 0xBF
                    if not self.need:
                        out.append(self.held.decode("utf-8"))
                    continue
                out.append("�")
                self.need = 0
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xF4:
                self.need, self.held = 1 + (b >= 0xE0) + (b >= 0xF0), bytes((b,))
                self.low, self.high = {0xE0: 0xA0, 0xF0: 0x90}.get(b, 0x80), {0xED: 0x9F, 0xF4: 0x8F}.get(b, 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def close(self) -> str:
        cut, self.need = self.need, 0
        return "�" if cut else ""


def decode_stream(ids, bytes_of: dict[int, bytes]) -> Iterator[str]:
    """The text of ``ids``, token by token, as far as its characters are whole."""
    stream = Utf8Stream()
    for i in ids:
        yield stream.feed(bytes_of[i])
    yield stream.close()


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, max_states: int = MAX_STATES) -> Encoder:
    """The encoder of the rank file at ``path``, one for each worker process."""
    if (path, max_states) not in _ENCODERS:
        with open(path, "rb") as f:
            _ENCODERS[path, max_states] = Encoder(read_ranks(f), max_states)
    return _ENCODERS[path, max_states]


class Pieces:
    """Remembers, for pieces met, what ``make`` gives for their ids and the bytes decoded from these."""

    def __init__(self, enc: Encoder, make):
        self.enc, self.make, self.known, self.older = enc, make, {}, {}

    def every(self, pieces: list[str]) -> list:
        found = list(map(self.known.get, pieces))
        if None in found:
            found = [self(p) if f is None else f for f, p in zip(found, pieces)]
        return found

    def __call__(self, piece: str):
        found = self.known.get(piece)
        if found is None:
            if len(self.known) >= MAX_PIECES // 2:
                self.known, self.older = {}, self.known
            found = self.older.get(piece)
            if found is None:
                ids = self.enc.encode(piece.encode("utf-8"))
                stream = Utf8Stream()
                text = stream.feed(b"".join([self.enc.bytes_of[i] for i in ids])) + stream.close()
                found = self.make(ids, piece if text == piece else text)  # one copy of equal strings is enough
            self.known[piece] = found
        return found


_DIGESTED: dict[str, Pieces] = {}


def digested(path: str) -> Pieces:
    """Number of tokens, ids as said in digests and text of every piece, for each worker process one, kept from task to task."""
    if path not in _DIGESTED:
        enc = encoder(path)
        said = {i: b",%d" % i for i in enc.bytes_of}
        _DIGESTED[path] = Pieces(enc, lambda ids, s: (len(ids), b"".join([said[i] for i in ids]), s))
    return _DIGESTED[path]


def encode_documents(df: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with ``token_ids`` (array<int>) and ``decoded`` (string): the whole text encoded, and decoded again.

    ``pattern`` splits a text into pieces that are encoded separately. A null text counts as empty. Rows stay as they
    are otherwise; columns of the two names are replaced. At the end of a task the worker gives the states back, as
    other stages of the session may need the memory.
    """
    keep = df.drop("token_ids", "decoded")
    schema = extended(keep, {"token_ids": "array<int>", "decoded": "string"})
    names = schema.names

    def run(batches):
        enc = encoder(ranks_path, STAGE_STATES)
        pieces, split = Pieces(enc, lambda ids, s: (np.array(ids, np.int32).tobytes(), s)), regex.compile(pattern)
        with uncollected():
            for batch in batches:
                for lo, hi in parts(batch.column(text), 1 << 20):
                    part = batch.slice(lo, hi - lo)
                    ids, texts, ends = [], [], [0]
                    for value in part.column(text).to_pylist():
                        found = pieces.every(split.findall(value or ""))
                        ids.append(b"".join([x for x, _ in found]))
                        ends.append(ends[-1] + len(ids[-1]) // 4)
                        texts.append("".join([s for _, s in found]))
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                    yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(texts, pa.string())], names=names)
        enc.forget()
        del pieces
        released()

    return keep.mapInArrow(run, schema)


def token_digests(df: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_tokens, ids_sha256 and decoded_sha256 of every text, without shipping the ids."""
    def run(batches):
        made, split = digested(ranks_path), regex.compile(pattern)
        with uncollected():
            for batch in batches:
                rows = []
                for value in batch.column(1):
                    ids, out, n, first = hashlib.sha256(), hashlib.sha256(), 0, True
                    whole = value.as_py() or ""
                    if len(whole) <= AT_ONCE:
                        n, first = feed(made.every(split.findall(whole)), ids, out, n, first)
                    else:
                        found = (m[0] for m in split.finditer(whole))
                        while held := list(itertools.islice(found, 4096)):
                            n, first = feed(made.every(held), ids, out, n, first)
                    rows.append((n, ids.hexdigest(), out.hexdigest()))
                cols = list(zip(*rows)) if rows else [(), (), ()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())],
                                                 names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    def feed(held, ids, out, n, first):
        if held:
            sizes, numbers, texts = zip(*held)
            numbers = b"".join(numbers)
            ids.update(numbers[1:] if first else numbers)
            out.update("".join(texts).encode("utf-8"))
            n, first = n + sum(sizes), False
        return n, first

    narrow = df.select(key, text)
    return narrow.mapInArrow(run, extended(narrow.select(key), {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}))
