"""SentencePiece encoding and decoding by shortest paths through composed transducers.

A model file is compiled once per Python worker into

* a normaliser transducer: the character map's arcs, or one arc for each character that writes itself,
  and for a space the space mark; a dummy prefix and squeezed spaces where the model says so,
* a piece transducer: a state for each beginning of a piece, an arc for each character, and the id of the
  piece in the states where one ends,
* byte arcs, that write the bytes of a character that no piece holds.

Composition is lazy: the states of the piece transducer are walked from each position of what the
normaliser writes for the input, and each piece that ends relaxes the position behind it (min, +). A
position keeps the length and the piece of its best arc as two integers, so memory is linear in the
text, also in one without a space.

Unigram models weigh an arc by the negated log probability. In a BPE model an arc may only follow a
piece with which it is *stable*: merging the two pieces' characters must give the two pieces again. Any
other succession weighs infinity. A sequence whose neighbours are all stable is what merging gives, so
exactly one path to each position has a finite weight, and the shortest path is the library's own.

No piece of common vocabularies has a space mark behind another character. Then every mark that
follows another character is a cut vertex of the lattice, the shortest path is the concatenation
of the paths of the parts, and a worker remembers the paths of parts it has met (bounded).
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrowed, small_batches

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: SentencePiece's distance of an unknown character below the worst piece of a unigram model.
UNKNOWN_PENALTY = 10.0
#: Parts, and pairs of pieces, that a worker remembers; longer parts are not remembered.
MEMO_PARTS, MEMO_PAIRS, MEMO_LENGTH = 200_000, 400_000, 200
NO_PIECE = float("inf")
#: Ids whose surfaces are gathered at a time.
GATHERED = 500_000


def _fields(buf: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protocol-buffer message."""

    def varint(i: int) -> tuple[int, int]:
        x = s = 0
        while True:
            b = buf[i]
            i += 1
            x |= (b & 127) << s
            if b < 128:
                return x, i
            s += 7

    i = 0
    while i < len(buf):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            n, i = varint(i)
            value, i = buf[i : i + n], i + n
        elif kind == 5:
            value, i = struct.unpack("<f", buf[i : i + 4])[0], i + 4
        else:
            value, i = buf[i : i + 8], i + 8
        yield key >> 3, value


class CharMap:
    """The normaliser's longest-match character map, kept by the model as a double-array trie."""

    def __init__(self, blob: bytes):
        n = struct.unpack("<I", blob[:4])[0]
        self.units = struct.unpack(f"<{n // 4}I", blob[4 : 4 + n])
        self.texts = blob[4 + n :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        units, found = self.units, None
        node = units[0] >> 10 << ((units[0] & 0x200) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node] if node < len(units) else 0
            if unit & 0x800000FF != data[i]:
                break
            node ^= unit >> 10 << ((unit & 0x200) >> 6)
            if unit & 0x100:
                start = units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.texts[start : self.texts.index(b"\0", start)]
        return found

    def apply(self, text: str) -> str:
        data, out, i = text.encode(), [], 0
        while i < len(data):
            got = self.longest(data, i)
            if got:
                out.append(got[1])
                i += got[0]
            else:
                n = 1 + (data[i] >= 0xC0) + (data[i] >= 0xE0) + (data[i] >= 0xF0)
                out.append(data[i : i + n])
                i += n
        return b"".join(out).decode("utf-8", "replace")


def piece_states(ids: dict[str, int]) -> dict:
    """Start state of the piece transducer. A state maps a character to its arc: the piece that ends there, or -1, and the next state."""
    arcs: dict = {}
    for piece, i in ids.items():
        state = arcs
        for ch in piece[:-1]:
            state = state.setdefault(ch, [-1, {}])[1]
        state.setdefault(piece[-1], [-1, {}])[0] = i
    return arcs


class Paths(dict):
    """Part of an input -> its shortest path, as little-endian int32 piece ids.

    Once MEMO_PARTS are held they become the old ones, of which those met again are taken over.
    """

    def __init__(self, codec: Codec, prefix: str):
        self.codec, self.prefix, self.old = codec, prefix, {}

    def __missing__(self, part: str) -> bytes:
        if len(self) >= MEMO_PARTS:
            self.old = dict(self)
            self.clear()
        out = self.old.get(part)
        if out is None:
            out = self.codec.path(self.prefix + part)
            if len(part) > MEMO_LENGTH:
                return out
        self[part] = out
        return out


class Codec:
    """A model file compiled into its transducers."""

    def __init__(self, model: bytes):
        self.kind, self.dummy, self.squeeze, self.escape = UNIGRAM, True, True, True
        self.charmap, self.byte_fallback = None, False
        pieces: list[tuple[str, float, int]] = []
        for number, value in _fields(model):
            if number == 1:
                f = dict(_fields(value))
                pieces.append((f.get(1, b"").decode(), f.get(2, 0.0), f.get(3, NORMAL)))
            elif number == 2:
                f = dict(_fields(value))
                self.kind, self.byte_fallback = f.get(3, UNIGRAM), bool(f.get(35, 0))
            elif number == 3:
                f = dict(_fields(value))
                self.dummy, self.squeeze, self.escape = bool(f.get(3, 1)), bool(f.get(4, 1)), bool(f.get(5, 1))
                self.charmap = CharMap(f[2]) if f.get(2) else None
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError(f"model type {self.kind} is neither unigram nor BPE")
        if any(kind == USER for _, _, kind in pieces):
            raise ValueError("user-defined pieces are not supported")
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.score = {p: s for p, s, kind in pieces if kind == NORMAL}
        self.cost = {p: -s for p, s in self.score.items()}
        self.unknown = next((i for i, x in enumerate(pieces) if x[2] == UNKNOWN), 0)
        self.bytes_at = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.longest = max(map(len, self.ids), default=1)
        self.worst = min(self.score.values(), default=0.0) - UNKNOWN_PENALTY
        self.cuts = not any(MARK in p.lstrip(MARK) for p in self.ids)
        #: A line end that no piece holds is a cut vertex too.
        self.line_end = struct.pack("<i", self.bytes_at[10]) if self.byte_fallback and 10 in self.bytes_at and not any("\n" in p for p in self.ids) else None
        self.surface = [
            bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(MARK, " ").encode()
            for p, _, kind in pieces
        ]
        self.surface_bytes = np.frombuffer(b"".join(self.surface), np.uint8)
        self.surface_size = np.array([len(x) for x in self.surface], np.int64)
        self.surface_start = np.cumsum(self.surface_size) - self.surface_size
        self.start = piece_states(self.ids)
        self.text_of = {i: p for p, i in self.ids.items()}
        self.weight = {i: -self.score[p] for p, i in self.ids.items()}
        self.stable_after: dict[int, dict[int, bool]] = {}
        self.known_pairs = 0
        self.after_mark, self.at_start = Paths(self, MARK), Paths(self, "")

    def normalise(self, text: str) -> str:
        """Output of the normaliser transducer."""
        if self.charmap:
            text = self.charmap.apply(text)
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if text and self.dummy:
            text = " " + text
        return text.replace(" ", MARK) if self.escape else text

    def merged(self, text: str) -> list[str]:
        """Merge neighbours, best piece first and leftmost among equals, until none can be merged."""
        parts, cost, no = list(text), self.cost, NO_PIECE
        costs = [cost.get(a + b, no) for a, b in zip(parts, parts[1:])]
        while costs and (best := min(costs)) < no:
            k = costs.index(best)
            joined = parts[k] = parts[k] + parts.pop(k + 1)
            del costs[k]
            if k:
                costs[k - 1] = cost.get(parts[k - 1] + joined, no)
            if k < len(costs):
                costs[k] = cost.get(joined + parts[k + 1], no)
        return parts

    def stable(self, left: int, right: int) -> bool:
        """Whether the arc of symbol ``right`` has a finite weight in a BPE model after ``left`` (-1: at the start).

        A symbol is the id of a piece, or -2 - code point for a character without one.
        """
        self.known_pairs += 1
        own = [self.text_of[x] if x >= 0 else chr(-2 - x) for x in (left, right) if x != -1]
        out = self.stable_after.setdefault(left, {})[right] = self.merged("".join(own)) == own
        return out

    def relaxed_bpe(self, text: str, back: list[int], symbol: list[int]) -> None:
        """The one arc of finite weight into each position: its length in ``back``, what it writes in ``symbol``."""
        start, longest, known = self.start, self.longest, self.stable_after
        if self.known_pairs > MEMO_PAIRS:
            known.clear()
            self.known_pairs = 0
        for i in range(len(text)):
            before, state, j = symbol[i], start, i
            after = known.get(before) or known.setdefault(before, {})
            for ch in text[i : i + longest]:
                arc = state.get(ch)
                if arc is None:
                    break
                piece, state = arc
                j += 1
                if piece >= 0 and not back[j]:
                    ok = after.get(piece)
                    if ok or (ok is None and self.stable(before, piece)):
                        back[j], symbol[j] = j - i, piece
            if not back[i + 1]:  # no piece ends here, not even one of one character
                back[i + 1], symbol[i + 1] = 1, -2 - ord(text[i])

    def relaxed_unigram(self, text: str, back: list[int], symbol: list[int]) -> None:
        """The arc of least cost into each position."""
        start, longest, weight = self.start, self.longest, self.weight
        cost = [0.0] + [float("inf")] * len(text)
        for i in range(len(text)):
            own, state, j = cost[i], start, i
            for ch in text[i : i + longest]:
                arc = state.get(ch)
                if arc is None:
                    break
                piece, state = arc
                j += 1
                if piece >= 0 and own + weight[piece] < cost[j]:
                    cost[j], back[j], symbol[j] = own + weight[piece], j - i, piece
            if start.get(text[i], (-1,))[0] < 0 and own - self.worst < cost[i + 1]:
                cost[i + 1], back[i + 1], symbol[i + 1] = own - self.worst, 1, -2 - ord(text[i])

    def symbols(self, text: str) -> list[int]:
        """What the shortest path through the lattice of normalised ``text`` writes: ids, or -2 - code point without one."""
        n = len(text)
        back, symbol = [0] * (n + 1), [-1] * (n + 1)
        (self.relaxed_bpe if self.kind == BPE else self.relaxed_unigram)(text, back, symbol)
        out = []
        while n:
            out.append(symbol[n])
            n -= back[n]
        out.reverse()
        return out

    def path(self, text: str) -> bytes:
        """Shortest path through the lattice of normalised ``text``: packed piece ids, byte arcs taken."""
        found = self.symbols(text)
        if min(found, default=0) < 0:
            out: list[int] = []
            for x in found:
                if x >= 0:
                    out.append(x)
                elif self.byte_fallback:
                    out.extend(self.bytes_at[b] for b in chr(-2 - x).encode())
                elif not out or out[-1] != self.unknown:
                    out.append(self.unknown)
            found = out
        return struct.pack(f"<{len(found)}i", *found)

    def encode_packed(self, text: str) -> bytes:
        if not text:
            return b""
        plain = self.charmap is None and self.escape and self.dummy and self.cuts and (self.byte_fallback or self.kind == BPE)
        if plain and not self.squeeze and MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            if "\n" not in text or self.line_end is None:
                return b"".join(map(self.after_mark.__getitem__, text.split(" ")))
            out = []
            for k, line in enumerate(text.split("\n")):
                words = line.split(" ")
                if k:
                    out.append(self.line_end)
                    if words[0]:
                        out.append(self.at_start[words[0]])
                    del words[0]
                out.extend(map(self.after_mark.__getitem__, words))
            return b"".join(out)
        text = self.normalise(text)
        if not (self.cuts and self.byte_fallback):
            return self.path(text)
        return b"".join(map(self.at_start.__getitem__, re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<i4").tolist()

    def decode_packed(self, packed: list[bytes]) -> list[str]:
        """Texts of many packed id sequences; the surfaces of a whole batch are gathered at once."""
        ids = np.frombuffer(b"".join(packed), "<i4")
        sizes = self.surface_size[ids]
        ends = np.cumsum(sizes)
        stretches = []
        for k in range(0, len(ids), GATHERED):
            some = sizes[k : k + GATHERED]
            before = np.cumsum(some) - some
            at = np.repeat(self.surface_start[ids[k : k + GATHERED]] - before, some) + np.arange(some.sum())
            stretches.append(self.surface_bytes[at].tobytes())
        data = b"".join(stretches)
        bounds = np.concatenate([[0], ends])[np.cumsum([0, *(len(p) // 4 for p in packed)])].tolist()
        out = []
        for a, b in zip(bounds, bounds[1:]):
            text = data[a:b].decode("utf-8", "replace")
            out.append(text[1:] if self.dummy and text[:1] == " " else text)
        return out

    def decode(self, ids: list[int]) -> str:
        return self.decode_packed([np.asarray(ids, "<i4").tobytes()])[0]

    def back_of(self, text: str) -> str:
        """What decoding must give for ``text``: its normalised form, marks turned into spaces."""
        if self.charmap is None and not self.squeeze:
            return text.replace(MARK, " ")
        text = self.normalise(text).replace(MARK, " ")
        return text[1:] if self.dummy and text[:1] == " " else text


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The compiled model of this worker."""
    if path not in _codecs:
        with open(path, "rb") as f:
            _codecs[path] = Codec(f.read())
    return _codecs[path]


def encode(docs: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, token_ids array<int>, n_tokens, decoded_sha256 and round_trip of each row.

    ``model`` is the path of the model file on every worker. A null text is an empty one and has
    no tokens. decoded_sha256 is the digest of the text decoded from token_ids; round_trip tells
    whether it is the normalised text (a space mark in a text comes back as a space). Repeated rows
    give repeated results; other columns don't matter; a kept column named like a result's gets _given
    behind its name; an empty table gives no rows. A row's memory is linear in its whole text.
    """
    small_batches(docs.sparkSession)
    source, names, schema = narrowed(docs, keep, "token_ids array<int>, n_tokens bigint, decoded_sha256 string, round_trip boolean", F.col(f"`{text}`"))

    def run(batches):
        c = codec(model)
        for batch in batches:
            texts = [x or "" for x in batch.column(len(names)).to_pylist()]
            packed = [c.encode_packed(x) for x in texts]
            counts = np.array([len(x) // 4 for x in packed], np.int64)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            values = np.frombuffer(b"".join(packed), "<i4")
            digests, same = [], []
            for x, back in zip(texts, c.decode_packed(packed)):
                digests.append(hashlib.sha256(back.encode()).hexdigest())
                same.append(back == c.back_of(x))
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], ids, pa.array(counts), pa.array(digests, pa.string()), pa.array(same)], names=schema.names)

    return source.mapInArrow(run, schema)


def decode(tokens: DataFrame, model: str, ids: str = "token_ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and text, what each row's piece ids stand for (null ids: an empty text); clashing names as in ``encode``."""
    small_batches(tokens.sparkSession)
    source, names, schema = narrowed(tokens, keep, "text string", F.col(f"`{ids}`"))

    def run(batches):
        c = codec(model)
        for batch in batches:
            texts = c.decode_packed([np.asarray(x or [], "<i4").tobytes() for x in batch.column(len(names)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(texts, pa.string())], names=schema.names)

    return source.mapInArrow(run, schema)
