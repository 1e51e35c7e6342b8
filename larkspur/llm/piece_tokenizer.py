"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The model file is parsed here (it is a protocol buffer with a few fields);
the sentencepiece library is not used. A text becomes flat numpy symbol
arrays over its distinct words; each round finds, for every word at once, the
adjacent pair of the least rank (leftmost on ties), merges all leftmost
non-overlapping occurrences of that pair up to the first merge that creates a
pair the library would take first, and compacts the arrays, until no pair is
left. Words are cut only where no piece of the vocabulary can cross: before a
space mark that follows another symbol, and around characters that no longer
piece holds. Words of over LONG symbols (texts without spaces) are cut again
and again while they are merged, between any two neighbours whose joint text
lies in no piece, so that a round merges the least pair of each part.

Supported models: BPE, identity normalisation, byte fallback or not. Others
are refused when the model is loaded.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from larkspur.llm.shingles import Spans, text_slices

MARK = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_NONE = np.iinfo(np.int64).max
_MISSING = repeat(-1)
_SLOTS = 1 << 18  # of the hash table of pairs
LONG = 256  # symbols; longer words are cut between neighbours that no piece holds together
LONG_RUN = 1 << 20  # symbols of such words merged at once, unless one part is longer
SLICE = 1 << 20  # bytes of texts encoded at once
MEMO_LIMIT = 200_000  # distinct words remembered by one Python worker


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer message's fields."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 5:
            value, at = data[at : at + 4], at + 4
        elif kind == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        else:
            raise ValueError(f"wire type {kind} in a model file")
        yield key >> 3, value


def _slot(pairs: np.ndarray) -> np.ndarray:
    """The first place of each pair in the table."""
    return (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(46)).astype(np.int64)


class _Memo(dict):
    """Words seen so far, by hash -> index into the arrays of their ids and second hashes."""

    def __init__(self):
        super().__init__()
        self.ids = np.empty(0, dtype=np.uint32)
        self.first = self.count = np.empty(0, dtype=np.int64)
        self.check = np.empty(0, dtype=np.uint64)

    def add(self, keys: list[int], check: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        self.update(zip(keys, range(len(self), len(self) + len(keys))))
        self.check = np.concatenate((self.check, check))
        self.first = np.concatenate((self.first, len(self.ids) + np.cumsum(count) - count))
        self.count = np.concatenate((self.count, count))
        self.ids = np.concatenate((self.ids, ids))


def _supported(model: bytes) -> tuple[list[tuple[str, float, int]], dict, dict]:
    """Pieces (text, score, kind), trainer and normalizer fields; what isn't supported is refused."""
    pieces: list[tuple[str, float, int]] = []
    trainer, normalizer = {}, {}
    for number, value in _fields(model):
        if number == 1:
            own = dict(_fields(value))
            score = struct.unpack("<f", own[2])[0] if 2 in own else 0.0
            pieces.append((own.get(1, b"").decode("utf-8"), score, own.get(3, _NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normalizer = dict(_fields(value))
    if trainer.get(3, 1) != 2:
        raise ValueError("not a BPE model")
    if normalizer.get(2, b"") or normalizer.get(4, 1) or not normalizer.get(5, 1) or trainer.get(24, 0):
        raise ValueError("only identity normalisation without white space removal is supported")
    if any(kind in (_USER, _UNUSED) for _, _, kind in pieces):
        raise ValueError("user-defined and unused pieces are not supported")
    return pieces, trainer, normalizer


def check_model(model: bytes) -> None:
    """Refuses a model that isn't supported, without making its tables."""
    _supported(model)


class PieceModel:
    """Tables for encoding and decoding, made from the bytes of a model file."""

    def __init__(self, model: bytes):
        pieces, trainer, normalizer = _supported(model)
        self.dummy_prefix = bool(normalizer.get(3, 1))
        self.byte_fallback = bool(trainer.get(35, 0))
        self.pieces = pieces
        self.unknown = next(i for i, p in enumerate(pieces) if p[2] == _UNKNOWN)
        control = {p[0]: i for i, p in enumerate(pieces) if p[2] == _CONTROL}
        self.begin, self.end = control.get("<s>"), control.get("</s>")
        self.byte_ids = np.full(256, self.unknown, dtype=np.int64)
        for i, (text, _, kind) in enumerate(pieces):
            if kind == _BYTE:
                self.byte_ids[int(text[3:5], 16)] = i
        self._pairs()
        surfaces = [self._surface(i) for i in range(len(pieces))]
        self.surface = np.frombuffer(b"".join(surfaces), dtype=np.uint8)
        self.surface_size = np.array([len(x) for x in surfaces], dtype=np.int64)
        self.surface_first = np.cumsum(self.surface_size) - self.surface_size
        self.is_control = np.array([p[2] == _CONTROL for p in pieces])
        self.parts: np.ndarray | None = None  # hashes of all texts of two characters or more within a piece, made for the first long word
        self.memo = _Memo()

    def _pairs(self) -> None:
        symbols: dict[str, int] = {p[0]: i for i, p in enumerate(self.pieces) if p[2] == _NORMAL}
        normal = dict(symbols)
        for text in normal:
            for ch in text:  # a character that is no piece can still be merged into one
                symbols.setdefault(ch, len(self.pieces) + len(symbols))
        self.width = 1 << max(symbols.values(), default=1).bit_length()
        scores = sorted({self.pieces[i][1] for i in normal.values()}, reverse=True)
        rank_of = {s: r for r, s in enumerate(scores)}
        keys, merged, ranks = [], [], []
        for text, i in normal.items():
            for cut in range(1, len(text)):
                a, b = symbols.get(text[:cut]), symbols.get(text[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.width + b)
                    merged.append(i)
                    ranks.append(rank_of[self.pieces[i][1]])
        pairs = dict(zip(keys, zip(ranks, merged)))
        if len(pairs) * 2 > _SLOTS:
            raise ValueError("more pairs than the table is made for")
        self.slots = np.full(_SLOTS, -2, dtype=np.int64)
        self.slot_rank, self.slot_made = np.zeros(_SLOTS, dtype=np.int64), np.zeros(_SLOTS, dtype=np.int64)
        self.probes = 1
        for key, at in zip(keys, _slot(np.array(keys, dtype=np.int64)).tolist()):
            probe = 1
            while self.slots[at] not in (-2, key):
                at, probe = (at + 1) & (_SLOTS - 1), probe + 1
            self.slots[at] = key
            self.slot_rank[at], self.slot_made[at] = pairs[key]
            self.probes = max(self.probes, probe)
        self.symbol_of = np.full(0x110000, -1, dtype=np.int32)
        for ch, i in symbols.items():
            if len(ch) == 1:
                self.symbol_of[ord(ch)] = i
        if any(a != MARK and b == MARK for text in normal for a, b in zip(text, text[1:])):
            raise ValueError("a piece goes on across a word's end")
        inner = {ch for text in normal if len(text) > 1 for ch in text}
        self.alone = np.zeros(256, dtype=bool)
        self.alone[[ord(ch) for ch in "\n\t\r" if ch not in inner]] = True

    def _surface(self, i: int) -> bytes:
        text, _, kind = self.pieces[i]
        if kind == _BYTE:
            return bytes([int(text[3:5], 16)])
        if kind == _CONTROL:
            return b""
        if kind == _UNKNOWN:
            return " ⁇ ".encode()
        return text.replace(MARK, " ").encode()

    # -- encoding

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; rank _NONE where there is none."""
        ask = np.where((left < 0) | (right < 0), -1, left * self.width + right)
        at = _slot(ask)
        for _ in range(self.probes):
            wrong = (self.slots[at] != ask) & (self.slots[at] != -2)
            if not wrong.any():
                break
            at = np.where(wrong, (at + 1) & (_SLOTS - 1), at)
        hit = self.slots[at] == ask
        return np.where(hit, self.slot_rank[at], _NONE), np.where(hit, self.slot_made[at], -1)

    def _rounds(self, symbols: np.ndarray, word: np.ndarray, text: Spans | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Merge all words; returns symbols and the first character of each. text: of the words, if they are to be cut between rounds."""
        place = np.arange(len(symbols))
        end = place + 1
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, made = np.full(len(symbols), _NONE), np.full(len(symbols), -1)
        fresh = np.flatnonzero(word[:-1] == word[1:])
        while len(symbols):
            rank[fresh], made[fresh] = self._lookup(symbols[fresh], symbols[np.minimum(fresh + 1, len(symbols) - 1)])
            if text is not None and len(apart := fresh[~self._together(text, place[fresh], end[np.minimum(fresh + 1, len(symbols) - 1)])]):
                heads = np.concatenate(([True], word[1:] != word[:-1]))
                heads[apart + 1] = True
                word = np.cumsum(heads)
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            sizes = np.diff(np.concatenate((starts, [len(symbols)])))
            least = np.minimum.reduceat(rank, starts)
            live = np.repeat(least != _NONE, sizes)
            if not live.all():  # finished words leave the arrays
                done.append((symbols[~live], place[~live]))
                symbols, word, place, end, rank, made = (x[live] for x in (symbols, word, place, end, rank, made))
                if not len(symbols):
                    break
                least, sizes = least[least != _NONE], sizes[least != _NONE]
                starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            of = np.repeat(np.arange(len(starts)), sizes)
            hits = np.flatnonzero(rank == least[of])  # positions of a least pair
            first = np.concatenate(([True], of[hits][1:] != of[hits][:-1]))
            lead = hits[np.maximum.accumulate(np.where(first, np.arange(len(hits)), 0))]
            hits = hits[(symbols[hits] == symbols[lead]) & (symbols[hits + 1] == symbols[lead + 1])]
            # within a run of overlapping occurrences (a a a ...) every second one is merged
            run = np.concatenate(([True], np.diff(hits) != 1))
            index = np.arange(len(hits))
            hits = hits[(index - np.maximum.accumulate(np.where(run, index, 0))) % 2 == 0]
            # up to the first merge after which another pair comes first
            group = of[hits]
            head = np.concatenate(([True], group[1:] != group[:-1]))
            joined = made[hits]
            before, after = hits - 1, hits + 2
            prior = np.where(before >= 0, symbols[np.maximum(before, 0)], -1)
            touching = np.concatenate(([False], (hits[1:] - hits[:-1] == 2) & ~head[1:]))
            prior = np.where(touching, joined, prior)
            prior = np.where((before >= 0) & (of[np.maximum(before, 0)] == group), prior, -1)
            inside = np.minimum(after, len(symbols) - 1)
            following = np.where((after < len(symbols)) & (of[inside] == group), symbols[inside], -1)
            early = (self._lookup(prior, joined)[0] <= least[group]) | (self._lookup(joined, following)[0] <= least[group])
            blocked = np.cumsum(early) - early  # earlier hits, in any word, that stop what comes after
            hits = hits[blocked == blocked[np.maximum.accumulate(np.where(head, np.arange(len(hits)), 0))]]
            symbols[hits], end[hits] = made[hits], end[hits + 1]
            keep = np.ones(len(symbols), dtype=bool)
            keep[hits + 1] = False
            stale = np.zeros(len(symbols), dtype=bool)
            stale[hits] = stale[np.maximum(hits - 1, 0)] = True
            stale[np.maximum(hits - 2, 0)] |= ~keep[np.maximum(hits - 1, 0)]  # what stood before was merged away
            symbols, word, place, end, rank, made, stale = (x[keep] for x in (symbols, word, place, end, rank, made, stale))
            rank[stale], made[stale] = _NONE, -1
            fresh = np.flatnonzero(stale[:-1] & (word[:-1] == word[1:]))
        if not done:
            return symbols, place
        symbols, place = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(place, kind="stable")
        return symbols[order], place[order]

    def _together(self, text: Spans, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether some piece holds each span of characters. (A hash that is there by chance only leaves a word uncut.)"""
        if self.parts is None:
            sizes = np.array([len(t) for t, _, kind in self.pieces if kind == _NORMAL], dtype=np.int64)
            all_text = Spans(np.frombuffer("".join(t for t, _, kind in self.pieces if kind == _NORMAL).encode("utf-32-le"), dtype=np.uint8), lower=False)
            left = np.repeat(np.cumsum(sizes), sizes) - np.arange(int(sizes.sum()))  # characters up to the piece's end
            at = [np.flatnonzero(left >= k) for k in range(2, int(sizes.max(initial=2)) + 1)]
            self.parts = np.unique(np.concatenate([all_text(4 * a, 4 * (a + k)) for k, a in enumerate(at, 2)]))
            self.longest = int(sizes.max(initial=2))
        out = end - start <= self.longest
        asked = text(4 * start[out], 4 * end[out])
        out[out] = self.parts[np.minimum(np.searchsorted(self.parts, asked), len(self.parts) - 1)] == asked
        return out

    def _long_words(self, flat: np.ndarray, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """_rounds() of long words, cut first where no piece holds two characters together."""
        text = Spans(flat.view(np.uint8), lower=False)
        within = np.flatnonzero(word[1:] == word[:-1])
        heads = np.ones(len(symbols), dtype=bool)
        heads[within[self._together(text, within, within + 2)] + 1] = False
        starts, out, at = np.flatnonzero(heads), [], 0
        part = np.cumsum(heads)
        while at < len(symbols):
            k = int(np.searchsorted(starts, at + LONG_RUN, side="right")) - 1
            to = int(starts[k]) if starts[k] > at else int(np.append(starts, len(symbols))[k + 1])
            if at + LONG_RUN >= len(symbols):
                to = len(symbols)
            made, place = self._rounds(symbols[at:to], part[at:to], Spans(flat[at:to].view(np.uint8), lower=False))
            out.append((made, place + at))
            at = to
        made, place = (np.concatenate(x) for x in zip(*out))
        return made, place

    def _emit(self, ch: str) -> list[int]:
        """Ids of a character that is no piece."""
        return [int(self.byte_ids[b]) for b in ch.encode("utf-8", "surrogatepass")] if self.byte_fallback else [self.unknown]

    def _learn(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, flat, and each word's number of ids. flat: code points; sizes: of each word."""
        known = len(self.pieces)
        symbols = self.symbol_of[flat].astype(np.int64)
        word = np.repeat(np.arange(len(sizes)), sizes)
        long = (sizes > LONG)[word]
        if long.any():
            parts = []
            for which, merge in ((np.flatnonzero(~long), self._rounds), (np.flatnonzero(long), lambda s, w: self._long_words(flat[long], s, w))):
                if len(which):
                    made, at = merge(symbols[which], word[which])
                    parts.append((made, which[at]))
            symbols, place = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(place, kind="stable")
            symbols, place = symbols[order], place[order]
        else:
            symbols, place = self._rounds(symbols, word)
        word = word[place]
        odd = np.flatnonzero((symbols < 0) | (symbols >= known))
        if len(odd):
            emitted = [self._emit(chr(flat[place[i]])) for i in odd.tolist()]
            count = np.ones(len(symbols), dtype=np.int64)
            count[odd] = [len(e) for e in emitted]
            symbols, word = np.repeat(symbols, count), np.repeat(word, count)
            first = (np.cumsum(count) - count)[odd]
            for at, e in zip(first.tolist(), emitted):
                symbols[at : at + len(e)] = e
        return symbols.astype(np.uint32), np.bincount(word, minlength=len(sizes))

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text, with the begin and end ids; a null is an empty text."""
        begin, end = (np.array([] if i is None else [i], dtype=np.uint32) for i in (self.begin, self.end))
        for _, _, data, offsets in text_slices(self._marked(texts), SLICE):
            ids, cut = self._slice(data, offsets)
            for a, b in zip(cut[:-1], cut[1:]):
                yield np.concatenate([begin, ids[a:b], end])

    def _marked(self, texts: pa.Array) -> pa.Array:
        """Texts with a space for each space mark, the one put before a text among them."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if pc.any(pc.match_substring(texts, MARK)).as_py():
            texts = pc.replace_substring(texts, MARK, " ")
        if not self.dummy_prefix:
            return texts
        empty = pa.scalar("", pa.large_string())
        return pc.if_else(pc.equal(texts, empty), empty, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string())))

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice's texts, and where each text's begin."""
        if not len(data):
            return np.empty(0, dtype=np.uint32), np.zeros(len(offsets), dtype=np.int64)
        space, alone = data == 32, self.alone[data]
        begins = alone.copy()
        begins[1:] |= alone[:-1] | (space[1:] & ~space[:-1])
        begins[offsets[:-1][offsets[:-1] < len(data)]] = True
        start = np.flatnonzero(begins)
        stop = np.append(start[1:], len(data))
        key, check = Spans(data, lower=False).both(start, stop)
        _, where, inverse = np.unique(key, return_index=True, return_inverse=True)
        if len(self.memo) > MEMO_LIMIT:
            self.memo = _Memo()
        memo, listed = self.memo, key[where].tolist()
        index = np.fromiter(map(memo.get, listed, _MISSING), dtype=np.int64, count=len(listed))
        known = index >= 0
        if (check[where][inverse] != check).any() or (memo.check[index[known]] != check[where[known]]).any():
            # different words of one hash: both hashes tell them apart, and none is remembered
            _, where, inverse = np.unique(np.stack((key, check), axis=1), axis=0, return_index=True, return_inverse=True)
            memo, listed, index, inverse = _Memo(), list(range(len(where))), np.full(len(where), -1), inverse.reshape(-1)
        new = np.flatnonzero(index < 0)
        if len(new):
            a, b = start[where[new]], stop[where[new]]
            size = b - a
            ends = np.cumsum(size)
            flat = data[np.repeat(a - (ends - size), size) + np.arange(ends[-1])]
            points = np.frombuffer(flat.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32).copy()
            points[points == 32] = ord(MARK)
            heads = np.concatenate(([0], np.cumsum((flat & 0xC0) != 0x80)))
            bounds = heads[np.concatenate(([0], ends))]
            base = len(memo)
            memo.add([listed[i] for i in new.tolist()], check[where[new]], *self._learn(points, np.diff(bounds)))
            index[new] = base + np.arange(len(new))
        index = index[inverse]
        n = memo.count[index]
        ends = np.cumsum(n)
        ids = memo.ids[np.repeat(memo.first[index] - (ends - n), n) + np.arange(ends[-1])]
        return ids, np.concatenate(([0], ends))[np.searchsorted(start, offsets)]

    # -- decoding

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: control ids vanish, byte ids join to characters, the first visible piece loses one leading space."""
        if len(ids) and int(ids.max()) >= len(self.pieces):
            raise ValueError("an id beyond the vocabulary")
        n = self.surface_size[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        data = self.surface[np.repeat(self.surface_first[ids] - (ends - n), n) + np.arange(total)].tobytes()
        if self.dummy_prefix and data[:1] == b" ":
            visible = ids[np.argmax(~self.is_control[ids])]
            if self.pieces[visible][2] == _NORMAL:
                data = data[1:]
        try:
            return data.decode("utf-8")
        except UnicodeDecodeError:
            return _lenient(data)


def _lenient(data: bytes) -> str:
    """One U+FFFD for each byte that is not part of a well-formed character."""
    out, at = [], 0
    while at < len(data):
        try:
            out.append(data[at:].decode("utf-8"))
            break
        except UnicodeDecodeError as e:
            out.append(data[at : at + e.start].decode("utf-8"))
            out.append("�")
            at += e.start + 1
    return "".join(out)
