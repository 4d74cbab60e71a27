"""Byte-level BPE ids of whole texts by the tokenizers library, as bytes of little-endian 32-bit integers."""

from __future__ import annotations

import os
from collections.abc import Iterable
from functools import lru_cache

from .hashing import span_hashes

# White space beyond ASCII as UTF-8, with characters that some libraries count as such.
_SPACES_2 = (0xC285, 0xC2A0)
_SPACES_3 = (0xE19A80, 0xE1A08E, *range(0xE28080, 0xE2808C), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080, 0xEFBBBF)
_MARKS = b".,!?;:|*#$%&"
#: Longest part that is remembered, and characters encoded at a time.
_LONGEST, _PIECE = 64, 400_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _spans(starts, lengths):
    """The indices of many spans, one after the other."""
    import numpy as np

    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _white(b):
    """Which bytes belong to white space."""
    import numpy as np

    table = np.zeros(256, dtype=bool)
    table[[*range(9, 14), *range(28, 33)]] = True
    white = table[b]
    at = np.flatnonzero(b[:-1] == 0xC2)
    at = at[np.isin(0xC200 + b[at + 1].astype(np.int64), _SPACES_2)]
    white[at] = white[at + 1] = True
    at = np.flatnonzero(np.isin(b[:-2], (0xE1, 0xE2, 0xE3, 0xEF)))
    at = at[np.isin((b[at].astype(np.int64) << 16) + (b[at + 1].astype(np.int64) << 8) + b[at + 2], _SPACES_3)]
    white[at] = white[at + 1] = white[at + 2] = True
    return white


class Encoder:
    """Ids of texts, equal to Tokenizer.encode(text, add_special_tokens=False).ids.

    The pre-tokenizer never joins characters on both sides of these places: before a space that follows another
    character than white space, between a letter and one of `_MARKS`, and on both sides of a line feed that has no white
    space beside it. Texts are cut there, and the library encodes each distinct part once; parts are compared
    by content, their hash only finds them. `most` parts are remembered at most; beyond, those not seen since the last
    clearing are forgotten. Texts that hold an added token of the tokenizer are encoded whole by the library.
    """

    def __init__(self, path: str, most: int = 200_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import numpy as np
        from tokenizers import Tokenizer

        self.np, self.tokenizer, self.most = np, Tokenizer.from_file(path), most
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.kind = np.uint16 if max(vocab.values()) < 1 << 16 else np.uint32
        self.sizes = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        for token, i in vocab.items():
            self.sizes[i] = len(token)
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.letter, self.mark = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
        self.letter[[*range(65, 91), *range(97, 123)]] = True
        self.mark[list(_MARKS)] = True
        self._keep(None)

    def whole(self, text: str) -> bytes:
        return self.np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _keep(self, kept) -> None:
        """Forget all parts but those whose slots are given."""
        np = self.np
        if kept is None:
            self.keys, self.slot, self.seen = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
            self.text, self.text_at, self.text_n = np.zeros(0, dtype=np.uint8), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
            self.ids, self.ids_at, self.ids_n = np.zeros(0, dtype=self.kind), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
            return
        number = np.full(len(self.seen), -1)
        number[kept] = np.arange(len(kept))
        stay = number[self.slot] >= 0
        self.keys, self.slot = self.keys[stay], number[self.slot[stay]]
        self.text, self.text_n = self.text[_spans(self.text_at[kept], self.text_n[kept])], self.text_n[kept]
        self.ids, self.ids_n = self.ids[_spans(self.ids_at[kept], self.ids_n[kept])], self.ids_n[kept]
        self.text_at, self.ids_at = np.cumsum(self.text_n) - self.text_n, np.cumsum(self.ids_n) - self.ids_n
        self.seen = np.zeros(len(kept), dtype=bool)

    def _cuts(self, b, white, first):
        """Starts of the parts of texts that begin at `first`."""
        np = self.np
        edge = np.zeros(len(b) + 1, dtype=bool)
        edge[first] = edge[len(b)] = True
        cut = edge.copy()
        at = np.flatnonzero(b[1:] == 32) + 1
        cut[at[~white[at - 1]]] = True
        at = np.flatnonzero(self.mark[b[1:]]) + 1
        after, before = b[at - 1], b[np.maximum(at - 2, 0)]
        cut[at[self.letter[after] | ((before == 0xC3) & (after >= 0x80) & (after != 0x97) & (after != 0xB7))]] = True
        at = np.flatnonzero(b == 10)
        alone = (edge[at] | ~white[at - 1]) & (edge[at + 1] | ~white[np.minimum(at + 1, len(b) - 1)])
        cut[at[alone]] = cut[at[alone] + 1] = True
        return np.flatnonzero(cut[:-1])

    def _ids(self, b, white, start, end):
        """Ids of each b[start:end] by the library: ids of all, place and count for each. Many parts go to it in one string, with a line feed before those that begin without a space."""
        np = self.np
        many = (b[start] == 32) | ~white[start]
        many &= ~white[end - 1]
        at, count, found, size = np.zeros(len(start), dtype=np.int64), np.zeros(len(start), dtype=np.int64), [], 0
        together = np.flatnonzero(many)
        for k in range(0, len(together), 20_000):
            some = together[k : k + 20_000]
            n = end[some] - start[some]
            feed = (b[start[some]] != 32).astype(np.int64)
            stop = np.cumsum(n + feed)
            joined = np.full(stop[-1], 10, dtype=np.uint8)
            joined[_spans(stop - n, n)] = b[_spans(start[some], n)]
            ids = np.array(self.tokenizer.encode_batch_fast([joined.tobytes().decode()], add_special_tokens=False)[0].ids, dtype=np.int64)
            reached = np.cumsum(self.sizes[ids])
            last = np.searchsorted(reached, stop) + 1
            assert np.array_equal(reached[last - 1], stop), "a token goes across a cut"
            at[some] = np.concatenate([[0], last[:-1]]) + feed + size
            count[some] = last - (at[some] - size)
            found.append(ids.astype(self.kind))
            size += len(ids)
        for k in np.flatnonzero(~many).tolist():
            ids = np.array(self.tokenizer.encode(b[start[k] : end[k]].tobytes().decode(), add_special_tokens=False).ids, dtype=self.kind)
            at[k], count[k] = size, len(ids)
            found.append(ids)
            size += len(ids)
        return np.concatenate(found) if found else np.zeros(0, dtype=self.kind), at, count

    def _slots(self, b, white, start, end):
        """The slot of each short part, unknown ones being encoded first; -1 where another text has the same hash."""
        np = self.np
        n = end - start
        hashes, one, which = np.unique(span_hashes(b, start, end), return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, hashes)
        known = np.zeros(len(hashes), dtype=bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == hashes[inside]
        new = one[~known]
        if len(new):
            ids, at, count = self._ids(b, white, start[new], end[new])
            slots = len(self.seen) + np.arange(len(new))
            self.text_at, self.text_n = np.concatenate([self.text_at, len(self.text) + np.cumsum(n[new]) - n[new]]), np.concatenate([self.text_n, n[new]])
            self.text = np.concatenate([self.text, b[_spans(start[new], n[new])]])
            self.ids_at, self.ids_n = np.concatenate([self.ids_at, len(self.ids) + at]), np.concatenate([self.ids_n, count])
            self.ids, self.seen = np.concatenate([self.ids, ids]), np.concatenate([self.seen, np.zeros(len(new), dtype=bool)])
            self.keys, self.slot = np.insert(self.keys, place[~known], hashes[~known]), np.insert(self.slot, place[~known], slots)
            place = np.searchsorted(self.keys, hashes)
        slot = self.slot[place][which]
        self.seen[self.slot[place[known]]] = True
        same = n == self.text_n[slot]
        some = np.flatnonzero(same)
        if len(some):
            equal = self.text[_spans(self.text_at[slot[some]], n[some])] == b[_spans(start[some], n[some])]
            same[some] = np.logical_and.reduceat(equal, np.cumsum(n[some]) - n[some])
        return np.where(same, slot, -1)

    def encode(self, texts: list[str]) -> list[bytes]:
        np = self.np
        special = {k for k, t in enumerate(texts) if any(x in t for x in self.added)}
        raw = [b"" if k in special else t.encode() for k, t in enumerate(texts)]
        b = np.frombuffer(b"".join(raw), dtype=np.uint8)
        bounds = np.cumsum([0, *map(len, raw)])
        out = [b""] * len(texts)
        if len(b):
            white = _white(b)
            start = self._cuts(b, white, bounds[:-1])
            end = np.concatenate([start[1:], [len(b)]])
            at, count = np.zeros(len(start), dtype=np.int64), np.zeros(len(start), dtype=np.int64)
            short = np.flatnonzero(end - start <= _LONGEST)
            slot = self._slots(b, white, start[short], end[short])
            at[short[slot >= 0]], count[short[slot >= 0]] = self.ids_at[slot[slot >= 0]], self.ids_n[slot[slot >= 0]]
            rest = np.ones(len(start), dtype=bool)
            rest[short[slot >= 0]] = False
            rest = np.flatnonzero(rest)
            own, own_at, own_n = self._ids(b, white, start[rest], end[rest])
            at[rest], count[rest] = own_at + len(self.ids), own_n
            ids = np.concatenate([self.ids, own])[_spans(at, count)].astype("<u4").tobytes()
            stop = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(start, bounds)] * 4
            out = [ids[a:z] for a, z in zip(stop[:-1].tolist(), stop[1:].tolist())]
            if len(self.keys) > self.most:
                kept = np.flatnonzero(self.seen)
                self._keep(kept if len(kept) < self.most // 2 else None)
        for k in special:
            out[k] = self.whole(texts[k])
        return out

    def pieces(self, text: str, most: int = _PIECE) -> list[str]:
        """The text in pieces of about `most` characters, cut before a space that follows a word; uncut where there is none, or if it holds an added token."""
        out, at = [], 0
        if len(text) > most and not any(x in text for x in self.added):
            while len(text) - at > most:
                k = at + most
                while (k := text.find(" ", k)) > 0 and (text[k - 1].isspace() or text[k - 1] in "᠎​﻿"):
                    k += 1
                if k < 0:
                    break
                out.append(text[at:k])
                at = k
        return [*out, text[at:]]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encoded(texts: list[str | None], path: str, chars: int = _PIECE) -> Iterable[bytes]:
    """Ids of each text (null: empty), about 400,000 characters at a time."""
    tool, some, size = encoder(path), [], 0
    for t in texts:
        t = t or ""
        if len(t) > chars:
            yield from tool.encode(some)
            some, size = [], 0
            yield b"".join(tool.encode([p])[0] for p in tool.pieces(t, chars))
            continue
        some.append(t)
        size += len(t)
        if size >= chars:
            yield from tool.encode(some)
            some, size = [], 0
    if some:
        yield from tool.encode(some)
