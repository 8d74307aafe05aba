"""Token ids of whole texts, by the tokenizers library.

The tokenizer is asked about each distinct piece of text once per worker, not
about each occurrence. A piece is a stretch without white space that ends where
the tokenizer's own splitting rule ends one for certain: between an ASCII letter
and an ASCII digit or sign, after a digit, or between a sign other than the
apostrophe and a letter. No token, normal form or contraction reaches across
such a place, so the pieces' ids in order are the ids of the text. Texts that
hold a special token's string go to the tokenizer whole.

This holds for tokenizers that drop white space, ignore ASCII case and split
words from signs; ``Encoder`` refuses others, which should be encoded directly.
"""

from __future__ import annotations

import json
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from .frames import text_buffer

PIECES_KEPT = 400_000  # pieces a worker remembers; more only costs memory, fewer only time
_SPACE, _LETTER, _DIGIT, _SIGN, _APOSTROPHE, _OTHER = range(6)


def _classes() -> np.ndarray:
    kind = np.full(256, _SIGN, np.uint8)
    kind[128:] = _OTHER
    kind[:32] = _OTHER  # control characters are left to the tokenizer
    kind[127] = _OTHER
    for byte in b" \t\n\v\f\r":
        kind[byte] = _SPACE
    kind[ord("a"):ord("z") + 1] = _LETTER
    kind[ord("0"):ord("9") + 1] = _DIGIT
    kind[ord("'")] = _APOSTROPHE
    return kind


def _splits() -> np.ndarray:
    """Whether a piece ends between two bytes of these classes."""
    split = np.zeros((6, 6), bool)
    split[_LETTER, [_DIGIT, _SIGN, _APOSTROPHE]] = True
    split[_DIGIT, [_LETTER, _DIGIT, _SIGN, _APOSTROPHE]] = True
    split[_SIGN, [_LETTER, _DIGIT]] = True
    split[_APOSTROPHE, _DIGIT] = True
    split[_SPACE, :] = True
    return split


_KIND, _SPLIT = _classes(), _splits().ravel()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


class Encoder:
    """Ids, and character spans on demand, for slices of texts. One per worker: see ``encoder``."""

    def __init__(self, path: str, spans: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.spans = spans
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [token["content"] for token in spec["added_tokens"]]
        suffix = spec["model"].get("end_of_word_suffix")
        probe = self.tokenizer.encode("Ab ab", add_special_tokens=False).ids
        if not suffix or len(probe) % 2 or probe[:len(probe) // 2] != probe[len(probe) // 2:]:
            raise ValueError("pieces need a tokenizer with word ends that ignores white space and case")
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        for token, place in spec["model"]["vocab"].items():
            self.ends_word[place] = token.endswith(suffix)
        self.known: dict[bytes, int] = {}
        self._clear()

    def _clear(self) -> None:
        self.known.clear()
        self.ids, self.starts, self.stops = [], [], []  # arrays of each miss round
        self.bounds = [np.zeros(1, np.int64)]
        self.held = 0

    def _ask(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of new pieces, their spans, and the number of ids of each piece."""
        texts = [piece.decode() for piece in pieces]
        if not self.spans:
            # One call for all: each word of the tokenizer ends in an id that says so, each plain piece is one word.
            plain = [i for i, text in enumerate(texts) if text.isalpha()]
            single = set(plain)
            whole = [self.tokenizer.encode(" ".join([texts[i] for i in plain[k:k + 500]]), add_special_tokens=False).ids
                     for k in range(0, len(plain), 500)]
            ids = np.fromiter(chain.from_iterable(whole), np.int64)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(plain):
                other = [i for i in range(len(pieces)) if i not in single]
                found = [self.tokenizer.encode(texts[i], add_special_tokens=False).ids for i in other]
                sizes = np.zeros(len(pieces), np.int64)
                sizes[plain] = np.diff(ends, prepend=0)
                sizes[other] = [len(x) for x in found]
                out = np.zeros(int(sizes.sum()), np.int64)
                is_plain = np.zeros(len(pieces), bool)
                is_plain[plain] = True
                mask = np.repeat(is_plain, sizes)
                out[mask] = ids
                out[~mask] = np.fromiter(chain.from_iterable(found), np.int64)
                return out, out[:0], out[:0], sizes
        found = [self.tokenizer.encode(text, add_special_tokens=False) for text in texts]
        sizes = np.array([len(e.ids) for e in found], np.int64)
        flat = lambda parts: np.array([x for part in parts for x in part], np.int64)
        spans = flat(span for e in found for span in e.offsets).reshape(-1, 2) if self.spans else np.zeros((0, 2), np.int64)
        return flat(e.ids for e in found), spans[:, 0], spans[:, 1], sizes

    def _learn(self, pieces: list[bytes]) -> None:
        ids, starts, stops, sizes = self._ask(pieces)
        first = len(self.known)
        self.known.update(zip(pieces, range(first, first + len(pieces))))
        self.bounds.append(np.cumsum(sizes) + self.held)
        self.held += len(ids)
        self.ids.append(ids)
        self.starts.append(starts)
        self.stops.append(stops)

    def _joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        for name in ("ids", "starts", "stops", "bounds"):
            parts = getattr(self, name)
            if len(parts) > 1:
                setattr(self, name, [np.concatenate(parts)])
        empty = np.zeros(0, np.int64)
        return (self.bounds[0], *[(getattr(self, name) or [empty])[0] for name in ("ids", "starts", "stops")])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """(ids, offsets): the ids of all texts in a row, and where each text's begin.

        With spans also (starts, stops) of each id, in characters of its text.
        """
        raw, offsets = text_buffer(texts)
        low = _LOWER[raw]
        holds = pc.fill_null(pc.match_substring(texts, "<", ignore_case=False), False) if self.special else None
        odd: list[int] = []
        if holds is not None and pc.any(holds).as_py():
            joined = low.tobytes()
            marks = [s.encode() for s in self.special]
            odd = [i for i in np.flatnonzero(holds.to_numpy(zero_copy_only=False))
                   if any(m in joined[offsets[i]:offsets[i + 1]] for m in marks)]
        kind = _KIND[low]
        begins = np.empty(len(low), bool)
        if len(low):
            begins[0] = True
            begins[1:] = _SPLIT[kind[:-1] * np.uint8(6) + kind[1:]]
        inner = offsets[:-1][offsets[:-1] < len(low)]
        begins[inner] = True
        solid = kind != _SPACE
        begins &= solid
        at = np.flatnonzero(begins)
        where = np.cumsum(solid, dtype=np.int32)[at] - 1 if len(low) < 2**31 else np.cumsum(solid)[at] - 1
        data = low[solid]
        bounds = np.append(where, len(data)).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > PIECES_KEPT:
            self._clear()
        known = self.known
        new = [piece for piece in distinct if piece not in known]
        if new:
            self._learn(new)
        slots = np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))
        ends, all_ids, all_starts, all_stops = self._joined()
        codes = slots[coded.indices.to_numpy(zero_copy_only=False)] if len(at) else np.zeros(0, np.int64)
        sizes = ends[codes + 1] - ends[codes]
        firsts = np.cumsum(sizes) - sizes
        total = int(sizes.sum())
        take = np.arange(total) - np.repeat(firsts - ends[codes], sizes)
        ids = all_ids[take]
        cut = np.searchsorted(at, offsets)  # first piece of each text
        filled = np.append(firsts, total)
        bounds = filled[cut]
        out = [ids]
        if self.spans:
            chars = np.cumsum((raw & 0xC0) != 0x80, dtype=np.int64)  # characters up to and with each byte
            before = np.concatenate([[0], chars])
            base = before[at] - np.repeat(before[offsets[:-1]], np.diff(cut))
            shift = np.repeat(base, sizes)
            out += [all_starts[take] + shift, all_stops[take] + shift]
        if odd:
            return self._patched(texts, odd, bounds, out)
        return (out[0], bounds, *out[1:])

    def _patched(self, texts: pa.Array, odd: list[int], bounds: np.ndarray, out: list[np.ndarray]) -> tuple:
        """The same with the texts at ``odd`` encoded whole."""
        parts: list[list[np.ndarray]] = [[] for _ in out]
        sizes = np.diff(bounds)
        done = 0
        for i in odd:
            e = self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False)
            spans = np.array(e.offsets, np.int64).reshape(-1, 2)
            for part, old, new in zip(parts, out, (np.array(e.ids, np.int64), spans[:, 0], spans[:, 1])):
                part += [old[done:bounds[i]], new]
            done = bounds[i + 1]
            sizes[i] = len(e.ids)
        whole = [np.concatenate([*part, old[done:]]) for part, old in zip(parts, out)]
        return (whole[0], np.concatenate([[0], np.cumsum(sizes)]), *whole[1:])


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, spans: bool = False) -> Encoder:
    """This worker's encoder: loaded once, shared by its tasks."""
    if (path, spans) not in _ENCODERS:
        _ENCODERS[path, spans] = Encoder(path, spans)
    return _ENCODERS[path, spans]


def with_end(ids: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's ids followed by the end id, as little-endian unsigned 32-bit numbers, and the new bounds."""
    return np.insert(ids, bounds[1:], end).astype("<u4"), bounds + np.arange(len(bounds))


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").data)
