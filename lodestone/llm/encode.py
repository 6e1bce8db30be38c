"""Token ids of many texts at once, by a word-level BPE file of the tokenizers library.

For the public lower-casing word BPE (its normalizer, pre-tokenizer and word ends are compared with the file's) whole
Arrow buffers are cut into the pre-tokenizer's pieces in a few numpy passes: runs of Latin letters, single digits, runs
of other ASCII signs. A word that holds anything else (an apostrophe, a control, a further script, a special token's
beginning) stays whole and takes the tokenizer's own way. Each distinct piece is encoded once and kept in a table of
fixed size (an entry gives way to a newer one); texts then gather their ids. Any other file takes the library's plain
way, text by text.
"""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa

from .common import slices
from .words import bounds, hashes

#: Entries of the table of pieces in one process, and ids kept for them.
SLOTS, POOL = 1 << 20, 1 << 23

# What the public lower-casing word BPE states about itself.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [{"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}],
}

SPACE, LETTER, DIGIT, SIGN, ODD = range(5)
CLASS = np.full(256, ODD, np.uint8)
CLASS[[9, 10, 13, 32]] = SPACE
CLASS[33:127] = SIGN
CLASS[48:58] = DIGIT
CLASS[65:91] = CLASS[97:123] = LETTER
CLASS[39] = ODD  # an apostrophe may belong to the letters after it
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_SOLID = CLASS != SPACE


def _byte_letters() -> np.ndarray:
    """The public byte-level alphabet: printable bytes stand for themselves, others for letters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in plain)
    letter = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return np.array([ord(letter[b]) for b in range(256)], "<u2")


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        said = json.loads(self.tokenizer.to_str())
        model = said["model"]
        self.known = said["normalizer"] == NORMALIZER and said["pre_tokenizer"] == PRE_TOKENIZER and said["post_processor"] is None
        self.known &= (model["type"], model["end_of_word_suffix"], model["dropout"], model["continuing_subword_prefix"], model["unk_token"]) == ("BPE", "</w>", None, None, None)
        added = [t["content"].encode() for t in said["added_tokens"] if not t["normalized"]]
        self.known &= len(added) == len(said["added_tokens"]) and all(len(t) > 1 for t in added)
        self.openings = sorted({t[:2] for t in added})
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.n_ids = self.tokenizer.get_vocab_size()
        self._clear()

    def _clear(self) -> None:
        self.keys, self.firsts = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64)
        self.at, self.size = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
        self.pool, self.used = np.zeros(POOL + (1 << 16), np.uint32), 0

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The bytes as they are encoded, starts and ends of the pieces, and whether each is an odd word."""
        kind, low = CLASS[data], _LOW[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)  # letters from U+00C0 to U+00FF
        if len(lead):
            after = data[lead + 1]
            kind[lead] = kind[lead + 1] = np.where((after == 0x97) | (after == 0xB7), SIGN, LETTER)
            low[lead + 1] += ((after <= 0x9E) & (after != 0x97)).astype(np.uint8) << 5
        odd = kind == ODD
        for a, b in self.openings:
            odd[:-1] |= (data[:-1] == a) & (data[1:] == b)
        if odd.any():
            starts, ends = bounds(data, offsets, _SOLID)
            n_odd = np.r_[0, np.cumsum(odd)]
            which = np.flatnonzero(n_odd[ends] > n_odd[starts])
            starts, length = starts[which], ends[which] - starts[which]
            inside = np.repeat(starts - np.cumsum(length) + length, length) + np.arange(length.sum())
            kind[inside], low[inside] = ODD, data[inside]
        edge = np.empty(len(data) + 1, bool)
        edge[1:-1] = kind[1:] != kind[:-1]
        edge[:-1] |= kind == DIGIT
        edge[1:] |= np.r_[kind[:-1] == DIGIT, False]
        edge[offsets] = True
        cuts = np.flatnonzero(edge)
        full = kind[cuts[:-1]] != SPACE
        starts, ends = cuts[:-1][full], cuts[1:][full]
        return low, starts, ends, kind[starts] == ODD

    def _learn(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encode pieces; where their ids are in the pool, and how many."""
        tokenize = self.model.tokenize
        letters = self.letters[low].tobytes().decode("utf-16-le")  # a letter for each byte
        words = [letters[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        strange = np.flatnonzero(odd).tolist()
        for k in strange:
            words[k] = ""
        found = [[t.id for t in tokenize(w)] for w in words]
        raw = low.tobytes() if strange else b""
        for i in range(0, len(strange), 1024):
            some = strange[i : i + 1024]
            for k, got in zip(some, self.tokenizer.encode_batch_fast([raw[starts[k] : ends[k]].decode() for k in some], add_special_tokens=False)):
                found[k] = got.ids
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum()))
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(len(flat) + POOL, np.uint32)])
        self.pool[self.used : self.used + len(flat)] = flat
        at = self.used + np.cumsum(size) - size
        self.used += len(flat)
        return at, size

    def encode_slice(self, data: np.ndarray, offsets: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, and how many each text has; with end_id after each text."""
        n = len(offsets) - 1
        if not self.known:
            texts = [data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:])]
            held = [got.ids + ([] if end_id is None else [end_id]) for got in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            lengths = np.fromiter(map(len, held), np.int64, n)
            return np.fromiter((x for ids in held for x in ids), np.uint32, int(lengths.sum())), lengths
        if not len(data):
            return np.full(0 if end_id is None else n, end_id or 0, np.uint32), np.full(n, int(end_id is not None), np.int64)
        if self.used > POOL:
            self._clear()
        low, starts, ends, odd = self.pieces(data, offsets)
        hashed, length = hashes(low, starts, ends), ends - starts
        padded = np.zeros(len(low) + 8, np.uint8)
        padded[: len(low)] = low
        first = np.ndarray(len(low), "<u8", padded, strides=(1,))[starts]
        short = np.minimum(length, 8).astype(np.uint64) * np.uint64(8)
        first = np.where(short == 64, first, first & ((np.uint64(1) << short) - np.uint64(1))) ^ (length.astype(np.uint64) << np.uint64(48))
        slot = (hashed & np.uint64(SLOTS - 1)).astype(np.int64)
        same = (self.keys[slot] == hashed) & (self.firsts[slot] == first)
        at, size = self.at[slot], self.size[slot]
        new = np.flatnonzero(~same)
        if len(new):
            _, one, inverse = np.unique(hashed[new], return_index=True, return_inverse=True)
            one = new[one]
            got_at, got_size = self._learn(low, starts[one], ends[one], odd[one])
            at[new], size[new] = got_at[inverse], got_size[inverse]
            into = slot[one]
            self.keys[into], self.firsts[into], self.at[into], self.size[into] = hashed[one], first[one], got_at, got_size
        begins = np.searchsorted(starts, offsets)
        total = np.r_[0, np.cumsum(size)]
        lengths = np.diff(total[begins])
        idx = np.repeat(at - total[:-1], size)
        idx += np.arange(len(idx))
        ids = self.pool[idx]
        if end_id is None:
            return ids, lengths
        out = np.full(len(ids) + n, end_id, np.uint32)
        keep = np.ones(len(out), bool)
        keep[np.cumsum(lengths + 1) - 1] = False
        out[keep] = ids
        return out, lengths + 1

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out = []
        for _, _, data, offsets in slices(pa.array(texts, pa.large_string())):
            ids, lengths = self.encode_slice(data, offsets)
            out += np.split(ids, np.cumsum(lengths)[:-1])
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One in each process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
