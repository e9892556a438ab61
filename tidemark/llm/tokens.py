"""Encoding whole texts with a public tokenizer, a chunk at a time.

These tokenizers never join characters across a space or a line feed, so a text's
ids are those of its chunks between them. Chunks are found and hashed by array
operations over the bytes of many texts; a worker keeps the ids of chunks in a
direct-mapped cache of fixed size, and only chunks that aren't there reach the
tokenizer, each distinct one of a batch once. (Chunks are told apart by 64-bit
hashes; a cache of 2**21 entries makes a mix-up a matter of 1 in 10**6 workers.)"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa

from tidemark.llm.common import SpanHash, pieces, text_view

LOG_SLOTS = 21
#: Ids kept before a worker starts over.
POOL = 1 << 24
#: Bytes of text encoded at once.
CHUNK = 1 << 20
#: Chunks of printable ASCII and Latin-1 letters, for which normalising is lower-casing.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]*").fullmatch
ALL_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ\n]*").fullmatch
# The pre-tokenizer's pattern (a fixed value of the tokenizer file), and what it matches in such chunks.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\n]+")
_encoders: dict[tuple, Encoder] = {}


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    def __init__(self, path: str, plain_specials: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        self.keys = np.zeros(1 << LOG_SLOTS, np.uint64)
        self.first = np.zeros(1 << LOG_SLOTS, np.int64)
        self.count = np.zeros(1 << LOG_SLOTS, np.int32)
        self.pool, self.used = np.zeros(1 << 20, np.uint32), 0
        self.plain = self.ends = None
        spec = json.loads(self.tokenizer.to_str())
        suffix = spec["model"].get("end_of_word_suffix")
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", ())]
        if suffix and kinds == ["NFC", "Replace", "Lowercase"] and PATTERN in json.dumps(spec["pre_tokenizer"]).replace("\\\\", "\\"):
            # Words that are split already need only the model: same merges, no pattern matching.
            spec["normalizer"], spec["added_tokens"] = None, []
            level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
            spec["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, level]}
            self.plain = Tokenizer.from_str(json.dumps(spec))
            self.ends = np.zeros(1 + max(spec["model"]["vocab"].values()), bool)
            self.ends[[v for k, v in spec["model"]["vocab"].items() if k.endswith(suffix)]] = True

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one behind the other, and the offsets of the texts."""
        raw, offsets = text_view(column)
        parts, at = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]
        for i, j in pieces(offsets, CHUNK):
            ids, ends = self._piece(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            parts.append(ids)
            at.append(at[-1][-1] + ends)
        return np.concatenate(parts), np.concatenate(at)

    def _piece(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = np.zeros(len(raw) + 2, bool)
        inside[1:-1] = (raw != 32) & (raw != 10)
        edge = inside[1:] != inside[:-1]
        cut = np.zeros(len(raw) + 1, bool)
        cut[offsets] = True
        cut &= inside[:-1] & inside[1:]  # texts that meet without a gap
        starts, ends = np.flatnonzero((edge & inside[1:]) | cut), np.flatnonzero((edge & inside[:-1]) | cut)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        h = SpanHash(raw)(starts, ends)
        slot = (h >> np.uint64(64 - LOG_SLOTS)).astype(np.int64)
        if self.used > POOL:
            self.keys[:], self.used = 0, 0
        missing = np.flatnonzero(self.keys[slot] != h)
        first, count = self.first[slot], self.count[slot]
        if len(missing):
            _, where, back = np.unique(h[missing], return_index=True, return_inverse=True)
            new = missing[where]
            ids, n = self._new(raw, starts[new], ends[new])
            if self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros(len(self.pool) + len(ids), np.uint32)])
            self.pool[self.used : self.used + len(ids)] = ids
            begin = self.used + np.cumsum(n) - n
            self.used += len(ids)
            first[missing], count[missing] = begin[back], n[back]
            self.keys[slot[new]], self.first[slot[new]], self.count[slot[new]] = h[new], begin, n
        total = np.concatenate([[0], np.cumsum(count)])
        out = self.pool[np.repeat(first - total[:-1], count) + np.arange(total[-1])]
        return out, total[np.searchsorted(starts, offsets[1:])]

    def _new(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks that are not in the cache, and how many each has."""
        n = ends - starts + 1
        at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
        line = np.where(at < np.repeat(ends, n), raw[np.minimum(at, len(raw) - 1)], np.uint8(10))
        text = line[:-1].tobytes().decode("utf-8")
        if self.plain is not None and "<|" not in text and ALL_PLAIN(text):
            return self._plain(text, len(starts))
        chunks = text.split("\n")
        easy = np.array([self.plain is not None and bool(PLAIN(c)) and "<|" not in c for c in chunks], bool)
        lists: list = [None] * len(chunks)
        if easy.any():
            ids, k = self._plain("\n".join(c for c, e in zip(chunks, easy, strict=True) if e), int(easy.sum()))
            for i, part in zip(np.flatnonzero(easy), np.split(ids, np.cumsum(k)[:-1]), strict=True):
                lists[i] = part
        odd = np.flatnonzero(~easy)
        for i, e in zip(odd, self.tokenizer.encode_batch_fast([chunks[i] for i in odd], add_special_tokens=False), strict=True):
            lists[i] = np.array(e.ids, np.uint32)
        return np.concatenate(lists).astype(np.uint32), np.array([len(x) for x in lists])

    def _plain(self, text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of n chunks, one a line: all parts of all chunks in one text; each part ends in
        an id that ends a word."""
        spaced = PARTS.sub(r"\g<0> ", text.lower())
        parts = np.fromiter((line.count(" ") for line in spaced.split("\n")), np.int64, n)
        ids = np.array(self.plain.encode_batch_fast([spaced], add_special_tokens=False)[0].ids, np.uint32)
        after = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])
        return ids, np.diff(after[np.concatenate([[0], np.cumsum(parts)])])


def encoder(path: str, plain_specials: bool = False) -> Encoder:
    """One encoder per worker and kind."""
    key = (path, plain_specials)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]
