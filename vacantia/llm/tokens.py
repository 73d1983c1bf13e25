"""Encoding by a public byte-level BPE vocabulary, in batched numpy merge rounds.

Texts are cut into words by the vocabulary's pattern; words not yet known to the task are encoded
together: their byte symbols stand in one flat array, every round looks the neighbouring pairs up
by binary search over the sorted pair keys and merges, in each word, all places of its
lowest-ranked pair, until no word has a pair left. Known words are looked up.

Defined results: null and empty texts give an empty list; special tokens in a text are ordinary
text; lone surrogates are encoded as the replacement character.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: how the vocabulary cuts texts into words.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NONE = np.int64(1 << 40)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: printable bytes themselves, others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Merges:
    """Sorted pair keys with their ranks and results, and the symbol of each byte."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray, results: np.ndarray, bytes_: np.ndarray):
        self.keys, self.ranks, self.results, self.bytes = keys, ranks, results, bytes_

    @staticmethod
    def read(path: str = VOCABULARY) -> tuple[np.ndarray, ...]:
        """The four arrays, which unlike this class can be broadcast to workers that lack the package."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([ids[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([ids[b] for _, b in pairs], dtype=np.int64)
        key = (left << 20) | right
        order = np.argsort(key, kind="stable")
        results = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)[order]
        return key[order], order.astype(np.int64), results, np.array([ids[c] for c in byte_letters()], dtype=np.int64)

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each non-empty word."""
        sizes = np.array([len(w) for w in words])
        flat = self.bytes[np.frombuffer(b"".join(words), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        out: list = [None] * len(words)
        while len(flat):
            together = owner[:-1] == owner[1:]
            key = (flat[:-1] << 20) | flat[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = together & (self.keys[at] == key)
            rank = np.where(hit, self.ranks[at], _NONE)
            lowest = np.full(len(words), _NONE)
            np.minimum.at(lowest, owner[:-1], rank)
            chosen = hit & (rank == lowest[owner[:-1]])
            # of overlapping places, as in aaa, every other one from the left
            begins = chosen & ~np.concatenate(([False], chosen[:-1]))
            index = np.arange(len(chosen))
            start = np.maximum.accumulate(np.where(begins, index, 0))
            chosen &= (index - start) % 2 == 0
            where = np.flatnonzero(chosen)
            flat = flat.copy()
            flat[where] = self.results[at[where]]
            keep = np.ones(len(flat), dtype=bool)
            keep[where + 1] = False
            flat, owner = flat[keep], owner[keep]
            done = lowest[owner] == _NONE
            if done.any():
                finished, of = flat[done], owner[done]
                cuts = np.flatnonzero(np.diff(of)) + 1
                for w, ids in zip(of[np.concatenate(([0], cuts))], np.split(finished, cuts)):
                    out[w] = ids.astype(np.int32)
                flat, owner = flat[~done], owner[~done]
        return out


def encoder(merges: Merges, keep_words: int = 1 << 18):
    """A function from texts to (offsets, ids), with its own cache of words."""
    import regex

    find, known = regex.compile(PATTERN).findall, {}

    def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if len(known) > keep_words:
            known.clear()
        cut = [find(t) if t else [] for t in texts]
        new = list(dict.fromkeys(w for words in cut for w in words if w not in known))
        for start in range(0, len(new), 1 << 16):
            part = new[start : start + (1 << 16)]
            known.update(zip(part, merges.encode_words([w.encode("utf-8", "replace") for w in part])))
        rows = [np.concatenate([known[w] for w in words]) if words else np.empty(0, dtype=np.int32) for words in cut]
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in rows]))).astype(np.int32)
        return offsets, np.concatenate(rows) if rows else np.empty(0, dtype=np.int32)

    return encode


def encoded(texts: DataFrame, path: str = VOCABULARY, count_only: bool = False) -> DataFrame:
    """(id, text) to (id, ids), or to (id, n_tokens)."""
    shared = texts.sparkSession.sparkContext.broadcast(Merges.read(path))  # some 2 MB, fixed by the vocabulary

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(Merges(*shared.value))
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                offsets, ids = encode(part.column(1).to_pylist())
                if count_only:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets).astype(np.int64))], ["id", "n_tokens"])
                else:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, type=pa.int32()))], ["id", "ids"])

    return texts.select("id", "text").mapInArrow(read, "id long, n_tokens long" if count_only else "id long, ids array<int>")
