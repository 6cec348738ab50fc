"""Token ids of whole texts with a public tokenizer, through a cache of pieces.

``word_bpe_49k.json`` drops white space and cuts the rest, before it applies its
merges, into runs of letters, single digits and runs of other marks (and after
apostrophes). So the ids of a text are the ids of its pieces in a row, and a piece
needs the tokenizer only once. Words of plain ASCII without an apostrophe are cut
into pieces here, on the bytes of a slice; any other word (letters beyond ASCII,
control bytes, apostrophes) is handed to the tokenizer as it stands. Texts that may
hold a special token's string are handed to it whole. Pieces are known by 64-bit
hashes.

The cache is three flat arrays. It is cut back to the pieces of the slice at hand
when it holds more than ``MOST_PIECES``, and given up at the end of a task, as
Spark keeps a Python worker for its next one; only the tokenizer itself stays.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from nearspark.llm import textops as T

MOST_PIECES = 500_000
SLICE_BYTES = 1 << 20
_U = np.uint64


def _byte_classes() -> tuple[np.ndarray, np.ndarray]:
    """Class of each ASCII byte (1 letter, 2 digit, 3 mark), and the bytes that make a word odd."""
    kind = np.full(256, 3, np.uint8)
    kind[[*range(65, 91), *range(97, 123)]] = 1
    kind[48:58] = 2
    odd = np.zeros(256, bool)
    odd[[*range(32), 39, *range(127, 256)]] = True
    return kind, odd


_KIND, _ODD = _byte_classes()
_AS_IS = T.mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))  # case kept: odd words may depend on it


def pieces_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each piece of a slice, and the index of each text's first piece."""
    s, e, _ = T.word_spans(data, off)
    n = len(data)
    if not len(s):
        return s, e, np.zeros(0, _U), np.zeros(len(off), np.int64)
    odd_before = np.zeros(n + 1, np.int32)
    np.cumsum(_ODD[data], out=odd_before[1:])
    odd = odd_before[e] > odd_before[s]
    change = np.zeros(n + 1, np.int8)  # inside words that are cut: +1 at their start, -1 at their end
    change[s[~odd]] += 1
    change[e[~odd]] -= 1
    inside = np.cumsum(change[:n], dtype=np.int8).astype(bool)
    kind = _KIND[data]
    start = np.zeros(n, bool)
    start[1:] = inside[1:] & inside[:-1] & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))
    start[s] = True
    begin = np.flatnonzero(start)
    end = np.append(begin[1:], n)
    last = np.searchsorted(begin, e) - 1
    end[last] = e
    h = T.word_hashes(data, begin, end)
    if odd.any():
        at = np.searchsorted(begin, s[odd])
        h[at] = ~T.word_hashes(data, begin[at], end[at], _AS_IS)
    return begin, end, h, np.searchsorted(begin, off)


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    """One per worker process: what a tokenizer holds is not given back when it goes."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark already runs a task on each core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordTokenizer:
    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        vocab = self.tokenizer.get_vocab()
        self.size = max(vocab.values()) + 1
        self.word_end = np.zeros(self.size, bool)
        self.word_end[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.keys, self.at, self.ids = np.zeros(0, _U), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all of ``words`` (no white space in them) in a row, and how many each has."""
        ids, sizes = [], []
        for a in range(0, len(words), 2000):
            part = words[a:a + 2000]
            got = self._ids_of_letters(part) if all(map(str.isalpha, part)) else None
            if got is None:
                each = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
                got = np.array([i for x in each for i in x.ids], np.uint32), np.array([len(x.ids) for x in each])
            ids.append(got[0])
            sizes.append(got[1])
        return np.concatenate(ids), np.concatenate(sizes)

    def _ids_of_letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """The same for words of letters, as one text: each is one merged unit, or the split is unknown."""
        one = self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0]
        ids = np.array(one.ids, np.uint32)
        ends = np.flatnonzero(self.word_end[ids]) + 1
        return (ids, np.diff(ends, prepend=0)) if len(ends) == len(words) and ends[-1] == len(ids) else None

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        """Add new pieces to the cache, which stays sorted by key."""
        order = np.argsort([not w.isalpha() for w in words], kind="stable")  # letters first, to be read together
        ids, n = self._ids_of([words[i] for i in order.tolist()])
        sizes = np.concatenate([np.diff(self.at), n])
        keys = np.concatenate([self.keys, keys[order]])
        self._keep(np.argsort(keys), keys, np.cumsum(sizes) - sizes, sizes, np.concatenate([self.ids, ids]))

    def _keep(self, order, keys, begin, sizes, flat) -> None:
        n = sizes[order]
        self.keys, self.at = keys[order], np.concatenate([[0], np.cumsum(n)])
        self.ids = flat[_ranges(begin[order], n)]

    def _places(self, data: np.ndarray, keys: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Index in the cache of each of the distinct ``keys``, new ones learned."""
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            new = np.flatnonzero(self.keys[at] != keys)
        else:
            new = np.arange(len(keys))
        if len(new):
            if len(self.keys) + len(new) > MOST_PIECES:
                known = np.setdiff1d(at, at[new]) if len(self.keys) else np.zeros(0, np.int64)
                known = known[np.isin(self.keys[known], keys)]
                self._keep(known, self.keys, self.at[:-1], np.diff(self.at), self.ids)
                new = np.flatnonzero(~np.isin(keys, self.keys))
            raw = data.tobytes()
            self._learn(keys[new], [raw[a:b].decode(errors="replace")
                                    for a, b in zip(begin[new].tolist(), end[new].tolist())])
        return np.searchsorted(self.keys, keys)

    def encode_slice(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin, end, h, first = pieces_of(data, off)
        keys, one, back = np.unique(h, return_index=True, return_inverse=True)
        place = self._places(data, keys, begin[one], end[one])[back]
        n = (self.at[1:] - self.at[:-1])[place]
        total = np.concatenate([[0], np.cumsum(n)])
        return self.ids[_ranges(self.at[place], n)], np.diff(total[first])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row (uint32), and the number of ids of each text (nulls: none)."""
        texts = texts.fill_null("")
        special = pc.match_substring(texts, "<|")
        if pc.any(special).as_py():
            each = []
            for text, whole in zip(texts, special.to_pylist()):
                each.append(self._encode(text.as_py()) if whole else self.encode(pa.array([text.as_py()]))[0])
            return np.concatenate(each), np.array([len(x) for x in each])
        got = [self.encode_slice(data, off) for _, _, data, off in T.text_slices(
            pa.RecordBatch.from_arrays([texts], names=["text"]), "text", SLICE_BYTES)]
        if not got:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return np.concatenate([x for x, _ in got]), np.concatenate([c for _, c in got])


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``start[i] .. start[i] + n[i] - 1`` of all ``i`` in a row."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - n), n)


def tokenizer_at(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def token_slices(batches, path: str, end_id: int, max_bytes: int, text_col: str = "text"):
    """Yield ``(batch, first_row, ids, counts)`` with ``end_id`` behind each text's ids, for the batches of a task."""
    T.keep_memory_low()
    tok = tokenizer_at(path)
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(text_col))
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        a = 0
        while a < len(texts):
            before = sizes[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(sizes, before + max_bytes, side="right")))
            ids, counts = tok.encode(texts.slice(a, b - a))
            ends = np.cumsum(counts)
            yield batch, a, np.insert(ids, ends, np.uint32(end_id)), counts + 1
            a = b
    del tok
    T.give_back_memory()
