"""Token ids of whole texts by a ``tokenizers`` file whose pre-tokeniser cuts
at white space, so that the ids of a text are those of its words in order.

The ids of words met before are kept in flat arrays, found by a sorted index of
the words' hashes: some 30 bytes a word, so that a worker remembers the words
of a large corpus.  New words of a buffer are encoded together, once each, and
the ids of the buffer are gathered by array operations."""

from __future__ import annotations

import os

import numpy as np

from .text import _SPACE, words

KEEP = 1_500_000  # words remembered; beyond, the half that was not met for longest goes
CORES = 250_000  # lower-case letter words whose ids are kept beside them


class _Store:
    """Ids by 64-bit key: sorted keys, and where the ids of each lie."""

    def __init__(self):
        self.keys = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int32)
        self.size = np.zeros(0, np.int32)
        self.met = np.zeros(0, np.int32)  # buffer in which the key was last met
        self.ids = np.zeros(0, np.uint32)
        self.now = 0

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, found) of sorted distinct ``keys``."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        found = self.keys[at] == keys
        self.met[at[found]] = self.now
        return at, found

    def add(self, keys: np.ndarray, ids: list[np.ndarray]) -> None:
        """Remember sorted ``keys`` that are not there yet."""
        if len(self.keys) + len(keys) > KEEP:
            self._clear()
        size = np.fromiter((len(i) for i in ids), np.int32, len(ids))
        first = (np.cumsum(size) - size + len(self.ids)).astype(np.int32)
        at = np.searchsorted(self.keys, keys)
        self.ids = np.concatenate([self.ids, *ids])
        self.keys, self.first = np.insert(self.keys, at, keys), np.insert(self.first, at, first)
        self.size, self.met = np.insert(self.size, at, size), np.insert(self.met, at, self.now)

    def _clear(self) -> None:
        """Keep the keys of this buffer and the half met last."""
        oldest = np.partition(self.met, len(self.met) // 2)[len(self.met) // 2] if len(self.met) else 0
        keep = np.flatnonzero((self.met > oldest) | (self.met == self.now))
        self.ids = self.ids[_spans(self.first[keep], self.size[keep])]
        self.keys, self.size, self.met = self.keys[keep], self.size[keep], self.met[keep]
        self.first = (np.cumsum(self.size) - self.size).astype(np.int32)


def _spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places ``first .. first + size`` of all spans, in order."""
    ends = np.cumsum(size)
    return np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


class WordEncoder:
    _loaded: dict[str, "WordEncoder"] = {}

    @classmethod
    def get(cls, name: str) -> "WordEncoder":
        """The encoder of this process for a public tokenizer file or a path."""
        if name not in cls._loaded:
            cls._loaded[name] = cls(name)
        return cls._loaded[name]

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(name if os.sep in name else public_tokenizers.path(name))
        self.tokenizer.encode_special_tokens = True  # control strings in a text are ordinary text
        self.store = _Store()
        self.cores: dict[str, np.ndarray] = {}

    def _encode_all(self, texts: list[str]) -> list[np.ndarray]:
        made = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in made]

    def words(self, raw: list[bytes]) -> list[np.ndarray]:
        """Ids of words.  Letters below U+0180 lower and normalise one by one,
        and a mark after them is a token run of its own, so such words share
        the entry of their lower-case letters."""
        parts: list[tuple[str, ...]] = []
        whole, missing = [], {}
        for at, word in enumerate(raw):
            word = word.decode("utf-8", "replace")
            body, tail = (word[:-1], word[-1]) if word[-1] in ",." else (word, "")
            if body.isalpha() and max(body) < "ƀ" and "İ" not in body:
                part = (body.lower(), tail) if tail else (body.lower(),)
                missing.update((p, None) for p in part if p not in self.cores)
            else:
                part = ()
                whole.append((at, word))
            parts.append(part)
        if len(self.cores) + len(missing) > CORES:
            missing.update((p, None) for part in parts for p in part)
            self.cores.clear()
        self.cores.update(zip(missing, self._encode_all(list(missing))))
        out = [self.cores[p[0]] if len(p) == 1 else np.concatenate([self.cores[c] for c in p]) if p else None for p in parts]
        for (at, _), ids in zip(whole, self._encode_all([w for _, w in whole])):
            out[at] = ids
        return out

    def word(self, raw: bytes) -> np.ndarray:
        """Ids of one word."""
        return self.words([raw])[0]

    def lookup(self, hashes: np.ndarray, start: np.ndarray, end: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, size) in ``store.ids`` of the words with sorted distinct
        ``hashes``, which stand at ``start`` to ``end`` in ``data``."""
        self.store.now += 1
        at, found = self.store.find(hashes)
        if not found.all():
            new = np.flatnonzero(~found)
            ids = self.words([data[a:b].tobytes() for a, b in zip(start[new].tolist(), end[new].tolist())])
            self.store.add(hashes[new], ids)
            at, _ = self.store.find(hashes)
        return self.store.first[at], self.store.size[at]

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents, ids per document); ``end_id`` is added to
        each document."""
        doc, start, end, h = words(data, offsets, _SPACE, lower=False)
        distinct, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        first, size = self.lookup(distinct, start[at], end[at], data)
        length = size[inverse]
        flat = self.store.ids[_spans(first[inverse], length)]
        counts = np.bincount(doc, length, len(offsets) - 1).astype(np.int64)
        if end_id is not None:
            flat = np.insert(flat, np.cumsum(counts), end_id)
            counts += 1
        return flat, counts
