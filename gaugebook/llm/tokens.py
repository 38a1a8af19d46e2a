"""Token ids of whole texts with a byte-level BPE vocabulary, word by word.

BPE never merges across the words that its splitting pattern finds, so the ids of a text
are the ids of its words in order. Words are found on arrays of code points, each
distinct word of a slice is encoded once by the tokenizer itself, and ids are put in
place by index arithmetic. A text outside the Latin blocks, or one that spells a special
token, goes through the tokenizer whole.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa

from gaugebook.llm.text import combine, gather, hash_spans

LATIN = 0x250
# Classes of code points in the splitting pattern.
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
_WHITE = {9, 10, 11, 12, 13, 32, 0x85, 0xA0}
#: Distinct words remembered by a worker before it starts afresh.
CACHE_WORDS = 1_500_000
#: New words encoded as one text.
JOINED = 2000


def _classes() -> np.ndarray:
    out = np.full(LATIN, OTHER, np.uint8)
    for code in range(LATIN):
        kind = unicodedata.category(chr(code))[0]
        out[code] = SPACE if code in _WHITE else {"L": LETTER, "N": NUMBER}.get(kind, OTHER)
    return out


CLASS = _classes()


def word_starts(code: np.ndarray, first: np.ndarray) -> np.ndarray:
    """True where a word of the pattern starts. `first` marks the first code point of each text."""
    n = len(code)
    kind = CLASS[code]
    change = np.empty(n, bool)
    change[0] = True
    change[1:] = kind[1:] != kind[:-1]
    start = change | first
    space = kind == SPACE
    follows = np.zeros(n, bool)  # the next code point is of the same text and no space
    follows[:-1] = ~space[1:] & ~first[1:]
    blank = space & follows
    start |= blank  # the last space of a run stands apart from the run ...
    joined = np.flatnonzero(blank & (code == 32)) + 1
    start[joined] = False  # ... and a U+0020 joins what follows
    quote = np.flatnonzero((code == 39) & start)
    if len(quote):
        padded = np.concatenate([code, np.zeros(3, code.dtype)])
        edge = np.concatenate([first, np.ones(3, bool)])
        one, two = padded[quote + 1], padded[quote + 2]
        near, far = ~edge[quote + 1], ~edge[quote + 1] & ~edge[quote + 2]
        # The contractions of the pattern.
        single = near & np.isin(one, [ord(c) for c in "stmd"])
        double = far & np.any([(one == ord(a)) & (two == ord(b)) for a, b in ("re", "ve", "ll")], axis=0)
        for at, size in ((quote[single], 1), (quote[double], 2)):
            start[at + 1] = False
            after = at + size + 1
            after = after[after < n]
            start[after[kind[after] == LETTER]] = True
    return start


class Encoder:
    """Ids of many texts at once. Not shared between processes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.bytes_of = np.zeros(self.tokenizer.get_vocab_size() + 1, np.int64)
        for token, i in self.tokenizer.get_vocab().items():  # one character of a token stands for one byte
            self.bytes_of[i] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.start = np.empty(0, np.int64)
        self.size = np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their counts of words that are no white space: JOINED at a time as one text.

        A word without a leading space is set apart by a line feed, which is a word of its
        own; the bytes that each id stands for then show where the words begin.
        """
        ids, sizes = [], []
        groups = [words[i:i + JOINED] for i in range(0, len(words), JOINED)]
        joined = [[w if w[0] == " " else "\n" + w for w in group] for group in groups]
        found = self.tokenizer.encode_batch_fast(["".join(j) for j in joined], add_special_tokens=False)
        for group, parts, encoded in zip(groups, joined, found):
            got = np.array(encoded.ids, np.uint32)
            at = np.cumsum(self.bytes_of[got]) - self.bytes_of[got]
            ends = np.cumsum([len(p.encode()) for p in parts])
            starts = ends - [len(w.encode()) for w in group]
            low, high = np.searchsorted(at, starts), np.searchsorted(at, ends)
            sizes.append(high - low)
            ids.append(got[gather(low, high - low)])
        return np.concatenate(ids), np.concatenate(sizes)

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        blank = np.array([w.isspace() for w in words])
        order = np.concatenate([np.flatnonzero(~blank), np.flatnonzero(blank)])
        ids, size = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        if not blank.all():
            got = self._encode_words([w for w, b in zip(words, blank) if not b])
            ids.append(got[0])
            size.append(got[1])
        for i in np.flatnonzero(blank):
            got = self.tokenizer.encode(words[i], add_special_tokens=False).ids
            ids.append(np.array(got, np.uint32))
            size.append(np.array([len(got)]))
        keys, size, ids = keys[order], np.concatenate(size), np.concatenate(ids)
        start = len(self.ids) + np.cumsum(size) - size
        all_keys = np.concatenate([self.keys, keys])
        order = np.argsort(all_keys, kind="stable")
        self.keys = all_keys[order]
        self.start = np.concatenate([self.start, start])[order]
        self.size = np.concatenate([self.size, size])[order]
        self.ids = np.concatenate([self.ids, ids])

    def _words(self, text: str, code: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of joined Latin texts, and for each text how many ids it has."""
        mark = np.zeros(len(code) + 1, bool)
        mark[first] = True
        starts = np.flatnonzero(word_starts(code, mark[:-1]))
        ends = np.append(starts[1:], len(code))
        high = hash_spans((code >> 8).astype(np.uint8), starts, ends) if (code > 0xFF).any() else np.uint64(0)
        key = combine([hash_spans((code & 0xFF).astype(np.uint8), starts, ends), ends - starts, high])
        unique, at, back = np.unique(key, return_index=True, return_inverse=True)
        if len(self.keys) + len(unique) > CACHE_WORDS:
            self._forget()
        place = np.searchsorted(self.keys, unique)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == unique[known]
        if not known.all():
            new = at[~known]
            self._learn(unique[~known], [text[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist())])
            place = np.searchsorted(self.keys, unique)
        size = self.size[place][back]
        ids = self.ids[gather(self.start[place][back], size)]
        row = np.searchsorted(first, starts, side="right") - 1
        return ids, np.bincount(row, weights=size, minlength=len(first)).astype(np.int64)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; null counts as empty."""
        texts = [t or "" for t in texts.to_pylist()]
        out = [np.empty(0, np.uint32)] * len(texts)
        full = [i for i, t in enumerate(texts) if t]
        if not full:
            return out
        code = np.frombuffer("".join(texts[i] for i in full).encode("utf-32-le"), np.uint32)
        size = np.array([len(texts[i]) for i in full])
        first = np.cumsum(size) - size
        latin = np.maximum.reduceat(code, first) < LATIN
        plain = [i for i, ok in zip(full, latin) if ok and not any(s in texts[i] for s in self.special)]
        if plain:
            if len(plain) < len(full):
                code = np.frombuffer("".join(texts[i] for i in plain).encode("utf-32-le"), np.uint32)
                size = np.array([len(texts[i]) for i in plain])
                first = np.cumsum(size) - size
            ids, counts = self._words("".join(texts[i] for i in plain), code, first)
            for i, part in zip(plain, np.split(ids, np.cumsum(counts)[:-1])):
                out[i] = part
        for i in set(full) - set(plain):
            out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return out
