"""Public tokenizers in tasks, with each worker's words encoded once."""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import repeat

import numpy as np

from ._text import rolled, rolling

MARK = " \x01"  # stands between words that are encoded in one string


@lru_cache(maxsize=4)
def tokenizer(file: str):
    """The tokenizer of a file; a bare name is looked up among the public tokenizers installed on the executor."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if not os.path.isabs(file):
        import public_tokenizers

        file = public_tokenizers.path(file)
    t = Tokenizer.from_file(file)
    t.no_truncation()
    t.no_padding()
    return t


def ids_of(texts: list[str], file: str) -> list[list[int]]:
    return [e.ids for e in tokenizer(file).encode_batch_fast(texts, add_special_tokens=False)]


class Words(dict):
    """word -> what the tokenizer makes of it, for about `most` words, after which it starts anew.

    Words have no special string in them. They are encoded many in one string, which the library does twice as fast as one by one;
    `joined` gives that string's parts back or None where they can't be told apart, and such words are encoded alone.
    """

    def __init__(self, file: str, most: int = 800_000):
        super().__init__()
        self.file, self.most = file, most

    def learn(self, words: set) -> None:
        if len(self) > self.most:
            self.clear()
        new, rest = list(words.difference(self)), []
        for at in range(0, len(new), 8192):
            parts = [new[k : k + 128] for k in range(at, min(len(new), at + 8192), 128)]
            for part, ids in zip(parts, ids_of([self.glue + self.glue.join(p) for p in parts], self.file)):
                got = self.joined(ids, len(part))
                if got is None:
                    rest += part
                else:
                    self.update(zip(part, got))
        for at in range(0, len(rest), 1024):
            part = rest[at : at + 1024]
            self.update(zip(part, map(self.alone, ids_of([self.lead + w for w in part], self.file))))


class Counted(Words):
    """Numbers of tokens, of a tokenizer that drops white space and encodes what stands between apart."""

    lead, glue = "", MARK + " "

    def joined(self, ids: list[int], n: int):
        [mark] = ids_of([MARK], self.file)[0]
        at = np.flatnonzero(np.array(ids) == mark)
        return (np.diff(at, append=len(ids)) - 1).tolist() if len(at) == n else None

    def alone(self, ids: list[int]) -> int:
        return len(ids)


class Encoded:
    """Ids of whole texts from a byte-level tokenizer that begins a token at every single space before a word.

    Texts are cut at spaces that a character other than white space follows; such a space always begins a token, so what lies between two
    cuts can be encoded apart. Each different stretch is encoded once by the library and found again by a 64-bit hash; its bytes are compared,
    and where two stretches have one hash the library encodes the whole rows.
    """

    def __init__(self, file: str, most: int = 400_000):
        self.file, self.most = file, most
        t = tokenizer(file)
        self.starts = np.zeros(t.get_vocab_size(), bool)
        self.starts[[k for token, k in t.get_vocab().items() if token.startswith("Ġ")]] = True
        self.follows = np.ones(256, bool)  # bytes after a space at which a text may be cut; those left out may begin white space
        self.follows[[*range(0x21), 0x7F, *range(0x80, 0xC3), 0xE1, 0xE2, 0xE3]] = False
        self.forget()

    def forget(self) -> None:
        self.known, self.size, self.used = {}, np.zeros(1 << 16, np.int64), 0
        self.at, self.pool, self.filled = np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32), 0
        self.spell_size, self.spell_at, self.spell, self.spelt = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 20, np.uint8), 0

    def keep(self, part: list[tuple[int, str, bytes]], sizes: np.ndarray, ids: np.ndarray) -> None:
        hashes = [h for h, _, _ in part]
        n = len(hashes)
        while self.used + n > len(self.size):
            self.size, self.at, self.spell_size, self.spell_at = (np.concatenate([x, np.zeros_like(x)]) for x in (self.size, self.at, self.spell_size, self.spell_at))
        spelling = [b for _, _, b in part]
        joined = np.frombuffer(b"".join(spelling), np.uint8)
        while self.spelt + len(joined) > len(self.spell):
            self.spell = np.concatenate([self.spell, np.zeros_like(self.spell)])
        lengths = np.fromiter(map(len, spelling), np.int64, n)
        self.spell_size[self.used : self.used + n] = lengths
        self.spell_at[self.used : self.used + n] = self.spelt + np.cumsum(lengths) - lengths
        self.spell[self.spelt : self.spelt + len(joined)] = joined
        self.spelt += len(joined)
        while self.filled + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.size[self.used : self.used + n] = sizes
        self.at[self.used : self.used + n] = self.filled + np.cumsum(sizes) - sizes
        self.pool[self.filled : self.filled + len(ids)] = ids
        self.known.update(zip(hashes, range(self.used, self.used + n)))
        self.used, self.filled = self.used + n, self.filled + len(ids)

    def learn(self, hashes: list[int], stretches: list[bytes]) -> None:
        every = [(h, b.decode(), b) for h, b in zip(hashes, stretches)]
        joint = [x for x in every if x[1][0] == " "]
        alone = [x for x in every if x[1][0] != " "]
        for at in range(0, len(joint), 8192):
            parts = [joint[k : k + 512] for k in range(at, min(len(joint), at + 8192), 512)]
            for part, ids in zip(parts, ids_of(["".join([w for _, w, _ in p]) for p in parts], self.file)):
                x = np.array(ids, np.uint32)
                cuts = np.flatnonzero(self.starts[x])
                if len(cuts) == len(part) and not cuts[0]:
                    self.keep(part, np.diff(cuts, append=len(x)), x)
                else:
                    alone += part
        for at in range(0, len(alone), 1024):
            part = alone[at : at + 1024]
            lists = ids_of([w for _, w, _ in part], self.file)
            self.keep(part, np.array([len(x) for x in lists]), np.concatenate([np.array(x, np.uint32) for x in lists]))

    def spelt_as(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, which: np.ndarray) -> bool:
        """Whether the stretches, which follow one another and fill buf, have the bytes of the entries `which`."""
        if (self.spell_size[which] != end - start).any():
            return False
        shift = self.spell_at[which] - start
        for low in range(0, len(start), 1 << 16):
            p = slice(low, low + (1 << 16))
            a, b = start[p][0], end[p][-1]
            if (self.spell[np.repeat(shift[p], end[p] - start[p]) + np.arange(a, b)] != buf[a:b]).any():
                return False
        return True

    def __call__(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, and the number of ids of each."""
        n = len(buf)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        cut = np.zeros(n + 1, bool)
        cut[: n - 1] = (buf[:-1] == 0x20) & self.follows[buf[1:]]
        cut[offsets[1:] - 1] = False  # a row's last byte
        cut[offsets] = True
        cut[n] = False
        start = np.flatnonzero(cut)
        end = np.append(start[1:], n)
        h = rolled(rolling(buf), start, end)
        order = np.argsort(h)
        sorted_h = h[order]
        new = np.concatenate([[True], sorted_h[1:] != sorted_h[:-1]])
        distinct = sorted_h[new].tolist()
        if self.used > self.most:
            self.forget()
        index = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        missing = np.flatnonzero(index < 0).tolist()
        if missing:
            one = order[new][missing]
            data = buf.tobytes()
            self.learn([distinct[k] for k in missing], [data[a:b] for a, b in zip(start[one].tolist(), end[one].tolist())])
            index[missing] = np.fromiter(map(self.known.__getitem__, [distinct[k] for k in missing]), np.int64, len(missing))
        which = np.empty(len(h), np.int64)
        which[order] = index[np.cumsum(new) - 1]
        if not self.spelt_as(buf, start, end, which):
            data = buf.tobytes()
            lists = [np.array(x, np.uint32) for x in ids_of([data[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], self.file)]
            return np.concatenate(lists), np.array([len(x) for x in lists])
        sizes = self.size[which]
        upto = np.cumsum(sizes)
        ids = self.pool[np.repeat(self.at[which] - (upto - sizes), sizes) + np.arange(upto[-1])]
        upto = np.concatenate([[0], upto])
        return ids, np.diff(upto[np.searchsorted(start, offsets)])


@lru_cache(maxsize=4)
def counted(file: str) -> Counted:
    return Counted(file)


@lru_cache(maxsize=4)
def encoded(file: str) -> Encoded:
    return Encoded(file)
