"""Byte-level BPE ids of whole batches of texts, with each distinct piece merged once.

The pre-tokenizer's pattern is applied with array operations over code points;
its pieces are told apart by a 64-bit hash, and only pieces not met before go
through the merges. The file's control strings inside a text have ids of their own.
Ids equal those of the tokenizers library on the same file, with its settings as
they come and add_special_tokens=False.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np

from skipscan.llm.common import mixed

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3


def load_ranks(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """(token bytes to id, control strings to id), from a tokenizers JSON file whose merges stand in the order of their ids."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model, added = told["model"], told["added_tokens"]
    if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in added):
        raise ValueError(f"{path}: control strings that depend on what is around them")
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stands = {chr(c): c for c in plain} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in set(plain))}
    ranks = {bytes(stands[c] for c in t): i for t, i in model["vocab"].items() if all(c in stands for c in t)}
    made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if made != sorted(made):
        raise ValueError(f"{path}: merges are not in the order of ids")
    return ranks, {x["content"]: x["id"] for x in added}


class Encoder:
    """Not for sharing between processes; its memory is bounded by MOST pieces."""

    MOST = 250_000
    #: Code points that are looked at together, unless one text has more.
    STRETCH = 1 << 19

    def __init__(self, path: str):
        import tiktoken

        ranks, self.control = load_ranks(path)
        self.controls = re.compile("(" + "|".join(map(re.escape, sorted(self.control, key=len, reverse=True))) + ")") if self.control else None
        merge = tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        self.merge = merge._encode_single_piece
        self.kinds = np.full(0x110000, 255, np.uint8)
        rng = np.random.Generator(np.random.PCG64(7))
        self.values = rng.integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = 0x2545F4914F6CDD1D
        self.up, self.down = np.array([1], np.uint64), np.array([1], np.uint64)
        self.base = base, pow(base, -1, 2**64)
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _kinds(self, cp: np.ndarray) -> np.ndarray:
        got = self.kinds[cp]
        if (got == 255).any():
            for c in np.unique(cp[got == 255]).tolist():
                k = unicodedata.category(chr(c))[0]
                space = c in (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000) or 0x2000 <= c <= 0x200A
                self.kinds[c] = SPACE if space else LETTER if k == "L" else NUMBER if k == "N" else OTHER
            got = self.kinds[cp]
        return got

    def _starts(self, cp: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """Where pieces begin. fresh: where texts begin."""
        n = len(cp)
        kind = self._kinds(cp)
        run = np.empty(n, bool)
        run[0] = True
        run[1:] = kind[1:] != kind[:-1]
        run[fresh] = True
        space = kind == SPACE
        # The last white space of a run before other text stands apart from the rest of the run, and a plain space goes to what follows.
        last = np.zeros(n, bool)
        last[:-1] = space[:-1] & ~space[1:]
        last[fresh[fresh > 0] - 1] = False
        start = run.copy()
        start[last] = True
        glue = np.flatnonzero(last & (cp == 32))
        start[glue + 1] = False
        # 's 't 'm 'd 're 've 'll where a piece begins at the apostrophe.
        new = np.zeros(n, bool)
        new[fresh] = True
        for a in np.flatnonzero((cp[:-1] == 39) & start[:-1] & (kind[1:] == LETTER) & run[1:] & ~new[1:]).tolist():
            if start[a + 1]:
                two = bytes(min(c, 255) for c in cp[a + 1 : a + 3].tolist())
                size = 1 if two[:1] in (b"s", b"t", b"m", b"d") else 2 if two in (b"re", b"ve", b"ll") and not (a + 2 < n and start[a + 2]) else 0
                if size:
                    start[a + 1] = False
                    if a + 1 + size < n:
                        start[a + 1 + size] = True
        return np.flatnonzero(start)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in a row, number of ids of each text)."""
        ids, counts, part, size = [], [], [], 0
        for t in texts:
            if self.controls and self.controls.search(t):
                pieces = self.controls.split(t)
                plain = self._plain(pieces[::2])
                at, own = np.concatenate(([0], np.cumsum(plain[1]))), []
                for i in range(len(plain[1])):
                    own += plain[0][at[i] : at[i + 1]], [self.control[x] for x in pieces[2 * i + 1 : 2 * i + 2]]
                whole = np.concatenate(own).astype(np.uint32)
                done = self._plain(part)
                ids += done[0], whole
                counts += done[1], np.array([len(whole)], np.int64)
                part, size = [], 0
                continue
            part.append(t)
            size += len(t)
            if size >= self.STRETCH:
                done = self._plain(part)
                ids.append(done[0])
                counts.append(done[1])
                part, size = [], 0
        done = self._plain(part)
        return np.concatenate([*ids, done[0]]), np.concatenate([*counts, done[1]])

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """encode() of texts without control strings, all at once."""
        sizes = np.array([len(t) for t in texts], np.int64)
        whole = "".join(texts)
        cp = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        if not len(cp):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        starts = self._starts(cp, begins[sizes > 0])
        ends = np.append(starts[1:], len(cp))
        keys = self._hashes(cp, starts, ends)
        if len(self.keys) > self.MOST:
            self._clear()
        unique, where, back = np.unique(keys, return_index=True, return_inverse=True)
        slot = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), bool)
        inside = slot < len(self.keys)
        known[inside] = self.keys[slot[inside]] == unique[inside]
        if not known.all():
            self._learn(whole, unique[~known], starts[where[~known]], ends[where[~known]])
            slot = np.searchsorted(self.keys, unique)
        first, count = self.first[slot][back], self.count[slot][back]
        total = np.cumsum(count)
        ids = self.pool[np.repeat(first - (total - count), count) + np.arange(total[-1])]
        upto = np.concatenate(([0], total))
        piece = np.searchsorted(starts, np.concatenate((begins, [len(cp)])))
        return ids, np.diff(upto[piece])

    def _hashes(self, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            if len(self.up) <= len(cp):
                for name, b in zip(("up", "down"), self.base, strict=True):
                    powers = np.full(len(cp) * 5 // 4 + 2, b, np.uint64)
                    powers[0] = 1
                    setattr(self, name, np.cumprod(powers, dtype=np.uint64))
            sums = np.zeros(len(cp) + 1, np.uint64)
            values = self.values[cp & 4095] + (cp >> 12).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            np.cumsum(values * self.up[: len(cp)], out=sums[1:])
            return mixed((sums[ends] - sums[starts]) * self.down[starts])

    def _learn(self, whole, keys, starts, ends) -> None:
        ids = [self.merge(whole[a:b].encode()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        count = np.array([len(x) for x in ids], np.int64)
        first = len(self.pool) + np.cumsum(count) - count
        self.pool = np.concatenate((self.pool, np.array([x for y in ids for x in y], np.uint32)))
        keys = np.concatenate((self.keys, keys))
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.first = np.concatenate((self.first, first))[order]
        self.count = np.concatenate((self.count, count))[order]
