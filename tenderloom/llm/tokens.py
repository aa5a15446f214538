"""Token ids of whole texts by the tokenizers library, with the ids of word units remembered.

The byte-level tokenizer cuts a text before every space that a non-space
follows, so the ids of a text are those of its units "first word", " second
word", ... one after the other. Units recur. All units of a stretch of texts are
found, hashed (64 bits) and looked up in one table with array operations, and
their ids gathered from one array; only units that the table lacks are encoded,
thousands in one string, whose ids are told apart by the tokens that begin with
a space. So neither a look-up nor a call is paid for each word. The table is
bounded; units of more than `LONG` bytes are encoded each time. A text where a
unit's end is not such a cut (white space on both sides of a space, or before a
last one), or that holds a special token's string, is encoded as a whole.
"""

from __future__ import annotations

import re

import numpy as np

from . import common as c

FILE = "byte_bpe_50k.json"
#: Units and ids that a worker remembers, about 60 MB; past either the later half goes, the early and frequent ones stay.
ROOM, IDS = 1 << 20, 1 << 22
#: Bytes of a unit that is remembered at most, and units encoded in one string.
LONG, JOINED = 256, 4_000
#: Bytes of text in one array step.
STEP = 1 << 19
_UNSAFE = re.compile(r"\s (?:\s|\Z)")
#: Bytes that a character which may be white space begins with.
_MAY_BE_SPACE = np.zeros(256, bool)
_MAY_BE_SPACE[[*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3]] = True
_FIRST = np.uint64(0xA24BAED4963EE407)  # units at a text's begin have ids of their own


def vocabulary(name: str = FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Table:
    """64-bit keys to runs of ids: open addressing in arrays, keys looked up and added many at a time."""

    def __init__(self, room: int = ROOM, ids: int = IDS):
        self.room, self.most_ids, self.slots = room, ids, 1 << (2 * room - 1).bit_length()
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(self.slots, np.uint64)  # 0: free
        self.entry = np.zeros(self.slots, np.int32)
        self.names = np.zeros(self.room, np.uint64)
        self.starts = np.zeros(self.room + 1, np.int64)
        self.flat = np.zeros(self.most_ids, "<u4")
        self.size = self.fill = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Entry of each key; -1 where it is not there."""
        mask = np.uint64(self.slots - 1)
        out = np.full(len(keys), -1, np.int64)
        left, at = np.arange(len(keys)), (keys & mask).astype(np.int64)
        while len(left):
            have = self.keys[at]
            hit = have == keys[left]
            out[left[hit]] = self.entry[at[hit]]
            go = ~hit & (have != 0)
            left, at = left[go], (at[go] + 1) & int(mask)
        return out

    def add(self, keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """New and distinct keys with their ids, one run after the other."""
        keep = min(len(keys), self.room - self.size, int(np.searchsorted(np.cumsum(sizes), self.most_ids - self.fill, "right")))
        keys, sizes, ids = keys[:keep], sizes[:keep], ids[: int(sizes[:keep].sum())]
        entries = np.arange(self.size, self.size + keep, dtype=np.int32)
        self.names[entries] = keys
        self.starts[self.size + 1: self.size + keep + 1] = self.fill + np.cumsum(sizes)
        self.flat[self.fill: self.fill + len(ids)] = ids
        self.size, self.fill = self.size + keep, self.fill + len(ids)
        self._place(keys, entries)

    def _place(self, keys: np.ndarray, entries: np.ndarray) -> None:
        mask = self.slots - 1
        at = (keys & np.uint64(mask)).astype(np.int64)
        while len(keys):
            free = np.flatnonzero(self.keys[at] == 0)
            self.keys[at[free]] = keys[free]  # of several for one slot the last one stays
            put = free[self.keys[at[free]] == keys[free]]
            self.entry[at[put]] = entries[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, entries, at = keys[rest], entries[rest], (at[rest] + 1) & mask

    def halve(self) -> None:
        """Forget the later half."""
        stay = self.size // 2
        names, ends, flat = self.names[:stay].copy(), self.starts[: stay + 1].copy(), self.flat[: self.starts[stay]].copy()
        self.clear()
        self.add(names, np.diff(ends), flat)

    def full(self) -> bool:
        return self.size > 0.9 * self.room or self.fill > 0.9 * self.most_ids


class Coder:
    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        words = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(words.values(), default=0) + 1, bool)
        self.spaced[[i for word, i in words.items() if word.startswith("Ġ")]] = True  # the byte-level sign for a space
        self.table = Table()

    @staticmethod
    def of(path: str | None = None) -> Coder:
        path = path or vocabulary()
        state = c.worker_state()
        if ("coder", path) not in state:
            state["coder", path] = Coder(path)
        return state["coder", path]

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _units(self, start: np.ndarray, end: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sizes, places and ids of the units that lie at start:end; those that begin with a space and a non-space in long strings."""
        second = data[np.minimum(start + 1, len(data) - 1)]
        joins = (data[start] == 32) & (end - start > 1) & ~_MAY_BE_SPACE[second]
        joined, alone = np.flatnonzero(joins), np.flatnonzero(~joins).tolist()
        raw = data.tobytes() if alone else b""
        sizes, places, parts, at = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), [], 0

        def put(units: np.ndarray, own: np.ndarray, ids: np.ndarray) -> None:
            nonlocal at
            sizes[units], places[units] = own, at + np.cumsum(own) - own
            parts.append(ids)
            at += len(ids)

        def one_by_one(units: list[int], texts: list[str]) -> None:
            ids = self._whole(texts)
            put(np.array(units, np.int64), np.array([len(x) for x in ids], np.int64), np.concatenate(ids))

        blocks = [joined[s: s + JOINED] for s in range(0, len(joined), JOINED)]
        texts = [data[c.spread(start[b], end[b] - start[b])].tobytes().decode("utf-8", "replace") for b in blocks]
        for block, text, ids in zip(blocks, texts, self._whole(texts), strict=True):
            cuts = np.flatnonzero(self.spaced[ids])
            if len(cuts) == len(block):
                put(block, np.diff(cuts, append=len(ids)), ids)
            else:  # a tokenizer that cuts elsewhere
                one_by_one(block.tolist(), [" " + x for x in text[1:].split(" ")])
        if alone:
            one_by_one(alone, [raw[x:y].decode("utf-8", "replace") for x, y in zip(start[alone].tolist(), end[alone].tolist(), strict=True)])
        return sizes, places, np.concatenate(parts) if parts else np.zeros(0, "<u4")

    def encode(self, texts: list[str], ends: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets (n + 1) and ids of texts, whose bytes are `data` cut at `ends`; without special tokens."""
        plain = np.array([not _UNSAFE.search(t) and not any(s in t for s in self.special) for t in texts], bool)
        n = len(texts)
        begin, stop = ends[:-1], ends[1:]
        space = np.flatnonzero(data == 32)
        before = np.searchsorted(space, ends)  # spaces ahead of each text
        row = np.repeat(np.arange(n), np.diff(before))
        start, end = np.zeros(len(space) + n, np.int64), np.zeros(len(space) + n, np.int64)
        head, tail = before[:-1] + np.arange(n), np.arange(len(space)) + row + 1
        following = np.append(space, len(data))
        start[head], end[head] = begin, np.minimum(following[before[:-1]], stop)
        start[tail], end[tail] = space, np.minimum(following[1:], stop[row])
        used = np.ones(len(start), bool)
        used[head], used[tail] = plain, plain[row]
        sizes, gathered = self._looked_up(start, end, head, used, data)
        per_text = np.add.reduceat(sizes, head) if n else np.zeros(0, np.int64)
        if plain.all():
            return np.append(0, np.cumsum(per_text)), gathered
        odd = np.flatnonzero(~plain)
        whole = self._whole([texts[i] for i in odd])
        per_text[odd] = [len(x) for x in whole]
        offsets = np.append(0, np.cumsum(per_text))
        out = np.zeros(int(offsets[-1]), "<u4")
        mine = np.repeat(plain, per_text)
        out[mine] = gathered
        out[~mine] = np.concatenate(whole)
        return offsets, out

    def _looked_up(self, start: np.ndarray, end: np.ndarray, head: np.ndarray, used: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each unit has, and the ids of all; units that are not used have none."""
        if self.table.full():
            self.table.halve()
        prefix = c.prefix_hash(data)
        key = c.span_hash(prefix, start, end)
        key[head] ^= _FIRST
        key[key == 0] = 1
        long = end - start > LONG
        at = self.table.find(key)
        at[~used | long | (start == end)] = -1
        sizes, runs = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        known = at >= 0
        runs[known] = self.table.starts[at[known]]
        sizes[known] = self.table.starts[at[known] + 1] - runs[known]
        lack = np.flatnonzero(~known & used & (end > start))
        if not len(lack):
            return sizes, self.table.flat[c.spread(runs, sizes)]
        tag = np.where(long[lack], np.uint64(0), key[lack])
        tag[long[lack]] = np.arange(1, int(long[lack].sum()) + 1, dtype=np.uint64)  # long ones are not compared
        both = np.rec.fromarrays([long[lack], tag]) if long[lack].any() else tag
        _, lead, back = np.unique(both, return_index=True, return_inverse=True)
        first = lack[lead]
        new_sizes, new_places, new_ids = self._units(start[first], end[first], data)
        runs[lack], sizes[lack] = new_places[back], new_sizes[back]
        new = np.zeros(len(start), bool)
        new[lack] = True
        new, at = np.repeat(new, sizes), c.spread(runs, sizes)
        out = np.empty(len(at), "<u4")
        out[new], out[~new] = new_ids[at[new]], self.table.flat[at[~new]]
        short = ~long[first]
        self.table.add(key[first][short], new_sizes[short], new_ids[c.spread(new_places[short], new_sizes[short])])
        return sizes, out


def encoded(batch, path: str | None = None):
    """(rows, ids as bytes) of a batch's `text`, a bounded stretch at a time; nulls are empty."""
    column = batch.column("text")
    ends, data = c.as_bytes(column)
    for a, b in c.steps(ends, STEP):
        texts = [t or "" for t in column.slice(a, b - a).to_pylist()]
        offsets, ids = Coder.of(path).encode(texts, ends[a: b + 1] - ends[a], data[ends[a]: ends[b]])
        yield slice(a, b), [ids[x:y].tobytes() for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
