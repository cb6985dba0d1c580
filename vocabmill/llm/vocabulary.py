"""The vocabulary of a word BPE tokenizer, and its merges for many words at once."""

from __future__ import annotations

import heapq
import json

import numpy as np

from vocabmill.llm.pretokens import SPECIAL_MARKS

#: Words of more bytes are merged one by one, with a heap.
LONG_WORD = 48
NONE = np.int32(2**31 - 1)
#: What the vocabulary's file says of splitting; other files are refused.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """``merge`` gives the ids of words; ``tokens`` the text of ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        splits = [x["pattern"].get("Regex") for x in data["pre_tokenizer"]["pretokenizers"] if "pattern" in x]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != "</w>" or splits != [SPLIT_PATTERN]:
            raise ValueError(f"{path}: not a vocabulary of words with word ends")
        ids = model["vocab"]
        self.special = {mark: x["id"] for x in data["added_tokens"] for token, mark in SPECIAL_MARKS.items() if x["content"] == token}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for token, number in ids.items():
            self.tokens[number] = token
        for x in data["added_tokens"]:
            self.tokens[x["id"]] = x["content"]
        symbols = byte_symbols()
        self.inner = np.array([ids[s] for s in symbols], np.int32)
        self.final = np.array([ids[s + "</w>"] for s in symbols], np.int32)
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        left, right = (np.array([ids[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.made = np.array([ids[a + b] for a, b in pairs], np.int32)
        keys = left << 20 | right
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self._slots()
        self.rank_of = dict(zip(keys.tolist(), range(len(pairs)), strict=True))

    def _slots(self) -> None:
        """A table of the pairs, by open addressing."""
        self.bits = 18
        self.slot_key = np.full((1 << self.bits) + 64, -1, np.int64)
        self.slot_rank = np.full((1 << self.bits) + 64, NONE, np.int32)
        todo = np.arange(len(self.keys))
        at = self._home(self.keys)
        while len(todo):
            free = self.slot_key[at] < 0
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            taken = np.zeros(len(at), bool)
            taken[first] = free[first]
            self.slot_key[at[taken]] = self.keys[todo[taken]]
            self.slot_rank[at[taken]] = self.ranks[todo[taken]]
            todo, at = todo[~taken], at[~taken] + 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, ``NONE`` if there is none."""
        keys = left.astype(np.int64) << 20 | right
        at = self._home(keys)
        found = self.slot_key[at]
        ranks = np.where(found == keys, self.slot_rank[at], NONE)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            at[open_] += 1
            found = self.slot_key[at[open_]]
            hit = found == keys[open_]
            ranks[open_[hit]] = self.slot_rank[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return ranks

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each word has."""
        raw = [b"" if w in self.special else w.encode() for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        short = (lengths > 0) & (lengths <= LONG_WORD)
        numbers, ids = self._merge_short([raw[i] for i in np.flatnonzero(short)], np.flatnonzero(short))
        for i in np.flatnonzero(~short):
            own = [self.special[words[i]]] if words[i] in self.special else self._merge_long(raw[i])
            numbers.append(np.full(len(own), i))
            ids.append(np.array(own, np.int32))
        if not numbers:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        number = np.concatenate(numbers)
        order = np.argsort(number, kind="stable")
        return np.concatenate(ids)[order], np.bincount(number, minlength=len(words))

    def _merge_short(self, raw: list[bytes], number: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """In each round, the best pair of every word is merged."""
        if not raw:
            return [], []
        data = np.frombuffer(b"".join(raw), np.uint8)
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(lengths)
        word = np.repeat(number, lengths)
        symbol = self.inner[data]
        symbol[ends - 1] = self.final[data[ends - 1]]
        rank = np.full(len(symbol), NONE)
        rank[:-1] = self.pair_ranks(symbol[:-1], symbol[1:])
        rank[ends - 1] = NONE
        starts = ends - lengths
        numbers, ids = [], []
        while len(symbol):
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(symbol)))
            done = best == NONE
            if done.any():
                over = np.repeat(done, sizes)
                numbers.append(word[over])
                ids.append(symbol[over])
                word, symbol, rank = word[~over], symbol[~over], rank[~over]
                best, sizes = best[~done], sizes[~done]
                starts = np.cumsum(sizes) - sizes
                if not len(symbol):
                    break
            hits = np.flatnonzero(rank == np.repeat(best, sizes))
            owner = word[hits]
            at = hits[np.concatenate(([True], owner[1:] != owner[:-1]))]
            symbol[at] = self.made[best]
            gone = np.zeros(len(symbol), bool)
            gone[at + 1] = True
            # The new symbol has the neighbour that the removed one had.
            rank[at] = rank[at + 1]
            keep = ~gone
            symbol, word, rank = symbol[keep], word[keep], rank[keep]
            at = at - np.arange(len(at))
            sizes -= 1
            starts = np.cumsum(sizes) - sizes
            last = np.zeros(len(symbol), bool)
            last[starts + sizes - 1] = True
            right = at[~last[at]]
            rank[right] = self.pair_ranks(symbol[right], symbol[right + 1])
            rank[at[last[at]]] = NONE
            left = at[at > starts] - 1
            rank[left] = self.pair_ranks(symbol[left], symbol[left + 1])
        return numbers, ids

    def _merge_long(self, raw: bytes) -> list[int]:
        """One word of any length, in n log n steps."""
        symbol = self.inner[np.frombuffer(raw, np.uint8)].tolist()
        symbol[-1] = int(self.final[raw[-1]])
        size = len(symbol)
        after, before = [*range(1, size), -1], [*range(-1, size - 1)]
        heap = []

        def push(i):
            j = after[i]
            if j >= 0 and (rank := self.rank_of.get(symbol[i] << 20 | symbol[j])) is not None:
                heapq.heappush(heap, (rank, i, symbol[i], symbol[j]))

        for i in range(size - 1):
            push(i)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != a or j < 0 or symbol[j] != b:
                continue
            symbol[i], symbol[j] = int(self.made[rank]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        result, i = [], 0
        while i >= 0:
            result.append(symbol[i])
            i = after[i]
        return result
