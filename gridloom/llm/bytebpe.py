"""Byte-level BPE over batches of texts.

``Units`` cuts texts into units that no pre-token crosses and looks each unit
up in a bounded memo; a text costs its distinct new units only.  ``count_batch``
is the rank-synchronous merge: all sequences of a batch are one ragged numpy
array, and each round applies every sequence's lowest-rank pair at once.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import regex

#: Fixed value: the pre-token pattern of byte-level BPE files (ByteLevel, use_regex).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRETOKENS = regex.compile(PATTERN)
CUT = re.compile(r"(?<=\S) (?=\S)")
NONE = np.int64(1) << 40


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in such files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    of = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}
    return [of[b] for b in range(256)]


class Ranks:
    """Merge ranks of a byte-level BPE file, as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["normalizer"]:
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        if model.get("ignore_merges") or model.get("dropout"):
            raise ValueError(f"{path}: ignore_merges and dropout are not supported")
        vocab = model["vocab"]
        self.byte_ids = np.array([vocab[s] for s in byte_symbols()], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        new = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        keys, first = np.unique((left << 32) | right, return_index=True)
        self.keys, self.rank, self.new = keys, first.astype(np.int64), new[first]
        self.bits = max(12, int(len(keys)).bit_length() + 4)
        self.seen = np.zeros(1 << self.bits, dtype=bool)
        self.seen[self.slot(keys)] = True
        self.special = [t["content"] for t in spec["added_tokens"]]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens that strip or match words are not supported")

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look(self, keys: np.ndarray) -> np.ndarray:
        """Index of each pair's merge, -1 where there is none."""
        out = np.full(len(keys), -1, dtype=np.int64)
        may = np.flatnonzero(self.seen[self.slot(keys)])
        at = np.searchsorted(self.keys, keys[may])
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == keys[may]
        out[may[hit]] = at[hit]
        return out


@functools.lru_cache(maxsize=4)
def ranks(path: str) -> Ranks:
    return Ranks(path)


def count_batch(table: Ranks, tokens: list[bytes]) -> np.ndarray:
    """Symbols that survive BPE for each byte string."""
    sizes = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    out = sizes.copy()
    open_ = np.flatnonzero(sizes > 1)
    if not len(open_):
        return out
    sym = table.byte_ids[np.frombuffer(b"".join([tokens[k] for k in open_]), dtype=np.uint8)]
    owner = np.repeat(np.arange(len(open_)), sizes[open_])

    def merges(left, right, same):
        at = np.full(len(left), -1, dtype=np.int64)
        at[same] = table.look((left[same] << 32) | right[same])
        return at

    # merge index of the pair that begins at each symbol; the last symbol of a sequence has none
    pair = np.append(merges(sym[:-1], sym[1:], np.flatnonzero(owner[:-1] == owner[1:])), -1)
    while len(sym):
        rank = np.where(pair >= 0, table.rank[pair], NONE)
        start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        least = np.minimum.reduceat(rank, start)
        length = np.diff(np.append(start, len(sym)))
        done = least == NONE
        if done.any():
            out[open_[owner[start[done]]]] = length[done]
            stay = np.repeat(~done, length)
            sym, owner, pair, rank = sym[stay], owner[stay], pair[stay], rank[stay]
            least, length = least[~done], length[~done]
            if not len(sym):
                break
        hit = np.flatnonzero(rank == np.repeat(least, length))
        # in a run of one symbol its pairs overlap: take every other one, from the left
        touch = np.append(False, (hit[1:] == hit[:-1] + 1) & (owner[hit[1:]] == owner[hit[:-1]]))
        if touch.any():
            run = np.maximum.accumulate(np.where(touch, 0, np.arange(len(hit))))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
        sym[hit] = table.new[pair[hit]]
        gone = np.zeros(len(sym), dtype=bool)
        gone[hit + 1] = True
        # only pairs beside a merge change
        fresh = np.zeros(len(sym), dtype=bool)
        fresh[hit] = True
        before = hit - 1
        before = before[before >= 0]
        before = np.where(gone[before], before - 1, before)
        fresh[before[before >= 0]] = True
        keep = ~gone
        sym, owner, pair, fresh = sym[keep], owner[keep], pair[keep], fresh[keep]
        at = np.flatnonzero(fresh)
        last = at == len(sym) - 1
        nxt = np.where(last, at, at + 1)
        same = ~last & (owner[nxt] == owner[at])
        pair[at] = -1
        at = at[same]
        pair[at] = table.look((sym[at] << 32) | sym[at + 1])
    return out


def blocks(text: str, size: int = 1 << 20):
    """The text in blocks cut before single spaces between other characters; no pre-token crosses such a cut."""
    start = 0
    while len(text) - start > size:
        cut = CUT.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


#: White space other than space and newline, to Python or to the pattern.
ODD_SPACES = [chr(c) for c in [*range(9, 10), *range(11, 14), *range(28, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]]
PAIRS = ["  ", "\n\n", " \n", "\n "]


def plain_spaced(text: str) -> bool:
    """Words apart by one space or one newline each, none at the ends."""
    if not text or text[0] in " \n" or text[-1] in " \n":
        return False
    return not any(p in text for p in PAIRS) and not any(c in text for c in ODD_SPACES)


class Units:
    """Values of texts as lists of memoised values of their units.

    A unit is a word with the one space before it, or with the one newline
    before it; texts with other white space are cut by the pre-token pattern.
    ``solve(list of strings) -> list of values`` is called with new units only.
    The memo holds at most ``most`` units; full, it starts again (a memo only:
    values never depend on it).
    """

    def __init__(self, solve, special: list[str], most: int = 450_000):
        self.solve, self.special, self.most = solve, special, most
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.spaced: dict = {}  # word -> value of " word"; "\nword" -> value of itself
        self.bare: dict = {}

    def batch(self, texts: list[str]) -> list[list]:
        """For each text its units' values in order; special strings give the value None."""
        if len(self.spaced) + len(self.bare) > self.most:
            self.spaced.clear()
            self.bare.clear()
        out, late = [], {True: [], False: []}  # late: (list of values, place, unit) to be filled in
        for text in texts:
            values: list = []
            parts = self.split.split(text) if self.split and any(s in text for s in self.special) else [text]
            for k, part in enumerate(parts):
                if k % 2:
                    values.append(None)
                    continue
                for block in blocks(part):
                    lead = block[:1] == " "
                    body = block[1:] if lead else block
                    if plain_spaced(body):
                        units = body.replace("\n", " \n").split(" ")
                        if not lead:
                            self._look(False, units[:1], values, late)
                            del units[0]
                        self._look(True, units, values, late)
                    else:
                        self._look(False, PRETOKENS.findall(block), values, late)
            out.append(values)
        for spaced, memo in ((True, self.spaced), (False, self.bare)):
            new = list({u for _, _, u in late[spaced]})
            if new:
                memo.update(zip(new, self.solve([u if not spaced or u[0] == "\n" else " " + u for u in new])))
                for values, at, u in late[spaced]:
                    values[at] = memo[u]
        return out

    def _look(self, spaced: bool, units: list[str], values: list, late: dict) -> None:
        found = list(map((self.spaced if spaced else self.bare).get, units))
        if None in found:
            base = len(values)
            late[spaced] += [(values, base + k, units[k]) for k, v in enumerate(found) if v is None]
        values += found


def groups(texts: list, size: int = 1 << 22):
    """Runs of texts of about ``size`` characters; nulls read as empty."""
    at, held = 0, []
    for t in texts:
        held.append(t or "")
        at += len(held[-1])
        if at >= size:
            yield held
            at, held = 0, []
    if held:
        yield held
