"""BPE encoding and decoding: speculate, verify, and merge exactly only where that fails.

A word is first cut greedily into the longest vocabulary entries.  A sequence of
reachable tokens is the true BPE result exactly if each adjacent pair would
survive merging on its own, so one vectorised check over the distinct adjacent
pairs of a whole batch decides which proposals stand.  Only words that hold an
incompatible pair go through rank-ordered merging.

Edge cases: a null or empty text gives no tokens and an empty decoded text; very
long texts and words stay whole; repeated rows are encoded alike; an input
column named like an output column is replaced.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, types as T

from .arrow import int_lists, map_slices

#: The contractions that the tokenizer's splitting rule keeps whole.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
#: Distinct words whose tokens a worker remembers before it starts anew.
REMEMBERED_WORDS = 200_000
#: Widths, in symbols, of the grids in which failing words are merged side by side; longer words use a heap.
SIDE_BY_SIDE = (8, 16, 32)
_NEVER = np.int64(2**62)


#: Letters and numbers that Unicode 17 added, as first-last in hexadecimal.  The
#: tokenizer splits by Unicode 16, the matcher here by Unicode 17.
LATER_LETTERS = """
558-558 58b-58c 88f-88f c5c-c5c cdc-cdc 208f-208f 209d-209f a7ce-a7cf a7d2-a7d2 a7d4-a7d4 a7dd-a7dd
a7e2-a7e2 a7f1-a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a-11b0a 11db0-11ddb
11de0-11de9 11df1-11df1 1246f-1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6
187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168-1b168
1d6a6-1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5
1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e-2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f
"""
#: Lower-case forms that Unicode 16 and 17 added, which Python 3.13 doesn't know.
LATER_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LATER_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}


@functools.cache
def _wide_words() -> regex.Pattern:
    """The splitting rule for any text."""
    late = re.sub(r"(\w+)-(\w+)\s*", lambda m: f"\\U{m[1]:0>8}-\\U{m[2]:0>8}", LATER_LETTERS.strip())
    letter, digit = rf"[\p{{L}}--[{late}]]", rf"[\p{{N}}--[{late}]]"
    rest = rf"[^\p{{White_Space}}[\p{{L}}\p{{N}}--[{late}]]]"
    return regex.compile(f"{CONTRACTIONS}|{letter}+|{digit}|{rest}+", regex.VERSION1)


def _narrow_words() -> re.Pattern:
    """The same splitting rule with explicit classes, for texts below U+0100; the standard matcher is faster."""
    kinds: dict[str, str] = {"L": "", "N": "", "Z": ""}
    for code in range(0x100):
        char = chr(code)
        kind = unicodedata.category(char)[0]
        kind = "Z" if char.isspace() and not "\x1c" <= char <= "\x1f" else kind
        if kind in kinds:
            kinds[kind] += f"\\x{code:02x}"
    return re.compile(f"{CONTRACTIONS}|[{kinds['L']}]+|[{kinds['N']}]|[^{kinds['Z']}{kinds['L']}{kinds['N']}]+")


_NARROW_WORDS = _narrow_words()


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one above U+00FF."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class PairRanks:
    """The rank of each mergeable pair, in an open hash table that whole arrays are looked up in."""

    BITS = 19

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.full(2**self.BITS, -1, dtype=np.int64)
        self.ranks = np.full(2**self.BITS, _NEVER, dtype=np.int64)
        open_, self.probes = np.arange(len(keys))[::-1], 0  # the first of equal keys is written last and stays
        while open_.size:
            at = self._slot(keys[open_], self.probes)
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[open_[free]]
            won = self.keys[at] == keys[open_]
            self.ranks[at[won]] = open_[won]
            open_ = open_[~won]
            self.probes += 1

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        mixed = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)
        return (mixed.astype(np.int64) + probe) & (2**self.BITS - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        shape, keys = keys.shape, keys.ravel()
        at = self._slot(keys, 0)
        out = np.where(self.keys[at] == keys, self.ranks[at], _NEVER)
        for probe in range(1, self.probes):
            left = np.flatnonzero((out == _NEVER) & (self.keys[at] != -1)) if probe == 1 else left[out[left] == _NEVER]
            if not left.size:
                break
            at_left = self._slot(keys[left], probe)
            out[left] = np.where(self.keys[at_left] == keys[left], self.ranks[at_left], _NEVER)
        return out.reshape(shape)


class WordBpe:
    """A word-level BPE vocabulary with a word-end suffix, read from its JSON description."""

    def __init__(self, description: str) -> None:
        spec = json.loads(description)
        model = spec["model"]
        self.suffix: str = model["end_of_word_suffix"]
        ids: dict[str, int] = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*ids.values(), *self.specials.values()]) + 1
        self.tokens = [""] * size
        for token, i in chain(ids.items(), self.specials.items()):
            self.tokens[i] = token
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([ids[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([ids[b] for _, b in pairs], dtype=np.int64)
        made = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        self.size = size
        self.pairs = PairRanks(left * size + right)
        self.made = made
        self.merges = {(a, b): (rank, c) for rank, (a, b, c) in reversed([*enumerate(zip(left.tolist(), right.tolist(), made.tolist()))])}
        self.rank = np.full(size, -1, dtype=np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        for rank in range(len(pairs) - 1, -1, -1):
            self.rank[made[rank]], self.left[made[rank]], self.right[made[rank]] = rank, left[rank], right[rank]
        self.bytes_as = byte_alphabet()
        self.base = {c: ids[c] for c in self.bytes_as}
        self.base_end = {c: ids[c + self.suffix] for c in self.bytes_as}
        reachable = self._reachable()
        self.inner: dict[str, int] = {}
        self.final: dict[str, int] = {}
        for token, i in ids.items():
            if reachable[i]:
                if token.endswith(self.suffix) and len(token) > len(self.suffix):
                    self.final[token.removesuffix(self.suffix)] = i
                else:
                    self.inner[token] = i
        self.reach: dict[str, int] = {}  # the longest entry that starts with these two characters
        for token in chain(self.inner, self.final):
            self.reach[token[:2]] = max(self.reach.get(token[:2], 1), len(token))
        self.known: dict[str, tuple[int, ...]] = {}
        self.special_heads = {s[:2] for s in self.specials}  # a quick test for texts that can hold none
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of merging each pair, or a number above all ranks."""
        return self.pairs.find(a * self.size + b)

    def _reachable(self) -> np.ndarray:
        """Which entries merging can produce from their own characters."""
        made = np.flatnonzero(self.rank >= 0)
        fine = np.ones(self.size, dtype=bool)
        fine[made] = self.compatible(self.left[made], self.right[made], self.rank[made])
        for i in made[np.argsort(self.rank[made])].tolist():
            fine[i] &= fine[self.left[i]] and fine[self.right[i]]
        return fine

    def compatible(self, a: np.ndarray, b: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
        """Whether merging leaves the tokens ``a`` and ``b``, side by side, as they are.

        Merges at the shared edge are undone from the latest on; at no moment may a
        merge across the edge come before the one that is undone.  With equal ranks
        the left place merges first.
        """
        fine = np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        below = np.full(len(a), _NEVER) if below is None else below.astype(np.int64)
        while live.size:
            crossed = self._rank_of(a, b) < below
            fine[live[crossed]] = False
            rank_a, rank_b = self.rank[a], self.rank[b]
            go = ~crossed & ((rank_a >= 0) | (rank_b >= 0))
            live, a, b, rank_a, rank_b = live[go], a[go], b[go], rank_a[go], rank_b[go]
            undo_a = rank_a > rank_b
            below = np.where(undo_a, rank_a, rank_b + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return fine

    def propose(self, word: str) -> tuple[int, ...]:
        """Greedy longest match over ``word`` in the byte alphabet."""
        out, at, end = [], 0, len(word)
        inner, final, reach = self.inner, self.final, self.reach
        while at < end:
            far = at + reach.get(word[at : at + 2], 1)
            if end <= far and (token := final.get(word[at:])) is not None:
                out.append(token)
                break
            for stop in range(far if far < end else end - 1, at, -1):
                if (token := inner.get(word[at:stop])) is not None:
                    out.append(token)
                    at = stop
                    break
        return tuple(out)

    def symbols(self, word: str) -> list[int]:
        return [self.base[c] for c in word[:-1]] + [self.base_end[word[-1]]]

    def merge(self, word: str) -> tuple[int, ...]:
        """Exact merging by rank, then place, over ``word`` in the byte alphabet."""
        return self._merge_long(self.symbols(word))

    def merge_many(self, words: list[str]) -> list[tuple[int, ...]]:
        """The same for many words: short ones of similar length side by side, one merge of each at a time."""
        out: list[tuple[int, ...]] = [()] * len(words)
        by_width: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            width = next((w for w in SIDE_BY_SIDE if len(word) <= w), 0)
            if width:
                by_width.setdefault(width, []).append(i)
            else:
                out[i] = self.merge(word)
        for width, places in by_width.items():
            rows = np.array(places)
            grid = np.full((len(rows), width + 1), -1, dtype=np.int64)
            for row, i in enumerate(places):
                grid[row, : len(words[i])] = self.symbols(words[i])
            steps = np.arange(width)
            while rows.size:
                a, b = grid[:, :-1], grid[:, 1:]
                ranks = np.where(b >= 0, self._rank_of(a, b), _NEVER)
                best = ranks.argmin(axis=1)
                rank = ranks[np.arange(len(rows)), best]
                done = rank == _NEVER
                for i, row in zip(rows[done].tolist(), grid[done].tolist()):
                    out[i] = tuple(row[: row.index(-1)])
                rows, grid, best, rank = rows[~done], grid[~done], best[~done], rank[~done]
                grid[np.arange(len(rows)), best] = self.made[rank]
                grid[:, :-1] = np.take_along_axis(grid, steps + (steps > best[:, None]), axis=1)
        return out

    def _merge_long(self, symbols: list[int]) -> tuple[int, ...]:
        """Keeps the open merges in a heap."""
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        queue = [(self.merges[p][0], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in self.merges]
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            j = after[i]
            if symbols[i] < 0 or j >= len(symbols) or (found := self.merges.get((symbols[i], symbols[j]))) is None or found[0] != rank:
                continue
            symbols[i], symbols[j], after[i] = found[1], -1, after[j]
            if after[i] < len(symbols):
                before[after[i]] = i
                if p := self.merges.get((symbols[i], symbols[after[i]])):
                    heapq.heappush(queue, (p[0], i))
            if before[i] >= 0 and (p := self.merges.get((symbols[before[i]], symbols[i]))):
                heapq.heappush(queue, (p[0], before[i]))
        return tuple(s for s in symbols if s >= 0)

    def learn(self, words: set[str]) -> None:
        """Remember the tokens of words not seen before."""
        fresh = [w for w in words if w not in self.known]
        if not fresh:
            return
        shown = [w if w.isascii() and w.isprintable() and " " not in w else "".join(map(self.bytes_as.__getitem__, w.encode())) for w in fresh]
        proposed = [self.propose(w) for w in shown]
        lengths = np.fromiter(map(len, proposed), dtype=np.int64, count=len(proposed))
        flat = np.fromiter(chain.from_iterable(proposed), dtype=np.int64, count=int(lengths.sum()))
        owner = np.repeat(np.arange(len(proposed)), lengths)
        edge = owner[1:] == owner[:-1]
        keys, back = np.unique((flat[:-1] * self.size + flat[1:])[edge], return_inverse=True)
        fine = self.compatible(keys // self.size, keys % self.size)[back]
        failing = set(owner[:-1][edge][~fine].tolist())
        self.known.update(zip(fresh, proposed))
        again = sorted(failing)
        self.known.update(zip((fresh[i] for i in again), self.merge_many([shown[i] for i in again])))

    def split(self, text: str) -> list[str]:
        """Normalise as the vocabulary asks (NFC, lower case letter by letter) and cut into words."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return _wide_words().findall(text.translate(LATER_LOWER))
        return _NARROW_WORDS.findall(text)

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, list[int]]:
        """All ids in one array, and how many of them each text has."""
        rows: list[list[list[str] | int]] = []
        for text in texts:
            if not any(head in text for head in self.special_heads):
                rows.append([self.split(text)])
            else:
                rows.append([self.specials[p] if p in self.specials else self.split(p) for p in self.special_at.split(text)])
        words = set().union(*(part for row in rows for part in row if isinstance(part, list)))
        if len(self.known) + len(words) > REMEMBERED_WORDS:
            self.known.clear()
        self.learn(words)
        flat: list[int] = []
        counts = []
        for row in rows:
            start = len(flat)
            for part in row:
                if isinstance(part, int):
                    flat.append(part)
                else:
                    flat.extend(chain.from_iterable(map(self.known.__getitem__, part)))
            counts.append(len(flat) - start)
        return np.array(flat, dtype=np.int32), counts

    def decode(self, ids: list[int]) -> str:
        """The token strings, joined by a space: this vocabulary names no decoder of its own."""
        return " ".join(map(self.tokens.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def load(description: str) -> WordBpe:
    """One model for each worker process and vocabulary."""
    return WordBpe(description)


def read_description(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def token_strings(description: str) -> list[str]:
    """The string of each id; an id without a token has an empty one."""
    spec = json.loads(description)
    named = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return [named.get(i, "") for i in range(max(named) + 1)]


def encode(df: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """Add the token ids of every whole text (null: none) as an ``array<int>`` column.

    With ``decoded_col`` the same pass decodes the ids again, as ``decode`` does, and
    adds the result.  ``drop`` names input columns that are not wanted further.  The
    vocabulary is read on the driver and sent to the executors as one broadcast, so
    they need no such file; its size (a few MB) does not depend on the data.
    """
    sent = df.sparkSession.sparkContext.broadcast(read_description(tokenizer_path))
    fields = [T.StructField(ids_col, T.ArrayType(T.IntegerType()))]
    fields += [T.StructField(decoded_col, T.StringType())] if decoded_col else []

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        model = load(sent.value)
        strings = pa.array(model.tokens, pa.large_string())

        def work(texts: pa.Array) -> list[pa.Array]:
            ids = int_lists(*model.encode_batch([t or "" for t in texts.to_pylist()]), pa.int32())
            return [ids, joined(ids, strings)] if decoded_col else [ids]

        return work

    return map_slices(df, text_col, T.StructType(fields), make, drop)


def decode(df: DataFrame, tokenizer_path: str, ids_col: str = "ids", decoded_col: str = "decoded", drop: tuple[str, ...] = ()) -> DataFrame:
    """Add the decoded text of an id column, special tokens included (null: empty)."""
    sent = df.sparkSession.sparkContext.broadcast(token_strings(read_description(tokenizer_path)))

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        strings = pa.array(sent.value, pa.large_string())
        return lambda ids: [joined(ids, strings)]

    return map_slices(df, ids_col, T.StructType([T.StructField(decoded_col, T.StringType())]), make, drop)


def joined(rows: pa.Array, strings: pa.Array) -> pa.Array:
    """Look up the string of each id and join each row's by a space (null: empty)."""
    ids = rows.flatten()
    lengths = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, strings.take(ids)), pa.scalar(" ", strings.type)).cast(pa.string())
