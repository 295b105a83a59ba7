"""Substring dedup by recompression: equal passages get equal symbols inside, whatever surrounds them.

A text's words are named by hashes of their bytes, eight bytes at a time.  A round of
recompression first replaces runs of one symbol by one symbol; each later round calls
every symbol left or right, by its name alone, and replaces each left symbol with a
right one after it by the name of the pair.  Names are hashes of what they stand for,
so that all tasks agree on them without exchanging a dictionary.  Inside a passage the
rounds go the same way wherever it stands; only symbols at its edges may differ.

For each window of ``window`` words the symbols are known that depend on the window
alone.  Of these the least group of ``GROUP`` neighbours is the window's anchor, so
equal windows have equal anchors, and neighbouring windows mostly share one.

Two exchanges settle what repeats.  In the first, anchors that occur in one document
only are sent back to it; windows under them occur nowhere else.  The first of equal
texts is told so, and its copies know themselves by hearing nothing.  In the second,
the remaining windows are settled: each goes back to the first document that has it.
What neither holds back, and what a document repeats itself, is removed.  Both are
map-side combined aggregations, so a passage in a third of all documents costs each
task one row; neither a group nor its pairs are ever gathered.

Anchors only reveal: two that are equal by chance cost work, never a word.  What is
removed is verified by a digest of 128 bits: windows, and texts as wholes, are named
pair by pair from words once more, from other names of the words (``proof``), and only
what agrees in both counts as equal.  For 2**44 words (about 100 TB) a wrong removal
anywhere has a chance of about 2**-40.  Repeats inside a document are compared word by word.

Edge cases: null and empty texts, and texts shorter than a window, lose nothing; a
document longer than a batch stays whole; documents are ordered by id, those without
an id come last; among rows of the same id, and among rows without one, only what a
row repeats itself is removed, so that repeated rows come out alike.  Rows that share
an id, and rows without one, are told what others have before them, in groups of about
``CROWD`` rows of one id: the work grows with their number, not with its square.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .arrow import map_slices

WINDOW = 20
#: Pair rounds, and neighbouring symbols that make an anchor.
ROUNDS, GROUP = 3, 2
#: Bytes of text that are parsed together.
SLICE_BYTES = 1_500_000
#: Bytes up to which words are hashed side by side; longer ones are hashed one by one.
LONG_WORD = 128
#: Rows of one id, or without an id, that share a list of what others have.
CROWD = 64
_LAST = 2**63 - 1
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Seeds of the words' names and of those that verify.
_NAMES, _PROOFS = 0x5851F42D4C957F2D, 0x2545F4914F6CDD1D
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: The first 0 to 8 bytes of a little-endian number.
_HEADS = np.array([2 ** (8 * n) - 1 for n in range(9)], dtype=np.uint64)


def mixed(z: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the argument changes half of the result's."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of two symbols side by side, or of a run and its length."""
    return mixed(a * _GOLDEN + mixed(b + np.uint64(0x632BE59BD9B4E019)))


def word_names(data: np.ndarray, first: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each word ``data[first:end]``: eight bytes at a time, mixed with what came before."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eights = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))  # the eight bytes from each place on
    size = end - first
    names = mixed(size.astype(np.uint64) * _GOLDEN + np.uint64(seed))
    todo, at = np.arange(len(first)), first
    long = size > LONG_WORD
    if long.any():
        for i in np.flatnonzero(long).tolist():
            names[i] = xxhash.xxh3_64_intdigest(data[first[i] : end[i]].tobytes(), seed=seed)
        todo = np.flatnonzero(~long)
        at = first[todo]
    left = size[todo]
    while len(todo):
        names[todo] = mixed((names[todo] ^ (eights[at] & _HEADS[np.minimum(left, 8)])) * _GOLDEN)
        more = np.flatnonzero(left > 8)
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    return names


def gram_names(names: np.ndarray, n: int) -> np.ndarray:
    """A name for each ``n`` neighbours, by their start: pairs, pairs of pairs, and so on."""
    out, done, power, size = None, 0, names, 1
    while True:
        if n & size:
            out = power if out is None else paired(out[: len(power) - done], power[done:]) if len(power) > done else power[:0]
            done += size
        if size * 2 > n:
            return out
        power, size = paired(power[:-size], power[size:]) if len(power) > size else power[:0], size * 2


class Parse:
    """The words of some texts, their windows, and each window's anchor and hash."""

    def __init__(self, texts: pa.Array, window: int = WINDOW) -> None:
        texts = pc.fill_null(texts, "").cast(pa.string())
        ends = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
        ends -= ends[0]
        blank = _BLANK[data]
        before, after = np.ones(len(data), dtype=bool), np.ones(len(data), dtype=bool)
        before[1:], after[:-1] = blank[:-1], blank[1:]
        inner = ends[(ends > 0) & (ends < len(data))]  # no word goes on into the next text
        before[inner], after[inner - 1] = True, True
        first, end = np.flatnonzero(~blank & before), np.flatnonzero(~blank & after) + 1
        self.counts = np.diff(np.searchsorted(first, ends))
        self.bounds = np.concatenate([[0], np.cumsum(self.counts)])
        self.names = word_names(data, first, end, _NAMES)
        self.proof_names = lambda: word_names(data, first, end, _PROOFS)
        self.text_of = np.repeat(np.arange(len(texts)), self.counts)
        self.window = window
        fits = self.text_of[: max(0, len(first) - window + 1)] == self.text_of[window - 1 :]
        self.starts = np.flatnonzero(fits)
        self.owner = self.text_of[self.starts]

    @functools.cached_property
    def grams(self) -> np.ndarray:
        return gram_names(self.names, self.window)

    @functools.cached_property
    def proofs(self) -> np.ndarray:
        """Names of the words that do not depend on ``names``."""
        return self.proof_names()

    def hashes(self, at: np.ndarray) -> np.ndarray:
        """A hash of the whole window for the windows of these places in ``starts``."""
        return self.grams[self.starts[at]]

    def hash_proofs(self, at: np.ndarray) -> np.ndarray:
        """Another hash of the same windows, made from ``proofs``."""
        return gram_names(self.proofs, self.window)[self.starts[at]]

    def whole(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts that have a window, and a hash of the names of all their words."""
        texts = np.flatnonzero(self.counts >= self.window)
        spans = zip(self.bounds[texts].tolist(), self.bounds[texts + 1].tolist())
        return texts, np.fromiter((xxhash.xxh3_64_intdigest(names[a:b].tobytes()) for a, b in spans), dtype=np.uint64, count=len(texts))

    def anchors(self) -> np.ndarray:
        """The anchor's name for every window; windows without any inner symbol are named by their own hash."""
        names, text_of, n = self.names, self.text_of, len(self.names)
        out = np.zeros(len(self.starts), dtype=np.uint64)
        if not len(out):
            return out
        fresh = np.ones(n, dtype=bool)
        fresh[1:] = (text_of[1:] != text_of[:-1]) | (names[1:] != names[:-1])
        at = np.flatnonzero(fresh)
        run_of = np.cumsum(fresh) - 1
        runs = np.diff(np.append(at, n))
        symbols, own = np.where(runs > 1, paired(names[at], runs.astype(np.uint64)), names[at]), text_of[at]
        # For a window whose first and last words are in runs a and b, the symbols low[a] .. high[b] - 1
        # depend on the window alone: the runs at its edges may go on outside.
        low, high = np.arange(1, len(at) + 1), np.arange(len(at))
        for k in range(1, ROUNDS + 1):
            right = mixed(symbols + np.uint64(k)) & np.uint64(1) == 1
            joins = np.zeros(len(symbols), dtype=bool)  # with the symbol before
            joins[1:] = right[1:] & ~right[:-1] & (own[1:] == own[:-1])
            # a right symbol in front may join one outside, and so may a left one at the end
            moved = np.append(np.cumsum(~joins) - 1 + right, len(symbols))
            low, high = moved[np.minimum(low, len(symbols))], np.where(high > 0, moved[high - 1], 0)
            keep = np.flatnonzero(~joins)
            after = np.append(joins[1:], False)[keep]
            symbols = np.where(after, paired(symbols[keep], symbols[np.minimum(keep + 1, len(symbols) - 1)]), symbols[keep])
            own = own[keep]
        low, high = low[run_of[self.starts]], high[run_of[self.starts + self.window - 1]]
        size = np.maximum(high - low, 0)
        grouped = [symbols]
        for g in range(1, GROUP):
            grouped.append(paired(grouped[-1][: len(symbols) - g], symbols[g:]))
        for g in range(1, GROUP):
            few = np.flatnonzero(size == g)
            out[few] = grouped[g - 1][low[few]]
        many = np.flatnonzero(size >= GROUP)
        least, width = grouped[-1], 1
        head, places = low[many], size[many] - GROUP + 1
        while len(many):  # minima over spans of doubling width; two of them cover a window's range
            done = places < 2 * width
            a = head[done]
            out[many[done]] = np.minimum(least[a], least[a + places[done] - width])
            many, head, places = many[~done], head[~done], places[~done]
            if len(many):
                least = np.minimum(least[:-width], least[width:])
                width *= 2
        none = np.flatnonzero(size == 0)
        out[none] = self.hashes(none)
        return out


def of_text(names: np.ndarray, text: np.ndarray) -> np.ndarray:
    """One number for a name in a text, so that sets of both can be compared at once."""
    return mixed(names + mixed(text.astype(np.uint64) + np.uint64(1)))


def known(names: np.ndarray, text: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Whether each name is in its own text's list (null: empty)."""
    lengths = [len(row) if row.is_valid else 0 for row in lists]
    listed = of_text(lists.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(len(lists)), lengths))
    return np.isin(of_text(names, text), listed)


def records(parse: Parse) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of windows with one anchor: its name (an even number), the first window, and the stretch of each window."""
    names = parse.anchors() & ~np.uint64(1)
    fresh = np.ones(len(names), dtype=bool)
    fresh[1:] = (names[1:] != names[:-1]) | (parse.owner[1:] != parse.owner[:-1])
    first = np.flatnonzero(fresh)
    return names[first], first, np.cumsum(fresh) - 1


def later_copies(parse: Parse, held: pa.Array) -> np.ndarray:
    """By text: whether all its words stand in an earlier document."""
    texts, hashes = parse.whole(parse.names)
    out = np.zeros(len(parse.counts), dtype=bool)
    out[texts] = ~known(hashes | np.uint64(1), texts, held)
    return out


def open_windows(parse: Parse, stretches: tuple[np.ndarray, np.ndarray, np.ndarray], held: pa.Array, settled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of texts not ``settled`` whose anchor other documents have too, as places in ``starts``, and those anchors."""
    names, first, of = stretches
    owner = parse.owner[first]
    still = ~settled[owner]
    still[still] = ~known(names[still], owner[still], held)
    at = np.flatnonzero(still[of])
    return at, names[of[at]]


def repeated(parse: Parse) -> np.ndarray:
    """Which windows stand in the same text before, word by word."""
    marks = of_text(parse.grams[parse.starts], parse.owner)
    once, of = np.unique(marks, return_index=True, return_inverse=True)[1:]
    first = once[of]
    out = first != np.arange(len(marks))
    at = np.flatnonzero(out)
    for k in range(parse.window):
        out[at] &= parse.names[parse.starts[at] + k] == parse.names[parse.starts[first[at]] + k]
    return out


def covered(parse: Parse, gone: np.ndarray) -> np.ndarray:
    """Which words are in a window that is ``gone``."""
    starts = parse.starts[gone]
    cover = np.zeros(len(parse.names) + 1, dtype=np.int32)
    cover[starts] += 1
    cover[starts + parse.window] -= 1
    return np.cumsum(cover[:-1]) > 0


def removed(parse: Parse, held: pa.Array, firsts: pa.Array) -> np.ndarray:
    """Which words are in a window that starts earlier too."""
    copies = later_copies(parse, held)
    gone = copies[parse.owner]
    at, _ = open_windows(parse, records(parse), held, copies)
    gone[at] = ~known(parse.hashes(at), parse.owner[at], firsts)
    return covered(parse, gone | repeated(parse))


def removed_crowded(parse: Parse, taken: pa.Array) -> np.ndarray:
    """The same for texts that are told which of their windows an earlier document has."""
    every = np.arange(len(parse.starts))
    return covered(parse, known(parse.hashes(every), parse.owner, taken) | repeated(parse))


def _votes(keyed: DataFrame, cols: tuple[str, ...], fields: T.StructType, emit: Callable[..., list[pa.Array]]) -> DataFrame:
    """The rows of equally long lists that ``emit`` makes for each document, one row for each item, with the document's ``__key``."""
    lists = map_slices(keyed, cols, T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in fields]), lambda: emit, tuple(c for c in keyed.columns if c != "__key"), SLICE_BYTES)
    return lists.select("__key", F.explode(F.arrays_zip(*fields.names)).alias("v")).select("__key", "v.*") if len(fields) > 1 else lists.select("__key", F.explode(fields.names[0]).alias(fields.names[0]))


def _lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    """A list array with the values of each of ``n`` texts; ``owner`` ascends."""
    offsets = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _kept(texts: pa.Array, parse: Parse, gone: np.ndarray) -> list[pa.Array]:
    """Number of words, of those removed, and the rest."""
    out, lost = [], []
    for text, a, b in zip(texts.to_pylist(), parse.bounds[:-1].tolist(), parse.bounds[1:].tolist()):
        own, stay = (text or "").encode().split(), ~gone[a:b]
        lost.append(b - a - int(stay.sum()))
        out.append(b" ".join(compress(own, stay.tolist()) if lost[-1] else own).decode())
    return [pa.array(parse.counts), pa.array(lost, pa.int64()), pa.array(out, pa.string())]


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "kept_text", window: int = WINDOW, drop: tuple[str, ...] = ()) -> DataFrame:
    """Add ``n_words``, ``n_removed`` and the kept words, joined by a space, to every document.

    ``drop`` names input columns that are not wanted further.
    """

    def name_votes(texts: pa.Array) -> list[pa.Array]:
        parse = Parse(texts, window)
        names, first, _ = records(parse)
        owner = parse.owner[first]
        place = np.unique(of_text(names, owner), return_index=True)[1]
        whole, hashes = parse.whole(parse.names)
        proofs = np.concatenate([np.zeros(len(place), dtype=np.uint64), parse.whole(parse.proofs)[1]])
        names, owner = np.concatenate([names[place], hashes | np.uint64(1)]), np.concatenate([owner[place], whole])
        order = np.argsort(owner, kind="stable")
        return [_lists(names[order], owner[order], len(texts)), _lists(proofs[order], owner[order], len(texts))]

    def listed(parse: Parse, at: np.ndarray, n: int) -> list[pa.Array]:
        """Hash and proof of these windows, once for each text."""
        hashes = parse.hashes(at)
        place = np.sort(np.unique(of_text(hashes, parse.owner[at]), return_index=True)[1])
        owner = parse.owner[at][place]
        return [_lists(hashes[place], owner, n), _lists(parse.hash_proofs(at[place]), owner, n)]

    def window_votes(texts: pa.Array, held: pa.Array, *_: pa.Array) -> list[pa.Array]:
        parse = Parse(texts, window)
        return listed(parse, open_windows(parse, records(parse), held, later_copies(parse, held))[0], len(texts))

    def all_windows(texts: pa.Array) -> list[pa.Array]:
        parse = Parse(texts, window)
        return listed(parse, np.arange(len(parse.starts)), len(texts))

    def kept(texts: pa.Array, held: pa.Array, firsts: pa.Array) -> list[pa.Array]:
        parse = Parse(texts, window)
        return _kept(texts, parse, removed(parse, held, firsts))

    def kept_crowded(texts: pa.Array, taken: pa.Array) -> list[pa.Array]:
        parse = Parse(texts, window)
        return _kept(texts, parse, removed_crowded(parse, taken))

    long = lambda name: T.StructField(name, T.LongType())
    hashed, fields = T.StructType([long("hash"), long("proof")]), T.StructType([long("n_words"), long("n_removed"), T.StructField(out_col, T.StringType())])
    keyed = docs.withColumn("__key", F.coalesce(id_col, F.lit(_LAST)))
    # ids of more than one row, and the rows without an id as one of them
    shared = keyed.groupBy("__key").agg(F.count("*").alias("__rows")).where(F.expr(f"__rows > 1 OR __key = {_LAST}"))
    crowds = not shared.isEmpty()
    single = keyed.join(shared, "__key", "left_anti") if crowds else keyed
    crowded = keyed.join(shared, "__key").drop("__rows") if crowds else None
    # with all columns, so that the exchange of the documents below is the one that the result needs, too
    others = tuple(c for c in docs.columns if c != text_col)

    votes = _votes(keyed, (text_col,), T.StructType([long("name"), long("proof")]), name_votes)
    voted = votes.groupBy("name", "proof").agg(F.min("__key").alias("__key"), F.max("__key").alias("last"))
    told = voted.where((F.col("__key") == F.col("last")) | (F.col("name").bitwiseAND(1) == 1)).where(F.col("__key") < _LAST)  # anchors that are alone, and every text's first copy
    held = told.groupBy("__key").agg(F.collect_list("name").alias("__held"))
    known_docs = single.join(held, "__key", "left")
    votes = _votes(known_docs, (text_col, "__held", *others), hashed, window_votes)
    if crowds:
        votes = votes.unionByName(_votes(crowded.where(F.col("__key") < _LAST), (text_col,), hashed, all_windows))
    first = votes.groupBy("hash", "proof").agg(F.min("__key").alias("__key"))
    firsts = first.groupBy("__key").agg(F.collect_list("hash").alias("__firsts"))
    out = map_slices(known_docs.join(firsts, "__key", "left"), (text_col, "__held", "__firsts"), fields, lambda: kept, ("__key", "__held", "__firsts", *drop), SLICE_BYTES)
    if not crowds:
        return out
    parts = F.ceil(F.col("__rows") / CROWD)
    grouped = keyed.join(shared, "__key").withColumn("__key", F.struct(F.col("__key").alias("id"), F.pmod(F.xxhash64(text_col), parts).alias("part"))).drop("__rows")
    earlier = _votes(grouped, (text_col,), hashed, all_windows).distinct().join(first.withColumnRenamed("__key", "first"), ["hash", "proof"]).where("first < __key.id")
    taken = earlier.groupBy("__key").agg(F.collect_list("hash").alias("__taken"))
    rest = map_slices(grouped.join(taken, "__key", "left"), (text_col, "__taken"), fields, lambda: kept_crowded, ("__key", "__taken", *drop), SLICE_BYTES)
    return out.unionByName(rest)
