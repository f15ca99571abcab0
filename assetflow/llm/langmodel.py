"""Hierarchical Pitman-Yor language model, sampled by Gibbs and averaged.

Restaurants: one for each word before. Those of the words of one ending (last two bytes) share a
parent, these share the restaurant of the last byte, all of which share one for words without
context; below it every word and "any other word" are equally likely. A customer is an occurrence
of a word; a table of a restaurant is a customer of its parent.

The words are dealt into parts by hash, and all customers of a word, in all restaurants, are in one
part. Parts share nothing but the numbers of tables and customers of each restaurant, which are
brought up to date after each round: at most 65,536 + 256 + 1 above the words before, whatever the
corpus, so that every part gets them all; a part gets those of the words before that it has from
their owners, each of which adds up a range of hashes. Texts stay in pieces of some megabytes: a
piece sends each part the distinct (word before, word) pairs it holds with their counts in training,
and gets back a probability for each. So what is shuffled are distinct pairs per piece, and a
frequent word is one small row from each piece.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetflow.llm.batches import pieces, utf8
from assetflow.llm.wordhash import Hasher
from assetflow.shared import new_path, remove_path

PIECE_BYTES = 4 << 20
PART_BYTES = 12 << 20  # text per part of the vocabulary
OWNED_PARTS = 8  # parts per owner of words before
STRENGTH = 1.0  # theta of every restaurant
# Rounds between which parts exchange totals, sweeps in each, and samples taken after the last ones.
ROUNDS, SWEEPS, SAMPLES = 4, 2, 2
HELD_OUT_OF, HELD_OUT = 7, 2

_START = np.uint64(0)  # the word before the first one
_ENDINGS, _LAST = 1 << 16, 1 << 8
_END_TOKEN = np.uint64(1)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays byte plane by byte plane, of whole numbers (from 0 on) those that are not all zeros."""
    import zstandard

    head, planes = [], []
    for a in arrays:
        used = a.itemsize if a.dtype.kind == "f" else (int(a.max(initial=0)).bit_length() + 7) // 8
        head += [len(a), used]
        as_bytes = np.ascontiguousarray(a).view(np.uint8)
        planes += [as_bytes[k :: a.itemsize].tobytes() for k in range(used)]
    return zstandard.ZstdCompressor(level=1).compress(np.array(head, np.int64).tobytes() + b"".join(planes))


def _unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    head = np.frombuffer(raw, np.int64, 2 * len(kinds)).tolist()
    at, out = 8 * len(head), []
    for kind, size, used in zip(kinds, head[::2], head[1::2], strict=True):
        made = np.zeros(size, kind)
        as_bytes, width = made.view(np.uint8), made.itemsize
        for k in range(used):
            as_bytes[k::width] = np.frombuffer(raw, np.uint8, size, at)
            at += size
        out.append(made)
    return out


def _ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and the place of each value among them."""
    codes, found = pd.factorize(values)
    order = np.argsort(found)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return found[order], rank[codes]


def _ranges(hashes: np.ndarray, n: int):
    """(number, slice) of those of n equal ranges of hashes that sorted hashes fall into."""
    number = ((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
    first = 0
    for end in np.flatnonzero(np.diff(number, append=np.uint64(n) + np.uint64(1))) + 1:
        yield int(number[first]), slice(first, int(end))
        first = int(end)


class _Piece:
    """Tokens of some texts, their distinct words in order of hash, and distinct pairs in order.

    Token i is pair ``pair[i]``; pair j is the word ``word_of[j]`` after the word ``context[j]``,
    given by 48 bits of its hash and then its ending, ``ending[j]``. Every text ends with one end
    token.
    """

    def __init__(self, hasher: Hasher, texts: list[bytes | None]):
        words = hasher.words([t.lower() if t else t for t in texts])
        numbers = np.arange(len(texts))
        self.sizes = np.diff(words.first) + 1
        total = int(self.sizes.sum())
        self.doc = np.repeat(numbers, self.sizes)
        place = np.arange(len(words.hash)) + words.doc
        token = np.full(total, _END_TOKEN, np.uint64)
        token[place] = words.hash
        last = words.data[words.end - 1].astype(np.int64) if len(place) else np.zeros(0, np.int64)
        longer = words.end - words.start > 1
        second = np.where(longer, words.data[np.maximum(words.end - 2, 0)], 0).astype(np.int64)
        self.words, rank = _ranked(token)
        ending = np.zeros(len(self.words), np.uint64)
        ending[rank[place]] = second * _LAST + last
        ending_bits = np.uint64(_ENDINGS - 1)
        contexts = np.append(_START, (self.words & ~ending_bits) | ending)
        before = np.zeros(total, np.int64)
        before[place + 1] = rank[place] + 1
        pairs, self.pair = _ranked(rank * len(contexts) + before)
        self.word_of, self.context = pairs // len(contexts), contexts[pairs % len(contexts)]
        self.ending = (self.context & ending_bits).astype(np.int64)
        self.name = hashlib.blake2b(
            words.data.tobytes() + words.text_start.tobytes(), digest_size=8
        ).digest()

    def count(self, used: np.ndarray) -> np.ndarray:
        """Tokens of each pair in the used texts."""
        return np.bincount(self.pair[used[self.doc]], minlength=len(self.ending))

    def cut(self, n_parts: int):
        """(part, words, pairs) as slices; a part is a range of hashes."""
        for part, words in _ranges(self.words, n_parts):
            lo, hi = np.searchsorted(self.word_of, [words.start, words.stop])
            yield part, words, slice(int(lo), int(hi))


def _each_piece(stream):
    """(piece, ids, held out) of each piece of text of an Arrow stream of id, held_out, text."""
    hasher = Hasher()
    for batch in stream:
        for lo, hi in pieces(batch.column(2), PIECE_BYTES):
            rows = batch.slice(lo, hi - lo)
            yield _Piece(hasher, utf8(rows.column(2))), rows.column(0), rows.column(1)


def _sent(docs: DataFrame, n_parts: int) -> DataFrame:
    """For each piece and part the piece's words and pairs, with their counts in training."""

    def run(stream):
        for piece, _, held in _each_piece(stream):
            counts = piece.count(~held.to_numpy(zero_copy_only=False))
            parts, blobs = [], []
            for part, w, p in piece.cut(n_parts):
                per_word = np.bincount(piece.word_of[p] - w.start, minlength=w.stop - w.start)
                blobs.append(
                    _pack(
                        piece.words[w],
                        per_word.astype(np.int32),
                        piece.context[p],
                        counts[p].astype(np.int32),
                    )
                )
                parts.append(part)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(parts, pa.int32()),
                    pa.array([piece.name] * len(parts), pa.binary()),
                    pa.array(blobs, pa.binary()),
                ],
                names=["part", "piece", "blob"],
            )

    return docs.mapInArrow(run, "part int, piece binary, blob binary")


_MESSAGE = (np.uint64, np.int32, np.uint64, np.int32)


def _split(count: np.ndarray, lo: np.ndarray, hi: np.ndarray, draw) -> tuple[np.ndarray, np.ndarray]:
    """(places, what each gets) of counts to be spread over ranges of places, by halving the ranges;
    ``draw(count, lo, mid, hi)`` is what the left half gets."""
    places, shares = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(count):
        single = hi - lo == 1
        places.append(lo[single])
        shares.append(count[single])
        count, lo, hi = count[~single], lo[~single], hi[~single]
        mid = (lo + hi) // 2
        left = draw(count, lo, mid, hi)
        count = np.concatenate([left, count - left])
        lo, hi = np.concatenate([lo, mid]), np.concatenate([mid, hi])
        some = count > 0
        count, lo, hi = count[some], lo[some], hi[some]
    return np.concatenate(places), np.concatenate(shares)


_TRIES, _TRIED = 15, 2048  # further draws of a dish at once, and customers in them


def _open(many: np.ndarray, weight: np.ndarray, rise: np.ndarray, discount: float, rng):
    """(accepted, sizes of new tables, place of the dish of each) when of some dishes ``many``
    customers sit at new tables only; what is accepted has the probability of the process.

    A customer opens a table by ``weight`` or follows an earlier one by 1. Who follows the first of
    a table stays there by 1 - discount, opens one by ``rise``, and else the dish is drawn anew.
    """
    total = int(many.sum())
    dish = np.repeat(np.arange(len(many)), many)
    begin = np.repeat(np.cumsum(many) - many, many)
    place = np.arange(total) - begin
    u = rng.random(total) * (weight[dish] + place) - weight[dish]
    first = (u < 0) | (place == 0)
    table = np.arange(total)
    left = np.flatnonzero(~first)
    after = begin[left] + np.minimum(u[left].astype(np.int64), place[left] - 1)
    coin = rng.random(len(left)) - (1 - discount)
    bad, known = np.zeros(len(many), bool), first.copy()
    while len(left):
        ready = known[after]
        i, j, c = left[ready], after[ready], coin[ready]
        of_first = first[j] & (c >= 0)
        opens = of_first & (c < rise[dish[i]])
        bad[dish[i[of_first & ~opens]]] = True
        first[i], known[i] = opens, True
        table[i] = np.where(opens, i, table[j])
        left, after, coin = left[~ready], after[~ready], coin[~ready]
    sizes = np.bincount(table, minlength=total)
    used = first & ~bad[dish]
    return ~bad, sizes[used], dish[used]


_FEW = 8  # customers of a dish whose seatings are listed


def _seatings(n: int, most: int | None = None) -> list[tuple[int, ...]]:
    """Sizes of the tables of n customers, in all ways that differ in sizes."""
    if n == 0:
        return [()]
    return [(k, *rest) for k in range(min(n, most or n), 0, -1) for rest in _seatings(n - k, k)]


def _seat_few(n: int, opening: np.ndarray, rise: np.ndarray, discount: float, rng) -> _Tables:
    """Dishes of n customers each, drawn from all their seatings by what the process gives each."""
    seatings = _seatings(n)
    opened = np.cumprod([np.ones(len(opening)), *[opening + rise * t for t in range(1, n)]], axis=0)
    weights = np.empty((len(seatings), len(opening)))
    for weight, sizes in zip(weights, seatings, strict=True):
        ways = math.factorial(n)
        for size in sizes:
            ways *= math.prod(m - discount for m in range(1, size)) / math.factorial(size)
        for equal in Counter(sizes).values():
            ways /= math.factorial(equal)
        np.multiply(opened[len(sizes) - 1], ways, out=weight)
    np.cumsum(weights, axis=0, out=weights)
    drawn = (weights[:-1] <= rng.random(len(opening)) * weights[-1]).sum(axis=0)
    size = np.array([[*sizes, *[0] * (n - len(sizes))] for sizes in seatings])[drawn]
    return _Tables((size > 0).sum(axis=1), size[size > 0])


class _Tables:
    """The tables of many dishes, each in one restaurant, and customers moved for many at once.

    ``size`` holds the customers of each table, dish by dish; ``tables`` and ``customers`` count
    them for each dish. ``opening`` is the weight of the first table of a dish and ``rise`` what
    each table of it adds to that of the next.
    """

    def __init__(self, tables: np.ndarray, size: np.ndarray):
        self.tables, self.size = tables.astype(np.int64), size.astype(np.int64)
        self.customers = self._by_dish(self.size)

    def _by_dish(self, per_table: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(per_table)])
        ends = np.cumsum(self.tables)
        return sums[ends] - sums[ends - self.tables]

    def _places(self, own: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Places in ``size`` of the tables of some dishes; ``ends``: of those of all."""
        tables = self.tables[own]
        own_ends = np.cumsum(tables)
        return np.repeat(ends[own] - own_ends, tables) + np.arange(int(tables.sum()))

    def _apart(self, own: np.ndarray) -> _Tables:
        return _Tables(self.tables[own], self.size[self._places(own, np.cumsum(self.tables))])

    def _put_back(self, own: np.ndarray, part: _Tables) -> None:
        others = self.size[np.repeat(~own, self.tables)]
        self.tables[own], self.customers[own] = part.tables, part.customers
        places = np.repeat(own, self.tables)
        self.size = np.empty(len(places), np.int64)
        self.size[places], self.size[~places] = part.size, others

    def _drop_empty(self) -> np.ndarray:
        """Where tables stay."""
        stay = self.size > 0
        if not stay.all():
            self.tables = self._by_dish(stay.astype(np.int64))
            self.size = self.size[stay]
        return stay

    def seat(self, many: np.ndarray, opening, rise, discount: float, rng) -> np.ndarray:
        """Seat so many further customers of each dish; places in ``size`` before which there are
        new tables. Exact given who sits, however many come."""
        ends = np.cumsum(self.tables)
        starts = ends - self.tables
        sums = np.concatenate([[0.0], np.cumsum(self.size - discount)])
        sitting = sums[ends] - sums[starts]
        weight = opening + rise * self.tables
        rest = many.copy()
        owners, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        left = np.flatnonzero(many > 0)
        while len(left):
            # Several draws at once where few customers are left; the first accepted one counts.
            tries = 1 + min(_TRIES, _TRIED // int(many[left].sum()))
            at = np.repeat(left, tries)
            share = np.ones(len(at))
            old = self.tables[at] > 0
            share[old] = rng.beta(weight[at[old]], sitting[at[old]])
            drawn = rng.binomial(many[at], share)
            taken, new, owner = _open(drawn, weight[at], rise[at], discount, rng)
            taken = taken.reshape(-1, tries)
            done = taken.any(axis=1)
            counts = np.zeros(len(at), bool)
            counts[(np.arange(len(left)) * tries + taken.argmax(axis=1))[done]] = True
            rest[at[counts]] -= drawn[counts]
            owners.append(at[owner[counts[owner]]])
            sizes.append(new[counts[owner]])
            left = left[~done]

        def urn(count, lo, mid, hi):
            return rng.binomial(count, rng.beta(sums[mid] - sums[lo], sums[hi] - sums[mid]))

        old = np.flatnonzero(rest > 0)
        at, more = _split(rest[old], starts[old], ends[old], urn)
        self.size[at] += more
        owner, new = np.concatenate(owners), np.concatenate(sizes)
        order = np.argsort(owner, kind="stable")  # dishes left without tables end at the same place
        owner, new = owner[order], new[order]
        self.size = np.insert(self.size, ends[owner], new)
        self.tables = self.tables + np.bincount(owner, minlength=len(self.tables))
        self.customers = self.customers + many
        return ends[owner]

    def grow(self, many: np.ndarray, opening, rise, discount: float, rng) -> None:
        """Seat customers as they come, in steps of which few have to be drawn again."""
        some = many > 0
        if not some.all():
            if some.any():
                part = self._apart(np.flatnonzero(some))
                part.grow(many[some], opening[some], rise[some], discount, rng)
                self._put_back(some, part)
            return
        left = many
        while left.any():
            weight = opening + rise * self.tables
            step = (self.customers + weight) / np.maximum(1, np.sqrt(discount * weight / 2))
            now = np.minimum(left, np.maximum(1, step.astype(np.int64)))
            self.seat(now, opening, rise, discount, rng)
            left = left - now

    def take(self, many: np.ndarray, rng) -> None:
        """Take so many random customers from each dish."""
        sums = np.concatenate([[0], np.cumsum(self.size)])
        ends = np.cumsum(self.tables)

        def half(count, lo, mid, hi):
            return rng.hypergeometric(sums[mid] - sums[lo], sums[hi] - sums[mid], count)

        some = np.flatnonzero(many > 0)
        at, gone = _split(many[some], (ends - self.tables)[some], ends[some], half)
        self.size[at] -= gone
        self.customers = self.customers - many
        self._drop_empty()

    def _reseat_in(self, batches: int, opening, rise, discount: float, rng) -> None:
        todo = self.size.copy()
        for left in range(batches, 0, -1):
            gone = rng.binomial(todo, 1 / left)
            many = self._by_dish(gone)
            self.size -= gone
            todo = (todo - gone)[self._drop_empty()]
            self.customers = self.customers - many
            todo = np.insert(todo, self.seat(many, opening, rise, discount, rng), 0)

    def reseat(self, opening, rise, discount: float, rng) -> None:
        """Seat every customer anew, once: those of a dish of few by drawing one of its seatings, others
        in random batches. A batch of a dish is so large that few have to be drawn again, so the cost
        grows with tables and not with customers."""
        parts = []
        for n in range(2, _FEW + 1):
            own = np.flatnonzero(self.customers == n)
            parts.append((own, _seat_few(n, opening[own], rise[own], discount, rng)))
        many = np.flatnonzero(self.customers > _FEW)
        weight, customers = opening[many] + rise[many] * self.tables[many], self.customers[many]
        batches = 1 + np.ceil(customers * np.sqrt(discount * weight / 2) / (customers + weight))
        batches = 1 << np.ceil(np.log2(batches)).astype(np.int64)
        for n in np.unique(batches):
            own = many[batches == n]
            part = self._apart(own)
            part._reseat_in(int(n), opening[own], rise[own], discount, rng)
            parts.append((own, part))
        for own, part in parts:
            self.tables[own] = part.tables
        self.size = np.ones(int(self.tables.sum()), np.int64)  # of who is alone, others follow
        ends = np.cumsum(self.tables)
        for own, part in parts:
            self.size[self._places(own, ends)] = part.size

    def remove(self, dishes: np.ndarray, rng) -> np.ndarray:
        """Take a random customer from each of distinct dishes; true where a table became empty."""
        starts = np.cumsum(self.tables) - self.tables
        sums = np.cumsum(self.size)
        first = sums[starts[dishes]] - self.size[starts[dishes]]
        at = np.searchsorted(sums, first + rng.integers(0, self.customers[dishes]), side="right")
        self.size[at] -= 1
        self.customers[dishes] -= 1
        empty = self.size[at] == 0
        if empty.any():
            self.size = np.delete(self.size, at[empty])
            self.tables[dishes[empty]] -= 1
        return empty

    def add(self, dishes: np.ndarray, opening: np.ndarray, discount: float, rng) -> np.ndarray:
        """Seat a customer for each of distinct dishes; ``opening``: weight of a new table. True
        where there is a new one."""
        tables, customers = self.tables[dishes], self.customers[dishes]
        sitting = customers - discount * tables
        new = (customers == 0) | (rng.random(len(dishes)) * (opening + sitting) < opening)
        starts = np.cumsum(self.tables) - self.tables
        old = dishes[~new]
        if len(old):
            sums = np.cumsum(self.size - discount)
            first = sums[starts[old]] - (self.size[starts[old]] - discount)
            at = np.searchsorted(sums, first + rng.random(len(old)) * sitting[~new], side="right")
            at = np.clip(at, starts[old], starts[old] + tables[~new] - 1)
            self.size[at] += 1
        if new.any():
            opened = dishes[new]
            self.size = np.insert(self.size, starts[opened] + self.tables[opened], 1)
            self.tables[opened] += 1
        self.customers[dishes] += 1
        return new


class _Totals:
    """Tables and customers of every restaurant above the words before, and the number of words;
    the same for all parts."""

    def __init__(self, n_words: int, discounts: list[float], c2: np.ndarray, t2, t1, t0: int):
        self.n_words, self.discounts, self.c2, self.t2, self.t1, self.t0 = n_words, discounts, c2, t2, t1, t0
        self.c1 = np.bincount(np.arange(_ENDINGS) % _LAST, t2, _LAST)
        self.c0 = t1.sum()

    def new_table(self, level: int, at=None) -> np.ndarray:
        tables = (self.t0, self.t1, self.t2)[level]
        return STRENGTH + self.discounts[level] * (tables if at is None else tables[at])

    def all(self, level: int, at=None) -> np.ndarray:
        customers = (self.c0, self.c1, self.c2)[level]
        return STRENGTH + (customers if at is None else customers[at])

    def share(self, level: int, customers, tables, parent, at=None) -> np.ndarray:
        """Probability of a dish in its restaurant."""
        own = customers - self.discounts[level] * tables
        return (own + self.new_table(level, at) * parent) / self.all(level, at)


def _alone(customers: np.ndarray) -> _Tables:
    """Everyone of a dish at one table."""
    return _Tables(customers > 0, customers[customers > 0])


class _Part:
    """The restaurants of endings and above, with all customers of the words of one part."""

    def __init__(self, words, per_word, ending, counts):
        self.words, self.per_word, self.ending, self.counts = words, per_word, ending, counts
        self.word_of = np.repeat(np.arange(len(words)), per_word)
        middle = self.word_of * _LAST + ending.astype(np.int64) % _LAST
        self.middle, self.parent = np.unique(middle, return_inverse=True)
        self.last = self.middle % _LAST
        self.middle_word = self.middle // _LAST

    def start(self) -> list[_Tables]:
        """Everyone at one table."""
        bottom = _alone(self.counts)
        middle = _alone(np.bincount(self.parent, bottom.tables, len(self.middle)).astype(np.int64))
        top = np.bincount(self.middle_word, middle.tables, len(self.words)).astype(np.int64)
        return [_alone(top), middle, bottom]

    def shares(self, seats: list[_Tables], totals: _Totals) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of the words without context and after each last byte."""
        top = totals.share(0, seats[0].customers, seats[0].tables, 1 / (totals.n_words + 1))
        middle = totals.share(
            1, seats[1].customers, seats[1].tables, top[self.middle_word], self.last
        )
        return top, middle

    def sweep(self, seats: list[_Tables], totals: _Totals, rng, known: list[np.ndarray] | None = None, change=None) -> None:
        """Seat every customer of every dish anew, from the endings up to the words without context.

        ``known``: tables of each dish, by level, when the totals were taken, if not those of now.
        ``change``: in customers of each dish of an ending, where tables below them changed.
        """
        top, middle = self.shares(seats, totals)
        known = [s.tables.copy() for s in seats] if known is None else known

        def weights(level, tables, parent):
            discount = totals.discounts[level]
            return (STRENGTH + discount * (tables - known[level])) * parent, discount * parent, discount, rng

        def move(level, change, ways):
            """Apply the change in customers, then seat all; the change in tables of each dish."""
            before = seats[level].tables.copy()
            if change is not None:
                seats[level].take(np.maximum(-change, 0), rng)
                seats[level].grow(np.maximum(change, 0), *ways)
            seats[level].reseat(*ways)
            return seats[level].tables - before

        change = move(2, change, weights(2, totals.t2[self.ending], middle[self.parent]))
        change = np.rint(np.bincount(self.parent, change, len(self.middle))).astype(np.int64)
        change = move(1, change, weights(1, totals.t1[self.last], top[self.middle_word]))
        change = np.rint(np.bincount(self.middle_word, change, len(self.words))).astype(np.int64)
        move(0, change, weights(0, totals.t0, np.full(len(self.words), 1 / (totals.n_words + 1))))


class _Below:
    """The restaurants of the words before, over those of the endings (``above``).

    Pair i is the word ``word_of[i]`` after the word ``context[i]`` of those that the part has;
    pairs of texts that are not for training have no customers.
    """

    def __init__(self, per_word: np.ndarray, context: np.ndarray, ending: np.ndarray, counts: np.ndarray):
        self.context, self.counts, self.n_contexts = context, counts, len(ending)
        self.word_of = np.repeat(np.arange(len(per_word)), per_word)
        dishes, self.parent = _ranked(self.word_of * _ENDINGS + ending[context].astype(np.int64))
        of_word = np.bincount(dishes // _ENDINGS, minlength=len(per_word))
        customers = np.bincount(self.parent, counts > 0, len(dishes)).astype(np.int64)
        self.above = _Part(np.arange(len(per_word)), of_word, (dishes % _ENDINGS).astype(np.uint16), customers)

    def start(self) -> list[_Tables]:
        return [*self.above.start(), _alone(self.counts)]

    def by_context(self, values: np.ndarray) -> np.ndarray:
        return np.rint(np.bincount(self.context, values, self.n_contexts)).astype(np.int64)

    def sweep(self, seats: list[_Tables], totals: _Totals, opened: np.ndarray, rng, known: list[np.ndarray]) -> None:
        """Seat every customer anew; ``opened``: tables of each context when the totals were taken."""
        bottom, discount = seats[3], totals.discounts[3]
        parent = self.above_shares(seats, totals)[self.parent]
        before = bottom.tables.copy()
        opened = (opened + self.by_context(before - known[3]))[self.context]
        bottom.reseat((STRENGTH + discount * (opened - before)) * parent, discount * parent, discount, rng)
        change = np.bincount(self.parent, bottom.tables - before, len(self.above.ending))
        self.above.sweep(seats[:3], totals, rng, known[:3], np.rint(change).astype(np.int64))

    def above_shares(self, seats: list[_Tables], totals: _Totals) -> np.ndarray:
        """Probabilities of the words after each ending."""
        above = self.above
        middle = above.shares(seats, totals)[1]
        return totals.share(2, seats[2].customers, seats[2].tables, middle[above.parent], above.ending)

    def probabilities(self, seats: list, totals: _Totals, customers: np.ndarray, opened: np.ndarray) -> np.ndarray:
        """Of each pair, by the customers and tables of each context."""
        discount, parent = totals.discounts[3], self.above_shares(seats, totals)[self.parent]
        own = self.counts - discount * seats[3].tables
        fresh = (STRENGTH + discount * opened)[self.context] * parent
        return (own + fresh) / (STRENGTH + customers)[self.context]


# What stays the same of a part: pairs per word, context and count of each pair; ending of each
# context and, once the owners have answered, its customers and its place with its owner.
_GIVEN = (np.int32, np.int32, np.int64, np.uint16, np.int64, np.int32)
_SEATS = (np.int64,) * 8
_SAMPLE = (np.int64,) * 8
# To an owner: keys and customers of contexts, or in later rounds their places; tables. Back from it
# places and customers, or in later rounds neither; tables.
_TO_OWNER = (np.uint64, np.int64, np.int32, np.int64)
_FROM_OWNER = (np.int32, np.int64, np.int64)
_STATE = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("piece", T.BinaryType()),
        T.StructField("given", T.BinaryType()),
        T.StructField("seats", T.BinaryType()),
        T.StructField("samples", T.ArrayType(T.BinaryType())),
        T.StructField("keys", T.ArrayType(T.IntegerType())),
        T.StructField("values", T.ArrayType(T.LongType())),
        T.StructField("owners", T.ArrayType(T.IntegerType())),
        T.StructField("opened", T.ArrayType(T.BinaryType())),
    ]
)
_ARROW_STATE = pa.schema(
    [
        ("part", pa.int32()),
        ("piece", pa.binary()),
        ("given", pa.binary()),
        ("seats", pa.binary()),
        ("samples", pa.list_(pa.binary())),
        ("keys", pa.list_(pa.int32())),
        ("values", pa.list_(pa.int64())),
        ("owners", pa.list_(pa.int32())),
        ("opened", pa.list_(pa.binary())),
    ]
)
# Keys of the totals: tables and customers by ending, tables by last byte, then single numbers.
_T2, _C2, _T1 = 0, _ENDINGS, 2 * _ENDINGS
_ONE = _T1 + _LAST
_T0, _WORDS, _TOKENS, _ONCE = _ONE, _ONE + 1, _ONE + 2, _ONE + 3  # then twice, by level


def _totals_of(part: _Part, seats: list[_Tables]) -> tuple[np.ndarray, np.ndarray]:
    """The part's share of the totals."""
    dense = np.zeros(_ONCE + 2 * len(seats), np.int64)
    dense[_T2:_C2] = np.bincount(part.ending, seats[2].tables, _ENDINGS)
    dense[_C2:_T1] = np.bincount(part.ending, seats[2].customers, _ENDINGS)
    dense[_T1:_ONE] = np.bincount(part.last, seats[1].tables, _LAST)
    dense[_T0], dense[_WORDS] = seats[0].tables.sum(), (seats[0].customers > 0).sum()
    dense[_TOKENS] = seats[-1].customers.sum()
    for level, at_level in enumerate(seats):
        for n in (1, 2):
            dense[_ONCE + 2 * level + n - 1] = (at_level.customers == n).sum()
    keys = np.flatnonzero(dense)
    return keys.astype(np.int32), dense[keys]


def _row(number: int, given: list, below: _Below, seats: list[_Tables], samples: list, to_owners: list) -> dict:
    keys, values = _totals_of(below.above, seats)
    return {
        "part": number, "given": _pack(*given), "seats": _pack(*[x for s in seats for x in (s.tables, s.size)]),
        "samples": samples, "keys": keys, "values": values,
        "owners": [o for o, _ in to_owners], "opened": [b for _, b in to_owners],
    }


def _gather(n_owners: int):
    """Function for a part: its counts from those of all pieces with everyone at one table, and for
    each piece which pairs it asks for."""

    def gather(messages: pa.Table) -> pa.Table:
        words, per_words, contexts, counts = [], [], [], []
        for blob in messages["blob"]:
            w, per_word, context, n = _unpack(blob.as_py(), *_MESSAGE)
            words.append(w)
            per_words.append(per_word)
            contexts.append(context)
            counts.append(n)
        sizes = [len(n) for n in counts]
        found, word = _ranked(np.concatenate(words))
        word = np.repeat(word, np.concatenate(per_words))
        contexts, context = _ranked(np.concatenate(contexts))
        pairs, pair = _ranked(word * len(contexts) + context)
        counts = np.rint(np.bincount(pair, np.concatenate(counts), len(pairs))).astype(np.int64)
        per_word = np.bincount(pairs // len(contexts), minlength=len(found)).astype(np.int32)
        ending = (contexts & np.uint64(_ENDINGS - 1)).astype(np.uint16)
        none = np.zeros(0, np.int64)
        given = [per_word, (pairs % len(contexts)).astype(np.int32), counts, ending, none, none.astype(np.int32)]
        below = _Below(*given[:2], ending, counts)
        seats = below.start()
        customers, opened = below.by_context(counts), below.by_context(seats[3].tables)
        to_owners = [
            (owner, _pack(contexts[c], customers[c], none.astype(np.int32), opened[c]))
            for owner, c in _ranges(contexts, n_owners)
        ]
        number = messages["part"][0].as_py()
        rows = [_row(number, given, below, seats, [], to_owners)]
        for name, asked in zip(messages["piece"], np.split(pair.astype(np.int32), np.cumsum(sizes)[:-1]), strict=True):
            rows.append({"part": number, "piece": name.as_py(), "given": _pack(asked)})
        return pa.Table.from_pylist(rows, _ARROW_STATE)

    return gather


def _add_up(messages: pa.Table) -> pa.Table:
    """Tables of each context of an owner in all parts, for each part those that it has. The first
    time also the customers, and a place by which the context goes from then on."""
    got = [_unpack(blob.as_py(), *_TO_OWNER) for blob in messages["opened"]]
    keys, customers, place, opened = (np.concatenate(x) for x in zip(*got, strict=True))
    first = len(keys) > 0
    if first:
        place = _ranked(keys)[1]
        customers = np.rint(np.bincount(place, customers)).astype(np.int64)[place]
    opened = np.rint(np.bincount(place, opened)).astype(np.int64)[place]
    ends = np.cumsum([len(g[3]) for g in got])[:-1]
    none = [np.zeros(0, np.int64)] * len(got)
    places = np.split(place.astype(np.int32), ends) if first else [n.astype(np.int32) for n in none]
    blobs = map(_pack, places, np.split(customers, ends) if first else none, np.split(opened, ends))
    return pa.table(
        {"part": messages["part"], "owner": messages["owner"], "blob": pa.array(blobs, pa.binary())}
    )


_REPLY = "part int, owner int, blob binary"


def _replies(state: DataFrame) -> DataFrame:
    """The totals of their contexts for all parts."""
    sent = state.select("part", F.explode(F.arrays_zip("owners", "opened")).alias("x"))
    return (
        sent.select("part", F.col("x.owners").alias("owner"), F.col("x.opened").alias("opened"))
        .groupBy("owner")
        .applyInArrow(_add_up, _REPLY)
    )


class _Loaded:
    """A part with its seats, and the customers and tables that its contexts have in all parts."""

    def __init__(self, row: dict, replies: pa.Table):
        blobs = dict(zip(replies["owner"].to_pylist(), replies["blob"].to_pylist(), strict=True))
        got = [_unpack(blobs[o], *_FROM_OWNER) for o in row["owners"]]
        place, customers, self.opened = (np.concatenate(x) for x in zip(*got, strict=True))
        self.ends = np.cumsum([len(g[2]) for g in got])
        self.given = _unpack(row["given"], *_GIVEN)
        if len(place):
            self.given[4:] = customers, place
        per_word, context, counts, ending, self.customers, self.place = self.given
        self.below = _Below(per_word, context, ending, counts)
        flat = _unpack(row["seats"], *_SEATS)
        self.seats = [_Tables(flat[2 * i], flat[2 * i + 1]) for i in range(4)]

    def sample(self) -> list[np.ndarray]:
        return [*[s.tables for s in self.seats], *[s.customers for s in self.seats[:3]], self.opened]

    def probabilities(self, sample: list[np.ndarray], totals: _Totals) -> np.ndarray:
        """Of each pair, as the model was when the sample and the totals were taken."""
        customers = [*sample[4:7], self.below.counts]
        seats = [SimpleNamespace(tables=t, customers=c) for t, c in zip(sample[:4], customers, strict=True)]
        return self.below.probabilities(seats, totals, self.customers, sample[7])

    def to_owners(self, owners: list[int]) -> list[tuple[int, bytes]]:
        opened = self.below.by_context(self.seats[3].tables)
        none = np.zeros(0, np.int64)
        return [
            (owner, _pack(none.astype(np.uint64), none, place, tables))
            for owner, place, tables in zip(
                owners, np.split(self.place, self.ends[:-1]), np.split(opened, self.ends[:-1]), strict=True
            )
        ]


def _round(state: DataFrame, totals: _Totals, number: int, keep: bool) -> DataFrame:
    """Some sweeps over every part, with the totals of the round before; ``keep``: its seats are a sample."""
    shared = state.sparkSession.sparkContext.broadcast(totals)

    def run(rows: pa.Table, replies: pa.Table) -> pa.Table:
        made = []
        for row in rows.to_pylist():
            part = _Loaded(row, replies)
            rng = np.random.default_rng([number, row["part"]])
            samples = [*(row["samples"] or []), *([_pack(*part.sample())] if keep else [])]
            known = [s.tables.copy() for s in part.seats]
            for _ in range(SWEEPS):
                part.below.sweep(part.seats, shared.value, part.opened, rng, known)
            to_owners = part.to_owners(row["owners"])
            made.append(_row(row["part"], part.given, part.below, part.seats, samples, to_owners))
        return pa.Table.from_pylist(made, _ARROW_STATE)

    return state.groupBy("part").cogroup(_replies(state).groupBy("part")).applyInArrow(run, _STATE)


def _sum_totals(state: DataFrame) -> np.ndarray:
    """The totals over all parts: a bounded number of sums."""
    sums = (
        state.select(F.explode(F.arrays_zip("keys", "values")).alias("x"))
        .groupBy("x.keys")
        .agg(F.sum("x.values").alias("v"))
        .toArrow()
    )
    dense = np.zeros(_ONCE + 8, np.int64)
    dense[sums["keys"].to_numpy()] = sums["v"].to_numpy()
    return dense


def _totals(dense: np.ndarray, discounts: list[float] | None = None) -> _Totals:
    if discounts is None:  # by what is found once and twice at the start, as usual for such models
        once, twice = dense[_ONCE::2], dense[_ONCE + 1 :: 2]
        discounts = list(np.clip(once / np.maximum(once + 2 * twice, 1), 0.05, 0.95))
    return _Totals(
        int(dense[_WORDS]), discounts, dense[_C2:_T1], dense[_T2:_C2], dense[_T1:_ONE], int(dense[_T0])
    )


def _answers(samples: list[_Totals]):
    """Function for a part: probabilities of the pairs each piece asks for."""

    def answer(state: pa.Table, others: pa.Table) -> pa.Table:
        asks = pc.is_valid(others["piece"])
        questions = others.filter(asks)
        row = state.to_pylist()[0]
        part = _Loaded(row, others.filter(pc.invert(asks)))
        below = part.below
        kept = [*[_unpack(b, *_SAMPLE) for b in row["samples"] or []], part.sample()]
        mean = sum(part.probabilities(k, totals) for k, totals in zip(kept, samples, strict=True)) / len(samples)
        logs = np.log10(mean).astype(np.float32)
        word_total = np.rint(np.bincount(below.word_of, below.counts)).astype(np.int64)
        blobs = []
        for blob in questions["blob"]:
            (pair,) = _unpack(blob.as_py(), np.int32)
            word = below.word_of[pair]
            blobs.append(_pack(word_total[word[np.diff(word, prepend=-1) > 0]], logs[pair]))
        return pa.table(
            {"piece": questions["piece"], "part": questions["part"], "answer": pa.array(blobs, pa.binary())}
        )

    return answer


def _texts(docs: DataFrame, id_field: T.StructField) -> DataFrame:
    """For each piece its documents, and which pair every token is."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(id_field.dataType)
    schema = T.StructType(
        [
            T.StructField("piece", T.BinaryType()),
            T.StructField("ids", T.ArrayType(id_field.dataType)),
            T.StructField("held", T.ArrayType(T.BooleanType())),
            T.StructField("tokens", T.BinaryType()),
        ]
    )

    def run(stream):
        for piece, ids, held in _each_piece(stream):
            per_word = np.bincount(piece.word_of, minlength=len(piece.words))
            tokens = _pack(piece.sizes.astype(np.int32), per_word.astype(np.int32), piece.pair.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([piece.name], pa.binary()),
                    pa.array([ids.to_pylist()], pa.list_(kind)),
                    pa.array([held.to_pylist()], pa.list_(pa.bool_())),
                    pa.array([tokens], pa.binary()),
                ],
                names=schema.names,
            )

    return docs.mapInArrow(run, schema)


SCORED = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scorer(n_tokens: int, n_words: int, kind: pa.DataType):
    """Function for a piece: scores of its documents from the answers of all parts."""

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        # Pieces of equal content have equal answers, one of each part is enough.
        by_part = dict(zip(answers["part"].to_pylist(), answers["answer"].to_pylist(), strict=True))
        got = [_unpack(by_part[p], np.int64, np.float32) for p in sorted(by_part)]
        counts = np.concatenate([g[0] for g in got]) if got else np.zeros(0, np.int64)
        logs = np.concatenate([g[1] for g in got]).astype(float) if got else np.zeros(0)
        base = np.log10((counts + 1) / (n_tokens + n_words + 1))
        tables = []
        for row in texts.to_pylist():
            sizes, per_word, pair = _unpack(row["tokens"], np.int32, np.int32, np.int32)
            if len(per_word) != len(counts) or per_word.sum() != len(logs):
                raise RuntimeError("a piece of text was cut differently when it was read again")
            word = np.repeat(np.arange(len(per_word)), per_word)[pair]
            doc = np.repeat(np.arange(len(sizes)), sizes)

            def sums(values, doc=doc, n=len(sizes)):
                return np.bincount(doc, values, n)

            tables.append(
                pa.table(
                    {
                        "id": pa.array(row["ids"], kind),
                        "held_out": pa.array(row["held"], pa.bool_()),
                        "n_tokens": pa.array(sizes.astype(np.int64)),
                        "n_known": pa.array(sums(counts[word] > 0).astype(np.int64)),
                        "train_tokens": pa.array(np.full(len(sizes), n_tokens, np.int64)),
                        "base_score": pa.array(sums(base[word])),
                        "score": pa.array(sums(logs[pair])),
                    }
                )
            )
        return pa.concat_tables(tables)

    return score


def score_documents(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id`` and the model's scores of each row of ``docs``, trained on those not held out.

    Held out are the rows for which crc32 of the id as text leaves 2 when divided by 7; a null id
    counts as an empty text. A null text is an empty one, which is its end token. Repeated rows
    count and score as often as they occur. Other columns are not read. Without any training row
    every token has probability 1.
    """
    spark = docs.sparkSession
    number = F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(
        F.col(id).alias("id"), (number % HELD_OUT_OF == HELD_OUT).alias("held_out"), F.col(text).alias("text")
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = max(int(size // PART_BYTES), 2 * spark.sparkContext.defaultParallelism, 1)

    n_owners = max(n_parts // OWNED_PARTS, spark.sparkContext.defaultParallelism)

    def written(df: DataFrame) -> tuple[DataFrame, str]:
        path = new_path(spark, "restaurants")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    counts = _sent(rows, n_parts).groupBy("part").applyInArrow(_gather(n_owners), _STATE)
    asking, first = F.col("piece").isNotNull(), new_path(spark, "restaurants")
    counts.withColumn("asks", asking).write.partitionBy("asks").parquet(first)
    with_asks = T.StructType([*_STATE.fields, T.StructField("asks", T.BooleanType())])
    state, path = spark.read.schema(with_asks).parquet(first).where("not asks").drop("asks"), f"{first}/asks=false"
    dense = _sum_totals(state)
    totals = _totals(dense)
    n_tokens, n_words = int(dense[_TOKENS]), int(dense[_WORDS])
    samples = []
    for k in range(ROUNDS):
        after, new = written(_round(state, totals, k, k > ROUNDS - SAMPLES))
        remove_path(spark, path)
        state, path = after, new
        totals = _totals(_sum_totals(state), totals.discounts)
        if k >= ROUNDS - SAMPLES:
            samples.append(totals)
    asked = spark.read.schema(with_asks).parquet(first).where("asks")
    others = asked.select("part", F.lit(None).cast("int").alias("owner"), "piece", F.col("given").alias("blob"))
    others = others.unionByName(_replies(state), allowMissingColumns=True)
    answers = state.select("part", "given", "seats", "samples", "owners").groupBy("part").cogroup(
        others.groupBy("part")
    ).applyInArrow(_answers(samples), "piece binary, part int, answer binary")
    id_field = rows.schema["id"]
    texts = _texts(rows, id_field)
    from pyspark.sql.pandas.types import to_arrow_type

    schema = T.StructType([id_field, *T._parse_datatype_string(SCORED).fields])
    scored = texts.groupBy("piece").cogroup(answers.groupBy("piece")).applyInArrow(
        _scorer(n_tokens, n_words, to_arrow_type(id_field.dataType)), schema
    )
    return scored.withColumnRenamed("id", id)


def op4_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
