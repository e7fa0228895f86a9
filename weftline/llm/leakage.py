"""Evaluation texts that stand in a corpus, whole or in part, not always letter by letter.

Pigeonhole edit matching.  An item's own wording (without paragraphs that many
items share) is normalised to letters and digits.  A case is a stretch of at
least ``least`` of it with at most ``errors`` edits a letter, in which at most
CHANGED of the words are others.  The wording is cut into pieces, words joined
to a few letters, so that a changed word spoils one piece only and every stretch
has more pieces than its changes can spoil: ``need`` of them stand unchanged in
a text that holds it, on diagonals no further apart than its edits.  So every
case has ``need`` exact piece hits in one band of diagonals; other bands are
none.  Myers' bit-parallel edit distance then verifies windows of the item
there, for many bands at once, and a local alignment measures how much of the
item is held, in its order.

No piece is ever left out, also not those that many items have, and the limits
are an item's own: what is found for an item depends neither on the other items
nor on how they are put in blocks.

Scale: the corpus is read and normalised once, nothing of it is shuffled or
collected.  Items are a stated query set.  They are broadcast in blocks of
bounded size and a worker keeps the indexes of the latest blocks only.  Piece
hits are looked up for many texts at once in array operations.
"""

from __future__ import annotations

import unicodedata
import uuid
from bisect import bisect_left
from collections import OrderedDict, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.plans.shape import spread

#: Letters of the items in one broadcast block, and letters of texts and piece hits looked at together.
BLOCK_LETTERS, CHUNK_LETTERS, CHUNK_HITS = 500_000, 200_000, 3_000_000
BLOCKS_KEPT = 8  # indexes that a worker keeps
LANES = 1024  # candidates verified together
#: An item of fewer letters must be held whole: half of it is a name or two.
SHORT = 24
#: Errors a letter in the stretch that is held: one word in five replaced, at words of any length.
ERRORS = 0.2
#: A stretch without any number has to agree more closely, for nothing else tells it from its pattern filled in otherwise.
ERRORS_WITHOUT_NUMBERS = 0.14
CHANGED = 0.22  # words that may be others, in scripts without spaces letters; those of a case are looked for in all of its stretch
LEAST_PIECE = 4
STRETCH = 0.8  # of the shortest stretch, that Myers' distance is taken of
SHARED = 3  # different items from which on a paragraph is no item's own

_NUMBER = regex.compile(r"\p{N}+")
_WIDE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")
_DROP = regex.compile(r"[^\p{L}\p{N}\p{M}]+")


def normal(text: str) -> str:
    """Letters, marks and digits in one compatible, caseless form."""
    return _DROP.sub("", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()))


def own_wording(items: DataFrame, item_id: str, text: str, shared: int = SHARED) -> DataFrame:
    """(item, wording): each item without paragraphs that ``shared`` or more items have beside different other ones.

    The same item registered several times keeps all of its paragraphs.
    """
    cleaned = F.filter(F.transform(F.split(F.col(text), r"\R"), F.trim), lambda p: p != "")
    whole = items.where(F.col(text).isNotNull()).select(F.col(item_id).cast("bigint").alias("item"), cleaned.alias("all"))
    paragraphs = whole.select("item", "all", F.posexplode("all").alias("at", "paragraph"))
    rest = F.xxhash64(F.array_join(F.array_except("all", F.array("paragraph")), "\n"))
    common = paragraphs.groupBy("paragraph").agg(F.countDistinct(rest).alias("n")).where(F.col("n") >= shared).select("paragraph")
    own = paragraphs.join(common, "paragraph", "left_anti")
    return own.groupBy("item").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("at", "paragraph"))), lambda p: p["paragraph"])).alias("wording"))


def distance(pattern: str, text: str) -> int:
    """Least edit distance of ``pattern`` to any stretch of ``text`` (Myers 1999)."""
    m = len(pattern)
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = m
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            best = min(best, score)
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
    return best


_FULL = ~np.uint64(0)
_ONE = np.uint64(1)


def any_within(lanes: list[tuple[int, int, int, int]], masks: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Which of many patterns have an edit distance within ``edits`` to a stretch of their text: Myers' algorithm, all lanes at once.

    A lane is (first row of its masks, row of ``letters``, length of the pattern,
    edits); ``masks`` has a row of 64-bit words for each letter of a lane's
    alphabet, ``letters`` the texts as places in it.  All patterns take as many words.
    """
    base, text, width, edits = (np.array(c) for c in zip(*lanes, strict=True))
    words, n = masks.shape[1], len(lanes)
    high = ((width - 1) % 64).astype(np.uint64)
    last = words - 1
    pv, mv = [np.full(n, _FULL) for _ in range(words)], [np.zeros(n, np.uint64) for _ in range(words)]
    score = width.copy()
    best = score.copy()
    top = np.uint64(63)
    for t in range(letters.shape[1]):
        eqs = masks[base + letters[text, t]]
        up = down = np.zeros(n, np.uint64)  # what a word hands to the next: one more, one less
        for w in range(words):
            p, m = pv[w], mv[w]
            eq = eqs[:, w]
            xv = eq | m
            eq = eq | down
            xh = (((eq & p) + p) ^ p) | eq
            ph = m | ~(xh | p)
            mh = p & xh
            if w == last:
                score += (ph >> high & _ONE).astype(np.int64)
                score -= (mh >> high & _ONE).astype(np.int64)
            ph, mh, up, down = ph << _ONE | up, mh << _ONE | down, ph >> top, mh >> top
            pv[w] = mh | ~(xv | ph)
            mv[w] = ph & xv
        np.minimum(best, score, out=best)
    return best <= edits


def _ends(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Where the best local alignment of a and b ends, and its score: 1 a letter, -2 an edit."""
    steps = 2 * np.arange(len(b) + 1, dtype=np.int32)
    above = np.zeros(len(b) + 1, np.int32)
    gain = {c: np.where(b == c, 1, -2).astype(np.int32) for c in np.unique(a)}
    best = (0, 0, 0)
    now, shifted = np.empty_like(above), np.empty_like(above)
    for i, c in enumerate(a, 1):
        np.subtract(above, 2, out=now)
        np.maximum(now[1:], above[:-1] + gain[c], out=now[1:])
        np.maximum(now, 0, out=now)
        np.add(now, steps, out=shifted)
        np.maximum.accumulate(shifted, out=shifted)
        np.subtract(shifted, steps, out=now)
        j = int(now.argmax())
        if now[j] > best[2]:
            best = (i, j, int(now[j]))
        above, now = now, above
    return best


def held(item: str, text: str, least: int = 1) -> tuple[int, int]:
    """Stretch of the item that its best local alignment with ``text`` spans; none if it scores below ``least``."""
    a, b = _codes(item), _codes(text)
    i, j, score = _ends(a, b)
    if score < least:
        return 0, 0
    back, _, _ = _ends(a[:i][::-1], b[:j][::-1])
    return i - back, i


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def budget(letters: int, errors: float = ERRORS) -> int:
    """Edits allowed in a stretch of so many letters."""
    return int(errors * letters)


def _pieces(text: str) -> tuple[str, list[tuple[int, int, int]], list[int]]:
    """The wording's letters, its pieces as (start, end, words or letters that may change in it), and where units begin.

    Words, joined until they have LEAST_PIECE letters; in scripts without
    spaces, groups of so few letters that an edit spoils one of them only.
    """
    letters, pieces, units = [], [], []
    n = begin = 0  # ``begin`` to n are words that are not yet a piece
    for word in text.split():
        word = normal(word)
        if not word:
            continue
        units.append(n)
        if _UNSPACED.search(word):
            if n > begin:
                pieces.append((begin, n))
            size = 2 if _WIDE.search(word) else 3
            pieces += [(n + a, min(n + a + size, n + len(word))) for a in range(0, len(word), size)]
            units += range(n + 1, n + len(word))
            begin = n + len(word)
        elif n + len(word) - begin >= LEAST_PIECE:
            pieces.append((begin, n + len(word)))
            begin = n + len(word)
        letters.append(word)
        n += len(word)
    if n > begin:
        pieces.append((begin, n))
    return "".join(letters), pieces, units


class Plan:
    """How an item is cut: its shortest stretch, its pieces, and how many of them a case keeps whole."""

    def __init__(self, text: str, least: float, errors: float = ERRORS, changed: float = CHANGED):
        self.letters, self.pieces, units = _pieces(text)
        m = len(self.letters)
        self.least = 1.0 if m < SHORT else least
        self.shortest = max(1, int(self.least * m))
        #: Diagonals of one case differ by no more than its edits.
        self.band = budget(m, errors) + 1
        start, end = (np.array(c) for c in zip(*self.pieces, strict=True)) if self.pieces else (np.zeros(0, int),) * 2
        # A stretch from within piece i to within piece j has those between them whole, but for one to each changed unit.
        before, upto = np.searchsorted(units, start, "right") - 1, np.searchsorted(units, end, "left")
        i, j = np.triu_indices(len(start))
        inside = (j - i - 1)[wide := end[j] - start[i] - 2 >= self.shortest]
        spoiled = np.ceil(changed * (upto[j] - before[i])[wide]).astype(int)
        most = int(spoiled[inside == inside.min()].max()) if len(inside) else 0
        ends = len(start) - np.ceil(changed * len(units))  # all of the item, whose first and last piece are whole too
        self.need = max(1, int(min([ends, *(inside - spoiled)])))
        # A shortest stretch holds one of these windows whole, with no more edits than are allowed in all of it.
        self.width = max(1, int(STRETCH * self.shortest))
        self.windows = list(range(0, m - self.width + 1, max(1, self.shortest - self.width))) if m else []
        #: First letters of the pieces that lie in each window, and how many of them a case keeps.
        self.within = [(a, a + self.width, max(0, sum(a <= s and e <= a + self.width for s, e in self.pieces) - most)) for a in self.windows]
        self.edits = budget(self.shortest, errors)


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BITS = 20


def _hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """A number for each group of ``size`` neighbouring codes."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = codes[:n].copy()
    for k in range(1, size):
        out *= _BASE
        out += codes[k : n + k]
    return out * _BASE ^ (out >> np.uint64(29))


class _Lookup:
    """Places of groups of letters by their number, behind a bit table that most other groups fail."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes, kind="stable")
        self.keys, first, times = np.unique(hashes[self.order], return_index=True, return_counts=True)
        self.first, self.times = first, times
        self.table = np.zeros(1 << _BITS, bool)
        self.table[self.keys >> np.uint64(64 - _BITS)] = True

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, key numbers) of the hashes that are there."""
        at = np.flatnonzero(self.table[hashes >> np.uint64(64 - _BITS)])
        j = np.searchsorted(self.keys, hashes[at])
        j[j == len(self.keys)] = 0
        same = self.keys[j] == hashes[at]
        return at[same], j[same]

    def places(self, at: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each hit with each place of its group."""
        times = self.times[j]
        inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return np.repeat(at, times), self.order[np.repeat(self.first[j], times) + inner]


class Block:
    """Items with the index of their pieces."""

    def __init__(self, items: list[tuple[int, str]], least: float = 0.5, errors: float = ERRORS, errors_without_numbers: float = ERRORS_WITHOUT_NUMBERS):
        self.errors, self.without = errors, errors_without_numbers
        self.ids = [k for k, _ in items]
        self.plans = [Plan(text, least, errors) for _, text in items]
        self.longest = max((len(p.letters) for p in self.plans), default=0)
        self.need = np.array([p.need for p in self.plans])
        self.band = np.array([p.band for p in self.plans])
        self.own = [_codes(p.letters) for p in self.plans]
        self.alphabets = [np.unique(c) for c in self.own]
        self._masks: dict[tuple[int, int], np.ndarray] = {}
        by_size: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for no, plan in enumerate(self.plans):
            for a, b in plan.pieces:
                by_size[b - a].append((no, a))
        self.lookups = []
        for size, places in by_size.items():
            no, at = (np.array(c) for c in zip(*places, strict=True))
            codes = _codes("".join(self.plans[i].letters[a : a + size] for i, a in places))
            self.lookups.append((size, _Lookup(_hashes(codes, size)[::size]), no, at))

    def found(self, texts: list[str]) -> dict[tuple[int, int], float]:
        """Share held by (number of the text, item) of normalised texts."""
        out: dict[tuple[int, int], float] = {}
        part: list[tuple[int, str]] = []
        letters = 0
        overlap = 3 * self.longest + 64  # a longer text is looked at in stretches that any case lies in whole
        for no, text in enumerate(texts):
            for a in range(0, max(1, len(text) - overlap), CHUNK_LETTERS):
                stretch = text[a : a + CHUNK_LETTERS + overlap]
                if part and letters + len(stretch) > CHUNK_LETTERS + overlap:
                    self._chunk(part, out)
                    part, letters = [], 0
                part.append((no, stretch))
                letters += len(stretch)
        if part:
            self._chunk(part, out)
        return out

    def _chunk(self, part: list[tuple[int, str]], out: dict[tuple[int, int], float]) -> None:
        codes = _codes("\0".join(t for _, t in part))
        looked = [(*lookup.hits(_hashes(codes, size)), lookup, no, at) for size, lookup, no, at in self.lookups]
        if len(part) > 1 and sum(int(lookup.times[j].sum()) for _, j, lookup, _, _ in looked) > CHUNK_HITS:
            self._chunk(part[: len(part) // 2], out)
            self._chunk(part[len(part) // 2 :], out)
            return
        starts = np.concatenate([[0], np.cumsum([len(t) + 1 for _, t in part])])
        here, item, at = [], [], []
        for place, j, lookup, no, offset in looked:
            p, k = lookup.places(place, j)
            here.append(p)
            item.append(no[k])
            at.append(offset[k])
        here, item, at = (np.concatenate(c) for c in (here, item, at))
        # Hits of one case lie in one slot of diagonals or in two neighbouring ones; a slot belongs to one text.
        text = np.searchsorted(starts, here, "right") - 1
        slot = (here - starts[text] - at + self.longest) // self.band[item]
        slots = int(np.diff(starts).max()) + self.longest + 2
        group = (item * len(part) + text) * slots + slot
        pieces = np.unique(group * (self.longest + 1) + at)  # a piece counts once in a slot
        groups, offsets = pieces // (self.longest + 1), pieces % (self.longest + 1)
        keys, count = np.unique(groups, return_counts=True)
        after = np.append(np.where(keys[1:] == keys[:-1] + 1, count[1:], 0), 0)
        need = self.need[keys // slots // len(part)]
        enough = count + after >= need
        # A slot that suffices alone is covered by the pair before it, if there is one.
        enough[1:] &= ~((keys[1:] == keys[:-1] + 1) & (after[1:] == 0) & enough[:-1])
        first = np.searchsorted(groups, keys)
        beyond = first + count + after
        candidates: list[tuple[int, int, str]] = []
        tried: list[list[int]] = []
        for key, lo, hi in zip(keys[enough].tolist(), first[enough].tolist(), beyond[enough].tolist(), strict=True):
            (i, k), s = divmod(key // slots, len(part)), key % slots
            plan, band = self.plans[i], int(self.band[i])
            hits = sorted(set(offsets[lo:hi].tolist()))
            windows = [w for w, (a, b, least) in enumerate(plan.within) if bisect_left(hits, b) - bisect_left(hits, a) >= least]
            if windows:
                begin = s * band - self.longest
                candidates.append((i, part[k][0], part[k][1][max(0, begin - band) : max(0, begin + 3 * band + len(plan.letters))]))
                tried.append(windows)
        for c in self._near(candidates, tried):
            i, no, region = candidates[c]
            known = out.get((no, self.ids[i]), 0.0)
            if known < 1.0 and (share := self._held(region, self.plans[i])) > known:
                out[no, self.ids[i]] = share

    def _near(self, candidates: list[tuple[int, int, str]], tried: list[list[int]]) -> list[int]:
        """The candidates of which a window is in their region within the edits allowed."""
        by_words: dict[int, list[int]] = defaultdict(list)
        for c in sorted(range(len(candidates)), key=lambda c: len(candidates[c][2])):
            by_words[-(-self.plans[candidates[c][0]].width // 64)].append(c)
        near: set[int] = set()
        for own in by_words.values():
            for a in range(0, len(own), LANES):
                group = own[a : a + LANES]
                letters = np.zeros((len(group), max(len(candidates[c][2]) for c in group)), np.int64)
                masks, rows, base = [], 0, {}
                lanes, of = [], []
                for row, c in enumerate(group):
                    i, _, region = candidates[c]
                    codes, alphabet = _codes(region), self.alphabets[i]
                    at = np.minimum(np.searchsorted(alphabet, codes), len(alphabet) - 1)
                    letters[row, : len(codes)] = np.where(alphabet[at] == codes, at + 1, 0)
                    for w in tried[c]:
                        if (i, w) not in base:
                            base[i, w] = rows
                            masks.append(self.masks(i, w))
                            rows += len(masks[-1])
                        lanes.append((base[i, w], row, self.plans[i].width, self.plans[i].edits))
                        of.append(c)
                near.update(of[k] for k in np.flatnonzero(any_within(lanes, np.concatenate(masks), letters)).tolist())
        return sorted(near)

    def masks(self, i: int, w: int) -> np.ndarray:
        """Myers' masks of a window: a row for each letter of the item's alphabet, the first for all others."""
        if (got := self._masks.get((i, w))) is None:
            plan = self.plans[i]
            own = self.own[i][plan.windows[w] : plan.windows[w] + plan.width]
            got = np.zeros((len(self.alphabets[i]) + 1, -(-plan.width // 64)), np.uint64)
            place = np.arange(plan.width)
            np.bitwise_or.at(got, (np.searchsorted(self.alphabets[i], own) + 1, place // 64), _ONE << (place % 64).astype(np.uint64))
            self._masks[i, w] = got
        return got

    def _held(self, region: str, plan: Plan) -> float:
        """Share of the item that the region holds; 0 beyond the edits allowed or below the least share."""
        # Of a stretch with so many edits at most, all but these agree.
        start, end = held(plan.letters, region, max(1, plan.shortest - 3 * plan.edits))
        own = plan.letters[start:end]
        if len(own) < plan.least * len(plan.letters):
            return 0.0
        numbers = _NUMBER.findall(own)
        if distance(own, region) <= budget(len(own), self.errors if numbers else self.without) and _same_numbers(numbers, region):
            return len(own) / len(plan.letters)
        return 0.0


def _same_numbers(numbers: list[str], region: str) -> bool:
    """Whether half of the numbers stand in ``region``: a pattern filled in otherwise has other ones."""
    there = set(_NUMBER.findall(region))
    return 2 * sum(n in there for n in numbers) >= len(numbers)


_OUT = pa.schema([("doc", pa.int64()), ("item", pa.int64()), ("share", pa.float64())])
_kept: OrderedDict[tuple, Block] = OrderedDict()


def _index(name: str, shared, *options: float) -> Block:
    """The index of a broadcast block, built once a worker while it is among the latest."""
    key = (name, *options)
    if key in _kept:
        _kept.move_to_end(key)
    else:
        _kept[key] = Block(shared.value, *options)
        while len(_kept) > BLOCKS_KEPT:
            _kept.popitem(last=False)
    return _kept[key]


def leaks(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    *, least: float = 0.5, errors: float = ERRORS, errors_without_numbers: float = ERRORS_WITHOUT_NUMBERS, block_letters: int = BLOCK_LETTERS,
) -> DataFrame:
    """(doc_id, item_id, share): documents that hold at least ``least`` of an item's own wording, in its order.

    Case, punctuation, white space, compatible character forms, invisible
    characters and single replaced words do not matter: up to ``errors`` edits a
    letter.  NULL and empty texts hold nothing; an item without own wording
    (NULL, empty or all of it shared) cannot leak.  Whole texts are searched.
    Repeated rows give one result; items registered twice under one id give the
    greater share.  Other columns are not read.
    """
    corpus = spread(docs.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).alias("t")))
    context = docs.sparkSession.sparkContext
    blocks, block, letters = [], [], 0
    # The items are the stated query set; they pass through the driver in blocks of bounded size.
    for row in own_wording(items, item_id, item_text).orderBy("item").toLocalIterator():
        size = len(normal(row["wording"]))
        if not size:
            continue
        if block and letters + size > block_letters:
            blocks.append((uuid.uuid4().hex, context.broadcast(block)))
            block, letters = [], 0
        block.append((row["item"], row["wording"]))
        letters += size
    if block:
        blocks.append((uuid.uuid4().hex, context.broadcast(block)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [normal(t) for t in batch.column(1).to_pylist()]
            for name, shared in blocks:
                if found := _index(name, shared, least, errors, errors_without_numbers).found(texts):
                    columns = [[ids[no] for no, _ in found], [item for _, item in found], list(found.values())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _OUT, strict=True)], schema=_OUT)

    found = corpus.mapInArrow(run, "doc bigint, item bigint, share double")
    return found.groupBy("doc", "item").agg(F.max("share").alias("share")).select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "share")
