"""Texts into containers of a fixed number of tokens, over several context sizes.

Each text is routed to a tier, the least of ``tiers`` that holds it, and each
tier is packed for itself: its texts go into packs of its own context size, with
best fit in order of length.  A pack is what attends to itself.  Containers,
whose size is the longest context, are then laid out from the longest tier
down: a pack of the tier opens a container, and the gap that it leaves is filled
with whole packs of the shorter tiers.  What no pack fits is filled from the
least filled packs of each tier, which are taken apart for it.  Only a text that
alone exceeds a container is split, into full containers and a rest that is
packed like any other text.

Containers are dealt to step groups of about the same work, the sum over packs
of their squared lengths, as attention costs.

Scale: texts are dealt to shards by a hash, whose number depends on the number
of rows only; a shard has some tens of thousands of texts, of which only ids and
lengths are held.  A task packs one shard after another, so that the result does
not depend on partitions or batches.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.plans.ranges import key_runs, walk
from weftline.plans.shape import shuffle_partitions, spread

CAPACITY = 2048
TIERS = (256, 512, 1024, 2048)
SHARD_ROWS = 20_000
GROUP = 16
#: Shares of a tier's packs, the least filled ones, that are taken apart to fill gaps; the share that needs the fewest containers is kept.
LOOSE = (0.02, 0.1, 0.3, 0.6)


def tokenizer_path(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def encoder(path: str):
    """A byte-level tokenizer from a vocabulary of ranks, loaded once a worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("weftline", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, doc_id: str, text: str, path: str | None = None) -> DataFrame:
    """(id, tokens): a row per row of ``docs``; NULL and empty texts have 0 tokens."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for batch in batches:
            counts = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["id", "tokens"])

    return spread(docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"))).mapInArrow(run, "id bigint, tokens bigint")


class _Lengths:
    """Things by length, with a quick step to the longest that fits."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        order = np.argsort(lengths, kind="stable")
        self.order = order.tolist()
        counts = np.bincount(lengths, minlength=capacity + 1)
        self.first = np.concatenate([[0], np.cumsum(counts)]).tolist()
        self.left = counts.tolist()
        self.down = list(range(capacity + 1))  # next length at or below that may have things
        self.capacity = capacity

    def longest(self, room: int) -> int:
        """The greatest length up to ``room`` that has things, else 0."""
        room = root = min(room, self.capacity)
        while root and not self.left[root]:
            root = self.down[root] if self.down[root] != root else root - 1
        while room > root:
            self.down[room], room = root, self.down[room] if self.down[room] != room else room - 1
        return root

    def take(self, length: int) -> int:
        self.left[length] -= 1
        return self.order[self.first[length] + self.left[length]]


def _packs(items: np.ndarray, lengths: np.ndarray, size: int) -> list[list[int]]:
    """Items into packs of ``size``: the longest left opens one, and the longest that fits fills it."""
    pool = _Lengths(lengths[items], size)
    packs: list[list[int]] = []
    while length := pool.longest(size):
        room, own = size, []
        while length:
            own.append(int(items[pool.take(length)]))
            room -= length
            length = pool.longest(room)
        packs.append(own)
    return packs


Packed = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY, tiers: tuple[int, ...] = TIERS, loose: tuple[float, ...] = LOOSE) -> Packed:
    """(container, offset, tier of the container, pack, context of the pack) of each item; lengths from 1 to capacity.

    Packs are numbered within their container.  An item that fills a gap by
    itself is a pack of its own, with its tier's context.
    """
    sizes = sorted({min(t, capacity) for t in tiers} | {capacity})
    if sizes[0] <= 0:
        raise ValueError("tiers must be positive")
    if not len(lengths):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return min((_lay_out(lengths, capacity, sizes, share) for share in loose), key=lambda packed: packed[0].max())


def _lay_out(lengths: np.ndarray, capacity: int, sizes: list[int], loose: float) -> Packed:
    n = len(lengths)
    container, offset, tier, pack, context = (np.zeros(n, np.int64) for _ in range(5))
    of_tier = np.searchsorted(sizes, lengths)
    packs: list[list[int]] = []
    pools, tiny = {}, []
    for k, size in enumerate(sizes):
        own = _packs(np.flatnonzero(of_tier == k), lengths, size)
        if size < capacity:  # a pack of the longest tier is a container, and opens one
            own.sort(key=lambda p: (-sum(lengths[p]), p))
            apart = int(len(own) * loose)
            tiny += [[i] for p in own[len(own) - apart :] for i in p]
            own = own[: len(own) - apart]
        pools[size] = (len(packs), _Lengths(np.array([lengths[p].sum() for p in own], np.int64), size))
        packs += own
    singles = (len(packs), _Lengths(np.array([lengths[p[0]] for p in tiny], np.int64), capacity))
    packs += tiny
    no = 0
    for size in [*sizes[::-1], 0]:
        first, opening = pools.get(size, singles)
        fillers = [pools[s] for s in sizes[::-1] if s <= size] + [singles]
        while (length := opening.longest(capacity)) > 0:
            at = count = 0
            start = first
            pool = opening
            while length:
                own = packs[start + pool.take(length)]
                for i in own:
                    container[i], offset[i], tier[i], pack[i] = no, at, size or sizes[of_tier[i]], count
                    context[i] = sizes[of_tier[i]]
                    at += int(lengths[i])
                count += 1
                # The gap: a pack of this tier or of a shorter one, the longest tier first, then single items.
                for start, pool in fillers:
                    if length := pool.longest(capacity - at):
                        break
            no += 1
    leader = np.zeros(no, np.int64)
    leader[container[offset == 0]] = tier[offset == 0]
    return container, offset, leader[container], pack, context


def step_groups(container: np.ndarray, pack: np.ndarray, lengths: np.ndarray, group: int = GROUP) -> np.ndarray:
    """Group of each item's container; groups of ``group`` containers with about equal work."""
    if not len(container):
        return container
    of_pack, place = np.unique(container * (pack.max() + 1) + pack, return_inverse=True)
    total = np.bincount(place, weights=lengths.astype(float))
    work = np.bincount(of_pack // (pack.max() + 1), weights=total**2)
    groups = -(-len(work) // group)
    rank = np.empty(len(work), np.int64)
    rank[np.argsort(-work, kind="stable")] = np.arange(len(work))
    lap, place = np.divmod(rank, groups)
    return np.where(lap % 2 == 0, place, groups - 1 - place)[container]


_OUT = pa.schema([(c, pa.int64()) for c in ("id", "part", "parts", "tokens", "token_start", "container", "container_offset", "tier", "pack", "context", "step_group")])
_DDL = ", ".join(f"{f.name} bigint" for f in _OUT)
#: Copies of one row that are written out together.
COPIES = 4096


def _pack(capacity: int, tiers: tuple[int, ...], group: int):
    def packed(rows: list[list[np.ndarray]]) -> pa.RecordBatch:
        shard, ids, part, parts, tokens, start = (np.concatenate(c) for c in zip(*rows, strict=True))
        order = np.lexsort((part, ids, -tokens))
        ids, part, parts, tokens, start = (c[order] for c in (ids, part, parts, tokens, start))
        container, offset, tier, own, context = pack_lengths(tokens, capacity, tiers)
        base = int(shard[0]) << 32
        groups = step_groups(container, own, tokens, group) | base
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ids, part, parts, tokens, start, container | base, offset, tier, own, context, groups)], schema=_OUT)

    def step(_: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            for a, b in key_runs(columns[:1]):
                if held and held[0][0][0] != columns[0][a]:
                    yield packed(held)
                    held = []
                held.append([c[a:b] for c in columns])
        if held:
            yield packed(held)

    return step


def pack(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
    *, capacity: int = CAPACITY, tiers: tuple[int, ...] = TIERS, group: int = GROUP, tokenizer: str | None = None, shards: int | None = None,
) -> DataFrame:
    """(doc_id, part, parts, tokens, token_start, container, container_offset, tier, pack, context, step_group).

    One row per text, or per part of a text longer than ``capacity`` tokens:
    parts are full containers but for the last.  ``token_start`` is the part's
    first token in its text.  ``tier`` is the context size of the container's
    first pack, ``context`` that of the row's own ``pack``.  Texts of equal
    length are told apart by id, so the result is the same each time.  NULL and
    empty texts take no room and have no row, nor have rows with a NULL id;
    repeated rows are texts of their own.
    """
    n = shards or max(1, docs.count() // SHARD_ROWS)
    counted = token_counts(docs, doc_id, text, tokenizer).where((F.col("tokens") > 0) & F.col("id").isNotNull())
    # Repeated rows are counted and numbered, so that a row with many copies is spread over the shards like others.
    copies = counted.groupBy("id", "tokens").agg(F.count(F.lit(1)).alias("copies"))
    zero = F.lit(0).cast("bigint")
    blocks = copies.withColumn("block", F.explode(F.sequence(zero, F.col("copies") - 1, F.lit(COPIES).cast("bigint"))))
    each = blocks.withColumn("copy", F.explode(F.sequence("block", F.least(F.col("block") + (COPIES - 1), F.col("copies") - 1))))
    parts = F.ceil(F.col("tokens") / capacity).cast("bigint")
    pieces = each.select("id", "tokens", "copy", parts.alias("parts"), F.posexplode(F.sequence(zero, parts - 1)).alias("at", "part")).select(
        F.pmod(F.xxhash64("id", "part", "copy"), F.lit(n).cast("bigint")).alias("shard"), "id", "part", "parts",
        F.least(F.lit(capacity).cast("bigint"), F.col("tokens") - F.col("part") * capacity).alias("tokens"), (F.col("part") * capacity).alias("token_start"),
    )
    laid = pieces.repartition(min(n, shuffle_partitions(docs.sparkSession)), "shard").sortWithinPartitions("shard")
    return walk(laid, _pack(capacity, tiers, group), _DDL).withColumnRenamed("id", doc_id)


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(container, step_group, tier, packs, texts, tokens, unused, work) per container."""
    of_pack = packed.groupBy("container", "pack").agg(F.first("step_group").alias("step_group"), F.max("tier").alias("tier"), F.count(F.lit(1)).alias("texts"), F.sum("tokens").alias("tokens"))
    return of_pack.groupBy("container").agg(
        F.first("step_group").alias("step_group"), F.max("tier").alias("tier"), F.count(F.lit(1)).alias("packs"), F.sum("texts").alias("texts"), F.sum("tokens").alias("tokens"),
        (F.lit(capacity) - F.sum("tokens")).alias("unused"), F.sum(F.col("tokens") * F.col("tokens")).alias("work"),
    )
