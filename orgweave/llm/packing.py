"""Filling fixed-capacity containers: pattern packing by non-negative least squares.

The driver sees only the histogram of sizes, which has at most capacity + 1
bars.  It enumerates patterns of a few sizes that fill a container, fits how
often to repeat each by non-negative least squares, rounds down, and packs what
is left by best fit, into the room that patterns leave as well.  The plan says
for every size which of its ranks go where; items get their rank within their
size from per-bucket counts and look their container up, so no group of items
is ever in one task and no item is sent to the driver.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Sizes are fitted in this many classes, by patterns of at most this many items.
CLASSES, ITEMS = 64, 4
#: Items of one size that a task ranks.
RANKED_PER_TASK = 2_000_000


def patterns(total: int, items: int) -> np.ndarray:
    """Counts per class (1..total) of all multisets of at most ``items`` classes that sum to ``total``."""
    found: list[list[int]] = []

    def grow(left: int, least: int, room: int, got: list[int]) -> None:
        if left == 0:
            found.append(got)
            return
        if room == 1:
            if left >= least:
                found.append([*got, left])
            return
        for part in range(least, left + 1):
            if part == left or part * 2 <= left:
                grow(left - part, part, room - 1, [*got, part])

    grow(total, 1, items, [])
    out = np.zeros((len(found), total + 1))
    for k, parts in enumerate(found):
        np.add.at(out[k], parts, 1)
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 600) -> np.ndarray:
    """The x >= 0 with the least |a x - b|: an active set of columns that grows by the steepest and is refitted."""
    x = np.zeros(a.shape[1])
    active = np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        gradient = a.T @ (b - a @ x)
        gradient[active] = -np.inf
        best = int(gradient.argmax())
        if gradient[best] <= 1e-9 * (1 + np.abs(b).max()):
            break
        active[best] = True
        while True:
            at = np.flatnonzero(active)
            fit = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (fit > 0).all():
                x[:] = 0
                x[at] = fit
                break
            low = fit <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - fit[low], 1e-300))
            moved = x[at] + step * (fit - x[at])
            x[:] = 0
            x[at] = np.where(moved > 1e-12, moved, 0)
            active = x > 0
            if not active.any():
                return x
    return x


def plan(counts: np.ndarray, capacity: int, classes: int = CLASSES, items: int = ITEMS) -> list[tuple[int, list[int]]]:
    """(containers, sizes in each) for ``counts[s]`` items of size s (1..capacity); every item is in exactly one."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    classes = min(classes, capacity)
    class_of = -(-np.arange(capacity + 1) * classes // capacity)
    groups: list[tuple[int, list[int]]] = []
    if left.sum() > 0:
        shapes = patterns(classes, items)
        wanted = np.bincount(class_of, weights=left, minlength=classes + 1)
        repeats = nnls(shapes[:, 1:].T, wanted[1:])
        by_class = {c: [int(s) for s in np.flatnonzero((class_of == c) & (left > 0))] for c in range(1, classes + 1)}
        for k in np.argsort(-repeats, kind="stable"):
            times = int(repeats[k])
            parts = [c for c in range(classes, 0, -1) for _ in range(int(shapes[k][c]))]
            for c in set(parts):
                times = min(times, int(sum(left[s] for s in by_class[c])) // parts.count(c))
            if times < 1:
                continue
            open_ = [(times, [])]
            for c in parts:
                filled = []
                for n, sizes in open_:
                    while n:
                        size = by_class[c][-1]
                        if not left[size]:
                            by_class[c].pop()
                            continue
                        m = min(n, int(left[size]))
                        left[size] -= m
                        n -= m
                        filled.append((m, [*sizes, size]))
                open_ = filled
            groups += open_
    rooms: dict[int, list[tuple[int, list[int]]]] = {}
    for n, sizes in groups:
        rooms.setdefault(capacity - sum(sizes), []).append((n, sizes))
    sorted_rooms = sorted(rooms)

    def put(room: int, group: tuple[int, list[int]]) -> None:
        if room not in rooms:
            bisect.insort(sorted_rooms, room)
            rooms[room] = []
        rooms[room].append(group)

    for size in range(capacity, 0, -1):
        n = int(left[size])
        while n:
            at = bisect.bisect_left(sorted_rooms, size)
            if at == len(sorted_rooms):
                each = capacity // size
                if n >= each:
                    put(capacity - each * size, (n // each, [size] * each))
                if n % each:
                    put(capacity - n % each * size, (1, [size] * (n % each)))
                break
            room = sorted_rooms[at]
            have, sizes = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                sorted_rooms.pop(at)
            m = min(n, have)
            if have > m:
                put(room, (have - m, sizes))
            put(room - size, (m, [*sizes, size]))
            n -= m
    return [g for room in sorted(rooms) for g in rooms[room]]


class Lookup:
    """Container of the item with a given rank among those of its spec and size."""

    def __init__(self, plans: dict[int, tuple[int, list[tuple[int, list[int]]]]]):
        starts, bases, self.first, self.total = [], [], {}, {}
        per: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for spec, (_, groups) in plans.items():
            base = 0
            for n, sizes in groups:
                for size in sizes:
                    per.setdefault((spec, size), []).append((base, n))
                base += n
            self.total[spec] = max(base, 1)
        self.keys = {key: i for i, key in enumerate(sorted(per))}
        for key in sorted(per):
            rank = 0
            for base, n in per[key]:
                starts.append((self.keys[key] << 44) + rank)
                bases.append(base - rank)
                rank += n
        self.starts, self.bases = np.array(starts, np.int64), np.array(bases, np.int64)

    def __call__(self, spec: np.ndarray, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        out = np.empty(len(spec), np.int64)
        for s in np.unique(spec):
            at = np.flatnonzero(spec == s)
            none = at[size[at] == 0]
            out[none] = rank[none] % self.total[s]
            at = at[size[at] > 0]
            sizes, which = np.unique(size[at], return_inverse=True)
            group = np.array([self.keys[(int(s), int(z))] for z in sizes], np.int64)[which] if len(sizes) else np.empty(0, np.int64)
            slot = np.searchsorted(self.starts, (group << 44) + rank[at], side="right") - 1
            out[at] = self.bases[slot] + rank[at]
        return out


def pack(sizes: DataFrame, key: str, size: str, specs: list[tuple[int, int]], scratch, ranked_per_task: int = RANKED_PER_TASK) -> DataFrame:
    """``spec_id, container_id, key, piece_no, first_token, n_tokens`` for every item and spec.

    ``specs`` are (spec_id, capacity >= 1).  An item above the capacity is cut
    into full pieces and a rest; no other is.  Items of size 0 (or null) take no room and
    are spread over the containers.  Each row is an item, repeated or not; no
    items, no rows.
    """
    if not specs:
        raise ValueError("no container sizes")
    caps = F.array(*[F.struct(F.lit(i).cast("int").alias("spec_id"), F.lit(c).cast("int").alias("cap")) for i, c in specs])
    whole = sizes.select(F.col(key).alias("key"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"), F.explode(caps).alias("s"))
    last = F.greatest(F.ceil(F.col("size") / F.col("s.cap")) - 1, F.lit(0))
    pieces = whole.select("key", "size", "s.spec_id", "s.cap", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    pieces = pieces.select("key", "spec_id", "piece", (F.col("piece") * F.col("cap")).alias("first"), F.least(F.col("cap"), F.col("size") - F.col("piece") * F.col("cap")).cast("int").alias("n"))
    # A bar may hold nearly all pieces (full ones of long items), so buckets follow the pieces of the smallest container.
    smallest = min(c for _, c in specs)
    total = sizes.agg(F.sum(F.greatest(F.ceil(F.col(size) / smallest), F.lit(1)))).first()[0] or 0
    buckets = max(1, -(-int(total) // ranked_per_task))
    bucket = F.pmod(F.xxhash64("key", "piece"), F.lit(buckets)).cast("int")
    items = pieces.withColumn("bucket", bucket)
    counted = scratch.cut(items.groupBy("spec_id", "n", "bucket").count())
    bars = counted.groupBy("spec_id", "n").agg(F.sum("count").alias("c")).collect()  # at most the sum of capacity + 1 rows
    plans = {}
    for spec, cap in specs:
        hist = np.zeros(cap + 1, np.int64)
        for r in bars:
            if r.spec_id == spec:
                hist[r.n] = r.c
        plans[spec] = (cap, plan(hist, cap))
    lookup = scratch.spark.sparkContext.broadcast(Lookup(plans))  # follows the number of sizes, not of items
    before = F.sum("count").over(Window.partitionBy("spec_id", "n").orderBy("bucket")) - F.col("count")
    offsets = counted.select("spec_id", "n", "bucket", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("spec_id", "n", "bucket").orderBy("key", "piece"))
    ranked = items.withColumn("at", within - 1).join(offsets, ["spec_id", "n", "bucket"]).withColumn("rank", F.col("at") + F.col("before"))
    kind = dict(pieces.dtypes)["key"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = lookup.value
        for b in batches:
            spec, n, rank = (b.column(k).to_numpy() for k in range(3))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(find(spec, n, rank)), b.column(3), b.column(4), b.column(5), b.column(1)],
                ["spec_id", "container_id", "key", "piece_no", "first_token", "n_tokens"],
            )

    slim = ranked.select("spec_id", "n", "rank", "key", F.col("piece").cast("int").alias("piece_no"), F.col("first").alias("first_token"))
    out = slim.mapInArrow(place, f"spec_id int, container_id bigint, key {kind}, piece_no int, first_token bigint, n_tokens int")
    return out.withColumnRenamed("key", key)
