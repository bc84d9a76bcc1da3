"""Texts of varying size put into containers of fixed capacity, with as little unused space as possible.

The global histogram of sizes has at most as many rows as the capacity, so it fits the driver whatever the number of texts.
Dynamic programming over it chooses bucket boundaries that minimise padding (the space between a size and its bucket's boundary). Batches
within the token budget then form: by default a container opens with texts of the longest bucket left and is topped up from shorter
buckets; with ``across=False`` from its own bucket only. A batch is planned once, as numbers of texts by bucket,
and repeated as long as texts last: the plan is small too. Each text finds its container from its rank inside its bucket.
"""

from __future__ import annotations

import pickle
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import ship

#: Bounds of what the driver plans: capacity, number of capacities, buckets.
MAX_CAPACITY, MAX_PACKS, N_BUCKETS = 1 << 16, 1000, 1024
#: Texts of a bucket that are ranked in one task.
RANKED_TOGETHER = 100_000


def length_buckets(counts: np.ndarray, n_buckets: int) -> np.ndarray:
    """Upper boundaries, ascending, of the `n_buckets` buckets of least padding; ``counts[s]`` texts have the size s, s > 0.

    Dynamic programming: the best split of sizes up to s into k buckets extends the best one into k - 1. The best last cut moves
    up with s, so each layer is solved by halving, all cuts of one depth at a time.
    """
    sizes = np.flatnonzero(counts)
    sizes = sizes[sizes > 0]
    m = len(sizes)
    if m <= n_buckets:
        return sizes
    n = np.r_[0, np.cumsum(counts[sizes])].astype(float)
    mass = np.r_[0, np.cumsum(counts[sizes] * sizes)].astype(float)

    def padding(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of one bucket for the sizes number a (excluded) to b (included)."""
        return sizes[b - 1] * (n[b] - n[a]) - (mass[b] - mass[a])

    best = np.full(m + 1, np.inf)
    best[1:] = padding(np.zeros(m, int), np.arange(1, m + 1))
    best[0] = 0
    cuts = [np.zeros(m + 1, np.int32)]
    for _ in range(1, n_buckets):
        new, cut = np.full(m + 1, np.inf), np.zeros(m + 1, int)
        new[0] = 0
        jobs = np.array([[1, m, 0, m - 1]])  # ends from, to; cuts from, to
        while len(jobs):
            lo, hi, c0, c1 = jobs.T
            mid = (lo + hi) // 2
            upper = np.minimum(c1, mid - 1)
            width = upper - c0 + 1
            starts = np.r_[0, np.cumsum(width)[:-1]]
            at = np.arange(int(width.sum())) - np.repeat(starts, width) + np.repeat(c0, width)
            ends = np.repeat(mid, width)
            cost = best[at] + padding(at, ends)
            least = np.minimum.reduceat(cost, starts)
            first = np.flatnonzero(cost == np.repeat(least, width))
            owner = np.repeat(np.arange(len(jobs)), width)[first]
            where = first[np.unique(owner, return_index=True)[1]]
            new[mid], cut[mid] = least, at[where]
            left = np.stack([lo, mid - 1, c0, at[where]], 1)[mid - 1 >= lo]
            right = np.stack([mid + 1, hi, at[where], c1], 1)[hi >= mid + 1]
            jobs = np.concatenate([left, right])
        cuts.append(cut.astype(np.int32))
        best = new
    out, e = [], m
    for cut in reversed(cuts):
        if e <= 0:
            break
        out.append(int(sizes[e - 1]))
        e = int(cut[e])
    return np.array(out[::-1])


@dataclass
class Plan:
    """How the texts of each bucket go to containers: `slots[b]` holds, by rank, first rank, first container and texts a container takes."""

    capacity: int
    bounds: np.ndarray
    slots: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    n_containers: int
    salts: np.ndarray

    def bucket(self, size: np.ndarray) -> np.ndarray:
        """0 for sizes of 0, else 1 and more."""
        return np.where(size > 0, np.searchsorted(self.bounds, size) + 1, 0)

    def container(self, bucket: np.ndarray, rank: np.ndarray) -> np.ndarray:
        out = rank % max(1, self.n_containers)  # texts without tokens need no space: they go round
        for b in np.unique(bucket):
            if b:
                first, base, each = self.slots[b - 1]
                at = bucket == b
                i = np.searchsorted(first, rank[at], side="right") - 1
                out[at] = base[i] + (rank[at] - first[i]) // each[i]
        return out


def plan(counts: np.ndarray, capacity: int, n_buckets: int = N_BUCKETS, across: bool = True) -> Plan:
    """A plan for ``counts[s]`` texts of size s."""
    bounds = length_buckets(counts, n_buckets)
    left = np.zeros(len(bounds), np.int64)
    sizes = np.flatnonzero(counts)
    sizes = sizes[sizes > 0]
    np.add.at(left, np.searchsorted(bounds, sizes), counts[sizes].astype(np.int64))
    salts = np.r_[int(counts[0]), left] // RANKED_TOGETHER + 1
    slots: list[tuple[list[int], list[int], list[int]]] = [([], [], []) for _ in bounds]
    done = np.zeros(len(bounds), np.int64)
    containers = 0
    top = len(bounds) - 1
    while top >= 0:
        if not left[top]:
            top -= 1
            continue
        room, batch, i = capacity, [], top
        while i >= 0 and room > 0:
            i = min(i, int(np.searchsorted(bounds, room, side="right")) - 1)
            while i >= 0 and not left[i]:
                i -= 1
            if i < 0:
                break
            take = int(min(room // bounds[i], left[i]))
            batch.append((i, take))
            room -= take * int(bounds[i])
            i = i - 1 if across else -1
        repeat = int(min(left[i] // take for i, take in batch))
        for i, take in batch:
            first, base, each = slots[i]
            first.append(int(done[i])), base.append(containers), each.append(take)
            done[i] += repeat * take
            left[i] -= repeat * take
        containers += repeat
    return Plan(capacity, bounds, [tuple(np.array(x, np.int64) for x in s) for s in slots], containers, salts)


def pack(sizes: DataFrame, key: str, packs: Sequence[tuple[str, int]], *, n_buckets: int = N_BUCKETS, across: bool = True) -> DataFrame:
    """One row per pack and piece: pack_id, `key`, piece_no, start_token, n_tokens, container_id.

    ``sizes`` has `key` and n_tokens, and is read several times, so it should be a written table. ``packs`` are (name, capacity); a capacity that is
    null or not positive is an error. Only a text larger than the capacity is split: into pieces of the capacity and a last one for the rest.
    A text without tokens is one piece of size 0. Containers of a pack are numbered from 0, and none exceeds its capacity. Rows with a null key are packed like others.
    """
    spark = sizes.sparkSession
    ship(spark)
    if len(packs) > MAX_PACKS or any(not c or c <= 0 or c > MAX_CAPACITY for _, c in packs):
        raise ValueError(f"at most {MAX_PACKS} packs, of a capacity from 1 to {MAX_CAPACITY}")
    if not packs:
        return spark.createDataFrame([], f"pack_id string, `{key}` {sizes.schema[key].dataType.simpleString()}, piece_no bigint, start_token bigint, n_tokens bigint, container_id bigint")
    rows = sizes.select(F.col(key).alias("key"), F.coalesce(F.col("n_tokens"), F.lit(0)).cast("bigint").alias("size"))
    # Sizes occur again and again: the histogram of sizes says all about full pieces and rests.
    by_size = rows.groupBy("size").count()
    caps = F.array(*[F.struct(F.lit(i).alias("pack"), F.lit(int(c)).cast("bigint").alias("cap")) for i, (_, c) in enumerate(packs)])
    each = by_size.select("size", "count", F.explode(caps).alias("p")).select("size", "count", "p.pack", "p.cap")
    rest = F.pmod("size", "cap")
    parts = F.filter(F.array(F.struct(F.col("cap").alias("len"), (F.floor(F.col("size") / F.col("cap")) * F.col("count")).cast("bigint").alias("n")), F.struct(rest.alias("len"), F.when((rest > 0) | (F.col("size") == 0), F.col("count")).otherwise(F.lit(0)).alias("n"))), lambda x: x["n"] > 0)
    # A row per pack and size up to the capacity at most: each pack is planned in a task of its own.
    histogram = each.select("pack", F.explode(parts).alias("x")).groupBy("pack", F.col("x.len").alias("len")).agg(F.sum("x.n").alias("n"))
    capacities = [int(c) for _, c in packs]

    def planned(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        capacity = capacities[key[0]]
        counts = np.zeros(capacity + 1, np.int64)
        counts[f["len"].to_numpy()] = f["n"].to_numpy()
        return pd.DataFrame({"pack": [key[0]], "plan": [pickle.dumps(plan(counts, capacity, n_buckets, across))]})

    made = {r["pack"]: pickle.loads(bytes(r["plan"])) for r in histogram.groupBy("pack").applyInPandas(planned, "pack int, plan binary").collect()}
    plans = [made[i] if i in made else plan(np.zeros(c + 1, np.int64), c, n_buckets, across) for i, c in enumerate(capacities)]
    shared = spark.sparkContext.broadcast(plans)

    def bucket_of(pack: pd.Series, size: pd.Series) -> pd.DataFrame:
        p, s = pack.to_numpy(), size.to_numpy()
        b, salt = np.zeros(len(p), np.int64), np.ones(len(p), np.int64)
        for i in np.unique(p):
            at = p == i
            b[at] = shared.value[i].bucket(s[at])
            salt[at] = shared.value[i].salts[b[at]]
        return pd.DataFrame({"bucket": b, "salts": salt})

    def container_of(pack: pd.Series, bucket: pd.Series, rank: pd.Series) -> pd.Series:
        p, b, r = pack.to_numpy(), bucket.to_numpy(), rank.to_numpy()
        out = np.zeros(len(p), np.int64)
        for i in np.unique(p):
            at = p == i
            out[at] = shared.value[i].container(b[at], r[at])
        return pd.Series(out)

    pieces = rows.select("key", "size", F.explode(caps).alias("p")).select("key", "size", "p.pack", "p.cap")
    last = F.greatest(F.ceil(F.col("size") / F.col("cap")) - 1, F.lit(0))
    pieces = pieces.select("key", "pack", "cap", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))).alias("piece_no"))
    pieces = pieces.select("key", "pack", "piece_no", (F.col("piece_no") * F.col("cap")).alias("start_token"), F.least(F.col("cap"), F.col("size") - F.col("piece_no") * F.col("cap")).alias("n"))
    placed = pieces.withColumn("b", F.pandas_udf(bucket_of, "bucket bigint, salts bigint")("pack", "n"))
    salt = F.pmod(F.xxhash64("key", "piece_no", "start_token"), F.col("b.salts"))
    placed = placed.select("key", "pack", "piece_no", "start_token", "n", F.col("b.bucket").alias("bucket"), salt.alias("salt"))
    # Rank in the bucket: the rank in a salted part of it, after the parts before. No part holds much more than RANKED_TOGETHER pieces.
    spot = ["pack", "bucket", "salt"]
    before = Window.partitionBy("pack", "bucket").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(*spot).count().select(*spot, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    ranked = placed.withColumn("nth", F.row_number().over(Window.partitionBy(*spot).orderBy("key", "piece_no")) - 1).join(offsets, spot)
    names = F.array(*[F.lit(n) for n, _ in packs])
    return ranked.select(
        F.get(names, F.col("pack")).alias("pack_id"), F.col("key").alias(key), "piece_no", "start_token", F.col("n").alias("n_tokens"),
        F.pandas_udf(container_of, "bigint")("pack", "bucket", (F.col("nth") + F.col("before")).cast("bigint")).alias("container_id"),
    )


def containers(pieces: DataFrame, packs: Sequence[tuple[str, int]]) -> DataFrame:
    """One row per container: pack_id, container_id, n_pieces, used_tokens, capacity_tokens, fill (share of the capacity that is used)."""
    capacity = F.element_at(F.create_map(*[x for n, c in packs for x in (F.lit(n), F.lit(int(c)).cast("bigint"))]), F.col("pack_id")) if packs else F.lit(None).cast("bigint")
    out = pieces.groupBy("pack_id", "container_id").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum("n_tokens").alias("used_tokens"))
    return out.withColumn("capacity_tokens", capacity).withColumn("fill", F.col("used_tokens") / F.col("capacity_tokens"))
