"""Records of several sources mixed so that each makes up its target share of the tokens, none used more often than allowed.

Temperature mixing: source token shares are raised to an exponent and normalised, and the exponent is bisected. Here the targets are shares of their own, so what is
raised is how far each target lies from the natural share: exponent 0 gives the natural shares, 1 the targets, and with even targets what lies between is the plain
temperature (natural shares to the power 1 - exponent). The exponent is the largest for which no source exceeds its repetitions. With
``keep="entropy"`` plain natural shares are raised, to the exponent whose weights are as even as the targets. Both give mixes of the wanted size, as far as all sources
together allow it; ``keep="shares"`` holds the targets instead and gives up size.

The weights are realised as budgeted block permutations: a source's texts are all used as often as its budget allows, and the
rest of the budget takes the first blocks of a permutation by hash, of which the last is opened until the budget is met.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a table of targets; what comes from it is small by this bound.
MAX_TARGETS = 10_000
#: Blocks of a permutation, at each of two levels, at most; and texts of a block, as long as that many blocks suffice.
BLOCKS, BLOCK_TEXTS = 4096, 2000


@dataclass(frozen=True)
class Target:
    mix: str
    source: str
    share: float
    repeats: int
    size_factor: float


def temperature(shares: list[float], exponent: float) -> list[float]:
    """Shares raised to an exponent and normalised; a share of 0 stays 0."""
    raised = [s**exponent if s > 0 else 0.0 for s in shares]
    total = sum(raised)
    return [r / total if total else 0.0 for r in raised]


def entropy(shares: Iterable[float]) -> float:
    return -sum(s * math.log(s) for s in shares if s > 0)


def exponent_for_entropy(shares: list[float], target: float, steps: int = 60) -> float:
    """The exponent in [0, 16] whose weights have an entropy nearest to `target`: entropy falls as the exponent grows."""
    lo, hi = 0.0, 16.0
    for _ in range(steps):
        mid = (lo + hi) / 2
        if entropy(temperature(shares, mid)) > target:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def between(natural: list[float], targets: list[float], exponent: float) -> list[float]:
    """Weights from the natural shares (exponent 0) to the targets (1): each target over natural share raised to the exponent."""
    raised = [n * (t / n) ** exponent if n > 0 and t > 0 else 0.0 for n, t in zip(natural, targets)]
    total = sum(raised)
    return [r / total if total else 0.0 for r in raised]


def _bisect(fits, good: float, bad: float) -> float:
    """The exponent nearest to `bad` that fits; `good` does."""
    for _ in range(60):
        mid = (good + bad) / 2
        good, bad = (mid, bad) if fits(mid) else (good, mid)
    return good


def filled(weights: list[float], caps: list[float], size: float) -> list[float]:
    """Tokens by weight that add up to `size`, none above its cap: what a source can't give the others give, by their weights. `size` is no more than all caps."""
    out, open_ = [0.0] * len(caps), [i for i, w in enumerate(weights) if w > 0]
    left = size
    while open_ and left > 0:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total >= caps[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = caps[i]
        left = size - sum(out)
        open_ = [i for i in open_ if i not in full]
    return out


def budgets(targets: list[Target], tokens: dict[str, int], all_tokens: int, keep: str = "size") -> tuple[list[tuple[Target, float, float]], float]:
    """((target, weight, tokens to take) of each source of one mix, exponent).

    Sources without tokens get nothing, and the others share by their targets. ``keep="size"`` holds the size and moves the weights from the targets towards the natural shares,
    as little as the repetitions ask for; where even the natural shares need too many, each such source gives all it may and the others the rest. ``keep="entropy"`` raises the natural
    shares to the exponent at which their entropy is that of the targets, and from there towards 1 as the repetitions ask. ``keep="shares"`` holds the target shares and lowers
    the size of the mix until every source suffices.
    """
    if keep not in ("shares", "size", "entropy"):
        raise ValueError("keep is size, entropy or shares")
    caps = [float(t.repeats * tokens.get(t.source, 0)) for t in targets]
    live = [t.share if c > 0 else 0.0 for t, c in zip(targets, caps)]
    total = sum(live)
    if not total:
        return [(t, 0.0, 0.0) for t in targets], 1.0
    goal = [x / total for x in live]
    wanted = max(t.size_factor for t in targets) * all_tokens
    if keep == "shares":
        size = min([wanted, *[c / g for c, g in zip(caps, goal) if g > 0]])
        return [(t, g, g * size) for t, g in zip(targets, goal)], 1.0
    here = sum(tokens.get(t.source, 0) for t, g in zip(targets, goal) if g > 0)
    natural = [tokens.get(t.source, 0) / here if g > 0 else 0.0 for t, g in zip(targets, goal)]
    size = min(wanted, sum(c for c, g in zip(caps, goal) if g > 0))
    if keep == "size":
        shape, start = lambda e: between(natural, goal, e), 1.0
        plain = 0.0
    else:
        shape, start = lambda e: temperature(natural, e), exponent_for_entropy(natural, entropy(goal))
        plain = 1.0
    fits = lambda e: all(x * size <= c * (1 + 1e-12) for x, c in zip(shape(e), caps))
    exponent = start if fits(start) else _bisect(fits, plain, start) if fits(plain) else plain
    weights = shape(exponent)
    return [(t, w, x) for t, w, x in zip(targets, weights, filled(weights, caps, size))], exponent


def read_targets(table: DataFrame) -> list[Target]:
    """Targets of a table with mix_id, source, target_share, max_repeats, size_factor.

    Null shares and sizes count as 0, null repeats as 1; rows of the same mix and source add their shares and take the larger repeats.
    """
    rows = table.select("mix_id", "source", "target_share", "max_repeats", "size_factor").limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    out: dict[tuple[str, str], Target] = {}
    for r in rows:
        t = Target(r[0], r[1], max(0.0, r[2] or 0.0), max(0, 1 if r[3] is None else r[3]), max(0.0, r[4] or 0.0))
        k = (t.mix, t.source)
        out[k] = Target(*k, out[k].share + t.share, max(out[k].repeats, t.repeats), max(out[k].size_factor, t.size_factor)) if k in out else t
    return sorted(out.values(), key=lambda t: (str(t.mix), str(t.source)))


def _open(budget_column: str):
    def run(key, f: pd.DataFrame) -> pd.DataFrame:
        """Of the last block: texts in the order of the permutation, each that still fits."""
        room = f["room"].iloc[0]
        f = f.sort_values(["u", "key"], kind="stable")
        chosen = []
        for size in f["n_tokens"]:
            take = size <= room
            chosen.append(take)
            room -= size * take
        return f.loc[chosen, ["pair", "key"]]

    return run


def mix(sizes: DataFrame, key: str, targets: list[Target], *, keep: str = "size") -> tuple[DataFrame, DataFrame]:
    """(chosen, plan). Chosen: mix_id, `key`, source, n_uses, n_tokens, for every text used at least once. Plan: mix_id, source, target_share, exponent (of the mix), weight, wanted_tokens (of the mix), planned_tokens (of the source).

    ``sizes`` has `key`, source and n_tokens, and is read several times, so it should be a written table; `key` identifies a text. Texts without tokens are never chosen. A null source matches no target.
    A source is short of its budget by less than the smallest unused text of the block it ends in.
    """
    spark = sizes.sparkSession
    rows = sizes.select(F.col(key).alias("key"), "source", "n_tokens").filter("n_tokens > 0")
    named = sorted({t.source for t in targets if t.source is not None})
    # A row per named source at most, and one for the rest: bounded by the table of targets.
    label = F.when(F.col("source").isin(named), F.col("source")) if named else F.lit(None).cast("string")
    stats = rows.groupBy(label.alias("source")).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("texts")).collect()
    tokens = {r["source"]: r["tokens"] for r in stats if r["source"] is not None}
    texts = {r["source"]: r["texts"] for r in stats if r["source"] is not None}
    all_tokens = sum(r["tokens"] for r in stats)
    plan: list[tuple] = []
    for name in dict.fromkeys(t.mix for t in targets):
        own = [t for t in targets if t.mix == name]
        wanted = max(t.size_factor for t in own) * all_tokens
        shared, exponent = budgets(own, tokens, all_tokens, keep)
        for t, weight, take in shared:
            have = tokens.get(t.source, 0)
            full = min(t.repeats, int(take / have + 1e-9)) if have else 0
            room = take - full * have if full < t.repeats else 0.0
            n1 = min(BLOCKS, texts.get(t.source, 0) // BLOCK_TEXTS + 1)
            n2 = min(BLOCKS, texts.get(t.source, 0) // n1 // BLOCK_TEXTS + 1)
            plan.append((len(plan), t.mix, t.source, t.share, exponent, weight, wanted, take, full, float(max(0.0, room)), n1, n2))
    schema = "pair int, mix_id string, source string, target_share double, exponent double, weight double, wanted_tokens double, planned_tokens double, full int, room double, n1 long, n2 long"
    planned = spark.createDataFrame(plan, schema)
    # MAX_TARGETS rows at most.
    r = rows.join(F.broadcast(planned.filter("planned_tokens > 0").select("pair", "mix_id", "source", "full", "room", "n1", "n2")), "source")
    u = F.xxhash64("key", "mix_id")
    r = r.withColumn("u", u).withColumn("b1", F.pmod(F.shiftright("u", 40), F.col("n1"))).withColumn("b2", F.pmod(F.shiftright("u", 20), F.col("n2")))
    kind = rows.schema["key"].dataType

    def last_block(part: DataFrame, block: str) -> DataFrame:
        """(pair, block, room): the block in which the budget of each pair ends, and what is left for it."""
        # A group of the window has BLOCKS rows at most.
        so_far = Window.partitionBy("pair").orderBy(block).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = part.groupBy("pair", block, "room").agg(F.sum("n_tokens").alias("s")).withColumn("upto", F.sum("s").over(so_far))
        return sums.filter((F.col("upto") > F.col("room")) & (F.col("upto") - F.col("s") <= F.col("room"))).select("pair", F.col(block).alias(f"{block}_last"), (F.col("room") - F.col("upto") + F.col("s")).alias(f"{block}_room"))

    partial = r.filter("room > 0")
    one = last_block(partial, "b1")
    inside = partial.join(F.broadcast(one), "pair").filter("b1 = b1_last").withColumn("room", F.col("b1_room"))
    two = last_block(inside.select("pair", "b2", "n_tokens", "room"), "b2")
    ends = one.join(two, "pair", "left")
    opened = inside.join(F.broadcast(two), "pair").filter("b2 = b2_last").select("pair", "key", "n_tokens", "u", F.col("b2_room").alias("room"))
    extra = opened.groupBy("pair").applyInPandas(_open("room"), T.StructType().add("pair", "integer").add("key", kind)).withColumn("opened", F.lit(1))
    marked = r.join(F.broadcast(ends), "pair", "left").join(extra, ["pair", "key"], "left")
    # Whole blocks before the last one; in that one, whole blocks of the second level, and the opened texts. Without a last block the rest holds all.
    first = F.col("b1_last").isNull() | (F.col("b1") < F.col("b1_last")) | ((F.col("b1") == F.col("b1_last")) & (F.col("b2_last").isNull() | (F.col("b2") < F.col("b2_last"))))
    uses = F.col("full") + F.when(F.col("room") <= 0, 0).when(first | F.col("opened").isNotNull(), 1).otherwise(0)
    chosen = marked.select("mix_id", F.col("key").alias(key), "source", uses.alias("n_uses"), "n_tokens").filter("n_uses > 0")
    return chosen, planned.select("mix_id", "source", "target_share", "exponent", "weight", "wanted_tokens", "planned_tokens")


def shares(chosen: DataFrame, plan: DataFrame) -> DataFrame:
    """One row per mix and source: target and actual share, texts, uses, tokens, and the tokens the mix has and wanted."""
    by = chosen.groupBy("mix_id", "source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_uses").alias("n_uses"), F.sum(F.col("n_uses") * F.col("n_tokens")).alias("tokens"), F.max("n_uses").alias("most_uses"))
    all_ = plan.join(by, ["mix_id", "source"], "left").na.fill(0, ["n_documents", "n_uses", "tokens", "most_uses"])
    mix_tokens = F.sum("tokens").over(Window.partitionBy("mix_id"))
    return all_.withColumn("mix_tokens", mix_tokens).withColumn("actual_share", F.when(F.col("mix_tokens") > 0, F.col("tokens") / F.col("mix_tokens")).otherwise(0.0))
