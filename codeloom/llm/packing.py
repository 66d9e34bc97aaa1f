"""Problem 7: filling containers of fixed capacity.

Bounded-space online best fit: at most ``OPEN_BINS`` containers are open; an item goes into the open container with the least room
that still takes it, found in a bitset keyed by free space; if none takes it a new one opens, and when too many are open
the fullest closes.  Only ids and sizes are packed, never texts.  Items are dealt over shards by a hash, so that every shard closes
about ``BINS_A_SHARD`` containers, or holds about ``ITEMS_A_SHARD`` items if these are tiny or empty: what its last open containers leave
unused is then a small share, at any scale, and the number of items in one task stays bounded.  An item above the capacity is split into full containers and a rest that is packed like any item.

A null text is in no container; an empty text is an item of size 0.  Rows delivered twice are packed once; the result depends on ids
and sizes only, not on the order of rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

OPEN_BINS = 64
BINS_A_SHARD = 4_000
ITEMS_A_SHARD = 1_000_000
#: Profiles are a small table of settings; each item is packed once per profile.
MAX_PROFILES = 1_000


def pack(sizes: list[int], capacity: int, open_bins: int = OPEN_BINS) -> list[int]:
    """The container of each item, in order of arrival; sizes are at most the capacity."""
    free_mask, by_free, count, opened, out = 0, {}, 0, 0, []
    for size in sizes:
        fitting = free_mask >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            bins = by_free[room]
            number = bins.pop()
            if not bins:
                free_mask &= ~(1 << room)
            room -= size
        else:
            if opened >= open_bins:
                fullest = (free_mask & -free_mask).bit_length() - 1
                bins = by_free[fullest]
                bins.pop()
                if not bins:
                    free_mask &= ~(1 << fullest)
                opened -= 1
            number, room = count, capacity - size
            count += 1
            opened += 1
        out.append(number)
        if room > 0:
            by_free.setdefault(room, []).append(number)
            free_mask |= 1 << room
        else:
            opened -= 1
    return out


def containers(sizes: DataFrame, profiles: DataFrame, key: str = "doc_id", open_bins: int = OPEN_BINS) -> DataFrame:
    """(profile, container, doc_id, part, tokens): where each text of sizes (key, n_tokens) goes, for each profile.

    A container's number holds its shard in the upper digits; part counts the pieces of a split text from 0.
    """
    items = sizes.where(F.col("n_tokens").isNotNull()).groupBy(key).agg(F.max("n_tokens").alias("n_tokens"))
    items = common.kept(items)  # ids and sizes; counted once for the shards, read once for the packing
    whole_size = items.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("total"), F.count("*").alias("n")).first()
    caps = profiles.where(F.col("capacity_tokens") > 0).groupBy("profile").agg(F.max("capacity_tokens").cast("long").alias("capacity")).orderBy("profile").limit(MAX_PROFILES + 1).collect()
    if len(caps) > MAX_PROFILES:
        raise ValueError(f"more than {MAX_PROFILES} container profiles")
    shards = {c.profile: max(1, whole_size.total // (c.capacity * BINS_A_SHARD), whole_size.n // ITEMS_A_SHARD) for c in caps}
    each = [F.struct(F.lit(c.profile).alias("profile"), F.lit(c.capacity).cast("long").alias("capacity"), F.lit(shards[c.profile]).cast("long").alias("shards")) for c in caps]
    rows = items.select(key, "n_tokens", F.explode(F.array(*each) if each else F.array().cast("array<struct<profile:string,capacity:bigint,shards:bigint>>")).alias("c")).select(key, "n_tokens", "c.*")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(key), F.col("shards")))
    full = F.when(F.col("n_tokens") > F.col("capacity"), F.floor((F.col("n_tokens") - 1) / F.col("capacity"))).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("full", full).withColumn("rest", F.col("n_tokens") - F.col("full") * F.col("capacity"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        number = pack(pdf.rest.astype(int).tolist(), int(pdf.capacity.iloc[0]), open_bins)
        return pd.DataFrame({"profile": pdf.profile, "container": [int(pdf.shard.iloc[0]) * 10_000_000 + n for n in number], key: pdf[key], "part": pdf.full, "tokens": pdf.rest})

    packed = rows.select("profile", "shard", "capacity", key, "full", "rest").groupBy("profile", "shard").applyInPandas(fill, f"profile string, container long, {key} long, part long, tokens long")
    whole = rows.where(F.col("full") > 0).select("profile", key, "capacity", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("part"))
    # full containers of split texts are numbered from the text's hash, below zero
    alone = whole.select("profile", (-(F.shiftrightunsigned(F.xxhash64(F.col(key), F.col("part")), 1)) - 1).alias("container"), key, "part", F.col("capacity").alias("tokens"))
    return packed.unionByName(alone)


def fill_rates(placed: DataFrame, profiles: DataFrame) -> DataFrame:
    """(profile, containers, tokens, fill_rate) of a packing."""
    used = placed.groupBy("profile").agg(F.countDistinct("container").alias("containers"), F.sum("tokens").alias("tokens"))
    caps = profiles.groupBy("profile").agg(F.max("capacity_tokens").alias("capacity"))
    return used.join(caps, "profile").select("profile", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("fill_rate"))
