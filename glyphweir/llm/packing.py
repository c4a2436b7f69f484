"""Containers of fixed capacity filled with items of varying length.

Bounded-space best fit: items come one after the other; a bitset has a bit for each free space that some open container
has, so the container that an item fits best is the lowest bit at or above its size. Only OPEN containers are open at a
time; to open another one, the fullest closes.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphweir.session import checked_broadcast

#: Open containers of a packer, and items that one packer gets.
OPEN = 128
ITEMS_PER_PACKER = 50_000
#: The table of capacities is fixed (three rows); a packer fills those of so many profiles at once.
PROFILE_BOUND, PROFILES_AT_ONCE = 1_000, 8


def pack(sizes: list[int], capacity: int, limit: int = OPEN) -> list[list[tuple[int, int, int]]]:
    """For each item its parts (container, start, length); only an item above the capacity has several parts."""
    free_bits = 0
    with_free: dict[int, list[int]] = defaultdict(list)
    n_open = n_containers = 0
    placed: list[list[tuple[int, int, int]]] = []
    for size in sizes:
        parts: list[tuple[int, int, int]] = []
        while size > capacity:  # only such an item is split: full containers of its own, then the rest
            parts.append((n_containers, 0, capacity))
            n_containers += 1
            size -= capacity
        fitting = free_bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            container = with_free[free].pop()
            if not with_free[free]:
                free_bits ^= 1 << free
        else:
            if n_open >= limit:  # the fullest closes
                least = (free_bits & -free_bits).bit_length() - 1
                with_free[least].pop()
                if not with_free[least]:
                    free_bits ^= 1 << least
                n_open -= 1
            container, free = n_containers, capacity
            n_containers += 1
            n_open += 1
        parts.append((container, capacity - free, size))
        placed.append(parts)
        left = free - size
        if left:
            with_free[left].append(container)
            free_bits |= 1 << left
        else:
            n_open -= 1
    return placed


def fill_containers(items: DataFrame, profiles: DataFrame, key: str, size: str, n_items: int | None = None) -> DataFrame:
    """(profile_id, container_id, key, part, start, length) of all items in the containers of every profile.

    ``profiles`` has profile_id and capacity, both unique and small; those below 1 or null have no containers. An item
    larger than the capacity fills containers of its own and leaves the rest as part of another; no other item is split.
    An item of size 0 or null takes no room in some container. Repeated keys are items of their own.

    Items are dealt to packers by hash, about ITEMS_PER_PACKER each, whose number follows the number of items (``n_items``
    where the caller knows it without making them): packing is parallel and a packer's memory bounded. Each item goes to its
    packer once, for all profiles. Each packer leaves at most OPEN containers that could have been fuller.
    """
    allowed = profiles.where("profile_id is not null and capacity > 0").select("profile_id", "capacity").distinct().limit(PROFILE_BOUND + 1).collect()
    if len(allowed) > PROFILE_BOUND:
        raise ValueError("too many profiles for a small table")
    own = sorted((r.profile_id, r.capacity) for r in allowed)
    packers = max(1, -(-(items.count() if n_items is None else n_items) // ITEMS_PER_PACKER))
    kind = items.schema[key].dataType.simpleString()
    turns = F.explode(F.array(*map(F.lit, range(0, len(own), PROFILES_AT_ONCE))) if own else F.expr("cast(array() as array<int>)"))
    dealt = items.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{size}`"), F.lit(0)).alias("size"), F.pmod(F.xxhash64(f"`{key}`"), F.lit(packers)).alias("packer"), turns.alias("turn"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("size", "ascending")])
        packer, turn = (table.column(c)[0].as_py() for c in ("packer", "turn"))
        sizes, keys = table.column("size").to_pylist(), table.column("key")
        out = []
        for profile, capacity in own[turn : turn + PROFILES_AT_ONCE]:
            placed = pack(sizes, capacity)
            rows = np.repeat(np.arange(len(placed)), [len(p) for p in placed])
            flat = np.asarray([part for parts in placed for part in parts], np.int64).reshape(-1, 3)
            number = np.asarray([k for parts in placed for k in range(len(parts))], np.int32)
            columns = [pa.array(np.full(len(flat), profile, np.int32)), pa.array((packer << 40) + flat[:, 0]), keys.take(pa.array(rows)).combine_chunks(), pa.array(number), pa.array(flat[:, 1].astype(np.int32)), pa.array(flat[:, 2].astype(np.int32))]
            out.append(pa.Table.from_arrays(columns, names=["profile_id", "container_id", "key", "part", "start", "length"]))
        return pa.concat_tables(out)

    packed = dealt.groupBy("packer", "turn").applyInArrow(run, f"profile_id int, container_id bigint, key {kind}, part int, start int, length int")
    return packed.withColumnRenamed("key", key)


def fill_report(containers: DataFrame, profiles: DataFrame) -> DataFrame:
    """Per profile the containers, items and parts, tokens, and the share of all room that is used."""
    used = containers.groupBy("profile_id").agg(F.count_distinct("container_id").alias("n_containers"), F.count("*").alias("n_parts"), F.sum("length").alias("n_tokens"))
    room = F.col("n_containers") * F.col("capacity")
    return used.join(checked_broadcast(profiles.select("profile_id", "capacity"), PROFILE_BOUND), "profile_id").withColumn("used_share", F.round(F.col("n_tokens") / room, 4))
