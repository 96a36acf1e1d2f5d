"""Placement of keys on shards by a permutation-filled lookup table.

Each shard orders the slots of a table of prime size by its own permutation (offset + i * skip, both from
hashes of its name); shards take turns, each claiming the first slot of its order that is free, until the
table is full. So shards own nearly equal numbers of slots, and adding or losing a shard moves few of them.
A shard of weight w takes w turns a round. The table (a few bytes a slot, of a size given beforehand) is
broadcast; a key is placed by one hash and one look-up, in a column expression, with no shuffle.

Defined results: a null key has shard null; equal keys have equal shards; without shards every placement
fails with ValueError; an empty table of keys gives no rows; extra columns are kept, and a column named
like the output is replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import free_names

#: Slots; a prime, over a hundred times the number of shards that are expected.
SLOTS = 65537


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: dict[str, int] | list[str], slots: int = SLOTS) -> np.ndarray:
    """Shard index of each slot; shards in the order of their names."""
    weights = dict(shards) if isinstance(shards, dict) else dict.fromkeys(shards, 1)
    if not weights or min(weights.values()) < 1:
        raise ValueError("shards must be given, each of weight 1 or more")
    if not is_prime(slots):
        raise ValueError(f"{slots} is not prime")
    names = sorted(weights)
    offsets, skips = [], []
    for name in names:
        digest = hashlib.blake2b(name.encode(), digest_size=16).digest()
        offsets.append(int.from_bytes(digest[:8], "little") % slots)
        skips.append(int.from_bytes(digest[8:], "little") % (slots - 1) + 1)
    table, following, filled = np.full(slots, -1, np.int32), [0] * len(names), 0
    while True:
        for i, name in enumerate(names):
            for _ in range(weights[name]):
                at = (offsets[i] + following[i] * skips[i]) % slots
                while table[at] >= 0:
                    following[i] += 1
                    at = (offsets[i] + following[i] * skips[i]) % slots
                table[at] = i
                following[i] += 1
                filled += 1
                if filled == slots:
                    return table


def place(df: DataFrame, key: str | Column, shards: dict[str, int] | list[str], slots: int = SLOTS, to: str = "shard") -> DataFrame:
    """Adds the shard's name. The look-up is a broadcast join with the table of ``slots`` rows."""
    names, (at, slot, name) = sorted(shards), free_names(df, "_at", "_slot", "_name")
    table = lookup_table(shards, slots)
    rows = F.broadcast(df.sparkSession.createDataFrame([(i, names[s]) for i, s in enumerate(table.tolist())], f"`{slot}` int, `{name}` string"))
    column = F.col(key) if isinstance(key, str) else key
    hashed = df.withColumn(at, F.when(column.isNotNull(), F.pmod(F.xxhash64(column), F.lit(slots)).cast("int")))
    return hashed.join(rows, F.col(at) == F.col(slot), "left").withColumn(to, F.col(name)).drop(at, slot, *([name] if name != to else []))
