"""Near-duplicate groups by MinHash with banding, signature verification and exact confirmation.

1. A map over the texts gives each document its set of word shingles (as 64-bit hashes), the set's size
   and fingerprint, and one key for each of 44 bands of 6 minima of universal hashes. A pair of
   similarity 0.8 shares no band with probability (1 - 0.8**6)**44 < 2e-6.
2. Equal sets are one class, carried on by its least doc_id.
3. Classes that share a band's key meet in a bucket. Each class is first tied to the least class it meets;
   these ties, one for each class at most, are confirmed on the full sets, and joined into components.
   So a bucket of thousands of near copies costs a row for each, not a row for each pair.
4. Buckets that still hold several components are opened: pairs across components are compared by size,
   by signature and, if the estimate is within five standard deviations of the threshold, on their sets
   of 32-bit hashes, each pair in the first bucket that it shares. A task that finds a link joins the two
   components for the rest of its bucket, so it gives at most one link a class, not one for each pair;
   blocks of a large bucket meet each other. The links are confirmed on the full sets and joined with
   the components. A pair inside one component needs no test, as it changes nothing. A link that is refused
   may have hidden others of its bucket; then the buckets that are still open are read once more, with the
   full sets in place of the 32-bit hashes, so that nothing is refused.

Words are maximal runs of bytes other than white space, A-Z lower-cased. Fewer words than a shingle
needs are one shingle together. Defined results: null, empty and blank texts have no shingles and no
links; rows with a null doc_id have no links either, and a null component; rows that share a doc_id are
one node; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import map_arrow, stored, text_or_empty, utf8
from loomspark.llm.components import connected_components
from loomspark.llm.rolling import Rolling, chunks, mixed

#: A broadcast of node ids is tried up to this number of rows (8 bytes each), a shuffle beyond.
BROADCAST_ROWS = 400_000
#: Rows of an opened bucket that are compared with each other at a time.
BLOCK = 2048


@dataclass(frozen=True)
class Plan:
    words: int = 5
    percent: int = 80
    bands: int = 44
    rows: int = 6
    print_bits: int = 32

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    @property
    def least_matches(self) -> int:
        """Matching minima of a pair at the threshold, less five standard deviations."""
        p = self.percent / 100
        return int(self.hashes * p - 5 * (self.hashes * p * (1 - p)) ** 0.5)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int):
    """The sorted distinct shingle hashes of each document of a buffer, one array after the other."""
    step = np.array([pow(0xD6E8FEB86659FD93, i + 1, 1 << 64) for i in range(words)], np.uint64)
    for first, last in chunks(offsets):
        part = _LOWER[data[offsets[first] : offsets[last]]]
        at = offsets[first : last + 1] - offsets[first]
        inside = ~_BLANK[part]
        begins, ends = inside.copy(), inside.copy()
        if len(part):
            breaks = np.zeros(len(part) + 1, bool)
            breaks[at] = True
            begins[1:] &= ~inside[:-1] | breaks[1:-1]
            ends[:-1] &= ~inside[1:] | breaks[1:-1]
        starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        hashed = mixed(Rolling(part).raw(starts, stops))
        bounds = np.searchsorted(starts, at)
        n = max(0, len(hashed) - words + 1)
        whole = np.zeros(n, np.uint64)
        for i in range(words):
            whole += hashed[i : i + n] * step[i]
        whole = mixed(whole)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= words:
                yield np.unique(whole[a : b - words + 1])
            elif b > a:
                yield mixed((hashed[a:b] * step[: b - a]).sum(keepdims=True) + np.uint64(b - a))
            else:
                yield hashed[:0]


def _family(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(77))
    return rng.integers(0, 1 << 31, hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, hashes, dtype=np.uint32)


def signature(shingles: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The minimum of a*x + b modulo 2**32 over the set, for each (a, b); the set must not be empty."""
    x, (a, b) = (shingles >> np.uint64(32)).astype(np.uint32), family
    out = None
    for i in range(0, len(x), 512):
        least = (x[i : i + 512, None] * a + b).min(axis=0)
        out = least if out is None else np.minimum(out, least)
    return out


def sketches(docs: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, n_shingles, set_key (fingerprint of the set; null if empty), bands (keys, 8 bytes each)."""

    def run(batches):
        family = _family(plan.hashes)
        step = np.array([pow(0xA24BAED4963EE407, i + 1, 1 << 64) for i in range(plan.rows)], np.uint64)
        band = np.arange(1, plan.bands + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)
        for batch in batches:
            sizes, keys, bands = [], [], []
            for s in shingle_sets(*utf8(batch.column(1)), plan.words):
                sizes.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                bands.append(mixed((signature(s, family).reshape(plan.bands, plan.rows) * step).sum(axis=1) + band).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.binary())], ["doc_id", "n_shingles", "set_key", "bands"])

    return map_arrow(docs.select("doc_id", text_or_empty().alias("text")), run, "doc_id bigint, n_shingles bigint, set_key binary, bands binary")


def _band_rows(classes: DataFrame) -> DataFrame:
    """node, key for every band of every class."""

    def run(batches):
        for batch in batches:
            keys, _ = utf8(batch.column(1))
            keys = keys.view(np.int64)
            nodes = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), len(keys) // max(1, batch.num_rows))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(keys, pa.int64())], ["node", "key"])

    return map_arrow(classes.select("node", "bands"), run, "node bigint, key bigint")


def _sets_of(docs: DataFrame, nodes: DataFrame, plan: Plan) -> DataFrame:
    """node, shingles (sorted hashes), prints (their upper bits), minima (16 bits of each minimum) of the given documents."""

    def run(batches):
        family = _family(plan.hashes)
        for batch in batches:
            found = [(i, s) for i, s in zip(batch.column(0).to_pylist(), shingle_sets(*utf8(batch.column(1)), plan.words), strict=True) if len(s)]
            columns = [[i for i, _ in found], [s.tobytes() for _, s in found], [(s >> np.uint64(64 - plan.print_bits)).astype(np.uint32).tobytes() for _, s in found], [signature(s, family).astype(np.uint16).tobytes() for _, s in found]]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["node", "shingles", "prints", "minima"])

    nodes = F.broadcast(nodes) if nodes.count() <= BROADCAST_ROWS else nodes
    wanted = docs.join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    return map_arrow(wanted.select("doc_id", text_or_empty().alias("text")), run, "node bigint, shingles binary, prints binary, minima binary")


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets that are not empty."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirmed(pairs: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """The pairs (u, v) that are similar on the full sets."""

    def run(batches):
        for batch in batches:
            u, v, su, sv = batch.columns
            good = [_similar(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64), plan.percent) for a, b in zip(su, sv, strict=True)]
            yield pa.RecordBatch.from_arrays([u, v], ["u", "v"]).filter(pa.array(good, pa.bool_()))

    held = sets.select("node", "shingles")
    met = pairs.join(held.select(F.col("node").alias("v"), F.col("shingles").alias("sv")), "v").join(held.select(F.col("node").alias("u"), F.col("shingles").alias("su")), "u")
    return map_arrow(met.select("u", "v", "su", "sv"), run, "u bigint, v bigint")


def _bucket_links(key: int, component: np.ndarray, node: np.ndarray, block: np.ndarray, crossing: bool, minima: np.ndarray, bands: np.ndarray, prints: list[np.ndarray], plan: Plan):
    """Links (greater, less) that join components of one bucket; pairs of one block are left to others if ``crossing``."""
    label = np.unique(component, return_inverse=True)[1].reshape(-1)
    size = np.array(list(map(len, prints)))
    for x in range(len(node) - 1):
        able = label[x + 1 :] != label[x]
        if crossing:
            able &= block[x + 1 :] != block[x]
        able &= 100 * np.minimum(size[x + 1 :], size[x]) >= plan.percent * np.maximum(size[x + 1 :], size[x])
        picked = x + 1 + np.flatnonzero(able)
        if not len(picked):
            continue
        matches = (minima[picked] == minima[x]).sum(axis=1)
        near = matches >= plan.least_matches
        picked, matches = picked[near], matches[near]
        first = (bands[picked] == bands[x]).argmax(axis=1)
        here = bands[x, first] == key
        for z in picked[here][np.argsort(-matches[here], kind="stable")]:
            if label[z] != label[x] and _similar(prints[x], prints[z], plan.percent):
                label[label == label[z]] = label[x]
                yield max(node[x], node[z]), min(node[x], node[z])


def _open_links(members: DataFrame, plan: Plan, kind: type = np.uint32) -> DataFrame:
    """members: key, node, component, bands, prints (of the kind given), minima of buckets with several
    components. Links (u, v) across components; a large bucket is cut into blocks, and each block meets each."""
    counts = members.groupBy("key").agg(F.count("*").alias("n"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("int")
    cut = members.join(counts, "key").withColumn("k", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    names = ["node", "component", "own", "bands", "prints", "minima"]
    dealt = cut.withColumn("other", F.explode(F.expr("sequence(0, k - 1)"))).select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *names)

    def links(group, rows):
        key, i, j = group
        node, component, own = (np.array([r[c] for r in rows], np.int64) for c in range(3))
        bands, minima = (np.frombuffer(b"".join(r[c] for r in rows), kind).reshape(len(rows), -1) for c, kind in ((3, np.int64), (5, np.uint16)))
        found = list(_bucket_links(key, component, node, own, i != j, minima, bands, [np.frombuffer(r[4], kind) for r in rows], plan))
        u, v = zip(*found, strict=True) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    def run(batches):
        now, rows = None, []
        for batch in batches:
            for key, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, i, j) != now:
                    if len(rows) > 1:
                        yield links(now, rows)
                    now, rows = (key, i, j), []
                rows.append(row)
        if len(rows) > 1:
            yield links(now, rows)

    grouped = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return map_arrow(grouped, run, "u bigint, v bigint").distinct()


def near_duplicates(docs: DataFrame, plan: Plan | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs."""
    plan = plan or Plan()
    all_rows = stored(sketches(docs, plan), "sketches")
    usable = all_rows.where("set_key is not null and doc_id is not null")
    classes = stored(usable.groupBy("set_key").agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("x")).select("set_key", F.col("x.doc_id").alias("node"), F.col("x.n_shingles").alias("size"), "x.bands"), "classes")

    rows = _band_rows(classes)
    shared = stored(rows.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last").select("key", "hub"), "buckets")
    members = stored(rows.join(shared, "key"), "members")
    sets = stored(_sets_of(docs, members.select("node").distinct(), plan), "sets")

    first = members.where("hub <> node").groupBy("node").agg(F.min("hub").alias("v")).select(F.col("node").alias("u"), "v")
    links = stored(_confirmed(first, sets, plan), "links")
    found = stored(connected_components(links), "components")

    def opened(found: DataFrame, prints: str) -> DataFrame:
        """The members of buckets that hold several components."""
        labelled = members.select("key", "node").join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
        still = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
        kept = sets.select("node", F.col(prints).alias("prints"), "minima")
        return labelled.join(still, "key", "left_semi").join(kept, "node").join(classes.select("node", "bands"), "node")

    def joined(found: DataFrame, more: DataFrame) -> DataFrame:
        return stored(connected_components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more)), "components")

    pairs = stored(_open_links(opened(found, "prints"), plan), "pairs")
    more = stored(_confirmed(pairs, sets, plan), "links")
    found = joined(found, more)
    if pairs.count() > more.count():
        found = joined(found, stored(_open_links(opened(found, "shingles"), plan, np.uint64), "pairs"))

    labels = classes.select("set_key", "node").join(found, "node", "left").select("set_key", F.coalesce("component", "node").alias("component_id"))
    labels = stored(labels, "labels")
    linked = usable.select("doc_id", "n_shingles", "set_key").join(labels, "set_key")
    alone = all_rows.where("set_key is null or doc_id is null").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")]
    return linked.select(*columns).unionByName(alone.select(*columns))
