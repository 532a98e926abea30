"""N-gram Jaccard join by a size-aware heavy-light split (operator 1).

A document is its set of shingles.  Those that no other document has come
first, then the others by how many blocks of the corpus hold them.  A partner at similarity s shares at least ceil(s * n) of the
n shingles, so two partners share one of their first n - ceil(s * n) + 1
shingles, and two of their first n - ceil(s * n) + 2.

Small sets are *light*: every pair of shingles of that longer prefix is a
key, and light partners share a key.  Large sets are *heavy*: the inverted
lists of the single prefix shingles are scanned; light sets near the boundary
stand in these lists too.  The boundary is the size up to which enumerating
costs no more rows than scanning lists of the length that this corpus has.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import Scratch, components, release
from .hashing import mix, words


@dataclass(frozen=True)
class Parameters:
    #: Words of a shingle.
    n: int = 5
    #: Similarity in hundredths.
    percent: int = 75
    #: Bytes of a shingle's hash by which lists are found, at every size of the corpus.  Results are exact with any; where
    #: they are too few, unshared shingles look shared: of 10**13 distinct ones 4 % with six bytes.
    width: int = 6
    #: Largest size considered for enumeration: beyond, pairs of prefix shingles would outgrow the text.
    light_most: int = 24
    #: Members of a key from which its last comparisons are cut by size and into slices of that many.
    crowd: int = 2000


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer than n words is one shingle, one without words none."""
    w, _, _, count, _ = words(texts)
    w = mix(w, 5)
    if len(w) >= n:
        h = w[: len(w) - n + 1].copy()
        with np.errstate(over="ignore"):
            for k in range(1, n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - n + 1 + k]
        h = mix(h, 6)
    out, at = [], 0
    for c in count.tolist():
        if c >= n:
            out.append(np.unique(h[at : at + c - n + 1]))
        elif c:
            x = np.uint64(c)
            with np.errstate(over="ignore"):
                for k in range(c):
                    x = x * np.uint64(0xC2B2AE3D27D4EB4F) + w[at + k]
            out.append(mix(np.array([x], np.uint64), 7))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def nodes_of(sets: list[np.ndarray]) -> list[int]:
    """A 64-bit name of each set: equal sets are one node."""
    return [int(mix(s, 8).sum(dtype=np.uint64).astype(np.int64)) for s in sets]


#: 64-bit words of a parity signature.
PARITY = 16


def parity(s: np.ndarray) -> np.ndarray:
    """For each of 64 * PARITY slots, whether an odd number of shingles falls there."""
    odd = np.bincount((s % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def least_shared(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def linked(shared, a, b, percent: int):
    return 100 * shared >= percent * (a + b - shared)


def set_blocks(docs: DataFrame, p: Parameters) -> DataFrame:
    """The sets of all documents, in blocks of about a million shingles.

    A block has doc_id (and whether it is null), size and node of each
    document, the shingles' values (hashes cut to `width` bytes) in order of
    the documents, sorted in each.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        release()
        ids, held, nodes = [], [], []
        n, name = 0, TaskContext.get().partitionId() << 32

        def block():
            doc = pd.concat(ids)
            sizes = np.array([len(s) for s in held], "<i4")
            every = np.concatenate(held)
            node = np.array(nodes, np.int64)
            row = {
                "ids": doc.fillna(0).to_numpy().astype("<i8").tobytes(), "nulls": doc.isna().to_numpy().astype(np.uint8).tobytes(),
                "sizes": sizes.tobytes(), "nodes": node.tobytes(), "seq": blocks.planes(every, p.width),
            }
            # Blocks are written before they are read, so what has a name need not come out the same again.
            return pd.DataFrame({"block": [name], "n_values": [len(every)], **{k: [v] for k, v in row.items()}})

        for batch in it:
            for i in range(0, len(batch), 256):
                part = batch.iloc[i : i + 256]
                sets = shingle_sets([t.encode() for t in part["text"]], p.n)
                ids.append(part["doc"].astype("Int64"))
                nodes += nodes_of(sets)
                held += [s >> np.uint64(64 - 8 * p.width) for s in sets]
                n += sum(map(len, sets))
                if n >= blocks.BLOCK_VALUES:
                    yield block()
                    ids, held, nodes, n, name = [], [], [], 0, name + 1
        if held:
            yield block()

    schema = "block long, n_values long, ids binary, nulls binary, sizes binary, nodes binary, seq binary"
    return docs.select("doc", "text").mapInPandas(run, schema)


def documents_of(table: DataFrame) -> DataFrame:
    """(doc, n, node) of every document in the blocks."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            for ids, nulls, sizes, nodes in batch.itertuples(index=False):
                doc = pd.Series(np.frombuffer(ids, "<i8")).astype("Int64").mask(np.frombuffer(nulls, np.uint8).astype(bool))
                yield pd.DataFrame({"doc": doc, "n": np.frombuffer(sizes, "<i4").astype(np.int64), "node": np.frombuffer(nodes, "<i8")})

    return table.select("ids", "nulls", "sizes", "nodes").mapInPandas(run, "doc long, n long, node long")


def boundary(list_length: float, p: Parameters) -> int:
    """Largest size up to which pairs of prefix shingles cost no more rows than prefix shingles and the lists they meet."""
    x = 1
    for n in range(2, p.light_most + 1):
        prefix = n - least_shared(n, p.percent) + 1
        light = (prefix + 1) * prefix // 2
        if light > prefix * list_length:
            break
        x = n
    return x


def postings(table: DataFrame, answers: DataFrame, light: int, p: Parameters) -> DataFrame:
    """Keys that more than one set may have: (key, node, n)."""
    # The smallest size that can be the partner of a heavy set.
    near = least_shared(light + 1, p.percent)

    def keys_of(s: np.ndarray, level: np.ndarray) -> np.ndarray:
        n = len(s)
        prefix = n - least_shared(n, p.percent) + 1
        order = np.argsort(level, kind="stable")[: prefix + 1]  # s is sorted: by (level, value)
        first, level = s[order].astype(np.uint64), level[order]
        out = []
        if n > light or n >= near or n == 1:
            out.append(first[:prefix][level[:prefix] > 0])
        if 1 < n <= light:
            first = first[level > 0]
            i, j = np.triu_indices(len(first), 1)
            a, b = np.minimum(first[i], first[j]), np.maximum(first[i], first[j])
            with np.errstate(over="ignore"):
                out.append(mix(a * np.uint64(0x9E3779B97F4A7C15) + b, 10))
        return np.concatenate(out)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            for sizes, nodes, seq, answer in batch.itertuples(index=False):
                sizes, nodes, seq = np.frombuffer(sizes, "<i4"), np.frombuffer(nodes, "<i8"), blocks.unplanes(seq, p.width)
                if not len(seq):
                    continue
                level = blocks.joined(answer)[np.unique(seq, return_inverse=True)[1]]
                # A document with as many unshared shingles as its prefix is long has no partner.
                alone = np.add.reduceat(np.append(level == 0, False).astype(np.int64), np.minimum(np.cumsum(sizes) - sizes, len(seq)))
                ends = np.cumsum(sizes)
                todo = np.flatnonzero((sizes > 0) & (alone < sizes - -(-p.percent * sizes.astype(np.int64) // 100) + 2))
                keys = [keys_of(seq[ends[k] - sizes[k] : ends[k]], level[ends[k] - sizes[k] : ends[k]]) for k in todo.tolist()]
                if keys:
                    of = np.repeat(todo, [len(k) for k in keys])
                    yield pd.DataFrame({"key": np.concatenate(keys).view(np.int64), "node": nodes[of], "n": sizes[of]})

    joined = table.select("block", "sizes", "nodes", "seq").join(blocks.by_block(answers), "block")
    return joined.select("sizes", "nodes", "seq", "answers").mapInPandas(run, "key long, node long, n int")


def verify(pairs: DataFrame, sets: DataFrame, p: Parameters) -> DataFrame:
    """Of pairs (a, b) those that link, as edges; sets has (node, shingles)."""
    left = pairs.join(sets.toDF("a", "sa"), "a")
    both = left.join(sets.toDF("b", "sb"), "b")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            ok = []
            for x, y in zip(batch["sa"], batch["sb"]):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                z = np.concatenate([x, y])
                z.sort(kind="stable")
                ok.append(bool(linked(int((z[1:] == z[:-1]).sum()), len(x), len(y), p.percent)))
            yield batch.loc[ok, ["a", "b"]]

    return both.select("a", "b", "sa", "sb").mapInPandas(run, "a long, b long")


def join(docs: DataFrame, scratch: Scratch, p: Parameters = Parameters(), rounds: int = 2) -> DataFrame:
    """Shingle-set size and component of every document: doc_id, n_shingles, component_id.

    Documents with the same set are one class, compared once.  Keys that two
    classes share make candidates, in three steps none of which is quadratic
    in a group of copies: in each round every member of a key meets one
    member that a hash picks for that key and round; links contract; keys
    whose members fell into one component are done.  What then remains are
    members that are not linked to the rest of their key: they meet every
    member of it that is in another component, in the first key that both
    share.  So no link between different texts is lost to the components.

    Null, empty and wordless texts: n_shingles 0, alone.  Repeated rows and
    ids: every row returns, and texts under one id link only if they are
    alike.  Null ids: such rows link like others but give a component no
    name; it is null where no member has an id.  Empty table: no rows.
    Whole texts count, however long.  Extra columns are ignored.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    table = scratch.save(set_blocks(d, p), "sets")
    rows = scratch.save(documents_of(table), "documents")
    cls = scratch.save(rows.where("n > 0").groupBy("node").agg(F.min("doc").alias("rep")), "classes")

    def read(sizes: bytes, nodes: bytes, seq: bytes) -> tuple[bytes, bytes]:
        row = blocks.pack(blocks.unplanes(seq, p.width), np.repeat(np.frombuffer(nodes, "<i8"), np.frombuffer(sizes, "<i4")))
        return row["vals"], row["twice"]

    answers = scratch.save(blocks.levels(table, table.agg(F.sum("n_values")).first()[0] or 0, "<u8", ("sizes", "nodes", "seq"), read, p.width), "levels")
    scratch.drop()
    light = boundary(blocks.list_length(answers), p)

    # Keys of one class only are dropped; copies of a class leave one posting.
    found_keys = scratch.save(postings(table, answers, light, p).distinct(), "postings")
    scratch.drop(table, answers)
    several = found_keys.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("key")
    live = scratch.save(found_keys.join(scratch.save(several, "several"), "key"), "live")
    scratch.drop(found_keys)

    members = live.select("node").distinct().join(cls, "node").select(F.col("rep").alias("doc")).distinct()
    members = scratch.save(members, "members")

    def as_sets(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            for i in range(0, len(batch), 256):
                s = shingle_sets([t.encode() for t in batch["text"].iloc[i : i + 256]], p.n)
                yield pd.DataFrame({"node": nodes_of(s), "shingles": [x.astype("<u8").tobytes() for x in s], "parity": [parity(x) for x in s]})

    held = d.join(members, "doc", "left_semi")
    if not members.where("doc is null").isEmpty():
        held = held.unionByName(d.where("doc is null"))  # a class that has no other ids
    sets = held.mapInPandas(as_sets, "node long, shingles binary, parity array<long>").dropDuplicates(["node"])
    sets = scratch.save(sets, "sets")
    scratch.drop()

    fits = lambda a, b: (F.col(a) * F.lit(100).cast("long") >= F.col(b) * F.lit(p.percent).cast("long")) & (F.col(b) * F.lit(100).cast("long") >= F.col(a) * F.lit(p.percent).cast("long"))
    edges = d.sparkSession.createDataFrame([], "a long, b long")
    todo = live.withColumn("comp", F.col("node"))
    for r in range(rounds):
        # First one member for all keys of a group, as far as the keys allow; later another for each key.
        by = F.xxhash64("node", "key", F.lit(r)) if r else F.xxhash64("node")
        pick = F.min_by(F.struct("node", "n", "comp"), by)
        chosen = todo.groupBy("key").agg(pick.alias("c")).select("key", F.col("c.node").alias("b"), F.col("c.n").alias("nb"), F.col("c.comp").alias("cb"))
        chosen = scratch.save(chosen, "chosen")
        meet = todo.join(chosen, "key").where((F.col("comp") != F.col("cb")) & fits("n", "nb"))
        pairs = scratch.save(meet.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct(), "pairs")
        if not pairs.isEmpty():
            edges = scratch.save(edges.unionByName(verify(pairs, sets.select("node", "shingles"), p)), "links")
            scratch.drop(pairs, chosen)
            todo = unfinished(live, edges, scratch)
    # The rest: members outside the largest part of their key, against everyone in another component.
    parts = todo.groupBy("key", "comp").agg(F.count("*").alias("m"))
    major = scratch.save(parts.groupBy("key").agg(F.max_by("comp", F.struct("m", "comp")).alias("major"), F.sum("m").alias("members")), "major")
    rest = scratch.save(todo.join(major, "key"), "rest")
    # Crowded keys: sizes in bands as wide as links allow, so partners are in the same band or a neighbour, and slices of a band.
    crowded = F.col("members") > p.crowd
    band = F.when(crowded, F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / p.percent))).cast("int")).otherwise(0)
    slices = F.when(crowded, F.ceil(F.col("members") / p.crowd).cast("int")).otherwise(1)
    first = scratch.save(rest.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("key")), 1, 64).alias("keys")), "first-keys")
    rest = scratch.save(rest.join(first, "node").join(sets.select("node", "parity"), "node"), "rest")
    cell = [band.alias("band"), F.pmod(F.xxhash64("node", F.lit("slice")), slices.cast("long")).cast("int").alias("slice")]
    x = rest.where("comp <> major").select("key", *cell, F.col("node").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"), F.col("keys").alias("ka"), F.col("parity").alias("pa"))
    near = rest.withColumns({"band_b": F.explode(F.when(crowded, F.array(band - 1, band, band + 1)).otherwise(F.array(F.lit(0)))), "slices": slices})
    near = near.withColumn("slice_b", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    y = near.select(F.col("key").alias("key_b"), "band_b", "slice_b", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"), F.col("keys").alias("kb"), F.col("parity").alias("pb"), "major")
    # Two minor members would meet twice: the smaller leads.  A pair that meets under a smaller key among the first of both is left to that key.
    once = (F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("major")) | (F.col("a") < F.col("b"))) & fits("na", "nb")
    once = once & (F.coalesce(F.array_min(F.array_intersect("ka", "kb")), F.col("key")) >= F.col("key"))
    # Where parities differ the sets do: a lower bound of what they don't share, of which links have little.
    apart = sum((F.bit_count(F.get("pa", F.lit(i)).bitwiseXOR(F.get("pb", F.lit(i)))) for i in range(1, PARITY)), F.bit_count(F.get("pa", F.lit(0)).bitwiseXOR(F.get("pb", F.lit(0)))))
    once = once & (apart * (100 + p.percent) <= (F.col("na").cast("long") + F.col("nb")) * (100 - p.percent))
    scratch.drop()
    pairs = scratch.save(x.join(y, (F.col("key") == F.col("key_b")) & (F.col("band") == F.col("band_b")) & (F.col("slice") == F.col("slice_b")) & once).select("a", "b").distinct(), "pairs")
    if not pairs.isEmpty():
        edges = scratch.save(edges.unionByName(verify(pairs, sets.select("node", "shingles"), p)), "links")

    comp = components(edges, scratch).toDF("node", "component")
    whole = scratch.save(cls.join(comp, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component")), "whole")
    least = scratch.save(whole.groupBy("component").agg(F.min("rep").alias("smallest")), "smallest")
    named = scratch.save(whole.join(least, "component").select("node", "smallest"), "named")
    return rows.join(named, "node", "left").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("smallest")).otherwise(F.col("doc")).alias("component_id"))


def unfinished(live: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Postings of keys whose members are in more than one component, with the component of each."""
    comp = components(edges, scratch).toDF("node", "component")
    now = scratch.save(live.join(comp, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("comp")), "now")
    open_keys = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    return scratch.save(now.join(scratch.save(open_keys, "open"), "key"), "todo")
