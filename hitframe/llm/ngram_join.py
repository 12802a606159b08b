"""Similarity join of word-shingle sets (Jaccard 0.8 or more) by parity sketches, and the groups that its links form.

A set's sketch has one bit flipped for every hash, so the Hamming distance of two sketches is at most the symmetric difference
of the sets. Similar sets differ in at most a ninth of their sizes together. A sketch is cut into more blocks than that, so
two similar sets agree in a block (pigeonhole); sets are joined on blocks within bands of similar size. Candidates
pass a Hamming filter on whole sketches and are then compared by their texts.

No group of rows that share a block is expanded into pairs when it is large. Its members are compared with one of them
only. If that leaves the group in more than one component (a passage that many texts have), its members are joined again, by
single shingles, the rarest first, so that what many texts have comes last. Groups that are open even then (near copies of
one text, many of them too far from it for a link) are compared in blocks, by sketches and then by their sets, and a task gives only the
links that join components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from hitframe.llm.common import LARGE_ROWS, arrow_schema, give_back, map_partition, small_batches
from hitframe.llm.components import components
from hitframe.llm.shingles import fingerprint, parity_sketch, shingle_set, similar, sketch_keys
from hitframe.session import written

#: Bits of the sketch of the Hamming filter; members up to which a group of a block, or of a rare shingle, is expanded into all its
#: pairs; keys that are broadcast.
BITS, SMALL, SMALL_RARE, BROADCAST_KEYS = 1024, 8, 32, 1_000_000
#: Members and hashes of a block of an open group, and the factor within which its sizes lie: sets of similar size are in the same
#: band or in the next one, as similar sets' sizes differ by a factor of 1.25 at most.
BLOCK, BLOCK_CODES, RATIO = 512, 1 << 17, 1.26
PLACE = ("key", "band", "lane", "lanes", "lanes_after")
MEMBERS = ("ids", "comps", "sizes", "codes")
BLOCK_DDL = "key long, band long, lane long, lanes long, lanes_after long, only long, ids binary, comps binary, sizes binary, codes binary"
PAIR_DDL = "a long, b long, key long, hot boolean"


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n, set_id, sketch, keys of every document. A task gives the keys of equal sets once."""

    def make(rows):
        seen = set()
        for key, text in rows:
            codes = shingle_set(text)
            if not len(codes) or key is None:
                yield key, len(codes), None, None, None
                continue
            set_id = fingerprint(codes)
            if set_id in seen:
                yield key, len(codes), set_id, None, None
                continue
            seen.add(set_id)
            bits = np.frombuffer(parity_sketch(codes, BITS), "<i8")
            yield key, len(codes), set_id, bits, sketch_keys(codes).view(np.int64)

    return map_partition(docs.select("doc_id", "text"), make, "doc_id long, n long, set_id long, sketch array<long>, keys array<long>")


def met_in_groups(keyed: DataFrame, small: int = SMALL) -> DataFrame:
    """Pairs a < b of sets that share a key: all of a small group, with the first of its members in a large one (``hot``).

    Rows of a key lie in one partition and in order, so a task streams over them and holds no group. A key that all
    documents share is still a small part of the rows, for every document has many keys.
    """

    schema = arrow_schema(PAIR_DDL)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail_key, tail = None, []  # first members of the group that may go on in the next batch

        def close(out, key, members):
            for i in range(1, len(members)):
                for j in range(i):
                    out.append((members[j], members[i], key, False))

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            fresh = np.ones(len(keys), bool)
            fresh[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
            keys, ids = keys[fresh], ids[fresh]
            edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            sizes = np.diff(np.concatenate([edges, [len(keys)]]))
            wide = sizes > 1
            wide[0] = wide[-1] = True  # may go on from the last batch or in the next
            out: list[tuple] = []
            for at, size in zip(edges[wide].tolist(), sizes[wide].tolist()):
                key = int(keys[at])
                if key != tail_key:
                    if len(tail) <= small:
                        close(out, tail_key, tail)
                    tail_key, tail = key, []
                for member in ids[at : at + size].tolist():
                    if tail and member == tail[-1]:
                        continue
                    if len(tail) < small:
                        tail.append(member)
                    elif len(tail) == small:  # now it is large
                        out.extend((tail[0], m, key, True) for m in [*tail[1:], member])
                        tail.append(member)
                    else:
                        out.append((tail[0], member, key, True))
                        tail[-1] = member
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
        if 1 < len(tail) <= small:
            out = []
            close(out, tail_key, tail)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
        give_back()

    return keyed.select("key", "set_id").repartition("key").sortWithinPartitions("key", "set_id").mapInArrow(join, PAIR_DDL)


def near_sketches(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Distinct pairs whose sizes and sketches allow similar sets: a, b, doc_a, doc_b, apart (Hamming distance)."""
    of = lambda side: sets.select(*(F.col(c).alias(f"{c}_{side}") for c in ("set_id", "n", "sketch", "doc_id")))
    both = pairs.select("a", "b").distinct().join(of("a"), F.col("a") == F.col("set_id_a")).join(of("b"), F.col("b") == F.col("set_id_b"))
    apart = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    sizes = 5 * F.least("n_a", "n_b") >= 4 * F.greatest("n_a", "n_b")
    near = both.where(sizes).withColumn("apart", apart).where(9 * F.col("apart") <= F.col("n_a") + F.col("n_b"))
    return near.select("a", "b", F.col("doc_id_a").alias("doc_a"), F.col("doc_id_b").alias("doc_b"), "apart")


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Texts of the documents named by ``ids`` (doc_id, distinct), one row for each id; written to the shared folder."""
    few = ids.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    rows = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    return written(rows, "texts")


def similar_pairs(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b, doc_a, doc_b) whose texts' shingle sets are similar: a, b."""

    def make(rows):
        last, codes = None, None
        for a, b, text_a, text_b in rows:
            if text_a != last:
                last, codes = text_a, shingle_set(text_a)
            other = shingle_set(text_b)
            # rows that repeat an id have several texts; only those of the two sets count
            if similar(codes, other) and fingerprint(codes) == a and fingerprint(other) == b:
                yield a, b

    left = pairs.join(texts.select(F.col("doc_id").alias("doc_a"), F.col("text").alias("text_a")), "doc_a")
    both = left.join(texts.select(F.col("doc_id").alias("doc_b"), F.col("text").alias("text_b")), "doc_b")
    return map_partition(both.select("a", "b", "text_a", "text_b"), make, "a long, b long")


def across(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Pairs whose ends are not in one component yet."""
    if labels is None:
        return pairs
    of = lambda side: labels.select(F.col("node").alias(side), F.col("comp").alias(f"comp_{side}"))
    joined = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return joined.where(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b")).drop("comp_a", "comp_b")


def rare_first(texts: DataFrame) -> DataFrame:
    """key, set_id: of every text its rarest shingles, as many as two similar sets must share one of.

    Sets that are similar have 80 of 100 of the larger one in common, so in any order that is the same for all, one of the
    first fifth (and one more) is in both. The order is by the number of these texts that have a shingle.
    """

    def make(rows):
        for (text,) in rows:
            codes = shingle_set(text)
            yield fingerprint(codes), len(codes), codes.view(np.int64)

    rows = map_partition(texts.select("text"), make, "set_id long, n long, codes array<long>")
    rows = rows.select("set_id", "n", F.explode("codes").alias("key")).distinct()
    counted = rows.join(rows.groupBy("key").agg(F.count("*").alias("texts")), "key")
    order = Window.partitionBy("set_id").orderBy("texts", "key")
    return counted.withColumn("rank", F.row_number().over(order)).where("rank <= n - (4 * n + 4) div 5 + 1").select("key", "set_id")


class Links:
    """Links found so far, and the components that they make."""

    def __init__(self, docs: DataFrame, sets: DataFrame):
        self.docs, self.sets = docs, sets
        self.edges: DataFrame | None = None
        self.labels: DataFrame | None = None

    def add(self, found: DataFrame) -> None:
        found = written(found, "links")
        if not found.isEmpty():
            self.edges = found if self.edges is None else self.edges.unionByName(found)
            self.labels = components(self.edges)

    def compare(self, pairs: DataFrame) -> None:
        """Compare the texts of ``pairs`` (a, b) whose sketches are near: of each ``b`` its nearest first, then what is still apart."""
        near = written(across(near_sketches(pairs, self.sets), self.labels), "near")
        if near.isEmpty():
            return
        texts = texts_of(self.docs, ends_of(near))
        best = near.groupBy("b").agg(F.min_by(F.struct("a", "doc_a", "doc_b"), F.struct("apart", "a")).alias("m"))
        self.add(similar_pairs(best.select("m.a", "b", "m.doc_a", "m.doc_b"), texts))
        rest = near.join(best.select("m.a", "b"), ["a", "b"], "left_anti")
        self.add(similar_pairs(across(rest, self.labels), texts))

    def open_groups(self, met: DataFrame) -> DataFrame:
        """key, set_id: members of large groups that are not one component."""
        large = met.where("hot").select("key", "a", "b")
        keys = across(large, self.labels).select("key").distinct()
        members = large.join(keys, "key", "left_semi")
        both = members.select("key", F.col("a").alias("set_id")).unionByName(members.select("key", F.col("b").alias("set_id")))
        return written(both.distinct(), "open")

    def join_within(self, members: DataFrame, texts: DataFrame) -> None:
        """Add links that join the members of every group (key, set_id), as far as similar sets do.

        Members of a group lie in blocks by size and hash. Sets are compared inside a block first; then, with the components of that, blocks
        meet whose sizes allow links. A task gives a spanning forest of the components that it joins, so groups make no list of pairs.
        """
        members = different_groups(members)
        for meet in (each_alone, in_a_grid):
            self.add(map_partition(meet(self.blocks(members, texts)), compare_blocks, "a long, b long"))
            members = self.still_open(members)
            if members.isEmpty():
                return

    def named(self, members: DataFrame) -> DataFrame:
        """Members with the component that each is in."""
        if self.labels is None:
            return members.withColumn("comp", F.col("set_id"))
        labels = self.labels.withColumnRenamed("node", "set_id")
        return members.join(labels, "set_id", "left").withColumn("comp", F.coalesce("comp", "set_id"))

    def still_open(self, members: DataFrame) -> DataFrame:
        comps = self.named(members).groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
        return written(members.join(comps.where("low != high").select("key"), "key", "left_semi"), "open")

    def blocks(self, members: DataFrame, texts: DataFrame) -> DataFrame:
        """key, band, lane, block: members of a group whose sizes are within a factor of ``RATIO``, in lanes of about ``BLOCK`` members or ``BLOCK_CODES`` hashes."""
        rows = self.named(members).join(codes_of(texts), "set_id")
        rows = rows.withColumn("band", F.floor(F.log(F.col("n")) / math.log(RATIO)))
        lanes = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_CODES)).alias("lanes")
        sizes = self.sets.select("set_id", "n").join(members, "set_id").withColumn("band", F.floor(F.log(F.col("n")) / math.log(RATIO)))
        sizes = written(sizes.groupBy("key", "band").agg(lanes), "lanes")
        after = sizes.select("key", (F.col("band") - 1).alias("band"), F.col("lanes").alias("lanes_after"))
        placed = rows.join(sizes, ["key", "band"]).join(after, ["key", "band"], "left")
        placed = placed.withColumn("lane", F.pmod(F.xxhash64("set_id"), F.col("lanes"))).select(*PLACE, "set_id", "comp", "codes")
        return written(map_partition(placed.repartition("key", "band", "lane").sortWithinPartitions(*PLACE), pack_blocks, BLOCK_DDL), "blocks", **LARGE_ROWS)


def different_groups(members: DataFrame) -> DataFrame:
    """Of groups with the same members one."""
    hashes = (F.bit_xor(F.xxhash64("set_id", F.lit(seed))).alias(f"h{seed}") for seed in (1, 2))
    marks = members.groupBy("key").agg(F.count("*").alias("n"), *hashes)
    return written(members.join(marks.groupBy("n", "h1", "h2").agg(F.min("key").alias("key")).select("key"), "key", "left_semi"), "groups")


def codes_of(texts: DataFrame) -> DataFrame:
    """set_id, n, codes of the texts' sets."""

    def make(rows):
        for (text,) in rows:
            codes = shingle_set(text)
            yield fingerprint(codes), len(codes), codes.tobytes()

    return map_partition(texts.select("text"), make, "set_id long, n long, codes binary").dropDuplicates(["set_id"])


def each_alone(blocks: DataFrame) -> DataFrame:
    return blocks.select(*MEMBERS, *(F.lit(None).cast("binary").alias(f"{c}_b") for c in MEMBERS))


def in_a_grid(blocks: DataFrame) -> DataFrame:
    """Pairs of blocks of a group and band, and of a band and the next; those that are of one and the same component are left out."""
    same = F.when(F.col("lane") + 1 < F.col("lanes"), F.transform(F.sequence(F.col("lane") + 1, F.col("lanes") - 1), lambda k: F.struct(F.col("band").alias("band"), k.alias("lane"))))
    above = F.when(F.col("lanes_after") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("lanes_after") - 1), lambda k: F.struct((F.col("band") + 1).alias("band"), k.alias("lane"))))
    none = F.array().cast("array<struct<band: bigint, lane: bigint>>")
    left = blocks.select("key", "only", *(F.col(c).alias(f"{c}_a") for c in MEMBERS), F.explode(F.concat(F.coalesce(same, none), F.coalesce(above, none))).alias("at"))
    left = left.select("key", F.col("at.band").alias("band"), F.col("at.lane").alias("lane"), F.col("only").alias("only_a"), *(f"{c}_a" for c in MEMBERS))
    met = left.join(blocks.select("key", "band", "lane", "only", *MEMBERS), ["key", "band", "lane"])
    return met.where("only_a IS NULL OR only IS NULL OR only_a != only").select(*(f"{c}_a" for c in MEMBERS), *(F.col(c).alias(f"{c}_b") for c in MEMBERS))


def pack_blocks(rows: Iterator[tuple]) -> Iterator[tuple]:
    """A block for every place from members in the order of places; ``only`` is the component if all members are of one."""

    def packed(place, held):
        ids, comps, codes = zip(*held)
        numbers = (np.array(c, np.int64).tobytes() for c in (ids, comps, [len(c) // 8 for c in codes]))
        return (*place, comps[0] if len(set(comps)) == 1 else None, *numbers, b"".join(codes))

    place, held, size = None, [], len(PLACE)
    for row in rows:
        if held and place != row[:size]:
            yield packed(place, held)
            held = []
        place = row[:size]
        held.append(row[size:])
    if held:
        yield packed(place, held)


class Block:
    """Members of a block: ids, components, and their sets with sizes and sketches."""

    def __init__(self, ids: bytes, comps: bytes, sizes: bytes, codes: bytes):
        self.ids, self.comps, self.sizes = (np.frombuffer(c, np.int64).copy() for c in (ids, comps, sizes))
        self.sets = np.split(np.frombuffer(codes, np.uint64), np.cumsum(self.sizes)[:-1])
        self.sketches = np.stack([np.frombuffer(parity_sketch(c, BITS), np.uint64) for c in self.sets])


def compare_blocks(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Links (a, b), smaller id first, between the members of two blocks, or of one (the other is null): one for each time two components become one."""
    for row in rows:
        one = Block(*row[:4])
        other = one if row[4] is None else Block(*row[4:])
        for i in range(len(one.ids)):
            sizes = 5 * np.minimum(one.sizes[i], other.sizes) >= 4 * np.maximum(one.sizes[i], other.sizes)
            near = np.flatnonzero(sizes & (one.comps[i] != other.comps))
            apart = np.bitwise_count(one.sketches[i] ^ other.sketches[near]).sum(axis=1)
            for j in near[9 * apart <= one.sizes[i] + other.sizes[near]]:
                old, new = other.comps[j], one.comps[i]
                if old != new and (other is not one or j > i) and similar(one.sets[i], other.sets[j]):
                    for block in (one, other):
                        block.comps[block.comps == old] = new
                    yield tuple(sorted((int(one.ids[i]), int(other.ids[j]))))


def linked(docs: DataFrame, rows: DataFrame, small: int = SMALL, small_rare: int = SMALL_RARE) -> DataFrame | None:
    """``node, comp`` of all sets with links (None: there is no link), from the written ``sketches`` of ``docs``."""
    own = rows.where(F.col("keys").isNotNull())
    first = own.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    sets = written(first, "sets")
    links = Links(docs, sets)
    keyed = own.select("set_id", F.explode("keys").alias("key"))
    for level, most in enumerate((small, small_rare)):
        met = written(met_in_groups(keyed, most), "pairs")
        links.compare(met)
        members = links.open_groups(met)
        if members.isEmpty():
            return links.labels
        if not level:
            texts = texts_of(docs, members.select("set_id").distinct().join(sets, "set_id").select("doc_id").distinct())
            keyed = rare_first(texts)
    links.join_within(members, texts)
    return links.labels


def ends_of(near: DataFrame) -> DataFrame:
    return near.select(F.col("doc_a").alias("doc_id")).unionByName(near.select(F.col("doc_b").alias("doc_id"))).distinct()


def near_duplicates(docs: DataFrame, small: int = SMALL) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id that links reach, its own included).

    Links join documents whose sets of 5-word shingles are similar; equal sets are linked. A document without words (null,
    empty, white space) has the empty set and no link. A row with a null id has no link, and a null component. Repeated rows each get their row. Columns other than doc_id and text are
    ignored. Shingles and sets are told apart by 64-bit hashes.
    """
    small_batches(docs.sparkSession)
    rows = written(sketches(docs), "sketches")
    labels = linked(docs, rows, small)
    named = rows.select("doc_id", F.col("n").alias("n_shingles"), "set_id")
    comp = F.col("set_id")
    if labels is not None:
        named = named.join(labels, named["set_id"] == labels["node"], "left")
        comp = F.coalesce("comp", "set_id")
    # both sides are read from tables, so adaptive execution can split a group that holds many of the documents
    grouped = written(named.select("doc_id", "n_shingles", comp.alias("g")), "groups")
    smallest = written(grouped.where(F.col("g").isNotNull()).groupBy("g").agg(F.min("doc_id").alias("smallest")), "smallest")
    return grouped.join(smallest, "g", "left").select("doc_id", "n_shingles", F.coalesce("smallest", "doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame, small: int = SMALL) -> DataFrame:
    """The rows of ``docs`` whose document has the smallest id of its group, with their columns; rows without words stay.

    Rows that repeat an id are one document here.
    """
    found = near_duplicates(docs, small).where("doc_id != component_id").select("doc_id").distinct()
    gone = written(found, "gone")
    few = gone.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti")
