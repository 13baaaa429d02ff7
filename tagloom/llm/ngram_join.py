"""N-gram Jaccard join by PartEnum signatures: exact, for sets of word shingles.

Two sets whose similarity is 3/4 or more differ in at most (|A| + |B|) / 7
elements. Sizes fall into bands of ratio 4/3; a pair lies in one band or two
neighbouring ones, so that each set takes part in the instance of its own band
and of the band below. An instance hashes the domain into groups of three
parts, half as many as elements can differ: in one group at least, then, one
part differs at most. Each two parts of each group, with what the set has in
them, are a signature, and a pair that links shares one that is not empty. A
set that leaves too many parts empty for this (a small one, above all)
enumerates single parts too, of finer and finer partitions, until it occupies
more of them than can differ; a pair meets at the finest that either needs.

Sets that are equal are one class. Signatures meet in buckets: each bucket's
smallest member is compared with the others, links are united, and only buckets
that still hold several components go on to a second step: members' sketches
(four bits a part: the parity of its elements and a hash of them; parts that differ bound the difference from below, by two where the parity is the same)
are compared in blocks, and pairs that may link are verified. No pair is lost,
none is formed within a component, and none is capped.

Cases: a null or empty text, or one without words, has an empty set and links
with nothing; rows without doc_id are left out; a repeated row comes out
repeated; an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, lean, sliced
from .components import components
from .decontaminate import sized
from .shingles import mix, shingle_sets

#: Groups an element at the largest size of an instance's own band: twice as many are to hold more than can differ, a third of the elements.
GROUPS = 0.2
#: Parts a sketch has for each group, at least.
SKETCHED = 4
BLOCK = 1024
#: The lowest bit of each four.
ONES = np.uint64(0x1111111111111111)
REMEMBERED = 200_000


def lower_bounds() -> np.ndarray:
    """Where the bands start: powers of 4/3."""
    return np.array([(4 / 3) ** i for i in range(120)])


def groups_of(instance: np.ndarray) -> np.ndarray:
    """First-level partitions of an instance, each of three parts."""
    return np.ceil(lower_bounds()[instance + 1] * GROUPS).astype(np.int64)


def band_of(sizes: np.ndarray) -> np.ndarray:
    return np.searchsorted(lower_bounds(), sizes, side="right") - 1


def contents(value: np.ndarray, sizes: np.ndarray, parts: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of what each part of each set holds, for all sets one after another, and its number of elements."""
    base = np.concatenate([[0], np.cumsum(parts)])
    m = mix(value + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64))
    at = np.repeat(base[:-1], sizes) + (m % np.repeat(parts, sizes).astype(np.uint64)).astype(np.int64)
    n = np.bincount(at, minlength=base[-1])
    # sums of 32-bit halves stay exact in doubles
    low = np.bincount(at, weights=(value & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=base[-1])
    high = np.bincount(at, weights=(value >> np.uint64(32)).astype(np.float64), minlength=base[-1])
    return mix(low.astype(np.uint64) + mix(high.astype(np.uint64))), n


def signatures(value: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each set's signatures: the set's number, the instance and the signature."""
    out = []
    ends = np.cumsum(sizes)
    for below in (0, 1):
        doc = np.flatnonzero(sizes > 0)
        doc = doc[band_of(sizes[doc]) >= below]
        level = 0
        while len(doc):
            n, instance = sizes[doc], band_of(sizes[doc]) - below
            parts = 3 * groups_of(instance) << max(0, level - 1)
            own = np.concatenate([value[ends[d] - sizes[d] : ends[d]] for d in doc]) if len(doc) < len(sizes) else value
            held, count = contents(own, n, parts, 1 + level)
            salt = mix((instance * 64 + level).astype(np.uint64))
            if level == 0:
                # pairs of a group's parts; a group counts if none of its pairs is empty
                owner = np.repeat(np.arange(len(doc)), parts // 3)
                place = np.arange(len(owner)) - np.repeat(np.cumsum(parts // 3) - parts // 3, parts // 3)
                h, c = held.reshape(-1, 3), count.reshape(-1, 3)
                key = mix(h + mix(mix(h[:, [1, 2, 0]]) + np.arange(3, dtype=np.uint64) + mix(place.astype(np.uint64) + salt[owner])[:, None]))
                full = (c + c[:, [1, 2, 0]]) > 0
                who = np.repeat(owner, 3).reshape(-1, 3)[full]
                whole = 2 * np.bincount(owner, weights=(c > 0).sum(axis=1) >= 2, minlength=len(doc))
            else:
                owner = np.repeat(np.arange(len(doc)), parts)
                place = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
                key = mix(held + mix(place.astype(np.uint64) + salt[owner]))
                full = count > 0
                who = owner[full]
                whole = np.bincount(who, minlength=len(doc))
            out.append((doc[who], instance[who], key[full]))
            most = n // 3 if below == 0 else 2 * n // 7
            # without a difference the sets are equal, and one class
            doc = doc[(most > 0) & (whole <= most)]
            level += 1
    if not out:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def labels(spark, n: int) -> list[int]:
    """For each of `n` partitions a number that Spark's hash partitioning sends there, so that each gets the same share."""
    placed = spark.range(40 * n + 200).select(F.col("id").cast("int").alias("id"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("to"))
    found = {r.to: r.id for r in placed.groupBy("to").agg(F.min("id").alias("id")).toLocalIterator()}
    return [found[k] for k in sorted(found)]


def _keys(width: int):
    """Of each text the size of its set and a 128-bit hash of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            value, sizes = shingle_sets(batch.column("text"), width)
            start = np.cumsum(sizes) - sizes
            k1, k2 = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
            if len(full := np.flatnonzero(sizes)):
                k1[full] = np.add.reduceat(mix(value ^ np.uint64(0xA5A5A5A5A5A5A5A5)), start[full])
                k2[full] = np.bitwise_xor.reduceat(mix(value + np.uint64(0x1234567)), start[full])
            yield pa.record_batch([batch.column("doc_id"), pa.array(sizes.astype(np.int64)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64))], names=["doc_id", "n", "k1", "k2"])

    return run


def _emit(width: int, to_label: list[int]):
    """The signatures in packets, one for each part of their range: 32 bits of each, and runs of documents and instances."""
    label, n_parts = np.array(to_label, np.int32), len(to_label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            doc, instance, sig = signatures(*shingle_sets(batch.column("text"), width))
            to = ((sig >> np.uint64(32)) % np.uint64(n_parts)).astype(np.int64)
            run_of = doc * 256 + instance
            # one number for both: a slice of texts has far fewer than 2^32 runs
            order = np.argsort((to << np.int64(40)) | run_of)
            run_of, sig, to = run_of[order], sig[order], to[order]
            cuts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, np.int64)
            rows = []
            # texts without words alone have no signatures
            ends = [*cuts[1:], len(to)] if len(to) else []
            for a, b in zip(cuts, ends, strict=True):
                runs, count = np.unique(run_of[a:b], return_counts=True)
                low = (sig[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                rows.append((int(label[to[a]]), ids[runs // 256].tobytes(), (runs % 256).astype(np.uint8).tobytes(), count.astype(np.uint16 if count.max() < 65536 else np.uint32).tobytes(), low.tobytes()))
            if rows:
                yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[j] for r in rows], pa.binary()) for j in range(1, 5))], names=["part", "ids", "instances", "counts", "low"])

    return run


PACKETS = "part int, ids binary, instances binary, counts binary, low binary"
MEMBERS = "bucket long, instance int, rep long, hub long"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of each bucket of two or more in this part, with the smallest of them."""
    sigs, docs, instances, part = [], [], [], 0
    for batch in batches:
        for r in batch.to_pylist():
            ids = np.frombuffer(r["ids"], np.int64)
            counts = np.frombuffer(r["counts"], np.uint16 if len(r["counts"]) == 2 * len(ids) else np.uint32)
            docs.append(np.repeat(ids, counts))
            instances.append(np.repeat(np.frombuffer(r["instances"], np.uint8), counts))
            sigs.append(np.frombuffer(r["low"], np.uint32).astype(np.int64))
            part = r["part"]
    if not sigs:
        return
    doc, instance = np.concatenate(docs), np.concatenate(instances)
    # 32 bits may meet by chance (and are then told apart by what follows), but only within an instance
    sig = np.concatenate(sigs)
    del sigs, docs, instances
    sig <<= 8
    sig |= instance
    # most signatures are alone: those that are not are picked by value before places are sorted
    values = np.sort(sig)
    values = values[1:][values[1:] == values[:-1]]
    if not len(values):
        return
    values = values[np.concatenate([[True], values[1:] != values[:-1]])]
    at = np.searchsorted(values, sig)
    at[at == len(values)] = 0
    several = values[at] == sig
    del at, values
    sig, doc, instance = sig[several], doc[several], instance[several]
    order = np.lexsort((doc, sig))
    order = order[np.concatenate([[True], (np.diff(sig[order]) != 0) | (np.diff(doc[order]) != 0)])]
    sig, doc, instance = sig[order], doc[order], instance[order]
    new = np.concatenate([[True], sig[1:] != sig[:-1]])
    starts, number = np.flatnonzero(new), np.cumsum(new) - 1
    hub = np.minimum.reduceat(doc, starts)[number]
    bucket = (np.int64(part) << np.int64(40)) + number
    for a in range(0, len(sig), 50_000):
        cut = slice(a, a + 50_000)
        yield pa.record_batch([pa.array(bucket[cut]), pa.array(instance[cut].astype(np.int32)), pa.array(doc[cut]), pa.array(hub[cut])], names=["bucket", "instance", "rep", "hub"])


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many elements differ at least between sketches, along the last axis of 64-bit numbers."""
    d = x ^ y
    some = (d | d >> np.uint64(1) | d >> np.uint64(2) | d >> np.uint64(3)) & ONES
    return 2 * np.bitwise_count(some).sum(axis=-1, dtype=np.int64) - np.bitwise_count(d & (ONES << np.uint64(3))).sum(axis=-1, dtype=np.int64)


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that their sketches don't rule out."""
    for batch in sliced(batches):
        d = {c: batch.column(c) for c in ("a", "b", "na", "nb")}
        differ = [differing(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)]
        ok = 7 * np.array(differ, np.int64) <= d["na"].to_numpy() + d["nb"].to_numpy()
        yield pa.record_batch([d["a"], d["b"]], names=["a", "b"]).filter(pa.array(ok))


def _alike(width: int):
    """The pairs of texts whose sets have 100 * intersection >= 75 * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            (one, n), (two, m) = (shingle_sets(batch.column(c), width) for c in ("ta", "tb"))
            row = np.concatenate([np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(m)), m)])
            value = np.concatenate([one, two])
            order = np.lexsort((value, row))
            row, value = row[order], value[order]
            # a set holds a value once, so that one next to its equal is in both
            both = np.bincount(row[1:][(row[1:] == row[:-1]) & (value[1:] == value[:-1])], minlength=len(n))
            ok = (both > 0) & (100 * both >= 75 * (n + m - both))
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok))

    return run


def _sketches(width: int):
    """A sketch for each instance in which a text's set takes part: four bits for what each part holds, its parity the highest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            value, sizes = shingle_sets(batch.column("text"), width)
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for below in (0, 1):
                instance = band_of(np.maximum(sizes, 1)) - below
                ok = (instance >= 0) & (sizes > 0)
                if not ok.any():
                    continue
                parts = -(-groups_of(instance[ok]) * SKETCHED // 16) * 16  # whole 64-bit numbers
                held, count = contents(value[np.repeat(ok, sizes)], sizes[ok], parts, 7)
                held = np.where(count > 0, np.maximum(held >> np.uint64(61), 1), 0).astype(np.uint8) | (count % 2 << 3).astype(np.uint8)
                held = held[::2] | held[1::2] << 4
                cuts = np.concatenate([[0], np.cumsum(parts // 2)]).astype(np.int32)
                blobs = pa.Array.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer(cuts), pa.py_buffer(held)])
                yield pa.record_batch([pa.array(ids[ok]), pa.array(instance[ok].astype(np.int32)), pa.array(sizes[ok].astype(np.int64)), blobs], names=["doc_id", "instance", "n", "sketch"])

    return run


def _pairs_of(g: dict[str, np.ndarray], sketch: np.ndarray, one: int, two: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one block of a bucket with another, of different components, that the sketches don't rule out.

    A share of the parts rules out most: what differs there differs in all.
    """
    p, q = np.flatnonzero(g["block"] == one), np.flatnonzero(g["block"] == two)
    ids, component, n = g["doc_id"], g["component"], g["n"]
    share = np.ascontiguousarray(sketch[:, : max(4, sketch.shape[1] * 2 // 5)])
    out = []
    if len(p) and len(q):
        cq, iq, nq = component[q], ids[q], n[q]
        for i in p:
            at = q[(cq != component[i]) & ((iq > ids[i]) | (one != two)) & (4 * np.minimum(nq, n[i]) >= 3 * np.maximum(nq, n[i]))]
            for s in (share, sketch):
                if len(at):
                    at = at[7 * differing(s[at], s[i]) <= n[i] + n[at]]
            if len(at):
                out.append((np.full(len(at), ids[i]), ids[at]))
    return out


GROUP = ("sig", "one", "two")


def _may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of each group of rows; rows come sorted by group, of which one at a time is held whole."""
    rest: list[pa.RecordBatch] = []
    seen: set[tuple[int, int]] = set()  # pairs that this task has named; what it forgets comes out again, and is made distinct later

    def groups(t: pa.Table, last: bool):
        t = t.combine_chunks()
        c = {x: t[x].to_numpy() for x in (*GROUP, "block", "doc_id", "component", "n")}
        new = np.ones(t.num_rows, bool)
        new[1:] = np.any([c[x][1:] != c[x][:-1] for x in GROUP], axis=0)
        cuts = [*np.flatnonzero(new).tolist(), t.num_rows]
        a, b = [], []
        blobs = t["sketch"].chunk(0)
        ends, data = np.asarray(pa.Array.from_buffers(pa.int32(), len(blobs) + 1, [None, blobs.buffers()[1]], offset=blobs.offset)), np.frombuffer(blobs.buffers()[2], np.uint8)
        stop = len(cuts) - 1 if last else len(cuts) - 2
        for x, y in zip(cuts[:stop], cuts[1 : stop + 1], strict=True):
            if (c["component"][x:y] == c["component"][x]).all():
                continue
            g = {k: v[x:y] for k, v in c.items()}
            for one, two in _pairs_of(g, data[ends[x] : ends[y]].reshape(y - x, -1).view(np.uint64), int(g["one"][0]), int(g["two"][0])):
                a.append(one)
                b.append(two)
        both = np.zeros((0, 2), np.int64)
        if a:
            both = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
            both = both[np.fromiter((p not in seen for p in map(tuple, both.tolist())), bool, len(both))]
            if len(seen) > REMEMBERED:
                seen.clear()
            seen.update(map(tuple, both.tolist()))
        found = pa.record_batch([pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))], names=["a", "b"])
        return found, t.slice(cuts[stop])

    size = 0
    for batch in batches:
        rest.append(batch)
        size += batch.nbytes
        if size > 4 << 20:
            found, t = groups(pa.Table.from_batches(rest), False)
            rest = t.to_batches()
            # a group that goes on is looked at again only when as much again has come
            size = -t.nbytes
            if found.num_rows:
                yield found
    if rest and sum(x.num_rows for x in rest):
        yield groups(pa.Table.from_batches(rest), True)[0]


def _linked(pairs: DataFrame, single: DataFrame, width: int, kept: Kept) -> DataFrame:
    """Those pairs `a`, `b` of which 100 * intersection >= 75 * union. Texts that pairs name travel, which compress better than their sets."""
    pairs = kept.write(pairs)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = kept.write(single.join(sized(wanted), "doc_id", "left_semi"))
    one = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb")
    out = kept.write(both.mapInArrow(lean(_alike(width)), "a long, b long").distinct())
    kept.drop(pairs, texts)
    return out


def jaccard_components(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of each text of `docs` (doc_id, text)."""
    spark = docs.sparkSession
    kept = Kept(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    keys = kept.write(docs.mapInArrow(lean(_keys(width)), "doc_id long, n long, k1 long, k2 long"))
    classes = keys.where("n > 0").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"))
    of = kept.write(keys.join(classes, ["n", "k1", "k2"], "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")))
    kept.drop(keys)
    # one text of each class goes on
    copies = of.where("rep <> doc_id").select("doc_id").distinct()
    single = docs.join(sized(copies), "doc_id", "left_anti")

    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packets = single.mapInArrow(lean(_emit(width, labels(spark, n_parts))), PACKETS).repartition(n_parts, "part")
    members = kept.write(packets.mapInArrow(lean(_meet), MEMBERS))
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    sketches = kept.write(single.join(sized(wanted), "doc_id", "left_semi").mapInArrow(lean(_sketches(width)), "doc_id long, instance int, n long, sketch binary"))

    pairs = members.where("rep <> hub").groupBy(F.col("hub").alias("a"), F.col("rep").alias("b")).agg(F.min("instance").alias("instance"))
    one = sketches.select(F.col("doc_id").alias("a"), "instance", F.col("n").alias("na"), F.col("sketch").alias("sa"))
    two = sketches.select(F.col("doc_id").alias("b"), "instance", F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    close = pairs.join(one, ["a", "instance"]).join(two, ["b", "instance"]).where("4 * least(na, nb) >= 3 * greatest(na, nb)")
    links = _linked(close.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(lean(_prune), "a long, b long"), single, width, kept)
    found = kept.write(components(links, kept))

    # what still parts a bucket: its smallest member has been compared with all others
    left = members.where("rep <> hub").join(found, members.rep == found.node, "left").select(F.col("bucket").alias("sig"), "rep", "instance", F.coalesce("component", "rep").alias("component"))
    # dealt once by bucket: what follows aggregates there, and joins what it has aggregated
    left = left.repartition(n_parts, "sig")
    buckets = left.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m"), F.sum(F.xxhash64("rep", "instance").cast("decimal(38,0)")).alias("who")).where("lo <> hi")
    buckets = buckets.groupBy("m", "who").agg(F.min("sig").alias("sig"))  # one of those with the same members
    parted = left.join(buckets, "sig").join(sketches.withColumnRenamed("doc_id", "rep"), ["rep", "instance"])
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    parted = parted.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = parted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("sig", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", F.col("rep").alias("doc_id"), "component", "n", "sketch")
    dealt = dealt.repartition(n_parts, *GROUP).sortWithinPartitions(*GROUP)
    more = dealt.mapInArrow(lean(_may_link), "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links2 = _linked(more, single, width, kept)
    if links2.isEmpty():
        last = found
    else:
        last = kept.write(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links2), kept))
    kept.drop(members, links, links2, sketches)
    # a text whose links were found only in itself stays alone
    return of.join(last, of.rep == last.node, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5) -> DataFrame:
    """The rows of `docs` whose doc_id is its component's smallest; rows without doc_id stay."""
    found = jaccard_components(docs, width).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
