"""MinHash near-dedup (operator 6).

1. Each document's words (ASCII white space parts them, A-Z lower-cased) give its set of distinct shingles,
   held as 64-bit hashes.  Documents with equal sets form a class, found by a partial aggregate over
   128-bit fingerprints; only classes go on, so copies never meet in pairs.
2. Many universal hash minima of a set, cut into bands; a bucket is a band with its minima.  At the linking
   similarity a pair misses all bands with a probability of at most one in a million.
3. A bucket's members meet first as short marks, a byte of each minimum and four of each band: those that agree with no member of
   another component as a pair at the similarity would, or only with such as share an earlier band, leave the bucket.  So full
   sets travel only where a link is likely, and once a pair rather than once a band.
   Buckets are searched in three rounds of bands.  A bucket's members are dealt into blocks of bounded size, and each two
   blocks meet in one task: pairs connected already, of sizes too different, or compared in an earlier band are passed over, the
   signatures' agreement ends those far below the similarity, and the others are verified on the full sets.  A task returns
   only links that connect what its links so far do not, so rows never grow with the pairs of a group.
4. Between rounds, links are contracted, and buckets within one component are closed.  Shingles that no other member of an
   open bucket holds bound what a member can share: members that reach no partner this way leave.
5. Linked classes are connected by large-star and small-star rounds.

Documents without words, or null, are linked with nothing.  Rows with equal ids are documents of
their own, linked by their texts; a null id is the id of no component.  An empty table gives an
empty one; extra columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefmill.llm.common import byte_texts, give_back_memory, join_hot, key_filter, map_arrow, may_be_in, short_batches, written
from briefmill.llm.components import components, contracted

WIDTH = 3
PERCENT = 85
BANDS = 30
MISSED = 1e-6  # most probability that a pair at the similarity shares no bucket
ROUNDS = (0, 3, 10)  # first bands of the rounds
BLOCK_ROWS = 512  # members of a bucket, and bytes of their sets, that meet in one task with as many others
BLOCK_BYTES = 4 << 20
MARK_ROWS = 4096  # members of a bucket that meet as marks
VERIFIED_AT_ONCE = 32

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def rows_a_band(percent: int, bands: int = BANDS) -> int:
    rows = 1
    while (1 - (percent / 100) ** (rows + 1)) ** bands <= MISSED:
        rows += 1
    return rows


class WordHashes(dict):
    """64-bit hashes of words; a memory of bounded size that computes what it lacks."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def shingle_hashes(text: bytes | None, width: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles, each mixed from its words' hashes in order.  A text
    of fewer words is one shingle."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(width, len(words))
    total = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        total = (total ^ hashes[k : len(words) - size + 1 + k]) * _MIX
        total ^= total >> np.uint64(29)
    return np.unique(total)


class Minima:
    """Minima of a set under many universal hashes (a x + b mod 2^32, a odd) of its folded shingle hashes."""

    def __init__(self, count: int):
        draw = np.random.default_rng(20_011)
        self.a = draw.integers(0, 1 << 31, (count, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = draw.integers(0, 1 << 32, (count, 1), dtype=np.uint32)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        folded = (hashes >> np.uint64(32)).astype(np.uint32)
        out = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for k in range(0, len(folded), 2048):  # bounded memory for long texts
            part = folded[None, k : k + 2048] * self.a
            part += self.b
            np.minimum(out, part.min(1), out)
        return out


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))


def sketches(docs: DataFrame, width: int, percent: int, bands: int = BANDS) -> DataFrame:
    """Per row: doc_id, n_shingles, class (16 bytes, equal for equal sets; null without words) and its
    bucket of each band."""
    rows = rows_a_band(percent, bands)

    def start():
        minima, known = Minima(rows * bands), WordHashes()
        odd = np.random.default_rng(7).integers(0, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, classes, buckets = [], [], []
            last: tuple[bytes | None, np.ndarray | None] = (None, None)
            for text in byte_texts(batch.column("text")):
                hashes = shingle_hashes(text, width, known)
                counts.append(len(hashes))
                if not len(hashes):
                    classes.append(None)
                    continue
                classes.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
                if classes[-1] != last[0]:
                    banded = minima(hashes).reshape(bands, rows).astype(np.uint64)
                    mixed = np.arange(1, bands + 1, dtype=np.uint64) * _MIX
                    for k in range(rows):
                        mixed = (mixed ^ banded[:, k]) * odd[k]
                        mixed ^= mixed >> np.uint64(31)
                    last = classes[-1], mixed.view(np.int64)
                buckets.append(last[1])
            flat = np.concatenate(buckets) if buckets else np.zeros(0, np.int64)
            held = np.array([c is not None for c in classes])
            offsets = np.concatenate([[0], np.cumsum(held * bands)]).astype(np.int32)
            return pa.record_batch([
                batch.column("doc_id"), batch.column("text_key"), pa.array(counts, pa.int64()), pa.array(classes, pa.binary()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64())),
            ], ["doc_id", "text_key", "n_shingles", "class", "buckets"])

        return step

    return map_arrow(_keyed(docs), start, "doc_id bigint, text_key bigint, n_shingles bigint, class binary, buckets array<bigint>")


def _sets(docs: DataFrame, chosen: DataFrame, width: int, count: int, bands: int) -> DataFrame:
    """node, signature, mark, shingles and their number n of each of the ``chosen`` classes, from the document that stands for it."""

    def start():
        minima, known = Minima(count), WordHashes()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            nodes, signatures, marks, sets = [], [], [], [np.zeros(0, np.uint64)]
            for node, text in zip(batch.column("node").to_pylist(), byte_texts(batch.column("text"))):
                hashes = shingle_hashes(text, width, known)
                if hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() == node:
                    nodes.append(node)
                    sets.append(hashes)
                    own = minima(hashes)
                    signatures.append(own.tobytes())
                    marks.append(_mark(own, bands))
            ends = np.cumsum([len(s) for s in sets]).astype(np.int32)
            return pa.record_batch([
                pa.array(nodes, pa.binary()), pa.array(signatures, pa.binary()), pa.array(marks, pa.binary()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64), pa.int64())),
            ], ["node", "signature", "mark", "shingles"])

        return step

    # only the chosen texts travel
    texts = _keyed(docs).withColumn("key", F.xxhash64("doc_id", "text_key"))
    texts = texts.filter(may_be_in(F.col("key"), key_filter(chosen.select(F.xxhash64("doc_id", "text_key").alias("key")), "key")))
    wanted = chosen.withColumn("key", F.xxhash64("doc_id", "text_key")).withColumnsRenamed({"doc_id": "own_id", "text_key": "own_text"})
    same = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_key") == F.col("own_text"))
    # repeated rows give a class twice; texts are dealt by their key already, so they are reduced where they lie
    once = (
        texts.join(wanted, "key").filter(same).groupBy("key", "node", F.xxhash64(F.lit(1), "text").alias("again"))
        .agg(F.first("text").alias("text")).select("node", "text")
    )
    found = map_arrow(once, start, "node binary, signature binary, mark binary, shingles array<bigint>")
    return found.withColumn("n", F.size("shingles").cast("bigint"))


def _mark(minima: np.ndarray, bands: int) -> bytes:
    """A byte of each minimum, equal for equal minima, and then four bytes of each band's minima."""
    mixed = (minima.astype(np.uint64) * _MIX) >> np.uint64(56)
    banded = minima.reshape(bands, -1).astype(np.uint64)
    folded = np.zeros(bands, np.uint64)
    for k in range(banded.shape[1]):
        folded = (folded ^ banded[:, k]) * _MIX
        folded ^= folded >> np.uint64(29)
    return mixed.astype(np.uint8).tobytes() + (folded >> np.uint64(32)).astype(np.uint32).tobytes()


class _Group:
    """Members of one bucket that meet in one task: a block of it, or two blocks."""

    def __init__(self, rows: list[tuple], crossing: bool):
        # a row: (block, label, node, n, own, signature, shingles)
        self.nodes, self.sets = [r[2] for r in rows], [r[6] for r in rows]
        self.sizes, self.own = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
        self.signatures = np.stack([r[5] for r in rows])
        numbers: dict[bytes, int] = {}
        self.component = np.array([numbers.setdefault(r[1], len(numbers)) for r in rows])
        blocks = np.array([r[0] for r in rows])
        self.first, self.second = (np.flatnonzero(blocks == blocks.min()), np.flatnonzero(blocks == blocks.max())) if crossing else (np.arange(len(rows)),) * 2
        self.crossing = crossing

    def links(self, percent: int, least: float, rows_a_band: int, first_band: int) -> Iterator[tuple[bytes, bytes]]:
        """Verified links that connect what the members' labels and the links so far do not."""
        for k, a in enumerate(self.first):
            others = self.second if self.crossing else self.second[k + 1 :]
            others = others[self.component[others] != self.component[a]]
            # what may be shared over what must be in the union, either way
            n, own = self.sizes[others], self.own[others]
            others = others[
                (100 * np.minimum(n, self.sizes[a] - self.own[a]) >= percent * np.maximum(n + self.own[a], 0))
                & (100 * np.minimum(self.sizes[a], n - own) >= percent * (self.sizes[a] + own))]
            if not len(others):
                continue
            same = self.signatures[others] == self.signatures[a]
            agreement = same.mean(1)
            alike = agreement >= least
            if first_band:  # pairs that share an earlier band have been compared
                alike &= ~same[:, : first_band * rows_a_band].reshape(len(others), first_band, rows_a_band).all(2).any(1)
            others = others[alike][np.argsort(-agreement[alike], kind="stable")]
            while len(others):
                yield from self._verified(a, others[:VERIFIED_AT_ONCE], percent)
                others = others[VERIFIED_AT_ONCE:]
                others = others[self.component[others] != self.component[a]]

    def _verified(self, a: int, others: np.ndarray, percent: int) -> Iterator[tuple[bytes, bytes]]:
        own = self.sets[a]
        theirs = np.concatenate([self.sets[b] for b in others])
        at = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
        starts = np.concatenate([[0], np.cumsum(self.sizes[others])[:-1]])
        both = np.add.reduceat((own[at] == theirs).astype(np.int64), starts)
        for b in others[100 * both >= percent * (len(own) + self.sizes[others] - both)]:
            if self.component[b] != self.component[a]:
                yield self.nodes[a], self.nodes[b]
                self.component[self.component == self.component[b]] = self.component[a]


def _least(percent: int, count: int) -> float:
    """Share of equal minima that a pair at the similarity reaches but for six standard deviations."""
    return max(0.0, percent / 100 - 6 * (percent / 100 * (1 - percent / 100) / count) ** 0.5)


def _partnered(labels: np.ndarray, sizes: np.ndarray, marks: np.ndarray, earlier: np.ndarray, percent: int, least: float) -> np.ndarray:
    """Which members have another one of another label, of a size and with marks as a pair at the similarity has, that
    shares none of the ``earlier`` bands: those that do have met before."""
    found = np.zeros(len(labels), bool)
    need = int(np.ceil(least * marks.shape[1] - 1e-9))
    for a in range(len(labels)):
        if found[a]:
            continue
        others = np.flatnonzero((labels != labels[a]) & (100 * np.minimum(sizes, sizes[a]) >= percent * np.maximum(sizes, sizes[a])))
        others = others[(marks[others] == marks[a]).sum(1) >= need]
        others = others[~(earlier[others] == earlier[a]).any(1)]
        found[others] = True
        found[a] = len(others) > 0
    return found


def _promising(left: DataFrame, sets: DataFrame, percent: int, count: int) -> DataFrame:
    """The rows of ``left`` (band, bucket, node, label) that have a partner by size and marks whose first common bucket is theirs.

    A pair that shares a bucket passes there or in an earlier band, since marks agree wherever minima do."""
    least = _least(percent, count)
    cuts = left.groupBy("bucket").agg(F.ceil(F.count("*") / MARK_ROWS).cast("int").alias("blocks"))
    dealt = (
        left.join(cuts, "bucket").withColumn("block", F.floor(_place() * F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "band", "label", "node")
    )
    key = ["bucket", "i", "j"]
    together = dealt.join(sets.select("node", "n", "mark"), "node").repartition(*key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at = None

        def closed() -> pa.RecordBatch:
            numbers: dict[bytes, int] = {}
            labels = np.array([numbers.setdefault(r[1], len(numbers)) for r in held])
            marks = np.frombuffer(b"".join(r[3] for r in held), np.uint8).reshape(len(held), -1)
            earlier = marks[:, count:].copy().view(np.uint32)[:, : held[0][4]]
            chosen = _partnered(labels, np.array([r[2] for r in held]), marks[:, :count], earlier, percent, least)
            return pa.record_batch([
                pa.array([at[0]] * int(chosen.sum()), pa.int64()), pa.array([r[0] for r, own in zip(held, chosen) if own], pa.binary()),
            ], ["bucket", "node"])

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in key))
            members = zip(*(batch.column(c).to_pylist() for c in ("node", "label", "n", "mark", "band")))
            for own_key, member in zip(keys, members):
                if own_key != at:
                    if len(held) > 1:
                        yield closed()
                    held, at = [], own_key
                held.append(member)
        if len(held) > 1:
            yield closed()
        held.clear()
        give_back_memory()

    short_batches(left.sparkSession)
    chosen = together.mapInArrow(run, "bucket bigint, node binary").distinct()
    return left.join(chosen, ["bucket", "node"], "left_semi")


def _links(left: DataFrame, sets: DataFrame, percent: int, rows: int, first_band: int, count: int) -> DataFrame:
    """Verified (a, b) links among the members of each bucket of ``left`` (bucket, node, label, n, own).

    A bucket's members are dealt into blocks of bounded rows and bytes, and each two blocks meet in one task with signatures and
    full sets.  What leaves a task is fewer links than it has members."""
    least = _least(percent, count)
    cuts = left.groupBy("bucket").agg(
        F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"))
    block = F.floor(_place() * F.col("blocks")).cast("int")
    dealt = (
        left.join(cuts, "bucket").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "label", "node", "own")
    )
    dealt = written(dealt, "dealt")  # of known size, so that sets stay where they are while few rows ask for them
    key = ["bucket", "i", "j"]
    together = dealt.join(_sets_of(dealt, sets), "node").repartition(*key).sortWithinPartitions(*key).select(*key, "block", "label", "node", "n", "own", "signature", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at = None

        def closed() -> pa.RecordBatch:
            found = list(_Group(held, at[1] != at[2]).links(percent, least, rows, first_band)) if len(held) > 1 else []
            return pa.record_batch([pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.binary())], ["a", "b"])

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in key))
            columns = [batch.column(c).to_pylist() for c in ("block", "label", "node", "n", "own", "signature")]
            flat, ends = _flat(batch.column("shingles"))
            for row, own_key in enumerate(keys):
                if own_key != at:
                    if len(held) > 1:
                        yield closed()
                    held, at = [], own_key
                block_, label, node, n, own, signature = (c[row] for c in columns)
                held.append((block_, label, node, n, own, np.frombuffer(signature, np.uint32), flat[ends[row] : ends[row + 1]]))
        if len(held) > 1:
            yield closed()
        held.clear()
        give_back_memory()

    short_batches(left.sparkSession)
    return together.mapInArrow(run, "a binary, b binary").distinct()


def _sets_of(wanted: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``sets`` that ``wanted`` names, told by a filter where they are read: the others, most of all bytes, are not shuffled."""
    named = key_filter(wanted.select(F.xxhash64("node").alias("key")), "key")
    return sets.filter(may_be_in(F.xxhash64("node"), named))


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column of sorted arrays, as unsigned ones, and where each array begins and ends."""
    ends = lists.offsets.to_numpy()
    return lists.values.to_numpy(zero_copy_only=False).view(np.uint64), ends


def _place() -> Column:
    """A member's fixed place in [0, 1), the same in all its buckets."""
    return F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1 << 40)) / float(1 << 40)


def _bounded(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``left`` with ``own``, each member's number of shingles that no other member holds; they can only be in the union,
    so members that reach no partner this way leave."""
    members = _sets_of(left, sets).join(left.select("node").distinct(), "node", "left_semi").select("node", "n", "shingles")
    alone = (
        members.select("node", F.explode("shingles").alias("shingle")).groupBy("shingle")
        .agg(F.count("*").alias("holders"), F.first("node").alias("node")).filter("holders = 1")
        .groupBy("node").agg(F.count("*").alias("own"))
    )
    counts = members.select("node", "n").join(alone, "node", "left").select("node", "n", F.coalesce("own", F.lit(0)).alias("own"))
    return left.join(counts.filter(100 * (F.col("n") - F.col("own")) >= percent * F.col("n")), "node")


def _open(buckets: DataFrame) -> DataFrame:
    """The rows of the buckets that hold more than one label."""
    split = buckets.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x != y").select("bucket")
    return buckets.join(split, "bucket", "left_semi")


def _labelled(buckets: DataFrame, stars: DataFrame | None) -> DataFrame:
    """``buckets`` with a label for most of a component, which is enough to see what is connected already."""
    if stars is None:
        return buckets.withColumn("label", F.col("node"))
    labels = stars.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return buckets.join(labels, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")


def _added(stars: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """The links so far, contracted, with new ones."""
    links = written(links, "links")
    if links.isEmpty():
        return stars
    return contracted(links if stars is None else links.unionByName(stars))


def _roots(docs: DataFrame, classes: DataFrame, width: int, percent: int, bands: int) -> DataFrame | None:
    """(node, root) of the classes that are linked with others; None if no two share a bucket."""
    rows = rows_a_band(percent, bands)
    members = classes.select("node", F.posexplode("buckets").alias("band", "bucket"))
    shared = written(members.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1").select("bucket"), "shared")
    if shared.isEmpty():
        return None
    met = members.filter(may_be_in(F.col("bucket"), key_filter(shared, "bucket")))
    buckets = written(met.join(shared, "bucket"), "buckets")
    chosen = written(classes.join(buckets.select("node").distinct(), "node").select("node", "doc_id", "text_key"), "chosen")
    sets = written(_sets(docs, chosen, width, rows * bands, bands), "sets")
    first = buckets.filter(F.col("band") < ROUNDS[1]).withColumn("label", F.col("node"))
    first = _promising(first, sets, percent, rows * bands).join(sets.select("node", "n"), "node")
    stars = _added(None, _links(written(first.withColumn("own", F.lit(0).cast("bigint")), "left"), sets, percent, rows, 0, rows * bands))
    rest = written(_open(_labelled(buckets.filter(F.col("band") >= ROUNDS[1]), stars)), "open")
    rest = written(_promising(rest, sets, percent, rows * bands), "promising").drop("label")
    rest = written(_bounded(rest, sets, percent), "bounded")
    for low, high in zip(ROUNDS[1:], [*ROUNDS[2:], bands]):
        left = written(_open(_labelled(rest.filter(F.col("band").between(low, high - 1)), stars)), "left")
        stars = _added(stars, _links(left, sets, percent, rows, low, rows * bands))
    return None if stars is None else components(stars)


def _placed(docs: DataFrame, width: int, percent: int, bands: int) -> tuple[DataFrame, DataFrame]:
    """Sketches of the rows, and (node, component, component_id, doc_id, text_key, copies) of the classes; component_id
    is the least id of the component, doc_id and text_key are of the class's least document."""
    rows = written(sketches(docs, width, percent, bands), "sketches")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("lacks"), "doc_id", "text_key"))
    classes = written(
        rows.filter("class is not null").groupBy(F.col("class").alias("node"))
        .agg(least.alias("least"), F.first("buckets").alias("buckets"), F.count("*").alias("copies"))
        .select("node", "least.doc_id", "least.text_key", "buckets", "copies"), "classes")
    roots = _roots(docs, classes, width, percent, bands)
    own = classes.select("node", "doc_id", "text_key", "copies")
    if roots is None:
        return rows, own.withColumns({"component": F.col("node"), "component_id": F.col("doc_id")})
    rooted = own.join(roots, "node", "left").withColumn("component", F.coalesce("root", "node")).drop("root")
    ids = rooted.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return rows, written(rooted.join(ids, "component"), "placed")


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, bands: int = BANDS) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    rows, placed = _placed(docs, width, percent, bands)
    known = placed.select(F.col("node").alias("class"), "component_id", "copies")
    worded = join_hot(rows.filter("class is not null"), known, "class", "copies")
    out = worded.select("doc_id", "n_shingles", "component_id").unionByName(
        rows.filter("class is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS) -> DataFrame:
    """The rows of ``docs`` with one row of each component, the one of the least id, and all rows without words."""
    rows, placed = _placed(docs, width, percent, bands)
    order = F.struct(F.col("doc_id").isNull().alias("lacks"), "doc_id", "text_key")
    chosen = written(placed.groupBy("component").agg(F.min(order).alias("least")).select("least.doc_id", "least.text_key"), "chosen")
    # the input's columns stay together, whatever their names
    packed = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("own_id"), F.xxhash64("text").alias("own_text"),
        F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]").alias("worded"))
    doubtful = may_be_in(F.xxhash64("own_id", "own_text"), key_filter(_not_once(rows, chosen), "key"))
    same = F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_text") == F.col("text_key"))
    kept = packed.filter(F.col("worded") & doubtful).join(chosen, same, "left_semi").dropDuplicates(["own_id", "own_text"])
    return packed.filter(~F.col("worded") | ~doubtful).select("row.*").unionByName(kept.select("row.*"))


def _not_once(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """The keys of rows with words that are not chosen, or come more than once; all others are kept where they are read."""
    seen = rows.filter("class is not null").groupBy("doc_id", "text_key").agg(F.count("*").alias("times"))
    wanted = chosen.select(F.col("doc_id").alias("own_id"), F.col("text_key").alias("own_text"), F.lit(True).alias("chosen"))
    same = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_key") == F.col("own_text"))
    return seen.join(wanted, same, "left").filter("chosen is null or times > 1").select(F.xxhash64("doc_id", "text_key").alias("key"))
