"""Near-duplicate detection by Order MinHash and banded alignment.

Words are compared without case and signs. Each of several hash functions picks
the two least of a text's occurrence-labelled k-mers of words; the pair, kept in
text order, is one sketch entry (Marcais et al., 2019). Texts that agree on an
entry are candidates. A candidate pair is linked if the edit distance of its
word sequences, computed in a band, is at most ``1 - similarity`` of the longer.

Inside a bucket every text is compared with one leader, so a group of copies
costs as many comparisons as it has texts; each hash function orders the texts
anew, so leaders differ between buckets. Then all texts of a bucket that are still
in different components are compared with each other. Large buckets are parted
for that by the rarest words of each text, of which texts that are alike share one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, shuffle_partitions, staged, whole_rows, whole_text
from .gather import gathered
from .textbytes import BASE, Hasher, U, folded, mix, row_bounds, shingles, slices, tidy, utf8, word_spans

WIDTH, ENTRIES, SIMILARITY = 5, 24, 0.8
_FACTORS = mix(np.arange(1, ENTRIES + 1).astype(U)) | U(1)
_KEEP = np.zeros(256, bool)
_KEEP[[0x20, *range(0x09, 0x0E), *range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
FILTER_BITS = 1 << 22
#: Texts of a bucket that meet in one task; pairs that wait there for alignment, and those aligned between two looks at the components.
BUCKET, GATHERED, PART = 2000, 200_000, 4096


def normal_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word, lower case, letters and digits only."""
    keep = _KEEP[data]
    offsets = np.append(0, np.cumsum(keep))[offsets]
    data = folded(data[keep])
    start, end, row = word_spans(data, offsets)
    return Hasher(data).spans(start, end), row


def node_of(words: np.ndarray, text: bytes) -> int:
    """A text's number: equal for equal word sequences; texts without words go by their bytes."""
    digest = hashlib.blake2b(words.tobytes() if len(words) else b"\0" + text, digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True)


def occurrence_labelled(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Values told apart by their how-manieth occurrence in the row."""
    order = np.lexsort((values, row))
    fresh = np.append(True, (values[order][1:] != values[order][:-1]) | (row[order][1:] != row[order][:-1]))
    rank = np.empty(len(values), np.int64)
    index = np.arange(len(values))
    rank[order] = index - np.maximum.accumulate(np.where(fresh, index, 0))
    return mix(values + rank.astype(U) * BASE)


def order_minhash(kmers: np.ndarray, labelled: np.ndarray) -> np.ndarray:
    """The sketch of one text from its k-mers in text order."""
    n = len(kmers)
    if n == 0:
        return np.empty(0, U)
    if n == 1:
        return mix(kmers[0] + _FACTORS)
    value = labelled[None, :] * _FACTORS[:, None]
    each = np.arange(ENTRIES)
    first = value.argmin(axis=1)
    value[each, first] = U(0xFFFFFFFFFFFFFFFF)
    second = value.argmin(axis=1)
    a, b = np.minimum(first, second), np.maximum(first, second)
    return mix(mix(kmers[a] + _FACTORS) * BASE + kmers[b])


#: Cells of a batch's antidiagonal, and bytes of its words.
CELLS, BATCH_WORDS = 1 << 15, 1 << 21
FAR = {np.int16: 16_000, np.int32: 1 << 29}


def trimmed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two without their common beginning and end, the shorter first."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - n :] != b[len(b) - n :])
    tail = n - 1 - int(differ[-1]) if len(differ) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    return (a, b) if len(a) <= len(b) else (b, a)


def edit_distances(pairs: list[tuple[np.ndarray, np.ndarray]], most: np.ndarray) -> np.ndarray:
    """Word edit distance of each pair, or its ``most + 1`` where it is more.

    Pairs are aligned many at a time in a band around the main diagonal. A
    narrow band comes first; it settles a distance that it is as wide as.
    """
    most = np.asarray(most, np.int64)
    out = most + 1
    cut = [trimmed(a, b) for a, b in pairs]
    n, m = np.array([len(a) for a, _ in cut], np.int64), np.array([len(b) for _, b in cut], np.int64)
    near = m - n <= most
    out[near & (n == 0)] = m[near & (n == 0)]
    left = np.flatnonzero(near & (n > 0))
    band = 32
    while len(left):
        width = np.maximum(np.minimum(most[left], band), m[left] - n[left])
        order = np.lexsort((n[left] + m[left], width))
        left, width = left[order], width[order]
        at = 0
        while at < len(left):
            size = max(1, min(2048, CELLS // (int(width[at]) + 1)))
            one = left[at : at + size]
            size = max(1, int(np.searchsorted(np.arange(1, len(one) + 1) * np.maximum.accumulate(n[one] + m[one] + 2 * width[at : at + size]), BATCH_WORDS, "right")))
            one = one[:size]
            bound = np.minimum(width[at : at + size], most[one])
            found = _aligned([cut[i] for i in one], bound, int(width[at : at + size].max()))
            good = found <= bound
            out[one[good]] = found[good]
            at += size
        left = left[(out[left] > most[left]) & (width < most[left])]
        band *= 8
    return out


def _aligned(pairs: list[tuple[np.ndarray, np.ndarray]], most: np.ndarray, band: int) -> np.ndarray:
    """Distances by antidiagonals of the band, a column for each pair; above ``most`` any greater number.

    On antidiagonal s, cell t holds the edits of the first i words of the one
    and j of the other with j - i = 2 t - band, or one more where s + band is odd.
    """
    n, m = np.array([len(a) for a, _ in pairs]), np.array([len(b) for _, b in pairs])
    ends, goal = n + m, m - n
    kind = np.int16 if int(ends.max()) < 15_000 else np.int32
    far = kind(FAR[kind])
    edge = band // 2 + 2
    rows, last = int(n.max()) + 2 * edge + band, int(m.max()) + 2 * edge + band
    left, right = np.zeros((rows, len(pairs)), np.uint32), np.zeros((last, len(pairs)), np.uint32)
    for p, (a, b) in enumerate(pairs):
        left[rows - edge - len(a) : rows - edge, p] = a[::-1]
        right[edge : edge + len(b), p] = b
    live, result = np.arange(len(pairs)), most.astype(np.int64) + 1
    older, newer = np.full((band + band % 2, len(pairs)), far, kind), np.full((band + 1 - band % 2, len(pairs)), far, kind)
    newer[band // 2] = 0  # antidiagonal 0, and the one before it without any
    for s in range(1, int(ends.max()) + 1):
        full = (s + band) % 2 == 0
        first = -band if full else 1 - band
        count = band + 1 if full else band
        x = rows - edge - (s - first) // 2
        y = edge + (s + first) // 2 - 1
        made = older + (left[x : x + count] != right[y : y + count])
        if full:
            if band:
                np.minimum(made[1:], newer + kind(1), out=made[1:])
                np.minimum(made[:-1], newer + kind(1), out=made[:-1])
        else:
            np.minimum(made, np.minimum(newer[:-1], newer[1:]) + kind(1), out=made)
        older, newer = newer, made
        done = np.flatnonzero(ends == s)
        if len(done):
            result[live[done]] = newer[(goal[done] - first) // 2, done]
        if s % 16 == 0:
            # edits so far and those that the way back to the goal takes at least
            away = np.abs((first + 2 * np.arange(count))[:, None] - goal[None, :])
            apart = (newer + away).min(axis=0)
            other = 1 - band if full else -band
            away = np.abs((other + 2 * np.arange(len(older)))[:, None] - goal[None, :])
            apart = np.minimum(apart, (older + away).min(axis=0)) if len(older) else apart
            keep = (apart <= most) & (ends > s)
            if not keep.any():
                break
            if keep.sum() <= 0.7 * len(keep):
                live, ends, goal, most = live[keep], ends[keep], goal[keep], most[keep]
                left, right, older, newer = (np.ascontiguousarray(z[:, keep]) for z in (left, right, older, newer))
    return result


CLASSES = 1024


def profile(words: np.ndarray) -> np.ndarray:
    """Counts of the words, and of the pairs of words in a row, in classes by hash.

    An edit moves at most 2 of the one count and 4 of the other, so half and a
    quarter of the differences bound the edit distance from below.
    """
    words = words.astype(np.uint32, copy=False)
    pairs = (words[:-1] * np.uint32(0x9E3779B1) ^ words[1:]) * np.uint32(0x85EBCA6B) >> np.uint32(22)
    return np.concatenate([np.bincount(words & np.uint32(CLASSES - 1), minlength=CLASSES), np.bincount(pairs, minlength=CLASSES)])


def least_edits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The greater bound from profiles; ``a`` may have several rows."""
    far = np.abs(a - b)
    return np.maximum(far[..., :CLASSES].sum(axis=-1) / 2, far[..., CLASSES:].sum(axis=-1) / 4)


def alike(pairs: list[tuple[np.ndarray, np.ndarray]], similarity: float) -> np.ndarray:
    """Whether the edit distance of each pair is at most ``1 - similarity`` of the longer; lengths and profiles go first."""
    size = np.array([(len(a), len(b)) for a, b in pairs], np.int64).reshape(-1, 2)
    most = ((1 - similarity) * size.max(axis=1) + 1e-9).astype(np.int64)
    good = np.abs(size[:, 0] - size[:, 1]) <= most
    for p in np.flatnonzero(good):
        good[p] = least_edits(profile(pairs[p][0]), profile(pairs[p][1])) <= most[p]
    left = np.flatnonzero(good)
    good[left] = edit_distances([pairs[p] for p in left], most[left]) <= most[left]
    return good


ROWS = "doc_id bigint, node bigint, sketch binary"


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        nodes, sketches = [], []
        for a, b in slices(offsets, 1 << 20):
            part, bounds = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            words, row = normal_words(part, bounds)
            at = row_bounds(row, b - a)
            kmers, to = shingles(words, row, b - a, WIDTH)
            labelled = occurrence_labelled(kmers, np.repeat(np.arange(b - a), np.diff(to))) if len(kmers) else kmers
            for i in range(b - a):
                nodes.append(node_of(words[at[i] : at[i + 1]], part[bounds[i] : bounds[i + 1]].tobytes()))
                sketches.append(order_minhash(kmers[to[i] : to[i + 1]], labelled[to[i] : to[i + 1]]).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(sketches, pa.binary())], names=["doc_id", "node", "sketch"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each node and sketch entry: the bucket, and the node in the entry's own order."""
    turn = mix(np.arange(101, 101 + ENTRIES).astype(U)).astype(np.int64)
    for batch in batches:
        sketches = [x for x in batch.column(1).to_pylist()]
        full = np.array([len(x) > 0 for x in sketches], bool)
        values = np.frombuffer(b"".join(sketches), U).reshape(-1, ENTRIES)
        node = np.asarray(batch.column(0), np.int64)[full]
        bucket = mix(values + turn.astype(U)[None, :]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(bucket.ravel()), pa.array((node[:, None] ^ turn[None, :]).ravel()), pa.array(np.repeat(node, ENTRIES))], names=["bucket", "turned", "node"])


def components(edges: DataFrame) -> DataFrame:
    """node and component of every node of the edges (a, b); a component's name is one of its nodes.

    Each round every node goes to the least of its neighbours, and its neighbour's
    choice, and the edges between what is left go on to the next; tables are
    written between rounds.
    """
    spark = edges.sparkSession
    left = staged(edges.select("a", "b").where("a != b").distinct(), narrow=True)
    found = None
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        least = staged(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")).select(F.col("a").alias("node"), "to"), narrow=True)
        hop = least.select(F.col("node").alias("to"), F.col("to").alias("then"))
        parent = staged(least.join(hop, "to").select("node", F.col("then").alias("to")), narrow=True)
        pa_, pb = parent.select(F.col("node").alias("a"), F.col("to").alias("ta")), parent.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        before, left = left, staged(left.join(pa_, "a").join(pb, "b").where("ta != tb").select(F.col("ta").alias("a"), F.col("tb").alias("b")).distinct(), narrow=True)
        discard(before, least)
        if found is None:
            found = parent
        else:
            old, found = found, staged(found.join(parent.select(F.col("node").alias("to"), F.col("to").alias("then")), "to", "left").select("node", F.coalesce("then", "to").alias("to")), narrow=True)
            discard(old, parent)
    if found is None:
        return spark.createDataFrame([], "node bigint, component bigint")
    return found.select("node", F.col("to").alias("component"))


def _verified(pairs: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose word sequences are alike."""
    left, right = words.select(F.col("node").alias("a"), F.col("words").alias("wa")), words.select(F.col("node").alias("b"), F.col("words").alias("wb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wa, wb = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            good = alike([(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) for x, y in zip(wa, wb, strict=True)], similarity)
            kept = batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
            if kept.num_rows:
                yield kept

    parts = shuffle_partitions(pairs.sparkSession)
    met = pairs.join(left, "a").repartition(parts, "b").join(right, "b")
    return staged(met.select("a", "b", "wa", "wb").mapInArrow(tidy(run), "a bigint, b bigint"))


def _pair(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, component) after further links (a, b)."""
    ca, cb = found.select(F.col("node").alias("a"), F.col("component").alias("ca")), found.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    between = links.join(ca, "a", "left").join(cb, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    merged = components(between)
    moved = found.join(merged.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return staged(moved.union(merged.join(found, "node", "left_anti")), narrow=True)


def labelled_words(words: np.ndarray) -> np.ndarray:
    """The words told apart by their how-manieth occurrence."""
    return occurrence_labelled(words.astype(U), np.zeros(len(words), np.int64)) if len(words) else np.empty(0, U)


def _parted(hot: DataFrame, words: DataFrame, similarity: float, block: int) -> DataFrame:
    """bucket, sub, node, component: large buckets in smaller, overlapping groups that no pair to be linked is parted by.

    Texts within the edit distance share all but ``1 - similarity`` of the
    longer one's words, so of the words of either, the rarest of the bucket
    first, one more than that share holds a common one. A text goes where those
    of its words go that another text of the bucket has too.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, node, component, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                word = labelled_words(np.frombuffer(raw, np.uint32)).astype(np.int64)
                n = len(word)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, v), pa.int64()) for v in (bucket, node, component)] + [pa.array(word), pa.array(np.full(n, n), pa.int64())], names=["bucket", "node", "component", "word", "size"])

    each = hot.join(words.select("node", "words"), "node").select("bucket", "node", "component", "words")
    each = staged(each.mapInArrow(tidy(split), "bucket bigint, node bigint, component bigint, word bigint, size bigint"))
    shared = each.groupBy("bucket", "word").agg(F.count("*").alias("texts")).where("texts > 1")
    one = Window.partitionBy("bucket", "node")
    held = each.join(shared, ["bucket", "word"]).withColumn("alone", F.col("size") - F.count("*").over(one))
    first = F.floor(F.col("size") * F.lit(1 - similarity) + 1e-9) + 1 - F.col("alone")
    held = staged(held.withColumn("place", F.row_number().over(one.orderBy("texts", "word"))).where(F.col("place") <= first).select("bucket", "node", "component", "word"))
    subs = held.groupBy("bucket").agg(F.ceil(F.count("*") * 4 / block).alias("subs"))
    return held.join(subs, "bucket").select("bucket", F.pmod(F.xxhash64("word"), "subs").alias("sub"), "node", "component").distinct()


def _meetings(rest: DataFrame, words: DataFrame, similarity: float, block: int) -> DataFrame:
    """bucket, sub, node, component, own, i, j: a row for each meeting (i, j) of two blocks of a group that the node's block ``own`` has.

    A group is a bucket, or where that has more than ``block`` texts, a part of
    it; few parts are still larger than a block. A group is dealt into blocks in
    order of component. Blocks that hold one and the same component have nothing
    to link and do not meet.
    """
    of = ["bucket", "sub"]
    low, high = F.min("component").alias("low"), F.max("component").alias("high")
    size = rest.groupBy("bucket").agg(low, high, F.count("*").alias("texts")).where("low != high").select("bucket", "texts")
    sized = staged(rest.join(size, "bucket"), narrow=True)
    groups = sized.where(F.col("texts") <= block).select("bucket", F.lit(0).cast("long").alias("sub"), "node", "component")
    hot = sized.where(F.col("texts") > block)
    if not hot.isEmpty():
        groups = staged(groups.unionByName(_parted(hot.drop("texts"), words, similarity, block)))
    several = groups.groupBy(*of).agg(low, high).where("low != high").select(*of)
    order = Window.partitionBy(*of).orderBy("component", "node")
    dealt = staged(groups.join(several, of).withColumn("own", F.floor((F.row_number().over(order) - 1) / block).cast("int")), narrow=True)
    blocks = dealt.groupBy(*of, "own").agg(low, high)
    left, right = blocks.toDF(*of, "i", "low_i", "high_i"), blocks.toDF(*of, "j", "low_j", "high_j")
    meet = left.join(right, of).where("i <= j and not (low_i = high_i and low_j = high_j and low_i = low_j)").select(*of, "i", "j")
    each = meet.withColumn("own", F.explode(F.array_distinct(F.array("i", "j"))))
    return dealt.join(each, [*of, "own"]).select(*of, "node", "component", "own", "i", "j")


class Classes:
    """Labels that merge."""

    def __init__(self, label: np.ndarray):
        self.label = np.unique(label, return_inverse=True)[1]
        self.parent = list(range(int(self.label.max()) + 1)) if len(label) else []

    def of(self, i: int) -> int:
        x, parent = int(self.label[i]), self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def merge(self, i: int, k: int) -> None:
        self.parent[self.of(i)] = self.of(k)

    def settle(self) -> np.ndarray:
        root = np.array([self.of(i) for i in np.unique(self.label, return_index=True)[1]])
        return root[self.label]


def _rest_of_buckets(rest: DataFrame, words: DataFrame, similarity: float, block: int = BUCKET) -> DataFrame:
    """Links (a, b) among what is in one bucket but not in one component.

    ``rest``: bucket, node and component of every text but the buckets' leaders,
    which have met all others. Texts of different components meet in blocks, each
    pair in the bucket of the first entry it shares; length and profile bound the
    edit distance from below, and what passes is aligned unless the two
    components are linked by then, so the links leave no candidate pair undecided.
    """
    turn = mix(np.arange(101, 101 + ENTRIES).astype(U))

    def run(table: pa.Table) -> pa.Table:
        node, side = table.column("node").to_numpy(), table.column("own").to_numpy() == table.column("i")[0].as_py()
        alone = bool(side.all())  # a block that meets itself
        classes = Classes(table.column("component").to_numpy())
        label = classes.label
        texts = [np.frombuffer(x, np.uint32) for x in table.column("words").to_pylist()]
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), U).reshape(-1, ENTRIES)
        entry = int(np.flatnonzero(mix(sketch[0] + turn).astype(np.int64) == table.column("bucket")[0].as_py())[0])
        size = np.array([len(t) for t in texts])
        profiles = np.stack([profile(t) for t in texts]).astype(np.int16 if size.max() < 30_000 else np.int32)
        coarse = profiles.reshape(len(texts), 2, 16, CLASSES // 16).sum(axis=2, dtype=profiles.dtype)
        found, left, right, allowed = [], [], [], []

        def align() -> None:
            """Decides what is gathered, a part at a time, and leaves out what earlier parts have put into one component."""
            a, b, most = np.concatenate(left), np.concatenate(right), np.concatenate(allowed)
            left.clear(), right.clear(), allowed.clear()
            for c in range(0, len(a), PART):
                now = classes.settle()
                part = c + np.flatnonzero(now[a[c : c + PART]] != now[b[c : c + PART]])
                good = part[edit_distances([(texts[a[p]], texts[b[p]]) for p in part], most[part]) <= most[part]]
                for p in good:
                    if classes.of(a[p]) != classes.of(b[p]):
                        classes.merge(a[p], b[p])
                        found.append((node[a[p]], node[b[p]]))

        for i in np.flatnonzero(side):
            others = np.arange(i + 1, len(node)) if alone else np.flatnonzero(~side)
            others = others[label[others] != label[i]]
            most = ((1 - similarity) * np.maximum(size[others], size[i]) + 1e-9).astype(np.int64)
            others, most = others[(near := np.abs(size[others] - size[i]) <= most)], most[near]
            near = ~(sketch[others, :entry] == sketch[i, :entry]).any(axis=1)  # the others met before
            others, most = others[near], most[near]
            far = np.abs(coarse[others] - coarse[i]).sum(axis=2, dtype=np.int32)  # fewer classes first, which bound from below as well
            others, most = others[(near := np.maximum(far[:, 0] / 2, far[:, 1] / 4) <= most)], most[near]
            others, most = others[(near := least_edits(profiles[others], profiles[i]) <= most)], most[near]
            left.append(np.full(len(others), i)), right.append(others), allowed.append(most)
            if sum(map(len, left)) > GATHERED:
                align()
        if left:
            align()
        return pa.table({"a": pa.array([p[0] for p in found], pa.int64()), "b": pa.array([p[1] for p in found], pa.int64())})

    met = _meetings(rest, words, similarity, block).join(words, "node")
    return staged(met.groupBy("bucket", "sub", "i", "j").applyInArrow(run, "a bigint, b bigint"))


def _marks(batch: pa.RecordBatch, total: np.ndarray) -> None:
    value = mix(np.asarray(batch.column(0), np.int64).astype(U)) >> U(64 - 22)
    total[np.unique(value.astype(np.int64))] = 1


def _marked(nodes: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    bit = (mix(nodes.astype(U)) >> U(64 - 22)).astype(np.int64)
    return (bitmap[bit >> 3] >> (7 - (bit & 7)) & 1).astype(bool)


def near_classes(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(doc_id, node) of every row, (node, component) of every node that has a near duplicate, and a
    bitmap of fixed size that marks every node with near or equal texts, and a few others."""
    rows = staged(docs.select("doc_id", whole_text().alias("text")).mapInArrow(tidy(_sketched), ROWS))
    nodes = rows.groupBy("node").agg(F.first("sketch").alias("sketch"))
    entries = nodes.mapInArrow(tidy(_entries), "bucket bigint, turned bigint, node bigint")
    # leader and last of a bucket in its entry's order: equal where it has one text
    led = entries.groupBy("bucket").agg(F.min(F.struct("turned", "node")).alias("low"), F.max("turned").alias("high")).where("low.turned != high").select("bucket", F.col("low.node").alias("leader"))
    members = staged(entries.select("bucket", "node").join(led, "bucket"), narrow=True)
    candidates = staged(members.where("node != leader").groupBy("node", "leader").agg(F.count("*").alias("times")), narrow=True)

    copied = rows.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node")
    bitmap = np.packbits(gathered(members.select("node").union(copied), _marks, FILTER_BITS) > 0)  # where it is full, more rows pass

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            nodes, out = [], []
            for a, b in slices(offsets, 1 << 20):
                part, bounds = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                words, row = normal_words(part, bounds)
                at = row_bounds(row, b - a)
                some = np.flatnonzero(np.diff(at))
                own = np.array([node_of(words[at[i] : at[i + 1]], b"") for i in some], np.int64)
                for i in np.flatnonzero(_marked(own, bitmap)):
                    nodes.append(int(own[i]))
                    out.append((words[at[some[i]] : at[some[i] + 1]] >> U(32)).astype(np.uint32).tobytes())
            found = pa.table({"node": pa.array(nodes, pa.int64()), "words": pa.array(out, pa.binary())}).group_by("node", use_threads=False).aggregate([("words", "first")])
            yield from pa.table({"node": found.column("node"), "words": found.column("words_first")}).combine_chunks().to_batches()

    words = docs.select(whole_text().alias("text")).mapInArrow(tidy(chosen), "node bigint, words binary")
    words = staged(words.groupBy("node").agg(F.first("words").alias("words")).join(nodes, "node"))

    # each text with the leader it shares most buckets with, then what that leaves apart
    best = candidates.groupBy("node").agg(F.max(F.struct("times", F.xxhash64("leader"), "leader")).alias("best")).select(*_pair(F.col("node"), F.col("best.leader"))).distinct()
    found = components(_verified(best, words, similarity))

    def apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
        ca, cb = found.select(F.col("node").alias("a"), F.col("component").alias("ca")), found.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        return pairs.join(ca, "a", "left").join(cb, "b", "left").where("ca is null or cb is null or ca != cb").select("a", "b")

    more = candidates.select(*_pair(F.col("node"), F.col("leader"))).distinct()
    found = joined(found, _verified(apart(more.join(best, ["a", "b"], "left_anti"), found), words, similarity))

    named = members.where("node != leader").join(found, "node", "left")
    rest = named.select("bucket", "node", F.coalesce("component", "node").alias("component"))
    found = joined(found, _rest_of_buckets(rest, words, similarity))
    discard(members, candidates, words)
    return rows.select("doc_id", "node"), found, bitmap


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class) and class_size of every row.

    A class holds texts linked by chains of near duplicates, equal texts
    included. Null text is empty, and texts without any word are near only to
    equal ones; texts of fewer than five words have one k-mer of them all; null
    ids are never the least unless the class has no other; repeated rows count
    each; an empty table gives an empty result; further columns are ignored.
    """
    rows, found, _ = near_classes(docs, similarity)
    placed = rows.join(found, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component"))
    sizes = staged(placed.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")), narrow=True)  # apart from the join, which can then split a large class
    return placed.join(sizes, "component").select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents less near duplicates: of each class the row of least doc_id stays, of equal ids the one of least text.

    All columns stay. Rows without near or equal texts pass by without a shuffle.
    """
    _, found, bitmap = near_classes(docs, similarity)
    rows = docs.select(whole_rows(docs).alias("doc"), "doc_id", whole_text().alias("text"))
    schema = rows.select("doc", "doc_id", "text").schema.add("node", "long").add("marked", "boolean")

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            nodes = []
            for a, b in slices(offsets, 1 << 20):
                part, bounds = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                words, row = normal_words(part, bounds)
                at = row_bounds(row, b - a)
                nodes += [node_of(words[at[i] : at[i + 1]], part[bounds[i] : bounds[i + 1]].tobytes()) for i in range(b - a)]
            nodes = np.array(nodes, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes), pa.array(_marked(nodes, bitmap))], names=["doc", "doc_id", "text", "node", "marked"])

    flagged = rows.mapInArrow(tidy(flag), schema)
    placed = flagged.where("marked").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = F.min_by("doc", F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text")))
    kept = placed.groupBy("component").agg(first.alias("doc"))
    return flagged.where("not marked").select("doc.*").union(kept.select("doc.*"))
