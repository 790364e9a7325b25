"""Most similar vectors for every vector: exact, or by a forest of hash prefixes where a least similarity is asked for.

Without `min_sim` every vector is compared with every other: blocks of at most about `ROWS_A_BLOCK` rows meet all rows as a stream, one
32-bit matrix product a batch; what reaches a row's k-th best so far is compared again in 64 bits. The cost is
quadratic in the number of distinct vectors, with no loss.

With `min_sim` each of `TREES` trees gives a vector a string of `BITS` random-hyperplane signs and keeps the strings as sorted arrays. A
search descends every tree to the longest prefix it shares with others and then ascends all trees in step, one bit at a time, until the rows under
its prefixes are `ENOUGH` together; these are its candidates. Here every row is a query, so both ways are one pass each over the arrays:

1. Down: a tree's array is cut into units of about `UNIT` rows between prefixes of `HEAD` bits, whose counts every task knows (at most
   TREES * 2^HEAD numbers); a prefix with more rows is cut by further bits. Runs of equal prefixes in a unit's sorted array give how many rows share
   each length with a row, up to `LEVELS` lengths; these profiles are summed over the trees.
2. Up: the longest length at which a row's sum reaches `ENOUGH` is where its ascent ends, in all trees alike. The row goes to every unit
   its prefix of that length touches, so no bound between units hides a neighbour, and is compared with the rows under the prefix, found by binary
   search, in one matrix product a prefix over 8-bit copies.

A row whose ascent ends on more than `DENSE` times `ENOUGH` rows lies in a cluster that its strings can't tell apart, and a unit that stays above
4 * UNIT rows is one. A row that meets more than a `CROWD`th of a tree's share of `ENOUGH` within `NEAR` of min_sim has its ascent end inside a
cluster, among candidates of which others may be nearer. Such rows are compared with every other vector as above. The rest keep all their candidates, which are compared
exactly on the full vectors.

Equal vectors are one class: they collapse to one row a batch before the shuffle, and the result is expanded from the
smallest ids of the class, large classes in slices, so a class that holds a third of all rows costs its number of rows and no more.
Recall against brute force: see the README and tests.

Defined cases: vectors that are null, of another length, not finite or all zero are no part of the search; similarity is
rounded to 6 digits, ties go to the smaller id; repeated rows of one id count once; fewer than k others give fewer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.runtime import cut

TREES, BITS, HEAD, LEVELS, SLACK = 8, 60, 16, 15, 0.01
ENOUGH, DENSE, UNIT, SLICE, CROWD, NEAR = 1280, 16, 100_000, 200_000, 6, 0.15
ROWS_A_BLOCK, BLOCKS = 131_072, 4
LANE = 21  # bits of a count; three counts in a long, each at most 2^17 a tree
MARGIN = 1e-5  # more than a 32-bit product of unit vectors errs


def usable(vector: Column, dims: int) -> Column:
    """True for `dims` finite numbers that aren't all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dims) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float64)
    flat /= np.abs(flat).max(axis=1, keepdims=True)  # keeps squares of extreme values finite
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def hash_strings(unit: np.ndarray, trees: int, bits: int, seed: int) -> np.ndarray:
    """(rows, trees) of hash strings as integers whose order is the strings' order."""
    planes = np.random.default_rng(seed).standard_normal((unit.shape[1], trees * bits))
    signs = (unit @ planes > 0).reshape(len(unit), trees, bits)
    half = bits // 2
    weights = [(1 << np.arange(n)[::-1]).astype(np.float64) for n in (half, bits - half)]
    high, low = signs[:, :, :half] @ weights[0], signs[:, :, half:] @ weights[1]
    return (high.astype(np.int64) << (bits - half)) | low.astype(np.int64)


def _plant(dims: int, trees: int, bits: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column(0).to_numpy()
            _, one = np.unique(key, return_index=True)  # equal vectors once a batch
            unit = _matrix(b.column(1), dims)[one]
            small = np.rint(unit * (127 / np.abs(unit).max(axis=1, keepdims=True))).astype(np.int8)
            blob = pa.Array.from_buffers(pa.binary(dims), len(one), [None, pa.py_buffer(small.tobytes())]).cast(pa.binary())
            codes = pa.ListArray.from_arrays(pa.array(np.arange(0, len(one) * trees + 1, trees), pa.int32()), pa.array(hash_strings(unit, trees, bits, seed).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(key[one]), codes, blob], names=["key", "codes", "small"])

    return run


class Units:
    """How the trees' arrays are cut: counts of the prefixes of HEAD bits, and the units between them."""

    def __init__(self, counts: np.ndarray, bits: int, unit: int):
        self.counts, self.bits = counts, bits  # (trees, 2^HEAD)
        self.sums = np.concatenate([np.zeros((len(counts), 1), np.int64), np.cumsum(counts, axis=1)], axis=1)
        extra = np.ceil(np.log2(np.maximum(1, counts / unit))).astype(np.int64)
        self.extra = np.minimum(extra, bits - HEAD)  # further bits by which a full prefix is cut
        size = np.where(self.extra > 0, unit, counts)
        number = np.zeros_like(counts)
        at = 0
        for t in range(len(counts)):  # consecutive small prefixes share a unit, a full one has its own
            sums, full = np.cumsum(size[t]), self.extra[t] > 0
            group = sums // unit + 2 * np.cumsum(full) - full
            number[t] = at + np.unique(group, return_inverse=True)[1]
            at = int(number[t].max()) + 1
        self.number = number

    def unit(self, tree: np.ndarray | int, code: np.ndarray) -> np.ndarray:
        """Number of each code's unit; further bits stand above bit 32."""
        head = code >> (self.bits - HEAD)
        extra = self.extra[tree, head]
        return self.number[tree, head] + (((code >> (self.bits - HEAD - extra)) & ((1 << extra) - 1)) << 32)

    def rows(self, tree: int, code: np.ndarray, level: int) -> np.ndarray:
        """Rows that share the first `level` <= HEAD bits with each code."""
        low = code >> (self.bits - level) << (HEAD - level)
        return self.sums[tree, low + (1 << (HEAD - level))] - self.sums[tree, low]

    def beyond(self, tree: int, code: np.ndarray, level: np.ndarray) -> np.ndarray:
        """Places of the codes whose first `level` bits hold rows of several units; a level below 0 asks for nothing."""
        head = code >> (self.bits - HEAD)
        wide = np.clip(HEAD - level, 0, HEAD)
        low = head >> wide << wide
        apart = self.number[tree, low] != self.number[tree, low + (1 << wide) - 1]
        return np.flatnonzero((level >= 0) & (apart | (level < HEAD + self.extra[tree, head]) & (self.extra[tree, head] > 0)))

    def touched(self, tree: int, code: int, level: int) -> np.ndarray:
        """Units that hold rows under the first `level` bits of a code."""
        head = code >> (self.bits - HEAD)
        if level >= HEAD + self.extra[tree, head]:
            return self.unit(np.array([tree]), np.array([code]))
        if level < HEAD:
            low = code >> (self.bits - level) << (HEAD - level)
            heads = np.arange(low, low + (1 << (HEAD - level)))
            heads = heads[self.counts[tree, heads] > 0]
            plain = np.unique(self.number[tree, heads[self.extra[tree, heads] == 0]])
            full = [self.number[tree, h] + (np.arange(1 << self.extra[tree, h]) << 32) for h in heads[self.extra[tree, heads] > 0]]
            return np.concatenate([plain, *full])
        extra, more = int(self.extra[tree, head]), level - HEAD
        low = ((code >> (self.bits - level)) & ((1 << more) - 1)) << (extra - more)
        return self.number[tree, head] + (np.arange(low, low + (1 << (extra - more))) << 32)


def _descend(shared, first: int):
    """Profiles of the rows of one unit: how many rows of the tree share each length with a row, three lengths in a long."""

    def run(table: pa.Table) -> pa.Table:
        units: Units = shared.value
        tree, code, key = (table[c].to_numpy() for c in ("tree", "code", "key"))
        order = np.lexsort((key, code))
        order = order[np.concatenate([[True], (np.diff(key[order]) != 0) | (np.diff(code[order]) != 0)])]
        code, key, t = code[order], key[order], int(tree[0])
        most = (1 << LANE) // (2 * len(units.counts))
        lanes = [np.zeros(len(code), np.int64) for _ in range(-(-LEVELS // 3))]
        for k in range(LEVELS):
            level = first + k
            if level <= HEAD:
                n = units.rows(t, code, level)
            else:
                head = code >> (units.bits - level)
                start = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
                run_of = np.diff(np.concatenate([start, [len(code)]]))
                n = np.repeat(run_of, run_of)
                cut_off = level < HEAD + units.extra[t, code >> (units.bits - HEAD)]
                n = np.where(cut_off, most, n)  # a full prefix that several units share
            lanes[k // 3] += np.minimum(n, most) << (LANE * (k % 3))
        return pa.table([pa.array(key), *map(pa.array, lanes)], names=["key", *(f"c{i}" for i in range(len(lanes)))])

    return run


def _spread(shared, keep_small: bool):
    """Rows of the trees by unit; with small copies also a visit to every other unit that a row's prefix touches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units: Units = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column(0).to_numpy()
            codes = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
            for t in range(codes.shape[1]):
                code = codes[:, t]
                unit = units.unit(np.full(len(code), t), code)
                tree = np.full(len(code), t, np.int32)
                if not keep_small:
                    yield pa.RecordBatch.from_arrays([pa.array(unit), pa.array(tree), pa.array(code), pa.array(key)], names=["unit", "tree", "code", "key"])
                    continue
                level = b.column(3).to_numpy()
                who, where = [np.arange(len(code))], [unit]
                for i in units.beyond(t, code, level):
                    other = units.touched(t, int(code[i]), int(level[i]))
                    other = other[other != unit[i]]
                    who.append(np.full(len(other), i))
                    where.append(other)
                who, at = np.concatenate(who), np.concatenate(where)
                home = np.arange(len(who)) < len(code)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at), pa.array(tree[who]), pa.array(code[who]), pa.array(key[who]), b.column(2).take(pa.array(who)), pa.array(level[who]), pa.array(home)],
                    names=["unit", "tree", "code", "key", "small", "level", "home"],
                )

    return run


def _ascend(dims: int, bits: int, trees: int, least: float):
    """Similar pairs of one unit: each row and the unit's rows under its prefix; a row in a crowd comes with itself too."""
    crowd = max(1, ENOUGH // (trees * CROWD))

    def run(table: pa.Table) -> pa.Table:
        code, key, level, home = (table[c].to_numpy(zero_copy_only=False) for c in ("code", "key", "level", "home"))
        blob = table["small"].combine_chunks()
        blob = blob.chunk(0) if isinstance(blob, pa.ChunkedArray) else blob
        unit = np.frombuffer(blob.buffers()[2], np.int8, count=len(code) * dims, offset=blob.offset * dims).reshape(-1, dims)
        order = np.lexsort((key, code, ~home))
        order = order[np.concatenate([[True], (np.diff(key[order]) != 0) | (np.diff(home[order].astype(np.int8)) != 0)])]
        code, key, level, home, unit = code[order], key[order], level[order], home[order], unit[order].astype(np.float32)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        here = int(home.sum())
        ask = np.flatnonzero(level >= 0)
        shift = bits - level[ask]
        low = code[ask] >> shift << shift
        lo = np.searchsorted(code[:here], low, "left")
        hi = np.searchsorted(code[:here], low + ((np.int64(1) << shift) - 1), "right")
        by = np.lexsort((hi, lo))
        ask, lo, hi = ask[by], lo[by], hi[by]
        heads = np.flatnonzero(np.concatenate([[True], (np.diff(lo) != 0) | (np.diff(hi) != 0)])) if len(ask) else np.zeros(0, int)
        ones, twos = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, z in zip(heads, [*heads[1:], len(ask)], strict=True):
            rows = unit[lo[a] : hi[a]].T
            for c in range(a, z, 4096):
                mine = ask[c : min(z, c + 4096)]
                sim = unit[mine] @ rows
                full = key[mine[(sim >= least - NEAR).sum(axis=1) > crowd + 1]]  # itself stands among them
                ones.append(full)
                twos.append(full)
                r, col = np.nonzero(sim >= least)
                x, y = key[mine[r]], key[lo[a] + col]
                ones.append(np.minimum(x, y)[x != y])
                twos.append(np.maximum(x, y)[x != y])
        both = np.unique(np.stack([np.concatenate(ones), np.concatenate(twos)], axis=1), axis=0)
        return pa.table([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    return run


def _compare(dims: int, k: int):
    """The k most similar classes of each row of a block; the rows arrive by block, each block's own rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, own, best = None, [], None
        for batch in batches:
            number = batch.column(0).to_numpy()
            for n in np.unique(number):
                part = batch.filter(pa.array(number == n))
                if n != block:
                    if best is not None:
                        yield best.result()
                    block, own, best = n, [], None
                base = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
                if not base.all():
                    own.append(part.filter(pa.array(~base)))
                if base.any():
                    best = best or _Best(pa.Table.from_batches(own), dims, k)
                    best.meet(part.filter(pa.array(base)))
        if best is not None:
            yield best.result()

    return run


class _Best:
    """Running k best of a block's rows, by similarity rounded to 6 digits, then by the class's smallest id."""

    def __init__(self, rows: pa.Table, dims: int, k: int):
        self.dims, self.k = dims, k
        self.key, self.unit = rows["key"].to_numpy(), _matrix(rows["v"].combine_chunks(), dims)
        self.single = self.unit.astype(np.float32)
        self.least = np.full(len(self.key), -2, np.float32)
        self.row, self.to, self.sim = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.name = None

    def meet(self, rows: pa.RecordBatch) -> None:
        key, unit = rows.column(2).to_numpy(), _matrix(rows.column(3), self.dims)
        name = np.array(rows.column(4).to_pylist())
        single, found = unit.astype(np.float32).T, []
        for a in range(0, len(self.key), 512):
            sim = self.single[a : a + 512] @ single
            least = self.least[a : a + 512]
            if sim.shape[1] > self.k and (least == -2).any():  # the first batch: its own k-th best, the row itself left out, bounds the rest
                least = np.maximum(least, np.partition(sim, -self.k - 1, axis=1)[:, -self.k - 1] - MARGIN)
            r, c = np.nonzero(sim >= least[:, None])
            other = self.key[a + r] != key[c]
            found.append((a + r[other], c[other]))
        r, c = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(r):
            return
        sim = np.concatenate([np.einsum("ij,ij->i", self.unit[r[i : i + 100_000]], unit[c[i : i + 100_000]]) for i in range(0, len(r), 100_000)])
        sim = np.round(np.clip(sim, -1, 1), 6)
        names = name[c] if self.name is None else np.concatenate([self.name, name[c]])
        row, to, sim = np.concatenate([self.row, r]), np.concatenate([self.to, key[c]]), np.concatenate([self.sim, sim])
        order = np.lexsort((names, -sim, row))
        rank = np.arange(len(order)) - np.searchsorted(row[order], row[order])
        order, rank = order[rank < self.k], rank[rank < self.k]
        self.row, self.to, self.sim, self.name = row[order], to[order], sim[order], names[order]
        last = rank == self.k - 1
        self.least[self.row[last]] = self.sim[last] - MARGIN

    def result(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.key[self.row]), pa.array(self.to), pa.array(self.sim)], names=["key", "to", "sim"])


def _exact(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sim = np.einsum("ij,ij->i", _matrix(b.column(2), dims), _matrix(b.column(3), dims))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.round(np.clip(sim, -1, 1), 6))], names=["a", "b", "sim"])

    return run


def _vectors(documents: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """(id, key, v): key is the hash of the vector; -0.0 equals 0.0."""
    v = F.transform(vector, lambda x: x.cast("float") + F.lit(0.0).cast("float"))
    usable_rows = documents.filter(F.col(key).isNotNull() & usable(F.col(vector), dims))
    return usable_rows.select(F.col(key).alias("id"), v.alias("v")).withColumn("key", F.xxhash64("v"))


def ascents(planted: DataFrame, shared, n: int, trees: int) -> DataFrame:
    """(key, level, rows): where each class's ascent ends, and how many rows of all trees lie under its prefixes there."""
    first = max(1, min(BITS - LEVELS, round(math.log2(max(2, n * trees / ENOUGH))) - 5))
    lanes = [f"c{i}" for i in range(-(-LEVELS // 3))]
    spread = planted.select("key", "codes").mapInArrow(_spread(shared, False), "unit long, tree int, code long, key long")
    profiles = spread.groupBy("unit").applyInArrow(_descend(shared, first), "key long, " + ", ".join(f"{c} long" for c in lanes))
    sums = profiles.groupBy("key").agg(*(F.sum(c).alias(c) for c in lanes))
    count = [F.shiftright(lanes[k // 3], LANE * (k % 3)).bitwiseAND(F.lit((1 << LANE) - 1)) for k in range(LEVELS)]
    level, rows = F.lit(first), count[0]  # where even the shortest prefixes hold fewer, they are all there is
    for k in range(1, LEVELS):
        level, rows = F.when(count[k] >= ENOUGH, first + k).otherwise(level), F.when(count[k] >= ENOUGH, count[k]).otherwise(rows)
    return sums.select("key", level.cast("int").alias("level"), rows.alias("rows"))


def candidate_pairs(rows: DataFrame, dims: int, trees: int, min_sim: float, seed: int = 20) -> tuple[DataFrame, DataFrame]:
    """(a, b), a < b: distinct classes that some tree brings together; (key): classes to be compared with all others."""
    planted = cut(rows.select("key", "v").mapInArrow(_plant(dims, trees, BITS, seed), "key long, codes array<long>, small binary"))
    heads = planted.select(F.posexplode("codes").alias("tree", "code")).groupBy("tree", F.shiftright("code", BITS - HEAD).alias("head")).agg(F.count("*").alias("n"))
    counts = np.zeros((trees, 1 << HEAD), np.int64)
    got = heads.toPandas()  # at most TREES * 2^HEAD rows
    counts[got["tree"].to_numpy(np.int64), got["head"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    shared = rows.sparkSession.sparkContext.broadcast(Units(counts, BITS, UNIT))
    ends = ascents(planted, shared, int(counts[0].sum()), trees)
    # units that further bits don't part
    full = planted.select("key", "codes").mapInArrow(_spread(shared, False), "unit long, tree int, code long, key long").groupBy("unit").agg(F.count("*").alias("n")).filter(F.col("n") > 4 * UNIT) if (counts > UNIT).any() else None
    ends = cut(ends.select("key", F.when(F.col("rows") <= DENSE * ENOUGH, F.col("level")).otherwise(-1).alias("level")))
    dense = ends.filter("level < 0").select("key")
    spread = planted.join(ends, "key").select("key", "codes", "small", "level").mapInArrow(_spread(shared, True), "unit long, tree int, code long, key long, small binary, level int, home boolean")
    if full is not None:
        full = cut(full)
        if full.limit(1).count():
            lost = planted.select("key", "codes").mapInArrow(_spread(shared, False), "unit long, tree int, code long, key long").join(full, "unit", "left_semi").select("key")
            dense = dense.unionByName(lost).distinct()
            spread = spread.join(full, "unit", "left_anti")
    pairs = cut(spread.groupBy("unit").applyInArrow(_ascend(dims, BITS, trees, min_sim - SLACK), "a long, b long").distinct())
    return pairs.filter("a < b"), cut(dense.unionByName(pairs.filter("a = b").select(F.col("a").alias("key"))).distinct())


def exact_lists(some: DataFrame, every: DataFrame, n: int, dims: int, k: int) -> DataFrame:
    """(key, to, sim): for the n classes of `some` the k most similar of `every`, both (key, v, id), by comparing all."""
    blocks = max(1, math.ceil(n / ROWS_A_BLOCK), min(BLOCKS, n // 4096))
    number = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(blocks)).cast("int")
    each = every.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    both = some.select(number.alias("block"), F.lit(False).alias("base"), "key", "v", "id").unionByName(each.select("block", F.lit(True).alias("base"), "key", "v", "id"))
    laid = both.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "base")
    return laid.mapInArrow(_compare(dims, k), "key long, to long, sim double")


def nearest(documents: DataFrame, k: int = 5, dims: int = 64, min_sim: float | None = None, trees: int = TREES, key: str = "id", vector: str = "vector") -> DataFrame:
    """(id, other, sim, rank): for each document with a usable vector its k most similar others, best first.

    With min_sim only others at least so similar come out; rank still counts from the best."""
    rows = _vectors(documents, key, vector, dims)
    one = rows.groupBy("key").agg(F.first("v").alias("v"), F.min("id").alias("id"))
    if min_sim is None:
        one = cut(one)
        both = exact_lists(one, one, one.count(), dims, k)
    else:
        pairs, dense = candidate_pairs(rows, dims, trees, min_sim)
        near = (
            pairs.join(one.select(F.col("key").alias("a"), F.col("v").alias("va")), "a")
            .join(one.select(F.col("key").alias("b"), F.col("v").alias("vb")), "b")
            .select("a", "b", "va", "vb")
            .mapInArrow(_exact(dims), "a long, b long, sim double")
        )
        near = cut(near.filter(F.col("sim") >= min_sim))
        both = near.select(F.col("a").alias("key"), F.col("b").alias("to"), "sim").unionByName(near.select(F.col("b").alias("key"), F.col("a").alias("to"), "sim"))
        n = dense.count()
        if n:
            one = cut(one)
            both = both.unionByName(exact_lists(one.join(dense, "key", "left_semi"), one, n, dims, k).filter(F.col("sim") >= min_sim)).distinct()
    # the k + 1 smallest ids of each class, salted first
    ids = cut(rows.select("key", "id").distinct())
    order = Window.partitionBy("key", "salt").orderBy("id")
    few = ids.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    few = few.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("id"))).filter(F.col("r") <= k + 1)
    smallest = cut(few.groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids")))  # at most k + 1 ids
    # k classes nearer, or as near with smaller ids, leave no place for a further class
    ranked = both.join(smallest.withColumnRenamed("key", "to"), "to").withColumn(
        "r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("sim"), F.element_at("ids", 1)))
    )
    lists = ranked.filter(F.col("r") <= k).select("key", "sim", "ids")
    own = smallest.filter(F.size("ids") > 1).select("key", F.lit(1.0).alias("sim"), "ids")
    offers = lists.unionByName(own).groupBy("key").agg(F.collect_list(F.struct("sim", "ids")).alias("offers"))  # at most k + 1 lists
    # negative similarity first, so that the natural order of the structs is best first
    flat = F.flatten(F.transform("offers", lambda o: F.transform(o["ids"], lambda i: F.struct((-o["sim"]).alias("far"), i.alias("other")))))
    best = F.slice(F.filter(F.sort_array(flat), lambda x: x["other"] != F.col("id")), 1, k)
    on = ["key"]
    wide = ids.groupBy("key").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices")).filter("slices > 1")
    large = wide.count()
    if large:  # classes of very many rows meet their offers in slices
        wide = F.broadcast(wide) if large <= 100_000 else wide
        ids = ids.join(wide, "key", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"), F.lit(0))).drop("slices")
        offers = offers.join(wide, "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1))).drop("slices")
        on = ["key", "salt"]
    return (
        ids.join(offers, on)
        .select("id", F.posexplode(best).alias("pos", "x"))
        .select("id", F.col("x.other").alias("other"), (-F.col("x.far")).alias("sim"), (F.col("pos") + 1).alias("rank"))
    )


def similar_pairs(documents: DataFrame, k: int = 5, min_sim: float = 0.85, **kw) -> DataFrame:
    """Distinct (id_a, id_b), id_a < id_b: one is among the other's k most similar, and they are at least so similar."""
    n = nearest(documents, k, min_sim=min_sim, **kw)
    return n.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
