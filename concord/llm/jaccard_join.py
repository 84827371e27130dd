"""Exact Jaccard join of word 5-gram sets in metric space.

The Jaccard distance d = 1 - J is a metric; documents link at d <= 0.2.

1. Equal sets are one node, known by a 64-bit hash.
2. Pivots of the first level are one-shingle sets {s}: d(x, {s}) = 1 - 1/|x| if x
   holds s, else 1.  A document's nearest pivots are its own shingles; a fixed
   random order ranks them, and the window that the triangle inequality leaves
   to partners reaches over the first |x| - ceil(0.8 |x|) + k of them: partners
   then share at least min(k) pivots.  Documents that share fewer pivots with
   others than a partner must (``least_shared``) leave; no text moves for that.
3. The survivors' pivots give regions: documents that share enough pivots, of at
   most ``CROWDED`` survivors each, and fit in size are of one region.  A pivot
   with more survivors only counts if one of its documents has too few other
   pivots to be found by them (more than k - 1 of its pivots are crowded), and
   only for documents that fit such a document's size.
4. Regions are joined exactly, each in a task (``join_region``): shingles that
   only one document has rule documents out; the others become pivot documents one
   after another, smallest components first.  A pivot is linked to its ball of
   radius 0.2, and its distances to all give windows: documents of different
   components that a window |d(x, p) - d(y, p)| <= 0.2 tells apart need not meet.
5. Regions over ``REGION_SHINGLES`` are split first.  Linked sizes differ by a factor
   of 1.25 at most, so a region falls into bands of size, each document in two of
   them.  Bands that are still over are split by balls around pivot documents, taken
   in turn: a document within 0.6 of a pivot is copied to the pivot's cell, one
   within 0.4 goes no farther, and what is left is a cell too; distances of linked
   documents differ by at most 0.2, so each linked pair meets in a cell.  Cells are
   split again by other pivots while that makes them smaller.  Links then are put
   together by a distributed component search.

No pairs leave a task but links to a component's root.

Defined cases: documents without words have an empty set, link with nothing and
are their own component; with one to four words the whole sequence is the only
shingle; component_id is the smallest doc_id, null only if all are null;
repeated rows belong to one node; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .common import map_batches, stored
from .components import components

SHINGLE = 5
CROWDED = 16
SPREAD = 1000                      # nodes of a crowded pivot in one place
SHORT, MIDDLE = 100, 400           # shingles: documents with all, with two fifths of their shingles as pivots
REGION_SHINGLES = 8_000_000        # in a task: 64 MB of hashes, some 400 MB while they are sorted
PIVOTS, MEET = 8, 32               # pivots that are kept, and documents that are met at once, in a region's task
BAND = 1.2500001                   # the factor between bands of size, just over that of linked sizes
SPLIT, MOST_SPLIT = 16, 256        # pivot documents for each part of a region that is split, and in all
NEAR, FAR = 0.4, 0.6               # a pivot's documents: alone its own, and copied to it
SMALLER = 0.9                      # a split counts if no cell has more of its region
LAST = (1 << 63) - 1
PREFIX = "__jaccard_"


def sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows in order of (row, hash), rows' bounds, and set hashes."""
    w = W.find(column, W.SPACE, lower=True)
    h, row, n = w.hashes(), w.row, len(w.first) - 1
    got, first = W.windows(h, row, SHINGLE)
    shingle, owner = [got], [row[first]]
    for k in range(1, SHINGLE):                                # short texts: their whole sequence
        got, first = W.windows(h, row, k)
        whole = w.counts[row[first]] == k
        shingle.append(W.mix(got[whole] + np.uint64(k)))
        owner.append(row[first][whole])
    shingle, owner = np.concatenate(shingle), np.concatenate(owner)
    by = np.lexsort((shingle, owner))
    shingle, owner = shingle[by], owner[by]
    new = np.ones(len(by), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])
    shingle, owner = shingle[new], owner[new]
    edge = np.searchsorted(owner, np.arange(n + 1))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(shingle))])
    node = W.mix(total[edge[1:]] - total[edge[:-1]] + np.diff(edge).astype(np.uint64))
    return shingle, edge, node.view(np.int64)


def need(n):
    """Shingles that a partner shares at least: ceil(0.8 n)."""
    return (4 * n + 4) // 5


def extra(n):
    """k: pivots that partners of documents of n shingles share.  Short documents
    afford more pivots, up to all their shingles."""
    return np.where(n <= SHORT, need(n), np.where(n <= MIDDLE, 1 + n // 5, 1 + 3 * n // 50))


def extra_col(n: Column) -> Column:
    return F.when(n <= SHORT, F.floor((4 * n + 4) / 5)).when(n <= MIDDLE, 1 + F.floor(n / 5)).otherwise(1 + F.floor(3 * n / 50))


def least_shared(n: Column) -> Column:
    """Pivots that a document shares with any partner: the least k of the sizes
    that a partner may have, which rises but where a class of sizes begins."""
    low, high = F.floor((4 * n + 4) / 5), F.floor(5 * n / 4)
    out = F.least(extra_col(n), extra_col(low))
    for begin in (SHORT + 1, MIDDLE + 1):
        out = F.when((low < begin) & (high >= begin), F.least(out, extra_col(F.lit(begin)))).otherwise(out)
    return out


def nodes(docs: DataFrame) -> DataFrame:
    """(id, print, node, n) of docs (id, print, text)."""

    def run(batches):
        for batch in batches:
            for part in W.slices(batch):
                _, edge, node = sets(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("print"), pa.array(node), pa.array(np.diff(edge).astype(np.int64))], names=["id", "print", "node", "n"])

    return map_batches(docs, run, "id long, print long, node long, n long")


def pivots(docs: DataFrame) -> DataFrame:
    """(key, pivot, node, n): each node's pivots, once per partition.

    A pivot that several nodes of a slice of the task's texts have is known to be shared:
    those rows name the pivot and are dealt by keys of their own, and one row stands for
    them under the pivot.  A pivot that very many nodes have so brings a row per slice,
    not per node, to one place.  The other rows' pivot is null: it is the key."""

    def run(batches):
        done: set[int] = set()                                 # nodes of this partition
        for batch in batches:
            for part in W.slices(batch):
                shingle, edge, node = sets(part.column("text"))
                n = np.diff(edge)
                fresh = np.zeros(len(n), bool)
                for r, x in enumerate(node.tolist()):
                    if n[r] and x not in done:
                        done.add(x)
                        fresh[r] = True
                take = np.where(fresh, np.minimum(n, n - need(n) + extra(n)), 0)
                at = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take) + np.repeat(edge[:-1], take)
                pivot, node, n = shingle[at], np.repeat(node, take), np.repeat(n, take).astype(np.int32)
                _, first, own, count = np.unique(pivot, return_index=True, return_inverse=True, return_counts=True)
                known = count[own] > 1
                key = np.where(known, pivot ^ W.mix(node.view(np.uint64)), pivot)
                stands = first[count > 1]
                more = lambda a, b: np.concatenate([a, b[stands]])                         # noqa: E731
                named = pa.array(more(pivot, pivot).view(np.int64), mask=more(~known, known))
                yield pa.RecordBatch.from_arrays([pa.array(more(key, pivot).view(np.int64)), named, pa.array(more(node, node)), pa.array(more(n, n))],
                                                 names=["key", "pivot", "node", "n"])

    return map_batches(docs, run, "key long, pivot long, node long, n int")


def survivors(docs: DataFrame) -> DataFrame:
    """(node, n, pivots): nodes that share enough pivots with others."""
    own = Window.partitionBy("key", "pivot")
    shared = pivots(docs).withColumns({"lo": F.min("node").over(own), "hi": F.max("node").over(own)}).where("pivot IS NOT NULL OR lo <> hi")
    return shared.groupBy("node").agg(F.first("n").alias("n"), F.collect_set(F.coalesce("pivot", "key")).alias("pivots")).where(
        F.size("pivots") >= least_shared(F.col("n")))


def regions(kept: DataFrame) -> DataFrame:
    """(node, region) of the survivors that may link: components of these edges.

    Pairs that meet at pivots of few survivors, are of fitting sizes, and share as
    many of them as a linked pair must: min(k), less the crowded pivots that they
    may share besides.  At a crowded pivot, all documents that fit the size of a
    crowded document are connected to one of them."""
    each = kept.select("node", F.col("n").cast("long").alias("n"), F.explode("pivots").alias("pivot"))
    # counted map-side and stored: a join back that the planner can split at hot pivots
    often = stored(each.groupBy("pivot").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "jaccard-often")
    each = each.join(often, "pivot")
    each = each.withColumn("busy", F.sum((F.col("df") > CROWDED).cast("int")).over(Window.partitionBy("node")))
    each = stored(each, "jaccard-pivots")
    few = each.where(F.col("df") <= CROWDED)
    a, b = (few.select("pivot", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "busy")]) for s in "ab")
    fit = (F.col("node_a") > F.col("node_b")) & (5 * F.least("n_a", "n_b") >= 4 * F.greatest("n_a", "n_b"))
    met = a.join(b, "pivot").where(fit).groupBy("node_a", "node_b", "n_a", "n_b", "busy_a", "busy_b").agg(F.count(F.lit(1)).alias("c"))
    must = F.least(extra_col(F.col("n_a")), extra_col(F.col("n_b"))) - F.least("busy_a", "busy_b")
    near = met.where(F.col("c") >= F.greatest(F.lit(1), must)).select(F.col("node_a").alias("u"), F.col("node_b").alias("v"))
    # a pivot's limits stand once per SPREAD of its nodes, so that a hot pivot's nodes meet them in many places
    parts = F.ceil(F.col("df") / SPREAD)
    many = each.where(F.col("df") > CROWDED)
    limits = many.where(F.col("busy") >= extra_col(F.col("n"))).groupBy("pivot").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.min("node").alias("low"), F.first(parts).alias("parts"))
    limits = stored(limits.select("pivot", "least", "most", "low", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")), "jaccard-limits")
    many = many.withColumn("part", F.pmod(F.xxhash64("node"), parts)).join(limits, ["pivot", "part"])
    many = many.where((5 * F.col("n") >= 4 * F.col("least")) & (4 * F.col("n") <= 5 * F.col("most")))
    edges = near.union(many.select(F.col("node").alias("u"), F.col("low").alias("v")).distinct())
    found = components(edges, "jaccard-regions").select(F.col("u").alias("node"), F.col("root").alias("region"))
    return found.union(found.select(F.col("region").alias("node"), "region").distinct())


def packed(docs: DataFrame) -> DataFrame:
    """(id, print, packed) of docs (id, print, text), a repeated row once a task: texts are
    compressed for the way through shuffles, where their sets would take four times as much."""

    def run(batches):
        import zstandard

        done: set[tuple[int, int]] = set()
        for batch in batches:
            pairs = list(zip(batch.column("id").to_pylist(), batch.column("print").to_pylist()))
            batch = batch.take(pa.array([r for r, p in enumerate(pairs) if not (p in done or done.add(p))], pa.int64()))
            pack = zstandard.ZstdCompressor(level=3)
            texts = [pack.compress((t or "").encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("print"), pa.array(texts, pa.binary())], names=["id", "print", "packed"])

    return map_batches(docs.select("id", "print", "text"), run, "id long, print long, packed binary")


def with_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(region, node, n, packed) for wanted (id, print, node, region, n)."""
    return packed(docs).join(wanted.hint("shuffle_hash"), ["id", "print"]).select("region", "node", F.col("n").cast("int").alias("n"), "packed")


def opened(texts: list[bytes], asked: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """The rows whose packed text has the node it is asked for (equal prints may be of different texts), and their sets."""
    import zstandard

    open_ = zstandard.ZstdDecompressor()
    column = pa.array([open_.decompress(x).decode() for x in texts], pa.large_string())
    rows, found, at = [], [], 0
    for part in W.slices(pa.RecordBatch.from_arrays([column], names=["text"])):
        shingle, edge, node = sets(part.column("text"))
        for r in np.flatnonzero(node == asked[at:at + len(node)]).tolist():
            rows.append(at + r)
            found.append(shingle[edge[r]:edge[r + 1]])
        at += len(node)
    return rows, found


class Members:
    """The sets of a region's documents as arrays, for the intersections of some of them with all."""

    def __init__(self, arrays: list[np.ndarray]):
        self.size = np.array([len(a) for a in arrays], np.int64)
        self.edge = np.concatenate([[0], np.cumsum(self.size)])
        _, code, df = np.unique(np.concatenate(arrays), return_inverse=True, return_counts=True)
        self.code, self.df = code.astype(np.int32), df         # half the memory for what stays
        code = self.code
        owner = np.repeat(np.arange(len(arrays), dtype=np.int32), self.size)
        # shingles of a quarter of the documents: columns of a matrix, no more than four times the mean size
        common = df > max(16, len(arrays) // 4)
        column = np.cumsum(common) - 1
        at = common[code]
        self.matrix = np.zeros((len(arrays), int(common.sum())), np.float32)
        self.matrix[owner[at], column[code[at]]] = 1
        # the others: postings, by shingle its documents; those of one document alone meet nobody
        self.rare = (df > 1) & ~common
        self.post = owner[np.argsort(code, kind="stable")]
        self.at = np.concatenate([[0], np.cumsum(df)])

    def shared(self, rows: np.ndarray) -> np.ndarray:
        """Intersection sizes of documents ``rows`` with all."""
        out = np.rint(self.matrix[rows] @ self.matrix.T).astype(np.int64)
        for i, r in enumerate(rows.tolist()):
            c = self.code[self.edge[r]:self.edge[r + 1]]
            c = c[self.rare[c]]
            k = self.df[c]
            place = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(self.at[c], k)
            out[i] += np.bincount(self.post[place], minlength=len(self.size))
            out[i, r] = self.size[r]                           # its own shingles were counted as far as others have them
        return out

    def common(self) -> np.ndarray:
        """Shingles of each document that another one has too."""
        return np.add.reduceat((self.df > 1)[self.code].astype(np.int64), self.edge[:-1])


def linked(inter: np.ndarray, n: int, size: np.ndarray) -> np.ndarray:
    return 100 * inter >= 80 * (n + size - inter)


def join_region(arrays: list[np.ndarray]) -> np.ndarray:
    """For each document of a region, given as its shingles, the first document of its component.

    A document is *met* when its intersections with all others are counted, at
    most once.  Pairs of documents that are not met are settled without counting if
    they are of one component already, or if a pivot (a met document) tells them
    apart: linked documents have |d(x, p) - d(y, p)| <= 0.2.  Documents of the
    smallest components are met first, so a large component's members are
    settled by all others."""
    m = Members(arrays)
    n = len(m.size)
    root = np.arange(n)
    open_ = m.common() >= need(m.size)                         # others can have no partner
    pivot = np.zeros((0, n), np.float32)                       # distances to the latest pivots

    def meet(rows: np.ndarray) -> None:
        nonlocal pivot
        inter = m.shared(rows)
        far = 1 - inter / (m.size[rows][:, None] + m.size - inter)
        for r, shared in zip(rows.tolist(), inter):
            near = np.unique(root[np.flatnonzero(open_ & linked(shared, m.size[r], m.size))])
            if len(near) > 1:
                root[np.isin(root, near)] = near[0]
        pivot = np.concatenate([far.astype(np.float32), pivot])[:PIVOTS]

    left = np.flatnonzero(open_)                               # neither met nor settled
    turn = 1                                                   # one document first, then more at a time
    while len(left) and (root[left] != root[left[0]]).any():
        _, own, count = np.unique(root[left], return_inverse=True, return_counts=True)
        left = left[np.argsort(count[own], kind="stable")]
        ask, settled = [], 0
        for y in left.tolist():
            may = root[left] != root[y]
            may &= 5 * np.minimum(m.size[left], m.size[y]) >= 4 * np.maximum(m.size[left], m.size[y])
            for d in pivot:
                if not may.any():
                    break
                may &= np.abs(d[left] - d[y]) <= 0.2 + 1e-5
            settled += 1
            if may.any():
                ask.append(y)
                if len(ask) == turn:
                    break
        if ask:
            meet(np.array(ask))
        left = left[settled:]
        turn = min(2 * turn, MEET)
    return root


def distinct_nodes(group: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    """The nodes of a table (node, packed, ...) in order, and their sets."""
    some = list({pair: None for pair in zip(group.column("node").to_pylist(), group.column("packed").to_pylist())})
    rows, found = opened([text for _, text in some], np.array([node for node, _ in some], np.int64))
    node = np.array([some[r][0] for r in rows], np.int64)
    node, first = np.unique(node, return_index=True)
    return node, [found[i] for i in first]


def _join(group: pa.Table) -> pa.Table:
    """(u, v): nodes and their component's first node in the region."""
    node, found = distinct_nodes(group)
    return pa.table({"u": pa.array(node, pa.int64()), "v": pa.array(node[join_region(found)] if len(node) else node, pa.int64())})


def oversized(wanted: DataFrame) -> DataFrame:
    """(region, size) of the regions over the bound."""
    return wanted.groupBy("region").agg(F.sum(F.col("n").cast("long")).alias("size")).where(F.col("size") > REGION_SHINGLES)


def banded(members: DataFrame, over: DataFrame) -> DataFrame:
    """``members`` with the regions of ``over`` cut into bands of size, which overlap by one."""
    columns = members.columns
    place = F.log(F.col("n").cast("double")) / F.log(F.lit(BAND))
    joined = members.join(over.select("region", F.lit(True).alias("__over")), "region", "left")
    bands = F.when(F.col("__over"), F.array(F.floor(place), F.floor(place) + 1)).otherwise(F.array(F.lit(None).cast("long")))
    cut = joined.withColumn("__band", F.explode(bands))
    return cut.withColumn("region", F.when(F.col("__over"), F.xxhash64("region", "__band")).otherwise(F.col("region"))).select(*columns)


def split(members: DataFrame, over: DataFrame, turn: int) -> DataFrame:
    """(parent, region, node, n, packed): cells of members (region, node, n, packed) of the regions ``over`` (region, size).

    ``turn`` salts the choice of pivots and the cells' names, so a split of a cell takes other ones."""
    parts = F.ceil(F.col("size") * 8 / F.lit(REGION_SHINGLES))     # a region is worked on in parts
    inside = members.join(over.withColumn("parts", parts), "region").withColumn("part", F.pmod(F.xxhash64("node", F.lit(turn)), F.col("parts")))
    top = Window.partitionBy("region").orderBy(F.xxhash64("node", F.lit(turn + 1000)), "node")
    light = inside.select("region", "node", "parts").distinct().withColumn("k", F.row_number().over(top)).where(F.col("k") <= F.least(SPLIT * F.col("parts"), F.lit(MOST_SPLIT)))
    centres = members.dropDuplicates(["region", "node"]).join(light, ["region", "node"])
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("__part")
    centres = centres.select(F.col("region").alias("__region"), every, F.col("k").alias("k"), F.col("node").alias("__node"), F.col("packed").alias("__packed"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("k")
        _, hashes = opened(right.column("__packed").to_pylist(), right.column("__node").to_numpy())
        size = np.array([len(h) for h in hashes], np.int64)
        whole = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        by = np.argsort(whole, kind="stable")
        whole, owner = whole[by], np.repeat(np.arange(len(size)), size)[by]
        rows, cells = [], []
        for r, own in zip(*opened(left.column("packed").to_pylist(), left.column("node").to_numpy())) if len(left) else ():
            lo, hi = np.searchsorted(whole, own, "left"), np.searchsorted(whole, own, "right")
            at = np.repeat(lo - np.cumsum(hi - lo) + (hi - lo), hi - lo) + np.arange((hi - lo).sum())
            inter = np.bincount(owner[at], minlength=len(size))
            far = 1 - inter / (len(own) + size - inter)
            own_cell = np.flatnonzero(far < NEAR - 1e-9)
            last = own_cell[0] if len(own_cell) else len(size)
            to = np.flatnonzero(far[:last + 1] <= FAR + 1e-9).tolist() + ([-1] if last == len(size) else [])
            rows += [r] * len(to)
            cells += to
        got = left.take(pa.array(rows, pa.int64()))
        parent = got.column("region")
        return pa.table({"parent": parent, "cell": pa.array(cells, pa.int64()), "node": got.column("node"), "n": got.column("n"), "packed": got.column("packed")})

    schema = "parent long, cell long, node long, n int, packed binary"
    found = inside.select("region", "part", "node", "n", "packed").groupBy("region", "part").cogroup(
        centres.groupBy("__region", "__part")).applyInArrow(run, schema)
    return found.select("parent", F.xxhash64("parent", "cell", F.lit(turn)).alias("region"), "node", "n", "packed")


def bounded(members: DataFrame) -> DataFrame:
    """Members of regions over the bound as members of cells: within the bound, or of a region that no split makes smaller."""
    done, turn = [], 0
    while True:
        over = oversized(members)
        fits = members.join(over.select("region"), "region", "left_anti").select("region", "node", "n", "packed")
        if not over.head(1):
            break
        turn += 1
        cells = stored(split(members, over, turn), "jaccard-cells")
        most = cells.groupBy("parent", "region").agg(F.sum(F.col("n").cast("long")).alias("s")).groupBy("parent").agg(F.max("s").alias("most"))
        shrunk = stored(over.join(most, over.region == most.parent).where(F.col("most") <= SMALLER * F.col("size")).select("parent"), "jaccard-shrunk")
        whole = members.join(over.select("region"), "region", "left_semi").join(shrunk, F.col("region") == F.col("parent"), "left_anti")
        done += [fits, whole.select("region", "node", "n", "packed")]
        members = cells.join(shrunk, "parent", "left_semi").select("region", "node", "n", "packed")
    done.append(fits)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def links(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, root): component roots of the wanted (id, print, node, region, n) in their regions."""
    found = lambda m: m.groupBy("region").applyInArrow(_join, "u long, v long")            # noqa: E731
    over = oversized(wanted)
    if not over.head(1):
        return found(with_texts(docs, wanted)).select(F.col("u").alias("node"), F.col("v").alias("root"))
    members = banded(stored(with_texts(docs, wanted), "jaccard-members"), stored(over, "jaccard-over"))
    return components(found(bounded(members)), "jaccard-links").select(F.col("u").alias("node"), "root")


def join(docs: DataFrame) -> DataFrame:
    """(id, print, n_shingles, component_id, root) of docs (id, print, text).

    ids of null are ``LAST``; root is the component's smallest node, null for empty sets."""
    rows = stored(nodes(docs), "jaccard-nodes")
    kept = stored(survivors(docs), "jaccard-survivors")
    first = rows.where("n > 0").groupBy("node").agg(F.min(F.struct("id", "print")).alias("first"), F.first("n").alias("n"))
    wanted = stored(regions(kept).join(first, "node").select("first.*", "node", "region", "n"), "jaccard-wanted")
    roots = stored(links(docs, wanted), "jaccard-roots")
    labelled = rows.join(roots, "node", "left").withColumn("root", F.when(F.col("n") > 0, F.coalesce("root", "node")))
    least = labelled.where("n > 0").groupBy("root").agg(F.min("id").alias("least"))
    return labelled.join(least, "root", "left").select("id", "print", F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"), "root")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("id"), F.xxhash64("text").alias("print"), "text")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    null = lambda c: F.when(F.col(c) != LAST, F.col(c))        # noqa: E731
    return join(keyed(docs)).select(null("id").alias("doc_id"), "n_shingles", null("component_id").alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: of its smallest doc_id, and of
    several texts with that id, the one with the smallest hash.  Rows without
    words stay as they are."""
    found = join(keyed(docs))
    stays = found.where("n_shingles > 0").groupBy("root").agg(F.min(F.struct("id", "print")).alias("s")).select("s.*", F.lit(True).alias("one"))
    stays = stays.union(found.where("n_shingles = 0").select("id", "print", F.lit(False)).distinct())
    stays = stays.select(F.col("id").alias(PREFIX + "id"), F.col("print").alias(PREFIX + "print"), F.col("one").alias(PREFIX + "one"))
    own = docs.withColumns({PREFIX + "id": F.coalesce("doc_id", F.lit(LAST)), PREFIX + "print": F.xxhash64("text")})
    left = own.join(stays.hint("shuffle_hash"), [PREFIX + "id", PREFIX + "print"])
    turn = F.row_number().over(Window.partitionBy(PREFIX + "id", PREFIX + "print").orderBy(PREFIX + "one"))
    return left.withColumn(PREFIX + "turn", turn).where(~F.col(PREFIX + "one") | (F.col(PREFIX + "turn") == 1)).select(*docs.columns)
