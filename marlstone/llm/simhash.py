"""SimHash near-duplicates: fingerprints of 3-word shingles, linked at few differing bits through BK-trees.

The distinct fingerprints are dealt to shards by masked keys: the 64 bits are cut into BLOCKS = 6 blocks, and
two fingerprints that differ in at most two bits agree on the other blocks for one at least of the 15 choices
of two blocks to leave out.  Each shard is the set of fingerprints with one masked key; it gets a BK-tree
(children keyed by the integer Hamming distance to their parent), and every member is looked up in it,
following only edges within the radius.  A shard has at most 2**22 members (the bits left out), however many
documents there are.  The trees aren't broadcast: together they grow with the corpus, so each is built in the
task that its queries are shuffled to.

A shard returns a spanning forest of its links, at most one edge per member, so that a group of copies makes
no quadratic number of pairs; components follow by alternating large-star and small-star steps.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

RADIUS = 2
BLOCKS = 6
SEED = 42
WORDS = 3
#: Members of shards handled at a time, unless one shard has more; and (query, node) pairs of a step of the search.
CHUNK, PAIRS = 200_000, 1_000_000


def majority(parts, n: int) -> int:
    """The fingerprint of n 64-bit hashes, given as arrays: bit i is set if it is in over half of them."""
    import numpy as np

    ones = np.zeros(64, np.int64)
    for h in parts:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None) -> int:
    """Bit i is set if it is in over half of the hashes of the text's shingles; 0 without a word."""
    import numpy as np
    from xxhash import xxh64_intdigest

    found = (text or "").encode().lower().split()
    if not found:
        return 0
    n = max(1, len(found) - WORDS + 1)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate([[0], ends])[:n].tolist()
    stops = (ends[-n:] - 1).tolist()
    return majority((np.array([xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts[a : a + 65536], stops[a : a + 65536])], np.uint64) for a in range(0, n, 65536)), n)


def _fingerprints(batches):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        found = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(found.view(np.int64))], ["doc_id", "text_hash", "fp"])


def masks(blocks: int = BLOCKS, radius: int = RADIUS) -> list[int]:
    """For each choice of `radius` blocks, the bits of the others, as signed 64-bit numbers."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    bits = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]
    out = [~sum(bits[i] for i in left) & (1 << 64) - 1 for left in combinations(range(blocks), radius)]
    return [x - (1 << 64) if x >> 63 else x for x in out]


class Forest:
    """One BK-tree per group of consecutive codes.  Level by level, the first code of each open group becomes
    a node and the others of the group are regrouped by their distance to it."""

    def __init__(self, codes, groups) -> None:
        import numpy as np

        self.codes = codes
        n = len(codes)
        self.root = np.zeros(n, np.int64)
        parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        left, group = np.arange(n), groups.astype(np.int64)
        top = True
        while len(left):
            order = np.argsort(group, kind="stable")
            left, group = left[order], group[order]
            new = np.concatenate([[True], group[1:] != group[:-1]])
            node = left[new][np.cumsum(new) - 1]
            if top:
                self.root[left] = node
                top = False
            rest = ~new
            left, node = left[rest], node[rest]
            d = np.bitwise_count(codes[left] ^ codes[node]).astype(np.int64)
            parent[left], edge[left] = node, d
            group = node * 65 + d
        # left's parent and edge were overwritten down to its own node, so they are those of the tree.
        child = np.flatnonzero(parent >= 0)
        child = child[np.argsort(parent[child], kind="stable")]
        self.child, self.edge = child, edge[child]
        self.first = np.searchsorted(parent[child], np.arange(n))
        self.last = np.searchsorted(parent[child], np.arange(n), side="right")

    def matches(self, radius: int):
        """Yields arrays (query, node) of codes of one tree within the radius, each pair once."""
        import numpy as np

        todo = [(np.arange(len(self.codes)), self.root)]
        while todo:
            q, node = todo.pop()
            if len(q) > PAIRS:
                half = len(q) // 2
                todo += [(q[:half], node[:half]), (q[half:], node[half:])]
                continue
            d = np.bitwise_count(self.codes[q] ^ self.codes[node]).astype(np.int64)
            near = (d <= radius) & (q > node)  # descendants come after their ancestors: a query needs the nodes before it
            if near.any():
                yield q[near], node[near]
            fan = self.last[node] - self.first[node]
            at = np.repeat(self.first[node] - np.concatenate([[0], np.cumsum(fan)[:-1]]), fan) + np.arange(fan.sum())
            query, child = np.repeat(q, fan), self.child[at]
            go = (np.abs(self.edge[at] - np.repeat(d, fan)) <= radius) & (child < query)
            if go.any():
                todo.append((query[go], child[go]))

    def earlier(self, radius: int, alike):
        """For each code a code before it in its tree, within the radius, for which alike(query, node) holds: the first
        that the search meets, of several of one step the nearest.  -1 without one."""
        import numpy as np

        found = np.full(len(self.codes), -1, np.int64)
        todo = [(np.arange(len(self.codes)), self.root)]
        while todo:
            q, node = todo.pop()
            if len(q) > PAIRS:
                half = len(q) // 2
                todo += [(q[half:], node[half:]), (q[:half], node[:half])]
                continue
            left = (found[q] < 0) & (q > node)
            q, node = q[left], node[left]
            d = np.bitwise_count(self.codes[q] ^ self.codes[node]).astype(np.int64)
            near = np.flatnonzero(d <= radius)
            near = near[alike(q[near], node[near])]
            near = near[np.argsort(-d[near], kind="stable")]
            found[q[near]] = node[near]  # the last of a query is the nearest
            left = found[q] < 0
            q, node, d = q[left], node[left], d[left]
            fan = self.last[node] - self.first[node]
            at = np.repeat(self.first[node] - np.concatenate([[0], np.cumsum(fan)])[:-1], fan) + np.arange(fan.sum())
            query, child = np.repeat(q, fan), self.child[at]
            go = (np.abs(self.edge[at] - np.repeat(d, fan)) <= radius) & (child < query)
            if go.any():
                todo.append((query[go], child[go]))
        return found


def unite(parent, a, b) -> None:
    """Joins the sets of a[i] and b[i] in a union-find forest whose roots are the smallest members."""
    import numpy as np

    def roots(x):
        while True:
            up = parent[x]
            if np.array_equal(parent[up], up):
                return up
            parent[x] = parent[up]

    while len(a):
        ra, rb = roots(a), roots(b)
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))


def _links(radius: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        def linked(combo, key, code):
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (combo[1:] != combo[:-1])])
            group = np.cumsum(new) - 1
            many = np.bincount(group)[group] > 1
            code, group = code[many], group[many]
            parent = np.arange(len(code))
            if len(code):
                for q, node in Forest(code, group).matches(radius):
                    unite(parent, q, node)
            while not np.array_equal(parent, parent[parent]):
                parent = parent[parent]
            tied = np.flatnonzero(parent != np.arange(len(code)))
            a, b = code[tied].view(np.int64), code[parent[tied]].view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        held = None
        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            now[2] = now[2].view(np.uint64)
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            if len(held[0]) < CHUNK:
                continue
            border = np.flatnonzero((held[1][1:] != held[1][:-1]) | (held[0][1:] != held[0][:-1]))
            if len(border):
                cut = border[-1] + 1
                yield linked(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield linked(*held)

    return run


def links(codes: DataFrame, *, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Edges a < b between distinct 64-bit codes (column fp) that connect all codes within the radius of each other."""
    keys = F.array(*[F.struct(F.lit(i).alias("combo"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks(blocks, radius))])
    dealt = codes.select("fp", F.explode(keys).alias("k")).select("k.combo", "k.key", "fp")
    n = common.shuffle_partitions(codes.sparkSession)
    dealt = dealt.repartition(n, "combo", "key").sortWithinPartitions("combo", "key")
    return dealt.mapInArrow(_links(radius), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for the nodes of edges a < b.

    Alternating stars: each node's larger neighbours, then its smaller ones, are tied to the smallest node
    that it knows, until nothing changes; the number of rounds grows with the logarithm of the diameter.
    Ties to hubs go through common.attach, so no hub's edges meet in one task.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        # pairs: (u, v).  Large: v > u counts for the output, all v for the minimum.  Small: v < u only.
        least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
        if large:
            least = least.withColumn("m", F.least("u", "m"))
        tied = common.attach(pairs, least, ["u"], "degree", max(1, pairs.count()))
        if large:
            out = tied.filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        else:
            out = tied.filter("v > m").select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
        return common.materialize(out.filter("a < b").distinct(), "components")

    edges = common.materialize(edges, "components")
    mark = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        edges = star(both, True)
        edges = star(edges.select(F.col("b").alias("u"), F.col("a").alias("v")), False)
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def near_duplicates(docs: DataFrame, *, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, text_hash, fp (the fingerprint as a signed long), root (a fingerprint that stands
    for the component), component_id.

    A null or wordless text has fingerprint zero and is linked like any other; texts of fewer words than a
    shingle are one shingle; repeated rows share their component; component_id is the smallest id that can be
    reached (null ids are passed over, and null comes out only where a component has no other); an empty table
    gives no row; other columns are ignored.  The result is a written table; the working tables are gone when it is there.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    common.bounded_batches(docs.sparkSession)
    with common.scratch(docs.sparkSession):
        prints = common.materialize(rows.mapInArrow(_fingerprints, "doc_id long, text_hash long, fp long"), "op8-prints")
        codes = common.materialize(prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")), "op8-codes")
        roots = common.materialize(components(links(codes.select("fp"), radius=radius)), "op8-roots")
        joined = codes.join(roots.withColumnRenamed("node", "fp"), "fp").select("fp", "n", "least", "root")
        whole = joined.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"))
        linked = common.attach(joined, whole, ["root"], "members", max(1, roots.count())).select("fp", "n", "root", "component_id")
        alone = codes.join(roots.select(F.col("node").alias("fp")), "fp", "left_anti").select("fp", "n", F.col("fp").alias("root"), F.col("least").alias("component_id"))
        classes = common.materialize(linked.unionByName(alone), "op8-classes")
        return common.result(common.attach(prints, classes, ["fp"], "n", max(1, prints.count())).select("doc_id", "text_hash", "fp", "root", "component_id"), "op8-rows")


def keep_one(docs: DataFrame, *, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that of the smallest id (null last; then by a hash of the text).

    Null and wordless texts have fingerprint zero and are linked like any other; of repeated rows one stays; an empty
    table gives no row; all columns stay."""
    return keep_first(docs, near_duplicates(docs, radius=radius, id_col=id_col, text_col=text_col), id_col=id_col, text_col=text_col)


def keep_first(docs: DataFrame, near: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each root of near (doc_id, text_hash, root; a row per row of docs).

    The row of the smallest id stays (null last; then by text_hash); of rows that share id and text any one."""
    near = common.materialize(near.select("doc_id", "text_hash", "root"), "op8-near")
    who = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    groups = near.groupBy("root").agg(F.min(who).alias("stays"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    inside = common.attach(near, common.materialize(groups, "op8-groups"), ["root"], "members", max(1, near.count()))
    # Of the rows that are the one that stays in all but their order, the first is kept.
    order = Window.partitionBy("root", "doc_id", "text_hash").orderBy(F.lit(0))
    lost = inside.withColumn("nth", F.row_number().over(order)).filter((who != F.col("stays")) | (F.col("nth") > 1))
    lost = lost.groupBy("doc_id", "text_hash").agg(F.max(F.when(who == F.col("stays"), F.col("nth"))).alias("repeats"))
    return common.without(docs, common.materialize(lost, "op8-lost"), id_col=id_col, text_col=text_col)


def op8_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
