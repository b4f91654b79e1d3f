"""SimHash near-duplicates: a self-join of binary tries within a Hamming budget.

Fingerprints of 64 bits are hung into binary tries.  Two tries are walked
together: a pair of nodes carries the number of bits in which their paths
differ, and a pair over the budget is dropped with all below it.  Of four tries,
each with another quarter of the bits on top, one has any close pair under the
same 16-bit node (three differing bits cannot reach all four quarters), so the
tasks are those nodes.  A node with too many fingerprints is cut into pairs of
its own subtrees, again only those within the budget.

A task returns a spanning forest of the links it finds, not all pairs; subtrees
that are one component already are not walked again.  Components over all tasks
come from alternating large-star and small-star steps on written tables.

Defined results: NULL and empty texts have fingerprint zero; it links like any
other.  Long texts count with all their shingles.  Rows with one id but several texts count as several documents.  A NULL
id is never the smallest of a component unless all are NULL.  Repeated rows and
extra columns change nothing; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nbgauge.llm.common import fresh, quoted, written
from nbgauge.session import cut_lineage

SHINGLE, BITS, BUDGET, TOP_BITS = 3, 64, 3, 16
ROTATIONS = BITS // TOP_BITS
#: Most fingerprints of a node before it is cut into subtree pairs.
NODE_ROWS = 4_000
#: About so many fingerprints of neighbouring nodes make a task.
TASK_ROWS = 20_000
_TABLE = np.array([bin(i).count("1") for i in range(1 << 16)], dtype=np.uint8)


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = 42) -> int:
    """64 bits, each set if it is set in over half the hashes of the word shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    last = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(b" ".join(words[i : i + size]), seed) for i in range(last)), dtype=np.uint64, count=last)
    set_bits = np.zeros(BITS, dtype=np.int64)
    for i in range(0, last, 4096):
        part = hashes[i : i + 4096].astype(">u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_bits * 2 > last).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id and fingerprint (as a signed long) of every document. Map-only."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t.as_py(), size) for t in batch.column(1)]
            signed = np.array(values, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed)], names=["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(compute, f"doc_id {kind}, fingerprint long")


def popcount(values: np.ndarray) -> np.ndarray:
    parts = values.astype(np.uint64)[:, None].view(np.uint16).reshape(-1, 4)
    return _TABLE[parts].sum(axis=1, dtype=np.int64)


class _Forest:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def trie_links(left: np.ndarray, right: np.ndarray | None = None, budget: int = BUDGET) -> list[tuple[int, int]]:
    """Spanning links within one set of fingerprints, or between two.

    Sorted fingerprints are a binary trie: a node is a run of rows, its children
    the two parts of the run at the next bit.
    """
    rows = np.unique(left if right is None else np.concatenate([left, right]))
    rows = np.sort(rows.astype(np.uint64))
    n = len(rows)
    values = rows.tolist()
    forest, links = _Forest(n), []
    side = None
    if right is not None:
        in_left, in_right = np.isin(rows, left.astype(np.uint64)), np.isin(rows, right.astype(np.uint64))
        side = (in_left, in_right)

    def split(lo: int, hi: int, bit: int) -> int:
        """First row of the run with the bit set."""
        wall = (values[lo] >> (bit + 1) << (bit + 1)) | (1 << bit)
        return int(np.searchsorted(rows[lo:hi], np.uint64(wall))) + lo

    whole: dict[tuple[int, int], int] = {}

    def component(lo: int, hi: int) -> int:
        """Component of a run all of whose rows are known to be connected, else -1."""
        root = whole.get((lo, hi), -1)
        if root < 0 and hi - lo <= 64:
            root = forest.find(lo)
            for x in range(lo + 1, hi):
                if forest.find(x) != root:
                    return -1
            whole[(lo, hi)] = root
        return root if root < 0 else forest.find(root)

    def leaves(a: int, b: int, c: int, d: int) -> None:
        """Compare two small runs outright."""
        same = (a, b) == (c, d)
        near = popcount((rows[a:b, None] ^ rows[None, c:d]).ravel()).reshape(b - a, d - c) <= budget
        if side is not None:
            l, r = side
            near &= (l[a:b, None] & r[None, c:d]) | (r[a:b, None] & l[None, c:d])
        for i, j in zip(*np.nonzero(near)):
            x, y = a + int(i), c + int(j)
            if (not same or x < y) and forest.union(x, y):
                links.append((values[x], values[y]))

    if n:
        # Pairs of nodes still to walk: two runs, the next bit, the bits that differ so far.
        stack = [(0, n, 0, n, BITS - 1, 0)]
        while stack:
            a, b, c, d, bit, differ = stack.pop()
            mine = component(a, b)
            if mine >= 0 and ((a, b) == (c, d) or mine == component(c, d)):
                continue
            if bit < 0 or (b - a) * (d - c) <= 1024:
                leaves(a, b, c, d)
                continue
            m = split(a, b, bit)
            if (a, b) == (c, d):
                if m in (a, b):
                    stack.append((a, b, a, b, bit - 1, 0))
                    continue
                # The halves first, so that whole components are known before the pair is met.
                stack.append((a, m, m, b, bit - 1, 1))
                stack.append((m, b, m, b, bit - 1, 0))
                stack.append((a, m, a, m, bit - 1, 0))
                continue
            k = split(c, d, bit)
            for one, two, more in (((a, m), (k, d), 1), ((m, b), (c, k), 1), ((a, m), (c, k), 0), ((m, b), (k, d), 0)):
                if one[0] < one[1] and two[0] < two[1] and differ + more <= budget:
                    stack.append((*one, *two, bit - 1, differ + more))
    return links


def _rotated(rotation: int) -> F.Column:
    turn = TOP_BITS * rotation
    value = F.col("fingerprint")
    if not turn:
        return value
    return F.shiftleft(value, turn).bitwiseOR(F.shiftrightunsigned(value, BITS - turn))


def node_links(values: np.ndarray, nodes: np.ndarray, budget: int = BUDGET) -> list[tuple[int, int]]:
    """Links within each of several nodes."""
    order = np.argsort(nodes, kind="stable")
    values, nodes = values[order], nodes[order]
    cuts = np.flatnonzero(np.diff(nodes, prepend=-1))
    ends = np.append(cuts[1:], len(nodes))
    return [link for a, b in zip(cuts.tolist(), ends.tolist()) if b - a > 1 for link in trie_links(values[a:b], budget=budget)]


def links_between(distinct: DataFrame, node_rows: int = NODE_ROWS, max_cut: int = 10, budget: int = BUDGET) -> DataFrame:
    """Spanning links (a, b) of distinct fingerprints, in several forests that together connect all that is linked."""
    if not 0 <= budget < ROTATIONS:
        raise ValueError(f"with {ROTATIONS} rotations a pair within {ROTATIONS - 1} bits shares a node, not one within {budget}")
    turned = distinct.select(
        F.explode(F.array(*[F.struct(F.lit(r).alias("rotation"), _rotated(r).alias("value")) for r in range(ROTATIONS)])).alias("t")
    ).select("t.rotation", "t.value", F.shiftrightunsigned("t.value", BITS - TOP_BITS).cast("int").alias("node"))
    # At most 4 x 65536 rows, whatever the input: safe to broadcast.
    crowded = (
        turned.groupBy("rotation", "node").count().where(F.col("count") > node_rows)
        .withColumn("cut", F.least(F.lit(max_cut), F.ceil(F.log2(F.col("count") / node_rows)).cast("int")))
        .select("rotation", "node", "cut")
    )
    placed = turned.join(F.broadcast(crowded), ["rotation", "node"], "left").withColumn("cut", F.coalesce("cut", F.lit(0)))
    # Subtrees of a crowded node: the next ``cut`` bits; a pair of subtrees within the budget is one task.
    below = F.shiftrightunsigned(F.shiftleft("value", TOP_BITS), BITS - max_cut).cast("int")
    subtree = F.when(F.col("cut") == 0, F.lit(0)).otherwise(F.expr(f"shiftright({{below}}, {max_cut} - cut)".format(below="_below")))
    placed = placed.withColumn("_below", below).withColumn("subtree", subtree)
    others = F.filter(F.sequence(F.lit(0), F.expr("shiftleft(1, cut) - 1")), lambda y: F.bit_count(y.bitwiseXOR(F.col("subtree"))) <= budget)
    placed = placed.withColumn("other", F.explode(others))
    # Nodes that are not cut share tasks with their neighbours.
    wanted = max(1, distinct.count() // TASK_ROWS)
    shared_bits = max(0, TOP_BITS - (wanted - 1).bit_length())
    tasks = placed.select(
        "rotation", "cut", F.when(F.col("cut") == 0, F.shiftright("node", shared_bits)).otherwise(F.col("node")).alias("task"),
        F.least("subtree", "other").alias("low"), F.greatest("subtree", "other").alias("high"),
        "node", (F.col("subtree") <= F.col("other")).alias("is_low"), "value",
    )

    def join(key: tuple, rows: pa.Table) -> pa.Table:
        rotation, _, _, low, high = (k.as_py() for k in key)
        values = rows["value"].to_numpy().view(np.uint64)
        if low == high:
            found = node_links(values, rows["node"].to_numpy(), budget)
        else:
            is_low = rows["is_low"].to_numpy(zero_copy_only=False).astype(bool)
            found = trie_links(values[is_low], values[~is_low], budget)
        pairs = np.array(found, dtype=np.uint64).reshape(-1, 2)
        turn = TOP_BITS * rotation
        if turn:
            pairs = (pairs >> np.uint64(turn)) | (pairs << np.uint64(BITS - turn))
        signed = pairs.view(np.int64)
        return pa.table({"a": signed[:, 0], "b": signed[:, 1]})

    return tasks.groupBy("rotation", "cut", "task", "low", "high").applyInArrow(join, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for all nodes of the links.

    Each step reconnects the neighbours of a node to the smallest of them.
    Neighbour lists are not collected: the minimum per node is aggregated and joined
    back, a join whose large groups Spark splits, so a star of any size is fine.
    """
    def stars(edges: DataFrame, large: bool) -> DataFrame:
        if large:
            both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        smallest = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        joined = both.join(smallest, "a")
        if large:
            new = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            kept = joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
            new = kept.union(smallest.select("a", F.col("m").alias("b")))
        return new.where("a <> b").distinct()

    edges = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        edges = cut_lineage(stars(stars(edges, large=True), large=False))
        # Two sums tell whether the set of links changed.
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def near_duplicates(docs: DataFrame, node_rows: int = NODE_ROWS, size: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """doc_id, fingerprint (long) and component_id of every document, from shingles of ``size`` words and at most ``budget`` differing bits."""
    marked = cut_lineage(fingerprints(docs, size))
    distinct = cut_lineage(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("smallest")))
    found = components(links_between(distinct.select("fingerprint"), node_rows, budget=budget))
    placed = distinct.join(found, distinct["fingerprint"] == found["node"], "left").select(
        "fingerprint", "smallest", F.coalesce("component", "fingerprint").alias("component")
    )
    classes = placed.groupBy("component").agg(F.min("smallest").alias("component_id"))
    labelled = placed.join(classes, "component").select("fingerprint", "component_id")
    return marked.join(labelled, "fingerprint").select("doc_id", "fingerprint", "component_id")


def one_per_group(docs: DataFrame, size: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """Of each group of near duplicates the row with the smallest id, no id last; equal ids by a hash of the row.

    Rows are told apart by a number that they get when they are written, not by id:
    rows with one id or none and different texts are different documents.  Texts are
    fingerprinted where they are read and moved once, with the rows.
    """
    number, mark = fresh(docs, "_number", "_mark")
    hashed = [quoted(c) for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    rows = written(docs.withColumns({mark: F.xxhash64(*hashed), number: F.monotonically_increasing_id()}), "numbered")
    named = rows.select(quoted(number).alias("doc_id"), F.col("text").cast("string").alias("text"))
    groups = near_duplicates(named, size=size, budget=budget).select(F.col("doc_id").alias("number"), F.col("component_id").alias("group"))
    ids = rows.select(quoted(number).alias("number"), quoted("doc_id").alias("id"), quoted(mark).alias("mark"))
    first = ids.join(groups, "number").groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "mark", "number")).alias("r"))
    keep = first.select(F.col("r.number").alias(number))
    # Only the numbers of the kept rows are hashed; rows with their texts need no sorting.
    return rows.join(keep.hint("shuffle_hash"), number, "left_semi").drop(number, mark)
