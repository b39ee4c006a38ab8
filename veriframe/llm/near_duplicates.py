"""Near-duplicate classes by BagMinHash signatures, banding and exact verification.

A text is the multiset of its five-word shingles (shorter texts: one shingle of all words). The weighted Jaccard
similarity of two multisets is the sum of smaller over the sum of larger multiplicities.

BagMinHash: the weight axis of a shingle is cut into the intervals [0, 1), [1, 2), [2, 4), [4, 8), ... and each
interval has one Poisson process of points at a rate as large as the interval is long. Times, registers and places
inside the interval depend on the shingle and the interval only; a point's place is found by halving its interval
down to the unit level. A shingle of weight w uses the points placed below w, so it costs a number of processes
that grows with the logarithm of its weight, and every register keeps the earliest time. Points are drawn in rising
time and only up to the limit at which all registers are filled. Registers agree with the probability of the
similarity.

Signatures are cut into bands. Equal texts are one node. Nodes that share a bucket are candidates. In each bucket
the centre is the node with the largest buckets in all; each node is verified exactly against the few centres it
shares most bands with, and verified links form components. Buckets that still hold several components are searched
whole: in blocks, a node of one component is compared with all nodes of others at once through an index of shingles,
exactly, and only links that join components are given. Large buckets that overlap are searched as one family where
that is less work. So no link between components is lost, no group is expanded into its pairs, and what is sent on
grows with a group's size times its number of blocks.

Defined cases: null texts and texts of white space only (as ``str.split`` sees it) have no shingles and are classes
of their own; equal texts share a class; repeated rows are listed as often as they occur; texts are read whole;
other columns are ignored, whatever their names; an empty table gives an empty table. The input must read the same
rows in the same order each time (a table or a written intermediate result), as rows are told apart by their place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriframe.llm.common import cut, cut_table, few_entries, free_name, parts_of, quoted, tidy
from veriframe.llm.components import components
from veriframe.llm.rolling import shingle_hashes, text_bytes

SHINGLE = 5
THRESHOLD = 0.8
#: A pair at the threshold shares no band with a probability of 3e-6.
BANDS, ROWS = 42, 6
#: Registers of a signature, a power of two; the bands take the first of them.
REGISTERS = 256
#: Centres that a node is verified against before buckets are searched whole.
CENTRES = 3
#: Members of a centre that are verified in one group; a centre with more is copied to as many groups.
GROUP = 400
#: Shingles in a block of the search, on either side.
BLOCK = 400_000
#: Buckets with more nodes are searched together with those they overlap.
LARGE = 100
#: Shingles whose signatures are made at once, and texts.
CHUNK, CHUNK_TEXTS = 100_000, 2_048


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of a column of texts, and where each text's shingles begin and end among them."""
    return shingle_hashes(*text_bytes(texts), SHINGLE)


def cells(shingles: np.ndarray) -> np.ndarray:
    """One hash for every unit of weight, for exact overlaps: the first occurrence of a shingle is level 0, the next
    level 1, ... Two multisets share as many cells as the sum of their smaller multiplicities."""
    order = np.sort(shingles)
    first = np.flatnonzero(np.append(True, order[1:] != order[:-1]))
    level = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return np.sort(_mix(order + level.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(1)))


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """Signature rows of several multisets (distinct shingles and their weights, none empty): the time of the
    earliest point in every register, as 64 bits. The time limit of a text starts where its registers are probably
    filled and grows until they are."""
    n = len(bags)
    element = np.concatenate([b[0] for b in bags])
    weight = np.concatenate([b[1] for b in bags]).astype(np.int64)
    owner = np.repeat(np.arange(n), [len(b[0]) for b in bags])
    # the processes: interval [0, 1) of every shingle, then [1, 2), [2, 4), ... of those that reach into it
    states, owners, lengths, below = [_mix(element + np.uint64(0x2545F4914F6CDD1D))], [owner], [np.ones(len(owner))], [np.zeros(len(owner), dtype=np.int64)]
    size = 1
    while True:
        into = np.flatnonzero(weight > size)
        if not len(into):
            break
        states.append(_mix(element[into] ^ np.uint64((size * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)))
        owners.append(owner[into])
        lengths.append(np.full(len(into), float(size)))
        rest = weight[into] - size  # places below this one are used; 0: all of them
        below.append(np.where(rest >= size, 0, rest))
        size *= 2
    waiting = (np.concatenate(states), np.concatenate(owners), np.zeros(sum(map(len, states))), -1.0 / (registers * np.concatenate(lengths)), np.concatenate(below))
    best = np.full(n * registers, np.inf)
    total = np.bincount(owner, weights=weight, minlength=n)
    limit = (np.log(registers) + 1.0) / total
    while True:
        state, owner, time, scale, part = waiting
        held: list[tuple] = []
        while len(state):
            point = _mix(state + np.uint64(0x9E3779B97F4A7C15))
            at = time + np.log(((point >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) * scale
            due = at <= limit[owner]
            if not due.all():
                late = ~due
                held.append((state[late], owner[late], time[late], scale[late], part[late]))
                point, at, owner, scale, part = point[due], at[due], owner[due], scale[due], part[due]
            slot = owner * registers + (point & np.uint64(registers - 1)).astype(np.int64)
            if part.any():
                # the point's place in its interval, by halving: the bits of a second hash
                length = np.rint(-1.0 / (registers * scale)).astype(np.int64)
                place = (_mix(point ^ np.uint64(0xA0761D6478BD642F)) & (length - 1).astype(np.uint64)).astype(np.int64)
                used = (part == 0) | (place < part)
                np.minimum.at(best, slot[used], at[used])
            else:
                np.minimum.at(best, slot, at)
            state, time = point, at
        unfilled = np.isinf(best).reshape(n, registers).any(axis=1)
        if not unfilled.any():
            return best.view(np.uint64).reshape(n, registers)
        limit = np.where(unfilled, limit * 1.4, 0.0)
        parts = [np.concatenate(x) for x in zip(*held, strict=True)]
        keep = unfilled[parts[1]]
        waiting = tuple(x[keep] for x in parts)


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for every band of signature rows, as longs."""
    parts = signature[:, : bands * rows].reshape(len(signature), bands, rows)
    out = np.arange(bands, dtype=np.uint64)[None, :] + np.zeros((len(signature), 1), dtype=np.uint64)
    for k in range(rows):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return out.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two texts' cells: cells are unit weights, so it is plain set overlap."""
    if not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _batch(rows: list[tuple], fields: tuple) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _placed(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def sketch(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, low, high, weight, bands) of every row: two hashes that are the text's identity, its number of
    shingles, and its band keys; null hashes for rows without a shingle."""
    own = _placed(docs).select("uid", "doc_id", F.xxhash64("text").alias("low"), F.xxhash64(F.lit("second"), "text").alias("high"), "text")
    fields = (("uid", pa.int64()), ("doc_id", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("weight", pa.int64()), ("bands", pa.list_(pa.int64())))

    def made(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        # texts of like size side by side: the number of steps is that of the smallest text
        held.sort(key=lambda r: r[4])
        at = 0
        while at < len(held):
            end, size = at, 0
            while end < len(held) and end - at < CHUNK_TEXTS and (end == at or size + len(held[end][5][0]) <= CHUNK):
                size += len(held[end][5][0])
                end += 1
            keys = band_keys(signatures([r[5] for r in held[at:end]])).tolist()
            yield _batch([(*r[:5], k) for r, k in zip(held[at:end], keys, strict=True)], fields)
            at = end

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        blank: list[tuple] = []
        size = 0
        for batch in parts_of(batches, 4):
            ids = [batch.column(k).to_pylist() for k in range(4)]
            shingles, ends = shingles_of(batch.column(4))
            for k, (uid, doc_id, low, high) in enumerate(zip(*ids, strict=True)):
                own = shingles[ends[k] : ends[k + 1]]
                if len(own):
                    bag = np.unique(own, return_counts=True)
                    held.append((uid, doc_id, low, high, len(own), bag))
                    size += len(bag[0])
                else:
                    blank.append((uid, doc_id, None, None, 0, None))
            if size > 5 * CHUNK or len(blank) > CHUNK:
                yield from made(held)
                yield _batch(blank, fields)
                held, blank, size = [], [], 0
        yield from made(held)
        yield _batch(blank, fields)

    return own.mapInArrow(tidy(run), "uid long, doc_id long, low long, high long, weight long, bands array<long>")


def _with_cells(docs: DataFrame, lists: DataFrame, schema: str, entry: Callable[[dict], tuple], kinds: tuple) -> DataFrame:
    """One row (entry's columns, node, cells) for each entry of ``lists`` (node, entries), a node being the place of
    a row with its text. Lists are broadcast while they are few and short, so texts stay where they are."""
    lists = cut_table(lists)
    side = F.broadcast(lists) if few_entries(lists, "entries") else lists
    rows = _placed(docs).select(F.col("uid").alias("node"), "text").join(side, "node").select("node", "text", "entries")
    fields = (*kinds, ("node", pa.int64()), ("cells", pa.binary()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches, 1):
            out: list[tuple] = []
            size = 0
            shingles, ends = shingles_of(batch.column(1))
            for k, (node, entries) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), strict=True)):
                own = cells(shingles[ends[k] : ends[k + 1]]).tobytes()
                for e in entries.as_py():
                    out.append((*entry(e), node, own))
                    size += len(own)
                    if size > 8 * CHUNK:
                        yield _batch(out, fields)
                        out, size = [], 0
            yield _batch(out, fields)

    return rows.mapInArrow(tidy(run), f"{schema}, node long, cells binary")


def _of(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.uint64)


def verify(pairs: DataFrame, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (centre, node) whose exact similarity reaches the threshold."""
    groups = pairs.groupBy("centre").agg(F.count("*").alias("n")).select("centre", F.ceil(F.col("n") / GROUP).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("node", F.lit("part")), F.col("parts")).cast("int")
    members = pairs.join(groups, "centre").select("node", F.struct("centre", part.alias("part"), F.lit(1).alias("role")).alias("e"))
    parts = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    heads = groups.select("centre", parts).select(F.col("centre").alias("node"), F.struct("centre", "part", F.lit(0).alias("role")).alias("e"))
    lists = members.unionByName(heads).groupBy("node").agg(F.collect_list("e").alias("entries"))
    kinds = (("centre", pa.int64()), ("part", pa.int32()), ("role", pa.int32()))
    rows = _with_cells(docs, lists, "centre long, part int, role int", lambda e: (e["centre"], e["part"], e["role"]), kinds)
    rows = rows.repartition("centre", "part").sortWithinPartitions("centre", "part", "role")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, head = None, np.zeros(0, dtype=np.uint64)
        for batch in batches:
            out: list[tuple] = []
            ids = [batch.column(k).to_pylist() for k in range(4)]
            for centre, part, role, node, raw in zip(*ids, batch.column(4), strict=True):
                own = _of(raw.as_py())
                if role == 0:
                    group, head = (centre, part), own
                elif group == (centre, part) and (found := similarity(head, own)) >= threshold:
                    out.append((centre, node, found))
            yield _batch(out, (("centre", pa.int64()), ("node", pa.int64()), ("similarity", pa.float64())))

    return rows.mapInArrow(tidy(run), "centre long, node long, similarity double")


def joining_links(block: list[tuple[int, int, bool, bytes]], within: bool, threshold: float) -> list[tuple[int, int, float]]:
    """Links between components in a block of (node, root, left, cells): enough of those that reach the threshold to
    join all components that they join. ``within``: both sides are the same nodes."""
    left = [k for k, r in enumerate(block) if within or r[2]]
    right = [k for k, r in enumerate(block) if within or not r[2]]
    if not left or not right:
        return []
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    bags = [_of(r[3]) for r in block]
    known, code = np.unique(np.concatenate([bags[k] for k in right]), return_inverse=True)
    owner = np.repeat(np.arange(len(right)), [len(bags[k]) for k in right])
    order = np.argsort(code, kind="stable")
    posting, first = owner[order], np.append(0, np.cumsum(np.bincount(code, minlength=len(known))))
    sizes = np.array([len(bags[k]) for k in right])
    roots = np.array([block[k][1] for k in right])
    out = []
    for k in left:
        node, root, _, _ = block[k]
        own = bags[k]
        if not (roots != root).any():
            continue
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        at = at[known[at] == own]
        n = first[at + 1] - first[at]
        if not len(at):
            continue
        ends = np.cumsum(n)
        places = np.arange(ends[-1]) + np.repeat(first[at] - (ends - n), n)
        both = np.bincount(posting[places], minlength=len(right))
        share = both / (sizes + len(own) - both)
        for j in np.flatnonzero((share >= threshold) & (roots != root)):
            a, b = find(root), find(int(roots[j]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((node, block[right[j]][0], float(share[j])))
    return out


def _search(state: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """Links between components in the groups of ``state`` (gid, node, root, weight). The nodes of a group's largest
    component are one side, cut in parts; the others are cut in parts that meet each other and all of that side."""
    per = state.groupBy("gid", "root").agg(F.sum("weight").alias("w"))
    per = per.groupBy("gid").agg(F.max(F.struct("w", "root")).alias("top"), F.sum("w").alias("w"))
    per = per.select("gid", F.col("top.root").alias("main"), F.ceil((F.col("w") - F.col("top.w")) / BLOCK).cast("int").alias("others"), F.ceil(F.col("top.w") / BLOCK).cast("int").alias("mains"))
    is_main = F.col("root") == F.col("main")
    part = F.pmod(F.xxhash64("node", F.lit("block")), F.when(is_main, F.col("mains")).otherwise(F.col("others"))).cast("int")
    placed = state.join(per, "gid").withColumn("part", part)
    block = lambda a, b, left: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), left.alias("left"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    of_main = F.transform(upto(F.col("others")), lambda i: block(i, F.col("others") + F.col("part"), F.lit(False)))
    among = F.transform(upto(F.col("others")), lambda i: block(F.least(i, F.col("part")), F.greatest(i, F.col("part")), F.col("part") <= i))
    across = F.transform(upto(F.col("mains")), lambda i: block(F.col("part"), F.col("others") + i, F.lit(True)))
    blocks = placed.select("gid", "node", "root", F.explode(F.when(is_main, of_main).otherwise(F.concat(among, across))).alias("k"))
    lists = blocks.groupBy("node").agg(F.collect_list(F.struct("gid", "k.a", "k.b", "k.left", "root")).alias("entries"))
    kinds = (("gid", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("left", pa.bool_()), ("root", pa.int64()))
    rows = _with_cells(docs, lists, "gid long, a int, b int, left boolean, root long", lambda e: (e["gid"], e["a"], e["b"], e["left"], e["root"]), kinds)
    rows = rows.repartition("gid", "a", "b").sortWithinPartitions("gid", "a", "b", "node")
    fields = (("centre", pa.int64()), ("node", pa.int64()), ("similarity", pa.float64()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            out: list[tuple] = []
            ids = [batch.column(k).to_pylist() for k in range(6)]
            for gid, a, b, left, root, node, raw in zip(*ids, batch.column(6), strict=True):
                if key != (gid, a, b):
                    if held:
                        out += joining_links(held, key[1] == key[2], threshold)
                    key, held = (gid, a, b), []
                held.append((node, root, left, raw.as_py()))
            yield _batch(out, fields)
        if held:
            yield _batch(joining_links(held, key[1] == key[2], threshold), fields)

    return rows.mapInArrow(tidy(run), "centre long, node long, similarity double")


def _groups(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """(gid, node, root) of the groups that are to be searched: buckets with several components, of equal ones only
    one; overlapping large buckets as one family where their pairs are more than the family's."""
    state = buckets.join(roots, "node", "left").select("band", "node", "centre", "n", "tried", F.coalesce("root", "node").alias("root"))
    # of two nodes that were verified already nothing is left to compare
    seen = F.max((~F.col("tried") & (F.col("node") != F.col("centre"))).cast("int"))
    marks = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    mixed = state.groupBy("band").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.max("n").alias("n"), seen.alias("untried"), *marks)
    mixed = mixed.filter("least <> most and (n > 2 or untried = 1)").groupBy("n", "x1", "x2").agg(F.min("band").alias("band")).select("band")
    state = cut(state.join(mixed, "band").select("band", "node", "centre", "n", "root"))
    large = state.filter(F.col("n") > LARGE)
    small = state.filter(F.col("n") <= LARGE).select(F.col("band").alias("gid"), "node", "root")
    if not large.limit(1).count():
        return small
    family = cut(components(large.filter("node <> centre").select("centre", "node")).select("node", F.col("root").alias("family")))
    large = large.join(family, "node")
    work = large.groupBy("family").agg(F.sum("n").alias("pairs")).join(family.groupBy("family").agg(F.count("*").alias("m")), "family")
    work = cut(work.select("family", (F.col("m").cast("double") * F.col("m") <= F.col("pairs")).alias("whole")))
    large = large.join(F.broadcast(work) if few_entries(work) else work, "family")
    one = large.filter("whole").select(F.xxhash64("family", F.lit("family")).alias("gid"), "node", "root").distinct()
    return small.unionByName(large.filter("not whole").select(F.col("band").alias("gid"), "node", "root")).unionByName(one)


def _buckets(nodes: DataFrame) -> DataFrame:
    """(band, node, n, centre, tried) of all buckets with several nodes; ``tried`` where the bucket's centre is one
    of the few that the node is verified against."""
    keyed = nodes.select("node", F.explode("bands").alias("band"))
    keyed = cut(keyed.withColumn("n", F.count("*").over(Window.partitionBy("band"))).filter("n > 1").select("band", "node", "n"))
    known = keyed.groupBy("node").agg(F.sum("n").alias("known"))
    centres = keyed.join(known, "node").groupBy("band").agg(F.max(F.struct("known", "node")).alias("c")).select("band", F.col("c.node").alias("centre"))
    of_node = Window.partitionBy("node")
    both = keyed.join(centres, "band").withColumn("shared", F.count("*").over(Window.partitionBy("node", "centre")))
    # the node's own buckets do not count among its centres
    rank = F.dense_rank().over(of_node.orderBy(F.col("centre") == F.col("node"), F.desc("shared"), "centre"))
    return cut(both.withColumn("tried", (rank <= CENTRES) & (F.col("centre") != F.col("node"))).drop("shared"))


def links(docs: DataFrame, nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Verified links (centre, node, similarity) between nodes (node, weight, bands) that join all nodes of a class."""
    buckets = _buckets(nodes)
    found = cut(verify(cut(buckets.filter("tried").select("centre", "node").distinct()), docs, threshold))
    state = _groups(buckets, components(found)).join(nodes.select("node", "weight"), "node")
    return cut(found.unionByName(_search(cut(state), docs, threshold)))


def _labelled(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows (uid, doc_id, low, high), and (low, high, class_id, class_size, lead) for every text of
    a class with several rows, lead being the row that stands for the class."""
    rows = cut_table(sketch(docs))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "uid")).alias("first")
    nodes = rows.filter("low is not null").groupBy("low", "high").agg(F.min("uid").alias("node"), F.first("weight").alias("weight"), F.first("bands").alias("bands"), first, F.count("*").alias("copies"))
    nodes = cut_table(nodes)
    rooted = components(links(docs, nodes.select("node", "weight", "bands"), threshold))
    own = nodes.select("low", "high", "node", "first", "copies").join(rooted, "node", "left").withColumn("root", F.coalesce("root", "node"))
    own = cut(own.select("low", "high", "root", "first", "copies"))
    named = own.groupBy("root").agg(F.min("first").alias("first"), F.sum("copies").alias("class_size")).filter("class_size > 1")
    named = own.select("low", "high", "root").join(named, "root")
    return rows.select("uid", "doc_id", "low", "high"), cut(named.select("low", "high", F.col("first.doc_id").alias("class_id"), "class_size", F.col("first.uid").alias("lead")))


def _with_classes(rows: DataFrame, named: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(named) if few_entries(named) else named, ["low", "high"], "left")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class), class_size, kept (true for one row of each class) for
    every row. Null and blank texts are classes of their own."""
    found = _with_classes(*_labelled(docs, threshold))
    alone = F.col("class_size").isNull()
    return found.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"), (alone | (F.col("uid") == F.col("lead"))).alias("kept"),
    )


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with one row of each class: that of the smallest id. Null and blank texts all stay."""
    own = free_name(docs, "uid")
    gone = cut(_with_classes(*_labelled(docs, threshold)).filter("uid <> lead").select(F.col("uid").alias(own)))
    placed = docs.withColumn(own, F.monotonically_increasing_id())
    return placed.join(F.broadcast(gone) if few_entries(gone) else gone, own, "left_anti").select(*quoted(docs))
