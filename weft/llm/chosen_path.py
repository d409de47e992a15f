"""Near-duplicate join on word n-grams by chosen paths.

A document is the set of its five-word shingles (all its words, if it has fewer than five).  Documents with one set, by
its size and two 64-bit fingerprints, are a class and are represented once, so that copies never meet.  Each set has a min-hash signature; its values are the
tokens on which sets are split:

* At the root, as many positions are chosen as the target recall takes; sets with the same value share a node.
* A node with too many sets is split again on further positions, several times over, first in Spark, then in the task
  that holds it; nodes that are small, or whose sets are all alike, are compared by brute force on signatures.
* Sets that may be similar are linked to one pivot each, never in all pairs.  Components of these links are checked
  exactly on whole sets of shingles, which are compared word by word; a large component is checked in blocks of chunk
  against chunk.

The result has one row for each document: its class (the smallest doc_id it is linked to, over any number of links) and
the number of documents it is linked to directly, copies included.

Defined results.  A null text or one without words is linked to nothing and is its own class.  Texts are read whole.
Repeated rows count as documents.  A null doc_id never names a class unless no document there has an id.  An empty
table gives an empty table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.components import components
from weft.llm.repeats import groups, table_bytes
from weft.llm.shared import cut, small_batches
from weft.llm.stats import doc_of
from weft.llm.textblock import Block, blocks, mix, sequence_codes, window_codes, window_starts

TOKENS = 64
#: Compressed bytes of the table for each bucket of nodes or of components.
BUCKET_BYTES = 4 << 20


@dataclass(frozen=True)
class Join:
    """similarity is numerator / denominator; recall is for a pair right at it."""

    width: int = 5
    numerator: int = 4
    denominator: int = 5
    recall: float = 0.9999
    #: A node of more sets is split again in Spark; one of more than brute sets is split within its task.
    node: int = 50_000
    brute: int = 256
    #: Components of more classes are checked in blocks of so many.
    chunk: int = 2500
    seed: int = 11

    @property
    def similarity(self) -> float:
        return self.numerator / self.denominator

    @property
    def paths(self) -> int:
        """Positions chosen at a node so that a pair meets in one of them with the target recall."""
        return math.ceil(math.log(1 - self.recall) / math.log(1 - self.similarity))

    @property
    def likely(self) -> int:
        """Signature tokens two sets must share to be checked: four standard deviations below the mean."""
        s = self.similarity
        return int(TOKENS * s - 4 * math.sqrt(TOKENS * s * (1 - s)))


def shingles(block: Block, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each document, by document: their hashes, and their documents."""
    _, _, code, first = block.words
    start, short = _shingle_starts(first, width)
    key = np.concatenate([window_codes(code, width)[start], sequence_codes(code, first[short], first[short + 1])])
    return _distinct(key, np.concatenate([doc_of(first)[start], short]))


def numbered_shingles(block: Block, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with numbers that are the block's own, by the words themselves: equal for equal shingles and no others."""
    first, word = block.words[3], block.numbers
    start, short = _shingle_starts(first, width)
    number, span = word.astype(np.int64), 1
    while span < width and len(number) > min(span, width - span):
        step = min(span, width - span)  # numbers of pairs of numbers stand for twice as many words
        number, span = pd.factorize(number[:-step] << 32 | number[step:])[0], span + step
    whole = number[start] if len(start) else start
    known: dict[bytes, int] = {}
    few = [-1 - known.setdefault(word[a:z].tobytes(), len(known)) for a, z in zip(first[short].tolist(), first[short + 1].tolist(), strict=True)]
    return _distinct(np.concatenate([whole, np.array(few, dtype=np.int64)]), np.concatenate([doc_of(first)[start], short]))


def _shingle_starts(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the windows begin, and the documents that have some words but no window."""
    count = np.diff(first)
    return np.flatnonzero(window_starts(first, width)), np.flatnonzero((count > 0) & (count < width))


def _distinct(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    return key[new], doc[new]


def fingerprints(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums that name each set, whatever the order of its members."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    one = np.add.reduceat(mix(key ^ np.uint64(0x5851F42D4C957F2D)), at)
    two = np.add.reduceat(mix(key + np.uint64(0x14057B7EF767814F)), at)
    return one.view(np.int64), two.view(np.int64)


SKETCH = "doc_id long, th long, n long, f1 long, f2 long, sig binary, nodes array<long>"


def sketches(documents: DataFrame, how: Join) -> DataFrame:
    """For each document: the size and name of its set, its signature, and the nodes it chooses at the root."""
    rng = np.random.default_rng(how.seed)
    flip = rng.integers(0, 1 << 32, TOKENS, dtype=np.uint32)
    times = rng.integers(0, 1 << 31, TOKENS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    chosen = rng.choice(TOKENS, how.paths, replace=False)

    def of(batches):
        for part, block in blocks(batches):
            key, doc = shingles(block, how.width)
            at = groups(doc)
            some = doc[at]
            n, f1, f2 = (np.zeros(block.n, np.int64) for _ in range(3))
            n[some] = np.diff(np.append(at, len(key)))
            f1[some], f2[some] = fingerprints(key, at)
            high = (key >> np.uint64(32)).astype(np.uint32)
            low = np.stack([np.minimum.reduceat((high ^ b) * a, at) for a, b in zip(times, flip, strict=True)], axis=1) if len(at) else np.zeros((0, TOKENS), np.uint32)
            token = mix(low.astype(np.uint64) + np.arange(TOKENS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            sig, nodes = (token & np.uint64(0xFFFF)).astype("<u2"), token[:, chosen].view(np.int64)
            row = np.full(block.n, -1)
            row[some] = np.arange(len(some))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), part.column("th"), pa.array(n), pa.array(f1), pa.array(f2),
                    pa.array([sig[k].tobytes() if k >= 0 else None for k in row.tolist()], pa.binary()),
                    pa.array([nodes[k] if k >= 0 else None for k in row.tolist()], pa.list_(pa.int64())),
                ],
                names=[x.split()[0] for x in SKETCH.split(", ")],
            )

    return documents.mapInArrow(of, SKETCH)


# Within a task: nodes of signatures.


def alike(sig: np.ndarray, likely: int) -> list[tuple[int, np.ndarray]]:
    """Components of sets that share ``likely`` tokens: (pivot, others). Each set is compared with the unassigned only."""
    out, free = [], np.arange(len(sig))
    while len(free) > 1:
        pivot, free = free[0], free[1:]
        found, wave = [], np.array([pivot])
        while len(wave) and len(free):
            some, wave = wave[:32], wave[32:]
            near = np.zeros(len(free), dtype=bool)
            for k in range(0, len(free), 4096):
                near[k : k + 4096] = ((sig[free[k : k + 4096], None] == sig[some]).sum(axis=2) >= likely).any(axis=1)
            found.append(free[near])
            wave, free = np.concatenate([wave, free[near]]), free[~near]
        others = np.concatenate([*found, np.zeros(0, np.int64)])
        if len(others):
            out.append((int(pivot), others))
    return out


def links_in(sig: np.ndarray, how: Join, rng: np.random.Generator, depth: int = 0) -> list[tuple[int, np.ndarray]]:
    """Pivot links between the sets of a node: split on sampled positions until nodes are small or alike."""
    if len(sig) <= how.brute or depth > 12:
        return alike(sig, how.likely)
    out = []
    for position in rng.choice(TOKENS, how.paths, replace=False).tolist():
        order = np.argsort(sig[:, position], kind="stable")
        edge = groups(sig[order, position])
        for a, z in zip(edge.tolist(), np.append(edge[1:], len(sig)).tolist(), strict=True):
            mine = order[a:z]
            if len(mine) > 1:
                # Where a split takes most of a node, its sets are alike, and one pivot finds nearly all of them.
                inner = alike(sig[mine], how.likely) if len(mine) > 0.8 * len(sig) else links_in(sig[mine], how, rng, depth + 1)
                out += [(int(mine[p]), mine[o]) for p, o in inner]
    return out


def pivot_links(table: pa.Table, how: Join) -> pa.Table:
    node, cid = np.array(table.column("node")), np.array(table.column("cid"))
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u2").reshape(-1, TOKENS)
    order = np.argsort(node, kind="stable")
    edge = groups(node[order])
    size = np.diff(np.append(edge, len(node)))
    u, v = [], []
    for a, n in zip(edge[size > 1].tolist(), size[size > 1].tolist(), strict=True):
        mine = order[a : a + n]
        mine = mine[np.argsort(cid[mine])]
        mine = mine[np.append(True, np.diff(cid[mine]) != 0)]
        if len(mine) > 1:
            rng = np.random.default_rng(abs(int(node[mine[0]])))
            for pivot, others in links_in(sig[mine], how, rng):
                u.append(np.full(len(others), cid[mine[pivot]]))
                v.append(cid[mine[others]])
    none = np.zeros(0, np.int64)
    pairs = np.stack([np.concatenate([*u, none]), np.concatenate([*v, none])], axis=1)
    pairs = pairs[np.lexsort(pairs.T)]
    pairs = pairs[np.append(True, (np.diff(pairs, axis=0) != 0).any(axis=1))] if len(pairs) else pairs
    return pa.table({"u": pairs[:, 0], "v": pairs[:, 1]})


def split_in_spark(level: DataFrame, how: Join) -> DataFrame:
    """Nodes with more than how.node sets are split on further positions, each set going to some of the children."""
    for depth in range(6):
        big = cut(level.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > how.node).select("node"))
        if big.isEmpty():
            return level
        position = lambda j: F.pmod(F.xxhash64("node", F.lit(depth), F.lit(j)), F.lit(TOKENS)).cast("int")
        child = [F.xxhash64("node", F.lit(j), F.substring(F.col("sig"), 2 * position(j) + 1, F.lit(2))) for j in range(how.paths)]
        deeper = level.join(big, "node", "left_semi").withColumn("node", F.explode(F.array(*child)))
        level = cut(level.join(big, "node", "left_anti").unionByName(deeper))
    return level


# Within a task: exact checks.


def check(keys: list[np.ndarray], side: np.ndarray | None, copies: np.ndarray, how: Join) -> tuple[np.ndarray, np.ndarray]:
    """Links of each set (each weighing its copies) and the least index it is connected to; with sides, only across."""
    n = len(keys)
    size = np.array([len(k) for k in keys], dtype=np.int64)
    flat, doc = np.concatenate(keys), np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    flat, doc = flat[order], doc[order]
    edge = groups(flat)
    count = np.diff(np.append(edge, len(flat)))
    column = np.repeat(np.cumsum(count > 1) - 1, count)
    keep = np.repeat(count > 1, count)
    column, doc = column[keep], doc[keep]
    inter = np.zeros((n, n), dtype=np.float32)
    width = max(256, min(4096, (16 << 20) // max(n, 1) // 4))
    top = int(column[-1]) + 1 if len(column) else 0
    for a in range(0, top, width):
        lo, hi = np.searchsorted(column, [a, a + width])
        part = np.zeros((n, min(width, top - a)), dtype=np.float32)
        part[doc[lo:hi], column[lo:hi] - a] = 1
        inter += part @ part.T
    common = inter.astype(np.int64) if n <= 512 else inter
    link = common * (how.numerator + how.denominator) >= how.numerator * (size[:, None] + size)
    np.fill_diagonal(link, False)
    if side is not None:
        link &= side[:, None] != side
    label, free = np.arange(n), np.ones(n, dtype=bool)
    for k in range(n):
        if free[k]:
            free[k], wave = False, np.array([k])
            while len(wave):
                wave = np.flatnonzero(link[wave].any(axis=0) & free)
                free[wave], label[wave] = False, k
    return link @ copies, label


def checked(table: pa.Table, how: Join) -> pa.Table:
    """(cid, to, links) for the classes of each unit of a bucket; a unit is a component, or two chunks of one."""

    block = Block.of(table.column("text"))
    key, doc = numbered_shingles(block, how.width)
    at = np.searchsorted(doc, np.arange(block.n + 1))
    sets = [key[a:z] for a, z in zip(at, at[1:])]
    key, doc = shingles(block, how.width)
    at = np.searchsorted(doc, np.arange(block.n + 1))
    f1, f2 = np.zeros(block.n, np.int64), np.zeros(block.n, np.int64)
    some = np.flatnonzero(np.diff(at))
    f1[some], f2[some] = fingerprints(key, at[:-1][some])
    cid, unit, chunk, within, copies = (np.array(table.column(c)) for c in ("cid", "unit", "chunk", "within", "copies"))
    right = np.flatnonzero(cid == f1)
    order = right[np.lexsort((cid[right], unit[right]))]
    order = order[np.append(True, (np.diff(unit[order]) != 0) | (np.diff(cid[order]) != 0))] if len(order) else order
    out = []
    edge = groups(unit[order])
    for a, z in zip(edge.tolist(), np.append(edge[1:], len(order)).tolist()):
        mine = order[a:z]
        if len(mine) > 1:
            side = None if within[mine[0]] else chunk[mine] != chunk[mine[0]]
            links, label = check([sets[k] for k in mine.tolist()], side, copies[mine], how)
            out.append(np.stack([cid[mine], cid[mine[label]], links.astype(np.int64)]))
    cid, to, links = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
    return pa.table({"cid": cid, "to": to, "links": links})


def join(documents: DataFrame, how: Join = Join()) -> DataFrame:
    """doc_id, class_id and n_links of every document."""
    spark = documents.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Buckets follow the data: signatures and texts of one take some MB, whatever the table.
    buckets = max(8 * tasks, table_bytes(documents) // BUCKET_BYTES)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = small_batches(documents).select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("th"))
    sketch = cut(sketches(docs, how))
    named = F.struct(F.col("doc_id").isNull(), "doc_id", "th")
    classes = sketch.filter("n > 0").groupBy("f1", "f2", "n").agg(F.min(named).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"), F.first("nodes").alias("nodes"))
    classes = cut(classes.select(F.col("f1").alias("cid"), F.col("rep.doc_id").alias("rep"), F.col("rep.th").alias("th"), "copies", "sig", "nodes"))
    level = split_in_spark(classes.select(F.explode("nodes").alias("node"), "cid", "sig"), how)
    bucket = F.pmod(F.xxhash64("node"), F.lit(buckets)).cast("int").alias("bucket")
    likely = level.select("node", "cid", "sig", bucket).groupBy("bucket").applyInArrow(lambda t: pivot_links(t, how), "u long, v long")
    member = components(likely).select(F.col("u").alias("cid"), F.col("v").alias("top"))
    member = member.unionByName(member.select(F.col("top").alias("cid"), "top").distinct())
    # Units of exact work: a component, or for a large one each pair of its chunks.
    chunks = member.groupBy("top").agg(F.ceil(F.count(F.lit(1)) / how.chunk).cast("int").alias("chunks"))
    units = cut(member.join(chunks, "top").join(classes.select("cid", "rep", "th", "copies"), "cid").withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int")))
    several = not units.filter("chunks > 1").isEmpty()
    dealt = units.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    unit = F.xxhash64("top", F.least("chunk", "other"), F.greatest("chunk", "other"))
    dealt = dealt.select("cid", "rep", "th", "copies", "chunk", (F.col("chunk") == F.col("other")).alias("within"), unit.alias("unit"), F.pmod(unit, F.lit(buckets)).cast("int").alias("bucket"))
    texts = docs.withColumnRenamed("th", "of").withColumnRenamed("doc_id", "id")
    full = dealt.join(texts, (F.col("th") == F.col("of")) & F.col("rep").eqNullSafe(F.col("id"))).select("bucket", "unit", "cid", "chunk", "within", "copies", "text")
    found = cut(full.groupBy("bucket").applyInArrow(lambda t: checked(t, how), "cid long, to long, links long"))
    linked = found.groupBy("cid").agg(F.sum("links").alias("links"))
    ties = found.filter("cid != to").select(F.col("cid").alias("u"), F.col("to").alias("v"))
    top = components(ties).select(F.col("u").alias("cid"), F.col("v").alias("top")) if several else ties.select(F.col("u").alias("cid"), F.col("v").alias("top"))
    known = classes.select("cid", "rep", "copies").join(top, "cid", "left").join(linked, "cid", "left").withColumn("top", F.coalesce("top", "cid"))
    first = known.groupBy("top").agg(F.min("rep").alias("class_id"))
    known = known.join(first, "top").select("cid", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    own = sketch.select("doc_id", F.when(F.col("n") > 0, F.col("f1")).alias("cid"))
    return own.join(known, "cid", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def first_of_each(documents: DataFrame, how: Join = Join()) -> DataFrame:
    """One document of each class: the one with the smallest doc_id, columns as they are.

    Repeated rows and rows without a doc_id are copies like any other: of rows with the least doc_id one stays, and of a
    class without ids one, too.  A text without words is a class of its own and stays, each time.  Rows are told apart by
    their numbers in the input, which must give the same rows in the same order whenever it is read, as files do.
    """
    row = "row"
    while row in {c.lower() for c in documents.columns}:
        row += "_"
    numbered = documents.withColumn(row, F.monotonically_increasing_id())
    rows = numbered.select(F.col(row).alias("number"), F.col("doc_id").cast("long").alias("own"))
    found = join(numbered.select(F.col(row).alias("doc_id"), "text"), how).select(F.col("doc_id").alias("number"), "class_id")
    first = found.join(rows, "number").groupBy("class_id").agg(F.min(F.struct(F.col("own").isNull(), "own", "number")).alias("first")).select("first.number")
    gone = found.select("number").join(first, "number", "left_anti").select(F.col("number").alias(row))
    return numbered.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in documents.columns])
