"""Best-fit packing by pattern fitting.

Documents become token ids closed by id 0; longer ones are cut into full pieces and a rest.  What is packed are piece
lengths, of which there are at most ``capacity`` many, so that a histogram of them is small whatever the corpus:

1. patterns, multisets of a few lengths that fill a sequence (nearly), are enumerated from the histogram;
2. non-negative least squares fits how often each pattern is used, and the counts are rounded: down first, then those of
   full patterns up by their remainders, from a half on, as long as there are pieces for them;
3. the pieces left over are packed best-fit decreasing on the histogram, in whole multiples;
4. every piece gets its place from its rank among the pieces of its length, in Spark.

Ranks are counted per slice of a hash of (doc_id, piece), so that a length that a third of all pieces share is spread
over many tasks; only the histogram reaches the driver.

Defined results.  Null text is empty and packs as the single id 0.  Texts of any length are cut, never truncated.
Repeated rows are packed as often as they come, each with its own place.  An empty table packs into no sequence.  A
null doc_id is packed like any other.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.llm import wordpieces
from weft.llm.shared import cut, small_batches
from weft.llm.textblock import blocks

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: A piece's rank is counted within SLICES slices of its length; a slice of a length has 1/SLICES of its pieces.
SLICES = 512
#: Runs of places that are broadcast, at most; each has four numbers.
MOST_BROADCAST = 200_000
#: A fitted pattern is used where it leaves no more places free.
SLACK = 7


def pieces(documents: DataFrame, vocabulary: str, capacity: int, close: int = 0) -> DataFrame:
    """One row a piece: its document, number, start, length and the checksum of its ids."""

    def of(batches):
        for part, block in blocks(batches, size=wordpieces.WORD_BLOCK):
            ids, first = wordpieces.lower_words(vocabulary).ids(block)
            raw, ids4 = ids.astype("<u4").tobytes(), np.uint32(close).tobytes()
            total = np.diff(first) + 1
            n = -(-total // capacity)
            row = np.repeat(np.arange(block.n), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            size = np.minimum(total[row] - start, capacity)
            crc = [zlib.crc32(raw[4 * (a := first[d] + s) : 4 * min(a + k, first[d + 1])] + (ids4 if s + k == total[d] else b"")) for d, s, k in zip(row.tolist(), start.tolist(), size.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size), pa.array(crc, pa.int64())],
                names=[x.split()[0] for x in PIECES.split(", ")],
            )

    return small_batches(documents).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(of, PIECES)


def patterns(lengths: np.ndarray, capacity: int, per_length: int = 12, most: int = 6) -> list[tuple[int, ...]]:
    """Multisets of lengths that there are, with the largest part in front, that fill the capacity as well as any found.

    For each length as largest part: the best partner (two parts), and for a spread of second parts the best third;
    and repeats of one length with the best filler, up to ``most`` parts.  ``per_length`` second parts are tried for each.
    What no pattern covers is packed with the rest, so that these bounds cost fill, and never pieces.
    """
    have = np.sort(lengths)
    best = np.zeros(capacity + 1, dtype=np.int64)  # the largest length there is that isn't above
    best[have] = have
    best = np.maximum.accumulate(best)
    found = set()
    for a in have.tolist():
        room = capacity - a
        if room < have[0]:
            found.add((a,))
            continue
        if best[room]:
            found.add(tuple(sorted((a, int(best[room])), reverse=True)))
        upper = have[: np.searchsorted(have, min(a, room), side="right")]
        for b in upper[np.unique(np.linspace(0, len(upper) - 1, per_length).astype(int))].tolist() if len(upper) else []:
            parts, left = [a, b], room - b
            while left > 0 and best[left] and len(parts) < most:
                parts.append(int(best[left]))
                left -= parts[-1]
            found.add(tuple(sorted(parts, reverse=True)))
        if a <= capacity // 2:
            k = min(most - 1, capacity // a)
            left = capacity - k * a
            found.add(tuple(sorted([a] * k + ([int(best[left])] if best[left] else []), reverse=True)))
    return sorted(found, key=lambda p: (-sum(p), p))


def nonnegative_fit(found: list[tuple[int, ...]], histogram: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """Counts c >= 0 of the patterns that minimise |A c - histogram|**2, A having each pattern's parts as a column.

    Projected gradient with Nesterov's momentum on the sparse matrix; the step is from its largest row and column sums.
    """
    column = np.repeat(np.arange(len(found)), [len(p) for p in found])
    row = np.array([x for p in found for x in p])
    n = len(histogram)
    times = lambda c: np.bincount(row, weights=c[column], minlength=n)
    back = lambda r: np.bincount(column, weights=r[row], minlength=len(found))
    scale = 1 / np.maximum(back(times(np.ones(len(found)))), 1)  # a diagonal bound on A'A
    c = y = np.zeros(len(found))
    t = 1.0
    for _ in range(sweeps):
        after = np.maximum(0, y + scale * back(histogram - times(y)))
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y = after + (last - 1) / t * (after - c)
        c = after
    return c


def _fits(part: dict[int, int], left: np.ndarray) -> int:
    return min(int(left[x]) // k for x, k in part.items())


def _counted(pattern) -> dict[int, int]:
    out: dict[int, int] = {}
    for x in pattern:
        out[x] = out.get(x, 0) + 1
    return out


def plan(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, how many sequences) that use up the histogram: ``histogram[n]`` pieces of length n."""
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    lengths = np.flatnonzero(left)
    if not len(lengths):
        return out
    if left[capacity]:
        out.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    found = patterns(np.flatnonzero(left), capacity) if left.any() else []
    if found:
        fitted = nonnegative_fit(found, left.astype(float))
        whole = np.floor(fitted + 1e-6).astype(np.int64)
        # Patterns that leave more than a few places free are left to the search for the rest; those rounded up must be full.
        size = np.array([sum(p) for p in found])
        by_fill = np.argsort([sum(p) for p in found], kind="stable")[::-1]
        by_rest = np.lexsort((np.arange(len(found)), whole - fitted))
        for order, times, least in ((by_fill, whole, capacity - SLACK), (by_rest, (fitted - whole >= 0.5).astype(np.int64), capacity)):
            for k in order[(size[order] >= least) & (times[order] > 0)].tolist():
                part = _counted(found[k])
                n = min(int(times[k]), _fits(part, left))
                if n:
                    out.append((found[k], n))
                    for x, m in part.items():
                        left[x] -= n * m
    # What is left: largest first, each time filled up with the largest that fits; used as often as the counts allow.
    have = np.flatnonzero(left).tolist()
    while have:
        a = have[-1]
        part, room = [a], capacity - a
        left[a] -= 1
        while room and (k := bisect_right(have, room)):
            while k and not left[have[k - 1]]:
                k -= 1
            if not k:
                break
            x = _closest(have, left, room, k - 1)
            for b in x:
                part.append(b)
                left[b] -= 1
                room -= b
        for x in part:
            left[x] += 1
        counted = _counted(part)
        n = _fits(counted, left)
        for x, m in counted.items():
            left[x] -= n * m
            if not left[x]:
                have.remove(x)
        out.append((tuple(part), n))
    return out


def _closest(have: list[int], left: np.ndarray, room: int, top: int) -> tuple[int, ...]:
    """The one length, or the two, that there are and that fill ``room`` best; one wins a tie."""
    one = have[top]
    if one == room:
        return (one,)
    low, high, best = 0, top, (one,)
    while low <= high:
        a, b = have[low], have[high]
        if a + b > room or not left[b] or (a == b and left[a] < 2):
            high -= 1
        elif not left[a]:
            low += 1
        else:
            if a + b > sum(best):
                best = (b, a)
                if a + b == room:
                    break
            low += 1
    return best


def places(planned: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, number of sequences, first sequence, offset): rank first + i goes to sequence first + i there."""
    out, used, sequence = [], {}, 0
    for pattern, n in planned:
        at = 0
        for x in pattern:
            rank = used.get(x, 0)
            out.append((x, rank, n, sequence, at))
            used[x] = rank + n
            at += x
        sequence += n
    return out


def pack(documents: DataFrame, vocabulary: str, capacity: int = 2048, close: int = 0) -> DataFrame:
    """Every piece with the sequence it is in and its offset there."""
    spark = documents.sparkSession
    # Ranks need the same rows each time; the written table also ends the lineage, so that a lost executor costs little.
    written = cut(pieces(documents, vocabulary, capacity, close))
    slice_ = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SLICES)).cast("int").alias("slice")
    rows = written.withColumn("slice", slice_)
    counts = rows.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("slice")) - F.col("n")
    counts = cut(counts.withColumn("before", before))
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for x, n in counts.groupBy("length").agg(F.sum("n")).collect():  # at most ``capacity`` rows
        histogram[x] = n
    where = places(plan(histogram, capacity))
    local = F.row_number().over(Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = rows.withColumn("local", local).join(counts.drop("n"), ["length", "slice"]).withColumn("rank", F.col("before") + F.col("local"))
    # The plan's rows follow the number of patterns, which the capacity bounds and the corpus doesn't.
    by_length: dict[int, list[tuple[int, int, int, int]]] = {}
    for x, rank, n, sequence, at in where:
        by_length.setdefault(x, []).append((rank, n, sequence, at))
    table = spark.createDataFrame(
        [(x, [list(map(int, r)) for r in sorted(rs)]) for x, rs in by_length.items()] or [], "length long, runs array<array<long>>"
    )
    run = F.element_at(F.filter("runs", lambda r: (r[0] <= F.col("rank")) & (F.col("rank") < r[0] + r[1])), 1)
    table = F.broadcast(table) if len(where) <= MOST_BROADCAST else table
    return (
        ranked.join(table, "length")
        .withColumn("run", run)
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("run")[2] + F.col("rank") - F.col("run")[0]).alias("sequence_id"), F.col("run")[3].alias("offset"))
    )
