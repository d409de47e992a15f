"""Which fixed-width windows of a corpus repeat, without a record for every window.

Windows are grouped by anchors: something inside the window that is chosen by the window's content alone, so that equal
windows choose the same anchor at the same place.  Consecutive windows with one anchor form a run.  Four passes:

1. Each part (documents by a hash) lists its anchors' names; a bucket by name marks the names that can have a repeat.
2. Each part sends, for marked names, its distinct runs (name and content) once, with a count or a smallest doc_id.
3. A bucket settles each name.  Where all runs are the same, the totals decide; else the windows are told apart.  Names
   and keys only bring together: what counts as equal is compared byte by byte, or word by word.
4. Each part reads off which windows of its documents repeat.

A name with very many different runs (a passage that is common in ever different surroundings) would gather them all in
one bucket.  Its runs are taken apart into windows, each with a name of its own, which spreads them.

Names and runs travel as packed arrays, one row a part and bucket, and the answers as one bit each.  A group of copies,
however large, is one entry for each part.  Documents are dealt once; all passes read the same exchange.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.shared import small_batches
from weft.llm.textblock import Block, verified_classes

ROWS = "bucket int, part int, kind int, a binary, b binary, c binary, d binary, e binary, size long"
NAMES = [x.split()[0] for x in ROWS.split(", ")]
ARROW = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("kind", pa.int32()), *((x, pa.binary()) for x in "abcde"), ("size", pa.int64())])
#: Compressed bytes of the table for a part.
PART_BYTES = 2 << 20


@dataclass
class Runs:
    """Runs of windows of a block. start:end are window starts; anchor is the anchor's place from start."""

    name: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    anchor: np.ndarray
    key: np.ndarray

    def take(self, at) -> "Runs":
        return Runs(*(x[at] for x in vars(self).values()))


def table_bytes(df: DataFrame) -> int:
    """Spark's estimate of the input's size, or what its shuffle partitions would hold where it has none; no job runs."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4 * PART_BYTES


def parts_of(table: pa.Table) -> list[tuple[pa.Table, Block]]:
    """The documents of a part in blocks, in an order that doesn't depend on how they came."""
    from weft.llm.textblock import blocks

    table = table.sort_by([("doc_id", "ascending")]).combine_chunks()
    return list(blocks(table.to_batches()))


def packed(part: int, bucket: np.ndarray, kind: int, buckets: int, *columns: np.ndarray) -> list[dict]:
    """Rows of slices of the columns for each bucket that has any; ``bucket`` ascends."""
    edge = np.searchsorted(bucket, np.arange(buckets + 1))
    return [
        {"bucket": k, "part": part, "kind": kind, **{n: c[edge[k] : edge[k + 1]].tobytes() for n, c in zip("abcde", columns)}, "size": 0}
        for k in np.flatnonzero(np.diff(edge)).tolist()
    ]


def groups(key: np.ndarray) -> np.ndarray:
    """Where each group of equal entries of an ascending array starts."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)


class Repeats:
    """``windows`` finds runs and settles names; ``parts`` and ``buckets`` are how many of each there are."""

    def __init__(self, windows, parts: int, hot: int = 4096):
        self.windows, self.parts, self.buckets = windows, parts, max(24, parts // 2)
        #: Different runs of a name above which it is taken apart. One run that every part has counts ``parts`` times.
        self.hot = max(hot, 2 * parts) if hot >= 4096 else hot

    def bucket(self, name: np.ndarray) -> np.ndarray:
        return ((name >> np.uint64(40)) * np.uint64(self.buckets) >> np.uint64(24)).astype(np.int64)

    # Pass 1

    def listed(self, table: pa.Table):
        """The part's blocks with their runs and ids, and its distinct names."""
        found = []
        for rows, block in parts_of(table):
            runs = self.windows.runs(block, rows.column("doc_id"))
            found.append((rows, block, runs, self.windows.ids(rows)))
        name = np.sort(np.concatenate([r.name for _, _, r, _ in found] or [np.zeros(0, np.uint64)]))
        return found, name[groups(name)]

    def names(self, table: pa.Table) -> pa.Table:
        """The part's names, each with whether it repeats within the part, and how many different runs it has there (up to 255)."""
        found, distinct = self.listed(table)
        name, ids, key = (np.concatenate([x for x in some] or [np.zeros(0, t)]) for some, t in (((r.name for _, _, r, _ in found), np.uint64), ((i[r.doc] for _, _, r, i in found), np.int64), ((r.key for _, _, r, _ in found), np.uint64)))
        order = np.argsort(name, kind="stable")
        at = groups(name[order])
        many, size = self.windows.many(ids[order], at), np.diff(np.append(at, len(name)))
        # Most names have one run; the others are looked at by key, too.
        several = order[np.repeat(size > 1, size)]
        several = several[np.lexsort((key[several], name[several]))]
        new = np.ones(len(several), dtype=np.int64)
        new[1:] = (key[several[1:]] != key[several[:-1]]) | (name[several[1:]] != name[several[:-1]])
        different = np.ones(len(at), dtype=np.int64)
        if len(several):
            different[size > 1] = np.add.reduceat(new, groups(name[several]))
        part = table.column("part")[0].as_py()
        rows = packed(part, self.bucket(distinct), 0, self.buckets, distinct | many.astype(np.uint64), np.minimum(different, 255).astype(np.uint8))
        return pa.Table.from_pylist(rows, schema=ARROW)

    def mark(self, table: pa.Table) -> pa.Table:
        """For each part's names of this bucket two bits: whether the name is in another part too or repeats within, and
        whether it is to be taken apart."""
        rows = table.select(["part", "a", "b"]).to_pylist()
        every = np.concatenate([np.frombuffer(r["a"], np.uint64) for r in rows])
        name, many = every >> np.uint64(1), (every & np.uint64(1)).astype(bool)
        order = np.argsort(name, kind="stable")
        at = groups(name[order])
        count = np.diff(np.append(at, len(name)))
        shared = np.empty(len(name), dtype=bool)
        shared[order] = np.repeat((count > 1) | np.bitwise_or.reduceat(many[order], at), count)
        different = np.frombuffer(b"".join(r["b"] for r in rows), np.uint8).astype(np.int64)
        apart = np.empty(len(name), dtype=bool)
        apart[order] = np.repeat(np.add.reduceat(different[order], at) > self.hot, count)
        out, k, bucket = [], 0, table.column("bucket")[0].as_py()
        for r in rows:
            n = len(r["a"]) // 8
            out.append({"bucket": bucket, "part": r["part"], "kind": 1, "a": np.packbits(shared[k : k + n]).tobytes(), "b": np.packbits(apart[k : k + n]).tobytes(), "size": n})
            k += n
        return pa.Table.from_pylist(out, schema=ARROW)

    # Pass 2

    @staticmethod
    def bits(answers: pa.Table, kind: int, column: str = "a") -> np.ndarray:
        """The answers to what a part sent, in bucket order."""
        rows = sorted((r for r in answers.to_pylist() if r["kind"] == kind), key=lambda r: r["bucket"])
        return np.concatenate([np.unpackbits(np.frombuffer(r[column], np.uint8))[: r["size"]] for r in rows] or [np.zeros(0, np.uint8)]).astype(bool)

    def classes(self, found, name: np.ndarray, shared: np.ndarray, apart: np.ndarray):
        """The distinct runs under shared names, by name and key: where each was found first, its statistic; and each found run's class."""
        kept, which, ids = [], [], []
        for k, (_, block, runs, doc_ids) in enumerate(found):
            at = np.searchsorted(name, runs.name)
            mine = runs.take(np.flatnonzero(shared[at] & ~apart[at]) if len(name) else at)
            if len(name) and (split := np.flatnonzero(shared[at] & apart[at])).size:
                single = self.singles(block, runs.take(split))
                mine = Runs(*(np.concatenate(x) for x in zip(vars(mine).values(), vars(single).values(), strict=True)))
            kept.append(mine)
            which.append(np.full(len(mine.name), k))
            ids.append(doc_ids[mine.doc])
        runs = Runs(*(np.concatenate([vars(r)[x] for r in kept] or [np.zeros(0, np.int64)]) for x in ("name", "doc", "start", "end", "anchor", "key")))
        which, ids = np.concatenate(which or [np.zeros(0, np.int64)]), np.concatenate(ids or [np.zeros(0, np.int64)])
        flat, base = self.windows.flat([block for _, block, _, _ in found])
        order, at, number = self.same_runs(runs.name, runs.key, flat, base[which] + runs.start, runs.end - runs.start)
        return runs, which, number, order[at], self.windows.statistic(ids[order], at), ids

    def same_runs(self, name, key, flat, begin, length):
        """Runs of the same name, key and content, which is compared: an order, where each class starts, each run's class."""
        size = length + self.windows.width - 1
        same = lambda i, j: (size[i] == size[j]) & self.windows.equal(flat, begin[i], begin[j], np.minimum(size[i], size[j]))
        return verified_classes((name, key), same, lambda i: flat[begin[i] : begin[i] + size[i]].tobytes())

    def singles(self, block: Block, runs: Runs) -> Runs:
        """Each window of the runs as a run with a name of its own."""
        n = runs.end - runs.start
        start = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(runs.start, n)
        name, key = self.windows.window_names(block, start)
        return Runs(name & ~np.uint64(1), np.repeat(runs.doc, n), start, start + 1, np.zeros(len(start), np.int64), key)

    def send(self, table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return ARROW.empty_table()
        part = table.column("part")[0].as_py()
        found, name = self.listed(table)
        shared, apart = self.bits(answers, 1), self.bits(answers, 1, "b")
        runs, which, _, first, statistic, _ = self.classes(found, name, shared, apart)
        one = runs.take(first)
        out = [{"bucket": part % self.buckets, "part": part, "kind": 3, "a": np.packbits(shared).tobytes(), "b": np.packbits(apart).tobytes(), "size": len(shared)}]
        edge = np.searchsorted(self.bucket(one.name), np.arange(self.buckets + 1))
        where = which[first]
        for k in np.flatnonzero(np.diff(edge)).tolist():
            s = slice(edge[k], edge[k + 1])
            head = np.stack([one.name[s], one.key[s]]).tobytes()
            shape = np.stack([one.end[s] - one.start[s], one.anchor[s]]).astype(np.uint16).tobytes()
            load = self.windows.load([(found[w][1], a, z) for w, a, z in zip(where[s].tolist(), one.start[s].tolist(), one.end[s].tolist(), strict=True)])
            out.append({"bucket": k, "part": part, "kind": 2, "a": head, "b": statistic[s].tobytes(), "c": shape, "d": pa.compress(load, codec="zstd", asbytes=True), "size": len(load)})
        return pa.Table.from_pylist(out, schema=ARROW)

    # Pass 3

    def settle(self, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out = [r for r in rows if r["kind"] == 3]
        rows = [r for r in rows if r["kind"] == 2]
        if rows:
            head = np.concatenate([np.frombuffer(r["a"], np.uint64).reshape(2, -1) for r in rows], axis=1)
            statistic = np.concatenate([np.frombuffer(r["b"], np.int64) for r in rows])
            shape = np.concatenate([np.frombuffer(r["c"], np.uint16).reshape(2, -1) for r in rows], axis=1).astype(np.int64)
            load = np.frombuffer(b"".join(pa.decompress(r["d"], r["size"], codec="zstd", asbytes=True) for r in rows), np.uint8)
            flags = self.windows.settle(self, head[0], head[1], statistic, shape[0], shape[1], load)
            ends = np.concatenate([[0], np.cumsum(shape[0])])
            k = 0
            for r in rows:
                n = len(r["b"]) // 8
                mine = flags[ends[k] : ends[k + n]]
                out.append({"bucket": r["bucket"], "part": r["part"], "kind": 2, "a": np.packbits(mine).tobytes(), "size": len(mine)})
                k += n
        return pa.Table.from_pylist(out, schema=ARROW)

    # Pass 4

    def repeated(self, table: pa.Table, answers: pa.Table):
        """For each block of the part: its rows, the block, and the window starts that repeat."""
        found, name = self.listed(table)
        runs, which, number, first, statistic, ids = self.classes(found, name, self.bits(answers, 3), self.bits(answers, 3, "b"))
        flags = self.bits(answers, 2)
        length = (runs.end - runs.start)[first]
        begin = np.cumsum(length) - length
        n = runs.end - runs.start
        window = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        hit = flags[np.repeat(begin[number], n) + window] | np.repeat(self.windows.within(ids, statistic[number]), n)
        starts, block_of = np.repeat(runs.start, n)[hit] + window[hit], np.repeat(which, n)[hit]
        for k, (rows, block, _, _) in enumerate(found):
            yield rows, block, starts[block_of == k]

    def last(self, table: pa.Table, answers: pa.Table, finish, schema: pa.Schema) -> pa.Table:
        done = [finish(*x) for x in self.repeated(table, answers)] if table.num_rows else []
        tables = [pa.table([pa.array(d[f.name], f.type) if isinstance(d[f.name], list | np.ndarray) else d[f.name].cast(f.type) for f in schema], schema=schema) for d in done]
        return pa.concat_tables(tables or [schema.empty_table()])


TYPES = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}


def find(windows, documents: DataFrame, finish, schema: str, hot: int = 4096) -> DataFrame:
    """``finish(rows, block, starts)`` gives the columns of ``schema`` for a block of documents and its repeated windows."""
    size = table_bytes(documents) / PART_BYTES
    # Part sizes grow slowly once there are very many, so that rows (parts x buckets) stay few for each name.
    every = Repeats(windows, int(max(48, min(size, size**0.5 * 200))), hot)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(every.parts)).cast("int").alias("part")
    tasks = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), every.parts // 2)
    dealt = small_batches(documents).select(F.col("doc_id").cast("long"), text).select("doc_id", "text", part).repartition(tasks, "part").groupBy("part")
    arrow = pa.schema([(n, TYPES[kind]) for n, kind in map(str.split, schema.split(", "))])
    # Plain functions: Spark counts a method's self among the arguments.
    marked = dealt.applyInArrow(lambda table: every.names(table), ROWS).groupBy("bucket").applyInArrow(lambda table: every.mark(table), ROWS)
    sent = dealt.cogroup(marked.groupBy("part")).applyInArrow(lambda table, answers: every.send(table, answers), ROWS)
    settled = sent.groupBy("bucket").applyInArrow(lambda table: every.settle(table), ROWS)
    return dealt.cogroup(settled.groupBy("part")).applyInArrow(lambda table, answers: every.last(table, answers, finish, arrow), schema)
