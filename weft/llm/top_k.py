"""Exact top-k search by BM25: an inverted index with block maxima, pruned by upper bounds, run per shard and merged.

Queries are texts, taken whole as sets of words; every document is searched.  Statistics are global: the number of
documents, their mean length, and for each word of a query the documents that have it.

A shard is a partition of the scan.  Texts are read once: some thousand documents at a time, in order of language and
length, become an index (their words' hashes, and each document's words and counts), which is written to the shared folder.
Queries are worked off in rounds of at most ``round_terms`` words and ``round_queries`` queries, which bounds what is
broadcast and what a task holds; a round reads the indexes.

A round's queries are put in order of language and length, too, and go through an index in groups.  Documents are cut into
segments, and these into blocks.  Where the maxima that a query's words have in a block add up to less than its k-th score
so far, the query passes the block by, and its postings there are never met.  Where less
than a quarter of a group would pass some blocks by, as where both are of one language, the group meets all of them.  A group's scores are a matrix: words that many of its queries and many documents have are
columns of a product in single precision, raised by more than its rounding can take away; other words' postings are added
in double precision.  What reaches the k-th score so is scored exactly in double precision.

Each shard would find its first k-th scores anew, so a sixteenth of the indexes is searched before the others, which begin
with the k-th scores found there.  A shard's best k are merged with those of the other shards; nothing that could be among
the best is dropped, ties included: score (rounded to six decimals), then doc_id.

Defined results.  A null or empty text matches nothing: as a query it has no row, as a document it is in no result.
Documents with a null doc_id count in the statistics but are neither found nor queries.  Repeated rows are found each
(the k best rows).  An empty table gives an empty table.  Other columns are ignored; ``lang``, where there is one, only
orders documents and queries.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.repeats import groups
from weft.llm.shared import cut, small_batches
from weft.llm.stats import doc_of
from weft.llm.textblock import Block, blocks, give_back

CHUNK = 4096
#: Bytes of text in an index, about, at most (or one longer document).
INDEX_BYTES = 16 << 20
#: Documents of a segment; queries or documents from which on a change of language begins a new group or segment.
SEGMENT, LEAST = 3072, 256
#: Blocks that are met together, and by all of a group where this share of its queries or more would not pass by.
STRETCH, WORTH = 8, 0.75
#: Cells and postings that are met at once.
CELLS = 1 << 16
#: Queries are few in a group of so many times their number.
FEW = 8
#: One index in so many is searched first; partitions whose counts are added up in one task.
FIRST, TOGETHER = 16, 16
#: What products in single precision are raised by: more than 2**-24 for each of ``Search.columns`` (4,096 at most) terms.
RAISED = np.float32(1 + 3e-4)


@dataclass(frozen=True)
class Search:
    k: int = 10
    k1: float = 1.2
    b: float = 0.75
    #: Words of queries in a round, at most (one query more at the end); 8 bytes each are broadcast, and 4 for each distinct.
    round_terms: int = 6_000_000
    #: Queries in a round, at most; of these in a group.
    round_queries: int = 20_000
    group: int = 4096
    #: Documents of an index, and of a block.
    index: int = 4096
    block: int = 64
    #: A word is a column where the share of a group's queries that have it, times that of a segment's documents, is the
    #: square of this or more; the most frequent ones if there are many.
    frequent: float = 0.045
    columns: int = 4096


class Group:
    """Some queries of a round: their distinct words ``terms`` (numbers of the round, ascending), and who has each."""

    def __init__(self, numbers: np.ndarray, starts: np.ndarray):
        self.n = len(starts) - 1
        order = np.argsort(numbers)
        self.of = np.repeat(np.arange(self.n), np.diff(starts))[order].astype(np.int32)
        at = groups(numbers[order])
        self.terms = numbers[order][at]
        self.starts = np.append(at, len(numbers))
        self.size = np.diff(self.starts)
        self.places, self.words = starts, np.empty(len(numbers), dtype=np.int32)
        self.words[order] = np.repeat(np.arange(len(at)), self.size)

    def part(self, some: np.ndarray) -> "Group":
        """A group of these queries; its words are places in this one's ``terms``."""
        words = [self.words[self.places[q] : self.places[q + 1]] for q in some.tolist()]
        return Group(np.concatenate(words), np.append(0, np.cumsum([len(w) for w in words])))

    def queries_of(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The queries that have each of these words, end to end, and how many each word has."""
        size = self.size[term]
        at = np.arange(int(size.sum())) + np.repeat(self.starts[term] - (np.cumsum(size) - size), size)
        return self.of.take(at), size


@dataclass
class Queries:
    """A round's queries: ids, their distinct words as numbers into the sorted ``terms``, and where groups of them end.

    Queries with the same words are one, with one of their ids; ``every`` has all ids, ``one`` the query of each.
    """

    ids: np.ndarray
    terms: np.ndarray
    starts: np.ndarray
    numbers: np.ndarray
    edges: np.ndarray
    every: np.ndarray
    one: np.ndarray
    _groups: list[Group] = field(default_factory=list)

    def groups(self) -> list[Group]:
        """Made once in a worker, which keeps the round's broadcast."""
        if not self._groups:
            edges = self.edges.tolist()
            self._groups = [Group(self.numbers[self.starts[a] : self.starts[z]], self.starts[a : z + 1] - self.starts[a]) for a, z in zip(edges, edges[1:])]
        return self._groups


def pieces(label: np.ndarray, most: int) -> np.ndarray:
    """Edges of pieces of at most ``most`` entries, which end where the label changes, too, but for very small ones."""
    edges = [0]
    for z in [*(np.flatnonzero(label[1:] != label[:-1]) + 1).tolist(), len(label)]:
        if z - edges[-1] >= LEAST or z == len(label):
            edges += np.linspace(edges[-1], z, -(-(z - edges[-1]) // most) + 1).astype(int)[1:].tolist()
    return np.array(edges)


def distinct(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, word, times) of each distinct word of each document, by document."""
    _, _, code, first = block.words
    key = np.sort(doc_of(first) << 32 | block.numbers)
    at = groups(key)
    seen = np.zeros(int(block.numbers.max(initial=-1)) + 1, dtype=np.uint64)
    seen[block.numbers] = code
    return key[at] >> 32, seen[key[at] & 0xFFFFFFFF], np.diff(np.append(at, len(key)))


def query_rounds(queries: DataFrame, how: Search):
    """The queries in rounds of bounded size, streamed to the driver one partition at a time."""

    def of(batches):
        for part, block in blocks(batches):
            doc, word, _ = distinct(block)
            at = np.searchsorted(doc, np.arange(block.n + 1))
            words = pa.array([np.sort(word[a:z]).tobytes() for a, z in zip(at, at[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), words], names=["doc_id", "lang", "words"])

    listed = queries.filter("doc_id is not null and text is not null")
    ids, seen, size = [], {}, 0
    for row in listed.mapInArrow(of, "doc_id long, lang string, words binary").toLocalIterator():
        if row.words:
            one = seen.setdefault(bytes(row.words), (len(seen), row.doc_id, row.lang or ""))
            size += len(row.words) // 8 if one[0] == len(seen) - 1 else 0
            ids.append((row.doc_id, one[0]))
            if size >= how.round_terms or len(ids) >= how.round_queries:
                yield classes_round(ids, seen, how)
                ids, seen, size = [], {}, 0
    if ids:
        yield classes_round(ids, seen, how)


def classes_round(ids: list[tuple[int, int]], seen: dict[bytes, tuple[int, int, str]], how: Search) -> Queries:
    """A round of distinct queries, in order of language and length."""
    langs = np.array([lang for _, _, lang in seen.values()])
    order = np.lexsort(([len(w) for w in seen], langs))
    words, first = [np.frombuffer(w, np.uint64) for w in seen], np.array([i for _, i, _ in seen.values()])
    out = packed_round(first[order], [words[k] for k in order.tolist()], langs[order], how)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    out.every, out.one = np.array([i for i, _ in ids]), place[[k for _, k in ids]]
    return out


def packed_round(ids, words, langs: np.ndarray | None = None, how: Search = Search()) -> Queries:
    number, terms = pd.factorize(np.concatenate(words), sort=True)
    starts = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    edges = pieces(np.zeros(len(ids)) if langs is None else langs, how.group)
    return Queries(np.array(ids), terms, starts, number.astype(np.int32), edges, np.array(ids), np.arange(len(ids)))


INDEX = "turn int, n long, length long, codes binary, counts binary, ids binary, lengths binary, edges binary, starts binary, numbers binary, times binary"


def indexed(batch: pa.RecordBatch, turn: int) -> pa.RecordBatch:
    """An index of these documents (doc_id, text, lang).

    Its words' codes, ascending, and how many documents have each; of the documents with a doc_id ids, lengths in words,
    the edges of segments, and each one's words (numbers into the codes) with how often it has them.
    """
    order = pa.table({"lang": batch.column("lang"), "size": pa.compute.binary_length(batch.column("text")), "k": np.arange(batch.num_rows)})
    order = order.sort_by([("lang", "ascending"), ("size", "descending"), ("k", "ascending")]).column("k")
    batch = batch.take(order.combine_chunks())
    lengths, docs, words, times, at = [], [], [], [], 0
    for _, block in blocks([batch]):
        doc, word, count = distinct(block)
        lengths.append(np.diff(block.words[3]))
        docs.append(doc + at)
        words.append(word)
        times.append(count)
        at += block.n
    lengths, doc, word, times = (np.concatenate(x) for x in (lengths, docs, words, times))
    number, codes = pd.factorize(word, sort=True)
    counts = np.bincount(number, minlength=len(codes))
    known = np.array(batch.column("doc_id").is_valid())
    lang = np.array(batch.column("lang").fill_null(""), dtype=object)[known]
    mine = known[doc]
    starts = np.searchsorted((np.cumsum(known) - 1)[doc[mine]], np.arange(int(known.sum()) + 1))
    times = times[mine].astype(np.uint16) if times.max(initial=0) < 1 << 16 else times[mine]
    parts = [codes, counts.astype(np.int32), np.array(batch.column("doc_id").drop_null()), lengths[known], pieces(lang, SEGMENT), starts, number[mine].astype(np.int32), times]
    return pa.RecordBatch.from_arrays(
        [pa.array([turn], pa.int32()), pa.array([batch.num_rows], pa.int64()), pa.array([int(lengths.sum())], pa.int64()), *(pa.array([p.tobytes()], pa.binary()) for p in parts)],
        names=[c.split()[0] for c in INDEX.split(", ")],
    )


def indexes(documents: DataFrame, how: Search) -> DataFrame:
    """A row for each index of the documents, in the shared folder. ``turn`` is 0 for one in FIRST."""

    def of(batches):
        from pyspark import TaskContext

        turn, waiting, rows, size = TaskContext.get().partitionId() * 7, [], 0, 0
        for batch in batches:
            while batch.num_rows:
                sizes = np.cumsum(np.array(pa.compute.binary_length(batch.column("text")), dtype=np.int64))
                fit = min(how.index - rows, int(np.searchsorted(sizes, INDEX_BYTES - size, side="right")))
                fit = min(batch.num_rows, fit if rows else max(fit, 1))
                if fit:
                    waiting.append(batch.slice(0, fit))
                    rows, size, batch = rows + fit, size + int(sizes[fit - 1]), batch.slice(fit)
                if rows >= how.index or batch.num_rows:
                    yield indexed(pa.Table.from_batches(waiting).combine_chunks().to_batches()[0], turn % FIRST)
                    turn, waiting, rows, size = turn + 1, [], 0, 0
        if rows:
            yield indexed(pa.Table.from_batches(waiting).combine_chunks().to_batches()[0], turn % FIRST)

    return cut(documents.mapInArrow(of, INDEX))


def numbers_in(terms: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the codes are terms, and the numbers of these; both are ascending."""
    at = np.minimum(np.searchsorted(terms, codes), len(terms) - 1)
    mine = terms[at] == codes
    return mine, at[mine]


def document_counts(index: DataFrame, terms) -> tuple[np.ndarray, int, int]:
    """For each term of the round, the documents that have it; the number of documents and of their words."""

    def of(batches):
        known = terms.value
        total, n, length = np.zeros(len(known), dtype=np.int64), 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                n, length = n + row["n"], length + row["length"]
                mine, number = numbers_in(known, np.frombuffer(row["codes"], np.uint64))
                total[number] += np.frombuffer(row["counts"], np.int32)[mine]
        for k in range(0, len(total), CHUNK):
            yield pa.RecordBatch.from_pydict({"chunk": [k], "counts": [total[k : k + CHUNK].astype(np.int32).tobytes()]})
        yield pa.RecordBatch.from_pydict({"chunk": [-1], "counts": [np.array([n, length], dtype=np.int64).tobytes()]})

    def summed(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        every = np.stack([np.frombuffer(x, np.int64 if chunk < 0 else np.int32) for x in table.column("counts").to_pylist()])
        return pa.table({"chunk": [chunk], "counts": pa.array([every.sum(axis=0, dtype=np.int64).tobytes()], pa.binary())})

    schema = "chunk long, counts binary"
    # Each task sends the counts of all terms, so that it adds up those of several partitions.
    parts = max(-(-index.rdd.getNumPartitions() // TOGETHER), index.sparkSession.sparkContext.defaultParallelism)
    listed = index.select("n", "length", "codes", "counts").coalesce(parts)
    rows = listed.mapInArrow(of, schema).groupBy("chunk").applyInArrow(summed, schema).collect()  # as many as the round's terms
    by = {r.chunk: np.frombuffer(r.counts, np.int64) for r in rows}
    n, length = by.pop(-1) if -1 in by else (0, 0)
    return np.concatenate([by[k] for k in sorted(by)] or [np.zeros(0, np.int64)]), int(n), int(length)


class Best:
    """The best k rows of each query so far, ties at the end included only as far as k goes."""

    def __init__(self, least: np.ndarray, k: int):
        self.k = k
        self.query, self.score, self.doc = (np.zeros(0, t) for t in (np.int64, float, np.int64))
        self.least = least.copy()  # a row with less is not among the best; 0 until there are k

    def add(self, query: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        """Only the rows of queries that get any are put in order again."""
        if not len(query):
            return
        touched = np.zeros(len(self.least), dtype=bool)
        touched[query] = True
        rest = ~touched[self.query]
        query, score, doc = (np.concatenate([old[~rest], new]) for old, new in ((self.query, query), (self.score, score), (self.doc, doc)))
        order = np.lexsort((doc, -score, query))
        query, score, doc = query[order], score[order], doc[order]
        at = groups(query)
        rank = np.arange(len(query)) - np.repeat(at, np.diff(np.append(at, len(query))))
        keep = rank < self.k
        last = rank == self.k - 1
        self.least[query[last]] = np.maximum(self.least[query[last]], score[last])
        self.query, self.score, self.doc = (np.concatenate([old[rest], new[keep]]) for old, new in ((self.query, query), (self.score, score), (self.doc, doc)))


class Scorer:
    """A round's queries against one index after the other; ``least`` are k-th scores that are known before."""

    def __init__(self, queries: Queries, counts: np.ndarray, n: int, length: int, how: Search, least: np.ndarray | None = None):
        self.how, self.queries, self.groups = how, queries, queries.groups()
        self.idf = np.log1p((n - counts + 0.5) / (counts + 0.5))
        self.mean = length / max(n, 1)
        least = np.zeros(len(queries.ids)) if least is None else least
        self.bests = [Best(least[a : a + g.n], how.k) for a, g in zip(queries.edges, self.groups)]
        #: Pairs of a query and a block; those whose postings were read; those that were scored.
        self.pairs = self.asked = self.scored = 0

    @property
    def best(self) -> Best:
        """Of all groups."""
        out = Best(np.concatenate([b.least for b in self.bests]), self.how.k)
        out.query = np.concatenate([b.query + a for a, b in zip(self.queries.edges, self.bests)])
        out.score, out.doc = (np.concatenate([getattr(b, x) for b in self.bests]) for x in ("score", "doc"))
        return out

    def index(self, ids: np.ndarray, lengths: np.ndarray, doc: np.ndarray, number: np.ndarray, times: np.ndarray, edges: np.ndarray | None = None) -> None:
        """Search these documents: their ids and lengths, in block order, and, by document, their words that are terms of the
        round. ``edges`` are those of segments."""
        how, n = self.how, len(ids)
        impact = self.idf[number] * times * (how.k1 + 1) / (times + how.k1 * (1 - how.b + how.b * lengths[doc] / self.mean))
        edges = (pieces(np.zeros(n), SEGMENT) if edges is None else edges).tolist()
        place = np.full(len(self.queries.terms), -1, dtype=np.int32)
        for group, best in zip(self.groups, self.bests):
            place[group.terms] = np.arange(len(group.terms))
            term = place[number]
            place[group.terms] = -1
            at = np.flatnonzero(term >= 0)
            mine, term, size = doc[at], term[at], impact[at]
            cuts = np.searchsorted(mine, edges).tolist()
            for a, z, lo, hi in zip(edges, edges[1:], cuts, cuts[1:]):
                self._segment(group, best, ids[a:z], mine[lo:hi] - a, term[lo:hi], size[lo:hi])

    def _segment(self, group: Group, best: Best, ids: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray) -> None:
        how, n = self.how, len(ids)
        blocks = -(-n // how.block)
        self.pairs += blocks * group.n
        if not len(doc):
            return
        share = np.bincount(term, minlength=len(group.terms)).astype(float) * group.size
        often = np.flatnonzero(share >= max(how.frequent**2 * n * group.n, 1))
        often = often[np.argsort(-share[often], kind="stable")[: how.columns]]
        column = np.full(len(group.terms), -1, dtype=np.int32)
        column[often] = np.arange(len(often))
        weight = np.zeros((group.n, len(often)), dtype=np.float32)  # which columns a query has
        query, size = group.queries_of(often)
        weight[query, np.repeat(np.arange(len(often)), size)] = 1
        cell = column[term]
        heavy = cell >= 0
        matrix = np.zeros((n, len(often)))
        matrix[doc[heavy], cell[heavy]] = impact[heavy]
        raised = matrix.astype(np.float32) * RAISED
        doc, term, impact = doc[~heavy], term[~heavy], impact[~heavy]
        edges = np.append(np.arange(0, n, how.block), n)
        cuts = np.searchsorted(doc, edges)

        def reached(a: int, z: int) -> np.ndarray | None:
            """Which queries can reach their k-th score in each block from a to z by their words' maxima; None: most of them."""
            least = np.maximum(best.least - 1e-5, 1e-9)
            most = np.maximum.reduceat(raised[edges[a] : edges[z]], edges[a:z] - edges[a], axis=0)
            if (most[:1] @ weight.T >= least).mean() >= WORTH:  # the first block shows it by the columns alone
                return None
            bound = most @ weight.T
            lo, hi = cuts[a], cuts[z]
            key = term[lo:hi].astype(np.int64) * (z - a) + doc[lo:hi] // how.block - a
            order = np.argsort(key)
            at = groups(key[order])
            if len(at):
                query, size = group.queries_of(key[order][at] // (z - a))
                cell = np.repeat(key[order][at] % (z - a) * group.n, size) + query
                bound = bound + np.bincount(cell, weights=np.repeat(np.maximum.reduceat(impact[lo:hi][order], at), size), minlength=bound.size).reshape(bound.shape)
            met = bound >= least
            return met if met.mean() < WORTH else None

        def score_block(j: int, some: np.ndarray | None, lists: Group, postings: tuple, product: np.ndarray) -> None:
            """Add what reaches the k-th scores of ``some`` queries (None: all) in a block: those of ``lists``, which these
            postings are for, or some of them. ``product`` is that of the columns."""
            begin, end, width = int(edges[j]), int(edges[j + 1]), product.shape[1]
            self.asked, self.scored = self.asked + width, self.scored + width
            known = best.least if some is None else best.least[some]
            new = np.flatnonzero(known == 0)
            least, found = np.maximum(known - 1e-5, 1e-9), []
            if lists.n > width:
                where = np.full(lists.n, -1)
                where[some] = np.arange(width)
            docs, terms, impacts = postings
            # Some documents at a time, so that what is made of their postings stays in the processor's cache.
            rows = np.searchsorted(docs, np.arange(begin, end + 1))
            sizes = np.append(0, np.cumsum(lists.size[terms[rows[0] : rows[-1]]]))[rows - rows[0]]
            step, a = max(CELLS // width, how.k + 1 if len(new) else 1), begin
            while a < end:
                z = min(end, a + step, max(begin + int(np.searchsorted(sizes, sizes[a - begin] + CELLS, side="right")) - 1, a + (how.k + 1 if len(new) else 1)))
                mine = slice(rows[a - begin], rows[z - begin])
                cell, size = lists.queries_of(terms[mine])
                row, value = np.repeat((docs[mine] - a) * width, size), np.repeat(impacts[mine], size)
                if lists.n > width:
                    cell = where[cell]
                    row, value, cell = (x[cell >= 0] for x in (row, value, cell))
                row += cell
                rare = np.zeros((z - a) * width)
                np.add.at(rare, row, value)
                upper = rare.reshape(z - a, width) + product[a - begin : z - begin]
                if z - a > how.k and len(new):  # queries that have no k rows yet: the best k of these, as far as upper bounds tell
                    bound = np.partition(upper[:, new], z - a - how.k, axis=0)[z - a - how.k] / float(RAISED) ** 2
                    least[new] = np.maximum(least[new], bound - 1e-5)
                hit = np.flatnonzero(upper >= least)
                for c in range(0, len(hit), 4096):
                    i, k = np.divmod(hit[c : c + 4096], width)
                    query = k if some is None else some[k]
                    score = np.round(np.einsum("ij,ij->i", matrix[a + i], weight[query]) + rare[hit[c : c + 4096]], 6)
                    good = np.flatnonzero((score >= known[k]) & (score > 0))
                    found.append((query[good], score[good], ids[a + i[good]]))
                a = z
            if found:
                best.add(*(np.concatenate(x) for x in zip(*found, strict=True)))

        for first in range(0, blocks, STRETCH):
            last = min(first + STRETCH, blocks)
            met, whole = reached(first, last), raised[edges[first] : edges[last]]
            lo, hi, begin = cuts[first], cuts[last], edges[first]
            postings = doc[lo:hi], term[lo:hi], impact[lo:hi]
            asked = np.arange(group.n) if met is None else np.flatnonzero(met.any(axis=0))
            if not len(asked):
                continue
            lists, few = group, FEW * len(asked) < group.n
            if few:  # the words of these queries only
                lists = group.part(asked)
                place = np.full(len(group.terms), -1, dtype=np.int32)
                place[lists.terms] = np.arange(len(lists.terms))
                own = place[postings[1]]
                at = np.flatnonzero(own >= 0)
                postings = postings[0][at], own[at], postings[2][at]
            product = whole @ weight[asked].T if few else whole @ weight.T if met is None else None
            for j in range(first, last):
                rows = slice(edges[j] - begin, edges[j + 1] - begin)
                some = asked if few else None if met is None else np.flatnonzero(met[j - first])
                if met is None or met[j - first].any():
                    score_block(j, some, lists, postings, whole[rows] @ weight[some].T if product is None else product[rows])


RESULT = "query_id long, found array<struct<score:double,doc_id:long>>"


def merged(found: DataFrame, k: int) -> DataFrame:
    """The best k of each query's rows. A shard gives k at most, so that a query's rows are bounded by the number of shards."""
    every = found.groupBy("query_id").agg(F.flatten(F.collect_list("found")).alias("found"))
    ordered = F.array_sort(F.transform("found", lambda x: F.struct((-x["score"]).alias("minus"), x["doc_id"].alias("doc_id"))))
    return every.select("query_id", F.transform(F.slice(ordered, 1, k), lambda x: F.struct((-x["minus"]).alias("score"), x["doc_id"].alias("doc_id"))).alias("found"))


def search_round(index: DataFrame, queries: Queries, how: Search) -> DataFrame:
    """(query_id, found): the best of each shard for each query of the round."""
    context = index.sparkSession.sparkContext
    terms = context.broadcast(queries.terms)
    counts, n, length = document_counts(index, terms)
    terms.destroy()
    given = context.broadcast((queries, counts, n, length))

    def run(some: DataFrame, least) -> DataFrame:
        def of(batches):
            queries, counts, n, length = given.value
            scorer = Scorer(queries, counts, n, length, how, least.value if least else None)
            for batch in batches:
                for row in batch.to_pylist():
                    codes, ids, lengths, edges, starts, numbers = (np.frombuffer(row[c], t) for c, t in (("codes", np.uint64), ("ids", np.int64), ("lengths", np.int64), ("edges", np.int64), ("starts", np.int64), ("numbers", np.int32)))
                    if not len(numbers):
                        continue
                    times = np.frombuffer(row["times"], np.uint16 if len(row["times"]) == 2 * len(numbers) else np.int64)
                    known, number = numbers_in(queries.terms, codes)
                    to = np.full(len(codes), -1, dtype=np.int32)
                    to[known] = number
                    number = to[numbers]
                    at = np.flatnonzero(number >= 0)
                    scorer.index(ids, lengths, doc_of(starts)[at], number[at], times[at].astype(np.int64), edges)
            best = scorer.best
            order = np.argsort(best.query, kind="stable")
            best.query, best.score, best.doc = best.query[order], best.score[order], best.doc[order]
            edge = groups(best.query)
            found = pa.ListArray.from_arrays(pa.array(np.append(edge, len(best.query)), pa.int32()), pa.StructArray.from_arrays([pa.array(best.score), pa.array(best.doc)], names=["score", "doc_id"]))
            place = np.full(len(queries.ids), -1)
            place[best.query[edge]] = np.arange(len(edge))
            place = place[queries.one]
            mine = np.flatnonzero(place >= 0)
            for k in range(0, len(mine), 10_000):
                some = mine[k : k + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(queries.every[some]), found.take(pa.array(place[some]))], names=["query_id", "found"])
            give_back()

        return some.mapInArrow(of, RESULT)

    # What was found is written before the next round, so that one round's broadcasts are held at a time, and a lost executor
    # costs its shards of one round.
    if n <= FIRST * how.index:
        found = cut(run(index, None))
    else:
        first = cut(merged(run(index.filter("turn = 0"), None), how.k))
        last = first.filter(F.size("found") == how.k).select("query_id", F.element_at("found", -1)["score"].alias("least"))
        known = {r.query_id: r.least for r in last.collect()}  # as many as the round's queries
        each = np.full(len(queries.ids), np.inf)
        np.minimum.at(each, queries.one, [known.get(i, 0.0) for i in queries.every.tolist()])
        least = context.broadcast(each)
        found = first.unionByName(cut(run(index.filter("turn > 0"), least)))
        least.destroy()
    given.destroy()
    return found


def search(documents: DataFrame, queries: DataFrame, how: Search = Search()) -> DataFrame:
    """query_id, rank, doc_id, score: the best k documents for every query (a row with doc_id and text)."""
    spark = documents.sparkSession

    def given(df: DataFrame) -> DataFrame:
        lang = F.col("lang").cast("string") if "lang" in df.columns else F.lit(None).cast("string")
        return df.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), lang.alias("lang"))

    index = indexes(given(small_batches(documents)).withColumn("text", F.coalesce("text", F.lit(""))), how)
    parts = [search_round(index, q, how) for q in query_rounds(given(queries), how)]
    found = parts[0] if parts else spark.createDataFrame([], RESULT)
    for more in parts[1:]:
        found = found.unionByName(more)
    best = merged(found, how.k).select("query_id", F.posexplode("found").alias("rank", "hit"))
    return best.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "hit.doc_id", "hit.score")
