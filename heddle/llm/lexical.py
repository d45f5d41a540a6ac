"""Ranked lexical search: posting lists cut into blocks of similar documents, with exact bounds that let blocks be skipped.

Documents become rows of impacts (weight of a term times its saturated frequency, whole numbers) over the terms that items ask for. Each
task reads its documents in segments. In a segment, a term's posting list is cut into blocks of similar documents, and a block keeps
the coordinatewise maximum of their rows: its product with an item is at least every score in the block. A block is scored only if that
bound reaches the item's tenth best score so far, so results are exact.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import chunks, give_back
from .common import hashed_sample, written

#: Terms of the items that are searched in one pass over the documents; more items take more passes.
MOST_TERMS = 200_000
#: Bytes of a segment's impacts in a task.
SEGMENT_BYTES = 48 << 20
#: Documents in a block, about.
BLOCK = 16
#: Documents whose scores give each item its first bound.
SAMPLED = 10_000
NO_ID = (1 << 63) - 1

_SIGNS = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _SIGNS else 0x20 for b in range(256))


def terms(text: str) -> list[bytes]:
    """Runs of ASCII letters, digits and signs beyond ASCII, A-Z in lower case, in UTF-8."""
    return text.encode("utf-8", "replace").translate(TABLE).split()


def forward(docs: DataFrame, vocabulary: list[bytes], text: str, doc_id: str) -> DataFrame:
    """doc, n (terms with repeats), ids and tfs (packed 32-bit) of the vocabulary's terms in each text; texts without a term have n = 0."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: i for i, t in enumerate(sent.value)}
        for batch in batches:
            done = 0
            for part in chunks([x or "" for x in batch.column(1).to_pylist()]):
                n, ids, tfs = [], [], []
                for value in part:
                    found = terms(value)
                    counted = Counter(map(place.get, found))
                    counted.pop(None, None)
                    at = sorted(counted)
                    n.append(len(found))
                    ids.append(np.array(at, "<i4").tobytes())
                    tfs.append(np.array([counted[i] for i in at], "<i4").tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(part)), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(tfs, pa.binary())], names=["doc", "n", "ids", "tfs"])
                done += len(part)
        give_back()

    rows = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NO_ID)).alias("doc"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, "doc long, n long, ids binary, tfs binary")


def frequencies(rows: DataFrame, size: int) -> np.ndarray:
    """In how many documents each of the ``size`` terms occurs. Tasks add up first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4"), minlength=size)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["id", "df"])

    df = np.zeros(size, np.int64)
    table = rows.select("ids").mapInArrow(run, "id int, df long").groupBy("id").agg(F.sum("df").alias("df")).toArrow()
    df[table.column("id").to_numpy()] = table.column("df").to_numpy()
    return df


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


@dataclass(frozen=True)
class Asked:
    """Items over the vocabulary: term ids and how often the item has each, the weights, and what lengths are measured by."""

    items: list[tuple[np.ndarray, np.ndarray]]
    weight: np.ndarray
    n_docs: int
    n_terms: int
    k: int
    first: np.ndarray  # a score that each item's k-th best reaches


@dataclass
class Blocks:
    """A term's posting list in blocks: documents in order, where blocks begin, and each block's largest impacts over ``columns``."""

    docs: np.ndarray
    starts: np.ndarray
    columns: np.ndarray
    summary: np.ndarray


@dataclass
class Segment:
    """Documents of a task that are searched together."""

    asked: Asked
    columns: dict[int, np.ndarray]  # of each term, the terms of all items that have it
    doc: np.ndarray
    impact: np.ndarray  # a row a document, a column a term
    sketch: np.ndarray
    blocks: dict[int, Blocks] = field(default_factory=dict)

    def block(self, term: int) -> Blocks:
        """The term's posting list, clustered: every few documents one is a pivot, and each document goes to the most similar pivot."""
        if term not in self.blocks:
            docs = np.flatnonzero(self.impact[:, term])
            pivots = docs[::BLOCK]
            home = (self.sketch[docs] @ self.sketch[pivots].T).argmax(1)
            docs = docs[np.argsort(home, kind="stable")]
            starts = np.flatnonzero(np.diff(np.sort(home), prepend=-1))
            columns = self.columns[term]
            self.blocks[term] = Blocks(docs, starts, columns, np.maximum.reduceat(self.impact[np.ix_(docs, columns)], starts, axis=0))
        return self.blocks[term]

    def candidates(self, ids: np.ndarray, times: np.ndarray, bound: int, most: np.ndarray) -> np.ndarray:
        """Documents that can reach ``bound``, among those of the lists that such a document must be in one of.

        ``most`` is each term's largest impact here, times the item's repeats. Lists that even together can't reach the bound are left out.
        """
        order = np.argsort(most, kind="stable")
        needed = order[np.cumsum(most[order]) >= max(bound, 1)]
        found = []
        for i in needed[::-1]:
            if not most[i]:
                continue
            b = self.block(int(ids[i]))
            reach = b.summary[:, np.searchsorted(b.columns, ids)] @ times
            for j in np.flatnonzero(reach >= bound).tolist():
                found.append(b.docs[b.starts[j] : b.starts[j + 1] if j + 1 < len(b.starts) else None])
        return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


class Search:
    """Searches segments one after the other; the best of each item are kept, and bound what later segments need to score."""

    def __init__(self, asked: Asked):
        self.asked = asked
        size = len(asked.weight)
        with_term: dict[int, list[np.ndarray]] = {}
        for ids, _ in asked.items:
            for t in ids.tolist():
                with_term.setdefault(t, []).append(ids)
        self.columns = {t: np.unique(np.concatenate(lists)) for t, lists in with_term.items()}
        self.rows = max(64, min(4096, SEGMENT_BYTES // (8 * size)))
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in asked.items]  # score, doc
        self.bound = asked.first.copy()
        rng = np.random.default_rng(7)  # fixed: it only shapes blocks, results are exact with any
        self.signs = rng.choice(np.array([-1.0, 1.0], np.float32), (size, 48))
        self.scored = self.seen = 0

    def segment(self, doc: np.ndarray, n: np.ndarray, ids: list[bytes], tfs: list[bytes]) -> None:
        """Searches documents of one segment for all items."""
        a = self.asked
        size = [len(x) // 4 for x in ids]
        row, term = np.repeat(np.arange(len(doc)), size), np.frombuffer(b"".join(ids), "<i4").astype(np.int64)
        tf = np.frombuffer(b"".join(tfs), "<i4").astype(np.int64)
        m = 25 + (75 * n * a.n_docs) // max(a.n_terms, 1)
        impact = np.zeros((len(doc), len(a.weight)), np.int64)
        impact[row, term] = a.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
        shape = impact.astype(np.float32)
        shape /= np.maximum(np.sqrt((shape * shape).sum(1, keepdims=True)), 1)
        here = Segment(a, self.columns, doc, impact, shape @ self.signs)
        largest = impact.max(0)
        for k, (ids_, times) in enumerate(a.items):
            most = largest[ids_] * times
            if int(most.sum()) < max(self.bound[k], 1):
                continue
            found = here.candidates(ids_, times, int(self.bound[k]), most)
            self.scored += len(found)
            if len(found):
                self.keep(k, impact[np.ix_(found, ids_)] @ times, doc[found])
        self.seen += len(doc)

    def keep(self, k: int, score: np.ndarray, doc: np.ndarray) -> None:
        good = (score > 0) & (score >= self.bound[k])
        score, doc = (np.concatenate(x) for x in zip(self.best[k], (score[good], doc[good]), strict=True))
        order = np.lexsort((doc, -score))[: self.asked.k]
        self.best[k] = score[order], doc[order]
        if len(order) == self.asked.k:
            self.bound[k] = max(self.bound[k], int(score[order[-1]]))


def searched(rows: DataFrame, asked: Asked) -> DataFrame:
    """item (place in ``asked``), score, doc: the best of each task's documents. Documents without a term of the items have no score."""
    sent = rows.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(sent.value)
        held: list[list] = [[], [], [], []]

        def flush() -> None:
            search.segment(np.array(held[0], np.int64), np.array(held[1], np.int64), held[2], held[3])
            for part in held:
                part.clear()

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for at in range(0, batch.num_rows, search.rows):
                for part, column in zip(held, columns, strict=True):
                    part.extend(column[at : at + search.rows])
                if len(held[0]) >= search.rows:
                    flush()
        if held[0]:
            flush()
        size = [len(s) for s, _ in search.best]
        out = [np.repeat(np.arange(len(size)), size), *(np.concatenate([b[i] for b in search.best] or [np.empty(0, np.int64)]) for i in (0, 1))]
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in out], names=["item", "score", "doc"])
        give_back()

    return rows.where("length(ids) > 0").mapInArrow(run, "item long, score long, doc long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(docs: DataFrame, items: DataFrame, k: int = 10, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", most_terms: int = MOST_TERMS, sampled: int = SAMPLED) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of each item's ``k`` best documents of a score above 0, ties to the smaller doc_id.

    Scores are those of BM25 in whole numbers: weights floor(1000 ln((2N + 2) / (2 df + 1))), lengths against the mean, repeats of a term in
    the item counted. Items are taken in groups of about ``most_terms`` terms, and each group is one pass over all documents. A sample of
    about ``sampled`` documents gives each item a first bound, which its k-th best in all documents reaches too, so nothing is lost by it.

    Null and wordless texts and items have no terms. Every row of ``docs`` and ``items`` counts, repeats too; rows without doc_id come after
    others of their score; equal rows take adjacent ranks. An empty table gives no rows. Other columns play no part.
    """
    session = docs.sparkSession
    wanted = items.select(F.col(f"`{item_id}`").alias("item_id"), F.coalesce(F.col(f"`{item_text}`"), F.lit("")).alias("text"))
    size = int(wanted.agg(F.sum(F.length("text"))).first()[0] or 0)
    groups = max(1, math.ceil(size / (5 * most_terms)))  # a term has some five letters
    if groups > 1:
        wanted = written(wanted.withColumn("_group", F.pmod(F.xxhash64("item_id", "text"), F.lit(groups))))
    kind = wanted.schema["item_id"].dataType.simpleString()
    out = None
    for g in range(groups):
        part = (wanted.where(F.col("_group") == g) if groups > 1 else wanted).select("item_id", "text").toArrow().to_pylist()
        held = [(row["item_id"], Counter(terms(row["text"]))) for row in part]
        held = [(i, c) for i, c in held if c]
        vocabulary = sorted(set().union(*(c for _, c in held)))
        if not vocabulary:
            continue
        place = {t: i for i, t in enumerate(vocabulary)}
        rows = written(forward(docs, vocabulary, text, doc_id))
        stats = rows.where("n > 0").agg(F.count("*"), F.sum("n")).first()
        n_docs, n_terms = stats[0], stats[1] or 0
        asked_items = []
        for _, counted in held:
            ids = np.array(sorted(place[t] for t in counted), np.int64)
            asked_items.append((ids, np.array([counted[vocabulary[i]] for i in ids.tolist()], np.int64)))
        weight = weights(frequencies(rows, len(vocabulary)), n_docs)
        asked = Asked(asked_items, weight, n_docs, n_terms, k, np.zeros(len(held), np.int64))
        sample = hashed_sample(rows.where("length(ids) > 0"), F.xxhash64("doc", "n", "ids"), sampled)
        for row in ranked(searched(sample, asked), k).where(F.col("rank") == k).select("item", "score").toLocalIterator():
            asked.first[row["item"]] = row["score"]
        best = ranked(searched(rows, asked), k)
        names = session.createDataFrame([(i, name) for i, (name, _) in enumerate(held)], f"item long, item_id {kind}")
        found = best.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "score")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else session.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
