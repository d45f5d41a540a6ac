"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes of a text.

A text's tokens and bytes are an incidence matrix (a row a token, a column a byte) in CSR, built by hand; products of such matrices by rows
give the links. Links are then counted by id pair over all texts, and each text reads the counts of its own pairs.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokenizer_files as files
from .arrow import give_back, numbered, with_columns
from .bpe import Encoder, Merges
from .common import fresh, spread_join, written

SPACE = "▁"
#: Bytes of text whose matrices are held at a time; slices end where tokens of both sides do.
SLICE = 1 << 20
#: Id pairs whose counts a task may hold (16 bytes each); with more of them, the counts are joined by a shuffle instead.
MOST_PAIRS = 2_000_000
#: Pairs that a task gathers before it adds up equal ones.
GATHERED = 2_000_000
#: Encoded words in a generation of a task's memory.
REMEMBERED = 120_000


@dataclass(frozen=True)
class Csr:
    """A sparse 0/1 matrix by rows: row i holds the columns ``columns[ends[i] : ends[i + 1]]``."""

    ends: np.ndarray
    columns: np.ndarray
    width: int

    @classmethod
    def tiles(cls, size: np.ndarray) -> Csr:
        """Rows that cover ``size`` columns each, one after the other: tokens over bytes."""
        ends = np.concatenate(([0], np.cumsum(size)))
        return cls(ends, np.arange(ends[-1]), int(ends[-1]))

    @classmethod
    def of(cls, columns: np.ndarray, width: int) -> Csr:
        """One column a row: tokens over groups."""
        return cls(np.arange(len(columns) + 1), columns, width)

    def transposed(self) -> Csr:
        rows = np.repeat(np.arange(len(self.ends) - 1), np.diff(self.ends))
        order = np.argsort(self.columns, kind="stable")
        return Csr(np.concatenate(([0], np.cumsum(np.bincount(self.columns, minlength=self.width)))), rows[order], len(self.ends) - 1)

    def counts_with(self, other: Csr) -> int:
        """How many terms the product with ``other`` adds up, without making them."""
        return int(np.diff(other.ends)[self.columns].sum())


def product(a: Csr, b: Csr) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and values of ``a`` times ``b``, row by row: each entry of a row calls up a row of ``b``, and equal columns add up."""
    size = np.diff(b.ends)[a.columns]
    rows = np.repeat(np.repeat(np.arange(len(a.ends) - 1), np.diff(a.ends)), size)
    total = np.cumsum(size)
    places = np.arange(int(total[-1]) if len(total) else 0) + np.repeat(b.ends[a.columns] - total + size, size)
    keys = rows * max(b.width, 1) + b.columns[places]
    if (keys[1:] < keys[:-1]).any():
        keys.sort()
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    keys = keys[at]
    return keys // max(b.width, 1), keys % max(b.width, 1), np.diff(np.append(at, len(new)))


class Words(Encoder):
    """The byte-level encoder with exact merges for every new word: where words aren't decoded again, that costs less than to propose and test."""

    def learn(self, words: list[str], plain: bool) -> None:
        known, tokenize = self.young[plain], self.model.tokenize
        for word in words:
            known[word] = array("I", [t.id for t in tokenize(files.signs(word) if plain else word)]).tobytes()


class Pieces:
    """Encodes texts as a sentencepiece model does, word by word with a memory.

    A text is cut before each run of spaces, if the vocabulary proves that no piece goes on over such a place (none holds a space behind
    another sign): merges then never cross it, and words encode alike alone. Else whole texts are encoded.
    """

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.cuts = not any(SPACE in name.lstrip(SPACE) for name in names)
        self.bytes = [bytes([int(name[3:5], 16)]) if self.library.is_byte(i) else name.replace(SPACE, " ").encode() for i, name in enumerate(names)]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.blank = array("I", [self.library.piece_to_id(SPACE)]).tobytes()

    def packed(self, words: list[str]) -> list[bytes]:
        """Ids of each word, which begins with one space at least, as little-endian unsigned 32-bit integers."""
        return [array("I", ids).tobytes() if ids else self.blank for ids in self.library.encode([w[1:] for w in words], num_threads=1)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text that begins with one space more than the text itself; the model adds that space."""
        if not self.cuts:
            return self.packed(texts)
        cut = [re.findall(" +[^ ]*", t) for t in texts]
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        seen = set().union(*cut).difference(self.young)
        again = seen.intersection(self.old)
        self.young.update(zip(again, map(self.old.__getitem__, again), strict=True))
        new = list(seen.difference(again))
        self.young.update(zip(new, self.packed(new), strict=True))
        return [b"".join(map(self.young.__getitem__, words)) for words in cut]


class Bytes:
    """The bytes of each id, to be laid out for many ids at once."""

    def __init__(self, strings: list[bytes]):
        self.flat = np.frombuffer(b"".join(strings), np.uint8)
        self.size = np.array([len(s) for s in strings], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def laid(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.start[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


class Aligner:
    """Aligns texts in the tokens of a byte-level file (A) and of a sentencepiece model (B)."""

    def __init__(self, file: str, merges: Merges, model: bytes):
        self.a, self.b = Words(file, merges), Pieces(model)
        self.a.cutter.special = None  # special strings inside a text are plain text
        known = files.parsed(file)["model"]["vocab"] | self.a.cutter.special_ids
        strings = {i: bytes(files.TO_BYTES.get(c, 0) for c in s) for s, i in known.items()}
        self.bytes_a = Bytes([strings.get(i, b"") for i in range(max(strings) + 1)])
        self.bytes_b = Bytes(self.b.bytes)
        comma = lambda n, end: [f"{i}{end}" for i in range(n)]
        n_a, n_b = len(self.bytes_a.size), len(self.bytes_b.size)
        self.spelled = comma(n_a, ",") + comma(n_a, "|") + comma(n_b, ",") + comma(n_b, ";")
        self.offset = np.array([0, n_a, 2 * n_a, 2 * n_a + n_b])

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids in A and B of each text; none where it is empty or where the bytes of either side aren't those of the text."""
        full = [" " + t for t in texts]
        out = []
        for text, a, b in zip(full, self.a.encode(full), self.b.encode(full), strict=True):
            a, b = np.frombuffer(a, "<u4").astype(np.int64), np.frombuffer(b, "<u4").astype(np.int64)
            raw = text.encode("utf-8", "replace")
            same = len(raw) > 1 and self.bytes_a.size[a].sum() == self.bytes_b.size[b].sum() == len(raw)
            if same and self.bytes_a.laid(a).tobytes() == raw and self.bytes_b.laid(b).tobytes() == raw:
                out.append((a, b))
            else:
                out.append((a[:0], b[:0]))
        return out

    def slices(self, size_a: np.ndarray, size_b: np.ndarray) -> Iterator[tuple[slice, slice]]:
        """Tokens of A and B whose bytes are about ``SLICE`` long and begin and end at one place on both sides."""
        ends_a, ends_b = np.cumsum(size_a), np.cumsum(size_b)
        shared = ends_a[np.isin(ends_a, ends_b, assume_unique=True)]
        i = j = at = 0
        while i < len(ends_a):
            cut = shared[min(np.searchsorted(shared, at + SLICE), len(shared) - 1)]
            i2, j2 = np.searchsorted(ends_a, cut) + 1, np.searchsorted(ends_b, cut) + 1
            yield slice(i, i2), slice(j, j2)
            i, j, at = i2, j2, cut

    def links(self, a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
        """Of the tokens of one or many texts, which begin and end together: overlap links (``row``, ``column``, ``shared`` bytes), which of
        them end ``together``, and the group of each token (``group_a``, ``group_b``)."""
        size_a, size_b = self.bytes_a.size[a], self.bytes_b.size[b]
        row, column, shared = product(Csr.tiles(size_a), Csr.tiles(size_b).transposed())
        ends_a, ends_b = np.cumsum(size_a), np.cumsum(size_b)
        together = ends_a[row] == ends_b[column]
        cuts = ends_a[row[together]]  # a group ends where tokens of both sides end
        return {"row": row, "column": column, "shared": shared, "together": together, "group_a": np.searchsorted(cuts, ends_a), "group_b": np.searchsorted(cuts, ends_b)}

    def grouped(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> bytes:
        """``a1,a2|b1;a3|b2,b3``: the ids of each group."""
        if not len(a):
            return b""
        kind_a = (np.append(group_a[1:], -1) != group_a).astype(np.int64)
        kind_b = 2 + (np.append(group_b[1:], -1) != group_b).astype(np.int64)
        codes = np.concatenate((self.offset[kind_a] + a, self.offset[kind_b] + b))
        order = np.argsort(np.concatenate((2 * group_a, 2 * group_b + 1)), kind="stable")
        return "".join(map(self.spelled.__getitem__, codes[order].tolist()))[:-1].encode()

    def align(self, texts: list[str]) -> list[list]:
        """One list a column: n_a, n_b, n_groups, n_links, n_shared, groups_sha256, and the text's link pairs (a * 2**32 + b) with their counts."""
        both = self.tokens(texts)
        a, b = (np.concatenate([x[k] for x in both] or [np.empty(0, np.int64)]) for k in (0, 1))
        n_a, n_b = (np.array([len(x[k]) for x in both], np.int64) for k in (0, 1))
        parts, groups = [], 0
        for s, t in self.slices(self.bytes_a.size[a], self.bytes_b.size[b]):
            found = self.links(a[s], b[t])
            hit = found["together"]
            parts.append((s.start + found["row"][hit], t.start + found["column"][hit], found["group_a"] + groups, found["group_b"] + groups))
            groups += int(hit.sum())
        empty = [np.empty(0, np.int64)]
        row, column, group_a, group_b = (np.concatenate([p[k] for p in parts] or empty) for k in range(4))
        stop_a, stop_b = np.cumsum(n_a), np.cumsum(n_b)
        doc = np.searchsorted(stop_a, row, side="right")
        n_links = np.bincount(doc, minlength=len(texts))
        out: list[list] = [n_a.tolist(), n_b.tolist(), [], n_links.tolist(), [], [], [], []]
        stop = np.cumsum(n_links)
        for k in range(len(texts)):
            sa, sb = slice(stop_a[k] - n_a[k], stop_a[k]), slice(stop_b[k] - n_b[k], stop_b[k])
            ga, gb = group_a[sa], group_b[sb]
            base = ga[0] if len(ga) else 0
            count = int(ga[-1] - base + 1) if len(ga) else 0
            out[2].append(count)
            out[4].append(Csr.of(ga - base, count).counts_with(Csr.of(gb - base, count).transposed()) if count else 0)
            out[5].append(hashlib.sha256(self.grouped(a[sa], b[sb], ga, gb)).hexdigest() if count else "")
            held = slice(stop[k] - n_links[k], stop[k])
            pairs, times = np.unique((a[row[held]] << 32) | b[column[held]], return_counts=True)
            out[6].append(pairs.astype("<i8").tobytes())
            out[7].append(times.astype("<u4").tobytes())
        return out


def aligned(docs: DataFrame, byte_path: str, piece_path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with n_a, n_b, n_groups, n_links, n_shared (pairs of tokens in one group), groups_sha256, pairs, times.

    ``pairs`` (a * 2**32 + b, signed 64-bit, sorted) are the distinct id pairs of tokens that end together, ``times`` (unsigned 32-bit) how
    often the text has each. Null and empty texts, and those whose bytes a side doesn't give back, have no tokens, zeros, and '' as hash.
    """
    file = files.read(byte_path)
    with open(piece_path, "rb") as model:
        sent = docs.sparkSession.sparkContext.broadcast((file, Merges.of(file), model.read()))
    give_back()
    whole = [T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_shared")]
    fields = [*whole, T.StructField("groups_sha256", T.StringType()), T.StructField("pairs", T.BinaryType()), T.StructField("times", T.BinaryType())]
    return with_columns(docs, text, fields, lambda: Aligner(*sent.value).align, keep)


def added(pairs: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate(pairs), return_inverse=True)
    return keys, np.bincount(where, np.concatenate(times), len(keys)).astype(np.int64)


def pair_counts(found: DataFrame) -> DataFrame:
    """pair, n (links of all texts that hold it), best (n is the highest of its B id). Tasks add up first, so no pair is frequent in the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, times, held = [], [], 0

        def batch_of() -> pa.RecordBatch:
            keys, n = added(pairs, times)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["pair", "n"])

        for batch in batches:
            pairs.append(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i8"))
            times.append(np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").astype(np.int64))
            held += len(pairs[-1])
            if held >= GATHERED:
                keys, n = added(pairs, times)
                pairs, times, held = [keys], [n], 0
                if len(keys) >= GATHERED // 2:
                    yield batch_of()
                    pairs, times = [], []
        if pairs:
            yield batch_of()
        give_back()

    total = found.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    total = written(total.withColumn("b", b))
    return written(total.join(total.groupBy("b").agg(F.max("n").alias("_most")), "b").select("pair", "n", (F.col("n") == F.col("_most")).alias("best")))


def scored(found: DataFrame, counts: DataFrame, most: int = MOST_PAIRS) -> DataFrame:
    """``found`` with n_best and count_sum in place of pairs and times. ``counts`` as of ``pair_counts`` of the same rows.

    Up to ``most`` pairs are sent to every task as sorted arrays; more are joined by a shuffle, in which the frequent pairs are broadcast.
    """
    names = [c for c in found.columns if c not in ("pairs", "times", "n_best", "count_sum")]
    schema = T.StructType([found.schema[c] for c in names] + [T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    if counts.count() > most:
        return joined(found, counts, names)
    table = counts.orderBy("pair").toArrow()
    arrays = (table.column("pair").to_numpy(), table.column("n").to_numpy(), table.column("best").to_numpy())
    sent = found.sparkSession.sparkContext.broadcast(arrays)
    place = {c: i for i, c in enumerate(found.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = sent.value
        for batch in batches:
            packed = batch.column(place["pairs"]).to_pylist()
            pairs = np.frombuffer(b"".join(packed), "<i8")
            times = np.frombuffer(b"".join(batch.column(place["times"]).to_pylist()), "<u4").astype(np.int64)
            at = np.searchsorted(keys, pairs)
            stop = np.concatenate(([0], np.cumsum([len(p) // 8 for p in packed]))).astype(np.int64)
            sums = [np.concatenate(([0], np.cumsum(v)))[stop] for v in (times * best[at], times * n[at])] if len(keys) else [np.zeros(len(packed) + 1, np.int64)] * 2
            yield pa.RecordBatch.from_arrays([*(batch.column(place[c]) for c in names), *(pa.array(np.diff(s)) for s in sums)], names=schema.names)

    return numbered(found).mapInArrow(run, schema)


def joined(found: DataFrame, counts: DataFrame, names: list[str]) -> DataFrame:
    """The same by a join on the pairs, for vocabularies whose counts no task should hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, packed, times = (batch.column(i) for i in range(3))
            size = [len(p) // 8 for p in packed.to_pylist()]
            columns = [np.repeat(row.to_numpy(), size), np.frombuffer(b"".join(packed.to_pylist()), "<i8"), np.frombuffer(b"".join(times.to_pylist()), "<u4").astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["_row", "pair", "times"])

    row, best, total = fresh(found, "_row", "n_best", "count_sum")
    rows = written(found.withColumn(row, F.monotonically_increasing_id()))
    each = rows.select(F.col(row).alias("_row"), "pairs", "times").mapInArrow(run, "_row long, pair long, times long")
    facts = counts.withColumn("_k", F.col("n"))
    links = int(counts.agg(F.sum("n")).first()[0] or 0)
    sums = spread_join(each, facts, "pair", "_k", links).groupBy(F.col("_row").alias(row)).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias(best), F.sum(F.col("times") * F.col("n")).alias(total))
    zero = lambda c, name: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(name)
    return rows.join(sums, row, "left").select(*[F.col(f"`{c}`") for c in names], zero(best, "n_best"), zero(total, "count_sum"))


def align(docs: DataFrame, byte_path: str, piece_path: str, text: str = "text", keep: list[str] | None = None, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """``docs`` (or its columns ``keep``) aligned in the tokens of two files: n_a, n_b, n_groups, n_links, n_shared, groups_sha256, n_best, count_sum.

    A encodes a space and the text by the byte-level file, B the text by the sentencepiece model, which adds that space; special strings
    are plain text. Offsets where tokens of both sides end cut them into groups. Links are token pairs that end together, a pair's count
    is how many links of all rows hold its ids; n_best are the links whose count is the highest of their B id, count_sum is over links.
    Null and empty texts, and those whose bytes a side doesn't give back, have zeros and ''. Each row counts, repeated or not; rows without
    doc_id are like others; an empty table gives no rows. Columns named as the results are replaced, others stay.
    """
    found = written(aligned(docs, byte_path, piece_path, text, keep))
    return scored(found, pair_counts(found), most_pairs)
