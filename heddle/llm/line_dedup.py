"""Line dedup: lines that many documents hold stay in one of them.

Hashes of lines are dealt out by ranges of (hash, document, position) and sorted so; each task streams its range and sees the largest
document of a hash first. A hash whose lines fill several ranges is settled from a few rows per range, so no task needs all lines of one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import chunks, give_back, numbered
from .common import fresh, small, written

BLANKS = b" \t\n\x0b\x0c\r"
#: Stands for a missing doc_id: one document below all others.
NO_ID = -(1 << 63)
#: What a streamed row says: its range did not hold all of its hash; it is dropped; its hash goes on in the next range and is common already.
UNSETTLED, DROPPED, COMMON = 0, 1, 2


def key(line: bytes) -> bytes:
    """The line without white space at both ends, A-Z in lower case."""
    return line.strip(BLANKS).lower()


def long_enough(k: bytes, least: int) -> bool:
    return len(k) >= least and (len(k) >= 4 * least or len(k.decode("utf-8", "replace")) >= least)


def lines(docs: DataFrame, text: str, doc_id: str, least_chars: int) -> DataFrame:
    """doc, mark (CRC-32 of the text), n_lines, and for each line with a key of ``least_chars`` code points or more its 128-bit hash
    (h1, h2) and position. Each text also has one row with position -1, so texts without such lines are there too."""
    schema = "doc long, mark long, n_lines int, h1 long, h2 long, pos int"
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
    names = ["doc", "mark", "n_lines", "h1", "h2", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, done = batch.column(0).to_pylist(), 0
            for part in chunks([x or "" for x in batch.column(1).to_pylist()]):
                doc, mark, count, at, digests = [], [], [], [], []
                for i, value in zip(ids[done : done + len(part)], part, strict=True):
                    raw = value.encode("utf-8", "replace")
                    cut = raw.split(b"\n")
                    found = [(p, xxhash.xxh3_128_digest(k)) for p, k in enumerate(map(key, cut)) if long_enough(k, least_chars)]
                    doc += [i] * (len(found) + 1)
                    mark += [zlib.crc32(raw)] * (len(found) + 1)
                    count += [len(cut)] * (len(found) + 1)
                    at += [-1, *(p for p, _ in found)]
                    digests += [bytes(16), *(h for _, h in found)]
                done += len(part)
                halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                columns = (doc, mark, count, halves[:, 0], halves[:, 1], at)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
        give_back()

    rows = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NO_ID)).alias("doc"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, schema)


class Stream:
    """Reads rows sorted by hash, document (largest first) and position, and says which lines go.

    Rows of a hash wait until ``least`` documents have been seen, so at most the lines of that many documents are held.
    """

    def __init__(self, least: int):
        self.least = least
        self.held: list[np.ndarray] | None = None  # rows of the last hash, while it has too few documents
        self.first: tuple[int, int] | None = None  # the range's first hash, whose start may lie in the range before
        self.going: tuple[int, int, int] | None = None  # the last hash once it is common, and its largest document

    def feed(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """``rows``: h1, h2, doc, mark, pos. Returns settled rows with a sixth array, what is said of each."""
        if self.held is not None:
            rows = [np.concatenate(x) for x in zip(self.held, rows, strict=True)]
            self.held = None
        h1, h2, doc = rows[:3]
        if self.first is None:
            self.first = (int(h1[0]), int(h2[0]))
        begins = np.ones(len(h1), bool)
        begins[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        starts = np.flatnonzero(begins)
        other = begins.copy()
        other[1:] |= doc[1:] != doc[:-1]
        many = np.add.reduceat(other.astype(np.int64), starts) >= self.least
        top = doc[starts].copy()
        if self.going is not None and (int(h1[0]), int(h2[0])) == self.going[:2]:
            many[0], top[0] = True, self.going[2]
        size = np.diff(np.append(starts, len(h1)))
        unsettled = (h1 == self.first[0]) & (h2 == self.first[1])
        said = np.where(unsettled, UNSETTLED, DROPPED).astype(np.int8)
        take = unsettled | (np.repeat(many, size) & (doc < np.repeat(top, size)))
        self.going = None
        last = (int(h1[-1]), int(h2[-1]))
        if last != self.first:
            if many[-1]:
                self.going = (*last, int(top[-1]))
            else:
                self.held = [x[starts[-1] :] for x in rows]
        return [x[take] for x in (*rows, said)]

    def end(self) -> list[np.ndarray]:
        """The last hash may go on in the next range: its waiting rows, or one row that tells it is common."""
        if self.held is not None:
            return [*self.held, np.full(len(self.held[0]), UNSETTLED, np.int8)]
        if self.going is not None:
            h1, h2, top = self.going
            return [np.array([v], np.int64) for v in (h1, h2, top, 0, -1)] + [np.array([COMMON], np.int8)]
        return [np.empty(0, np.int64)] * 5 + [np.empty(0, np.int8)]


def streamed(found: DataFrame, least_docs: int) -> DataFrame:
    """``found`` (h1, h2, doc, mark, pos) dealt out by ranges, sorted, streamed: the rows that a range alone settles or leaves open."""
    names = ["h1", "h2", "doc", "mark", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = Stream(least_docs)

        def batch_of(rows: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in rows[:4]] + [pa.array(rows[4].astype(np.int32)), pa.array(rows[5].astype(np.int32))], names=[*names, "said"])

        for batch in batches:
            if batch.num_rows:
                yield batch_of(stream.feed([batch.column(i).to_numpy().astype(np.int64) for i in range(5)]))
        yield batch_of(stream.end())
        give_back()

    order = [F.col("h1"), F.col("h2"), F.desc("doc"), F.col("mark"), F.col("pos")]
    dealt = found.select(*names).repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.mapInArrow(run, "h1 long, h2 long, doc long, mark long, pos int, said int")


def dropped(found: DataFrame, least_docs: int) -> DataFrame:
    """doc, mark, pos of the lines that go. Hashes at the ends of a range, two a range at most, are settled together."""
    told = written(streamed(found, least_docs))
    ends = told.where(F.col("said") != DROPPED)
    seen = ends.groupBy("h1", "h2", "doc").agg(F.max("said").alias("said"), F.max(F.when(F.col("said") == UNSETTLED, 1).otherwise(0)).alias("held"))
    whole = seen.groupBy("h1", "h2").agg(F.max("doc").alias("_top"), F.sum("held").alias("_docs"), F.max("said").alias("_said"))
    common = whole.where((F.col("_said") == COMMON) | (F.col("_docs") >= least_docs)).select("h1", "h2", "_top")
    late = told.where(F.col("said") == UNSETTLED).join(small(common, 1_000_000), ["h1", "h2"]).where("doc < _top")
    return told.where(F.col("said") == DROPPED).select("doc", "mark", "pos").unionByName(late.select("doc", "mark", "pos"))


def bitmap(n_lines: int, gone: list[int]) -> bytes:
    """One bit a line, set where it stays, compressed."""
    keep = np.ones(n_lines, np.uint8)
    keep[gone] = 0
    return zlib.compress(np.packbits(keep).tobytes())


def kept_lines(text: str, keep: bytes) -> str:
    cut = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))
    return "\n".join(line for line, bit in zip(cut, bits.tolist(), strict=False) if bit)


def keep_bitmaps(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """doc, mark, n_lines, n_dropped, keep of each distinct text of each document. ``keep`` has one bit a line, compressed.

    A line's key is the line without white space at both ends, A-Z in lower case. Keys of ``least_chars`` code points or more that
    ``least_docs`` documents or more hold lose their lines except in the largest doc_id that holds them, where all of them stay.
    Texts are split at \\n; null and empty texts are one empty line. Rows of one doc_id are one document, however often it repeats; rows
    without doc_id are together one document below all others (doc is then -2**63). ``mark``, a text's CRC-32, tells texts of one doc_id
    apart. An empty table gives no rows; other columns play no part. A text's dropped positions, as many as it has lines at most, meet in one row.
    """
    found = written(lines(docs, text, doc_id, least_chars))
    gone = dropped(found.where("pos >= 0"), least_docs)
    every = found.where("pos < 0").select("doc", "mark", "n_lines", F.lit(None).cast("int").alias("pos"))
    by = every.unionByName(gone.select("doc", "mark", F.lit(0).alias("n_lines"), "pos")).groupBy("doc", "mark").agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, mark, n, gone = (batch.column(i) for i in range(4))
            sets = gone.to_pylist()
            maps = [bitmap(k, sorted(g)) for k, g in zip(n.to_pylist(), sets, strict=True)]
            yield pa.RecordBatch.from_arrays([doc, mark, n.cast(pa.int64()), pa.array([len(g) for g in sets], pa.int64()), pa.array(maps, pa.binary())], names=["doc", "mark", "n_lines", "n_dropped", "keep"])

    return by.mapInArrow(run, "doc long, mark long, n_lines long, n_dropped long, keep binary")


def apply(docs: DataFrame, bitmaps: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with n_lines, n_dropped and kept (the text that is left) of each row, null texts as empty.

    ``bitmaps`` as of ``keep_bitmaps`` of the same rows. Columns named as the results are replaced; others, of whatever name, stay.
    """
    results = ["n_lines", "n_dropped", "kept"]
    names = [c for c in (keep if keep is not None else docs.columns) if c not in results]
    doc, mark, lines_, gone, bits, value = fresh(docs, "doc", "mark", "lines", "gone", "bits", "value")
    facts = bitmaps.toDF(doc, mark, lines_, gone, bits)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(*[F.col(f"`{c}`") for c in names], body.alias(value), F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NO_ID)).alias(doc), F.crc32(body.cast("binary")).alias(mark))
    both = rows.join(facts.hint("shuffle_hash"), [doc, mark]).select(*[F.col(f"`{c}`") for c in (*names, value, lines_, gone, bits)])
    last = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, ready = [], zip(*(batch.column(last + i).to_pylist() for i in (0, 2, 3)), strict=True)
            for body, n, packed in ready:
                kept.append(kept_lines(body, packed) if n else body)
            columns = [*batch.columns[:last], batch.column(last + 1), batch.column(last + 2), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *results])
        give_back()

    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())])
    return numbered(both).mapInArrow(run, schema)
