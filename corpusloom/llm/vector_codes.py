"""Codes of vectors by product quantisation in whole numbers, with memoised grid cells.

A component x becomes floor(256 x). Vectors are cut into PARTS equal parts; each
position has a codebook of up to ENTRIES entries, which starts from the vectors
of the smallest ids and is replaced `rounds` times by the floored means of the
parts assigned to its entries. All of this is exact, so any order of the rows
gives the same codes.

A part is assigned by its grid cell, the box of parts that agree but for their low bits.
For the cells that a task meets, each once, it works out the least and greatest squared
distance of every entry to the box and remembers the entries whose least distance isn't
beyond the smallest greatest one; no other can be nearest anywhere in the box. Only
these are measured, exactly; ties go to the lower index. Codebooks of fixed size go to
the tasks; from each round a task sends back sums and counts of its entries.

Rows whose vector is null or holds null or non-finite components are left out,
as are vectors without components and those whose length isn't a multiple of PARTS. Vectors
of another length have codebooks of their own. Components beyond 2**18 in size count
as that, so that sums of squares fit a long. Rows of equal ids are rows of their own;
among the first vectors they come in the order of their components. A row without an id
doesn't start an entry, but is coded where its length has entries. Null labels count
as one label. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keep

PARTS, ENTRIES, SCALE = 16, 64, 256
#: Greatest size of a whole-number component.
LARGEST = SCALE << 18
#: Low bits in which the parts of a cell differ, cells a task remembers at most, and parts that are measured together.
CELL_BITS, MOST_CELLS, TOGETHER = 5, 1 << 20, 1 << 14


def whole_numbers(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, row numbers and whole-number vectors of the usable rows of a batch."""
    vectors = batch.column(column)
    size = np.asarray(vectors.value_lengths().fill_null(0)).astype(np.int64)
    flat = vectors.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    for dim in np.unique(size[(size > 0) & (size % PARTS == 0)]).tolist():
        rows = np.flatnonzero(size == dim)
        values = flat[(ends[rows] - dim)[:, None] + np.arange(dim)]
        good = np.isfinite(values).all(1)
        yield dim, rows[good], np.clip(np.floor(values[good] * SCALE), -LARGEST, LARGEST).astype(np.int64)


class Cells:
    """The nearest entry of a codebook, for parts by their grid cells."""

    def __init__(self, codebook: np.ndarray):
        self.codebook = codebook
        self._forget()
        self.measured = 0

    def _forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.start, self.size, self.entries = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, cells: np.ndarray) -> None:
        """The entries that may be nearest to a part of each of these cells."""
        low = cells << CELL_BITS
        high = low + (1 << CELL_BITS) - 1
        starts, sizes, found = [], [], []
        used = len(self.entries)
        for i in range(0, len(cells), TOGETHER // 8):
            a, b = low[i : i + TOGETHER // 8, None], high[i : i + TOGETHER // 8, None]
            outside = np.maximum(np.maximum(a - self.codebook, self.codebook - b), 0)
            across = np.maximum(np.abs(self.codebook - a), np.abs(self.codebook - b))
            least, greatest = (outside**2).sum(-1), (across**2).sum(-1)
            row, entry = np.nonzero(least <= greatest.min(1, keepdims=True))
            size = np.bincount(row, minlength=len(a))
            starts.append(used + np.cumsum(size) - size)
            sizes.append(size)
            found.append(entry)
            used += len(entry)
        self.start, self.size, self.entries = np.concatenate([self.start, *starts]), np.concatenate([self.size, *sizes]), np.concatenate([self.entries, *found])

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each part."""
        cells, which = np.unique(parts >> CELL_BITS, axis=0, return_inverse=True)
        which = which.ravel()
        if len(self.number) + len(cells) > MOST_CELLS:
            self._forget()
        names = [c.tobytes() for c in cells]
        new = [i for i, name in enumerate(names) if name not in self.number]
        if new:
            self._learn(cells[new])
            for i in new:
                self.number[names[i]] = len(self.number)
        cell = np.array([self.number[name] for name in names], np.int64)[which]
        best, distance = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
        for i in range(0, len(parts), TOGETHER):
            some = slice(i, i + TOGETHER)
            size = self.size[cell[some]]
            first = np.cumsum(size) - size
            entry = self.entries[np.arange(size.sum()) + np.repeat(self.start[cell[some]] - first, size)]
            d = ((np.repeat(parts[some], size, 0) - self.codebook[entry]) ** 2).sum(1)
            self.measured += len(d)
            least = np.minimum.reduceat(d, first)
            best[some] = np.minimum.reduceat(np.where(d == np.repeat(least, size), entry, ENTRIES), first)
            distance[some] = least
        return best, distance


Books = dict[int, np.ndarray]


def _assigned(books: Books, dim: int, values: np.ndarray, known: dict[tuple[int, int], Cells]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each position: the parts, their entries and squared distances. books: length -> (position, entry, place)."""
    width = dim // PARTS
    for p in range(PARTS):
        parts = values[:, p * width : (p + 1) * width]
        yield parts, *known.setdefault((dim, p), Cells(books[dim][p])).nearest(parts)


_SUMS = "dim int, position int, entry int, place int, total bigint, n bigint"


def _sums(books: Books, column: str):
    """Sums and counts of the parts of a task's rows, by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int], Cells] = {}
        totals = {dim: np.zeros((*book.shape[:2], book.shape[2] + 1), np.int64) for dim, book in books.items()}
        for batch in batches:
            for dim, _, values in whole_numbers(batch, column):
                if dim not in books:
                    continue
                for p, (parts, entry, _) in enumerate(_assigned(books, dim, values, known)):
                    order = np.argsort(entry, kind="stable")
                    used, first = np.unique(entry[order], return_index=True)
                    if len(used):
                        totals[dim][p, used, :-1] += np.add.reduceat(parts[order], first)
                        totals[dim][p, used, -1] += np.diff(first, append=len(entry))
        for dim, total in totals.items():
            position, entry = np.nonzero(total[:, :, -1])
            width = total.shape[2] - 1
            own = np.repeat(position, width), np.repeat(entry, width), np.tile(np.arange(width), len(entry))
            n = len(own[0])
            columns = [pa.array(np.full(n, dim, np.int32)), *(pa.array(x.astype(np.int32)) for x in own), pa.array(total[position, entry, :-1].ravel()), pa.array(np.repeat(total[position, entry, -1], width))]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _SUMS.split(", ")])

    return run


_CODES = "vec_id bigint, label string, code string, error bigint, codebooks_sha256 string"


def _codes(books: Books, key: str, column: str, label: str):
    names = {dim: hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest() for dim, book in books.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int], Cells] = {}
        for batch in batches:
            for dim, rows, values in whole_numbers(batch, column):
                if not len(rows) or dim not in books:
                    continue
                codes, error = np.empty((len(rows), PARTS), np.uint8), np.zeros(len(rows), np.int64)
                for p, (_, entry, distance) in enumerate(_assigned(books, dim, values, known)):
                    codes[:, p] = entry
                    error += distance
                some = batch.take(pa.array(rows))
                text = [c.tobytes().hex() for c in codes]
                yield pa.RecordBatch.from_arrays([some.column(key), some.column(label), pa.array(text, pa.string()), pa.array(error), pa.array([names[dim]] * len(rows), pa.string())], names=[c.split()[0] for c in _CODES.split(", ")])

    return run


def first_books(rows: DataFrame, key: str, column: str) -> Books:
    """Codebooks of the vectors of the ENTRIES smallest ids of each length."""
    width = F.size(column)
    fit = F.col(key).isNotNull() & (width > 0) & (width % PARTS == 0) & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = rows.where(fit).select(width.alias("dim"), key, column)
    books = {}
    for (dim,) in sorted(usable.select("dim").distinct().collect()):
        least = usable.where(F.col("dim") == dim).orderBy(key, column).limit(ENTRIES).select(column).collect()
        values = np.clip(np.floor(np.array([r[0] for r in least], np.float64) * SCALE), -LARGEST, LARGEST).astype(np.int64)
        books[dim] = np.ascontiguousarray(values.reshape(len(least), PARTS, dim // PARTS).transpose(1, 0, 2))
    return books


def train(rows: DataFrame, rounds: int = 2, key: str = "vec_id", column: str = "embedding") -> Books:
    """Codebooks for each length of vectors: (position, entry, place)."""
    books = first_books(rows, key, column)
    for _ in range(rounds):
        sums = rows.select(column).mapInArrow(_sums(books, column), _SUMS).groupBy("dim", "position", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        after = {dim: book.copy() for dim, book in books.items()}
        for dim, position, entry, place, total, n in sums.collect():  # as many as codebooks have numbers
            after[dim][position, entry, place] = total // n
        books = after
    return books


def encode(vectors: DataFrame, rounds: int = 2, key: str = "vec_id", column: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error (errors of all rows of its label), codebooks_sha256 of every usable row.

    Labels that hold more than a thousandth of the rows, of which there are less than a
    thousand, are joined by broadcast, the others by their value.
    """
    rows = vectors.select(F.col(key).cast("bigint").alias(key), column, F.coalesce(F.concat(F.lit("1"), F.col(label).cast("string")), F.lit("0")).alias(label))
    books = train(rows, rounds, key, column)
    if not books:
        return rows.sparkSession.createDataFrame([], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string")
    coded = keep(rows.mapInArrow(_codes(books, key, column, label), _CODES), "codes")
    sums = keep(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label-errors")
    hot = F.col("n") > coded.count() / 1000
    often = F.broadcast(sums.where(hot).select("label", F.col("label_error").alias("often")))
    known = coded.join(often, "label", "left")
    rest = known.where("often is null").drop("often").join(sums.where(~hot).select("label", "label_error"), "label")
    columns = ("vec_id", "code", "error", "label_error", "codebooks_sha256")
    return known.where("often is not null").withColumnRenamed("often", "label_error").select(*columns).unionByName(rest.select(*columns))
