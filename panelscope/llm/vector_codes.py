"""Vector code compression: integer parts coded by codebooks, with per-dimension value dictionaries.

A vector becomes integers and is cut into consecutive parts; every part is coded by
the nearest entry of its codebook, which rounds of integer means have fitted. The
distinct integers of a dimension are its dictionary: their squared differences to all
entries are tabulated once, and the distances of parts are gathers from these tables
by dictionary code, added up. All arithmetic is exact, so results do not depend on
how rows are spread over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_scratch
from .similar import small_join

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LARGEST = 1 << 28  # components beyond count as this; squares of whole vectors fit 64 bits
AT_ONCE = 4096  # rows whose dictionaries are made together: a table has at most so many rows


class Codebooks(NamedTuple):
    """``entries`` is a parts x entries x positions table of integers."""

    entries: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def assign(part: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row (ties to the lower) and its squared distance."""
    total = np.zeros((len(part), len(entries)), np.int64)
    for j in range(part.shape[1]):
        values, code = np.unique(part[:, j], return_inverse=True)
        table = np.square(values[:, None] - entries[None, :, j])
        total += table[code]
    nearest = total.argmin(axis=1)
    return nearest, total[np.arange(len(part)), nearest]


def _rows_of(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(-1, dimensions)


def integers(vectors: DataFrame, vector: str, scale: int = SCALE) -> DataFrame:
    """The rows with a whole vector, which becomes ``_v``, integers; the other columns stay boxed in ``_row``."""
    held = F.col(f"`{vector}`")
    whole = held.isNotNull() & F.forall(
        held, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))

    def number(x: Column) -> Column:
        return F.greatest(F.least(F.floor(F.greatest(F.least(
            x.cast("double") * scale, F.lit(1e18)), F.lit(-1e18))), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int")

    return vectors.where(whole).select(
        F.struct(*[F.col(f"`{c}`") for c in vectors.columns if c != vector]).alias("_row"),
        F.transform(held, number).alias("_v"))


def first_entries(rows: DataFrame, key: str, parts: int, entries: int) -> Codebooks | None:
    """The parts of the vectors with the least keys; null keys come last, equal ones by vector."""
    order = F.col("_row").getField(key)
    least = rows.select(order.alias("_key"), "_v").orderBy(F.col("_key").asc_nulls_last(), "_v").limit(entries).collect()
    if not least:
        return None
    held = np.array([r["_v"] for r in least], np.int64)
    return Codebooks(held.reshape(len(held), parts, -1).transpose(1, 0, 2).copy())


def _sums(rows: DataFrame, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """How many parts each entry gets, and their componentwise sums; as large as the codebooks."""
    parts, entries, positions = books.entries.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, positions), np.int64)
        for batch in batches:
            vectors = _rows_of(batch.column(0), parts * positions)
            for at in range(0, len(vectors), AT_ONCE):
                for p in range(parts):
                    piece = vectors[at:at + AT_ONCE, p * positions:(p + 1) * positions]
                    code, _ = assign(piece, books.entries[p])
                    order = np.argsort(code, kind="stable")
                    used, first, n = np.unique(code[order], return_index=True, return_counts=True)
                    count[p, used] += n
                    total[p, used] += np.add.reduceat(piece[order], first, axis=0)
        p, e = np.nonzero(count)
        at = np.repeat(np.arange(len(p)), positions)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x.astype(np.int64)) for x in (
                p[at], e[at], np.tile(np.arange(positions), len(p)), count[p, e][at], total[p, e].ravel())],
            ["part", "entry", "position", "n", "total"])

    told = rows.select("_v").mapInArrow(
        partial, "part long, entry long, position long, n long, total long"
    ).groupBy("part", "entry", "position").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, positions), np.int64)
    for r in told:
        count[r.part, r.entry] = r.n
        total[r.part, r.entry, r.position] = r.total
    return count, total


def fit(rows: DataFrame, books: Codebooks, rounds: int = ROUNDS) -> Codebooks:
    """Each round replaces entries by the floors of their parts' means; unused ones stay."""
    for _ in range(rounds):
        count, total = _sums(rows, books)
        used = count > 0
        entries = books.entries.copy()
        entries[used] = total[used] // count[used][:, None]
        books = Codebooks(entries)
    return books


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """``rows`` with ``_code``, two hex digits a part, and ``_error`` in place of ``_v``."""
    parts, entries, positions = books.entries.shape
    kind = next(f for f in rows.schema.fields if f.name == "_row").dataType

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, codes, errors = _rows_of(batch.column("_v"), parts * positions), [], []
            for at in range(0, len(vectors), AT_ONCE):
                found = [assign(vectors[at:at + AT_ONCE, p * positions:(p + 1) * positions], books.entries[p])
                         for p in range(parts)]
                digits = np.stack([code for code, _ in found], axis=1).astype(np.uint8)
                codes += [row.tobytes().hex() for row in digits]
                errors.append(sum(error for _, error in found))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), pa.array(codes, pa.string()),
                 pa.array(np.concatenate(errors) if errors else [], pa.int64())], ["_row", "_code", "_error"])

    from pyspark.sql.types import LongType, StringType, StructField, StructType

    return rows.mapInArrow(coded, StructType([
        StructField("_row", kind), StructField("_code", StringType()), StructField("_error", LongType())]))


def compressed(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
    entries: int = ENTRIES, rounds: int = ROUNDS,
) -> DataFrame:
    """One row per whole vector: key, label, code, error, label_error, codebooks_sha256.

    Rows whose vector is null or holds null or non-finite components go; so do vectors
    without components or of another length than that of the least key, and all of them
    if that length is no multiple of ``parts``. Components beyond ``LARGEST`` / 1024
    count as that. With fewer vectors than ``entries`` all of them are entries. Repeated
    rows are kept and count each; null keys come last as first entries; null labels are
    one label. An empty table gives an empty table. Other columns are not read.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits a part")
    chosen = vectors.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label"),
                            F.col(f"`{vector}`").alias("vector"))
    rows = write_scratch(integers(chosen, "vector"), "vectors")
    least = rows.select(F.col("_row.key").alias("_key"), "_v").orderBy(
        F.col("_key").asc_nulls_last(), "_v").limit(1).collect()
    length = len(least[0]["_v"]) if least else 0
    rows = rows.where(F.size("_v") == (length if length and length % parts == 0 else -1))
    books = first_entries(rows, "key", parts, entries)
    if books is None:
        books = Codebooks(np.zeros((parts, 1, 1), np.int64))
    else:
        books = fit(rows, books, rounds)
    coded = write_scratch(encode(rows, books).select(
        F.col("_row.key").alias(key), F.col("_row.label").alias("label"), F.col("_code").alias("code"),
        F.col("_error").alias("error")), "codes")
    # combined before it is moved: a label with a third of all rows is no hot spot
    sums = write_scratch(coded.groupBy("label").agg(F.least(
        F.sum(F.col("error").cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long").alias(
        "label_error")).withColumnRenamed("label", "_label"), "label-errors")
    return small_join(coded, sums, F.col("label").eqNullSafe(F.col("_label")), "inner").select(
        key, F.col("label").alias(label), "code", "error", "label_error",
        F.lit(books.digest()).alias("codebooks_sha256"))


def decoded(codes: list[str], books: Codebooks) -> np.ndarray:
    """The integer vectors that codes stand for."""
    at = np.array([list(bytes.fromhex(c)) for c in codes], np.int64).reshape(len(codes), -1)
    return np.concatenate([books.entries[p][at[:, p]] for p in range(at.shape[1])], axis=1)
