"""Vector code compression (operator 13): product codes, with entries found by annular norm pruning.

A vector is cut into PARTS equal parts, and each part is written as the number of the nearest of ENTRIES codebook
entries. Vectors are integers, so distances, ties and means are exact and no order of rows or tasks changes a code.

Entries are sorted by norm. The entry whose norm is nearest to a part's own gives a first distance; an entry that is no
farther off has a norm within that distance of the part's, so binary searches bound an annulus of entries. Its
entries are evaluated exactly, from the middle outwards, and each better distance narrows the annulus; its borders
belong to it, so ties are seen.

Codebooks (PARTS * ENTRIES entries) are all that tasks are given and all that comes back: each task adds up its own rows
by entry, a groupBy adds up the tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.llm.common import in_small_batches, stored

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256
#: Components are held within this size, which keeps sums of squares within 64 bits up to 256 components a vector.
MOST = 1 << 26
#: Labels whose sums go to all tasks; beyond that rows and sums are joined by label, each label SALT ways.
LABELS, SALT = 100_000, 32


def whole_numbers(vector: Column) -> Column:
    """floor(SCALE * x) of each component, within +-MOST; null for a null vector or one with a component that is null,
    not a number or infinite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    whole = F.transform(vector, lambda x: F.floor(F.least(F.greatest(x.cast("double") * SCALE, F.lit(-float(MOST))), F.lit(float(MOST)))).cast("int"))
    return F.when(vector.isNotNull() & ~F.exists(vector, bad), whole)


class Codebook:
    """The entries of one part, sorted by norm."""

    def __init__(self, entries: np.ndarray):
        norms = np.sqrt((entries.astype(np.float64) ** 2).sum(1))
        self.order = np.argsort(norms, kind="stable")
        self.norms, self.entries = norms[self.order], entries[self.order]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest entry of each part, the least among equally near ones, and its squared distance."""
        norm = np.sqrt((parts.astype(np.float64) ** 2).sum(1))
        n, rows = len(self.norms), np.arange(len(parts))
        best, code = np.full(len(parts), np.iinfo(np.int64).max), np.full(len(parts), n)
        begin, end = np.zeros(len(parts), np.int64), np.full(len(parts), n)
        up = np.searchsorted(self.norms, norm)
        down = up - 1
        while len(rows):
            for at in (up, down):
                some = rows[(at[rows] >= begin[rows]) & (at[rows] < end[rows])]
                k = at[some]
                far = ((parts[some] - self.entries[k]) ** 2).sum(1)
                better = (far < best[some]) | ((far == best[some]) & (self.order[k] < code[some]))
                now = some[better]
                best[now], code[now] = far[better], self.order[k[better]]
                # A little wider than the distance, so that rounding excludes no entry.
                width = np.sqrt(best[now]) * (1 + 1e-9) + 1e-6 + norm[now] * 1e-12
                begin[now], end[now] = np.searchsorted(self.norms, norm[now] - width), np.searchsorted(self.norms, norm[now] + width, "right")
            up[rows] += 1
            down[rows] -= 1
            rows = rows[(up[rows] < end[rows]) | (down[rows] >= begin[rows])]
        return code, best


def _batches(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Each batch with its vectors (row, part, component), codes and squared distances (row, part)."""
    parts, _, size = books.shape
    made = [Codebook(b) for b in books]
    for batch in batches:
        column = batch.column("v")
        vectors = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), parts, size)
        found = [book.nearest(vectors[:, p]) for p, book in enumerate(made)]
        yield batch, vectors, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def first_entries(whole: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray | None:
    """(part, entry, component): the parts of the vectors v with the least ids, null ids last, equal ids by vector; vectors
    of another length than the first one's give none. Nothing if no vector can be cut."""
    first = whole.where((F.size("v") > 0) & (F.size("v") % parts == 0)).orderBy(F.col("id").asc_nulls_last(), "v").select(F.size("v").alias("n")).limit(1).collect()
    if not first:
        return None
    some = whole.where(F.size("v") == first[0].n).orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    return np.array([r.v for r in some], np.int64).reshape(len(some), parts, -1).transpose(1, 0, 2)


def improved(whole: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry is the floor of its parts' mean, unused entries stay."""
    parts, entries, size = books.shape

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * entries, size), np.int64), np.zeros(parts * entries, np.int64)
        for _, vectors, codes, _ in _batches(batches, books):
            at = (codes + np.arange(parts) * entries).ravel()
            np.add.at(sums, at, vectors.reshape(-1, size))
            counts += np.bincount(at, minlength=len(counts))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used], pa.int64()), pa.array(list(sums[used]), pa.list_(pa.int64()))], ["entry", "n", "sums"])

    each = whole.select("v").mapInArrow(added, "entry bigint, n bigint, sums array<bigint>")
    # A sum may pass 64 bits in a very large table, a decimal does not.
    total = each.select("entry", "n", F.posexplode("sums").alias("k", "s")).groupBy("entry", "k").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(30,0)")).alias("s"))
    out = books.copy().reshape(parts * entries, size)
    for r in total.collect():
        out[r.entry, r.k] = int(r.s) // r.n
    return out.reshape(books.shape)


def fitted(whole: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    books = first_entries(whole, parts, entries)
    if books is not None:
        fit = whole.where(F.size("v") == books.shape[0] * books.shape[2])
        for _ in range(rounds):
            books = improved(fit, books)
    return books


def encoded(whole: DataFrame, books: np.ndarray) -> DataFrame:
    """id, codes (a number for each part), error and label of rows (id, v, label)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, codes, far in _batches(batches, books):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(codes.astype(np.int32)), pa.list_(pa.int32())), pa.array(far.sum(1), pa.int64()), batch.column("label")], ["id", "codes", "error", "label"])

    return whole.select(F.col("id").cast("long"), "v", F.col("label").cast("long")).mapInArrow(made, "id bigint, codes array<int>, error bigint, label bigint")


def decoded(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """id and v, the whole numbers that each row's codes stand for."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column("codes").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            vectors = books[np.arange(len(books)), codes].reshape(len(codes), -1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(vectors), pa.list_(pa.int64()))], ["id", "v"])

    return coded.select("id", "codes").where("codes is not null").mapInArrow(made, "id bigint, v array<bigint>")


def with_label_errors(coded: DataFrame, labels: int = LABELS, salt: int = SALT) -> DataFrame:
    """The rows with label_error, the sum of error over rows of their label; null labels are one label.

    Sums of up to `labels` labels (counted, not guessed) go to all tasks; beyond that a label's rows spread over `salt`
    tasks, which each get the label's sum.
    """
    sums = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "of")
    if sums.count() <= labels:
        return coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("of"))).drop("of")
    salted = coded.withColumn("turn", F.pmod(F.xxhash64("id", "codes"), F.lit(salt)))
    each = sums.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salt - 1).cast("long"))))
    return salted.join(each, F.col("label").eqNullSafe(F.col("of")) & (F.col("turn") == F.col("at"))).drop("of", "turn", "at")


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every row of embeddings whose vector has finite components
    only.

    Components count up to a size of 2^18 (2^26 after scaling) and as that beyond it. Equal ids are ordered by vector; null
    ids come last. A row whose vector has another length than that of the least id whose length is a multiple of 16 has
    null as code and error, which its label's error leaves out; without any such vector all rows are so, and the digest is
    that of an empty text. An empty table gives an empty one.
    """
    in_small_batches(spark)
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    whole = rows.select(F.col("vec_id").alias("id"), whole_numbers(F.col("embedding")).alias("v"), "label").where("v is not null")
    books = fitted(whole)
    if books is None:
        coded, digest = whole.select("id", F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("long").alias("error"), "label"), ""
    else:
        cut = books.shape[0] * books.shape[2]
        odd = whole.where(F.size("v") != cut).select("id", F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("long").alias("error"), F.col("label").cast("long"))
        coded, digest = encoded(whole.where(F.size("v") == cut), books).unionByName(odd), ",".join(map(str, books.ravel().tolist()))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    made = with_label_errors(stored(coded, "codes"))
    return made.select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(hashlib.sha256(digest.encode()).hexdigest()).alias("codebooks_sha256"))


def _rounds_sql() -> str:
    out = []
    for k in range(ROUNDS + 1):
        out.append(f"""d{k} AS (SELECT vec_id, label, p.part, e, p.x, list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p JOIN c{k} c ON c.part = p.part),
a{k} AS (SELECT * FROM d{k} QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, e) = 1)""")
        if k < ROUNDS:
            out.append(f"""m{k} AS (SELECT part, e, list(m ORDER BY j) AS x FROM (SELECT part, e, j, floor(sum(x[j]) / count(*))::BIGINT AS m FROM a{k}, (SELECT unnest(generate_series(1, (SELECT max(len(x)) FROM p))) AS j) GROUP BY ALL) GROUP BY ALL),
c{k + 1} AS (SELECT c.part, c.e, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN m{k} m ON m.part = c.part AND m.e = c.e)""")
    return ",\n".join(out)


#: Ids are unique in the given tables.
OP13_SQL = f"""WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, label, part, v[part * (len(v) // {PARTS}) + 1 : (part + 1) * (len(v) // {PARTS})] AS x FROM k, (SELECT unnest(generate_series(0, {PARTS - 1})) AS part)),
c0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, x FROM p WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT {ENTRIES})),
{_rounds_sql()},
coded AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY ALL)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, e)) FROM c{ROUNDS}) AS codebooks_sha256 FROM coded"""
