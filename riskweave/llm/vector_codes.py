"""Compression of vectors by parts: codebooks by Lloyd's rounds, with Elkan's bounds.

Each vector is cut into equal parts, and each part is given the number of the
nearest entry in the codebook of its place. Between rounds a vector keeps, for
each part, an upper bound of the distance to its entry and one lower bound for
each entry, shifted by what the entries have moved. An entry is compared only
where neither its lower bound nor half its distance from the vector's own entry is
above the upper bound. Both must be strictly above, so that no tie is lost; what
is left is compared by integer squared distances, equal ones by lower number.
Bounds are integers too: rounded up above, down below.

Scale: a round is one pass over its rows where they lie, without a shuffle; it
writes rows with their bounds as a table in the shared folder (a lost executor
costs a reread), and sums by part and entry for each partition, which Spark adds
up. The driver holds the codebooks alone. The table of a round before goes once
the next one is written.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm.common import broadcast_if, materialise, shared_dir, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
BROADCAST_ROWS = 1_000_000
MOST = 2**31 - 1
STATE = [("q", pa.int32()), ("codes", pa.int8()), ("upper", pa.int32()), ("lower", pa.int32())]


def whole_numbers(vector: Column, dimensions: int) -> Column:
    """floor(SCALE * x) of each component, held within bounds so that squared distances of whole vectors fit a long."""
    most = float(2 ** ((62 - math.ceil(math.log2(max(2, dimensions)))) // 2 - 1))
    return F.transform(vector, lambda x: F.floor(F.least(F.greatest(x.cast("double") * SCALE, F.lit(-most)), F.lit(most))).cast("int"))


def is_finite(vector: Column) -> Column:
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & good, F.lit(False))


def root(squares: np.ndarray) -> np.ndarray:
    """Largest whole numbers whose squares are within squares."""
    r = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    r -= r * r > squares
    return r + ((r + 1) * (r + 1) <= squares)


def root_up(squares: np.ndarray) -> np.ndarray:
    r = root(squares)
    return r + (r * r < squares)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return np.einsum("...i,...i->...", d, d)


def nearest(q: np.ndarray, book: np.ndarray, codes: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """codes, upper and lower of one part's rows q for the entries of book, and how many distances were computed.

    codes and bounds are those of the round before, moved says how far (rounded up)
    each entry has gone since; without them all entries are compared.
    """
    if codes is None:
        squares = squared(q[:, None, :], book[None])
        codes = squares.argmin(axis=1)
        return codes, root_up(squares[np.arange(len(q)), codes]), root(squares), squares.size
    rows = np.arange(len(q))
    upper, lower = np.minimum(upper + moved[codes], MOST), np.maximum(lower - moved, 0)
    apart = root(squared(book[:, None, :], book[None]))
    np.fill_diagonal(apart, MOST)
    live = np.flatnonzero(2 * upper >= apart.min(axis=1)[codes])

    def rivals(at):
        u = upper[at, None]
        open_ = (lower[at] <= u) & (apart[codes[at]] <= 2 * u)
        open_[np.arange(len(at)), codes[at]] = False
        return open_

    live = live[rivals(live).any(axis=1)]
    own = squared(q[live], book[codes[live]])
    upper[live] = root_up(own)
    lower[live, codes[live]] = root(own)
    open_ = rivals(live)
    i, j = np.nonzero(open_)
    met = squared(q[live[i]], book[j])
    lower[live[i], j] = root(met)
    squares = np.full((len(live), len(book)), np.iinfo(np.int64).max)
    squares[np.arange(len(live)), codes[live]] = own
    squares[i, j] = met
    best = squares.argmin(axis=1) if len(live) else codes[live]
    codes = codes.copy()
    codes[live] = best
    upper[live] = root_up(squares[np.arange(len(live)), best])
    return codes, upper, lower, len(live) + len(i) + apart.size * bool(len(rows))


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Rows of equal length as a list column."""
    size = int(np.prod(values.shape[1:]))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * size, pa.int32()), pa.array(values.reshape(-1), kind))


def one_round(rows: DataFrame, kept: list[str], books: np.ndarray, moved: np.ndarray, last: bool) -> DataFrame:
    """Rows with codes and bounds for books; in the last round with error in their place; then sums by part and entry (part, entry, n, sums)."""
    parts, entries, width = books.shape
    known = "codes" in rows.columns
    sums_of = [("part", "int"), ("entry", "int"), ("n", "long"), ("sums", "array<long>"), ("compared", "long")]
    own = [("codes", "array<byte>"), ("error", "long")] if last else [("q", "array<int>"), ("codes", "array<byte>"), ("upper", "array<int>"), ("lower", "array<int>")]
    schema = T.StructType([rows.schema[c] for c in kept] + T.StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in own + sums_of)).fields)

    def run(batches):
        sums, counts, compared = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64), 0
        kinds = None
        for batch in batches:
            n = batch.num_rows
            read = lambda c, *shape, b=batch: b.column(c).flatten().to_numpy().astype(np.int64).reshape(b.num_rows, *shape)
            q = read("q", parts, width)
            codes, upper, lower = (read("codes", parts), read("upper", parts), read("lower", parts, entries)) if known else (None,) * 3
            new = [nearest(q[:, p], books[p], *(x[:, p] if known else None for x in (codes, upper, lower)), moved[p]) for p in range(parts)]
            codes, upper, lower = (np.stack([x[k] for x in new], axis=1) for k in range(3))
            compared += sum(x[3] for x in new)
            for p in range(parts):
                np.add.at(sums[p], codes[:, p], q[:, p])
                counts[p] += np.bincount(codes[:, p], minlength=entries)
            if last:
                error = sum(squared(q[:, p], books[p][codes[:, p]]) for p in range(parts))
                columns = [_lists(codes, pa.int8()), pa.array(error, pa.int64())]
            else:
                columns = [batch.column("q"), _lists(codes, pa.int8()), _lists(upper, pa.int32()), _lists(lower, pa.int32())]
            columns = [batch.column(c) for c in kept] + columns + [pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.int64())]
            names = [*kept, *(c for c, _ in own), *(c for c, _ in sums_of)]
            out = pa.RecordBatch.from_arrays(columns, names)
            kinds = out.schema
            yield out
        if kinds is not None and not last:
            p, e = np.nonzero(counts)
            size = len(p)
            empty = [pa.nulls(size, f.type) for f in list(kinds)[: len(kept) + len(own)]]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), _lists(sums[p, e], pa.int64()), pa.array(np.where(np.arange(size) == 0, compared, 0), pa.int64())], kinds.names)

    return rows.mapInArrow(run, schema)


def _write(spark: SparkSession, df: DataFrame) -> tuple[DataFrame, str]:
    path = f"{shared_dir(spark)}/vector-bounds-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _drop(spark: SparkSession, path: str | None) -> None:
    if path:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def compress_vectors(vectors: DataFrame, *, id_column: str = "vec_id", vector: str = "embedding", keep: tuple[str, ...] = (), parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray, list[int]]:
    """Codes of vectors, the codebooks (part, entry, position) and how many distances each round but the last computed.

    The frame has id_column, the columns in keep, codes (a number for each part) and
    error (squared distances summed over parts). Codebooks begin as the parts of the
    `entries` smallest ids; in each round parts go to their nearest entries (equal
    distances to the lower number), which become the componentwise floor of their
    means; entries without parts stay. Codes are those for the codebooks returned.

    Components count as floor(4096 * x), at most 2^27 in size in vectors of up to 64.
    Vectors that are null, hold null or non-finite components, or have another length
    than that of the smallest id are left out; a length that parts don't divide is an
    error. Rows with a null id are coded but begin no codebook. Of rows that repeat an
    id the least vector begins the codebook; all are coded. With fewer ids than entries
    there are so many entries. Without any id left (as in an empty table) the result is
    empty. Other columns, whatever their names, are left out.
    """
    spark = vectors.sparkSession
    kept = [id_column, *keep]
    rows = vectors.where(is_finite(F.col(vector))).select(*kept, F.col(vector).alias("_vector"))
    ids = rows.where(F.col(id_column).isNotNull())
    first = [r[0] for r in ids.select(id_column).distinct().orderBy(id_column).limit(entries).collect()]
    length = F.size("_vector")
    if first:
        dimensions = ids.where(F.col(id_column) == first[0]).agg(F.min(F.struct(length.alias("n"), "_vector"))).first()[0]["n"]
        ids = ids.where(length == dimensions)
        first = [r[0] for r in ids.select(id_column).distinct().orderBy(id_column).limit(entries).collect()]
    if not first or not dimensions:
        return rows.where(F.lit(False)).select(*kept, F.lit(None).cast("array<byte>").alias("codes"), F.lit(None).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64), []
    if dimensions % parts:
        raise ValueError(f"{dimensions} components can't be cut into {parts} equal parts")
    rows = rows.where(length == dimensions).select(*kept, whole_numbers(F.col("_vector"), dimensions).alias("q"))
    begin = rows.where(F.col(id_column).isin(first)).groupBy(id_column).agg(F.min("q").alias("q")).orderBy(id_column).collect()  # a row an entry
    books = np.array([r["q"] for r in begin], np.int64).reshape(len(begin), parts, -1).transpose(1, 0, 2).copy()
    moved, before, compared = np.zeros(books.shape[:2], np.int64), None, []
    for _ in range(rounds):
        state, path = _write(spark, one_round(rows, kept, books, moved, False))
        found = state.where("part is not null").select("part", "entry", "n", "compared", F.posexplode("sums"))
        found = found.groupBy("part", "entry", "pos").agg(F.sum("n").alias("n"), F.sum("col").alias("sum"), F.sum("compared").alias("compared")).collect()  # a row a component of the codebooks
        new = books.copy()
        for r in found:
            new[r["part"], r["entry"], r["pos"]] = r["sum"] // r["n"]
        compared.append(sum(r["compared"] for r in found if not r["pos"]))
        moved, books = root_up(squared(new, books)), new
        rows = state.where("part is null").select(*kept, *(c for c, _ in STATE))
        _drop(spark, before)
        before = path
    coded, _ = _write(spark, one_round(rows, kept, books, moved, True))
    _drop(spark, before)
    return coded.select(*kept, "codes", "error"), books, compared


def op13_vector_codes(spark, sf_dir):
    coded, books, _ = compress_vectors(table(spark, sf_dir, "embeddings"), keep=("label",))
    totals = materialise(coded.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error")), "label-errors")
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c.cast("long")), 2, "0"))), "")
    met = coded.join(broadcast_if(totals, totals.count(), BROADCAST_ROWS), F.col("label").eqNullSafe(F.col("_label")))
    return met.select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql(rounds: int = ROUNDS) -> str:
    """All distances in each round, without bounds."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT row, v.part, min((d, entry)) AS best FROM (SELECT row, v.part, entry, list_sum(list_transform(range(1, len(v.x) + 1), lambda j: (v.x[j] - c.x[j]) * (v.x[j] - c.x[j])))::BIGINT AS d FROM v JOIN c{i} c ON v.part = c.part) v GROUP BY row, v.part)""")
        if i < rounds:
            steps.append(f"""m{i} AS (SELECT part, entry, list(s ORDER BY j) AS x FROM (SELECT part, entry, j, floor(sum(x)::DOUBLE / count(*))::BIGINT AS s FROM (SELECT v.part, best[2] AS entry, unnest(v.x) AS x, unnest(range(len(v.x))) AS j FROM v JOIN a{i} a ON a.row = v.row AND a.part = v.part) GROUP BY part, entry, j) GROUP BY part, entry),
  c{i + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m ON m.part = c.part AND m.entry = c.entry)""")
    return f"""WITH k AS (SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  v AS MATERIALIZED (SELECT row, p AS part, q[p * len(q) // {PARTS} + 1 : (p + 1) * len(q) // {PARTS}] AS x FROM k, range({PARTS}) r(p)),
  c0 AS (SELECT v.part, entry, v.x FROM v JOIN (SELECT row, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k ORDER BY vec_id LIMIT {ENTRIES}) f USING (row)),
  {', '.join(steps)},
  e AS (SELECT k.vec_id, k.label, string_agg(lpad(lower(to_hex(best[2])), 2, '0'), '' ORDER BY part) AS code, sum(best[1])::BIGINT AS error FROM a{rounds} JOIN k USING (row) GROUP BY k.row, k.vec_id, k.label)
  SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM c{rounds}) AS codebooks_sha256 FROM e"""


OP13_SQL = _sql()
