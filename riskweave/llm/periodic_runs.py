"""Periodic runs of words: stretches that repeat themselves, found by comparing a text with itself at every lag.

The words of a text become numbers. For each lag q up to n / min_exponent the
numbers are compared with themselves q words on, many lags in one vectorised
comparison; a stretch of equal places of length m is m + q words of period q.
Stretches are maximal, as what ends them differs. One whose period is a multiple
of a smaller one is left out: of a word repeated, lag 1 alone counts.

Scale: the comparisons of a text grow with the square of its words. Texts of up
to LONG_BYTES are done where they are read. A longer one is dealt out in ranges
of lags, more of them the longer it is, which are shuffled to different tasks;
each range sends back the runs it found (together at most n), which meet the text
again. Memory is bound by one text and CELLS comparisons.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import table
from riskweave.llm.wordhash import texts

MIN_WORDS, MIN_EXPONENT = 12, 2
#: Texts of more bytes have their lags dealt out; a range holds about as many comparisons as such a text needs.
LONG_BYTES = 32_768
#: Comparisons made at once.
CELLS = 1 << 16
RUN = "array<struct<start:long,length:long,period:long>>"
FOUND = f"doc_id long, n_words long, runs {RUN}, collapsed string"

Rewrite = Callable[[int | None, int], np.ndarray | None]


@lru_cache(4096)
def prime_factors(q: int) -> tuple[int, ...]:
    out, p = [], 2
    while p * p <= q:
        if q % p == 0:
            out.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return (*out, q) if q > 1 else tuple(out)


def _smallest(ids: np.ndarray, start: int, q: int) -> bool:
    """Whether no smaller number is a period of the run that starts here: such a one would divide q."""
    first = ids[start : start + q]
    return not any(np.array_equal(first, ids[start + q // r : start + q // r + q]) for r in prime_factors(q))


def lag_runs(ids: np.ndarray, low: int, high: int, *, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs whose period lies from low to high, in no order."""
    n, out = len(ids), []
    high = min(high, n // min_exponent)
    ids = ids.astype(np.int16 if n < 1 << 15 else np.int32)
    step = max(1, CELLS // max(1, n))
    # What lies behind the end equals nothing: -1 there, -2 in the last column of each row of lags.
    ahead, here = np.concatenate((ids, np.full(step + 1, -1, ids.dtype))), np.append(ids, np.array([-2], ids.dtype))
    for first in range(low, high + 1, step):
        lags = np.arange(first, min(first + step, high + 1))
        width = n - first + 1
        mine = here[:width].copy()
        mine[-1] = -2
        shifted = np.lib.stride_tricks.as_strided(ahead[first:], (len(lags), width), ahead.strides * 2)
        at = np.flatnonzero(shifted == mine)
        need = np.maximum(min_words - lags, (min_exponent - 1) * lags)
        least = int(need.min())
        if len(at) < least or not (at[least - 1 :] - at[: len(at) - least + 1] == least - 1).any():
            continue
        breaks = np.flatnonzero(np.diff(at) != 1)
        starts, ends = at[np.concatenate(([0], breaks + 1))], at[np.append(breaks, len(at) - 1)] + 1
        row = starts // width
        keep = ends - starts >= need[row]
        for r, s, m in zip(row[keep], (starts - row * width)[keep], (ends - starts)[keep], strict=True):
            q = int(lags[r])
            if _smallest(ids, int(s), q):
                out.append((int(s), int(m) + q, q))
    return out


def numbered(words: list[bytes], order: np.ndarray | None) -> np.ndarray:
    """A number for each word, in order of first use; order puts other words in their places."""
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))
    return ids if order is None else ids[order]


def dropped_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words a run contains after its first period."""
    turns = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        turns[start + period] += 1
        turns[start + length] -= 1
    return np.cumsum(turns[:n]) > 0


def _output(rows: list[tuple]) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
    doc, n, runs, text = zip(*rows, strict=True) if rows else ((),) * 4
    listed = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in x] for x in runs]
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(listed, kind), pa.array(text, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])


def _collapsed(doc, text, rewrite: Rewrite | None, found: Callable) -> tuple:
    """A row of FOUND; found(ids) gives the runs."""
    words = text.split() if text else []
    order = rewrite(doc, len(words)) if rewrite else None
    runs = sorted(found(words, order), key=lambda r: (r[0], r[2]))
    if order is not None:
        words = [words[j] for j in order]
    gone = dropped_words(len(words), runs)
    kept = [w for w, x in zip(words, gone, strict=True) if not x] if gone.any() else words
    return doc, len(words), runs, b" ".join(kept)


def collapse_runs(docs: DataFrame, *, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT, rewrite: Rewrite | None = None, long_bytes: int = LONG_BYTES) -> DataFrame:
    """Per row of docs: doc_id, n_words, runs (start, length, period; by start, then period) and collapsed, the text without repetitions.

    A run is a maximal stretch of blank words (unchanged) with smallest period q and
    at least max(min_words, min_exponent * q) words. Of each run the first q words
    stay; the words that stay are joined by one space. rewrite(doc_id, n_words) may
    give, for each place, the place of the word that is to stand there.

    Null and empty texts have no words and no runs. Runs may overlap; a word that any
    run drops is dropped. Two runs of one start differ in period. Each row is judged
    by itself, so repeated rows and doc_ids (null too) give a row each. Texts of any
    length are compared whole. An empty table gives an empty result; other columns
    are ignored, whatever their names.
    """
    bounds = {"min_words": min_words, "min_exponent": min_exponent}

    def whole(batches):
        for batch in batches:
            found = lambda words, order: lag_runs(numbered(words, order), 1, len(words), **bounds) if len(words) >= min_words else []
            yield _output([_collapsed(doc, text, rewrite, found) for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True)])

    def ranges(batches):
        for batch in batches:
            rows: list[tuple] = []
            for key, doc, mark, part, parts, text in zip(*(batch.column(c).to_pylist() for c in ("id", "doc_id", "mark", "part", "parts")), texts(batch), strict=True):
                words = text.split()
                last = len(words) // min_exponent
                ids = numbered(words, rewrite(doc, len(words)) if rewrite else None)
                rows += [(key, mark, *r) for r in lag_runs(ids, 1 + last * part // parts, last * (part + 1) // parts, **bounds)]
            columns = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "mark", "start", "length", "period"])

    def met(batches):
        for batch in batches:
            rows = zip(batch.column("doc_id").to_pylist(), texts(batch), batch.column("runs").to_pylist(), strict=True)
            yield _output([_collapsed(doc, text, rewrite, lambda words, order, r=runs: [(x["start"], x["length"], x["period"]) for x in r or []]) for doc, text, runs in rows])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    done = rows.where(size <= long_bytes).mapInArrow(whole, FOUND)
    # Rows alike in doc_id and text are one here, and meet their runs by both; a null doc_id has an id of its own.
    longer = rows.where(size > long_bytes).select("*", F.xxhash64(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0))).alias("id"), F.xxhash64("text").alias("mark"))
    parts = F.ceil(F.pow(F.octet_length("text") / long_bytes, 2)).cast("int")
    dealt = longer.withColumn("parts", parts).select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt = dealt.select("id", "doc_id", "mark", "part", "parts", "text").repartition("id", "mark", "part")
    found = dealt.mapInArrow(ranges, "id long, mark long, start long, length long, period long")
    found = found.groupBy("id", "mark").agg(F.collect_set(F.struct("start", "length", "period")).alias("runs"))
    return done.unionByName(longer.join(found, ["id", "mark"], "left").select("doc_id", "text", "runs").mapInArrow(met, FOUND))


def planted(doc: int | None, n: int) -> np.ndarray | None:
    """The query's rewriting: of the documents whose crc32 leaves 0 when divided by 10, the words from a on repeat those from a to a + p."""
    if doc is None or not n:
        return None
    h = zlib.crc32(str(doc).encode())
    if h % 10:
        return None
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def op11_periodic_runs(spark, sf_dir):
    found = collapse_runs(table(spark, sf_dir, "documents"), rewrite=planted)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.array_join(lines, "").alias("listed"), "collapsed")
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return found.select(
        "doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.col("listed").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: Pairs of equal words by lag, their stretches as islands, and of those the ones that no smaller period covers.
OP11_SQL = r"""WITH d AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
  h AS (SELECT *, len(ws) AS n, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda b: [ascii(b)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda c, e: xor(xor(c, e) >> 1, CASE WHEN xor(c, e) & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)), 4294967295::BIGINT) AS h FROM d),
  a AS (SELECT *, CASE WHEN n > 0 THEN (h // 10) % n ELSE 0 END AS a FROM h), p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
  t AS (SELECT row, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: ws[CASE WHEN i < a THEN i + 1 ELSE a + (i - a) % p + 1 END]) ELSE ws END AS ws FROM p),
  w AS (SELECT row, n, unnest(ws) AS w, unnest(range(n)) AS i FROM t),
  e AS (SELECT x.row, y.i - x.i AS q, x.i FROM w x JOIN w y ON x.row = y.row AND x.w = y.w AND y.i > x.i AND y.i - x.i <= x.n // 2),
  s AS (SELECT row, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS island FROM e) GROUP BY row, q, island HAVING count(*) >= greatest(12 - q, q)),
  r AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.row = s.row AND o.q < s.q AND o.start <= s.start AND o.start + o.length >= s.start + s.length)),
  g AS (SELECT row, count(*) AS n_runs, min((-length, start, q)) AS best, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS listed, list(start + q) AS lows, list(start + length) AS highs FROM r GROUP BY row),
  k AS (SELECT t.row, coalesce(string_agg(ws[i], ' ' ORDER BY i), '') AS kept FROM (SELECT row, ws, unnest(range(1, n + 1)) AS i FROM t) t LEFT JOIN g ON g.row = t.row WHERE g.row IS NULL OR NOT list_bool_or(list_transform(range(1, len(lows) + 1), lambda j: i - 1 >= lows[j] AND i - 1 < highs[j])) GROUP BY t.row)
  SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best[2] AS start, -best[1] AS length, best[3] AS period, (1000 * -best[1]) // best[3] AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
  FROM t LEFT JOIN g ON g.row = t.row LEFT JOIN k ON k.row = t.row"""
