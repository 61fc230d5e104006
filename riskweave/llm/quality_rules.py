"""Quality rules with thresholds that adapt to language and source.

Each text is measured. The measures of the texts that pass the base rules go into
mergeable quantile sketches, by language and source: counts of logarithmic bins
(relative error ERROR), which add up over partitions, and over groups: to each
group's sketch its language's is added with the weight of a fixed number of texts. No
cutoff is fixed: a text is out where a measure lies beyond the
upper quartile of its group by more than `reach` spreads (or, for word length,
below the lower quartile by as much). The spread is the group's interquartile
range, but not less than what chance does to a text of its size: a rate q over n
units (words; lines for repetition) scatters by sqrt((q + 1/n) / n).

Scale: texts are read once, in Arrow batches; the sketch is a grouped count
combined before the shuffle, with at most some hundred bins a group and measure,
so a source with a third of all rows is as many rows as a small one. The join of
quartiles is small against large and left to Spark.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from riskweave.llm.common import materialise, table
from riskweave.llm.wordhash import texts

ERROR = 0.01
GAMMA = math.log((1 + ERROR) / (1 - ERROR))
SYMBOLS = b"#*$%&|<>"
#: Measure: what it is a rate over, and whether there is a lower fence.
MEASURES = {"symbol_share": ("n_words", False), "dup_line_share": ("n_lines", False), "repeat_share": ("n_lines", False), "word_length": ("n_words", True), "upper_share": ("n_words", False)}


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three that stand twice or more in the list."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) == n:
        return 0
    pairs = at[:-1] * len(ids) + at[1:]
    if len(ids) < 2_000_000:
        windows = pairs[:-1] * len(ids) + at[2:]
    else:
        windows = np.unique(pairs, return_inverse=True)[1][:-1] * len(ids) + at[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(n, np.bool_)
    twice = np.concatenate((order[1:][same], order[:-1][same]))
    for j in range(3):
        hit[twice + j] = True
    return int(hit.sum())


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each text."""

    def run(batches):
        for batch in batches:
            rows = []
            for text in texts(batch):
                text = text or b""
                words = text.split()
                inside = b"".join(words)
                points = len(inside) if inside.isascii() else len(inside.decode())
                seen: set[bytes] = set()
                dup = lines = 0
                for line in text.split(b"\n"):
                    if line and line.strip():
                        lines += 1
                        dup += line in seen
                        seen.add(line)
                upper = 0 if inside.islower() else len(inside) - len(inside.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
                rows.append((len(words), points, len(inside) - len(inside.translate(None, SYMBOLS)), dup, lines, repeated_words(words), upper))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "lang", "source")] + [pa.array(list(c), pa.int64()) for c in columns], ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_upper"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text")
    return docs.mapInArrow(run, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long, n_upper long")


def _measures() -> dict[str, Column]:
    part = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return {
        "symbol_share": part("n_symbols", "word_chars"),
        "dup_line_share": part("n_dup_lines", "n_lines"),
        "repeat_share": part("n_repeat_words", "n_words"),
        "word_length": part("word_chars", "n_words"),
        "upper_share": part("n_upper", "word_chars"),
    }


def base_failure(min_words: int = 50) -> Column:
    """Fewer than min_words words, or over half of them in repeated windows."""
    return (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def sketch_measures(measured: DataFrame) -> DataFrame:
    """Quantile sketches: counts by lang, source, measure and bin; bin null holds zeros."""
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("measure"), value.alias("value")) for name, value in _measures().items()]))
    bins = F.when(F.col("m.value") > 0, F.ceil(F.log("m.value") / F.lit(GAMMA)))
    return measured.select("lang", "source", pairs.alias("m")).groupBy("lang", "source", F.col("m.measure").alias("measure"), bins.alias("bin")).agg(F.count("*").alias("n"))


def _exact(*parts: Column | str) -> Column:
    """Product of whole numbers that may be too large for a long."""
    out = None
    for part in parts:
        value = (F.col(part) if isinstance(part, str) else part).cast("decimal(38,0)")
        out = value if out is None else (out * value).cast("decimal(38,0)")
    return out


def blended(sketches: DataFrame, prior_rows: int) -> DataFrame:
    """lang, source, measure, bin, weight: each group's sketch with that of its language, which counts as prior_rows rows however many it has, and has that of the whole corpus blended in likewise.

    Weights are whole numbers, in units of their group.
    """
    prior, keys = F.lit(prior_rows), ["lang", "measure"]
    group = sketches.groupBy("lang", "source", "measure", "bin").agg(F.sum("n").alias("n"))
    lang = sketches.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
    whole = sketches.groupBy("measure", "bin").agg(F.sum("n").alias("n"))
    of_whole = whole.groupBy("measure").agg(F.sum("n").alias("rows_w"))
    of_lang = lang.groupBy(*keys).agg(F.sum("n").alias("rows_l")).join(of_whole, "measure")
    # What a language weighs in all: (its rows + prior) times those of the corpus.
    of_lang = of_lang.select(F.col("lang").alias("o_lang"), F.col("measure").alias("o_measure"), "rows_w", _exact(F.col("rows_l") + prior, "rows_w").alias("total"))
    same = F.col("lang").eqNullSafe(F.col("o_lang")) & (F.col("measure") == F.col("o_measure"))
    one = lang.join(of_lang, same).select("lang", "measure", "bin", _exact("n", "rows_w").alias("weight"))
    two = of_lang.join(whole, F.col("measure") == F.col("o_measure")).select(F.col("o_lang").alias("lang"), "measure", "bin", _exact("n", prior).alias("weight"))
    base = one.union(two).groupBy(*keys, "bin").agg(F.sum("weight").cast("decimal(38,0)").alias("weight"))
    mine = group.join(of_lang, same).select("lang", "source", "measure", "bin", _exact("n", "total").alias("weight"))
    groups = group.select("lang", "source", "measure").distinct()
    shared = base.select(F.col("lang").alias("o_lang"), F.col("measure").alias("o_measure"), "bin", _exact("weight", prior).alias("weight"))
    shared = groups.join(shared, same).select("lang", "source", "measure", "bin", "weight")
    return mine.union(shared).groupBy("lang", "source", "measure", "bin").agg(F.sum("weight").cast("decimal(38,0)").alias("weight"))


def fences(sketches: DataFrame, *, prior_rows: int = 100) -> DataFrame:
    """f_lang, f_source and, for each measure, the quartiles that its fences are set from.

    They are those of the group's texts together with prior_rows texts spread as those
    of its language are, so the fewer a group has, the more its language speaks for it,
    without a size at which that turns.
    """
    by = W.partitionBy("lang", "source", "measure")
    upto = F.sum("weight").over(by.orderBy(F.col("bin").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0))
    ranked = blended(sketches, prior_rows).select("lang", "source", "measure", "bin", upto.alias("upto"), F.sum("weight").over(by).alias("all"))
    value = F.coalesce(F.lit(2.0) * F.exp(F.col("bin") * F.lit(GAMMA)) / F.lit(math.exp(GAMMA) + 1), F.lit(0.0))
    at = lambda name, k: F.min(F.when((F.col("measure") == name) & (_exact("upto", F.lit(4)) >= _exact("all", F.lit(k))), value))
    quarters = [at(name, k).alias(f"{q}_{name}") for name in MEASURES for q, k in (("q25", 1), ("q75", 3))]
    return ranked.groupBy(F.col("lang").alias("f_lang"), F.col("source").alias("f_source")).agg(*quarters)


def within_fences(reach: float) -> Column:
    """Whether all measures of a text lie within the fences that its group's quartiles and its own size give."""
    inside = F.lit(True)
    for name, value in _measures().items():
        units, lower = MEASURES[name]
        n, low, high = F.greatest(F.col(units), F.lit(1)), F.col(f"q25_{name}"), F.col(f"q75_{name}")
        spread = F.greatest(high - low, F.sqrt((high + F.lit(1.0) / n) / n)) * F.lit(float(reach))
        inside = inside & (value <= high + spread) & ((value >= low - spread) if lower else F.lit(True))
    return inside


def judge_quality(docs: DataFrame, *, min_words: int = 50, reach: float = 4.0, prior_rows: int = 100) -> DataFrame:
    """One row per input row: doc_id, counts, measures, base_failed, kept.

    base_failed: fewer than min_words words, or over half of them in repeated
    windows. kept: not base_failed and all measures within the fences of the
    document's language and source, which those that pass the base rules set, together
    with prior_rows texts spread as those of their language.

    Null and empty texts have no words and fail. Null languages and sources are
    groups of their own. Repeated rows count as often as they stand, and ties
    with a fence are kept. Texts of any length are measured whole. An empty table
    gives an empty result; other columns are ignored, whatever their names.
    """
    measured = materialise(measure(docs), "measures")
    limits = fences(materialise(sketch_measures(measured.where(~base_failure(min_words))), "quantile-sketches"), prior_rows=prior_rows)
    judged = measured.join(limits, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left")
    failed = base_failure(min_words)
    kept = ~failed & F.coalesce(within_fences(reach), F.lit(True))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"), *[v.alias(n) for n, v in _measures().items()])


def op9_quality_rules(spark, sf_dir):
    return judge_quality(table(spark, sf_dir, "documents")).drop(*MEASURES)


def _sql() -> str:
    """The same result in DuckDB: the same bins, counted from measures taken word by word and line by line."""
    value = {"symbol_share": "n_symbols / nullif(word_chars, 0)", "dup_line_share": "n_dup_lines / nullif(n_lines, 0)", "repeat_share": "n_repeat_words / nullif(n_words, 0)", "word_length": "word_chars / nullif(n_words, 0)", "upper_share": "n_upper / nullif(word_chars, 0)"}
    pairs = " UNION ALL ".join(f"SELECT r, lang, source, '{name}' AS measure, coalesce({v}, 0)::DOUBLE AS value, greatest({MEASURES[name][0]}, 1)::DOUBLE AS n, {str(MEASURES[name][1]).lower()} AS lower FROM counted WHERE NOT base_failed" for name, v in value.items())
    return rf"""
WITH read AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), windows AS (
  SELECT r, p, w[p + 1] || ' ' || w[p + 2] || ' ' || w[p + 3] AS g FROM (SELECT r, w, unnest(range(len(w) - 2)) AS p FROM read WHERE len(w) > 2)
), twice AS (
  SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS c FROM windows) WHERE c > 1
), repeated AS (
  SELECT r, count(DISTINCT p + j) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS j) GROUP BY r
), lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM read) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), counted AS (
  SELECT *, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed FROM (
    SELECT r, doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
      len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(text, '[A-Z]'))::BIGINT AS n_upper,
      coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
    FROM read LEFT JOIN lines USING (r) LEFT JOIN repeated USING (r))
), pairs AS ({pairs}),
binned AS (SELECT lang, source, measure, CASE WHEN value > 0 THEN ceil(ln(value) / {GAMMA!r}::DOUBLE) END AS bin FROM pairs),
g AS (SELECT lang, source, measure, bin, count(*)::HUGEINT AS n FROM binned GROUP BY ALL), l AS (SELECT lang, measure, bin, count(*)::HUGEINT AS n FROM binned GROUP BY ALL), w AS (SELECT measure, bin, count(*)::HUGEINT AS n FROM binned GROUP BY ALL),
tw AS (SELECT measure, sum(n)::HUGEINT AS n FROM w GROUP BY ALL), tl AS (SELECT lang, l.measure, max(tw.n) AS rows_w, (sum(l.n) + 100)::HUGEINT * max(tw.n) AS total FROM l JOIN tw USING (measure) GROUP BY ALL),
base AS (SELECT lang, measure, bin, sum(weight)::HUGEINT AS weight FROM (
  SELECT l.lang, l.measure, l.bin, l.n * tl.rows_w AS weight FROM l JOIN tl ON l.lang IS NOT DISTINCT FROM tl.lang AND l.measure = tl.measure UNION ALL SELECT tl.lang, w.measure, w.bin, w.n * 100 FROM tl JOIN w ON w.measure = tl.measure) GROUP BY ALL),
mixed AS (SELECT lang, source, measure, bin, sum(weight)::HUGEINT AS weight FROM (
  SELECT g.lang, g.source, g.measure, g.bin, g.n * tl.total AS weight FROM g JOIN tl ON g.lang IS NOT DISTINCT FROM tl.lang AND g.measure = tl.measure
  UNION ALL SELECT k.lang, k.source, k.measure, base.bin, base.weight * 100 FROM (SELECT DISTINCT lang, source, measure FROM g) k JOIN base ON k.lang IS NOT DISTINCT FROM base.lang AND k.measure = base.measure) GROUP BY ALL),
limits AS (
  SELECT lang, source, measure, min(CASE WHEN upto * 4 >= total THEN v END) AS q25, min(CASE WHEN upto * 4 >= total * 3 THEN v END) AS q75 FROM (
    SELECT *, (sum(weight) OVER (PARTITION BY lang, source, measure ORDER BY bin NULLS FIRST ROWS UNBOUNDED PRECEDING))::HUGEINT AS upto, (sum(weight) OVER (PARTITION BY lang, source, measure))::HUGEINT AS total,
      coalesce(2.0::DOUBLE * exp(bin * {GAMMA!r}::DOUBLE) / {math.exp(GAMMA) + 1!r}::DOUBLE, 0) AS v FROM mixed) GROUP BY ALL
), outside AS (
  SELECT DISTINCT r FROM (
    SELECT r, value, lower, q25, q75, 4 * greatest(q75 - q25, sqrt((q75 + 1 / n) / n)) AS spread
    FROM pairs p JOIN limits f ON p.lang IS NOT DISTINCT FROM f.lang AND p.source IS NOT DISTINCT FROM f.source AND p.measure = f.measure)
  WHERE value > q75 + spread OR (lower AND value < q25 - spread)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND o.r IS NULL AS kept FROM counted c LEFT JOIN outside o ON c.r = o.r
"""


OP9_SQL = _sql()
