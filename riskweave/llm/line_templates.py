"""Line dedup by a log-template tree of fixed depth.

Lines are tokens between blanks; tokens with a digit are variable fields. The
tree leads a line by its number of tokens and its first DEPTH tokens to a leaf.
In a leaf, a token that a share of its lines has at its position is a constant,
and any other is generalised to a field, which gives the line's template. Lines
whose template, or which themselves, recur in min_docs documents are candidates.
Whether a candidate is boilerplate or merely copied along with its document is
told by its witnesses: documents with at least min_own of their characters in
lines that are no candidates. What recurs in min_docs witnesses is dropped
wherever it stands; copies of a document lose its boilerplate and keep the rest.

Scale: documents are read twice. The first pass writes their lines without
shuffle; lines are counted by hash, combined before the shuffle, and only lines
of recurring leaves are shaped, as distinct lines with counts, so a line in a
third of all documents is one row. Joins by line may be skewed and are plain
equi-joins, which adaptive execution splits; the tables of recurring leaves and
lines are broadcast while their counted rows are within BROADCAST_ROWS. What is
collected into one row is the candidate lines of one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import broadcast_if, materialise, table

BROADCAST_ROWS = 500_000
DEPTH = 3
FIELD = "<*>"


def masked(text: Column) -> Column:
    """text with every token that holds a digit replaced by a field."""
    return F.when(text.rlike("[0-9]"), F.regexp_replace(text, r"(?<![^ \n])[^ \n0-9]*+[0-9][^ \n]*+", FIELD)).otherwise(text)


def line_table(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Lines with anything but spaces: doc_id, body (hash of the text), total (its length), at, chars, leaf, line (masked), lh, rh (hashes of the masked and the raw line)."""
    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id"), F.xxhash64("text").alias("body"), F.length("text").alias("total"), F.split("text", "\n").alias("raw"), F.split(masked(F.col("text")), "\n").alias("lines"))
    at = texts.select("doc_id", "body", "total", "raw", "lines", F.explode(F.sequence(F.lit(0), F.size("lines") - 1)).alias("at"))
    lines = at.select("doc_id", "body", "total", "at", F.get("lines", F.col("at")).alias("line"), F.get("raw", F.col("at")).alias("raw"))
    bare = F.length(F.replace("line", F.lit(" "), F.lit("")))
    lines = lines.withColumn("bare", bare).where(F.col("bare") > 0)
    leaf = F.xxhash64(F.length("line") - F.col("bare") + 1, F.substring_index("line", " ", depth))
    return lines.select("doc_id", "body", "total", "at", F.length("raw").alias("chars"), leaf.alias("leaf"), F.xxhash64("line").alias("lh"), F.xxhash64("raw").alias("rh"), "line")


def templates(lines: DataFrame, counts: DataFrame, *, min_docs: int, leaf_share: float, min_constant: float) -> DataFrame:
    """Lines that may recur: leaf, rh, exact (the line itself recurs), tkey (hash of its template, if that may recur), template.

    counts: leaf, lh, rh, docs. Templates are counted here by (document, line)
    pairs, which is never less than by documents.
    """
    leaves = materialise(counts.groupBy("leaf").agg(F.sum("docs").alias("in_leaf")).where(F.col("in_leaf") >= min_docs).select(F.col("leaf").alias("l"), "in_leaf"), "leaves")
    n = leaves.count()
    small = lambda df: broadcast_if(df, n, BROADCAST_ROWS)
    spread = materialise(counts.join(small(leaves), F.col("leaf") == F.col("l")).select("leaf", "lh", "rh", "docs", "in_leaf"), "leaf-counts")
    seen = lines.select("leaf", "lh", "line").join(small(leaves), F.col("leaf") == F.col("l")).groupBy("leaf", "lh", "line").agg(F.lit(1).alias("one"))
    docs = spread.groupBy(F.col("leaf").alias("c_leaf"), F.col("lh").alias("c_lh")).agg(F.sum("docs").alias("docs"), F.max("in_leaf").alias("in_leaf"))
    kept = materialise(seen.join(docs, (F.col("leaf") == F.col("c_leaf")) & (F.col("lh") == F.col("c_lh"))).select("leaf", "lh", "line", "docs", "in_leaf"), "leaf-lines")

    tokens = kept.select("leaf", "lh", "docs", "in_leaf", F.posexplode(F.split("line", " ")).alias("p", "token"))
    often = (F.col("seen") >= min_docs) & (F.col("seen") >= F.col("all") * leaf_share) & (F.col("token") != FIELD)
    constant = tokens.groupBy("leaf", "p", "token").agg(F.sum("docs").alias("seen"), F.max("in_leaf").alias("all")).where(often).select(F.col("leaf").alias("k_leaf"), F.col("p").alias("k_p"), F.col("token").alias("k_token"))
    known = tokens.join(constant, (F.col("leaf") == F.col("k_leaf")) & (F.col("p") == F.col("k_p")) & (F.col("token") == F.col("k_token")), "left")
    part = F.struct("p", F.coalesce("k_token", F.lit(FIELD)).alias("part"))
    # Masked tokens are fields of the template and count neither way.
    share = F.avg(F.when(F.col("token") != FIELD, F.col("k_token").isNotNull().cast("double")))
    shaped = known.groupBy("leaf", "lh").agg(F.max("docs").alias("docs"), F.array_join(F.array_sort(F.collect_list(part))["part"], " ").alias("template"), share.alias("constant"))
    shaped = materialise(shaped.where(F.col("constant") >= min_constant).withColumn("tkey", F.xxhash64("leaf", "template")), "line-shapes")
    wide = shaped.groupBy(F.col("tkey").alias("w_tkey")).agg(F.sum("docs").alias("n")).where(F.col("n") >= min_docs)
    shaped = shaped.join(wide, F.col("tkey") == F.col("w_tkey")).select(F.col("leaf").alias("s_leaf"), F.col("lh").alias("s_lh"), "tkey", "template")
    both = spread.join(shaped, (F.col("leaf") == F.col("s_leaf")) & (F.col("lh") == F.col("s_lh")), "left").withColumn("exact", F.col("docs") >= min_docs)
    return materialise(both.where(F.col("exact") | F.col("tkey").isNotNull()).select("leaf", "rh", "exact", "tkey", "template"), "recurring")


def candidate_lines(lines: DataFrame, *, min_docs: int, leaf_share: float, min_constant: float) -> DataFrame:
    """doc_id, body, total, spots (at, chars and key of each candidate line): one row for each document that has any."""
    once = lines.select("doc_id", "body", "leaf", "lh", "rh").distinct()
    counts = materialise(once.groupBy("leaf", "lh", "rh").agg(F.count("*").alias("docs")), "line-counts")
    found = templates(lines, counts, min_docs=min_docs, leaf_share=leaf_share, min_constant=min_constant)
    possible = broadcast_if(found.select(F.col("leaf").alias("f_leaf"), F.col("rh").alias("f_rh"), "exact", "tkey"), found.count(), BROADCAST_ROWS)
    met = lines.select("doc_id", "body", "total", "at", "chars", "leaf", "rh").join(possible, (F.col("leaf") == F.col("f_leaf")) & (F.col("rh") == F.col("f_rh")))
    met = materialise(met.select("doc_id", "body", "total", "at", "chars", "rh", "exact", "tkey").distinct(), "line-hits")
    true = met.where(F.col("tkey").isNotNull()).select("doc_id", "body", "tkey").distinct().groupBy(F.col("tkey").alias("t")).agg(F.count("*").alias("docs"))
    true = materialise(true.where(F.col("docs") >= min_docs).select("t"), "template-counts")
    keyed = met.join(broadcast_if(true, true.count(), BROADCAST_ROWS), F.col("tkey") == F.col("t"), "left").withColumn("key", F.coalesce("t", F.when(F.col("exact"), F.col("rh"))))
    spots = F.collect_list(F.struct("at", "chars", "key"))
    return keyed.where(F.col("key").isNotNull()).groupBy("doc_id", "body").agg(F.max("total").alias("total"), spots.alias("spots"))


def drop_template_lines(docs: DataFrame, *, min_docs: int = 20, leaf_share: float = 0.1, min_constant: float = 0.8, min_own: float = 0.25, leave_bare: bool = True) -> DataFrame:
    """docs with the lines of recurring templates taken out of text.

    All columns of docs stay, whatever their names; text is replaced, n_chars (if
    there) follows it, and lines_dropped (long) is added. Where nothing but
    boilerplate is in a text, an empty text is left, or with leave_bare=False the
    text as it is.

    min_docs: distinct documents (doc_id and text) that a line or template must
    stand in. Null text stays null; empty texts and lines of nothing but spaces
    are left alone. Repeated rows count as one document and are treated alike; a
    null doc_id is an id like others. Equal lines (ties) all go or all stay. Texts
    of any length are treated whole. An empty table gives an empty one.
    """
    lines = materialise(line_table(docs.select("doc_id", "text")), "lines")
    held = materialise(candidate_lines(lines, min_docs=min_docs, leaf_share=leaf_share, min_constant=min_constant), "candidates")
    own = F.col("total") - F.aggregate("spots", F.lit(0), lambda s, x: s + x["chars"])
    witnessed = held.where(own >= F.col("total") * min_own).select(F.explode(F.array_distinct("spots.key")).alias("k")).groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("k")
    witnessed = materialise(witnessed, "boilerplate")
    gone = held.select("doc_id", "body", F.explode("spots").alias("x")).join(broadcast_if(witnessed, witnessed.count(), BROADCAST_ROWS), F.col("x.key") == F.col("k"))
    gone = gone.groupBy(F.col("doc_id").alias("g_id"), F.col("body").alias("g_body")).agg(F.collect_list("x.at").alias("g_at"))

    # Columns are numbered, so that no name of docs meets one used here; the text travels as lines.
    at = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    cut = docs.select(*[F.split(docs[name], "\n").alias(c) if name == "text" else docs[name].alias(c) for name, c in at.items()], F.xxhash64(docs["text"]).alias("d_body"))
    lines_of = F.col(at["text"])
    joined = cut.join(gone, F.col(at["doc_id"]).eqNullSafe(F.col("g_id")) & (F.col("d_body") == F.col("g_body")) & lines_of.isNotNull(), "left")
    rest = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines_of) - 1), F.col("g_at")), lambda i: F.get(lines_of, i)), "\n")
    drops = F.col("g_at").isNotNull()
    if not leave_bare:
        drops = drops & F.coalesce(F.replace(rest, F.lit("\n"), F.lit("")) != "", F.lit(False))
    joined = joined.withColumn("d_text", F.when(drops, rest).otherwise(F.array_join(lines_of, "\n"))).withColumn("d_n", F.when(drops, F.size("g_at")).otherwise(F.lit(0)).cast("long"))
    columns = []
    for name, c in at.items():
        column = F.col("d_text") if name == "text" else F.length("d_text").cast(docs.schema[name].dataType) if name == "n_chars" else F.col(c)
        columns.append(column.alias(name))
    return joined.select(*columns, F.col("d_n").alias("lines_dropped"))


def op7_line_templates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = drop_template_lines(docs)
    return out.select("doc_id", "lines_dropped", F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("text_md5"))


OP7_SQL = r"""
WITH docs AS (SELECT doc_id, text FROM documents),
texts AS (SELECT doc_id, text, row_number() OVER () AS d, string_split(text, chr(10)) AS raw FROM (SELECT DISTINCT doc_id, text FROM docs WHERE text IS NOT NULL)),
places AS (SELECT d, raw[i + 1] AS raw, i FROM (SELECT d, raw, unnest(range(len(raw))) AS i FROM texts)),
lines AS (
  SELECT d, i, raw, list_transform(string_split(raw, ' '), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS tokens FROM places WHERE replace(raw, ' ', '') <> ''
), leafed AS (SELECT *, (len(tokens), array_to_string(tokens[1:3], ' ')) AS leaf, array_to_string(tokens, ' ') AS line FROM lines),
counts AS (SELECT leaf, line, any_value(tokens) AS tokens, count(*) AS docs FROM (SELECT DISTINCT d, leaf, line, raw, tokens FROM leafed) GROUP BY leaf, line),
leaves AS (SELECT leaf, sum(docs) AS in_leaf FROM counts GROUP BY leaf HAVING sum(docs) >= 20),
parts AS (SELECT leaf, line, docs, in_leaf, p, tokens[p + 1] AS token FROM (SELECT *, unnest(range(len(tokens))) AS p FROM counts JOIN leaves USING (leaf))),
constants AS (SELECT leaf, p, token FROM parts GROUP BY leaf, p, token, in_leaf HAVING sum(docs) >= 20 AND sum(docs) >= in_leaf * 0.1::DOUBLE AND token <> '<*>'),
shapes AS (
  SELECT x.leaf, x.line, string_agg(coalesce(c.token, '<*>'), ' ' ORDER BY x.p) AS template
  FROM parts x LEFT JOIN constants c ON x.leaf = c.leaf AND x.p = c.p AND x.token = c.token
  GROUP BY x.leaf, x.line HAVING avg(CASE WHEN x.token = '<*>' THEN NULL WHEN c.token IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) >= 0.8
), places_of AS (SELECT l.d, l.i, l.raw, l.leaf, s.template FROM leafed l LEFT JOIN shapes s ON l.leaf = s.leaf AND l.line = s.line),
exact AS (SELECT raw FROM places_of GROUP BY raw HAVING count(DISTINCT d) >= 20),
shaped AS (SELECT leaf, template FROM places_of WHERE template IS NOT NULL GROUP BY leaf, template HAVING count(DISTINCT d) >= 20),
candidates AS (
  SELECT p.d, p.i, length(p.raw) AS chars, CASE WHEN s.template IS NOT NULL THEN (p.leaf::VARCHAR, s.template) ELSE ('line', p.raw) END AS key
  FROM places_of p LEFT JOIN shaped s ON p.leaf = s.leaf AND p.template = s.template LEFT JOIN exact e ON p.raw = e.raw WHERE s.template IS NOT NULL OR e.raw IS NOT NULL
), witnesses AS (
  SELECT d FROM (SELECT d, sum(chars) AS chars FROM candidates GROUP BY d) JOIN texts USING (d) WHERE length(text) - chars >= length(text) * 0.25::DOUBLE
), boilerplate AS (SELECT key FROM candidates SEMI JOIN witnesses USING (d) GROUP BY key HAVING count(DISTINCT d) >= 20),
gone AS (SELECT d, list(i) AS spots FROM candidates SEMI JOIN boilerplate USING (key) GROUP BY d),
made AS (
  SELECT doc_id, text, len(spots) AS n, array_to_string(list_transform(list_filter(range(len(raw)), lambda i: NOT list_contains(spots, i)), lambda i: raw[i + 1]), chr(10)) AS rest FROM texts JOIN gone USING (d)
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS lines_dropped, length(CASE WHEN n IS NULL THEN d.text ELSE rest END)::BIGINT AS kept_chars, md5(CASE WHEN n IS NULL THEN d.text ELSE rest END) AS text_md5
FROM docs d LEFT JOIN made m ON d.doc_id IS NOT DISTINCT FROM m.doc_id AND d.text = m.text
"""
