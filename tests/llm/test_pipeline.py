"""The pipeline against its stages done by hand, and the registry."""

from pathlib import Path

import duckdb
import pytest

WHERE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(WHERE).exists(), reason="no test tables")


def test_pipeline(spark):
    import corpus_pipeline as P
    from riskweave.llm.minhash import near_duplicates

    docs = spark.read.parquet(f"{WHERE}/documents.parquet")
    columns, kept = docs.columns, docs
    sizes = [docs.count()]
    for name, stage in P.STAGES[:-1]:
        kept = P.materialise(stage(spark, kept, WHERE), "test-stage")
        assert kept.columns == columns, name
        sizes.append(kept.count())
    assert sizes[1] < sizes[0] and sizes[2] == sizes[1] and sizes[3] <= sizes[2] and sizes[4] <= sizes[3]
    bad = {r.doc_id for r in spark.read.parquet(f"{WHERE}/labels.parquet").where("quality = 0").collect()}
    left = {r.doc_id for r in kept.select("doc_id").collect()}
    assert len(bad & left) <= 0.2 * len(bad)
    assert near_duplicates(kept).where("not kept").count() == 0
    final = P.run(spark, WHERE)
    total = kept.selectExpr("sum(size(filter(split(text, '[ \\t\\n\\f\\r\\x0b]+'), x -> x <> '')))").first()[0]
    assert set(columns) < set(final.columns) and {r.doc_id for r in final.select("doc_id").collect()} <= left
    assert final.agg({"taken": "sum"}).first()[0] <= 1.5 * total


def brute_run(spark, P, where, docs, con):
    """The stages by other means: plain Python for texts, SQL for line dedup and mixing; the classifier's scores are taken as given."""
    from test_free import brute_components
    from test_native import brute_hits

    from riskweave.llm.fair_mix import OP4_SQL
    from riskweave.llm.line_templates import OP7_SQL
    from riskweave.llm.pu_quality import fit_quality, score_texts

    model = fit_quality(docs, spark.read.parquet(f"{where}/labels.parquet"))
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    rows = [r for r in rows if score_texts(model, [None if r[1] is None else r[1].encode()])[0] >= 0.7]
    yield rows
    import pandas as pd

    con.register("documents", pd.DataFrame([(i, r[1]) for i, r in enumerate(rows)], columns=["doc_id", "text"]))
    sql = OP7_SQL.replace("length(CASE WHEN n IS NULL THEN d.text ELSE rest END)::BIGINT AS kept_chars, md5(CASE WHEN n IS NULL THEN d.text ELSE rest END) AS text_md5", "CASE WHEN n IS NULL OR replace(rest, chr(10), '') = '' THEN d.text ELSE rest END AS text")
    texts = {r[0]: r[2] for r in con.execute(sql).fetchall()}
    rows = [(r[0], texts[i], r[2]) for i, r in enumerate(rows)]
    yield rows
    component = {d: c for d, _, c in brute_components([r[:2] for r in rows], 5)}
    rows = [r for r in rows if r[0] is None or component[r[0]] == r[0]]
    yield rows
    items = [tuple(r) for r in spark.read.parquet(f"{where}/benchmark.parquet").collect()]
    rows = [r for r in rows if brute_hits([r], items)[0][2] == 0]
    yield rows
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"}))
    taken = {(r[0], r[1]): r[4] for r in con.execute(OP4_SQL).fetchall()}
    yield [(d, t, s, taken[d, len((t or "").encode().split())]) for d, t, s in rows if taken[d, len((t or "").encode().split())]]


def test_pipeline_against_brute_force(spark, tmp_path):
    """A fixture with null, repeated and empty rows, copies, boilerplate, junk, passages and columns of clashing names."""
    import random

    import corpus_pipeline as P

    rng = random.Random(11)
    vocabulary = [f"{a}{b}{c}" for a in ("th", "er", "on", "st", "re", "qu") for b in ("a", "e", "i", "ou") for c in ("n", "r", "l", "nd", "sh")]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)).capitalize() + "."
    items = [line(14) for _ in range(5)]
    rows = []
    for i in range(150):
        lines = [line(rng.randrange(8, 16)) for _ in range(rng.randrange(3, 8))]
        if i % 3 == 0:
            lines.insert(rng.randrange(len(lines)), "Share this page with all of your friends")
        if i % 17 == 0:
            lines.append(items[i % 5])
        rows.append((i, "\n".join(lines)))
    rows += [(200 + i, rows[i * 7][1]) for i in range(10)] + [(300 + i, rows[i * 5 + 1][1].replace(".", ";", 1)) for i in range(10)]
    rows += [(400 + i, "\n".join(" ".join(f"{rng.choice(vocabulary)}{rng.choice(['$$$', '***', '###'])}" for _ in range(12)) for _ in range(4))) for i in range(60)]
    rows += [(None, items[0] + " " + line(20)), (None, line(60)), (500, None), (501, ""), (502, "Share this page with all of your friends"), (503, line(30)), (503, line(30) + " " + items[1]), (504, line(40)), (504, line(40)), (505, "long " + line(20_000))]
    full = [(d, t, "en", f"s{(d or 0) % 4}" if d != 504 else None, len(t or ""), "x", 7, 8, 9, 10, 11) for d, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, gone string, copies int, taken int, lines_dropped int, t_id int, score int"
    spark.createDataFrame(full, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(d, int(not 400 <= d < 500), 0) for d, _ in rows if d is not None and d < 460 and d % 2], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    expected = list(brute_run(spark, P, tmp_path, docs, duckdb.connect()))
    sizes = []
    for (name, stage), want in zip(P.STAGES, expected, strict=True):
        kept = P.materialise(stage(spark, kept, str(tmp_path)), "test-stage")
        if name != "mixing":
            assert kept.columns == docs.columns, name
            got = [tuple(r) for r in kept.select("doc_id", "text", "source").collect()]
        else:
            got = [tuple(r) for r in kept.select("doc_id", "text", "source", "taken").collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want)), name
        sizes.append(len(got))
    assert 150 < sizes[0] < len(rows) and sizes[0] == sizes[1] > sizes[2] > sizes[3] > sizes[4] > 100
    assert sorted(map(repr, P.run(spark, str(tmp_path)).collect())) == sorted(map(repr, kept.collect()))
    for name, stage in P.STAGES:
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0, name


def test_registry(spark):
    from riskweave.llm.registry import ORACLES, QUERIES

    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in QUERIES)] == [] and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", ["op2_license_scan", "op3_decontaminate", "op4_fair_mix", "op7_line_templates", "op8_url_filter", "op9_quality_rules", "op10_minhash"])
def test_query_equals_its_sql(spark, name):
    from riskweave.llm.registry import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{WHERE}/{t}.parquet'")
    df = QUERIES[name](spark, WHERE)
    got = df.collect()
    cursor = con.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    plain = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    assert sorted(repr([plain(r[c]) for c in columns]) for r in got) == sorted(repr([plain(v) for v in r]) for r in cursor.fetchall())


def test_alike_rows_take_what_the_mix_gives_them(spark):
    """Rows alike in doc_id, source and size, of which not all have as many copies: together they keep to the budget."""
    import corpus_pipeline as P
    from riskweave.llm.fair_mix import mix_to_targets

    rows = [(None if i % 2 else 7, f"same size {i} words " + "x " * 6, "s" if i % 3 else None) for i in range(300)] + [(9, "one other text", "s"), (9, "one other text", "s"), (10, "", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    given = mix_to_targets(docs, keep=("source",)).agg({"taken": "sum", "copies": "sum"}).first()
    got = P.mix(spark, docs, WHERE)
    assert got.columns == ["doc_id", "text", "source", "copies", "taken"]
    sums = got.agg({"taken": "sum", "copies": "sum"}).first()
    assert (sums["sum(taken)"], sums["sum(copies)"]) == (given["sum(taken)"], given["sum(copies)"])
    assert got.count() <= len(rows) and got.where("copies > 2 or taken <> copies * size(split(trim(text), ' +'))").count() == 0
    again = P.mix(spark, docs, WHERE)
    assert again.exceptAll(got).count() == 0 and got.where("text = ''").count() == 0
