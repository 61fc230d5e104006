"""The operators in DataFrame operations against brute force, with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from riskweave.llm.components import components
from riskweave.llm.decontaminate import exact_phrases, find_contamination, indexed, near_phrases
from riskweave.llm.fair_mix import mix_to_targets
from riskweave.llm.license_scan import scan_licenses, scan_spans
from riskweave.llm.line_templates import drop_template_lines
from riskweave.llm.url_filter import filter_urls

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EXTRA = "row long, words string, key string, h string, p int, size string, target string"


def words(text):
    return WORD.findall((text or "").translate(UP))


def documents(spark, rows, tmp_path, name="docs"):
    """Rows (doc_id, text, source) as a table with columns that clash with names used inside."""
    full = [(d, t, s, "en", len(t or ""), 1, "w", "k", "h", 2, "s", "t") for d, t, s in rows]
    df = spark.createDataFrame(full, f"doc_id long, text string, source string, lang string, n_chars long, {EXTRA}")
    df.repartition(3).write.mode("overwrite").parquet(str(tmp_path / name))
    return spark.read.parquet(str(tmp_path / name))


LONG = "the cat sat on the mat and then it ran off over seven green hills to see what lay beyond them all today"
ODD = [(1, None, None), (2, "", "a"), (3, "MIT License. Ærø ÉTÉ", "a"), (3, "MIT License. Ærø ÉTÉ", "a"), (None, "Under the Apache License, or the GNU General Public License", "b"), (5, " \n\t ", "b"), (6, LONG + " " + LONG.upper(), "c"), (7, "word " * 30_000 + LONG, "c"), (8, "mit license mit license", "c")]


def test_license_scan(spark, tmp_path):
    got = scan_licenses(documents(spark, ODD, tmp_path)).collect()
    assert len(got) == len(ODD)
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    expected = []
    for d, t, _ in ODD:
        w = words(t)
        at = sorted((i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        expected.append((d, len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))))
    key = lambda x: repr(x)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=key) == sorted(expected, key=key)
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)


def test_license_spans_bear_edits(spark, tmp_path):
    text = "blah Permission is hereby granted, free of charge, to any kind person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction. blah"
    got = scan_licenses(documents(spark, [(1, text, "a"), (2, "permission is granted to leave", "a")], tmp_path)).collect()
    assert {r.doc_id: r.labels for r in got} == {1: "mit-text", 2: ""}


def test_license_spans_are_verified(spark, tmp_path):
    whole = "licensed under the apache license version 2 0"
    texts = [
        "under the apache license x " * 4,  # one gram of the template, over and over
        "version 2 0 apache license version licensed under the",  # all words, out of order
        f"{whole} and {whole}",
        "licensed under the apache license of the version 2 0",
        "x " * 20_000 + whole,
        "under the apache license " * 5_000,
    ]
    docs = documents(spark, [(i, t, "a") for i, t in enumerate(texts)], tmp_path)
    got = {r.doc_id: r for r in scan_licenses(docs).collect()}
    assert [got[i].labels for i in range(6)] == ["apache", "apache", "apache,apache-2.0", "apache", "apache,apache-2.0", "apache"]
    assert [got[i].n_base for i in range(6)] == [4, 1, 2, 1, 1, 5_000]
    spans = [(r.first, r.last, r.share) for r in scan_spans(docs).where("doc_id = 2 and label = 'apache-2.0'").collect()]
    assert sorted(spans) == [(0, 7, 1.0), (9, 16, 1.0)]


def brute_hits(docs, items, n=10):
    out = []
    for d, t, _ in docs:
        w, hit, found = words(t), set(), set()
        for i, text in items:
            b = words(text)
            m = min(n, len(b))
            windows = {tuple(b[s : s + m]) for s in range(max(1, len(b) - n + 1))} if b else set()
            for p in range(len(w) - m + 1):
                if m and tuple(w[p : p + m]) in windows:
                    hit.update(range(p, p + m))
                    found.add(str(i))
        out.append((d, len(w), len(hit), ",".join(sorted(found))))
    return sorted(out, key=repr)


def test_decontamination(spark, tmp_path):
    items = [(1, LONG), (2, "Seven green HILLS"), (3, None), (4, ""), (10, LONG.replace("mat", "hat")), (10, LONG.replace("mat", "hat"))]
    docs = ODD + [(9, "so seven green hills; seven green hills", "a"), (10, "x " + LONG.replace("cat", "dog") + " y", "a"), (11, LONG.replace("cat", "k").replace("then", "l").replace("hills", "m").replace("beyond", "n"), "a")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = documents(spark, docs, tmp_path)
    got = [(r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in find_contamination(table, bench).collect()]
    assert sorted(got, key=repr) == brute_hits(docs, items)
    index, anchors, n = indexed(table, bench)
    exact = {(r.doc_id, r.item_id) for r in exact_phrases(index, anchors, n).collect()}
    near = {(r.doc_id, r.item_id) for r in near_phrases(index, anchors, n).collect()}
    assert exact < near and (11, 1) in near - exact
    # Near copies that lack the rarest word of a window, or a word that no document has.
    odd = spark.createDataFrame([(20, "zzz " + " ".join(LONG.split()[:9])), (21, " ".join(LONG.split()[5:15]).replace("seven", "nine")), (22, "the")], "item_id long, text string")
    close = {r.doc_id: (set(r["items"]), set(r["near_items"])) for r in find_contamination(table, odd).where("doc_id in (6, 10, 11)").collect()}
    assert close[6][0] == {"22"} and close[6][1] >= {"20", "22"} and "21" in close[10][1]
    empty = find_contamination(table, bench.where("false"))
    assert empty.where("n_hit > 0").count() == 0 and empty.count() == len(docs)
    assert find_contamination(table.where("false"), bench).count() == 0


def test_fair_mix(spark, tmp_path):
    rows = [(i, "w " * (1 + i * 7 % 40), f"s{i % 5}") for i in range(400)] + [(1000 + i, "w " * 20, None) for i in range(300)] + [(7, "w " * 50, "s2"), (None, "w w", "s0"), (2000, None, "s1"), (2001, "", "only-empty")]
    got = mix_to_targets(documents(spark, rows, tmp_path)).collect()
    assert len(got) == len(rows)
    sizes, taken, targets = defaultdict(int), defaultdict(int), {}
    named = {(d, len((t or "").split())): s for d, t, s in rows}
    for r in got:
        s = named[(r.doc_id, r["size"])]
        sizes[s] += r["size"]
        taken[s] += r.taken
        targets[s] = r.target
        assert 0 <= r.taken <= 2 * r["size"] and r.source_size == sum(len((t or "").split()) for d, t, x in rows if x == s)
    assert sum(targets.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    for s in sizes:
        assert targets[s] <= 2 * sizes[s] + 1e-6 and abs(taken[s] - targets[s]) <= 60
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    level = max(targets[s] / weight[s] for s in sizes if sizes[s])
    assert all(targets[s] == pytest.approx(min(2 * sizes[s], level * weight[s])) for s in sizes)
    again = mix_to_targets(documents(spark, rows[::-1], tmp_path, "again")).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert mix_to_targets(documents(spark, rows, tmp_path).where("false")).count() == 0


def own(i, k, n=12):
    return " ".join(hashlib.md5(f"{i}{k}{j}".encode()).hexdigest()[:5].translate(str.maketrans("0123456789", "ghijklmnop")) for j in range(n))


def test_line_templates(spark, tmp_path):
    rows = [(i, "\n".join([own(i, "a"), f"Posted on 2024-{i} by the team", own(i, "b"), f"Share this page with {own(i, 'n')[:5]} now"]), "a") for i in range(40)]
    rows += [(100 + i, own("same", "a") + "\n" + own("same", "b"), "a") for i in range(30)]  # copies: nothing else bears witness against their lines
    rows += [(500, None, "a"), (501, "", "a"), (502, "\n\n", "a"), (None, rows[3][1], "a"), (0, rows[0][1], "a"), (503, "Posted on 2020-1 by the team", "a")]
    out = drop_template_lines(documents(spark, rows, tmp_path))
    got = sorted(((r.doc_id, r.text, r.lines_dropped) for r in out.collect()), key=repr)
    expected = []
    for d, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not x.startswith(("Posted on", "Share this"))]
        expected.append((d, t if t is None else "\n".join(kept), len(lines) - len(kept)))
    assert got == sorted(expected, key=repr)
    assert out.columns[:-1] == documents(spark, rows, tmp_path, "more").columns
    assert out.where("n_chars <> length(text)").where("lines_dropped > 0").count() == 0
    whole = drop_template_lines(documents(spark, rows, tmp_path), leave_bare=False).where("doc_id = 503").first()
    assert (whole.text, whole.lines_dropped) == (rows[-1][1], 0)
    assert drop_template_lines(documents(spark, rows, tmp_path).where("false")).count() == 0


def test_line_templates_count_documents_and_keep_copies(spark, tmp_path):
    fixed = ["Home", "Tel 555 123 4567", "Page 3 of 10", "Posted on 2024-05-01", "About us and all of our long list of friends and partners in many countries of the world"]
    rows = [(1, "\n".join([own(1, "z")] + [f"One line of many with {own(i, 'v')[:5]} inside" for i in range(22)]), "a")]  # 22 variants in one document
    # Pages that are mostly boilerplate, one-token lines, lines of fields and short templates.
    rows += [(100 + i, "\n".join([*fixed[:2], f"Page {i} of {i + 3}", f"Posted on 2024-{i}", fixed[4], own(i, "own", 10)]), "a") for i in range(30)]
    # Near copies: each differs from the rest in one line of eight; they hold boilerplate too.
    rows += [(200 + i, "\n".join([own("copy", str(j)) if j != i % 8 else own(i, "edit") for j in range(8)] + ["Home"]), "a") for i in range(40)]
    got = {r.doc_id: (r.text, r.lines_dropped) for r in drop_template_lines(documents(spark, rows, tmp_path)).collect()}
    assert got[1] == (rows[0][1], 0)
    assert all(got[100 + i] == (own(i, "own", 10), 5) for i in range(30))
    assert all(got[d] == (t.removesuffix("\nHome"), 1) for d, t, _ in rows if d >= 200)


def test_url_filter(spark):
    pages = [
        (1, "https://WWW.example.com/en/x", None), (2, "http://m.example.com/en/x?q=1", ""), (3, "https://a.org/p.html?utm_source=f", '<link rel="canonical" href="http://sub.net/fr/z">'), (4, "HTTPS://A.org:443/p.html?utm_source=f#top", None), (12, "http://www.a.org/p/#top", None), (5, None, None), (6, "no scheme", "x"),
        (7, "http://b.org", '<meta http-equiv="refresh" content="0; url=http://b.com/">'), (8, "http://b.org/q", None), (9, "http://sub.net/fr/z", None), (9, "http://sub.net/fr/z", None), (10, "http://c.org/1", '<link rel="canonical" href="http://d.net/es/">'), (11, "http://e.org/", None),
    ]
    table = spark.createDataFrame([(*p, 1, "k", "n") for p in pages], "page_id long, url string, html string, key int, node string, component string")
    redirects = spark.createDataFrame([("http://e.org/", "http://c.org/1"), ("http://b.org/q", "http://b.org"), (None, "http://x.net/fr/")], "source string, target string")
    got = {(r.page_id): (r.host, r.path, r.rule, r.verdict) for r in filter_urls(table, redirects).collect()}
    assert got[1] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[2] == ("m.example.com", "/en/x", "example.com/en/", "block")
    assert got[3] == ("a.org", "/p.html", None, "block") and got[4][3] == "block"  # alias of a blocked page, and the same address
    assert got[12][3] == "allow"  # no link ties it to its sibling
    assert got[5] == ("", "", None, "allow") and got[6] == ("", "", None, "allow")
    assert got[7][3] == "allow" and got[8][3] == "allow" and got[9][2:] == ("net/fr/", "block")
    assert got[10][3] == "block" and got[11][3] == "block"  # over a redirect, a canonical link and a rule
    assert filter_urls(table, redirects).count() == len(pages)
    assert filter_urls(table.where("false")).count() == 0


def test_url_filter_follows_links_however_written(spark):
    from html.parser import HTMLParser
    from urllib.parse import urljoin

    class Links(HTMLParser):
        def handle_starttag(self, tag, attrs):
            a = {k: v or "" for k, v in reversed(attrs)}
            if tag == "link" and "canonical" in a.get("rel", "").lower().split():
                self.found.append(a["href"])
            if tag == "meta" and a.get("http-equiv", "").lower() == "refresh":
                self.found.append(re.sub("^[^=]*=", "", a["content"]).strip(" '\""))

    long = "x" * 50_000
    tags = [
        "<link href='http://sub.net/fr/a' rel='canonical'>", '<LINK HREF=http://sub.net/fr/a REL=canonical>', '<link rel="alternate canonical" title="a > b" href="http://sub.net/fr/a"/>', "<meta content=\"0;url='http://sub.net/fr/a'\" http-equiv=\"refresh\">",
        '<meta http-equiv=refresh content="5; URL = http://sub.net/fr/a">', '<link rel=canonical href="//sub.net/fr/a">', '<link rel="canonical" href="http://d.org/1"><link rel="canonical" href="http://sub.net/fr/a">', f'<link title="{long}" rel="canonical" href="http://sub.net/fr/a">',
        '<link rel="stylesheet" href="http://sub.net/fr/a">', '<link rel="next" title="rel=canonical" href="http://sub.net/fr/a">', '<meta name="x" content="0;url=http://sub.net/fr/a">', '<link rel="canonical" href="mailto:a">', '<link rel="canonical" href="">',
    ]
    pages = [(i, f"http://p{i}.org/x", t) for i, t in enumerate(tags)]
    relative = ["/fr/x", "x", "../fr/x", "./../../../fr/x", "?q=1&amp;r=2", "y/../x#top"]
    pages += [(100 + i, f"http://r{i}.info/a/b/c.html", f'<link href="{t}" rel="canonical">') for i, t in enumerate(relative)]
    rules = [("net", "/fr/", "block")]
    for i, url, html in pages[len(tags) :]:
        parser = Links()
        parser.found = []
        parser.feed(html)
        rest = urljoin(url, parser.found[0]).partition("://")[2].partition("#")[0]
        pages.append((200 + i, f"http://{rest}", None))
    got = {r.page_id: r for r in filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), rules=rules).collect()}
    for i, _, html in pages[: len(tags)]:
        parser = Links()
        parser.found = []
        parser.feed(html)
        blocked = any(urljoin(f"http://p{i}.org/x", x) == "http://sub.net/fr/a" for x in parser.found)
        assert blocked == (i < 8) and got[i].verdict == ("block" if blocked else "allow"), html
    for i in range(len(relative)):
        assert got[100 + i].component == got[300 + i].component, relative[i]


def test_url_filter_equals_its_sql_on_linked_pages(spark, tmp_path):
    import random

    import duckdb

    from riskweave.llm.url_filter import OP8_SQL, op8_url_filter

    rng = random.Random(3)
    hosts = ["a.org", "b.info", "sub.net", "x.com", "www.example.com", "m.example.com", "c.net:80"]
    url = lambda: f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}/{rng.choice(['en', 'es', 'fr', 'q'])}/{rng.randrange(40)}{rng.choice(['', '?k=1', '#f'])}"
    forms = ['<link rel="canonical" href="{}">', "<LINK HREF='{}' REL=\"alternate canonical\" />", '<meta content="0; URL={}" http-equiv=Refresh>', '<link rel=canonical href={}>', '<link rel="stylesheet" href="{}">', "<meta http-equiv=\"refresh\" content=\"3;url='{}'\">"]
    rows = []
    for i in range(400):
        target = url() if rng.random() < 0.6 else rng.choice(["/fr/1", "../es/2", "?z=1&amp;y=2", "./3", "//sub.net/fr/5", "#top", "mailto:x", ""])
        rows.append((i, url(), "<html>" + "".join(rng.choice(forms).format(target) for _ in range(rng.choice((0, 0, 1, 2)))) + "<p>rel=canonical</p>"))
    rows += [(900, None, '<link rel="canonical" href="http://sub.net/fr/">'), (901, "no scheme", '<link rel="canonical" href="/x">'), (902, "http://a.org", None), (903, "http://A.org/", ""), (903, "http://A.org/", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = sorted(repr(tuple(r)) for r in op8_url_filter(spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict").collect())
    want = [tuple(r) for r in con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({OP8_SQL})").fetchall()]
    assert got == sorted(map(repr, want))
    assert sum(v == "block" and r is None for _, _, _, r, v in want) > 5


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7), (None, 3)] + [(200, 300 + i) for i in range(50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200, **{300 + i: 200 for i in range(50)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
    assert components(spark.createDataFrame([("b", "a"), ("b", "c")], "u string, v string")).select(F.min("component")).first()[0] == "a"
