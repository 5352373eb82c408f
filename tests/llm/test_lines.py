from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from loadcast.llm import lines, pipeline
from tests.llm.data import documents, texts


def brute(rows, ratio, least):
    pages, held = Counter(), Counter()
    for _, t, s in rows:
        s = s or ""
        pages[s] += 1
        held.update((s, x) for x in set((t or "").split("\n")) if x.strip(" "))
    junk = {k for k, n in held.items() if n >= least and n / pages[k[0]] > ratio}
    return [(i, None if t is None else "\n".join(x for x in t.split("\n") if (s or "", x) not in junk), s) for i, t, s in rows]


def test_documents_lose_lines_that_their_site_repeats(spark):
    rows = texts()
    rows += [(200 + k, f"Same head\nown line {k}\n\nSame foot\nSame head", f"src{k % 2}") for k in range(12)]
    rows += [(300 + k, "Same head\nonly here", "src9") for k in range(2)] + [(400, "Same head", "src0"), (None, "a\n\n", None)]
    docs = documents(spark, rows)
    out = lines.clean_documents(docs, ratio=0.1, least_pages=3)
    assert out.columns == docs.columns
    got = out.collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.text, r.source) for r in got), key=key) == sorted(brute(rows, 0.1, 3), key=key)
    assert all(r.n_chars == len(r.text or "") and r.p == 3 + 0 * r.u or r.s == "s" for r in got)
    assert lines.clean_documents(documents(spark, [])).count() == 0


def test_copies_keep_their_lines_in_the_pipeline(spark):
    copy = "First line of the copy\n\nSecond line of it"
    rows = [(k, copy, "src0") for k in range(30)]                                       # a third of the source
    rows += [(100 + k, f"Same head\nown line {k}", "src0") for k in range(60)] + [(200, "Same head\n" + copy, "src0")]
    got = {r.doc_id: r.text for r in pipeline.drop_lines(spark, documents(spark, rows), "").collect()}
    want = {i: t.removeprefix("Same head\n") for i, t, _ in rows}
    assert got == want
    by_row = {r.doc_id: r.text for r in lines.clean_documents(documents(spark, rows), ratio=0.1).collect()}
    assert by_row[0] == "" and by_row[100] == "own line 0"


def test_pipeline_drops_lines_above_its_own_ratio(spark):
    rows = [(k, ("Rare head\n" if k < 5 else "") + ("Four times\n" if 5 <= k < 9 else "") + f"own line {k}", "src0") for k in range(200)]
    got = {r.doc_id: r.text for r in pipeline.drop_lines(spark, documents(spark, rows), "").collect()}
    assert got == {i: t.removeprefix("Rare head\n") for i, t, _ in rows}


def test_html_lines_and_hosts(spark):
    html = ("<!DOCTYPE html><html><head><style>p{}</style><script>var t='</p>';</script><title>T</title></head><body><!-- x -->"
            "<p>One <b>two</b><br>three<li> four </li></body>")
    row = spark.createDataFrame([(html, "HTTPS://u:p@Www.Ex.org:80/a?b"), (None, None), ("", "no url")], "html string, url string")
    got = row.select(lines.html_lines("html").alias("l"), lines.host_of("url").alias("h")).collect()
    assert [(r.l, r.h) for r in got] == [(["T", "One two", "three", "four"], "www.ex.org"), ([], ""), ([], "")]


def test_pages_with_clashing_columns(spark):
    pages = spark.createDataFrame([(k, "h", ["x", f"y{k}"], 1, 2, "j") for k in range(6)], "id long, site string, lines array<string>, held long, pages long, drops string")
    got = lines.drop_boilerplate(pages, F.col("site"), F.col("lines"), 0.5, 2).collect()
    assert all(r["__lines"] == [f"y{r.id}"] and r["__n_lines"] == 2 and r["__n_dropped"] == 1 and r.drops == "j" for r in got)


def op9(spark, rows, folder):
    spark.createDataFrame([(*r, "h", 1, 2) for r in rows], "page_id long, url string, html string, host string, n_lines long, held long").write.parquet(f"{folder}/pages.parquet")
    return {(r.page_id, r.host): r for r in lines.op9_site_line_dedup(spark, str(folder)).collect()}


def test_the_ratio_decides_on_small_and_large_hosts(spark, tmp_path):
    """A line on 3 of 20 pages goes, one on 3 of 40 stays; one on both pages of a host of two goes."""
    rows = [(k, "http://a.org/x", f"<p>{'Menu' if k < 3 else 'x'}</p><p>own {k}</p>") for k in range(20)]
    rows += [(100 + k, "http://b.org", f"{'<p>Menu' if k < 3 else ''}<p>own {k}") for k in range(40)]
    rows += [(200 + k, "http://c.org", f"<p>Menu<p>own {k}") for k in range(2)] + [(300, "http://d.org", "<p>Menu<p>Menu")]
    got = op9(spark, rows, tmp_path)
    assert got[0, "a.org"].text == "own 0" and got[5, "a.org"].n_dropped == 1
    assert got[100, "b.org"].text == "Menu\nown 0" and got[100, "b.org"].n_dropped == 0
    assert got[200, "c.org"].text == "own 0" and got[300, "d.org"].text == "Menu\nMenu"


def test_awkward_pages(spark, tmp_path):
    rows = [(1, None, None), (2, None, "<p>no host</p>"), (3, "not a url", ""), (None, "http://a.org", "<p>x"), (4, "http://a.org", None)]
    rows += [(5, "http://b.org", "<p>twice")] * 2 + [(6, "http://b.org", "<p>" + "long " * 20000)] + [(7 + k, "http://b.org", f"<p>o{k}") for k in range(8)]
    got = op9(spark, rows, tmp_path)
    assert len(got) == len(rows) - 1
    assert got[1, ""].n_lines == 0 and got[1, ""].text == "" and got[2, ""].text == "no host" and got[None, "a.org"].text == "x"
    assert got[5, "b.org"].n_dropped == 1  # repeated rows are pages: 2 of 11 hold it
    assert got[6, "b.org"].text == ("long " * 20000).strip()


def test_empty_pages(spark, tmp_path):
    assert op9(spark, [], tmp_path) == {}
