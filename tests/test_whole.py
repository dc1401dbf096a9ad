"""Texts after a cut that queries once made."""

import duckdb

from feedloom.plans import queries


def test_calendars_of_whole_texts(spark, tmp_path):
    texts = {1: "short", 2: "word " * 3000 + "end", 3: "one; two,\r\nthree " * 100 + "é日" * 300}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {int(r.source_key): r.description for r in queries.QUERIES["ics_unfold"](spark, str(tmp_path)).collect()}
    assert got == {i: t.replace(";", " ").replace(",", " ").replace("\r\n", " ").strip() for i, t in texts.items()}


def test_excerpts_of_pages_are_those_of_the_sql(spark, tmp_path):
    pages = ["<h1>and&amp;&amp;&amp the&amp</h1><p>x</p>", "<p>&copy &quot;a&quot; &copyx; &amp;lt; &#39;&middot;</p>", "<p>&am&amp;p; a&amp", "<p>" + "a" * 219 + "é more words", "<p>" + "🙂" * 100, "<p>a" + "é" * 105 + " " + "é" * 60, None, ""]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    want = duckdb.connect().execute(f"WITH pages AS (SELECT * FROM '{tmp_path}/pages.parquet/*.parquet') SELECT * FROM ({queries.ORACLE['excerpts_html']})").fetchall()
    assert sorted(tuple(r) for r in queries.QUERIES["excerpts_html"](spark, str(tmp_path)).collect()) == sorted(want)
    assert dict(want)[0] == "and&&&amp the&amp"


def test_texts_leave_python_by_slices_of_a_batch():
    import pyarrow as pa

    from feedloom.functions import text

    seen, batch = [], pa.array(["a&amp;b", None, ""] * 400)
    got = text.by_slices(lambda v: seen.append(v) or v.upper(), iter([batch, batch.slice(0, 0)]))
    first = next(got)
    assert len(first) == text.ROWS and len(seen) <= text.ROWS
    assert pa.chunked_array([first, *got]).to_pylist() == [v and v.upper() for v in batch.to_pylist()]
