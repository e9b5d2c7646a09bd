"""Plain text of pages against the SQL, where elements, comments and entities stand at odd places."""

import duckdb
import pyarrow as pa
import pytest

from docsluice.llm import warc

PAGES = [
    "a  ", "<p>x</p> \u0085",  # a line separator at the end is no end of the text
    "a<script>b</script >c<script>d", "<style><script></style>x</script>y", "a<!--b--->c<!--d", "a<!-->b-->c", "<title>a<title>b</title>c", "<title>never closed <p>x",
    "<!-- <script> -->a</script>b", "a &nbsp;<b> </b>&nbsp;\n c&amp;lt;&#39;&quot;", "< &nbsp; >a<<b>", "&nbsp;\n", "", "<script " * 50 + "<!--" * 50,
]


@pytest.mark.parametrize("html", PAGES)
def test_as_the_sql(spark, html):
    pages = pa.table({"page_id": [1], "url": ["http://x/"], "html": [html]})
    con = duckdb.connect()
    con.register("pages", pages)
    got = warc.page_derivatives(spark.createDataFrame([(1, "http://x/", html)], "page_id bigint, url string, html string"))
    want = con.execute(warc.sql() + " ORDER BY warc_type").fetchall()
    assert [tuple(r) for r in got.orderBy("warc_type").collect()] == want
