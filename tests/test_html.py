"""Any text is read as HTML: what looks like broken markup raises nothing and takes no text beyond itself with it."""

import pytest

from siltstone.queries import entities
from siltstone.sources.web import text_of_html

CASES = {
    "<p>a <![\n>=_}? b</p>": "a =_}? b", "<p>a <![x[ b> c</p>": "a c", "<p>a <![5 b</p><p>c</p>": "a\nc", "<p>a <![ b": "a <![ b", "<p>a <!": "a <!",
    "<p>a<![if word]>b<![endif]>c</p>": "abc", "<p>a<![CDATA[ x > y ]]>b</p>": "ab", "<p>a<!-- x -->b</p>": "ab", "<p>&#0065;&#65;&amp;</p>": "AA&",
    "<p>&#" + "0" * 5000 + "65;b</p>": "Ab", "<p>a&#" + "9" * 5000 + ";b</p>": "a\ufffdb",
}


@pytest.mark.parametrize("html", CASES)
def test_text(html):
    assert text_of_html(html) == CASES[html]


def test_query(spark, tmp_path):
    rows = [(1, "T", "before <![\n>=_}?| after"), (2, None, "a <![ b"), (3, "T", None)]
    spark.createDataFrame(rows, "doc_id long, title string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.plain for r in entities.QUERIES["s08_html_to_text"](spark, str(tmp_path)).collect()}
    assert got == {1: "T\nbefore =_}?| after", 2: "a", 3: None}
