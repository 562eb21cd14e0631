"""Elements of raw web pages: no visible text is lost."""

from docloom.operators import structure


def test_html_elements_keep_all_text(spark):
    html = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>bare
<nav><ul><li><a href="/x">one</a><li>two</ul></nav><!-- <p>no</p> --><div class="ad">advert</div><article><h1 id="a>b">Head <b>bold</b></h1><p><b>first</b><p>second
</article><table><tr><td>c1</td><td>c2</td></tr></table><footer>foot &copy; x</footer><p>last 1 < 2"""
    pages = spark.createDataFrame([(1, html), (2, "just text"), (3, "<pre>code</pre>"), (4, ""), (5, None)], "page_id bigint, html string")
    rows = structure.html_elements(pages).orderBy("doc_id", "ord").collect()
    assert [(r["type"], r["text"]) for r in rows if r["doc_id"] == 1] == [
        ("title", "T"), ("paragraph", "bare"), ("list", "one"), ("list", "two"), ("paragraph", "advert"), ("h1", "Head bold"), ("paragraph", "first"),
        ("paragraph", "second"), ("paragraph", "c1"), ("paragraph", "c2"), ("paragraph", "foot &copy; x"), ("paragraph", "last 1 < 2"),
    ]
    assert [(r["doc_id"], r["text"]) for r in rows if r["doc_id"] > 1] == [(2, "just text"), (3, "code")]
