"""Names that only may say what an element is, forms around a page and lone short articles."""

from cloudspark.llm import wrappers


def test_nothing_else_is_dropped():
    cases = {
        '<form id="aspnet"><div><p>story of the day</p></div></form>': "story of the day",
        '<form><div><nav>menu</nav><article><p>body</p></article></div></form>': "body",
        '<article><p>body</p><form><label>Name of the reader</label></form></article>': "body",
        '<article><p>body</p><p class="ad-hoc-note">note</p><div class="promotion-of-staff"><p>more</p></div></article>': "body\n\nnote\n\nmore",
        '<article><p>body</p><div class="ad-box">buy</div><div class="adUnit">buy</div><div class="social-share-links">s</div></article>': "body",
        "<article><p>short</p></article><div><p>a longer block that no name marks</p></div>": "short",
        "<article><p>one</p></article><article><p>two</p></article><div><p>the story that is longer than both</p></div>": "one\n\ntwo\n\nthe story that is longer than both",
    }
    assert {h: wrappers.extract(h) for h in cases} == cases


def test_the_wrapper_decides_on_doubtful_names(spark):
    """One name, on a host where its text is a template's and on one where it is the article's."""
    page = '<body><article><h1>{0}</h1><p>{1}</p><div class="promo-of-week"><p>{2}</p></div></article></body>'
    rows, want = [], {}
    for i in range(6):
        story = " ".join([f"story {i}"] * 30)
        rows.append((i, f"https://same.example/{i}", page.format(f"T{i}", story, "Our shop sells things")))
        rows.append((10 + i, f"https://own.example/{i}", page.format(f"T{i}", story, f"Person {i} moved up")))
        want |= {i: f"T{i}\n\n{story}", 10 + i: f"T{i}\n\n{story}\n\nPerson {i} moved up"}
    # with neither tags nor names that mark anything
    bare = "<body><div><a href=a>Home</a></div><div><h2>{0}</h2><p>{1}</p></div><div><p><a href=x>See {0} x</a></p><p><a href=y>See {0} y</a></p></div><div>All rights</div></body>"
    for i in range(5):
        story = " ".join([f"plain {i}"] * 20)
        rows.append((20 + i, f"https://bare.example/{i}", bare.format(f"Head {i}", story)))
        want[20 + i] = f"Head {i}\n\n{story}"
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in wrappers.digest(table).collect()} == want
