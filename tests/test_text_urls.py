import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsloom.functions import html as H
from newsloom.functions import text as X
from newsloom.functions import urls as U

few = settings(max_examples=100, deadline=None, suppress_health_check=list(HealthCheck))


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


@pytest.mark.parametrize(
    ("text", "keywords", "want"),
    [("Object storage pricing", ["rag"], False), ("Now available in Tokyo", ["ai"], False), ("生成AIが変えた開発", ["ai"], True), ("writing c++ bindings", ["c++"], True), ("abc", ["a.c"], False), ("x", [], False), ("x", [""], False), ("Agentic flows", ["agent"], True)],
)
def test_keyword(spark, text, keywords, want):
    assert one(spark, X.matches_keyword(F.col("t"), keywords), t=text) is want


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [("https://example.com/a", "http://www.example.com/a/", True), ("https://e.com/a?utm_source=x&b=1&a=2", "https://e.com/a?a=2&b=1#top", True), ("https://e.com/item?id=1", "https://e.com/item?id=2", False), ("https://e.com/Post", "https://e.com/post", False), ("https://E.com:443/x", "https://e.com/x", True), ("Not A Url", "not a url", True), ("https://e.com/", "https://e.com", True)],
)
def test_url_key(spark, a, b, same):
    assert (one(spark, U.url_key(F.col("u")), u=a) == one(spark, U.url_key(F.col("u")), u=b)) is same


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://e.com/a/../b/./c", "e.com/b/c"), ("https://e.com/a/b/..", "e.com/a"), ("https://e.com/../../x", "e.com/x"), ("https://e.com/a/%2E%2e/b", "e.com/b"),
        ("https://e.com/a b/é", "e.com/a%20b/%C3%A9"), ("https://e.com/a%20b", "e.com/a%20b"), ("https://e.com\\a\\b?c=\\", "e.com/a/b?c=%5C"), ("  https://e.com/a\n ", "e.com/a"),
        ("https://e.com/?q=a%20b&p", "e.com?p=&q=a+b"), ("https://e.com/?q=a+b&%75tm_x=1", "e.com?q=a+b"), ("https://e.com/x?a=100%&a=(1)~", "e.com/x?a=100%25&a=%281%29%7E"),
        ("https://e.com/x?", "e.com/x"), ("https://e.com/x?&&", "e.com/x"), ("https://e.com/x?a=b=c", "e.com/x?a=b%3Dc"), ("https://a b.com/X", "https://a b.com/x"), ("https://e.com//a//", "e.com//a/"),
    ],
)
def test_url_key_spellings(spark, url, want):
    assert one(spark, U.url_key(F.col("u")), u=url) == want
    assert spark.createDataFrame([(url,)], "u string").select(U.url_key(F.col("u"))).first()[0] == want  # not folded


def test_url_key_of_null_and_empty(spark):
    rows = spark.createDataFrame([(None,), ("",)], "u string").select(U.url_key(F.col("u")).alias("k"), U.fetch_url(F.col("u")).alias("f")).collect()
    assert [tuple(r) for r in rows] == [(None, None), ("", "")]


def test_fetch_url_keeps_scheme_and_other_parameters(spark):
    assert one(spark, U.fetch_url(F.col("u")), u="http://e.com/a?ref=1&fbclid=2&x=3#f") == "http://e.com/a?fbclid=2&x=3"
    assert one(spark, U.fetch_url(F.col("u")), u="No Url") == "No Url"


def test_spellings_are_nine_at_most(spark):
    got = one(spark, U.spellings(F.col("u")), u="https://www.e.com/a/?utm_x=1")
    assert len(got) == len(set(got)) == 9 and "http://e.com/a" in got and "https://www.e.com/a/" in got


def test_crowd_bonus(spark):
    hn, lob = (one(spark, X.crowd_bonus(F.lit(v), F.lit(s))) for v, s in ((250.0, 1.0), (50.0, 5.0)))
    assert hn == lob == 43
    assert one(spark, X.crowd_bonus(F.lit(1e7), F.lit(1.0))) == 60 and one(spark, X.crowd_bonus(F.lit(0.0), F.lit(1.0))) == 0


def test_substring_and_boundary_semantics_differ(spark):
    assert one(spark, X.keyword_bonus(F.col("t"), [(["rag"], 10)]), t="storage") == 10
    assert one(spark, X.matches_keyword(F.col("t"), ["rag"]), t="storage") is False


def test_small_functions(spark):
    assert one(spark, X.js_trim(F.col("t")), t="　\t a b \n") == "a b"
    assert one(spark, X.chunks(F.col("t"), 3000), t="x" * 9500) == ["x" * 3000] * 3 + ["x" * 500]
    assert one(spark, X.chunks(F.col("t"), 5), t="") == []
    assert one(spark, X.first_link(F.col("t")), t="*<https://e.com/x|T>*") == "https://e.com/x"
    assert one(spark, X.first_link(F.col("t")), t="none") is None
    assert one(spark, X.star_count(F.col("t")), t="1,371 stars today") == 1371
    assert one(spark, X.crowd_number(F.col("t")), t="many") is None and one(spark, X.crowd_number(F.col("t")), t="10") == 10
    assert one(spark, X.strip_fence(F.col("t")), t='```json\n{"a":1}\n```') == '{"a":1}'
    assert one(spark, X.rail_width(F.lit(10))) == 3 and one(spark, X.rail_width(F.lit(200))) == 100
    assert one(spark, X.fold(F.col("t")), t="ＡＩ") == "ai"
    assert str(one(spark, X.parse_date(F.col("t")), t="Mon, 10 Aug 2026 01:02:03 GMT")) == "2026-08-10 01:02:03"
    assert one(spark, X.parse_date(F.col("t")), t="soon") is None
    assert one(spark, X.paragraphs(F.col("t")), t="a\n\n b \n \nc") == ["a", "b", "c"]
    assert one(spark, X.month_label(F.col("t")), t="2026-08") == "2026年8月"
    assert one(spark, X.page_id(F.col("t")), t="https://x/" + "a" * 32 + "?v=1") == "a" * 32


@pytest.mark.parametrize(("text", "want"), [("a" * 5, True), ("a" * 4, False), (" \u3000a  b\n\ufeff", False), ("\n a   b ", True), ("é" * 4 + "😀", True), ("", False), ("   " * 9, False), ("abcd" + " " * 10_000, False), ("ab" + " " * 10_000 + "c", True)])
def test_trimmed_at_least(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(X.trimmed_at_least(F.col("t"), 5), F.length(X.js_trim(F.col("t"))) >= 5).first()
    assert got[0] is got[1] is want


def test_pages_of_any_nesting():
    import time

    deep = 100_000
    began = time.time()
    assert H.article_paragraphs("<article>" + "<b>" * deep + "<p>A paragraph of the article.</p>" + "</i>" * deep + "</article>") == ["A paragraph of the article."]
    assert H.article_paragraphs("<article>" + "<ul><li>" * deep + "far inside") == ["far inside"] * 1200
    assert H.article_paragraphs("<article>" + "<p><span>" * deep + "</article>") == []
    assert H.article_paragraphs("<div>" * deep + "<article>" + "</div>" * 3 + "<p>0123456789</p>") == []
    assert H.listing_links("<div>" * deep + '<a href="/news/a"><h3>A title of ten</h3></a>') == [{"href": "/news/a", "title": "A title of ten", "description": "", "date": None}]
    assert time.time() - began < 30


def test_nesting_as_before():
    """Paragraphs end where a block begins, items where the next one does; end tags without a beginning don't matter."""
    page = "<main><p>first one here<p>second <b>one</i> here</b><ul><li>item number one<li>item number two<ul><li>inner item one</ul></ul><div><p>in a div, third</div>tail<nav><p>not this one here</p></nav><h2>a heading, too</h2></main>"
    assert H.article_paragraphs(page) == ["first one here", "second one here", "item number one", "item number twoinner item one", "inner item one", "in a div, third", "a heading, too"]
    n = H.Tree(page).root
    assert list(n.texts({"li"})) == [x.text() for x in n.walk() if x.tag == "li"]


@few
@given(st.lists(st.sampled_from(["<p>", "</p>", "<li>", "</li>", "<ul>", "</ul>", "<div>", "</div>", "<b>", "</b>", "</i>", "some text ", "<br>", "<article>", "</article>"]), max_size=40))
def test_texts_are_those_of_the_nodes(parts):
    root = H.Tree("".join(parts)).root
    assert list(root.texts(H.BLOCK)) == [n.text() for n in root.walk() if n.tag in H.BLOCK]
    assert "".join(p for p in parts if not p.startswith("<")) == root.text()


# Host names and their ASCII forms.
HOSTS = {
    "münchen.de": "xn--mnchen-3ya.de", "bücher.example": "xn--bcher-kva.example", "日本語.jp": "xn--wgv71a119e.jp", "пример.испытание": "xn--e1afmkfd.xn--80akhbyknj4f", "例え。テスト": "xn--r8jz45g.xn--zckzah",
    "faß.de": "xn--fa-hia.de", "www.Ａｂｃ．com": "www.abc.com", "ü.com:8080": "xn--tda.com:8080", "a.b": "a.b", "": "", "xn--tda.com": "xn--tda.com", "ليهمابتكلموشعربي؟": "xn--egbpdaj6bu4bxfgehfvwxn",
}


def test_hosts_in_ascii(spark):
    from newsloom.functions.hosts import ascii_host

    df = spark.createDataFrame([(h,) for h in HOSTS] + [(None,)], "h string")
    got = {r.h: r.a for r in df.select("h", ascii_host(F.col("h")).alias("a")).collect()}
    assert got == HOSTS | {None: None}


def test_labels_like_the_standard_codec(spark):
    import random

    from newsloom.functions.hosts import ascii_host

    rng = random.Random(5)
    pools = ["abcxyz019-", "äöüéñçøå", "абвгджя", "日本語例中文字", "あいうえおん", "한국어", "😀🚀𠀋"]
    labels = sorted({"".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(1, 24))) for _ in range(250)})
    df = spark.createDataFrame([(x,) for x in labels], "h string")
    got = {r.h: r.a for r in df.select("h", ascii_host(F.col("h")).alias("a")).collect()}
    assert got == {x: x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in labels}


def test_both_spellings_have_one_key(spark):
    pairs = [("https://www.bücher.example/a/?utm_source=x", "http://xn--bcher-kva.example/a"), ("https://日本語.jp:443/", "https://xn--wgv71a119e.jp"), ("https://m%C3%BCnchen.de/x", "https://MÜNCHEN.de/x")]
    for a, b in pairs:
        assert one(spark, U.url_key(F.col("u")), u=a) == one(spark, U.url_key(F.col("u")), u=b)
    assert one(spark, U.fetch_url(F.col("u")), u="https://日本語.jp/a") == "https://xn--wgv71a119e.jp/a"
    assert one(spark, U.host_in(F.col("u"), ["xn--bcher-kva.example"]), u="https://news.bücher.example/") is True
