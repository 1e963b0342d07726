import pytest

from fleetlark.llm.html import extract_text, render


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("  plain \n text ", "plain text"), ("<p>a<p>b", "a\n\nb"), ("<div>a</div><div>b</div>", "a\nb"), ("a<br>b", "a\nb"),
    ("<ul><li>x<li>y<ol start=3><li>z</ol></ul>", "- x\n- y\n  3. z"), ("<script>var a='</p>'</script>x<style>y</style>", "x"),
    ("<head><title>t</title></head><body>b", "b"), ("<p hidden>a</p><p style='display: none'>b</p><p>c", "c"), ("a<!-- <p>b -->c", "ac"),
    ("<table><tr><th>n<th>no<tr><td>long<td>1</table>", "n     no\nlong  1"), ("<pre>a\n  b</pre>", "a\n  b"), ("1 < 2 &amp; 3 &lt; 4", "1 < 2 & 3 < 4"),
    ("<p>cut off <b", "cut off"), ("</p></li>x</table>", "x"), ("a <b> b</b> c", "a b c"), ("<script>never closed", ""), ("<td>cell", "cell"), ("<<p>x", "<\n\nx")])
def test_cases(page, text):
    assert render(page) == text


@pytest.mark.parametrize("page, text", [
    ('<body class="hidden md:block"><p title="the hidden cost of it">a', "a"), ("<p data-style='display:none'>a", "a"), ('<p class="x" title="style=display:none">a', "a"),
    ("<p title='a > hidden'>b", "b"), ('<p style="font-display:none">a', "a"), ('<p style="display:none;display:block">a', "a"), ("<ol data-start=7 title='start=4'><li>a", "1. a"),
    ('<p HIDDEN>a</p><p hidden="">b</p><p id=x hidden=until-found>c</p><p id="x"hidden>d</p>e', "e"), ('<p title="hidden" STYLE="color:red; Visibility : hidden !important">a</p>b', "b"),
    ('<p style="display:none!important;display:block">a</p><p style=display:none>b</p>c', "c"), ('<ol start="3"><li>a', "3. a")])
def test_only_the_attribute_itself_hides(page, text):
    assert render(page) == text


@pytest.mark.parametrize("page, text", [
    ("<html><head><title>t</title><body><p>text</p></body></html>", "text"), ("<head><meta charset=x><link rel=y><style>z</style>\n<p>a</p>b", "a\n\nb"),
    ("<html><head><title>t</title> plain <b>text</b></html>", "plain text"), ("<head><script>s</script><!-- c -->\n </head><body>b", "b"), ("<head>&nbsp;a", "a"),
    ("<head><head><title>t</title><div>a</div>", "a"), ("<head><template><p>x</p>y</template><body>a", "a"), ("<head><basefont size=3><noscript><p>n</p></noscript><br>a", "a"),
    ("<head><title>t</title></body>a", "a"), ("<p>a<head><title>t</title></head>b", "ab")])
def test_the_head_ends_where_other_content_begins(page, text):
    assert render(page) == text


@pytest.mark.parametrize("page, text", [
    ("<p title=it's>Hello world</p><p>I don't know</p>", "Hello world\n\nI don't know"), ('<p class="a"">Hello</p><p>"x"</p>', 'Hello\n\n"x"'), ("<p '>a</p>b", "a\n\nb"),
    ('<p a="1"b=\'2\' c = "x > y" d>e', "e"), ("<a href=/x/>y</a>", "y"), ("<p =\">a\"", 'a"'), ("<p title=>a</p>", "a"), ('<p title="never closed>a</p>b', "a\n\nb"),
    ("x</p title='>'>y", "xy"), ("a<b title='x>y", "ay"), ("a<br/>b<br / >c", "a\nb\nc")])
def test_quotes_delimit_only_after_the_equals_sign(page, text):
    assert render(page) == text


def test_many_quotes_take_no_long():
    assert render("<p ' title=\"" * 20_000 + "x") == ""
    assert render("<p title=it's>a</p>" * 20_000).count("a") == 20_000


def test_depth_and_length():
    assert render("<div>" * 50_000 + "x") == "x"
    assert render("<p>word " * 20_000).count("word") == 20_000


def test_rows(spark, sf):
    pages = spark.createDataFrame([(1, None, "t"), (1, "<p>a", "t"), (None, "", "t")], "page_id long, html string, text string")
    assert sorted(r["text"] for r in extract_text(pages).collect()) == ["", "", "a"]
    assert extract_text(pages.limit(0)).count() == 0
    from fleetlark.llm.html import op5_html
    assert op5_html(spark, sf).where("text LIKE '%<p>%' OR text IS NULL").count() == 0
