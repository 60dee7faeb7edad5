from hypothesis import given, settings
from hypothesis import strategies as st

from pagemart.operators.html_fields import PageElements


class FullParser(PageElements):
    def _read_regular(self, html):
        return False


PIECES = [
    "<p>", "</p>", "<P class='a b'>", '<a href="x&amp;y" title="1">', "</a >", "<br>", "<br/>", "<br />",
    "<div id=x>", '<div id="x" id="y">', "</div>", "<", ">", "&", "&amp;", "&eacute;", "&nope", "a < b", " text ",
    "<!-- note -->", "<!---->", "<!-->", "<!-- a -- b -->", "<!-- open", "<!DOCTYPE html>", "<!doctype>",
    "<script>", "</script>", '<script>var a="</p>";</script>', "<script><!-- </script> --></script>", "</ script>",
    "<style>p{}</style>", "<style>", "<title>t</title>", "<title>a<b>c</title>", "<textarea>", "</textarea>",
    "<table><tr><th>k</th><td>v</td></tr></table>", "<article class=product_pod>", "<?pi?>", "<![CDATA[x]]>",
    '<p title="a>b">', '<p title="a', "<iframe>", "</iframe>", "<ruby>x<rt>y</rt></ruby>", "<h3\n>", "</P>",
    '<img src="../../x.jpg" alt>', "<p/>", "<x-y>", "<1>", "é", "&#233;", "&#x;", '<p title="&lt">',
]


def shape(parser, html):
    try:
        page = parser(html)
    except AssertionError:
        return "unreadable"
    return [page.tags, page.values, page.ends, page.parents]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
def test_regular_pages_read_as_the_full_parser_does(html):
    assert shape(PageElements, html) == shape(FullParser, html)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>/!-=\"'& apscrit", max_size=40))
def test_any_text_reads_as_the_full_parser_does(html):
    assert shape(PageElements, html) == shape(FullParser, html)


def test_ends_enclose_what_is_inside():
    page = PageElements("<div><p>a<b>c</p>d</div><i>e</i>")
    place = page.tags.index("p")
    assert page.text(place) == "ac" and page.text(0) == "acd"
    assert page.ends[0] == page.tags.index("i")
