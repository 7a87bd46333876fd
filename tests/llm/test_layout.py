from millrace.llm import mainbody
from millrace.llm.layout import is_html, render, source_lines


def test_blocks_lists_and_tables():
    html = "<html><head><title>T</title><style>x{}</style></head><body><h1>Head</h1><p>One<p>Two <b>bold</b><ul><li>a<li>b<ul><li>c</ul></ul><ol start=3><li>x<li>y</ol><table><tr><td>ab<td>c<tr><td>d<td>efg</table><div hidden>no</div><span style='display: none'>no</span><script>no</script></body>"
    assert render(html).split("\n") == ["Head", "", "One", "", "Two bold", "", "* a", "* b", "  * c", "", "3. x", "4. y", "", "ab  c", "d   efg"]


def test_text_is_no_html():
    assert not is_html("a < b and <insert hours>") and is_html("x <br> y") and not is_html("")
    assert render("") == "" and render("plain") == "plain" and render("<pre>a  b\n c</pre>") == "a  b\n c"
    assert render("a<br>b<br/>c") == "a\nb\nc" and render("<p>&lt;x&gt; &amp; y</p>") == "<x> & y"


def test_broken_markup():
    assert render("<div><p>a</div></span>b<td>c") == "a\n\nb\nc"


def test_captions_and_what_else_stands_in_tables():
    assert render("<table><caption>Hours <b>today</b></caption><tr><td>a<td>b</table>") == "Hours today\na  b"
    assert render("<table><caption>Hours<tr><td>a<td>b</table>") == "Hours\na  b"
    assert render("<table>Call <b>first</b><tbody><tr>now<td>a<td>b</tr><div>Ask</div></tbody></table>").split("\n") == ["Call first", "now", "Ask", "a  b"]
    assert render("<table><caption hidden>no</caption><colgroup><col></colgroup> <tr> <td>a</td> </tr> </table>") == "a"


def test_lines_come_from_lines_of_the_text():
    html = "<div>\n<p>One\ntwo</p>\n\n<table><tr><td>a\n<td>bcd</table><p>x<br>y\n</div>\nend"
    assert render(html).split("\n") == ["One two", "", "a  bcd", "", "x", "y", "", "end"]
    assert source_lines(html) == [[2, 3], [], [5, 6], [], [6], [6], [], [8]]


def test_verdicts_of_html_are_numbered_by_the_lines_of_the_text():
    html = "<html>\n<body>\n<ul><li>Home</ul>\n\n<h1>Visits</h1>\n<p>A nurse visits you\nat home after birth.</p>\n<p>Copyright Wrenfield</p>\n</body>"
    got = mainbody.text_verdicts(html, mainbody.fit([]))
    assert [no for no, _ in got] == [1, 2, 3, 5, 6, 7, 8, 9] and {no for no, m in got if m} >= {6, 7} and not {1, 2, 8, 9} & {no for no, m in got if m}
