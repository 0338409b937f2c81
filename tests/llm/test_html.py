"""What is visible, and how it is laid out."""

import pytest

from mizan.llm.html_text import extract


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<style>.x{display:none}</style><p class=x>gone<p>here", "here"),
        ("<style>/* p{} */ @media print{p{display:none}} p.a, #q{display:none} @media screen{i{display:none}}</style><p class='a b'>no<p>yes<i>no</i><div id=q>no</div><p class=a style='display:block'>shown", "yes\n\nshown"),
        ("<style>.a{display:none}.a.b{display:block}</style><p class='a b'>x<p class=a>y", "x"),
        ('<div style="visibility:hidden">a<b style="visibility:visible">b</b>c</div>', "b"),
        ('<form><input type=submit value="Send it"><input type=hidden value=zz><input value=abc></form>', "Send it abc"),
        ("<p hidden>a<p>b", "b"),
        ("<ul><li>one<li>two<ul><li>x</ul></ul><ol start=3><li>c<li>d</ol>", "- one\n- two\n  - x\n\n3. c\n4. d"),
        ("<table><tr><th>a<td>bb<tr><td>ccc<td>d</table>", "a    bb\nccc  d"),
        ("<p>a<div>b</div><pre>x\n  y</pre>c<br>d", "a\n\nb\n\nx\n  y\n\nc\nd"),
        ("<script>x</script><title>t</title><!-- c --><p>&lt;b&gt; &amp;c", "<b> &c"),
        ("text <unclosed", "text"),
        ("", ""),
        (None, ""),
    ],
)
def test_extract(html, text):
    assert extract(html) == text


def test_long_and_deep():
    assert extract("<div>" * 20000 + "x") == "x"
    assert extract("<p>word " * 30000).count("word") == 30000
