"""Rendered layout of small pages, worked out by hand."""

from signalpanel.llm.htmltext import render


def test_blocks_and_inline():
    assert render("<h1>Title</h1><p>One  <b>two</b>\n three</p>tail<div>a<div>b</div>c</div>") == (
        "Title\n\nOne two three\n\ntail\na\nb\nc")


def test_hidden():
    page = ("<html><head><title>t</title><style>p{}</style></head><body><script>var x='<p>no</p>'</script>"
            "<p hidden>no</p><p style='color:red; display : none'>no</p><div style='visibility:hidden'>no</div>"
            "<noscript>no</noscript><template><p>no</p></template><details><summary>more</summary>no</details>"
            "<details open><summary>s</summary>yes</details><!-- no --><p>seen</p></body></html>")
    assert render(page) == "more\ns\nyes\n\nseen"


def test_lists():
    assert render("<ul><li>a<li>b<ol start=3><li>c<li>d</ol><li>e</ul>after") == (
        "- a\n- b\n  3. c\n  4. d\n- e\n\nafter")


def test_table():
    page = "<table><tr><th>name<th>n<tr><td>long name<td>1<tr><td colspan=2>all</table>x"
    assert render(page) == "name      | n\nlong name | 1\nall\n\nx"


def test_nested_table_and_multiline_cell():
    page = "<table><tr><td>a<br>b</td><td><table><tr><td>1</td><td>2</td></tr></table></td></tr></table>"
    assert render(page) == "a | 1 | 2\nb |"


def test_pre_and_break():
    assert render("<p>a<br>b</p><pre>x  y\n  z\n\nw</pre>end") == "a\nb\n\nx  y\n  z\n\nw\n\nend"


def test_entities_and_stray_tags():
    assert render("</div>&amp;&lt;b&gt; &middot;</p><p>x</b></i>y</span>") == "&<b> ·\n\nxy"


def test_all_visible_words_stay():
    words = [f"w{k}" for k in range(200)]
    tags = ["p", "div", "li", "td", "span", "b", "h2", "section", "dd", "a"]
    page = "".join(f"<{tags[k % 10]}>{w} " for k, w in enumerate(words))
    assert sorted(render(page).replace("|", " ").replace("- ", " ").split()) == sorted(words)


def test_depth():
    assert render("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"


def test_mathml():
    page = ("<p>if <math><semantics><mrow><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mi>y</mi></mfrac><mspace/><mtext>or so</mtext></mrow>"
            "<annotation encoding='application/x-tex'>no</annotation><annotation-xml><mi>no</mi></annotation-xml>"
            "</semantics></math> then <annotation>yes</annotation></p>")
    assert render(page) == "if x= 1 y or so then yes"


def test_svg():
    page = ("<p>a <svg><title>no</title><desc>no</desc><metadata>no</metadata><defs><text>no</text></defs><defs/><path d='M0'/>no"
            "<g><text x=1>North <tspan>Sea</tspan></text><text>12 km</text><text visibility='hidden'>no</text>"
            "<text><tspan x=0 y=1>two</tspan><tspan x=0 y=2>lines</tspan></text></g>"
            "<foreignObject><div>box</div></foreignObject></svg> b</p>")
    assert render(page) == "a North Sea 12 km two lines\nbox\nb"
    assert render("<svg><text>in</text><g><p>out") == "in\n\nout"
    assert render("<svg>" + "<g>" * 20_000 + "<text>deep</text>") == "deep"


def test_rowspan():
    page = "<table><tr><td rowspan=2>ab<td>c<td>d<tr><td>e<td>f<tr><td>g<td>h<td>i</table>"
    assert render(page) == "ab | c | d\n   | e | f\ng  | h | i"
    page = "<table><tr><td>a<td rowspan=0>b<td>c<tr><td>d<td>e<tbody><tr><td>f<td>g<td>h</table>"
    assert render(page) == "a | b | c\nd |   | e\nf | g | h"
    page = "<table><tr><td rowspan=3 colspan=2>ab<td>c<tr><td rowspan=2>d<td>e<tr><td>f</table>"
    assert [x.split("|")[-1].strip() for x in render(page).split("\n")] == ["c", "e", "f"]
