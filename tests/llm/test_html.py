import random
import time

import pytest

from docgate.llm.html import extract_text, render
from tests.llm.helpers import SMALL


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>one<p>two<br>three", "one\n\ntwo\nthree"),
        ("<div>a</div><div>b</div>c", "a\nb\nc"),
        ("a <b>b</b>c\n d", "a bc d"),
        ("<title>t</title><style>p{}</style><script>if (a<b) '</p>'</script>x", "x"),
        ("<p hidden>no</p><p style='color:red; DISPLAY : none'>no</p><p>yes", "yes"),
        ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>", "- a\n- b\n  3. x\n  4. y\n- c"),
        ("<ol><li value=7>a<li>b</ol>", "7. a\n8. b"),
        ("<table><tr><td>1<td>22<tr><th>333<th>4</table>", "1    22\n333  4"),
        ("<table><tr><td colspan=2>wide cell<td>z<tr><td>a<td>b<td>c</table>", "wide cell  z\na  b       c"),
        ("<table><caption>c</caption><tbody><tr><td>a<table><tr><td>in<td>ner</table></table>", "c\na in ner"),
        ("<pre>\n a\n   b</pre>", "\n a\n   b".lstrip("\n")),
        ("<dl><dt>t<dd>d</dl>", "t\n  d"),
        ("x<!-- no --><![CDATA[no]]><?no?>y", "xy"),
        ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
        ("<a href='x>y'>link</a>", "link"),
        ("a<b title=\"it's", "a"),
        ("<details><summary>s</summary>h</details><details open><summary>s</summary>h</details>", "s\n\ns\nh".replace("\n\n", "\n")),
        ("</p></div>x</td>", "x"),
        ("<textarea><b>raw</b></textarea>", "<b>raw</b>"),
    ],
)
def test_layout(html, text):
    assert render(html).strip("\n") == text.strip("\n")


def test_all_text_of_a_cell_is_kept():
    long = "word " * 500
    text = render(f"<table><tr><td>{long}<td>x<tr><td>a<td>b</table>")
    assert text.count("word") == 500 and max(len(x) for x in text.splitlines()[1:]) < 100


def test_any_input_is_rendered_in_bounded_time():
    rng = random.Random(1)
    bits = ["<p>", "</p>", "<li>", "<ul>", "</ul>", "<table>", "<tr>", "<td>", "</table>", "x", "&lt;", "<!--", "-->", "<script>", "</script>", "<div hidden>", "</div>", "<", '"', "'", "=", "<a b=", ">", "\n", "<pre>", "</pre>"]
    for _ in range(2000):
        render("".join(rng.choice(bits) for _ in range(rng.randint(0, 40))))
    began = time.time()
    for hard in ("<div>" * 20_000, '<a "' * 50_000, "<table><tr><td>" * 2000, "<li>" * 20_000, "<table>" + "<tr><td>a" * 10_000):
        assert render(hard + "x") is not None
    assert time.time() - began < 60


def test_table_of_pages(spark):
    schema = "page_id long, url string, html string, text string"
    df = spark.createDataFrame([(1, None, None, "old"), (2, "u", "", "old"), (2, "u", "<p>a", "old"), (None, "u", "<b>x</b>" * 20_000, None)], schema)
    out = extract_text(df)
    assert sorted(out.columns) == ["page_id", "text", "url"]
    assert sorted((r.page_id or 0, len(r.text)) for r in out.collect()) == [(0, 20_000), (1, 0), (2, 0), (2, 1)]
    assert extract_text(spark.createDataFrame([], schema)).count() == 0
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    assert extract_text(pages).filter("text like '%<p>%' or text = ''").count() == 0


def test_no_visible_text_of_tables_and_drawings_is_lost():
    from docgate.llm.html import render

    for page in (
        "<table><tr><form><td>AA</td></form></tr></table>", "<table><tr><p>AA</p><td>BB</table>", "<table><tr><a>AA</a></tr></table>",
        "<table><tbody><form><tr><td>AA<td>BB</tr></form></tbody></table>", "<table><tbody>AA<tr><td>BB</table>", "<table><thead>AA</thead><tfoot>BB</tfoot></table>",
        "<svg><defs/><title>no</title><desc>no</desc><path d=''/><text>AA</text><text>BB</text></svg>", "<math><mi>AA</mi><annotation>no</annotation></math> BB",
    ):
        said = render(page)
        assert said.count("AA") == 1 and said.count("BB") == page.count("BB") and "no" not in said and "AABB" not in said


def grow(rng, depth, inside=""):
    """A random tree: text, or (tag, attributes, children). Blocks aren't put where HTML would close what is open."""
    if depth == 0 or rng.random() < 0.25:
        return rng.choice(["", " "]) + " ".join(rng.choice(["ab", "c", "def", "x<y", "&"]) + str(rng.randint(0, 99)) for _ in range(rng.randint(1, 3))) + rng.choice(["", " ", "\n"])
    many = lambda kind: [grow(rng, depth - 1, kind) for _ in range(rng.randint(1, 3))]
    kind = rng.choice(["b", "br", "hidden"] if inside in ("p", "b") else ["div", "p", "b", "br", "ul", "ol", "hidden", "none", "script", "table"])
    if kind in ("ul", "ol"):
        return (kind, "", [("li", "", many("li")) for _ in range(rng.randint(1, 3))])
    if kind == "table":
        width = rng.randint(1, 3)
        return (kind, "", [("tr", "", [("td", "", [" ".join(["w"] * rng.randint(0, 4))]) for _ in range(width)]) for _ in range(rng.randint(1, 3))])
    if kind == "script":
        return (kind, "", ["var hidden1 = '<p>';"])
    tag = {"hidden": "b", "none": "div"}.get(kind, kind)
    return (tag, {"hidden": " hidden", "none": " style='display:none'"}.get(kind, ""), [] if kind == "br" else many("b" if inside in ("p", "b") else tag))


def source(node):
    if isinstance(node, str):
        return node.replace("&", "&amp;").replace("<", "&lt;")
    tag, attributes, children = node
    inner = "".join(children) if tag == "script" else "".join(map(source, children))
    return f"<{tag}{attributes}>" if tag == "br" else f"<{tag}{attributes}>{inner}</{tag}>"


def said(nodes, lists=()):
    """What a page shows as marks: text, a line's end (0), a blank line (1), a break (2), a list mark, a whole line."""
    for node in nodes:
        if isinstance(node, str):
            yield ("text", node)
            continue
        tag, attributes, children = node
        if attributes or tag == "script":
            continue
        if tag == "br":
            yield ("end", 2)
        elif tag in ("div", "p"):
            yield ("end", int(tag == "p"))
            yield from said(children, lists)
            yield ("end", int(tag == "p"))
        elif tag in ("ul", "ol"):
            yield ("end", int(not lists))
            for i, (_, _, inner) in enumerate(children):
                yield ("end", 0)
                yield ("mark", "  " * len(lists) + ("- " if tag == "ul" else f"{i + 1}. "), "  " * len(lists))
                yield from said(inner, (*lists, tag))
                yield ("end", 0)
                yield ("mark", "", "  " * max(len(lists) - 1, 0))
            yield ("end", int(not lists))
        elif tag == "table":
            rows = [[cell[2][0].strip() for cell in row[2]] for row in children]
            widths = [max(len(r[i]) for r in rows) for i in range(len(rows[0]))]
            yield ("end", 1)
            for row in rows:
                yield ("line", "  ".join(c.ljust(w) for c, w in zip(row, widths, strict=True)).rstrip())
            yield ("end", 1)
        else:
            yield from said(children, lists)


def plain(nodes):
    """The words of all that a page shows, in order, without layout."""
    return " ".join(m[1] for m in said(nodes) if m[0] in ("text", "line"))


def lines(nodes):
    """said() put into lines; for trees without lists in lists, whose indents are left to test_layout."""
    out, now, space, gap, mark = [], "", False, 0, ""

    def end():
        nonlocal now, space
        if now:
            out.append(now.rstrip())
        now, space = "", False

    def begin():
        nonlocal gap, now, mark
        if gap and out:
            out.extend([""] * gap)
        gap, now, mark = 0, mark, ""

    for kind, value, *_ in said(nodes):
        if kind == "mark":
            mark = value
        elif kind == "line" and value.strip():
            begin()
            now += value
            end()
        elif kind == "end":
            if value == 2 and now:
                end()
            elif value == 2:
                gap = max(gap, int(bool(out)))
            else:
                end()
                gap = max(gap, value)
        elif kind == "text":
            for i, word in enumerate(value.split()):
                if not now:
                    begin()
                elif i or space or value[0].isspace():
                    now += " "
                now, space = now + word, False
            space = space or not value.strip() or value[-1].isspace()
    end()
    return "\n".join(out)


def test_random_pages_against_a_plain_renderer():
    rng = random.Random(11)
    exact = 0
    for _ in range(1500):
        nodes = [grow(rng, rng.randint(1, 5)) for _ in range(rng.randint(1, 4))]
        page = "".join(map(source, nodes))
        got = render(page)
        marks = ("-", *(f"{i}." for i in range(1, 10)))
        words = [w for w in got.split() if w not in marks]
        assert "".join(words) == "".join(plain(nodes).split()), page
        if "<ul" not in page and "<ol" not in page or page.count("<ul") + page.count("<ol") == 1:
            exact += 1
            assert got == lines(nodes), page
    assert exact > 500


def test_hidden_stays_hidden_and_text_is_kept_at_any_depth():
    for deep in (10, 600, 2000):
        assert render(f"<div hidden>{'<div>' * deep}no{'</div>' * deep}no</div>yes") == "yes"
        assert render(f"a{'<div>' * deep}b<p hidden>no</p>{'</div>' * deep}c").split() == ["a", "b", "c"]
        assert render(f"{'<table><tr><td>x<td>' * deep}in{'</table>' * deep}out").split() == [*"x" * deep, "in", "out"]
    wide = render("<table><tr><td colspan=99999999999>a<td>b<tr><td>c<td>d</table>")
    assert wide.split() == ["a", "b", "c", "d"]
