"""Tables of pages against a second, plain reading of the markup; limits; addresses that lead nowhere."""

import random
import re

import pytest

from tidelake.sources import documents


def plain_tables(html):
    """Tables of well-formed markup without nesting, by regular expressions."""
    text = lambda x: " ".join(re.sub(r"<[^>]*>", "", x).split())
    out = []
    for t in re.findall(r"(?s)<table>(.*?)</table>", html):
        header, rows = [], []
        for tr in re.findall(r"(?s)<tr>(.*?)</tr>", t):
            cells = re.findall(r"(?s)<(t[hd])>(.*?)</t[hd]>", tr)
            values = [text(x) for _, x in cells]
            if cells and not header and all(k == "th" for k, _ in cells):
                header = values
            elif cells:
                rows.append(values)
        caption = re.search(r"(?s)<caption>(.*?)</caption>", t)
        out.append({"caption": (text(caption[1]) or None) if caption else None, "header": header, "rows": rows})
    return out


def test_tables_against_a_plain_reading():
    rng = random.Random(2)
    word = lambda: rng.choice(["a", "1.234,5", " b <b>c</b>", "", "d\n e", "<i>f</i>"])
    for _ in range(200):
        html = "<p>x</p>"
        for _ in range(rng.randrange(4)):
            rows = "".join("<tr>" + "".join(f"<{k}>{word()}</{k}>" for k in rng.choices(["th", "td"], [p, 1 - p], k=rng.randrange(4))) + "</tr>" for p in rng.choices([1, 0, 0.5], k=rng.randrange(5)))
            html += f"<table>{rng.choice(['', '<caption>' + word() + '</caption>'])}<tbody>{rows}</tbody></table> y "
        got = documents.parse_html(html, "")
        assert got["tables"] == plain_tables(html) and got["n_tables"] == len(got["tables"])


def test_cells_without_an_end_and_tables_in_cells():
    got = documents.parse_html("<table><tr><td>1<td>2<tr><td>3<table><caption>in</caption><tr><th>h<tr><td>i</table>4<td>5</table><table><tr><td>last", "")["tables"]
    assert got == [{"caption": None, "header": [], "rows": [["1", "2"], ["34", "5"]]}, {"caption": "in", "header": ["h"], "rows": [["i"]]}, {"caption": None, "header": [], "rows": [["last"]]}]
    assert documents.parse_html("<td>x</td><tr></table></tr><caption>y", "")["tables"] == []
    assert documents.parse_html("<table><tr><td>a<script><td>b</script>c</table>", "")["n_cells"] in (1, 2)


def test_what_is_beyond_a_limit_is_left_out():
    rows, tables = documents.MAX_ROWS, documents.MAX_TABLES
    many = documents.parse_html("<table>" + "<tr><td>x</td></tr>" * (rows + 100) + "</table>", "")
    assert many["cut"] and many["n_cells"] == rows and all(r == ["x"] for r in many["tables"][0]["rows"])
    many = documents.parse_html("<table><tr><td>x</td></tr></table>" * (tables + 10), "")
    assert many["cut"] and many["n_tables"] == tables == many["n_cells"]
    many = documents.parse_html("<table><tr>" + "<td>x</td>" * (documents.MAX_COLS + 5) + "</tr></table>", "")
    assert many["cut"] and many["n_cells"] == documents.MAX_COLS
    assert not documents.parse_html("<table>" + "<tr><td>x</td></tr>" * rows + "</table>", "")["cut"]


def test_links_that_lead_to_no_page():
    html = "".join(f'<a href="{h}">x</a>' for h in ("#top", " #a", "javascript:x()", "mailto:a@b", "tel:1", "", "ftp://h/x", "/p#top", "  /q "))
    assert documents.parse_html(html, "http://h/p")["links"] == ["http://h/p#top", "http://h/q"]


@pytest.mark.parametrize("html", [None, ""])
def test_nothing(spark, html):
    page = spark.createDataFrame([(1, None, html)], "page_id long, url string, html string")
    (r,) = documents.extract_html(page).collect()
    assert r.tables == [] and r.n_cells == 0 and documents.cells(documents.extract_html(page)).count() == 0
