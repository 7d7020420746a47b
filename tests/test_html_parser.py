"""HTML to lines: layout of tables, bold headings, broken markup."""

import pytest

from lodestrata.operators.html_lines import html_lines
from lodestrata.operators.html_parser import parse_lines


def texts(html):
    return [t for t, _ in parse_lines(html)]


def cells(*values, tag="td", **attrs):
    extra = "".join(f' {k}="{v}"' for k, v in attrs.items())
    return "".join(f"<{tag}{extra}>{v}</{tag}>" for v in values)


def test_statement_rows_get_their_years_and_affixes():
    html = f"""<table>
      <tr><td></td><td colspan=6>Year Ended June 30,</td></tr>
      <tr><td></td>{cells("2021", "2020", "2019", colspan=2)}</tr>
      <tr><td>Sales</td></tr>
      <tr>{cells("All sales", "$", "1,234", "$", "1,111", "$", "987")}</tr>
      <tr>{cells("Interest", "(", "12 )", "(", "13)", "(", "14 )")}</tr></table>"""
    assert texts(html) == ["Year Ended June 30,", "2021 | 2020 | 2019", "Sales", "All sales | 2021: $1,234 | 2020: $1,111 | 2019: $987", "Interest | 2021: (12) | 2020: (13) | 2019: (14)"]


def test_symbols_in_a_header_stay_apart():
    html = f"<table><tr><td>(millions)</td><td colspan=2>2021</td>{cells('$', '%')}</tr><tr>{cells('Total', '$', '50', '$(5)', '(9)%')}</tr></table>"
    assert texts(html)[1] == "Total | 2021: $50 | $: $(5) | %: (9)%"


def block(year, a, b):
    row = lambda *v: "<tr>" + cells(*(f"<div>{x}</div>" for x in v), colspan=3) + "</tr>"
    return f'<tr><td colspan=3></td><td colspan=12><div>Effect</div></td></tr>{row("(in millions)", f"At {year}", "", "High", "")}{row("Kinds:", "", "", "", "")}{row("Rates", a, "", b, "")}{row("", "", "", "", "")}'


def test_a_second_header_block_replaces_the_first():
    lines = texts("<table>" + block(2021, "$1", "$2") + block(2020, "$3", "$4") + "</table>")
    assert "Rates | At 2021: $1 | High: $2" in lines and "Rates | At 2020: $3 | High: $4" in lines


def test_cells_below_a_rowspan_move_right():
    html = f"""<table><tr><td rowspan=2>Summary</td><td colspan=3></td><td colspan=2>Change</td></tr>
      <tr><td colspan=2>2021</td><td>2020</td>{cells("Total", "Currency")}</tr>
      <tr>{cells("Sales", "$", "406", "$378", "7.3%", "6.5%")}</tr></table>"""
    assert texts(html)[-1] == "Sales | 2021: $406 | 2020: $378 | Change Total: 7.3% | Change Currency: 6.5%"
    html = f"""<table><tr><td></td><td rowspan=2>Due</td><td rowspan=2></td>{cells("2021", "2020", colspan=2)}</tr>
      <tr><td></td>{cells("Amount", "Rate", "Amount", "Rate")}</tr>
      <tr>{cells("Notes", "2021 &#8211; 2062", "", "$86", "0.1% &#8211; 5%", "$97", "6%")}</tr></table>"""
    assert texts(html)[-1] == "Notes | Due: 2021 – 2062 | 2021 Amount: $86 | 2021 Rate: 0.1% – 5% | 2020 Amount: $97 | 2020 Rate: 6%"


def test_tables_without_figures_or_with_item_headings_are_text():
    assert texts("<table><tr><td>Name</td><td>Role</td></tr><tr><td>J. Doe</td><td>Clerk</td></tr></table>") == ["Name Role", "J. Doe Clerk"]
    assert texts("<table><tr><td>Item 1.</td><td>Business</td><td>12</td></tr></table>") == ["Item 1. Business 12"]


def test_only_innermost_tables_are_laid_out():
    inner = "<table><tr><td>Sales</td><td>5</td></tr></table>"
    assert texts(f"<table><tr><td>Left</td><td>{inner}</td></tr></table>") == ["Left", "Sales | 5"]


def test_hidden_headers_scripts_noise_and_entities():
    html = b"<div><ix:header><ix:hidden>SECRET</ix:hidden></ix:header></div><script>if (a < b) { '</p>' }</script><style>p {}</style><p>Sales &#8212; all&nbsp;&amp; more</p><p>17</p><p>Table of Contents</p><table><tr><td>Other</td><td>&#8212;</td><td>5</td></tr></table>"
    assert texts(html) == ["Sales — all & more", "Other | — | 5"]


def test_heading_sizes():
    bold = '<span style="font-size:{}pt;font-weight:700">{}</span>'
    html = f"""<div>{bold.format(12, "Risk")}</div><div>{bold.format(10, "A")} <b style="font-size: 14pt">B</b></div>
      <div>{bold.format(12, "Run-in")} and text</div><b>two<br>lines</b><div style="font-size:9pt"><strong>Inherited</strong></div><p><b>plain</b></p>"""
    assert parse_lines(html) == [("Risk", 12.0), ("A B", 14.0), ("Run-in and text", None), ("two", None), ("lines", None), ("Inherited", 9.0), ("plain", 0.0)]


def test_bold_leaves_no_blanks():
    assert texts('<table><tr><td><span style="font-weight:bold">All</span></td><td>assets</td></tr></table>') == ["All assets"]


def test_broken_markup_loses_no_text():
    assert texts("<p>one<p>two<ul><li>a<li>b</ul><div>three</span></div></p>four") == ["one", "two", "a", "b", "three", "four"]
    assert texts("<table><tr><td>x<td>1<tr><td>y<td>2</table>after") == ["x | 1", "y | 2", "after"]
    assert texts("<b>never closed <p>text") == ["never closed", "text"]


@pytest.mark.parametrize("html", [None, "", b"", "   ", "<p></p>"])
def test_nothing_gives_no_lines(html):
    assert parse_lines(html) == []


def test_repeated_footers_go_and_rare_ones_stay():
    page = "".join(f"<p>Text {n}.</p><p>Acme Inc. | 2021 Report | {n}</p>" for n in range(1, 7))
    assert texts(page) == [f"Text {n}." for n in range(1, 7)]
    assert texts("<p>Part | 12</p><p>Other</p>") == ["Part | 12", "Other"]


def test_spark_pass_numbers_lines(spark):
    docs = spark.createDataFrame([(1, "<p>a</p><p><b>b</b></p>"), (2, None), (3, "")], "doc_id long, html string")
    rows = [tuple(r) for r in html_lines(docs).orderBy("doc_id", "line_no").collect()]
    assert rows == [(1, 0, "a", None), (1, 1, "b", 0.0)]
