"""What large tables bring: how many files, rows and bytes the steps of queries take, and keys that small tables don't have."""

from pathlib import Path

import pytest

from lodestrata.operators import factsheets
from lodestrata.operators.html_parser import parse_lines
from lodestrata.plans import documents
from lodestrata.sources import archive, reports, store


def parts(root) -> list[Path]:
    return [p for p in Path(root).rglob("part-*")]


@pytest.fixture
def suppliers(spark, tmp_path):
    """Tables of 40 suppliers."""
    spark.range(40).selectExpr("id AS s_suppkey").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    return str(tmp_path)


def test_filings_are_packed_by_task(spark, suppliers, monkeypatch):
    seen = []
    monkeypatch.setattr(documents, "FILINGS_A_FILE", 10)
    monkeypatch.setattr(documents, "scratch", lambda spark, name: seen.append(f"{suppliers}/{name}") or seen[-1])
    _, filings = documents._filed(spark, suppliers)
    assert filings.count() == 40 and 1 < len(parts(seen[0])) <= 4


def test_sections_are_a_file_a_task(spark, tmp_path):
    rows = spark.range(40).selectExpr("concat('T', id) AS ticker", "'7' AS section", "concat('Text ', id) AS text").repartition(2)
    reports.write_sections(rows, str(tmp_path / "s"))
    assert len(parts(tmp_path / "s")) == 2
    assert sorted(map(tuple, spark.read.json(str(tmp_path / "s")).select("ticker", "section", "text").collect())) == sorted(map(tuple, rows.collect()))


def test_packed_filings_are_what_was_packed(spark, tmp_path):
    rows = spark.createDataFrame([("A", "a-1", "<p>ä</p>"), ("2025", "a-2", None)], "ticker string, accession string, html string")
    archive.write_packed(rows, str(tmp_path / "p"))
    assert sorted(map(tuple, archive.read_packed(spark, str(tmp_path / "p")).collect())) == [("a-1", bytearray("<p>ä</p>".encode())), ("a-2", None)]


def laid_out(*rows):
    html = "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows)
    return [t for t, _ in parse_lines(f"<table>{html}</table>")]


def test_figures_that_look_like_years():
    assert laid_out(("", "2025"), ("Total revenues", "2025"), ("Net income", "1990")) == ["2025", "Total revenues | 2025: 2025", "Net income | 2025: 1990"]
    assert laid_out(("", "2025", "2024"), ("Stores", "1990", "2001"), ("Sales", "12", "13"))[1:] == ["Stores | 2025: 1990 | 2024: 2001", "Sales | 2025: 12 | 2024: 13"]


def test_headings_of_years_stay_headings():
    again = laid_out(("December 31,", "2025"), ("Assets", "12"), ("December 31,", "2024"), ("Assets", "11"))
    assert again == ["December 31, | 2025", "Assets | 2025: 12", "December 31, | 2024", "Assets | 2024: 11"]
    assert laid_out(("", "2025", "2024"), ("Sales", "5", "6"), ("Debts", "2025", "2024"), ("Notes", "7", "8"))[2:] == ["Debts | 2025 | 2024", "Notes | 2025: 7 | 2024: 8"]


@pytest.mark.parametrize("name", ["filing_chunks", "ingest_counts"])
def test_filings_whose_amounts_are_years(spark, tmp_path, name):
    from lodestrata.plans import registry

    spark.range(1925, 1927).selectExpr("id AS s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    found = registry.queries()[name](spark, str(tmp_path)).collect()
    assert {r["ticker"] for r in found} == {"S1925", "S1926"}
    if name == "filing_chunks":
        assert any(r["text"].endswith("Total revenues | 2025: 2025\nOperating income | 2025: 1935\nNet income | 2025: 1926") for r in found)


def test_the_store_is_a_file_a_task(spark, tmp_path):
    rows = spark.range(40).selectExpr("CAST(id AS STRING) AS ticker", "concat('Text ', id) AS text").repartition(2)
    store.write_chunks(rows, str(tmp_path / "c"))
    back = store.read_chunks(spark, str(tmp_path / "c"))
    assert len(parts(tmp_path / "c")) == 2 and dict(back.dtypes)["ticker"] == "string"
    assert [r["text"] for r in store.lookup(back, {"ticker": "7"}).collect()] == ["Text 7"]


def test_a_quote_of_many_facts_is_looked_for_once(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(factsheets, "holding", lambda texts, passages, *a, f=factsheets.holding, **b: asked.append(passages.count()) or f(texts, passages, *a, **b))
    lines = spark.createDataFrame([("T", "8", "income", "Net sales | price: 1"), ("T", "8", "", "Net sales | price: 12"), ("T", "8", "", "Net sales | price: 1"), ("T", "7", "", "Net sales | price: 1")], "ticker string, section string, statement string, text string")
    quotes = [("sales | price: 1", None), ("sales | price: 1", "income"), ("sales | price: 2", None), (None, None), ("", None)]
    facts = spark.createDataFrame([("T", f"{i} {k}", "8", s, q, "1") for i in range(20) for k, (q, s) in enumerate(quotes)], "ticker string, id string, section string, statement string, quote string, value string")
    got = {r["id"]: r["n_lines"] for r in factsheets.quote_lines(lines, facts).collect()}
    assert asked[0] <= 4 and len(got) == 100
    assert all(n == {"0": 2, "1": 1, "2": 0, "3": 0, "4": 0}[i[-1]] for i, n in got.items())
    told = {r["id"]: r["problem"] for r in factsheets.fact_problems(lines, facts).collect()}
    assert len(told) == 80 and told["3 0"] == "quote found on 2 distinct lines of Item 8" and "3 1" not in told


LINES = ["ring ring ring | price: 1", "ring ring | price: 12", "a  b c", " a b ", "a b a b a", "über 😀 x | 9", "ab.c* d+ e\\E f", "", " ", "x", "a\tb c d", "Net sales | price: 1", "sales net | price: 1"]
QUOTES = ["ring ring | price: 1", "g ring | p", "ring | price: 12", "ng ring ring |", "  ", " ", "a  b", " b", "b ", "a b a", " a b a", "b a b", "r 😀 x | ", "😀", "x", "xx", ".c* d+ e\\E", "e\\E f", "\tb c", "sales | price: 1", "a b", "i", "", None]


def test_lines_hold_quotes_of_every_form(spark):
    lines = [(k, "8", s, t) for k in "TU" for i, t in enumerate(LINES) for s in ("income", "")[: 1 + i % 2] if k == "T" or i % 3]
    facts = [(k, f"{s} {i}", "8", s, q, None) for k in "TU" for s in ("income", None) for i, q in enumerate(QUOTES)]
    want = {(k, i): len({t for tk, _, at, t in lines if q and tk == k and q in t and s in (None, at)}) for k, i, _, s, q, _ in facts}
    columns = "ticker string, id string, section string, statement string"
    lines, facts = spark.createDataFrame(lines, f"{columns.replace('id string, ', '')}, text string"), spark.createDataFrame(facts, f"{columns}, quote string, value string")
    got = factsheets.quote_lines(lines, facts).collect()
    assert len(got) == len(want) and {(r["ticker"], r["id"]): r["n_lines"] for r in got} == want


@pytest.mark.parametrize("query", [factsheets.quote_lines, factsheets.fact_problems])
def test_lines_are_not_held_against_quotes_in_pairs(spark, query):
    """One word finds all these lines for all these quotes: 90,000 pairs."""
    rows = spark.range(300).selectExpr("concat('T', id DIV 1000) AS ticker", "CAST(id AS STRING) AS id", "'8' AS section", "CAST(NULL AS STRING) AS statement", "concat('Net', id, ' ring | price: ', id) AS quote", "CAST(id AS STRING) AS value")
    found = query(rows.selectExpr("ticker", "section", "statement", "concat('Part ', quote) AS text"), rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join" in x]
    assert joins and not any("Contains(" in x or "Broadcast" in x or "NestedLoop" in x for x in joins)
    assert query is factsheets.fact_problems or found.filter("n_lines <> 1").count() == 0


def test_a_store_is_looked_up_in_as_many_tasks_as_its_bytes_need(spark, tmp_path, monkeypatch):
    rows = spark.range(6000).selectExpr("id AS doc_id", "concat('s', id % 3) AS source", "'en' AS lang", "sha2(CAST(id AS STRING), 512) AS text")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    monkeypatch.setattr(documents, "scratch", lambda spark, name: str(tmp_path / name))
    monkeypatch.setattr(store, "load_or_build", lambda spark, chunks, *a, f=store.load_or_build: seen.append(chunks) or f(spark, chunks, *a))
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        assert {tuple(r) for r in documents.store_rebuilt(spark, str(tmp_path)).collect()} == {(f"s{i}", 2000, 256000, True) for i in range(3)}
        assert seen[1].rdd.getNumPartitions() > 6
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
