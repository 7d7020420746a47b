"""Chunks, store, retrieval, answers, scoring, evaluation, facts and sources, end to end with a fake model."""

import json
import re
import tomllib
import urllib.error
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.constants import CATEGORY_QUERIES
from lodestrata.functions.labels import numbered_context
from lodestrata.operators import answers, chunking, evaluation, factsheets, retrieval, scoring, sessions
from lodestrata.operators.completion import DailyQuotaExhausted, RateLimited, complete, wait_seconds, with_rate_limit_retries
from lodestrata.operators.embedding import HashingEmbedder, with_embeddings
from lodestrata.operators.ingest import IngestError, ingest, sections_of
from lodestrata.sources import archive, fact_specs, labels, pins, reports, results, store
from lodestrata.sources.settings import Settings
from lodestrata.streaming.arrivals import ingest_arrivals

WORDS = st.lists(st.sampled_from(["a", "word", "longerword", "x" * 40, "\n", "\n\n", ". ", " ", "  "]), max_size=120).map("".join)


@settings(max_examples=150, deadline=None)
@given(WORDS, st.integers(10, 60), st.integers(0, 9))
def test_chunks_keep_size_order_and_text(text, size, overlap):
    chunks = chunking.split_text(text, size, overlap)
    assert all(0 < len(c) <= size and c == c.strip() for c in chunks)
    at = 0
    for c in chunks:  # each chunk stands in the text, and none begins before the one before it
        found = text.find(c, at)
        assert found >= 0
        at = found
    assert set("".join(text.split())) <= set("".join(chunks))


def test_chunks_prefer_larger_breaks():
    assert chunking.split_text("one two\nthree four\n\nfive six", 20, 0) == ["one two\nthree four", "five six"]
    assert chunking.split_text("aaaa bbbb cccc dddd", 10, 5) == ["aaaa bbbb", "bbbb cccc", "cccc dddd"]
    assert chunking.split_text("", 10, 5) == [] and chunking.split_text("x" * 25, 10, 0) == ["x" * 10, "x" * 10, "x" * 5]


def test_stride_chunks_cover_the_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(2345))
    docs = spark.createDataFrame([(1, text), (2, "ab"), (3, ""), (4, None), (5, text[:1000]), (6, text[:1001])], "doc_id long, text string")
    rows = chunking.fixed_stride_chunks(docs).orderBy("doc_id", "chunk_index").collect()
    assert [r["text"] for r in rows if r["doc_id"] == 1] == [text[i : i + 1000] for i in (0, 850, 1700)]
    assert [len([r for r in rows if r["doc_id"] == d]) for d in (2, 3, 4, 5, 6)] == [1, 0, 0, 1, 2]


BODY = "Words of the business. " * 60
PIN = {
    "ticker": "ACME", "company": "Acme Inc.", "cik": 7, "form": "10-K", "fiscal_year": 2025, "period_end": "2025-12-31", "accession": "0007-25-1", "primary_document": "a.htm",
    "revenue_line": "Total revenues", "operating_income_line": "Operating income", "net_income_line": "Net income",
}
OTHER = PIN | {"ticker": "ZED", "company": "Zed Ltd", "cik": 8, "accession": "0008-25-1"}


def filing(seven_a="We hedge foreign currency exchange rate risk. " * 15, sheet=True):
    balance = "<p>Consolidated Balance Sheets</p><p>(In millions)</p><table><tr><td></td><td>2025</td></tr><tr><td>Cash and cash equivalents</td><td>50</td></tr><tr><td>Term debt</td><td>70</td></tr></table>" if sheet else ""
    return f"""<p>Item 1. Business</p><p>{BODY}</p><p>Item 1A. Risk Factors</p><p>{"Supply chain disruption risks. " * 50}</p><p>Item 3. Legal</p><p>{"Litigation and investigation. " * 20}</p>
      <p>Item 7. Discussion</p><p>{"Liquidity and cash flow and revenue. " * 90}</p><p>Item 7A. Market Risk</p><p>{seven_a}</p><p>Item 8. Statements</p><p>Consolidated Statements of Operations</p><p>(In millions)</p>
      <table><tr><td></td><td>2025</td><td>2024</td></tr><tr><td>Total revenues</td><td>900</td><td>800</td></tr><tr><td>Operating income</td><td>90</td><td>80</td></tr><tr><td>Net income</td><td>60</td><td>50</td></tr></table>
      {balance}<p>Notes to Consolidated Financial Statements</p><p>{"Revenue by geographic area. " * 40}</p><p>Item 9. Changes</p><p>None.</p>"""


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("data")
    for pin, html in ((PIN, filing()), (OTHER, filing("None; see elsewhere.", sheet=False))):
        path = root / "edgar" / pin["ticker"] / pin["accession"] / pin["primary_document"]
        path.parent.mkdir(parents=True)
        path.write_bytes(html.encode())
    table = pins.pins_table(spark, [PIN, OTHER])
    filings = archive.read_filings(spark, str(root / "edgar"))
    counts = ingest(table, filings, str(root / "store"))
    return {"pins": table, "filings": filings, "root": root, "counts": counts, "chunks": store.read_chunks(spark, str(root / "store")).cache()}


def test_ingest_counts_and_ids(built):
    counts = {r["ticker"]: r.asDict() for r in built["counts"].collect()}
    assert all(counts[t][i] > 0 for t in ("ACME", "ZED") for i in ("1", "1A", "3", "7", "7A", "8"))
    rows = built["chunks"].collect()
    assert counts["ACME"]["total"] == sum(r["ticker"] == "ACME" for r in rows)
    for r in rows:
        assert r["chunk_id"] == f"{r['accession']}:{r['section']}:{r['chunk_index']}" and len(r["text"]) <= 1000 and len(r["embedding"]) == 64
    eight = sorted((r["chunk_index"], r["statement"]) for r in rows if (r["ticker"], r["section"]) == ("ACME", "8"))
    assert [i for i, _ in eight] == list(range(len(eight)))
    assert [s for i, s in eight][:2] == ["income", "balance_sheet"] and {s for _, s in eight[2:]} == {""}
    assert {r["content_source"] for r in rows if r["section"] == "7A"} == {"own", "short_unresolved"}
    assert rows[0]["source_url"].startswith("https://www.sec.gov/Archives/edgar/data/")


def test_ingest_refuses_what_scoring_cannot_use(spark, built):
    wrong = pins.pins_table(spark, [PIN | {"revenue_line": "Turnover"}, PIN | {"ticker": "GONE", "accession": "none"}])
    with pytest.raises(IngestError, match="0 income-statement rows labelled 'Turnover'"):
        ingest(wrong, built["filings"], str(built["root"] / "never"))
    assert not (built["root"] / "never").exists()


def test_store(spark, built):
    chunks = built["chunks"]
    assert store.has_documents(chunks) and store.has_documents(chunks, "ACME") and not store.has_documents(chunks, "NONE")
    assert store.lookup(chunks, {"ticker": "ACME", "section": "7A"}, ["text"], 1).count() == 1
    plain = chunks.drop("embedding")
    assert store.digest(plain) == store.digest(plain.repartition(5)) != store.digest(plain.filter("section <> '1'"))
    root = str(built["root"] / "stores")
    first, there = store.load_or_build(spark, plain, root, "1000_150", with_embeddings)
    again, there_again = store.load_or_build(spark, plain, root, "1000_150", with_embeddings)
    assert (there, there_again) == (False, True) and first.count() == again.count() == chunks.count()


def question(spark, ticker="ACME", text="What was the total revenue?"):
    return spark.createDataFrame([("q", ticker, text, [float(x) for x in HashingEmbedder().embed([text])[0]])], "question_id string, ticker string, question string, vector array<float>")


def test_questions_retrieve_without_repeats(spark, built):
    rows = retrieval.retrieve_for_questions(built["chunks"], question(spark)).orderBy("n").collect()
    keys = [(r["section"], r["chunk_index"]) for r in rows]
    assert [r["n"] for r in rows] == list(range(1, len(rows) + 1)) and len(set(keys)) == len(keys)
    assert {r["ticker"] for r in rows} == {"ACME"} and ("8", 0) in keys and any(s == "8" for s, _ in keys[:4])


def test_first_wins_where_branches_overlap(spark):
    a = spark.createDataFrame([("q", 1, "x"), ("q", 2, "y")], "q string, rank int, k string")
    b = spark.createDataFrame([("q", 1, "y"), ("q", 2, "z"), ("r", 1, "x")], "q string, rank int, k string")
    rows = [tuple(r) for r in retrieval.first_wins([a, b], "q", ("k",)).select("q", "n", "k").orderBy("q", "n").collect()]
    assert rows == [("q", 1, "x"), ("q", 2, "y"), ("q", 3, "z"), ("r", 1, "x")]


def test_quotas(spark):
    sources = spark.createDataFrame([("A", "own"), ("B", "short_unresolved"), ("C", None)], "ticker string, content_source string")
    rows = retrieval.section_quotas(sources).orderBy("sec_ord").collect()
    of = lambda t, c, no=0: [(r["section"], r["k"]) for r in rows if (r["ticker"], r["category"], r["search_no"]) == (t, c, no)]
    assert of("A", "FX Risk") == [("7A", 3), ("8", 1)] and of("A", "FX Risk", 1) == [("7", 1), ("8", 2)]
    assert of("B", "FX Risk") == of("C", "FX Risk") == [("7A", 3), ("8", 1), ("7", 2)]
    assert of("B", "Interest Rate Risk") == [("7A", 2), ("8", 1), ("7", 2)]
    assert of("B", "Legal Risk") == [("3", 2), ("8", 1), ("1A", 1)]


def fake_client():
    """Made in a function, so that workers get it by value."""

    class FakeClient:
        """Answers every prompt by what it is about."""

        def complete(self, prompt, max_tokens, temperature):
            if "Sum up its risk profile" in prompt:
                return " Risk is fair. "
            if "You rate one risk" in prompt:
                category = re.search(r"from 1 to 10: (.*)\.", prompt)[1]
                if category == "Legal Risk":
                    return "SCORE: INSUFFICIENT\nREASON: Nothing there."
                return f"**SCORE:** {len(category) % 10 + 1}\nREASON: Revenues of $900 million [1] and $123,456 [2]; ≈ 7% of it [99]."
            return "Total revenues were $900 million [1] and 41,000 [2]."

    return FakeClient()


def test_answers(spark, built):
    row = answers.ask(built["chunks"], question(spark), fake_client).first()
    assert [p["n"] for p in row["passages"] if p["cited"]] == [1, 2] and "41,000" in row["check"]["unverified_figures"]
    assert row["passages"][0]["label"].startswith("Acme Inc. · 10-K FY2025 · Item ")
    assert answers.ask(built["chunks"], question(spark, "NONE"), fake_client).count() == 0


def test_risk_analysis(spark, built):
    vectors = scoring.query_vectors(spark)
    asked = {(r["ticker"], r["category"]): r for r in scoring.category_prompts(built["chunks"], built["pins"], vectors).collect()}
    assert len(asked) == 12
    liquidity = asked["ACME", "Liquidity Risk"]["passages"]
    assert liquidity[0]["text"] == "(In millions)\nTotal revenues | 2025: 900 | 2024: 800\nOperating income | 2025: 90 | 2024: 80\nNet income | 2025: 60 | 2024: 50"
    assert liquidity[1]["text"] == "(In millions)\nCash and cash equivalents | 2025: 50\nTerm debt | 2025: 70"
    assert [p["n"] for p in liquidity] == list(range(1, len(liquidity) + 1)) and liquidity[2]["section"] == "7"
    assert asked["ACME", "Revenue Risk"]["passages"][1]["section"] == "7"
    assert asked["ACME", "Liquidity Risk"]["read_from"] == "Item 7 ×2, Item 8 ×1"
    assert "7" in [p["section"] for p in asked["ZED", "FX Risk"]["passages"]]
    scores, totals = scoring.run_risk_analysis(built["chunks"], built["pins"], fake_client)
    rows = {(r["ticker"], r["category"]): r for r in scores.collect()}
    assert (rows["ACME", "Legal Risk"]["score"], rows["ACME", "Legal Risk"]["reason"]) == (None, "Insufficient information: Nothing there.")
    fx = rows["ACME", "FX Risk"]
    assert fx["score"] == 8 and fx["check"]["invalid_citations"] == [99] and fx["check"]["approximate_ratios"] == ["≈ 7%"] and fx["check"]["unverified_figures"] == ["$123,456"]
    total = {r["ticker"]: r for r in totals.collect()}["ACME"]
    scored = [len(c) % 10 + 1 for c in CATEGORY_QUERIES if c != "Legal Risk"]
    assert total["overall"] == round(sum(scored) / (10 * 5) * 100) and total["summary"] == "Risk is fair."

    path = str(built["root"] / "results")
    records = scoring.result_records(built["pins"], scores, totals)
    results.save_results(records, path, "Run 1", "2026-01-01 10:00")
    results.save_results(records.filter("ticker = 'ACME'"), path, "Run 2", "2026-01-02 10:00")
    kept = {r["ticker"]: r for r in results.load_results(spark, path).collect()}
    assert (kept["ACME"]["source"], kept["ZED"]["source"]) == ("Run 2", "Run 1")
    assert kept["ACME"]["results"]["scores"]["FX Risk"]["score"] == 8 and kept["ACME"]["results"]["evidence"]["FX Risk"]["check"]["invalid_citations"] == [99]
    ready = {r["ticker"]: r["analysed"] for r in sessions.ready_filings(built["pins"], built["chunks"], results.load_results(spark, path)).collect()}
    assert ready == {"ACME": True, "ZED": True}
    assert results.load_results(spark, str(built["root"] / "nowhere")).count() == 0


def test_categories_without_text_make_no_call(spark, built):
    class Never:
        def complete(self, prompt, *a):
            raise AssertionError("called")

    only_statements = built["chunks"].filter("section = '8'")
    rows = {r["category"]: r for r in scoring.score_categories(only_statements, built["pins"], scoring.query_vectors(spark), fake_client).filter("ticker = 'ACME'").collect()}
    assert {c for c, r in rows.items() if r["reason"] == "No text found in the Items this category reads"} == {"Revenue Risk", "Operational Risk"}
    assert all(rows[c]["passages"] is None and rows[c]["check"] is None and rows[c]["score"] is None for c in ("Revenue Risk", "Operational Risk"))
    nobody = pins.pins_table(spark, [PIN | {"ticker": "NONE"}])
    with pytest.raises(Exception, match="NONE: 0 income-statement rows"):
        scoring.category_prompts(built["chunks"], nobody, scoring.query_vectors(spark)).collect()
    rows = spark.createDataFrame([("NONE", i, c, None) for i, c in enumerate(CATEGORY_QUERIES)], "ticker string, cat_ord int, category string, score int")
    assert scoring.summaries(built["chunks"], rows, scoring.query_vectors(spark), Never).first()["summary"] == "Fewer than 4 of 6 risk categories could be scored, so no summary was generated."


def test_retries_wait_and_give_up():
    waits, left = [], [RateLimited("per minute", "7"), RateLimited("per minute", "900"), RateLimited("per minute", None)]

    def call():
        if left:
            raise left.pop(0)
        return "done"

    assert with_rate_limit_retries(call, waits.append) == "done" and waits == [7.0, 120.0, 30.0]
    with pytest.raises(DailyQuotaExhausted):
        with_rate_limit_retries(lambda: (_ for _ in ()).throw(RateLimited("tokens per day (TPD)")), waits.append)
    waits.clear()
    with pytest.raises(RateLimited):
        with_rate_limit_retries(lambda: (_ for _ in ()).throw(RateLimited("per minute", "1")), waits.append)
    assert len(waits) == 6 and wait_seconds(RateLimited("x", "soon")) == 30.0


def test_daily_limit_stops_the_rest(spark):
    class Limited:
        n = 0

        def complete(self, prompt, max_tokens, temperature):
            self.n += 1
            if self.n > 1:
                raise RateLimited("requests per day")
            return "yes"

    rows = complete(spark.createDataFrame([("a",), ("b",), (None,), ("c",)], "prompt string").coalesce(1), Limited, 10).collect()
    assert sorted((r["reply"] or "", bool(r["stopped"])) for r in rows) == [("", False), ("", True), ("", True), ("yes", False)]


def test_labels(spark, tmp_path):
    (tmp_path / "l.csv").write_text('company,category,my_score,my_reason\nA,FX Risk,6,"Gross, net ""x"""\nA,Legal Risk, ,\nB,FX Risk,2,ok\nC,FX Risk,3,\nD,FX Risk,9,\n', encoding="utf-8")
    found = labels.read_labels(spark, str(tmp_path / "l.csv"))
    assert [(r["company"], r["label"], r["reason"]) for r in found.orderBy("company").collect()] == [("A", 6, 'Gross, net "x"'), ("B", 2, "ok"), ("C", 3, ""), ("D", 9, "")]
    scores = spark.createDataFrame([("A", "FX Risk", 7), ("B", "FX Risk", None), ("D", "FX Risk", 2)], "company string, category string, score int")
    rows = {r["company"]: (r["status"], r["gap"], r["within_1"]) for r in evaluation.compare_with_labels(scores, found).collect()}
    assert rows == {"A": ("scored", 1, True), "B": ("n/a", None, False), "C": ("not run", None, False), "D": ("scored", -7, False)}
    total = evaluation.agreement(evaluation.compare_with_labels(scores, found)).first()
    assert (total["labels"], total["scored"], total["within_1"], total["total_gap"], total["largest_gap"]) == (4, 2, 1, 8, 7)
    tickers = spark.createDataFrame([("A",), ("B",)], "ticker string")
    labels.write_label_template(tickers, str(tmp_path / "t"))
    labels.write_label_template(tickers.limit(1), str(tmp_path / "t"))
    written = spark.read.option("header", True).csv(str(tmp_path / "t")).collect()
    assert len(written) == 12 and written[0]["company"] == "A" and written[0]["category"] == "FX Risk"


def test_hits_and_containing(spark):
    retrieved = spark.createDataFrame([("c", 1, "8", 4, "Harbour  dues\n11,402 10,953 x"), ("c", 2, "7", 1, "no"), ("d", 1, "7", 1, "no")], "check_name string, n int, section string, chunk_index int, text string")
    passages = spark.createDataFrame([("c", "Harbour dues 11,402 10,953"), ("d", "yes"), ("e", "x")], "check_name string, passage string")
    rows = {r["check_name"]: r for r in evaluation.check_retrieval(retrieved, passages).collect()}
    assert [tuple(x) for x in rows["c"]["hit"]] == [("8", 4)] and rows["d"]["hit"] == [] and rows["e"]["retrieved"] is None
    docs = spark.createDataFrame([(1, "alpha beta  gamma\ndelta"), (2, "xalpha beta gammay"), (3, "beta"), (4, None)], "doc_id long, text string")
    wanted = spark.createDataFrame([(1, "alpha beta gamma"), (2, "beta gamma"), (3, "eta"), (4, ""), (5, None), (6, "beta gamma delta")], "item_id long, passage string")
    assert {tuple(r) for r in evaluation.containing(docs, wanted).collect()} == {(1, 1), (2, 1), (1, 2), (2, 2), (1, 3), (2, 3), (3, 3), (1, 6)}
    assert evaluation.expected_passages(spark).select("check_name").distinct().count() == 10


SPECS = tomllib.loads("""
[T]
notes = ["One note."]
[[T.facts]]
id = "revenue"
topic = "scale"
label = "Revenue"
section = "8"
statement = "income"
quote = "Takings of the year | 2031: 52,310"
value = "52,310"
unit = "millions"
[[T.facts]]
id = "us"
topic = "fx"
label = "US"
section = "8"
quote = "US | 2031: $21.845"
value = "21.845"
unit = "billions"
[[T.facts]]
id = "policy"
topic = "fx"
label = "Policy"
section = "7A"
quote = "rarely buy cover"
[[T.ratios]]
topic = "fx"
label = "Outside"
numerator = ["revenue", "-us"]
denominator = ["revenue"]
""")


def test_fact_sheets(spark, tmp_path):
    facts, ratios, notes = fact_specs.fact_tables(spark, SPECS)
    rows = [("T", "8", "income", "Takings of the year | 2031: 52,310"), ("T", "8", "", "Takings of the year | 2031: 52,310 again"), ("T", "8", "", "US | 2031: $21.845"), ("T", "7A", "", "We rarely buy cover."), ("T", "7A", "", "We rarely buy cover.")]
    lines = spark.createDataFrame(rows, "ticker string, section string, statement string, text string")
    assert factsheets.fact_problems(lines, facts).count() == 0
    twice = lines.union(spark.createDataFrame([("T", "7A", "", "rarely buy cover, again")], lines.schema))
    assert [r["problem"] for r in factsheets.fact_problems(twice, facts).collect()] == ["quote found on 2 distinct lines of Item 7A"]
    bad = facts.withColumn("value", F.lit("1,000"))
    assert factsheets.fact_problems(lines, bad).count() == 3
    with pytest.raises(Exception, match="value 1,000 is not in the quote"):
        factsheets.fact_values(bad).collect()
    ratio = factsheets.ratio_values(ratios, factsheets.fact_values(facts)).first()
    assert (ratio["formula"], ratio["shown"], ratio["missing"]) == ("(52,310 - 21,845) / 52,310", "58.2%", [])
    sections = spark.createDataFrame([("T", "8", ""), ("T", "7A", "Item 7, Market Risk")], "ticker string, section string, resolved_from string")
    made = factsheets.sheets(pins.pins_table(spark, [PIN | {"ticker": "T"}]), sections, facts, ratios, notes)
    reports.write_sheets(made, str(tmp_path / "sheets"))
    (path,) = (tmp_path / "sheets" / "ticker=T").glob("part-*")
    sheet = path.read_text(encoding="utf-8")
    assert "- **Revenue**: “Takings of the year | 2031: 52,310” (Item 8 · Income statement)\n" in sheet and "(Item 7A (Item 7, Market Risk))" in sheet
    assert "| Outside | (52,310 - 21,845) / 52,310 | 58.2% |" in sheet and sheet.index("## Scale") < sheet.index("## FX") < sheet.index("## Interest") < sheet.index("## Notes")


#: ratio -> its operands and how it is shown, as fact sheets have them.
GOLDEN = [((21000 + 9000) / 60000, "50.0%"), (1234 / 60000, "2.1%"), (7 / 900, "0.78%"), (8.5 / 2, "4.2×"), (0.25, "25.0%"), (61 / 60, "1.0×"), (45 / 100000, "0.04%")]


def test_golden_ratios(spark):
    from lodestrata.functions.facts import ratio_text

    rows = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(GOLDEN)], "i int, v double").select("i", ratio_text(F.col("v")).alias("t")).orderBy("i").collect()
    assert [r["t"] for r in rows] == [t for _, t in GOLDEN]


def test_pins(spark, tmp_path):
    path = tmp_path / "filings.toml"
    with pytest.raises(pins.PinError, match="not found"):
        pins.read_pins(path)
    text = "[[filing]]\n" + "\n".join(f"{k} = {json.dumps(v)}" for k, v in PIN.items())
    path.write_text(text)
    row = pins.load_pins(spark, path).first()
    assert row["source_url"] == "https://www.sec.gov/Archives/edgar/data/7/0007251/a.htm" and row["cache_path"] == "ACME/0007-25-1/a.htm"
    path.write_text(text.replace('"10-K"', '"10-K/A"'))
    with pytest.raises(pins.PinError, match="only '10-K'"):
        pins.read_pins(path)
    path.write_text(text.replace('"Total revenues"', '""'))
    with pytest.raises(pins.PinError, match="revenue_line not pinned"):
        pins.read_pins(path)


class Answer:
    def __init__(self, body):
        self.body = body

    def __enter__(self):
        return self

    def __exit__(self, *a):
        return False

    def read(self):
        return self.body


def test_archive(spark, tmp_path):
    now, waits, asked, errors = [0.0], [], [], [503, 429]
    recent = {"form": ["10-Q", "10-K", "10-K/A", "10-K"], "accessionNumber": ["q", "0007-25-1", "z", "old"], "filingDate": ["a", "b", "c", "d"], "reportDate": ["a", "2025-12-30", "c", "d"], "primaryDocument": ["a", "a.htm", "c", "d"]}

    def opener(request, timeout):
        asked.append(request.full_url)
        if errors:
            raise urllib.error.HTTPError(request.full_url, errors.pop(0), "busy", {}, None)
        if "tickers" in request.full_url:
            return Answer(json.dumps({"0": {"cik_str": 7, "ticker": "ACME", "title": "Acme"}}).encode())
        return Answer(json.dumps({"filings": {"recent": recent}}).encode()) if "submissions" in request.full_url else Answer(b"<p>x</p>")

    client = archive.ArchiveClient("me me@example.com", opener, lambda s: (waits.append(s), now.__setitem__(0, now[0] + s)), lambda: now[0])
    assert archive.lookup_cik(spark, client, "acme") == (7, "Acme") and waits == [2, 4]
    with pytest.raises(LookupError):
        archive.lookup_cik(spark, client, "none")
    table = archive.recent_annual_reports(archive.submissions(spark, client, [7]))
    assert [(r["pos"], r["accession"]) for r in table.orderBy("pos").collect()] == [(0, "0007-25-1"), (1, "old")]
    verified = archive.verify_pins(pins.pins_table(spark, [PIN, PIN | {"accession": "none"}]), table).orderBy("accession").collect()
    assert [(r["problems"], r["ok"]) for r in verified] == [("period_end is 2025-12-30", False), ("accession not among recent 10-K filings", False)]
    assert archive.fetch([PIN], {PIN["accession"]: "https://x/a"}, client, tmp_path) == ["ACME"] and archive.fetch([PIN], {}, client, tmp_path) == []
    errors += [503, 503, 503]
    with pytest.raises(urllib.error.HTTPError):
        client.get("https://x/b")
    errors[:] = [404]
    with pytest.raises(urllib.error.HTTPError):
        client.get("https://x/c")
    with pytest.raises(ValueError, match="contact"):
        archive.ArchiveClient("nobody")


def test_sessions(spark):
    history = spark.createDataFrame([("s", 0, "user"), ("s", 1, "assistant")], "session_id string, turn long, role string")
    done = spark.createDataFrame([("s", "What?", "That.", "p", "c"), ("s", "Why?", None, None, None), ("new", "Who?", "I.", "p", "c")], "session_id string, question string, answer string, passages string, check string")
    rows = sorted(tuple(r) for r in sessions.next_turns(history, done).collect())
    assert [(r[0], r[1], r[2], r[3]) for r in rows] == [("new", 0, "user", "Who?"), ("new", 1, "assistant", "I."), ("s", 2, "user", "What?"), ("s", 3, "assistant", "That.")]
    check = spark.createDataFrame([((([1, 9], [9], ["$5"], None)),)], "c struct<cited: array<long>, invalid_citations: array<long>, unverified_figures: array<string>, approximate_ratios: array<string>>")
    told = check.select(sessions.check_warnings(F.col("c")), reports.citation_line(F.col("c"), F.array(F.lit(1)))).first()
    assert len(told[0]) == 2 and told[1] == "cited 1, 9 of 1 passages | invalid: 9 | unverified figures: $5"


def test_reports(spark, built, tmp_path):
    sections = sections_of(built["filings"]).withColumn("ticker", F.col("accession"))
    summary = reports.section_summary(sections).collect()
    assert all(r["missing"] == [] and r["chars"] > 1000 for r in summary)
    reports.write_sections(sections, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).count() == sections.count()
    row = spark.createDataFrame([("A", "FX Risk", 7, "scored", 6, 1, True), ("A", "FX Risk", None, "n/a", 6, None, False)], "a string, b string, m int, s string, l int, g int, w boolean")
    assert [r[0] for r in row.select(reports.comparison_line(*map(F.col, "abmslgw"))).collect()] == ["A       FX Risk                   7     6   +1  yes", "A       FX Risk                 n/a     6       no"]
    assert [r[0].split()[2:] for r in row.select(reports.score_line(F.col("b"), F.col("m"))).collect()] == [["7/10", "[HIGH]", "#######---"], ["n/a"]]
    path = reports.write_evaluation(row, str(tmp_path), "1000_150", "risk", datetime(2026, 1, 2, 3, 4, 5))
    assert path.endswith("risk_1000_150_20260102-030405.json") and spark.read.json(path).count() == 2


def test_context(spark):
    rows = spark.createDataFrame([([(1, "A", "x"), (2, "B", "y")],)], "p array<struct<n: int, label: string, text: string>>")
    assert rows.select(numbered_context(F.col("p"))).first()[0] == "[1] A\nx\n\n[2] B\ny"


def test_settings():
    made = Settings.from_env({"LLM_TEMPERATURE": "0.5", "GROQ_API_KEY": "k", "GROQ_MODEL": "m"})
    assert (made.temperature, made.api_key, made.llm_model) == (0.5, "k", "m") and "k'" not in repr(made)
    assert Settings.from_env({}).temperature == 0.1


def test_arriving_files(spark, built, tmp_path):
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for _ in range(2):  # the second run finds nothing new
        ingest_arrivals(built["pins"], str(built["root"] / "edgar"), out, mark).awaitTermination(120)
    assert spark.read.parquet(out).count() == built["chunks"].count()
