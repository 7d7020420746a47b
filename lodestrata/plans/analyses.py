"""Queries of retrieval for scoring, of whole analyses with a model that answers by rule, and of what is kept and shown of them. A nation
(or a supplier) is a company."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.constants import CATEGORY_QUERIES, CATEGORY_QUOTAS, EXTRA_SEARCHES, SUMMARY_QUERY
from lodestrata.functions.presentation import gauge
from lodestrata.operators import answers, completion, evaluation, factsheets, flows, retrieval, scoring, sessions
from lodestrata.plans.registry import register, table
from lodestrata.session import cut_lineage, scratch
from lodestrata.sources import fact_specs, labels, pins, reports, results

_SECTIONS = ("1", "1A", "3", "7", "7A", "8")
_IN = ", ".join(f"'{s}'" for s in _SECTIONS)


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("ticker"), F.concat(F.lit("acc-"), "n_nationkey").alias("accession"))


_INCOME = "concat('(In millions)\\n', 'Total revenues | 2025: ', k + 100, '\\nOperating income | 2025: ', k + 10, '\\nNet income | 2025: ', k + 1)"
_BALANCE = "concat('(In millions)\\nCurrent assets:\\nCash and cash equivalents | 2025: ', k + 5, '\\nInventories | 2025: 3\\nNon-current liabilities:\\nTerm debt | 2025: ', k + 7, '\\nTerm debt | 2025: ', k + 7)"


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five chunks of each Item of each nation; the first of Item 8 is an income statement, the second a balance sheet. The lower its number, the
    nearer a chunk is to any question. Item 7A of every third nation is unresolved, of every third missing."""
    n = _nations(spark, sf_dir)
    each = n.select("*", F.explode(F.array(*map(F.lit, _SECTIONS))).alias("section")).select("*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("chunk_index")).filter("section <> '7A' OR k % 3 <> 2")
    kind = F.when(F.col("section") == "8", F.when(F.col("chunk_index") == 0, "income").when(F.col("chunk_index") == 1, "balance_sheet")).otherwise(F.lit(None))
    text = F.when(kind == "income", F.expr(_INCOME)).when(kind == "balance_sheet", F.expr(_BALANCE)).otherwise(F.concat_ws(" ", F.lit("Text"), "section", "chunk_index", "k"))
    return each.select(
        "k", "ticker", "accession", "section", "chunk_index", F.coalesce(kind, F.lit("")).alias("statement"), text.alias("text"), F.array(F.lit(1.0).cast("float"), (-F.col("chunk_index") / 10.0).cast("float")).alias("embedding"),
        F.lit("own").alias("content_source_own"), F.when((F.col("section") == "7A") & (F.col("k") % 3 == 1), "short_unresolved").otherwise("own").alias("content_source"),
        F.concat(F.lit("Company "), "k").alias("company"), F.lit("10-K").alias("form"), F.lit(2025).alias("fiscal_year"), F.concat(F.lit("Title "), "section").alias("section_title"), F.lit("").alias("resolved_from"), F.lit("https://example.org").alias("source_url"),
    ).drop("content_source_own")


def _pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    lit = lambda name, value: F.lit(value).alias(name)
    return _nations(spark, sf_dir).select("ticker", "accession", lit("revenue_line", "Total revenues"), lit("operating_income_line", "Operating income"), lit("net_income_line", "Net income"))


_N_SQL = "n AS (SELECT n_nationkey AS k, n_name AS ticker FROM nation)"
_INCOME_SQL = "concat('(In millions)', chr(10), 'Total revenues | 2025: ', k + 100, chr(10), 'Operating income | 2025: ', k + 10, chr(10), 'Net income | 2025: ', k + 1)"
_BALANCE_SQL = "concat('(In millions)', chr(10), 'Current assets:', chr(10), 'Cash and cash equivalents | 2025: ', k + 5, chr(10), 'Non-current liabilities:', chr(10), 'Term debt | 2025: ', k + 7)"


@register("derived_passages", f"WITH {_N_SQL} SELECT ticker, -1 AS chunk_index, 'income' AS statement, {_INCOME_SQL} AS text FROM n UNION ALL SELECT ticker, -2, 'balance_sheet', {_BALANCE_SQL} FROM n")
def derived_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    both = retrieval.scale_passages(chunks, _pins(spark, sf_dir)).unionByName(retrieval.balance_sheet_passages(chunks))
    return both.select("ticker", "chunk_index", "statement", "text")


def _quota_values() -> str:
    rows = []
    for category, quotas in CATEGORY_QUOTAS.items():
        for no, wanted in enumerate([quotas] + ([EXTRA_SEARCHES[category][1]] if category in EXTRA_SEARCHES else [])):
            rows += [f"('{category}', {no}, {i}, '{s}', {k})" for i, (s, k) in enumerate(wanted.items())]
    return ", ".join(rows)


def _vectors(spark: SparkSession) -> DataFrame:
    queries = [*CATEGORY_QUERIES.values(), *(q for q, _ in EXTRA_SEARCHES.values()), SUMMARY_QUERY]
    return spark.createDataFrame([(q, [1.0, 1.0]) for q in queries], "query string, vector array<float>")


_READS_SQL = f"""
{_N_SQL},
q(category, no, o, section, q) AS (VALUES {_quota_values()}),
u AS (
  SELECT n.k, n.ticker, q.* FROM n CROSS JOIN q
  UNION ALL SELECT n.k, n.ticker, q.category, 0, 99, '7', 2 FROM n CROSS JOIN q WHERE q.section = '7A' AND q.no = 0 AND n.k % 3 <> 0),
g AS (SELECT k, ticker, category, no, section, min(o) AS o, max(q) AS q FROM u GROUP BY ALL),
r AS (SELECT *, unnest(range(0, q)) AS i FROM g WHERE section <> '7A' OR k % 3 <> 2),
f AS (SELECT ticker, category, section, i, min(no * 1000000 + o * 1000 + i) AS pos FROM r GROUP BY ALL)
"""


@register("category_reads", f"WITH {_READS_SQL} SELECT ticker, category, CAST(row_number() OVER (PARTITION BY ticker, category ORDER BY pos) AS INTEGER) AS n, section, CAST(i AS INTEGER) AS chunk_index FROM f")
def category_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    quotas = retrieval.section_quotas(retrieval.item_7a_sources(chunks, _nations(spark, sf_dir)))
    return retrieval.category_chunks(chunks.drop("k"), quotas, _vectors(spark)).select("ticker", "category", "n", "section", "chunk_index")


@register(
    "question_reads",
    f"""
WITH {_N_SQL},
c AS (SELECT k, ticker, s.section, i.i FROM n CROSS JOIN (SELECT unnest([{_IN}]) AS section) s CROSS JOIN (SELECT unnest(range(0, 5)) AS i) i WHERE section <> '7A' OR k % 3 <> 2),
a AS (SELECT ticker, section, i, 0 AS b, row_number() OVER (PARTITION BY ticker ORDER BY i, section) AS r FROM c),
u AS (SELECT * FROM a WHERE r <= 3 UNION ALL SELECT ticker, '8', 0, 1, 1 FROM n UNION ALL SELECT ticker, '8', 0, 2, 1 FROM n),
o AS (SELECT ticker, section, i, min(b * 100 + r) AS pos FROM u GROUP BY ALL)
SELECT ticker AS question_id, CAST(row_number() OVER (PARTITION BY ticker ORDER BY pos) AS INTEGER) AS n, section, CAST(i AS INTEGER) AS chunk_index FROM o
""",
)
def question_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _nations(spark, sf_dir).select(F.col("ticker").alias("question_id"), "ticker", F.array(F.lit(1.0), F.lit(1.0)).cast("array<float>").alias("vector"))
    return retrieval.retrieve_for_questions(_chunks(spark, sf_dir).drop("k"), asked).select("question_id", "n", "section", "chunk_index")


def rule_client(refuses: bool = True):
    """A model that scores by the revenue in its prompt and the name of the category, and refuses some calls for a moment."""
    import re

    from lodestrata.operators.completion import RateLimited

    class Ruled:
        refused: set = set()

        def complete(self, prompt, max_tokens, temperature):
            if "Sum up its risk profile" in prompt:
                return " Overall " + re.search(r"Overall: (\d+)", prompt)[1] + ". "
            if "You rate one risk" not in prompt:
                return "Revenues were $" + re.search(r"Total revenues \| 2025: (\d+)", prompt)[1] + " million [1] and 77,777 [9]."
            revenue, category = int(re.search(r"Total revenues \| 2025: (\d+)", prompt)[1]), re.search(r"from 1 to 10: (.*)\.", prompt)[1]
            if refuses and revenue % 5 == 0 and (revenue, category) not in self.refused:
                self.refused.add((revenue, category))
                raise RateLimited("requests per minute", "0")
            score = (revenue + len(category)) % 12
            return f"SCORE: {score}\nREASON: Revenues of ${revenue} million [1]."

    return Ruled()


def _limited(calls: int):
    def make():
        from lodestrata.operators.completion import RateLimited

        ruled = rule_client(False)

        class Limited:
            n = 0

            def complete(self, prompt, max_tokens, temperature):
                self.n += 1
                if self.n > calls:
                    raise RateLimited("tokens per day (TPD)")
                return ruled.complete(prompt, max_tokens, temperature)

        return Limited()

    return make


_CATEGORIES = ", ".join(f"({i}, '{c}')" for i, c in enumerate(CATEGORY_QUERIES))
_SCORES_SQL = f"""
{_N_SQL},
c(o, category) AS (VALUES {_CATEGORIES}),
x AS (SELECT k, ticker, o, category, (k + 100 + length(category)) % 12 AS s FROM n CROSS JOIN c),
y AS (SELECT *, CASE WHEN s BETWEEN 1 AND 10 THEN CAST(s AS INTEGER) END AS score FROM x),
z AS (SELECT ticker, CASE WHEN count(score) >= 4 THEN CAST(round_even(sum(score) / (10.0::DOUBLE * count(score)) * 100, 0) AS INTEGER) END AS overall, count(score) AS scored FROM y GROUP BY ticker)
"""


def _search(chunks: DataFrame) -> DataFrame:
    return chunks.drop("k")


@register(
    "risk_scores",
    f"""WITH {_SCORES_SQL} SELECT ticker, o AS cat_ord, category, score, CASE WHEN score IS NULL THEN 'Could not parse model response' ELSE concat('Revenues of $', k + 100, ' million [1].') END AS reason,
  CASE WHEN score IS NULL THEN '' ELSE '1' END AS cited, '' AS unverified FROM y""",
)
def risk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = cut_lineage(scoring.score_categories(_search(_chunks(spark, sf_dir)), _pins(spark, sf_dir), _vectors(spark), rule_client))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return scores.select("ticker", "cat_ord", "category", "score", "reason", text(F.col("check.cited")).alias("cited"), text(F.col("check.unverified_figures")).alias("unverified"))


@register(
    "risk_totals",
    f"""WITH {_SCORES_SQL} SELECT ticker, overall, CASE WHEN overall < 40 THEN 'Low' WHEN overall < 70 THEN 'Medium' WHEN overall IS NOT NULL THEN 'High' END AS level, scored, 6::BIGINT AS categories,
  CASE WHEN overall IS NULL THEN 'Fewer than 4 of 6 risk categories could be scored, so no summary was generated.' ELSE concat('Overall ', overall, '.') END AS summary FROM z""",
)
def risk_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, vectors = _search(_chunks(spark, sf_dir)), _vectors(spark)
    scores = cut_lineage(scoring.score_categories(chunks, _pins(spark, sf_dir), vectors, rule_client))
    return scoring.summaries(chunks, scores, vectors, rule_client).select("ticker", "overall", "level", "scored", "categories", "summary")


class _Flat:
    """An embedder to which all texts are alike."""

    def embed(self, texts):
        import numpy as np

        return np.ones((len(texts), 2), np.float32)


@register("risk_partial", "SELECT 7::BIGINT AS n_scores, 'daily quota exhausted: tokens per day (TPD)' AS reason")
def risk_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is kept of a run whose quota ends after seven calls, and why it ended."""
    scores, reason = flows.score_risk(_search(_chunks(spark, sf_dir)), _pins(spark, sf_dir), _limited(7), _Flat)
    return scores.agg(F.count("*").alias("n_scores")).withColumn("reason", F.lit(reason))


@register(
    "results_kept",
    f"""WITH {_SCORES_SQL} SELECT ticker, 'first' AS source, overall, category, score FROM y JOIN z USING (ticker)""",
)
def results_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that are saved, kept where a later run is refused, and loaded again."""
    chunks, table_, path = _search(_chunks(spark, sf_dir)), _pins(spark, sf_dir), scratch(spark, "results")
    flows.run_and_cache(chunks, table_, rule_client, path, "first", _Flat, "2026-01-01 10:00")
    flows.run_and_cache(chunks, table_, _limited(0), path, "second", _Flat, "2026-01-02 10:00")
    kept = results.with_results(table_, results.load_results(spark, path))
    return kept.select("ticker", "source", F.col("results.overall").alias("overall"), F.explode("results.scores").alias("category", "s")).select("ticker", "source", "overall", "category", "s.score")


@register(
    "metric_answers",
    f"""WITH {_N_SQL}, q AS (SELECT unnest(['revenue', 'net_income']) AS name)
SELECT concat(ticker, ' ', name) AS question_id, concat('Revenues were $', k + 100, ' million [1] and 77,777 [9].') AS answer, '1,9' AS cited, '9' AS invalid, '77,777' AS unverified, false AS stated FROM n CROSS JOIN q""",
)
def metric_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of an evaluation, their answers and checks. The first passage is an Item's first chunk, which is the statement if only Item 8 is there."""
    chunks = _search(_chunks(spark, sf_dir)).filter("section = '8'")
    found, _, _ = flows.run_llm_metrics(chunks, _pins(spark, sf_dir), rule_client, _Flat)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return found.select("question_id", "answer", text(F.col("check.cited")).alias("cited"), text(F.col("check.invalid_citations")).alias("invalid"), text(F.col("check.unverified_figures")).alias("unverified"), F.element_at("stated", "94,827").alias("stated"))


@register("replies_kept", "SELECT conv_id, turn, concat(text, '!') AS reply FROM conversations WHERE text IS NOT NULL")
def replies_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies that are written step by step, a refused call in each."""

    def echo():
        from lodestrata.operators.completion import RateLimited

        class Echo:
            n = 0

            def complete(self, prompt, max_tokens, temperature):
                self.n += 1
                if self.n == 2:
                    raise RateLimited("requests per minute", "0")
                return prompt + "!"

        return Echo()

    rows = table(spark, sf_dir, "conversations").filter("text IS NOT NULL").select("conv_id", "turn", F.col("text").alias("prompt"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"))
    return completion.complete_kept(rows, "id", scratch(spark, "replies"), echo, None, steps=3).select("conv_id", "turn", "reply")


@register(
    "labels_read",
    "SELECT n_name AS company, 'FX Risk' AS category, CAST(n_nationkey % 10 + 1 AS INTEGER) AS label, CASE WHEN n_nationkey % 2 = 0 THEN concat('say \"', n_nationkey, '\", or', chr(10), 'so') ELSE '' END AS reason FROM nation WHERE n_nationkey % 3 <> 0",
)
def labels_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels from CSV: rows without a score are left out, quotes and line ends are kept."""
    path = scratch(spark, "labels")
    n = F.col("k")
    rows = _nations(spark, sf_dir).select(F.col("ticker").alias("company"), F.lit("FX Risk").alias("category"), F.when(n % 3 == 0, " ").otherwise((n % 10 + 1).cast("string")).alias("my_score"), F.when(n % 2 == 0, F.concat(F.lit('say "'), n, F.lit('", or\nso'))).otherwise("").alias("my_reason"))
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return labels.read_labels(spark, path)


@register("label_template_written", "SELECT n_name AS company, count(*) AS n FROM nation CROSS JOIN (SELECT unnest(range(0, 6))) GROUP BY n_name")
def label_template_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template is written once; what is there stays."""
    path = scratch(spark, "template")
    labels.write_label_template(_nations(spark, sf_dir).select("ticker"), path)
    labels.write_label_template(_nations(spark, sf_dir).select("ticker").limit(1), path)
    return spark.read.option("header", True).csv(path).groupBy("company").agg(F.count("*").alias("n"))


_SPECS = """
[A]
notes = ["One note.", "Two."]
[[A.facts]]
id = "r"
topic = "scale"
label = "Revenue"
section = "8"
statement = "income"
quote = "Revenue | 2025: 1,000"
value = "1,000"
unit = "millions"
[[A.facts]]
id = "p"
topic = "fx"
label = "Policy"
section = "7A"
quote = "We rarely buy cover."
[B]
[[B.ratios]]
topic = "fx"
label = "Share"
numerator = ["r", "-p"]
denominator = ["r"]
"""


@register(
    "facts_read",
    """SELECT * FROM (VALUES ('fact', 'A', 0, 'r', 'Revenue | 2025: 1,000', '1,000', 'income'), ('fact', 'A', 1, 'p', 'We rarely buy cover.', NULL, NULL), ('note', 'A', 0, NULL, 'One note.', NULL, NULL), ('note', 'A', 1, NULL, 'Two.', NULL, NULL),
  ('ratio', 'B', 0, NULL, 'r,-p / r', NULL, NULL)) AS t(kind, ticker, ord, id, text, value, statement)""",
)
def facts_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, ratios, notes = fact_specs.fact_tables(spark, tomllib.loads(_SPECS))
    none = F.lit(None).cast("string")
    sides = F.concat_ws(" / ", F.array_join("numerator", ","), F.array_join("denominator", ","))
    rows = facts.select(F.lit("fact").alias("kind"), "ticker", "ord", "id", F.col("quote").alias("text"), "value", "statement")
    rows = rows.union(notes.select(F.lit("note"), "ticker", "ord", none, "note", none, none))
    return rows.union(ratios.select(F.lit("ratio"), "ticker", "ord", none, sides, none, none))


@register("pins_loaded", "SELECT n_name AS ticker, n_nationkey AS cik, concat('https://www.sec.gov/Archives/edgar/data/', n_nationkey, '/00', n_nationkey, '/a.htm') AS source_url, concat(n_name, '/00-', n_nationkey, '/a.htm') AS cache_path FROM nation")
def pins_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry's records, a catalogue of a fixed number of companies, as a table with the addresses that follow."""
    rows = [{"ticker": r["ticker"], "cik": r["k"], "accession": f"00-{r['k']}", "primary_document": "a.htm"} for r in _nations(spark, sf_dir).collect()]
    return pins.pins_table(spark, rows).select("ticker", "cik", "source_url", "cache_path")


@register(
    "evaluation_written",
    "SELECT o_custkey AS company, CAST(count(*) AS BIGINT) AS n, CASE WHEN count(*) % 2 = 0 THEN CAST(count(*) AS INTEGER) END AS score FROM orders GROUP BY o_custkey",
)
def evaluation_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An evaluation as one JSON table, nulls told, read back."""
    counted = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("company")).agg(F.count("*").alias("n")).withColumn("score", F.when(F.col("n") % 2 == 0, F.col("n").cast("int")))
    path = reports.write_evaluation(counted, scratch(spark, "evaluation"), "1000_150", "scores")
    return spark.read.schema("company long, n long, score int").json(path)


@register("sheets_written", "SELECT n_name AS ticker, concat('# ', n_name, chr(10), chr(10), '“Sales”', chr(10)) AS sheet FROM nation")
def sheets_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch(spark, "sheets")
    reports.write_sheets(_nations(spark, sf_dir).select("ticker", F.concat(F.lit("# "), "ticker", F.lit("\n\n“Sales”")).alias("sheet")), root)
    return spark.read.text(root, wholetext=True).select("ticker", F.col("value").alias("sheet"))


_S = "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 10 + 1 AS INTEGER) END"


@register(
    "console_lines",
    f"""
WITH s AS (SELECT o_orderkey AS k, {_S} AS s, CAST(o_orderkey % 7 + 1 AS INTEGER) AS l FROM orders)
SELECT k, concat(rpad('FX Risk', 20, ' '), ' ', CASE WHEN s IS NULL THEN 'n/a' ELSE concat(s, '/10  [', CASE WHEN s < 4 THEN 'LOW' WHEN s < 7 THEN 'MEDIUM' ELSE 'HIGH' END, ']  ', repeat('#', s), repeat('-', 10 - s)) END) AS score_line,
  concat(rpad(CAST(k AS VARCHAR), 8, ' '), rpad('FX Risk', 20, ' '), lpad(CASE WHEN s IS NULL THEN 'n/a' ELSE CAST(s AS VARCHAR) END, 7, ' '), lpad(CAST(l AS VARCHAR), 6, ' '),
    lpad(CASE WHEN s IS NULL THEN '' ELSE concat(CASE WHEN s >= l THEN '+' ELSE '' END, s - l) END, 5, ' '), '  ', CASE WHEN abs(s - l) <= 1 THEN 'yes' ELSE 'no' END) AS comparison_line FROM s
""",
)
def console_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.expr(_S).alias("s"), (F.col("o_orderkey") % 7 + 1).cast("int").alias("label"))
    compared = evaluation.compare_with_labels(rows.select("k", F.col("s").alias("score")), rows.select("k", "label"), ["k"])
    line = reports.comparison_line(F.col("k").cast("string"), F.lit("FX Risk"), *map(F.col, ("model", "status", "label", "gap", "within_1")))
    return compared.select("k", reports.score_line(F.lit("FX Risk"), F.col("model")).alias("score_line"), line.alias("comparison_line"))


@register(
    "citation_lines",
    "SELECT conv_id, turn, concat('cited ', CASE turn % 3 WHEN 0 THEN 'nothing' WHEN 1 THEN '1' ELSE '1, 5' END, ' of 2 passages | invalid: ', CASE WHEN turn % 3 = 2 THEN '5' ELSE 'none' END, ' | unverified figures: ', CASE WHEN turn % 3 = 0 THEN 'none' ELSE '$999' END) AS line FROM conversations",
)
def citation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.functions.figures import check_answer

    said = F.expr("CASE turn % 3 WHEN 0 THEN 'nothing' WHEN 1 THEN 'Sales of $999 [1].' ELSE 'Sales of $999 and 120 [1][5].' END")
    passages = F.expr("array(named_struct('n', 1, 'text', 'It was 120.'), named_struct('n', 2, 'text', '999'))")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", said.alias("said"), passages.alias("passages"))
    return rows.select("conv_id", "turn", reports.citation_line(check_answer(F.col("said"), F.col("passages")), F.col("passages")).alias("line"))


@register("fact_amounts", "SELECT p_brand AS ticker, CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size * CASE WHEN p_partkey % 2 = 0 THEN 1000.0::DOUBLE ELSE 1.0::DOUBLE END END AS amount FROM part")
def fact_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of facts, which must stand in their quotes; none of facts without a value."""
    part, size = table(spark, sf_dir, "part"), F.col("p_size").cast("string")
    facts = part.select(F.col("p_brand").alias("ticker"), F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit("Size of "), size).alias("quote"), F.when(F.col("p_partkey") % 3 != 0, size).alias("value"), F.when(F.col("p_partkey") % 2 == 0, "billions").otherwise("millions").alias("unit"))
    return factsheets.fact_values(facts)


@register(
    "fact_scopes",
    """WITH l AS (SELECT s_nationkey AS ticker, CASE WHEN s_suppkey % 2 = 0 THEN 'income' ELSE '' END AS statement, s_name AS text FROM supplier)
SELECT ticker, f.id, l.text FROM l CROSS JOIN (VALUES ('whole', NULL), ('part', 'income')) AS f(id, statement) WHERE f.statement IS NULL OR f.statement = l.statement""",
)
def fact_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("ticker"), F.lit("8").alias("section"), F.when(F.col("s_suppkey") % 2 == 0, "income").otherwise("").alias("statement"), F.col("s_name").alias("text"))
    facts = rows.select("ticker").distinct().select("ticker", F.lit("8").alias("section"), F.inline(F.expr("array(named_struct('id', 'whole', 'statement', CAST(NULL AS STRING)), named_struct('id', 'part', 'statement', 'income'))")))
    return factsheets.scope_lines(rows, facts)


@register(
    "gauges",
    "SELECT o_orderkey, CAST(o_orderkey % 101 AS INTEGER) AS value, CASE WHEN o_orderkey % 101 < 40 THEN 'Low' WHEN o_orderkey % 101 < 70 THEN 'Medium' ELSE 'High' END AS level, CASE WHEN o_orderkey % 101 < 40 THEN '#28a745' WHEN o_orderkey % 101 < 70 THEN '#ffc107' ELSE '#dc3545' END AS color, 3 AS steps FROM orders",
)
def gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "orders").select("o_orderkey", gauge((F.col("o_orderkey") % 101).cast("int")).alias("g"))
    return g.select("o_orderkey", "g.value", "g.level", "g.color", F.size("g.steps").alias("steps"))


@register(
    "conversation_turns",
    """
WITH h AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id),
q AS (SELECT conv_id, last, concat('Q', conv_id) AS question, CASE WHEN conv_id % 3 <> 0 THEN concat('A', conv_id) END AS answer FROM h)
SELECT conv_id, CAST(last + 1 AS BIGINT) AS turn, 'user' AS role, question AS content FROM q WHERE answer IS NOT NULL UNION ALL SELECT conv_id, CAST(last + 2 AS BIGINT), 'assistant', answer FROM q WHERE answer IS NOT NULL
""",
)
def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's turn and an assistant's after the last one, where there is an answer; nothing where the call was refused."""
    history = table(spark, sf_dir, "conversations")
    c = F.col("conv_id").cast("string")
    answered = history.select("conv_id").distinct().select("conv_id", F.concat(F.lit("Q"), c).alias("question"), F.when(F.col("conv_id") % 3 != 0, F.concat(F.lit("A"), c)).alias("answer"), F.array().cast("array<string>").alias("passages"), F.lit(None).cast("string").alias("check"))
    return sessions.next_turns(history, answered, "conv_id").select("conv_id", "turn", "role", "content")


@register(
    "answer_warnings",
    "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '' ELSE 'Cites passages that are not there: 7;Figures found in no cited passage: $55,555' END AS warnings, CASE WHEN turn % 2 = 0 THEN '2' ELSE '1' END AS cited, CASE WHEN turn % 2 = 0 THEN '1' ELSE '2' END AS others FROM conversations",
)
def answer_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestrata.functions.figures import check_answer

    said = F.expr("IF(turn % 2 = 0, 'It was 120 [2].', 'It was $55,555 [1][7].')")
    passages = F.expr("array(named_struct('n', 1, 'text', 'none'), named_struct('n', 2, 'text', 'It was 120.'))")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", said.alias("said"), passages.alias("passages"))
    marked = answers.marked_passages(F.col("passages"), F.col("said"))
    shown = rows.select("conv_id", "turn", sessions.check_warnings(check_answer(F.col("said"), F.col("passages"))).alias("w"), sessions.split_by_citation(marked).alias("s"))
    numbers = lambda c: F.array_join(F.transform(c, lambda p: p["n"].cast("string")), ",")
    return shown.select("conv_id", "turn", F.array_join("w", ";").alias("warnings"), numbers(F.col("s.cited")).alias("cited"), numbers(F.col("s.others")).alias("others"))


@register("filings_ready", "SELECT n_name AS ticker, n_nationkey % 2 = 0 AS analysed FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey)")
def filings_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _nations(spark, sf_dir)
    chunks = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("k")).select("ticker")
    return sessions.ready_filings(n, chunks, n.filter("k % 2 = 0")).select("ticker", "analysed")
