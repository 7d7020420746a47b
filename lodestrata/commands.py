"""Command flows: python -m lodestrata ingest | evaluate | factsheets. Each checks all that it needs first, and writes all or nothing."""

from __future__ import annotations

import argparse
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from lodestrata.operators.completion import Client
from lodestrata.operators.embedding import Embedder, HashingEmbedder
from lodestrata.operators.evaluation import agreement, check_retrieval, compare_with_labels, expected_passages, risk_overview
from lodestrata.operators.factsheets import fact_problems, sheets
from lodestrata.operators.flows import evaluation_questions, score_risk
from lodestrata.operators.ingest import ingest, sections_of
from lodestrata.operators.retrieval import retrieve_for_questions
from lodestrata.operators.services import ChatClient, SentenceEmbedder
from lodestrata.operators.statements import statement_lines
from lodestrata.session import cut_lineage
from lodestrata.sources import archive, fact_specs, labels, pins, reports, store
from lodestrata.sources.settings import Settings


class CommandError(ValueError):
    """A command can't do its work, and has written nothing."""


def ingest_command(spark: SparkSession, pin_file: str, filings_root: str, store_path: str, make: Callable[[], Embedder] = HashingEmbedder) -> list[str]:
    """Rebuild the chunk store from the cached filings; a line for each filing. Raises before anything is written if one is unfit."""
    table = pins.load_pins(spark, pin_file)
    counts = ingest(table, archive.read_filings(spark, filings_root), store_path, make)
    return [f"{r['ticker']}: {r['total']} chunks (" + ", ".join(f"Item {c}: {r[c]}" for c in counts.columns if c not in ("ticker", "total", "other")) + ")" for r in counts.orderBy("ticker").collect()]


def retrieval_report(chunks: DataFrame, table: DataFrame, make: Callable[[], Embedder] = HashingEmbedder) -> DataFrame:
    """check_name, hit, retrieved of the checks whose filings are there."""
    asked = evaluation_questions(table, make)
    found = retrieve_for_questions(chunks, asked).withColumn("check_name", F.replace("question_id", F.lit(" "), F.lit("_")))
    wanted = expected_passages(chunks.sparkSession)
    return check_retrieval(found.select("check_name", "n", "section", "chunk_index", "text"), wanted.join(found.select("check_name").distinct(), "check_name", "left_semi"))


def evaluate_command(spark: SparkSession, pin_file: str, store_path: str, label_file: str, out: str, client: Callable[[], Client] | None = None, make: Callable[[], Embedder] = HashingEmbedder) -> list[str]:
    """The retrieval checks and, with a client, the scores against labels; written under out, and told in lines."""
    table = pins.load_pins(spark, pin_file)
    try:
        chunks = store.read_chunks(spark, store_path)
    except AnalysisException as error:
        raise CommandError(f"no store at {store_path}: ingest first") from error
    if not store.has_documents(chunks):
        raise CommandError(f"no chunks at {store_path}: ingest first")
    known = labels.read_labels(spark, label_file) if client else None
    checks = cut_lineage(retrieval_report(chunks, table, make))
    lines = [f"{r['check_name']}: {'hit' if r['hit'] else 'MISS'} ({len(r['retrieved'] or [])} retrieved)" for r in checks.orderBy("check_name").collect()]
    reports.write_evaluation(checks, out, "retrieval")
    if client is None:
        return lines
    scores, stopped = score_risk(chunks, table, client, make)
    named = scores.withColumnRenamed("ticker", "company")
    compared = cut_lineage(compare_with_labels(named, known))
    shown = compared.select(reports.comparison_line(*map(F.col, ("company", "category", "model", "status", "label", "gap", "within_1"))).alias("line"))
    lines += [r["line"] for r in shown.orderBy("line").collect()]
    whole = agreement(compared).first()
    lines.append(f"within 1: {whole['within_1']} of {whole['labels']}; total gap {whole['total_gap']}, largest {whole['largest_gap']}")
    lines += [f"{r['company']}: overall {r['overall'] if r['complete'] else 'incomplete'}" for r in risk_overview(named).orderBy("company").collect()]
    reports.write_evaluation(compared, out, "scores")
    return lines + ([f"stopped: {stopped}"] if stopped else [])


def factsheets_command(spark: SparkSession, pin_file: str, filings_root: str, fact_file: str, out: str, label_out: str) -> list[str]:
    """The fact sheets and the label template, if every quote stands on one line of its filing; else CommandError and nothing."""
    table = pins.load_pins(spark, pin_file)
    facts, ratios, notes = fact_specs.read_facts(spark, fact_file)
    sections = cut_lineage(sections_of(archive.read_filings(spark, filings_root)).join(table.select("accession", "ticker"), "accession"))
    lines = statement_lines(sections, "ticker").select("ticker", "section", "statement", "text")
    problems = fact_problems(lines, facts).orderBy("ticker", "id").limit(20).collect()
    if problems:
        raise CommandError("; ".join(f"{r['ticker']} {r['id']}: {r['problem']}" for r in problems))
    made = cut_lineage(sheets(table, sections, facts, ratios, notes))
    reports.write_sheets(made, out)
    labels.write_label_template(table.select("ticker"), label_out)
    return [f"{r['ticker']}: {len(r['sheet'])} characters" for r in made.orderBy("ticker").collect()]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodestrata")
    parser.add_argument("command", choices=("ingest", "evaluate", "factsheets"))
    for name, default in (("pins", "filings.toml"), ("filings", "data/edgar"), ("store", "data/chunks"), ("labels", "data/labels"), ("facts", "facts.toml"), ("out", "data/out"), ("chat-url", "")):
        parser.add_argument(f"--{name}", default=default)
    parser.add_argument("--sentence-model", action="store_true", help="embed by the model of EMBED_MODEL, not by hashing")
    args, settings = parser.parse_args(argv), Settings.from_env()
    spark = spark or SparkSession.builder.appName("lodestrata").getOrCreate()
    make = partial(SentenceEmbedder, settings.embed_model) if args.sentence_model else HashingEmbedder
    client = partial(ChatClient, args.chat_url, settings.llm_model, settings.api_key) if args.chat_url else None
    try:
        if args.command == "ingest":
            lines = ingest_command(spark, args.pins, args.filings, args.store, make)
        elif args.command == "evaluate":
            lines = evaluate_command(spark, args.pins, args.store, args.labels, args.out, client, make)
        else:
            lines = factsheets_command(spark, args.pins, args.filings, args.facts, args.out, args.labels)
    except ValueError as error:
        print(f"error: {error}")
        return 1
    print("\n".join(lines))
    return 0
