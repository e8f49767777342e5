"""Command line: preprocess, vectorize, cluster, export, analyze, chat, health, demo."""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import functions as F

from ticketloom.operators import reports
from ticketloom.operators.embed import embed_tasks, model_for
from ticketloom.operators.prepare import preprocess_tasks
from ticketloom.plans.chat import Agent
from ticketloom.plans.config import ALGORITHMS, ClusteringParameters
from ticketloom.plans.pipeline import cluster_tasks
from ticketloom.session import build_session
from ticketloom.sources import sinks, tickets

_NEEDED = ("pyspark", "pyarrow", "pandas", "numpy")
_OPTIONAL = ("openpyxl", "sentence_transformers")


def health() -> dict[str, str]:
    """Component -> healthy or missing."""

    def state(name: str) -> str:
        try:
            importlib.import_module(name)
        except ImportError:
            return "missing"
        return "healthy"

    import os

    return {n: state(n) for n in (*_NEEDED, *_OPTIONAL)} | {"data_directory": "accessible" if os.path.isdir("data") else "missing"}


def demo_distribution(tasks):
    """Rows by ordinal modulo three, with the first summary of each."""
    return tasks.groupBy(F.pmod("ord", F.lit(3)).alias("demo_cluster")).agg(F.count(F.lit(1)).alias("n"), F.min_by("summary", "ord").alias("first_summary"))


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ticketloom")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, files: bool = True):
        c = sub.add_parser(name)
        if files:
            c.add_argument("-i", "--input", required=True)
            c.add_argument("-o", "--output", required=name != "analyze")
        return c

    command("preprocess")
    command("demo")
    command("vectorize").add_argument("-m", "--model", default="all-MiniLM-L6-v2")
    for name in ("cluster", "analyze"):
        c = command(name)
        c.add_argument("-a", "--algorithm", default="hdbscan", choices=ALGORITHMS)
        c.add_argument("--min-size", type=int, default=10)
        c.add_argument("--epsilon", type=float, default=0.5)
    command("export").add_argument("-f", "--format", default="csv")
    for name in ("chat", "health"):
        command(name, files=False)
    return p


def main(argv: list[str] | None = None) -> int:
    """Exit code 0, or 1 for a missing input or an unknown export format."""
    a = _parser().parse_args(argv)
    if a.command == "health":
        for k, v in health().items():
            print(f"{k}: {v}")
        return 0
    spark = build_session()
    if a.command == "chat":
        return _chat(spark)
    if not tickets.path_exists(spark, a.input):
        print(f"Input file not found: {a.input}", file=sys.stderr)
        return 1
    if a.command == "preprocess":
        x = preprocess_tasks(tickets.load_tickets(spark, a.input))
        if x.isEmpty():
            print("No valid rows")
        else:
            sinks.write_tasks(x, a.output)
    elif a.command == "demo":  # any CSV: missing columns get defaults
        x = tickets.lenient_tasks(tickets.read_csv(spark, a.input)).withColumn("cluster_label", F.lit(None).cast("string"))
        demo_distribution(x).orderBy("demo_cluster").show(truncate=False)
        sinks.write_tasks(sinks.demo_sample(x, 10, "ord"), a.output)
    elif a.command == "vectorize":
        sinks.write_tasks(embed_tasks(tickets.read_processed(spark, a.input), model_for(a.model)), a.output)
    elif a.command in ("cluster", "analyze"):
        x = tickets.read_processed(spark, a.input) if a.command == "cluster" else embed_tasks(preprocess_tasks(tickets.load_tickets(spark, a.input)))
        r = cluster_tasks(x, ClusteringParameters(a.min_size, a.epsilon, algorithm=a.algorithm))
        sinks.show_report(r.report)
        if a.output:
            sinks.write_result(sinks.result_document(r.report, r.totals(), r.processing_time), a.output)
    elif a.command == "export":
        if a.format.lower() not in sinks.EXPORTS:
            print(f"Unsupported export format: {a.format}", file=sys.stderr)
            return 1
        doc = tickets.read_result(spark, a.input)
        sinks.export(doc, tickets.result_rows(doc), a.output, a.format)
    return 0


def _chat(spark) -> int:
    agent = Agent(spark)
    session = agent.create_session()
    print("Type a message; 'file PATH' to hand over a file, 'exit' to end.")
    for line in sys.stdin:
        text = line.strip()
        if text in ("exit", "quit"):
            break
        if text.startswith("file "):
            agent.sessions[session].context.update(file_uploaded=True, uploaded_file_path=text[5:].strip())
            print("Got it.")
        elif text:
            print(agent.process_message(session, text).message)
    agent.close()
    return 0


if __name__ == "__main__":
    sys.exit(main())
