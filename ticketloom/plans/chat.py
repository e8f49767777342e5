"""Rule-based chat front end over the plans. Sessions live on the driver; data stays in DataFrames."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from ticketloom.functions.intents import INTENTS, PARAMETERS
from ticketloom.operators import reports
from ticketloom.operators.embed import Embedder, embed_tasks
from ticketloom.operators.prepare import preprocess_tasks
from ticketloom.plans.config import ClusteringParameters
from ticketloom.plans.pipeline import cluster_tasks
from ticketloom.sources.tickets import load_tickets

HELP = "I can load a ticket file, cluster its tickets, show or export the results, and change parameters. Try: load data, cluster analysis, show results, change parameters."
UNKNOWN = "I did not understand that. Ask for help to see what I can do."
#: Words that mean an upload, and one that means it is done.
UPLOAD_WORDS = ("文件", "上传", "导入")
UPLOADED = "已上传"


@dataclass
class Reply:
    message: str
    action_required: str | None = None
    parameters: dict | None = None
    context_updates: dict | None = None


@dataclass
class Session:
    session_id: str
    messages: list[dict] = field(default_factory=list)
    context: dict = field(default_factory=dict)
    created_at: datetime = field(default_factory=lambda: datetime.now(timezone.utc))
    last_activity: datetime = field(default_factory=lambda: datetime.now(timezone.utc))

    def add(self, role: str, content: str) -> None:
        if role not in ("user", "assistant", "system") or not content:
            raise ValueError("a message needs a known role and content")
        self.last_activity = datetime.now(timezone.utc)
        self.messages.append({"role": role, "content": content, "timestamp": self.last_activity})

    def release(self) -> None:
        """Give back what the session keeps in memory."""
        if (tasks := self.context.pop("processed_tasks", None)) is not None:
            tasks.unpersist()
        if result := self.context.pop("clustering_result", None):
            result.release()


def recognize_intent(message: str, table: dict = INTENTS) -> str:
    """As functions.intents.intent, for one message."""
    low = message.lower()
    return next((name for name, patterns in table.items() if any(re.search(p, low) for p in patterns)), "unknown")


def extract_parameter(message: str, name: str, default=None):
    for p in PARAMETERS.get(name, ()):
        if m := re.search(p, message, re.IGNORECASE):
            return int(m[1]) if name == "min_size" else float(m[1])
    return default


class Agent:
    def __init__(self, spark: SparkSession, embedder: Embedder | None = None):
        self.spark, self.embedder, self.sessions = spark, embedder, {}

    def create_session(self) -> str:
        key = str(uuid.uuid4())
        self.sessions[key] = Session(key)
        return key

    def process_message(self, session_id: str, message: str) -> Reply:
        s = self.sessions.setdefault(session_id, Session(session_id))
        s.add("user", message)
        try:
            handler = getattr(self, f"_on_{recognize_intent(message)}")
            reply = handler(message, s)
        except Exception as e:  # the user gets an answer in any case
            reply = Reply(f"Sorry, that went wrong: {e}")
        s.add("assistant", reply.message)
        s.context.update(reply.context_updates or {})
        return reply

    def _on_help(self, message: str, s: Session) -> Reply:
        return Reply(HELP)

    def _on_unknown(self, message: str, s: Session) -> Reply:
        return Reply(UNKNOWN)

    def _on_data_import(self, message: str, s: Session) -> Reply:
        if not any(w in message for w in UPLOAD_WORDS):
            return Reply("Send me a ticket export as a CSV file and I will load it.")
        if UPLOADED not in message and not s.context.get("file_uploaded"):
            return Reply("Please upload the ticket export (CSV).", action_required="file_upload")
        path = s.context.get("uploaded_file_path")
        if not path:
            return Reply("I have no uploaded file yet.")
        tasks = preprocess_tasks(load_tickets(self.spark, path)).persist()
        n = tasks.count()
        s.release()
        s.context.update(processed_tasks=tasks, total_tasks=n)
        return Reply(f"Loaded and cleaned {n} tickets; they can be clustered now.", context_updates={"data_processed": True})

    def _on_clustering(self, message: str, s: Session) -> Reply:
        if not s.context.get("data_processed"):
            return Reply("Please upload and load a file first.")
        tasks = s.context.get("processed_tasks")
        if tasks is None or not s.context.get("total_tasks"):
            return Reply("There are no tickets to cluster.")
        size = extract_parameter(message, "min_size") or s.context.get("min_cluster_size") or 10
        eps = s.context.get("cluster_epsilon") or 0.5
        r = cluster_tasks(embed_tasks(tasks, self.embedder), ClusteringParameters(min_cluster_size=size, cluster_selection_epsilon=eps))
        if old := s.context.pop("clustering_result", None):
            old.release()
        s.context["clustering_result"] = r
        return Reply(reports.summary_text(r.report, r.total_tasks, r.clusters_found, r.processing_time), context_updates={"analysis_completed": True})

    def _on_results(self, message: str, s: Session) -> Reply:
        r = s.context.get("clustering_result")
        if not s.context.get("analysis_completed") or r is None:
            return Reply("Nothing has been clustered yet.")
        at = datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
        return Reply(reports.detailed_text(r.report, r.total_tasks, r.clusters_found, r.processing_time, at), action_required="export_options")

    def _on_parameters(self, message: str, s: Session) -> Reply:
        got = {"min_cluster_size": extract_parameter(message, "min_size"), "cluster_epsilon": extract_parameter(message, "epsilon")}
        got = {k: v for k, v in got.items() if v}
        if not got:
            return Reply("Which parameter? For instance: change parameters, min size 15, or epsilon 0.3.")
        s.context.update(got)
        return Reply("Set " + ", ".join(f"{k} to {v}" for k, v in got.items()) + " for the next run.", parameters=got)

    def cleanup_session(self, session_id: str) -> None:
        if s := self.sessions.pop(session_id, None):
            s.release()

    def close(self) -> None:
        for key in list(self.sessions):
            self.cleanup_session(key)
