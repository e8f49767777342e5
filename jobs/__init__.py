"""Runnable jobs: python -m jobs.ticket_intake, python -m jobs.cluster_digest."""
