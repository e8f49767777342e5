"""ticketloom: lazy DataFrame operators for ticket-text analytics on Apache Spark."""

__version__ = "0.1.0"
