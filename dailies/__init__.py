"""Spark operators for footage transcripts, edit decisions and cost ledgers."""

from dailies.session import build_session

__all__ = ["build_session"]
