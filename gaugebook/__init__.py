"""Exactly-once accounting of device measurements on Spark DataFrames."""

from gaugebook.session import build_session, prepare

__all__ = ["build_session", "prepare"]
