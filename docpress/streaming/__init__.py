"""Structured Streaming jobs."""

from docpress.streaming.ingest import start_ingest
from docpress.streaming.late import read_timely, start_timely, window_account
from docpress.streaming.rates import rate_stream, start_rates, start_totals
from docpress.streaming.unique import start_unique

__all__ = ["rate_stream", "read_timely", "start_ingest", "start_rates", "start_timely",
           "start_totals", "start_unique", "window_account"]
