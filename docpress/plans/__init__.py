"""Whole jobs put together from the operators."""

from docpress.plans.batch import BatchRun, run_batch
from docpress.plans.daily import checked_run
from docpress.plans.stream import run_stream

__all__ = ["BatchRun", "checked_run", "run_batch", "run_stream"]
