"""Whole jobs: evaluation, reports, answers, commands, and the registered queries."""
