"""Experiment analytics on Spark: qualification, splits, selection, ledgers, metrics, event logs and audits."""
