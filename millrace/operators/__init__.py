"""Estimators and dataflow operators."""
