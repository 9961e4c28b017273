"""Trace narrative analytics on Spark."""
