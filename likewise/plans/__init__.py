"""Whole jobs: training, refreshing, answering queries."""
