"""Temporal, evidence-backed property-graph analytics on Spark DataFrames."""

from tidegraph.plans.view import Graph, View, open_view, open_views
from tidegraph.session import drop_staged, tune

__all__ = ["Graph", "View", "open_view", "open_views", "tune", "drop_staged"]
