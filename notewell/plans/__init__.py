"""Composed queries: extraction, routing, recommendation, catalogue matching, dashboards, drift."""
