"""Registered queries, their SQL, and the question planner."""
