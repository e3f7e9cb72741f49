"""Whole plans: test views, the lifecycle tick, registered queries and their SQL counterparts."""
