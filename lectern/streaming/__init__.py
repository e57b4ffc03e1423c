"""Stateful operators: rate limits, event protocols and conversation state, as batch jobs and as streams."""
