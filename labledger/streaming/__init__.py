"""Structured Streaming jobs: stateless scoring of arriving orders and
micro-batch import of arriving line-item exports."""
