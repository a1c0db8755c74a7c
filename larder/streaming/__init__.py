"""Structured Streaming forms of the daily feed, the forecasts and the stock ledger."""
