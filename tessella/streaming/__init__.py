"""Streaming forms of the crawl state."""
