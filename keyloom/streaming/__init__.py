"""Incremental profiles of a stream of rows: value frequencies are kept up to date batch by batch."""
