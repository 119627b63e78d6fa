"""Operators for building large training corpora.  Nothing outside this
subpackage imports it; the queries are in :mod:`tidewell.llm.queries`."""
