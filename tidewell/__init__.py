"""Keyed-table convergence on Spark: change sets, keyed apply, chunked copy,
retention, reconciliation, and the metadata analysis around them."""
