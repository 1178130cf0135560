"""Plan-level building blocks (ordered scans, exact quantiles) and pipelines."""
