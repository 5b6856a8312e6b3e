"""Record-log analytics on Spark: append-only tables, replay, ranges, aggregates and relations."""
