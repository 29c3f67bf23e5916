"""Plan building blocks: one-pass aggregation, quantiles, ordered totals, lookups."""
