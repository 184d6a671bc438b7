"""Analytics over an append-only log of visual observations, as Spark jobs."""
