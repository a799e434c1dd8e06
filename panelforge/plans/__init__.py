"""Ready-made plans: the county study and the registered queries with their SQL oracles."""
