"""DataFrame operators: lazy, declarative, and partitioned by the keys they work on."""
