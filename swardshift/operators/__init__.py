"""DataFrame operators: joins, level-aware means, spatial and neighbour search, statistics, models."""
