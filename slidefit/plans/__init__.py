"""Plan-time objects: models, segments, costs; they reach executors as literals only."""
