"""Factor models, ladders and walk-forward validation of surface panels on Spark."""
