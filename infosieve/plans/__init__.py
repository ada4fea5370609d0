"""Query plans over the driver tables, the selection job and the ML estimator."""
