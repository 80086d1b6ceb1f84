"""Quote-data analytics on Spark: scans, bars, as-of joins, features, costs,
replays, rules, statistics and streams as DataFrame functions."""
