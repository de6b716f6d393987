"""Storage-growth analytics on Spark: inventories, snapshots, diffs, timelines and change journals."""
