"""Table, source-tree and change-feed sources."""
