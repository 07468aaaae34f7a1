"""Operators on DataFrames: reads, groups and windows, snapshots, merges, matching, facts, bundles, scoring."""
