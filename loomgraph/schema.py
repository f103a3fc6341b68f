"""Schemas of edges, search keys, breadth-first trees and run metrics. Ids are long; what isn't reached has no row."""

EDGES = "src long, dst long"
ROOTS = "run int, source long"
TREE = "run int, v long, d int, parent long"
METRICS = "total_time double, comm_time double, teps double, max_over_mean double, cv double"
RESULTS = METRICS + ", graph string, variant string, cores int, filename string"
KRONECKER = "edge_id long, src long, dst long"
