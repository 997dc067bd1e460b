"""vigil - package-risk analytics on Spark.

Scores collections of Python packages for malicious behaviour without running
them: one row-parallel extraction job turns files into fact tables, and ordinary
DataFrame operators (semi-joins, grouped counts, windowed top-k, hashing,
PageRank, attention, rule and logistic scoring) turn facts into per-package
features, probabilities and reports.
"""

__version__ = "0.1.0"
