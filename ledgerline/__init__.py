"""ledgerline: a Spark-native retail order analytics library.

Sub-packages:
  sources    table readers, the shop-table mapping, seed generators, sinks
  functions  column helpers for dialect differences (clock, NULL order, concat)
  operators  reusable set-based operators: upsert, ids, defaults, constraints,
             audit diff, and the batch forms of the order-management steps
  plans      the analytical statements and reports
  streaming  Structured Streaming forms of the rollup and of reservations
"""

__version__ = "0.1.0"
