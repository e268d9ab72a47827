"""priorline: leak-free, point-in-time feature tables and market evaluation on Spark."""
