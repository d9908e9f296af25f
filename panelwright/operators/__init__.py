"""Table operators: DataFrame(s) and parameters in, DataFrame(s) out."""
