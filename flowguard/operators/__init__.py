"""Dataset-level operators: every function takes and returns DataFrames or small fitted parameters."""
