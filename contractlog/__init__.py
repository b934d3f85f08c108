"""contractlog: append-only record logs under a runtime contract, on DataFrames."""
