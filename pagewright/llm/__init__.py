"""Training-data operators: each module holds one operator and a thin query over the test tables."""
