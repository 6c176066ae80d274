"""Whole flows: balancing a dataset, comparing two, profiling questions and answers."""
