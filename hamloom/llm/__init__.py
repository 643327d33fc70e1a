"""Operators for training data: percentiles, neighbours, increments, samples, groups, tokens, mixtures, content scores."""
