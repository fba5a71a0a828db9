"""DataFrame operators: selection, observables, features, statistics and models."""
