"""DataFrame operators: routing, replies, ranking, profiling, similarity, evaluation."""
