"""Causeway: causal features, ranking evaluation and corpus preparation as Spark jobs."""
