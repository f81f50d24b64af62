"""factsieve: data profiling, cleaning, statistics and modelling as Spark jobs."""
