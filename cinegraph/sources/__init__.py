"""Where rows come from outside Spark: directories, probes, frames, file digests and the stored index."""
