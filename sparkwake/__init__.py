"""sparkwake: service-dependency graphs and change reach, as Spark plans."""
