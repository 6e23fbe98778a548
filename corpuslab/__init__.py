"""corpuslab: corpus engineering, n-gram memory statistics and evaluation analytics as Spark jobs."""
