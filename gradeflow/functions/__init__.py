"""Column functions; none of them runs Python on the executors but those of ``similarity``."""
