"""loamwork: DataFrame-to-DataFrame jobs for building and studying a knowledge corpus on Spark."""
