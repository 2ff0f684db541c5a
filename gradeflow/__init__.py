"""gradeflow: classification, grading and corpus preparation as Spark DataFrame operators."""
