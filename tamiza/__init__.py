"""tamiza: cleaning, annotating and analysing Spanish review text with PySpark."""
