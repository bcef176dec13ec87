"""trackloom: analytics for object-track events and question-answer benchmarks on PySpark."""
