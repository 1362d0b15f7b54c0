"""quern: a Spark-first engine for building, curating and scoring text corpora."""
