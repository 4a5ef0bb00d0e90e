"""corpusloom: analytics over text corpora and small relational tables, declared on the Spark DataFrame API."""
