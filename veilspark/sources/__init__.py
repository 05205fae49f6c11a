"""Tables that sessions are built from. Files are read and written by Spark itself: spark.read and DataFrame.write."""
