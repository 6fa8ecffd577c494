"""Analytics over public notices, places and text corpora as Spark jobs."""
