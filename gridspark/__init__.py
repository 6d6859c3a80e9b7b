"""Analytics on gridded, station and ensemble data, and on text corpora, as Spark plans."""
