"""lectern: a Spark-native engine for text corpora, lexicons and reading evidence."""
