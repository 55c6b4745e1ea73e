"""helixframe: a Spark-native k-mer spectrum and read-correction engine."""
