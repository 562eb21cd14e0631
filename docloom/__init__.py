"""docloom: a Spark-native document-intelligence and corpus-preparation engine."""
