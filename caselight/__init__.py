"""caselight: Spark-native operators for scored cases, reviews, labels and audit trails."""
