"""A Spark-native analytics engine over several data models, asked through one nested query language."""
