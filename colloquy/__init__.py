"""colloquy: a Spark-native analytics engine for long-form dialogue transcripts."""
