"""Question-answer corpora, answer mining, cloze questions and text scores on Spark."""
