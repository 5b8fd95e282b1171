"""rubrica: question-evaluation analytics as Spark DataFrame plans."""
