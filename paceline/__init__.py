"""Race analytics as Spark jobs: landing, features, probabilities, evaluation and live updates."""
