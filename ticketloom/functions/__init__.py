"""Column expressions: text cleaning, rule flags, features, prompts."""
