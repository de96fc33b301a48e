"""Column functions: text cleaning, composition, prompts, arrays and metrics."""
