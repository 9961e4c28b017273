"""Column functions: signals, sentences, time labels."""
