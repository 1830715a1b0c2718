"""Operators over a log of prompts and model answers, as Spark DataFrame plans."""
