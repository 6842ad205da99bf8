"""Operators on the texts and judgements of a training-data corpus."""
