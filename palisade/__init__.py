"""Bracket-disciplined text and markup analytics on Spark."""
