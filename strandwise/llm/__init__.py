"""Operators for preparing language-model training data.

Self-contained: nothing outside this folder imports it, and it imports nothing
from the interval engine.
"""
