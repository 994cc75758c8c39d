"""Training-data operators: near-duplicates, tokenizers, mixing, classifiers, formats.

Nothing else in the library imports this subpackage.
"""
