"""Training-data operators: tokens, secrets, licences, duplicates, nearest neighbours, packing, quality, language-model scores.

Nothing else in the library imports this subpackage.
"""
