"""Training-data operators over whole corpora: text kernels, near copies, language and toxicity models, packing, search.

Nothing else in the library imports this package. The queries are in ``queries``.
"""
